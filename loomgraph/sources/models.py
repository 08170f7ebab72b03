"""Price lists of models, as JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCHEMA = "data array<string>"


def parse(documents: DataFrame, column: str = "body") -> DataFrame:
    """id, name, context_length, prompt_price, completion_price, free of each model.

    ``documents`` holds one JSON text with a list ``data`` a row.  Entries that
    are no objects or have no id are left out; a price that is no number is
    null; a model is free if its prompts cost 0."""
    entries = documents.select(F.explode(F.from_json(column, _SCHEMA)["data"]).alias("m"))
    get = lambda path: F.get_json_object("m", f"$.{path}")
    price = lambda kind: get(f"pricing.{kind}").try_cast("double")
    rows = entries.select(
        get("id").alias("id"),
        F.coalesce(F.nullif(get("name"), F.lit("")), get("id")).alias("name"),
        get("context_length").try_cast("bigint").alias("context_length"),
        price("prompt").alias("prompt_price"),
        price("completion").alias("completion_price"),
        F.coalesce(price("prompt") == 0, F.lit(False)).alias("free"),
    )
    return rows.where("id is not null and id != ''")


def free_only(models: DataFrame) -> DataFrame:
    return models.where("free")


def grouped(number: Column) -> Column:
    """A whole number with commas between its thousands."""
    return F.format_number(number, 0)


def price_label(models: DataFrame) -> DataFrame:
    """``models`` with ``context`` and ``price`` as text, six significant digits, ``?`` where unknown."""
    digits = F.format_string("%.5e", "prompt_price").cast("double").cast("decimal(30,18)").cast("string")
    plain = F.regexp_replace(digits, r"\.?0+$", "")
    price = F.when(F.col("free"), "free").when(F.col("prompt_price").isNotNull(), F.concat(F.lit("$"), plain, F.lit("/token"))).otherwise("?")
    return models.withColumns({"context": F.coalesce(grouped(F.col("context_length")), F.lit("?")), "price": price})
