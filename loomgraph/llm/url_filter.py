"""URL filters by expressions and hash prefixes.

Each distinct URL is expanded into expressions of a host suffix and a path
prefix, but only of the shapes that rules have: so many labels, so many
characters.  A URL thus has at most one expression for each shape, however
long it is.  Expressions and rules are hashed with SHA-256 and joined on the
first 32 bits; the full digest then confirms, and of the confirmed rules the
longest wins (the longer host of equally long ones).

The joined sides are plain equi-joins: Spark broadcasts the rules only below
its size limit and splits hot hosts otherwise.  The verdicts of distinct URLs
are written before they meet all rows, so that Spark can split a hot URL.
Shapes, pairs of small numbers, come to the driver: at most as many as labels
of a host times characters of a path, whatever the number of rules.

Edge cases: a null URL or one without ``://`` has an empty host and path and no
rule fits it.  A path is taken as written, so a URL without a path fits no rule
whose path is ``/``.  Equal rules count once; of contradicting ones, allow
wins.  Rules with a null host or path fit nothing.  Rows repeat as given;
further columns are ignored.
"""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import stash


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: str) -> Column:
    return F.length(host) - F.length(F.translate(F.col(host), ".", "")) + 1


def _expressions(shapes: list[tuple[int, int]]) -> Column:
    """Structs (host, path) for the columns ``host`` and ``path``, one for each shape that fits."""
    by: dict[int, list[int]] = defaultdict(list)
    for labels, length in sorted(shapes):
        by[labels].append(length)
    # one literal, whatever the number of shapes
    known = F.from_json(F.lit(json.dumps([{"labels": k, "lengths": v} for k, v in by.items()])), "array<struct<labels:int,lengths:array<int>>>")
    fits = F.filter(known, lambda s: s["labels"] <= F.col("labels"))
    of_host = lambda s: F.transform(
        F.filter(s["lengths"], lambda n: n <= F.length("path")),
        lambda n: F.struct(F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]).alias("host"), F.substring(F.col("path"), F.lit(1), n).alias("path")),
    )
    return F.flatten(F.transform(fits, of_host))


def _digested(rows: DataFrame) -> DataFrame:
    """``prefix``, the first 32 bits, and ``digest`` of host and path."""
    whole = F.sha2(F.concat_ws("/", F.length("host").cast("string"), F.concat("host", "path")), 256)
    return rows.withColumn("digest", whole).withColumn("prefix", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of each row of (page_id, url).

    ``rules``: host, path, verdict (``allow`` or ``block``)."""
    rules = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict")).withColumn("rule", F.concat("host", "path"))
    shapes = [tuple(r) for r in rules.select(_labels("host"), F.length("path")).distinct().collect()]
    urls = pages.where("instr(url, '://') > 0").select("url").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    shown = urls.withColumn("labels", _labels("host")).select("url", F.explode(_expressions(shapes)).alias("e"))
    met = _digested(shown.select("url", "e.host", "e.path")).select("url", "prefix", "digest").join(
        _digested(rules).select("prefix", F.col("digest").alias("whole"), "rule", "verdict", F.length("rule").alias("n"), F.length("host").alias("h")), "prefix"
    )
    best = met.where("digest = whole").groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), F.struct("n", "h", "rule")).alias("best"))
    # URLs that no rule can fit are spread by their page
    meets = F.when(F.instr("url", "://") > 0, F.col("url")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id").cast("string")))
    judged = pages.select("page_id", "url", meets.alias("meets")).join(stash(best, "verdicts").withColumnRenamed("url", "meets"), "meets", "left")
    return judged.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
