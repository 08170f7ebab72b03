"""Scalar functions on content and text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a question that name no symbol by themselves.
STOP_WORDS = (
    "the and for what which where how does did why this that with from into when who are was were can could would should about show tell give find "
    "explain code codebase repo repository file files function functions class classes method methods call calls use used uses using connect connects connected "
    "between impact affect affects happens happen there get set all any not but you your its have"
).split()

TOKEN = "[A-Za-z_][A-Za-z0-9_]{2,}"
CHARS_PER_TOKEN = 3.5


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def is_stop_word(word: Column) -> Column:
    return F.lower(word).isin(*STOP_WORDS)


def line_count(text: Column) -> Column:
    """Line feeds and one more."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("bigint")


def snippet(text: Column, start_line: Column, most: int = 12) -> Column:
    """At most ``most`` lines from ``start_line`` (1-based) on."""
    return F.slice(F.split(text, "\n", -1), F.greatest(start_line, F.lit(1)), most)


def unquoted(text: Column) -> Column:
    """Without white space, then double, then single quotes at both ends."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), '^"+|"+$', ""), "^'+|'+$", "")


def requirement_name(line: Column) -> Column:
    """The name before a version, extra or marker."""
    return F.element_at(F.split(line, r"[<>=!\[~; ]", 2), 1)


def token_estimate(text: Column) -> Column:
    return (F.floor(F.length(text) / F.lit(CHARS_PER_TOKEN)) + 1).cast("bigint")


def cost_estimate(prompt_tokens: Column, completion_tokens: Column, per_million: float = 5.0) -> Column:
    return F.round((prompt_tokens + completion_tokens) / F.lit(1e6) * F.lit(per_million), 6)


def trimmed_to(text: Column, most_chars: int) -> Column:
    return F.substring(text, 1, most_chars)


def last_segment(id_: Column) -> Column:
    return F.substring_index(id_, "::", -1)


def file_status(size: Column, content: Column, language: Column, is_symlink: Column, most_bytes: int) -> Column:
    """Status and reason of a file before it is parsed, in the order of the checks."""
    status = lambda s, r: F.struct(F.lit(s).alias("status"), r.alias("reason"))
    return (
        F.when(language.isNull() | (language == ""), status("unsupported", F.lit("no grammar")))
        .when(is_symlink, status("skipped", F.lit("symlink")))
        .when(size > most_bytes, status("skipped", F.format_string("file_too_large: %d > %d", size, F.lit(most_bytes))))
        .when(F.instr(F.substring(content, 1, 8192).cast("binary").cast("string"), "\0") > 0, status("skipped", F.lit("binary")))
        .when(~F.is_valid_utf8(content), status("unparsed", F.lit("utf8_decode_error")))
        .otherwise(status("parsed", F.lit("")))
    )
