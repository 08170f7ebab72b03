"""A scan of a source tree whose folders are listed by tasks.

    files = listing.listed(spark, "/shared/repo")
    scan = listing.with_contents(files.where("path like 'src/%'"), "/shared/repo")

The tree is listed a depth at a time: the folders of one depth are rows, dealt
to tasks, and what they hold is a table that gives the next depth.  Order and
bounds are then decided over all files, by a sort on the path's parts and a
running count, so a filter before ``with_contents`` does not change which files
fall under the bounds, and only reads less.  The rows equal those of the data
source ``repository`` without its following of links, which needs one walker.

Folders that can't be read hold nothing.  Names that are not UTF-8 are shown
with escapes, and their files are read errors.  An empty tree has no rows.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators.windows import first_of
from loomgraph.plans.storage import drop_stash, stash
from loomgraph.sources.languages import EXTENSIONS
from loomgraph.sources.repository import EXCLUDED, MAX_BYTES, MAX_DEPTH, MAX_FILES, MAX_SECONDS, OWN, SCHEMA, is_source

LISTED = "path string, name string, depth int, walk_order bigint, size bigint, is_symlink boolean, status string, reason string"
_ENTRY = "parts array<string>, name string, folder boolean, size bigint, is_symlink boolean"
#: Bytes of content in one batch, but for a single larger file.
BATCH_BYTES = 16 << 20


def _shown(name: str) -> str:
    return name.encode("utf-8", "backslashreplace").decode()


def _entries(root: str, excluded: frozenset[str]):
    """What lies in each folder (``parts``, from the root); folders that are left out are not listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts in batch["parts"].to_pylist():
                rows = []
                try:
                    found = list(os.scandir(os.path.join(root, *parts)))
                except OSError:
                    found = []
                for entry in found:
                    try:
                        link = entry.is_symlink()
                        folder = entry.is_dir()
                        size = entry.stat(follow_symlinks=False).st_size
                    except OSError:  # gone since
                        continue
                    if not folder:
                        rows.append((parts, _shown(entry.name), False, size, link))
                    elif not link and entry.name not in excluded and not entry.name.startswith(OWN):
                        rows.append((parts, _shown(entry.name), True, 0, False))
                columns = list(zip(*rows)) or [()] * 5
                kinds = (pa.list_(pa.string()), pa.string(), pa.bool_(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in _ENTRY.split(", ")])

    return run


def listed(
    spark: SparkSession,
    root: str,
    excluded: list[str] | None = None,
    max_files: int = MAX_FILES,
    max_bytes: int = MAX_BYTES,
    max_depth: int = MAX_DEPTH,
    folders_per_task: int = 64,
) -> DataFrame:
    """The files of a tree in the order of a walk: a folder's files, then its folders, by name.

    ``status`` is ``skipped`` for links, and past ``max_files`` sources of at most ``max_bytes``."""
    root, left_out = os.path.realpath(root), frozenset(EXCLUDED if excluded is None else excluded)
    folders, found = spark.createDataFrame([([],)], "parts array<string>"), []
    many = 1
    for _ in range(max_depth):
        dealt = folders.repartition(max(1, -(-many // folders_per_task)))
        found.append(stash(dealt.mapInArrow(_entries(root, left_out), _ENTRY), "listed"))
        folders = found[-1].where("folder").select(F.concat("parts", F.array("name")).alias("parts"))
        many = folders.count()
        if not many:
            break
    every = spark.createDataFrame([], _ENTRY)
    for one in found:
        every = every.union(one.where("not folder"))
    # files come before folders, each by name
    key = F.concat(F.transform("parts", lambda p: F.concat(F.lit("1"), p)), F.array(F.concat(F.lit("0"), "name")))
    ordered = stash(every.repartitionByRange(key).sortWithinPartitions(key).withColumn("at", F.monotonically_increasing_id()), "ordered")
    drop_stash(*found)
    # a row for each partition of the sort
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    order = (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("walk_order")
    rows = ordered.withColumn("part", part).join(F.broadcast(sizes.select("part", before.alias("before"))), "part")
    rows = rows.select(F.array_join(F.concat("parts", F.array("name")), "/").alias("path"), "name", F.size("parts").alias("depth"), order, "size", "is_symlink")
    suffix = F.lower(F.concat(F.lit("."), F.substring_index("name", ".", -1)))
    source = F.col("name").contains(".") & suffix.isin(*EXTENSIONS)
    capped = first_of(rows, "walk_order", source & ~F.col("is_symlink") & (F.col("size") <= max_bytes), max_files)
    reason = F.when(F.col("capped"), "max_files_reached").when(F.col("is_symlink"), "symlink").otherwise("")
    out = capped.select(*rows.columns, F.when(reason == "", "").otherwise("skipped").alias("status"), reason.alias("reason"))
    done = stash(out.sortWithinPartitions("path"), "files")
    drop_stash(ordered)
    return done


def _contents(root: str, contents: str, max_bytes: int, until: float):
    """Reads the files of each row, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, states = 0, [], []

            def flush(end: int) -> pa.RecordBatch:
                status, reason = zip(*states)
                known = batch.slice(start, end - start).drop_columns(["status", "reason"])
                columns = [*known.columns, pa.array(status), pa.array(reason), pa.array(held, pa.binary())]
                return pa.RecordBatch.from_arrays(columns, [*known.schema.names, "status", "reason", "content"])

            size_held = 0
            for at, (path, name, size, status, reason) in enumerate(zip(*(batch[c].to_pylist() for c in ("path", "name", "size", "status", "reason")))):
                content = None
                if not status and size > max_bytes:
                    status, reason = "skipped", f"file_too_large: {size} > {max_bytes}"
                elif not status and time.time() > until:
                    status, reason = "skipped", "wall_clock_exceeded"
                elif not status and (contents == "true" or contents == "sources" and is_source(name)):
                    try:
                        with open(os.path.join(root, path), "rb") as f:
                            content = f.read(max_bytes + 1)
                    except OSError as e:
                        status, reason = "skipped", f"read_error: {e.strerror}"
                held.append(content)
                states.append((status, reason))
                size_held += len(content or b"")
                if size_held > BATCH_BYTES:
                    yield flush(at + 1)
                    start, held, states, size_held = at + 1, [], [], 0
            if states:
                yield flush(batch.num_rows)

    return run


def with_contents(files: DataFrame, root: str, contents: str = "true", max_bytes: int = MAX_BYTES, max_seconds: float = MAX_SECONDS, files_per_task: int = 64) -> DataFrame:
    """A scan (``repository.SCHEMA``) of listed files; ``contents`` as the data source's ``withContent``.

    ``max_seconds`` run from this call on."""
    many = max(1, -(-files.count() // files_per_task))
    dealt = files.select(*(c.split()[0] for c in LISTED.split(", "))).repartition(many, "walk_order")
    return dealt.mapInArrow(_contents(os.path.realpath(root), contents, max_bytes, time.time() + max_seconds), SCHEMA)
