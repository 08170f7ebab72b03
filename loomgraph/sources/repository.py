"""A bounded scan of a source tree as a Spark data source.

    spark.dataSource.register(RepositorySource)
    spark.read.format("repository").option("root", "/shared/repo").load()

The driver lists names (excluded folders are not entered, depth and number of
sources are bounded: files of a known language and at most ``maxBytes``); tasks
read the contents, until ``maxSeconds`` after the listing are over.  On a cluster the root has to be
a folder that all executors see.  ``withContent`` says whose contents are read: of
all files (``true``), of none (``false``) or of files of a known language
(``sources``, which is all that extraction looks at); files over ``maxBytes`` never are.

With the option ``pushdown`` (and ``spark.sql.python.filterPushdown.enabled``, which it needs),
filters on what a listing knows (path, name, depth, order, size, link) are taken over: files that they leave out
are not read, and still count for the bounds.  ``listing`` has the folders listed by tasks.
"""

from __future__ import annotations

import operator
import os
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomgraph.sources.languages import EXTENSIONS

SCHEMA = "path string, name string, depth int, walk_order bigint, size bigint, is_symlink boolean, status string, reason string, content binary"

# Folders that hold no sources of their own, and the default bounds.
EXCLUDED = (
    ".git .hg .svn .venv venv env node_modules __pycache__ .mypy_cache .pytest_cache .ruff_cache .tox dist build target vendor third_party .next .nuxt site-packages"
).split()
#: Folders that start so hold what this library wrote.
OWN = ".loomgraph"
MAX_FILES, MAX_BYTES, MAX_DEPTH, MAX_SECONDS = 5000, 1 << 20, 25, 120.0


@dataclass
class Chunk(InputPartition):
    root: str
    files: list[tuple]
    until: float


def is_source(name: str) -> bool:
    return "." in name and f".{name.rpartition('.')[2]}".lower() in EXTENSIONS


def walk(root: str, excluded: frozenset[str], max_files: int, max_depth: int, follow: bool = False, max_bytes: int = MAX_BYTES) -> Iterator[tuple]:
    """(path, name, depth, order, size, is_symlink, status, reason), folders and files in sorted order."""
    taken, order, seen = 0, 0, set()
    for folder, names, files in os.walk(root, followlinks=follow):
        here = os.stat(folder)
        if (here.st_dev, here.st_ino) in seen:
            names.clear()
            continue
        seen.add((here.st_dev, here.st_ino))
        inside = os.path.relpath(folder, root).replace(os.sep, "/")
        depth = 0 if inside == "." else inside.count("/") + 1
        if depth >= max_depth:
            names.clear()
            continue
        names[:] = sorted(n for n in names if n not in excluded and not n.startswith(OWN))
        for name in sorted(files):
            full = os.path.join(folder, name)
            link = os.path.islink(full)
            sound = not link or os.path.exists(full)
            size = (os.stat if follow and sound else os.lstat)(full).st_size
            reason = "max_files_reached" if taken >= max_files else "symlink" if link and not follow else ""
            taken += not reason and is_source(name) and sound and size <= max_bytes
            yield (name if inside == "." else f"{inside}/{name}", name, depth, order, size, link, "skipped" if reason else "", reason)
            order += 1


#: Columns that the listing knows, in its order.
_KNOWN = ("path", "name", "depth", "walk_order", "size", "is_symlink")
_COMPARED: dict[type, Callable] = {
    ds.EqualTo: operator.eq,
    ds.EqualNullSafe: operator.eq,
    ds.GreaterThan: operator.gt,
    ds.GreaterThanOrEqual: operator.ge,
    ds.LessThan: operator.lt,
    ds.LessThanOrEqual: operator.le,
    ds.In: lambda value, listed: value in listed,
    ds.StringStartsWith: str.startswith,
    ds.StringEndsWith: str.endswith,
    ds.StringContains: str.__contains__,
}


def holds(filter_: ds.Filter, file: tuple) -> bool | None:
    """Whether a listed file meets a filter; none if the listing can't tell."""
    if isinstance(filter_, ds.Not):
        inner = holds(filter_.child, file)
        return None if inner is None else not inner
    if len(filter_.attribute) != 1 or filter_.attribute[0] not in _KNOWN:
        return None
    if isinstance(filter_, (ds.IsNull, ds.IsNotNull)):
        return isinstance(filter_, ds.IsNotNull)
    # a comparison with null is for Spark to judge
    if type(filter_) not in _COMPARED or filter_.value is None or isinstance(filter_, ds.In) and None in filter_.value:
        return None
    return bool(_COMPARED[type(filter_)](file[_KNOWN.index(filter_.attribute[0])], filter_.value))


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        get = lambda key, default: type(default)(options.get(key.lower(), default))
        self.root = os.path.realpath(options["root"])
        self.bounds = get("maxFiles", MAX_FILES), get("maxDepth", MAX_DEPTH), get("maxBytes", MAX_BYTES)
        self.excluded = frozenset(options["exclude"].split(",") if "exclude" in options else EXCLUDED)
        self.with_content = options.get("withcontent", "true")
        self.follow = options.get("followsymlinks", "false") == "true"
        self.chunk = get("filesPerTask", 64)
        self.seconds = get("maxSeconds", MAX_SECONDS)
        self.filters: list[ds.Filter] = []

    def partitions(self) -> list[Chunk]:
        walked = walk(self.root, self.excluded, self.bounds[0], self.bounds[1], self.follow, self.bounds[2])
        files = [file for file in walked if all(holds(one, file) for one in self.filters)]
        until = time.time() + self.seconds
        return [Chunk(self.root, files[k : k + self.chunk], until) for k in range(0, len(files), self.chunk)] or [Chunk(self.root, [], until)]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        for path, name, depth, order, size, link, status, reason in partition.files:
            content = None
            if not status and size > self.bounds[2]:
                status, reason = "skipped", f"file_too_large: {size} > {self.bounds[2]}"
            elif not status and time.time() > partition.until:
                status, reason = "skipped", "wall_clock_exceeded"
            elif not status and (self.with_content == "true" or self.with_content == "sources" and is_source(name)):
                try:
                    with open(os.path.join(partition.root, path), "rb") as f:
                        content = f.read(self.bounds[2] + 1)
                except OSError as e:
                    status, reason = "skipped", f"read_error: {e.strerror}"
            yield path, name, depth, order, size, link, status, reason, content


class FilteringReader(RepositoryReader):
    """Takes filters over; a class of its own, as Spark refuses such readers where it does not push filters."""

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for one in filters:
            if holds(one, ("", "", 0, 0, 0, False)) is None:
                yield one
            else:
                self.filters.append(one)


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepositoryReader:
        kind = FilteringReader if self.options.get("pushdown", "false") == "true" else RepositoryReader
        return kind(dict(self.options))
