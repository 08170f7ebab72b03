"""A sink of audit records: redacted JSON lines, whole jobs or nothing.

    rows.write.format("audit").mode("append").option("path", folder).option("level", "info").save()

Each task writes a file of its own in a folder of the job; when all have ended
their files move next to those of other jobs, which are never touched, so jobs
may write at once.  Files of tasks that failed, ran twice or belong to a job
that was stopped stay behind in the job's folder, which goes with it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from loomgraph.functions.redact import redact_tree

LEVELS = {"debug": 10, "info": 20, "warning": 30, "error": 40}


@dataclass
class _Written(WriterCommitMessage):
    """A file of one task, if it had a record at all."""

    name: str | None


def _folder(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def record_line(row: dict, least: str) -> str | None:
    """The redacted record, keys in order and without nulls; None below the level.  A level that is none of the four counts as info."""
    if LEVELS.get(row.get("level"), LEVELS["info"]) < LEVELS[least]:
        return None
    clean, _ = redact_tree({k: v for k, v in row.items() if v is not None})
    return json.dumps(clean, sort_keys=True, default=str)


class AuditWriter(DataSourceWriter):
    def __init__(self, path: str, level: str, overwrite: bool):
        if level not in LEVELS:
            raise ValueError(f"level is one of {', '.join(LEVELS)}, not {level!r}")
        if overwrite:
            raise ValueError("audit records are only appended")
        self.path, self.level, self.job = path, level, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        files, root = _folder(self.path)
        lines = (line for row in iterator if (line := record_line(row.asDict(recursive=True), self.level)) is not None)
        first = next(lines, None)
        if first is None:
            return _Written(None)
        name = f"{self.job}-{uuid.uuid4().hex}.json"
        files.create_dir(f"{root}/_job-{self.job}", recursive=True)
        with files.open_output_stream(f"{root}/_job-{self.job}/{name}") as out:
            out.write(f"{first}\n".encode())
            for line in lines:
                out.write(f"{line}\n".encode())
        return _Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _folder(self.path)
        for message in messages:
            if message and message.name:
                files.move(f"{root}/_job-{self.job}/{message.name}", f"{root}/{message.name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _folder(self.path)
        at = f"{root}/_job-{self.job}"
        if files.get_file_info(at).type == pyarrow.fs.FileType.Directory:
            files.delete_dir(at)


class AuditSink(DataSource):
    """Appends records of any columns; ``level`` is among them, if they have one."""

    @classmethod
    def name(cls) -> str:
        return "audit"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return AuditWriter(self.options["path"], self.options.get("level", "info"), overwrite)
