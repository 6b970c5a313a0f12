"""A data sink for results: one JSON array or one table of text, written by all tasks and committed as a whole.

Tasks write their rows as JSON lines beside the target, under a name of the write's own.  The commit puts them together in
the order of partitions, a line at a time, under a temporary name, which becomes the target's at the end.  A write that fails
leaves no target, and one that was there before stays as it was; nothing of the result is ever in the driver's memory.

    spark.dataSource.register(Result)
    rows.write.format("quillstone_result").option("path", "/out/hits.json").option("kind", "json").mode("append").save()

Cases: nulls are null in JSON and empty in text; names in text are cut at 60 letters; an empty result is an empty array, or
the line of names.
"""

from __future__ import annotations

import datetime
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Letters of a name in text.
LONGEST = 60


@dataclass
class Part(WriterCommitMessage):
    path: str
    partition: int
    widths: list[int]


class ResultWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.target, self.kind, self.names = options["path"], options.get("kind", "json"), names
        if self.kind not in ("json", "text"):
            raise ValueError(f"{self.kind!r} is neither json nor text")
        self.beside = f"{self.target}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Part:
        n, widths = TaskContext.get().partitionId(), [0] * len(self.names)
        path = f"{self.beside}/part-{n:06d}-{uuid.uuid4().hex}"  # a repeated try of a task has a file of its own
        system, inner = filesystem(path)  # in the folder that the driver made: once an abort took it away, late tasks fail, too
        with system.open_output_stream(inner, compression=None) as sink:
            for row in iterator:
                values = row.asDict(recursive=True)
                if self.kind == "text":
                    values = dict(zip(self.names, cells(self.names, row), strict=True))
                    widths = [max(w, len(v)) for w, v in zip(widths, values.values(), strict=True)]
                sink.write(json.dumps(values, ensure_ascii=False, default=_shown).encode() + b"\n")
        return Part(path, n, widths)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        fresh = f"{self.beside}/whole"
        system, inner = filesystem(fresh)
        with system.open_output_stream(inner, compression=None) as sink:
            (self._array if self.kind == "json" else self._text)(sink, parts)
        _, target = filesystem(self.target)
        system.move(inner, target)
        self._clear()

    def _lines(self, parts: list[Part]) -> Iterator[bytes]:
        for p in parts:
            system, inner = filesystem(p.path)
            with system.open_input_stream(inner, compression=None) as source:
                yield from (line.rstrip(b"\n") for line in io.BufferedReader(source, 1 << 20))

    def _array(self, sink, parts: list[Part]) -> None:
        sink.write(b"[")
        for i, line in enumerate(self._lines(parts)):
            sink.write((b",\n " if i else b"\n ") + line)
        sink.write(b"\n]\n")

    def _text(self, sink, parts: list[Part]) -> None:
        widths = [max([len(name), *(p.widths[i] for p in parts)]) for i, name in enumerate(self.names)]
        padded = lambda values: "  ".join(v.ljust(w) for v, w in zip(values, widths, strict=True)).rstrip() + "\n"
        sink.write(padded(self.names).encode())
        for line in self._lines(parts):
            sink.write(padded(json.loads(line).values()).encode())

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, inner = filesystem(self.beside)
        if system.get_file_info(inner).type != pafs.FileType.NotFound:
            system.delete_dir(inner)


class Result(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillstone_result"

    def writer(self, schema, overwrite: bool) -> ResultWriter:
        writer = ResultWriter({k.lower(): v for k, v in self.options.items()}, schema.names)
        system, inner = filesystem(writer.beside)
        system.create_dir(inner, recursive=True)
        return writer


def cells(names: list[str], row) -> list[str]:
    """A row's values as they stand in text."""
    return ["" if v is None else str(v).replace("\n", " ")[:LONGEST] if k == "name" else str(v).replace("\n", " ") for k, v in zip(names, row, strict=True)]


def _shown(value):
    return value.isoformat() if isinstance(value, datetime.date | datetime.datetime) else str(value)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path that all tasks reach, and the path in it; plain paths are local."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def save(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Writes a result as one file."""
    rows.sparkSession.dataSource.register(Result)
    rows.write.format("quillstone_result").option("path", path).option("kind", kind).mode("append").save()
