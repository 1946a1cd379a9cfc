"""Arrow IPC streams, and append-only logs of JSON lines read by byte offset, in batch and as a stream."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a log that one task reads.
PIECE = 64 << 20


def read_arrow_streams(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows of Arrow IPC stream files (or IPC files) below ``path``, a task for each file; anything Spark can list, local or remote.

    Record batches go on as they are, without becoming rows in Python; columns of ``schema`` are taken by name, and one that a
    file lacks is null. A file must fit into a task (2 GB at most).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for content in files.column(0):
                data = content.as_buffer()
                whole = bytes(data[:6]) == b"ARROW1"
                reader = pa.ipc.open_file(data) if whole else pa.ipc.open_stream(io.BytesIO(data))
                for batch in (reader.get_batch(i) for i in range(reader.num_record_batches)) if whole else reader:
                    own = set(batch.schema.names)
                    columns = [batch.column(f.name).cast(f.type) if f.name in own else pa.nulls(batch.num_rows, f.type) for f in wanted]
                    yield pa.RecordBatch.from_arrays(columns, schema=wanted)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, schema)


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__(None)
        self.first, self.last = first, last


def _whole(path: str, start: int) -> int:
    """The offset after the last whole line from ``start`` on; what follows is still being written."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        at = size
        while at > start:
            step = min(1 << 16, at - start)
            f.seek(at - step)
            cut = f.read(step).rfind(b"\n")
            if cut >= 0:
                return at - step + cut + 1
            at -= step
    return start


def _ranges(first: int, last: int, piece: int) -> list[Range]:
    return [Range(a, min(a + piece, last)) for a in range(first, last, piece)]


def _lines(path: str, part: Range, begin: int) -> Iterator[tuple[int, str]]:
    """(offset, line) of the lines that begin in a range; ``begin`` begins a line."""
    with open(path, "rb") as f:
        at = part.first
        if at > begin:
            f.seek(at - 1)
            at += len(f.readline()) - 1
        else:
            f.seek(at)
        while at < part.last:
            line = f.readline()
            if line.strip():
                yield at, line.rstrip(b"\r\n").decode("utf-8", errors="replace")
            at += len(line)


class _Lines(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.begin, self.piece = options["path"], int(options.get("offset", 0)), int(options.get("piece", PIECE))

    def partitions(self) -> list[Range]:
        return _ranges(self.begin, _whole(self.path, self.begin), self.piece)

    def read(self, partition: Range | None) -> Iterator[tuple[int, str]]:
        # Without a piece Spark asks once, for none.
        if partition is not None:
            yield from _lines(self.path, partition, self.begin)


class _LineStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.begin, self.piece = options["path"], int(options.get("offset", 0)), int(options.get("piece", PIECE))

    def initialOffset(self) -> dict:
        return {"offset": self.begin}

    def latestOffset(self) -> dict:
        return {"offset": _whole(self.path, self.begin)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return _ranges(start["offset"], end["offset"], self.piece)

    def read(self, partition: Range | None) -> Iterator[tuple[int, str]]:
        # Offsets of batches begin lines, but those of pieces may not.
        if partition is not None:
            yield from _lines(self.path, partition, self.begin)


class AppendLog(DataSource):
    """Format ``append_log``: (offset, line) of the whole lines of a growing file, from ``offset`` on (0 by default).

    A last line without its end is left for the next read. Blank lines are passed over. Lines are read on executors, ``piece``
    bytes to a task; driver and executors must see the path. As a stream it goes on from the offset in its checkpoint, so a line
    is read once.
    """

    @classmethod
    def name(cls) -> str:
        return "append_log"

    def schema(self) -> str:
        return "offset long, line string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Lines(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _LineStream(self.options)


def append_log(spark: SparkSession, path: str, offset: int = 0, stream: bool = False) -> DataFrame:
    """A log as a table, or as a stream."""
    spark.dataSource.register(AppendLog)
    return (spark.readStream if stream else spark.read).format("append_log").option("offset", offset).load(path)
