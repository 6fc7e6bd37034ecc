"""Subscription to logs that applications append to: a streaming source with offsets in bytes.

Applications write one JSON object a line, `{"sql", "name", "started", "finished",
"binds"}`, to files of a folder that all executors see, and go on writing while a
session reads.  The source's offset is the position after the last whole line of
each file, so a line that is still being written waits, and a session that is begun
anew goes on where its checkpoint says.

Scale: the driver lists the folder and reads the tails of the files that have grown,
never their content.  What was added is cut into parts of `partBytes`; a task reads
those lines that begin in its part, in Arrow batches, and Spark's own expressions
read the JSON.

Defined results: empty lines and lines that are no object with a statement are no
events.  Hidden files (`.x`, `_x`) and folders are not read.  A file that goes away
is no longer read, and one that is shorter than what was read of it is an error.
A renamed file is a new one.
"""

from __future__ import annotations

import io
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.sqltext import literalised

LINES = "file string, at bigint, line string"
EVENT = "seq bigint, sql string, name string, started decimal(20,6), finished decimal(20,6), binds array<variant>"
PART_BYTES, BLOCK, BATCH_BYTES = 16 << 20, 1 << 20, 4 << 20


@dataclass
class Part(InputPartition):
    """The lines of a file that begin in [begin, stop); all lines end before `end`."""

    file: str
    begin: int
    stop: int
    end: int


class Folder:
    """What both readers share: sizes of files, parts of them and their lines."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.part_bytes = int(options.get("partbytes", options.get("partBytes", PART_BYTES)))
        self.ends: dict[str, tuple[int, int]] = {}  # size and end of the last whole line, where looked at before

    def _open(self, name: str):
        system, base = fs.FileSystem.from_uri(self.folder)
        return system.open_input_file(posixpath.join(base, name))

    def _last_line(self, name: str, size: int, known: int) -> int:
        """The position after the last line break at or after `known`, from the end backwards."""
        with self._open(name) as file:
            at = size
            while at > known:
                begin = max(known, at - BLOCK)
                file.seek(begin)
                found = file.read(at - begin).rfind(b"\n")
                if found >= 0:
                    return begin + found + 1
                at = begin
        return known

    def now(self) -> dict[str, int]:
        system, base = fs.FileSystem.from_uri(self.folder)
        files = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
        ends = {}
        for info in files:
            name = info.base_name
            if info.type != fs.FileType.File or name[0] in "._":
                continue
            size, end = self.ends.get(name, (0, 0))
            if info.size < size:
                raise ValueError(f"{name} has {info.size} bytes; {size} were there before")
            ends[name] = (info.size, end if info.size == size else self._last_line(name, info.size, end))
        self.ends = ends
        return {name: end for name, (_, end) in sorted(ends.items())}

    def parts(self, start: dict[str, int], end: dict[str, int]) -> list[Part]:
        out = []
        for name, upto in end.items():
            begin = start.get(name, 0)
            if upto < begin:
                raise ValueError(f"{name} ends at {upto}; it was read up to {begin}")
            out += [Part(name, at, min(at + self.part_bytes, upto), upto) for at in range(begin, upto, self.part_bytes)]
        return out

    def lines(self, part: Part) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("line", pa.string())])
        places, texts, held = [], [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([part.file] * len(texts), pa.string()), pa.array(places, pa.int64()), pa.array(texts, pa.string())], schema=schema)
        with self._open(part.file) as raw:
            raw.seek(max(part.begin - 1, 0))
            file = io.BufferedReader(raw, BLOCK)
            # a line that begins before the part is another part's: up to its break, which may be the byte before the part
            at = part.begin - 1 + len(file.readline()) if part.begin else 0
            while at < min(part.stop, part.end):
                line = file.readline()
                if not line:
                    raise EOFError(f"{part.file} ends at {at}; {part.end} bytes were there before")
                places.append(at)
                texts.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                at += len(line)
                held += len(line)
                if held >= BATCH_BYTES:
                    yield batch()
                    places, texts, held = [], [], 0
        if texts:
            yield batch()


class _Batch(DataSourceReader):
    def __init__(self, folder: Folder):
        self.folder = folder

    def partitions(self) -> list[Part]:
        return self.folder.parts({}, self.folder.now())

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.folder.lines(partition) if partition else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: Folder):
        self.folder = folder

    def initialOffset(self) -> dict[str, int]:  # noqa: N802
        return {}

    def latestOffset(self) -> dict[str, int]:  # noqa: N802
        return self.folder.now()

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Part]:
        return self.folder.parts(start, end)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.folder.lines(partition)


class GrowingLog(DataSource):
    """Format `growing_log`: (file, at, line) of the files in `path`; `at` is the line's first byte."""

    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return _Batch(Folder(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(Folder(self.options))


def _micros(seconds: Column) -> Column:
    return (seconds * 1_000_000).cast("bigint")


def events(lines: DataFrame) -> DataFrame:
    """Query-log rows of (line): the duration is that from start to finish in ms, to two places; a line without `seq`
    is placed by its start.  explain_sql is the statement with its binds filled in, where that changes it."""
    e = lines.select(F.from_json("line", EVENT).alias("e")).select("e.*").filter("sql is not null")
    number = lambda v: F.schema_of_variant(v).rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
    binds = F.transform("binds", lambda v: F.struct(F.try_variant_get(v, "$", "string").alias("value"), F.coalesce(number(v), F.lit(False)).alias("numeric")))
    filled = literalised(F.col("sql"), binds)
    return e.select(
        F.coalesce("seq", _micros(F.col("started"))).alias("seq"), "sql", "name", F.round((F.col("finished") - F.col("started")) * 1000, 2).cast("decimal(18,2)").alias("duration_ms"),
        F.when(filled != F.col("sql"), filled).alias("explain_sql"), F.timestamp_micros(_micros(F.col("started"))).alias("ts"),
    )


def log_stream(spark: SparkSession, folder: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """The statements of a folder of growing logs as they arrive, for `Capture` and `Running`."""
    spark.dataSource.register(GrowingLog)
    return events(spark.readStream.format("growing_log").option("partBytes", part_bytes).load(folder))


def log_so_far(spark: SparkSession, folder: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """The statements that are there now."""
    spark.dataSource.register(GrowingLog)
    return events(spark.read.format("growing_log").option("partBytes", part_bytes).load(folder))
