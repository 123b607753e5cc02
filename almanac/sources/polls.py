"""A table replayed as a source that is polled (inventory A15).

Feeds of sensors are fetched every so often: 15-minute gages, hourly ports, lock snapshots.  This stream
source replays a Parquet table that way: a poll hands on the rows of one ``step`` of the table's own time,
``polls`` of them at most make a micro-batch, and the position is the end of what was handed on.  Rows are
read on the executors, one partition per row group that holds times of the poll; of the files only their
footers are read on the driver.

Spark's checkpoint names the range of every batch, and a range always gives the same rows, so with an
exactly-once sink nothing is lost or doubled over restarts.  After a restart the reader learns its position
from ``progress``, a file that it writes when a batch is committed and that may be one batch behind; the first
batch is therefore twice as long.

Options: ``path``, ``time`` (a timestamp column), ``step`` and ``polls`` (numbers; seconds for the step),
``progress`` (a file of its own for each checkpoint).  Rows without a time are never due.  A table without
rows gives no batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import new_path


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def micros_of(value: datetime) -> int:
    """Microseconds since the epoch; a time without a zone is in UTC."""
    t = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
    d = t - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


class Group(InputPartition):
    """The rows of one row group with times in [start, end)."""

    def __init__(self, path: str, group: int, start: int, end: int):
        self.path, self.group, self.start, self.end = path, group, start, end


class PolledReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.time = schema, options["path"], options["time"]
        self.step, self.polls = int(float(options["step"]) * 1_000_000), int(options.get("polls", 1))
        if self.step < 1 or self.polls < 1:
            raise ValueError("step and polls are positive")
        self.progress, self.at, self.found = options["progress"], None, None

    def groups(self) -> list[tuple[str, int, int, int]]:
        """(file, row group, first time, last time) of the row groups that hold times."""
        if self.found is None:
            files, root = store(self.path)
            info = files.get_file_info(root)
            inside = files.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
            names = sorted(f.path for f in inside if f.type == fs.FileType.File and f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")))
            self.found = []
            for name in names:
                meta = pq.read_metadata(name, filesystem=files)
                column = meta.schema.to_arrow_schema().names.index(self.time)
                for g in range(meta.num_row_groups):
                    s = meta.row_group(g).column(column).statistics
                    if s is None or not s.has_min_max:
                        values = pc.min_max(pq.ParquetFile(name, filesystem=files).read_row_group(g, [self.time]).column(0)).as_py()
                        low, high = values["min"], values["max"]
                    else:
                        low, high = s.min, s.max
                    if low is not None:
                        self.found.append((name, g, micros_of(low), micros_of(high)))
        return self.found

    def bounds(self) -> tuple[int, int]:
        """The first time, on a whole step, and the step after the last time."""
        g = self.groups()
        if not g:
            return 0, 0
        return min(x[2] for x in g) // self.step * self.step, (max(x[3] for x in g) // self.step + 1) * self.step

    def initialOffset(self) -> dict:
        self.at = self.bounds()[0]
        return {"at": self.at}

    def latestOffset(self) -> dict:
        first, last = self.bounds()
        batches = 1
        if self.at is None:
            self.at, batches = self.resumed(first), 2
        self.at = min(self.at + batches * self.polls * self.step, last)
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> list[Group]:
        self.at = max(self.at or 0, end["at"])
        return [Group(p, g, start["at"], end["at"]) for p, g, low, high in self.groups() if low < end["at"] and high >= start["at"]]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        files, _ = store(self.path)
        want = to_arrow_schema(self.schema)
        source = pq.ParquetFile(partition.path, filesystem=files)
        for batch in source.iter_batches(row_groups=[partition.group], columns=sorted({*want.names, self.time})):
            t = batch.column(batch.schema.get_field_index(self.time)).cast(pa.timestamp("us")).cast(pa.int64())
            due = pc.and_(pc.greater_equal(t, partition.start), pc.less(t, partition.end))
            out = batch.filter(due)
            if out.num_rows:
                yield pa.RecordBatch.from_arrays([out.column(out.schema.get_field_index(f.name)).cast(f.type) for f in want], schema=want)

    def resumed(self, first: int) -> int:
        files, path = store(self.progress)
        if files.get_file_info(path).type != fs.FileType.File:
            return first
        with files.open_input_stream(path) as f:
            return max(first, json.loads(f.read())["at"])

    def commit(self, end: dict) -> None:
        files, path = store(self.progress)
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with files.open_output_stream(path + ".next") as f:
            f.write(json.dumps(end).encode())
        files.move(path + ".next", path)


class Polled(DataSource):
    """The format ``polled``."""

    @classmethod
    def name(cls) -> str:
        return "polled"

    def schema(self) -> str:
        raise ValueError("name the schema of the table")

    def streamReader(self, schema: StructType) -> PolledReader:
        return PolledReader(schema, dict(self.options))


def stream_polls(spark: SparkSession, path: str, schema: StructType | str, time: str, step: float, polls: int = 1, progress: str | None = None) -> DataFrame:
    """The table at ``path`` as a stream of polls of ``step`` seconds of its time, ``polls`` in a micro-batch."""
    spark.dataSource.register(Polled)
    r = spark.readStream.format("polled").schema(schema).option("path", path).option("time", time)
    return r.option("step", step).option("polls", polls).option("progress", progress or new_path(spark, "progress")).load()
