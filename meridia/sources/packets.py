"""A Python data source of packet rows from JSON lines, and readers of traces."""

from __future__ import annotations

import io
import json
import os

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PACKETS = "stream long, track_id int, arrival long, pts long, dts long, duration long, random_access boolean, bytes int"
REQUESTS = "requested double, answered double, path string, blocking boolean, max_age double, error string, tags array<string>"


class _Reader(DataSourceReader):
    def __init__(self, schema, paths):
        self.names, self.paths = schema.names, paths

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        # a path or the address of a file on any store that PyArrow knows
        fs, path = pafs.FileSystem.from_uri(partition.value) if "://" in partition.value else (pafs.LocalFileSystem(), partition.value.removeprefix("file:"))
        with fs.open_input_stream(path) as f, io.TextIOWrapper(f, encoding="utf-8") as lines:
            for line in lines:
                if line.strip():
                    row = json.loads(line)
                    yield tuple(row.get(n) for n in self.names)


class _StreamReader(DataSourceStreamReader):
    """Files of a folder in the order of their names; the offset is the name of the last one read, and of
    the files after it at most ``files`` are a batch. Files are whole when they appear."""

    def __init__(self, schema, options):
        self.reader, self.folder, self.files = _Reader(schema, []), options["folder"], int(options.get("files", "1000"))
        self.at = self.initialOffset()

    def _after(self, name: str, upto: str | None = None) -> list[str]:
        names = sorted(n for n in os.listdir(self.folder) if n.endswith(".jsonl") and n > name)
        return [n for n in names if upto is None or n <= upto]

    def initialOffset(self):
        return {"name": ""}

    def latestOffset(self):
        got = self._after(self.at["name"])[: self.files]
        self.at = {"name": got[-1]} if got else self.at
        return self.at

    def partitions(self, start, end):
        self.at = end if end["name"] > self.at["name"] else self.at
        return [InputPartition(os.path.join(self.folder, n)) for n in self._after(start["name"], end["name"])]

    def read(self, partition):
        return self.reader.read(partition)


class PacketSource(DataSource):
    """``spark.read.format("packets").option("paths", "a,b")``: one partition a file; as a stream,
    ``option("folder", ...)`` and at most ``files`` of its files a batch, which bounds what is taken in."""

    @classmethod
    def name(cls):
        return "packets"

    def schema(self):
        return PACKETS

    def reader(self, schema):
        return _Reader(schema, self.options["paths"].split(","))

    def streamReader(self, schema):
        return _StreamReader(schema, self.options)


def trace(spark: SparkSession, path: str) -> DataFrame:
    """Validator request traces: JSON lines by Spark's own reader, with waiting times."""
    return spark.read.schema(REQUESTS).json(path).withColumn("waited", F.col("answered") - F.col("requested"))


def check_catalog(tracks: DataFrame) -> DataFrame:
    """What is wrong with a catalog: ids that repeat."""
    return tracks.groupBy("stream", "track_id").count().where("count > 1")
