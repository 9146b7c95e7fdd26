"""Structured Streaming forms of the event-time operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.time import floor_div
from ..plans.inputs import micros
from ..sources import store

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of event files; a single file is given as a pattern. ``files_per_trigger`` limits the rate."""
    r = spark.readStream.schema(EVENTS)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def daily(spark: SparkSession, path: str, lateness: str = "2 hours", files_per_trigger: int | None = None) -> DataFrame:
    """Counts by kind and day."""
    e = events(spark, path, files_per_trigger).withColumn("at", F.timestamp_micros(micros("ts"))).withColumn("day", floor_div(micros("ts"), 86_400_000_000) * 86_400_000_000)
    e = e.withWatermark("at", lateness)
    return e.groupBy(F.col("event_type").alias("kind"), "day").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("bytes"))


def windows(spark: SparkSession, path: str, width: str, lateness: str, files_per_trigger: int | None = None) -> DataFrame:
    """Packets by stream and tumbling window, each told once when the watermark seals it; rows of sealed
    windows come too late and are dropped."""
    e = events(spark, path, files_per_trigger).withColumn("at", F.timestamp_micros(micros("ts"))).withWatermark("at", lateness)
    w = F.window("at", width)
    g = e.groupBy(F.col("user_id").alias("stream"), w.alias("w")).agg(F.count("*").alias("packets"))
    return g.select("stream", F.unix_micros("w.start").alias("start"), "packets")


def density(spark: SparkSession, path: str, width: int, files_per_trigger: int | None = None) -> DataFrame:
    """Windows anchored at their first row; state is one window a stream."""
    rows = events(spark, path, files_per_trigger).select(F.col("user_id").alias("stream"), F.col("event_id").alias("arrival"), (micros("ts") * 1000).alias("t"))

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, mark, n = state.get if state.exists else (None, None, 0)
        out = []
        for t in pd.concat(batches).sort_values("arrival")["t"].tolist():
            mark = t if mark is None else max(mark, t)
            if start is None or mark >= start + width:
                if start is not None:
                    out.append((key[0], start, n))
                start, n = mark, 0
            n += 1
        state.update((start, mark, n))
        yield pd.DataFrame(out, columns=["stream", "start", "packets"])

    return rows.groupBy("stream").applyInPandasWithState(run, "stream long, start long, packets long", "start long, mark long, n long", "append", GroupStateTimeout.NoTimeout)


def fold(rows: DataFrame, key: str, order: list[str], make: Callable, schema: str) -> DataFrame:
    """A fold of ``operators.folds`` over a stream: its state is kept from batch to batch and survives restarts.

    A batch's rows of a key are taken in ``order``; rows that come in a later batch come later, whatever
    their order. What a fold tells at its end is not told, for a stream has none. Rows with a null in
    another column than the key are passed over."""
    names = [c for c in rows.columns if c != key]
    for c in names:
        rows = rows.where(F.col(c).isNotNull())
    columns = StructType.fromDDL(schema).fieldNames()

    def run(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        step, _ = make(group[0])
        if state.exists:
            for container, kept in zip(step.state, pickle.loads(state.get[0])):
                container.clear()
                (container.update if isinstance(container, dict) else container.extend)(kept)
        table = pd.concat(batches).sort_values(order, kind="stable")
        out = [x for values in zip(*(table[c].tolist() for c in names)) for x in step(SimpleNamespace(**dict(zip(names, values))))]
        state.update((pickle.dumps(step.state),))
        yield pd.DataFrame(out, columns=columns)

    return rows.groupBy(key).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, mode: str, root: str | None = None) -> DataFrame:
    """Run a streaming frame over all that is there, and give what it wrote.

    Batches and the query's checkpoint are in ``root``, by default a new folder that executors
    share: a second call with the same one goes on from where the first ended, and nothing
    passes through the driver. Of a complete query the newest batch is the result."""
    spark = df.sparkSession
    root = root or store.shared_folder(spark, "stream")
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(store.sink(f"{root}/batches")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = store.read(spark, f"{root}/batches", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") == (-1 if last is None else last))
    return rows.drop("batch")
