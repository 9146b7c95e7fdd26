"""Engine rows from the star-schema and event tables.

Events of a user stand for a stream's packets. They are minutes apart, so queries use
hours where media has seconds; each says its thresholds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOUR = 3600 * 10**9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> F.col:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"unix_date(cast({ts} as date)) * 86400000000L + (hour({ts}) * 3600L + minute({ts}) * 60L) * 1000000L + cast(extract(second from {ts}) * 1000000 as bigint)")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, t ns, arrival, kind, bytes, ra): one packet per event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("stream"), (micros("ts") * 1000).alias("t"), F.col("event_id").alias("arrival"), F.col("event_type").alias("kind"),
        F.round(F.col("value") * 100).cast("long").alias("bytes"), F.col("event_type").isin("view", "purchase").alias("ra"),
    )


P = "p AS (SELECT user_id AS stream, epoch_us(ts) * 1000 AS t, event_id AS arrival, event_type AS kind, CAST(round(value * 100) AS BIGINT) AS bytes, event_type IN ('view', 'purchase') AS ra FROM events)"


def by_time():
    return Window.partitionBy("stream").orderBy("t", "arrival")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets with the distance to the next one of their stream as duration; the last has none and goes.
    publication counts sign-ups so far; seq counts rows from 1."""
    return (
        packets(spark, sf_dir)
        .withColumn("dur", F.lead("t").over(by_time()) - F.col("t"))
        .withColumn("publication", F.sum(F.when(F.col("kind") == "signup", 1).otherwise(0)).over(by_time().rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("seq", F.row_number().over(by_time()).cast("long"))
        .where("dur is not null")
    )


S = (
    P + ", s AS (SELECT * FROM (SELECT *, lead(t) OVER w - t AS dur, CAST(sum(CASE WHEN kind = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY t, arrival ROWS UNBOUNDED PRECEDING) AS BIGINT) AS publication, "
    "row_number() OVER w AS seq FROM p WINDOW w AS (PARTITION BY stream ORDER BY t, arrival)) WHERE dur IS NOT NULL)"
)


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent, idx, start, dur, bytes, ra): lines of an order as its contiguous parts, quantities as durations."""
    w = Window.partitionBy("parent").orderBy("l_linenumber", "l_partkey", "l_suppkey", "bytes")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("parent"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("dur"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("bytes"), (F.col("l_returnflag") != "N").alias("ra"),
    )
    return rows.select(
        "parent", (F.row_number().over(w) - 1).cast("long").alias("idx"), F.coalesce(F.sum("dur").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), "dur", "bytes", "ra"
    )


L = (
    "l0 AS (SELECT l_orderkey AS parent, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS dur, CAST(round(l_extendedprice * 100) AS BIGINT) AS bytes, l_returnflag <> 'N' AS ra FROM lineitem), "
    "l AS (SELECT parent, row_number() OVER w - 1 AS idx, CAST(coalesce(sum(dur) OVER (PARTITION BY parent ORDER BY l_linenumber, l_partkey, l_suppkey, bytes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, "
    "dur, bytes, ra FROM l0 WINDOW w AS (PARTITION BY parent ORDER BY l_linenumber, l_partkey, l_suppkey, bytes))"
)
