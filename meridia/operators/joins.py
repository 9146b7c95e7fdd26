"""Interval, band and as-of joins as equi-joins on time buckets.

A range condition alone would be a nested loop. Rows go to the buckets their intervals
touch, so the join shuffles on (key, bucket) and a hot stream spreads over its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import floor_div


def overlap_join(left: DataFrame, right: DataFrame, key: str, left_start: str, left_end: str, right_start: str, right_end: str, width: int) -> DataFrame:
    """Pairs with equal key whose half-open intervals overlap; each pair once.

    ``width`` should be near the longer intervals, so that rows touch few buckets. A pair
    is taken in the bucket where its overlap begins.
    """
    def spread(df, s, e):
        return df.withColumn("_b", F.explode(F.sequence(floor_div(F.col(s), width), floor_div(F.col(e) - 1, width)))).where(F.col(e) > F.col(s))
    right = right.withColumnRenamed(key, "_key")
    a, b = spread(left, left_start, left_end), spread(right, right_start, right_end).withColumnRenamed("_b", "_b2")
    hit = (F.col(key) == F.col("_key")) & (F.col("_b") == F.col("_b2")) & (F.col(left_start) < F.col(right_end)) & (F.col(left_end) > F.col(right_start))
    return a.join(b, hit).where(F.col("_b") == floor_div(F.greatest(left_start, right_start), width)).drop("_b", "_b2", "_key")


def as_of_forward(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """left with ``value`` of the first right row at or after its time (null if none).

    One union sorted per key: no row is multiplied, whatever the distances. Rows are passed
    from the last to the first, so a frame only ever grows; at equal times rows of the right
    side come first, so that they count as ahead."""
    a = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    w = Window.partitionBy("_k").orderBy(F.col("_t").desc(), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("_found", F.last(F.when(F.col("_side") == 1, F.struct("_v")), ignorenulls=True).over(w))
    return found.where("_side = 0").select("_row.*", F.col("_found._v").alias(value))


def latest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row with the greatest order of each key, aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")
