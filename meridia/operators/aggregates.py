"""Histograms, counters and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: upper bounds of duration histograms, in seconds
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60, 120)


def histogram(df: DataFrame, keys: list[str], value: Column, bounds: tuple = BOUNDS) -> DataFrame:
    """One row a key and bound (null: +Inf) with cumulative counts, and count and sum on every row.

    Counts are partial sums of one pass; a value on a bound belongs to it."""
    sums = [F.count_if(value <= b).alias(f"_{i}") for i, b in enumerate(bounds)]
    g = df.groupBy(*keys).agg(*sums, F.count(value).alias("n"), F.sum(value).alias("total"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("below")) for i, b in enumerate(bounds)], F.struct(F.lit(None).cast("double").alias("le"), F.col("n").alias("below")))
    return g.select(*keys, F.inline(rows), "n", "total")


def long_if_it_fits(df: DataFrame, name: str) -> DataFrame:
    """df with a column of whole decimals as longs; as decimals of 38 digits if one is beyond a long. Runs df once to see."""
    beyond = F.col(name).isNotNull() & F.col(name).try_cast("long").isNull()
    return df.withColumn(name, F.col(name).cast("decimal(38,0)" if df.where(beyond).limit(1).count() else "long"))


def rate_steps(window, value: str) -> Column:
    """A counter's increase since the row before; after a reset its value."""
    before = F.lag(value).over(window)
    return F.when(F.col(value) >= before, F.col(value) - before).when(before.isNotNull(), F.col(value))


def histogram_quantile(df: DataFrame, keys: list[str], p: float) -> DataFrame:
    """Prometheus' quantile of cumulative (le, below) rows: linear within a bucket; the
    last finite bound where it falls beyond it."""
    b = F.sort_array(F.collect_list(F.struct(F.coalesce("le", F.lit(float("inf"))).alias("le"), "below")))  # one entry a bound
    g = df.groupBy(*keys).agg(b.alias("b")).withColumn("rank", F.element_at("b", -1)["below"] * p)
    hit = F.array_position(F.transform("b", lambda x: x["below"] >= F.col("rank")), True).cast("int")
    low = F.when(hit > 1, F.element_at("b", hit - 1)["le"]).otherwise(0.0)
    under = F.when(hit > 1, F.element_at("b", hit - 1)["below"]).otherwise(0)
    at = F.element_at("b", hit)
    inside = low + (at["le"] - low) * (F.col("rank") - under) / (at["below"] - under)
    value = F.when(F.element_at("b", -1)["below"] == 0, None).when(at["le"] == float("inf"), F.element_at("b", -2)["le"]).otherwise(inside)
    return g.select(*keys, value.alias("value"))


def quantile(df: DataFrame, column: str, q: float, levels: int = 2) -> DataFrame:
    """One row with the exact quantile ``value`` (linear between ranks, null without rows).

    Each level brackets the ranks wanted within two hundredths by a sketch and counts what lies
    below; only the last bracket's distinct values, a thousandth of all, are put in order."""
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_v"))
    state = rows.agg((F.count("*") - 1).alias("_last")).select((F.col("_last") * q).alias("_rank"), F.lit(0).cast("long").alias("_below"))
    for _ in range(levels):
        # one row each: the ranks wanted, and how many rows lie below the bracket
        here = rows.join(F.broadcast(state))
        n, at = F.count("*"), F.first("_rank") - F.first("_below")
        marks = F.percentile_approx("_v", F.array(*[F.lit(x / 50) for x in range(51)]), F.lit(10_000))
        cut = here.agg(marks.alias("_m"), n.alias("_n"), at.alias("_at"), F.first("_rank").alias("_rank"), F.first("_below").alias("_below"))
        slot = lambda rank: F.floor(rank * 50 / F.greatest("_n", F.lit(1))).cast("int")
        low, high = F.greatest(slot(F.col("_at")) - 1, F.lit(0)), F.least(slot(F.col("_at") + 1) + 2, F.lit(50))
        cut = cut.select("_rank", "_below", F.when(low > 0, F.get("_m", low)).alias("_low"), F.when(high < 50, F.get("_m", high)).alias("_high"))
        rows = rows.join(F.broadcast(cut.select("_low", "_high")))
        under = F.count_if(F.col("_v") < F.col("_low"))
        state = rows.agg(under.alias("_under")).join(F.broadcast(cut)).select("_rank", (F.col("_below") + F.col("_under")).alias("_below"))
        rows = rows.where((F.col("_low").isNull() | (F.col("_v") >= F.col("_low"))) & (F.col("_high").isNull() | (F.col("_v") <= F.col("_high")))).select("_v")
    upto = Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    values = rows.groupBy("_v").agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(upto)).join(F.broadcast(state))
    place = lambda r: F.min(F.when(F.col("_upto") + F.col("_below") > r, F.col("_v")))
    got = values.agg(place(F.floor("_rank")).alias("_a"), place(F.ceil("_rank")).alias("_b"), F.first("_rank").alias("_rank"))
    return got.select((F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_rank") - F.floor("_rank"))).cast("double").alias("value"))
