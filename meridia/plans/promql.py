"""Dashboard and alert queries over metric series, reset-aware."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.time import floor_div
from ..operators.aggregates import histogram, histogram_quantile, quantile, rate_steps
from .aggregates import bounds_sql
from .inputs import HOUR, P, S, by_time, packets, samples
from .registry import register

QUERIES: dict = {}
DAY = 24 * HOUR


def q(sql=None):
    return register(QUERIES, sql)


@q(f"WITH {P} SELECT stream, kind, arg_max(bytes, t) AS value FROM p WHERE regexp_matches(kind, '^(view|click)$') GROUP BY 1, 2")
def pq1_instant(spark, d):
    """PQ-1: latest values of series whose label matches."""
    return packets(spark, d).where(F.col("kind").rlike("^(view|click)$")).groupBy("stream", "kind").agg(F.max_by("bytes", "t").alias("value"))


#: bytes as a counter: it falls whenever a packet is smaller than the one before, which counts as a reset
STEP = ", r AS (SELECT *, CASE WHEN bytes >= lag(bytes) OVER w THEN bytes - lag(bytes) OVER w WHEN lag(bytes) OVER w IS NOT NULL THEN bytes END AS step FROM p WINDOW w AS (PARTITION BY stream ORDER BY t, arrival))"


def steps(spark, d):
    return packets(spark, d).withColumn("step", rate_steps(by_time(), "bytes"))


@q(f"WITH {P}{STEP} SELECT stream, t // {DAY} AS day, CAST(sum(step) AS BIGINT) AS increase, CAST(sum(step) AS BIGINT) / 86400.0::DOUBLE AS rate FROM r GROUP BY 1, 2")
def pq2_rate(spark, d):
    """PQ-2, PQ-4: increases and rates of counters a day."""
    g = steps(spark, d).groupBy("stream", floor_div(F.col("t"), DAY).alias("day")).agg(F.sum("step").alias("increase"))
    return g.withColumn("rate", F.col("increase") / 86400.0)


@q(f"WITH {P}{STEP} SELECT kind, t // {DAY} AS day, CAST(sum(step) AS BIGINT) AS increase FROM r GROUP BY 1, 2")
def pq3_sum_rate(spark, d):
    """PQ-3: sums of rates by label; each series' resets are seen before the sum."""
    return steps(spark, d).groupBy("kind", floor_div(F.col("t"), DAY).alias("day")).agg(F.sum("step").alias("increase"))


@q(f"WITH {P}, m AS (SELECT max(t) AS now FROM p) SELECT stream, (SELECT now FROM m) - max(t) AS age FROM p GROUP BY 1")
def pq5_age(spark, d):
    """PQ-5: now less the latest sample."""
    p = packets(spark, d)
    return p.groupBy("stream").agg(F.max("t").alias("last")).join(F.broadcast(p.agg(F.max("t").alias("now")))).select("stream", (F.col("now") - F.col("last")).alias("age"))


@q(f"WITH {S}, v AS (SELECT kind, dur / 3600000000000.0 AS h FROM s), b AS ({bounds_sql('h')}), c AS (SELECT kind, coalesce(le, 'inf'::DOUBLE) AS le, count(*) FILTER (le IS NULL OR h <= le) AS below FROM v, b GROUP BY 1, 2), "
   "r AS (SELECT *, max(below) OVER (PARTITION BY kind) * 0.95::DOUBLE AS rnk, lag(le, 1, 0) OVER w AS lo, lag(below, 1, 0) OVER w AS under FROM c WINDOW w AS (PARTITION BY kind ORDER BY le)), "
   "f AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY le) AS n FROM r WHERE below >= rnk) SELECT kind, round(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (rnk - under) / (below - under) END, 6) AS value FROM f WHERE n = 1")
def pq6_quantile(spark, d):
    """PQ-6: the 0.95 quantile of a histogram, linear in its bucket."""
    h = histogram(samples(spark, d), ["kind"], F.col("dur") / (HOUR * 1.0))
    return histogram_quantile(h, ["kind"], 0.95).select("kind", F.round("value", 6).alias("value"))


@q(f"WITH {P} SELECT stream, CAST(sum(bytes) AS BIGINT) AS total FROM p GROUP BY 1 ORDER BY total DESC, stream LIMIT 10")
def pq7_topk(spark, d):
    """PQ-7, SORT-9: the ten largest sums (a top-k report)."""
    return packets(spark, d).groupBy("stream").agg(F.sum("bytes").alias("total")).orderBy(F.col("total").desc(), "stream").limit(10)


@q(f"WITH {P}, g AS (SELECT stream, max(bytes) AS top FROM p GROUP BY 1) SELECT quantile_cont(top, 0.5)::DOUBLE AS median FROM g")
def pq8_quantile(spark, d):
    """PQ-8: the median of each stream's greatest, exactly."""
    return quantile(packets(spark, d).groupBy("stream").agg(F.max("bytes").alias("top")), "top", 0.5).withColumnRenamed("value", "median")


@q(f"WITH {P} SELECT coalesce((SELECT count(*) FROM p WHERE bytes > 100000000), 0) AS value, (SELECT count(*) FILTER (n > 60) FROM (SELECT stream, count(*) AS n FROM p GROUP BY 1)) AS busy")
def pq10_or_zero(spark, d):
    """PQ-10, PQ-12: zero where nothing matches; how many series are above a value."""
    p = packets(spark, d)
    return p.agg(F.count_if(F.col("bytes") > 100_000_000).alias("value")).join(p.groupBy("stream").count().agg(F.count_if(F.col("count") > 60).alias("busy")))


@q(f"WITH {P} SELECT stream, round(count(*) FILTER (kind = 'error') * 1.0::DOUBLE / nullif(count(*), 0), 9) AS ratio FROM p GROUP BY 1")
def pq11_ratio(spark, d):
    """PQ-11: error shares, guarded against no requests."""
    return packets(spark, d).groupBy("stream").agg(F.round(F.try_divide(F.count_if(F.col("kind") == "error").cast("double"), F.count("*")), 9).alias("ratio"))


@q(f"WITH {P}, f AS (SELECT *, bytes < 5000 AS low, row_number() OVER (PARTITION BY stream ORDER BY t, arrival) - row_number() OVER (PARTITION BY stream, bytes < 5000 ORDER BY t, arrival) AS island FROM p) SELECT stream, min(t) AS since, max(t) AS until FROM f WHERE low GROUP BY stream, island HAVING max(t) - min(t) >= {48 * HOUR}")
def pq13_held(spark, d):
    """PQ-13, EVT-4, ADM-3: a condition that held for 48 hours, as islands of rows."""
    low = (F.col("bytes") < 5000).alias("low")
    p = packets(spark, d).select("*", low)
    own = Window.partitionBy("stream", "low").orderBy("t", "arrival")
    f = p.withColumn("island", F.row_number().over(by_time()) - F.row_number().over(own)).where("low")
    return f.groupBy("stream", "island").agg(F.min("t").alias("since"), F.max("t").alias("until")).where(F.col("until") - F.col("since") >= 48 * HOUR).select("stream", "since", "until")


@q(f"WITH {P} SELECT stream, count(*) AS n, CAST(sum(bytes) FILTER (kind = 'view') AS BIGINT) AS views, max(t) FILTER (kind = 'error') AS last_error FROM p GROUP BY 1")
def pq16_merge(spark, d):
    """PQ-16: several queries merged by stream: one pass in place of joins."""
    k = F.col("kind")
    return packets(spark, d).groupBy("stream").agg(F.count("*").alias("n"), F.sum(F.when(k == "view", F.col("bytes"))).alias("views"), F.max(F.when(k == "error", F.col("t"))).alias("last_error"))
