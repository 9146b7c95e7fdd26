"""Lifecycle events, deliveries, recordings, and the same over streams of files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.time import floor_div
from .inputs import HOUR, P, S, by_time, packets, samples
from .registry import register

QUERIES: dict = {}


def q(sql=None):
    return register(QUERIES, sql)


@q(f"WITH {S}, g AS (SELECT stream, publication, min(t) AS opened, bool_or(kind = 'view') AS ran, min(t) FILTER (kind = 'error') AS ended FROM s GROUP BY 1, 2) SELECT stream, publication, opened, CASE WHEN ended IS NULL THEN 'open' WHEN ran THEN 'ended' ELSE 'failed' END AS state, ended FROM g")
def evt1_lifecycle(spark, d):
    """EVT-1: sessions: opened once, running once, closed by their first end."""
    k = F.col("kind")
    g = samples(spark, d).groupBy("stream", "publication").agg(F.min("t").alias("opened"), F.bool_or(k == "view").alias("ran"), F.min(F.when(k == "error", F.col("t"))).alias("ended"))
    return g.select("stream", "publication", "opened", F.when(F.col("ended").isNull(), "open").when(F.col("ran"), "ended").otherwise("failed").alias("state"), "ended")


@q(f"WITH {S}, l AS (SELECT stream, kind, arg_max(bytes, t) AS v FROM s GROUP BY 1, 2) SELECT stream, list(kind || '=' || v ORDER BY kind) AS latest FROM l GROUP BY 1")
def evt2_latest(spark, d):
    """EVT-2, SUP-6: the latest compensation of each track, in one event a session."""
    l = samples(spark, d).groupBy("stream", "kind").agg(F.max_by("bytes", "t").alias("v"))
    return l.groupBy("stream").agg(F.array_sort(F.collect_list(F.concat("kind", F.lit("="), F.col("v").cast("string")))).alias("latest"))


@q(f"WITH {S}, a AS (SELECT stream, publication, min(t) FILTER (ra) AS available, max(t) FILTER (kind = 'error') AS last_error FROM s GROUP BY 1, 2) SELECT stream, publication, available, CASE WHEN last_error > available THEN last_error END AS unavailable FROM a WHERE available IS NOT NULL")
def evt3_available(spark, d):
    """EVT-3: available once a life, when first playable; unavailable only if that was told."""
    a = samples(spark, d).groupBy("stream", "publication").agg(F.min(F.when(F.col("ra"), F.col("t"))).alias("available"), F.max(F.when(F.col("kind") == "error", F.col("t"))).alias("e")).where("available is not null")
    return a.select("stream", "publication", "available", F.when(F.col("e") > F.col("available"), F.col("e")).alias("unavailable"))


@q(f"WITH {P}, x AS (SELECT *, kind = 'error' AS bad, lag(kind = 'error') OVER (PARTITION BY stream ORDER BY t, arrival) AS before, row_number() OVER (PARTITION BY stream ORDER BY t, arrival) - row_number() OVER (PARTITION BY stream, kind = 'error' ORDER BY t, arrival) AS island FROM p) SELECT stream, min(arrival) AS opened, count(*) AS lost FROM x WHERE bad GROUP BY stream, island")
def evt4_failures(spark, d):
    """EVT-4: one event at the opening of each run of failures, and how many were lost in it."""
    bad = (F.col("kind") == "error").alias("bad")
    p = packets(spark, d).select("*", bad)
    island = F.row_number().over(by_time()) - F.row_number().over(Window.partitionBy("stream", "bad").orderBy("t", "arrival"))
    return p.withColumn("island", island).where("bad").groupBy("stream", "island").agg(F.min("arrival").alias("opened"), F.count("*").alias("lost")).drop("island")


@q(f"WITH {P}, a AS (SELECT stream, t // {48 * HOUR} AS event, arrival, row_number() OVER (PARTITION BY stream, t // {48 * HOUR} ORDER BY t) AS attempt, CASE WHEN kind IN ('view', 'purchase') THEN 'delivered' WHEN kind = 'signup' THEN 'rejected' ELSE 'retry' END AS verdict FROM p), "
   "f AS (SELECT stream, event, count(*) AS tries, min(attempt) FILTER (verdict <> 'retry' AND attempt <= 5) AS last, arg_min(verdict, attempt) FILTER (verdict <> 'retry' AND attempt <= 5) AS verdict FROM a GROUP BY 1, 2) SELECT stream, event, coalesce(verdict, CASE WHEN tries >= 5 THEN 'exhausted' ELSE 'pending' END) AS outcome, least(coalesce(last, tries), 5) AS attempts FROM f")
def evt6_retry(spark, d):
    """EVT-6, SNK-6: the first terminal attempt of five decides."""
    k = F.col("kind")
    verdict = F.when(k.isin("view", "purchase"), "delivered").when(k == "signup", "rejected").otherwise("retry")
    a = packets(spark, d).withColumn("event", floor_div(F.col("t"), 48 * HOUR)).withColumn("verdict", verdict)
    a = a.withColumn("attempt", F.row_number().over(Window.partitionBy("stream", "event").orderBy("t")))
    final = (F.col("verdict") != "retry") & (F.col("attempt") <= 5)
    f = a.groupBy("stream", "event").agg(F.count("*").alias("tries"), F.min(F.when(final, F.struct("attempt", "verdict"))).alias("x"))
    outcome = F.coalesce("x.verdict", F.when(F.col("tries") >= 5, "exhausted").otherwise("pending"))
    return f.select("stream", "event", outcome.alias("outcome"), F.least(F.coalesce("x.attempt", "tries"), F.lit(5)).cast("long").alias("attempts"))


@q(f"WITH {P} SELECT kind, count(*) FILTER (kind IN ('view', 'signup')) AS delivered, count(*) FILTER (kind NOT IN ('view', 'signup')) AS filtered FROM p GROUP BY 1")
def evt7_subscriptions(spark, d):
    """EVT-7: events someone subscribes to, and those filtered."""
    subs = spark.range(2).select(F.when(F.col("id") == 0, "view").otherwise("signup").alias("kind"), F.lit(1).alias("hit"))
    return packets(spark, d).join(F.broadcast(subs), "kind", "left").groupBy("kind").agg(F.count("hit").alias("delivered"), F.count_if(F.col("hit").isNull()).alias("filtered"))


@q(f"WITH {S} SELECT arrival, stream || '/' || publication || '/' || t // {24 * HOUR} AS file, row_number() OVER w AS part, CAST(coalesce(sum(bytes) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM s WHERE kind <> 'error' WINDOW w AS (PARTITION BY stream, publication, t // {24 * HOUR} ORDER BY t, arrival)")
def snk2_recorder(spark, d):
    """SNK-2: the recorded file (a day of a publication) that each part is in, its number there and its place in bytes."""
    s = samples(spark, d).where("kind <> 'error'").withColumn("day", floor_div("t", 24 * HOUR))
    w = Window.partitionBy("stream", "publication", "day").orderBy("t", "arrival")
    place = F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return s.select("arrival", F.concat_ws("/", "stream", "publication", "day").alias("file"), F.row_number().over(w).alias("part"), place.alias("place"))


@q("SELECT event_type AS kind, CAST(epoch_us(date_trunc('day', ts)) AS BIGINT) AS day, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS bytes FROM events GROUP BY 1, 2")
def stream_daily(spark, d):
    """§2.8 on Structured Streaming: a watermarked daily count, run over the files that are there."""
    from ..streaming.jobs import drain, daily
    return drain(daily(spark, f"{d}/event[s].parquet"), "complete").select("kind", "day", "n", "bytes")


@q(f"WITH RECURSIVE {P}, n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY arrival) AS i FROM p), f AS (SELECT stream, i, t, t AS start FROM n WHERE i = 1 UNION ALL SELECT n.stream, n.i, n.t, CASE WHEN n.t >= f.start + {24 * HOUR} THEN n.t ELSE f.start END FROM f JOIN n ON n.stream = f.stream AND n.i = f.i + 1), w AS (SELECT stream, start, count(*) AS packets FROM f GROUP BY 1, 2) SELECT stream, start, packets FROM (SELECT *, max(start) OVER (PARTITION BY stream) AS newest FROM w) WHERE start < newest")
def stream_density(spark, d):
    """STR-2 as a stateful streaming operator: closed windows; the open one stays in state."""
    from ..streaming.jobs import density, drain
    return drain(density(spark, f"{d}/event[s].parquet", 24 * HOUR), "append")
