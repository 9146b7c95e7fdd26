"""Ordered computations per stream, as window functions in closed form."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.time import floor_div
from .inputs import HOUR, L, P, S, by_time, packets, samples, tiles
from .registry import register

QUERIES: dict = {}

def before():
    return by_time().rowsBetween(Window.unboundedPreceding, -1)


def so_far():
    return by_time().rowsBetween(Window.unboundedPreceding, 0)


def by_arrival():
    return Window.partitionBy("stream").orderBy("arrival")


def by_part():
    return Window.partitionBy("parent").orderBy("idx")

W = "(PARTITION BY stream ORDER BY t, arrival)"
WB = "(PARTITION BY stream ORDER BY t, arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
#: late packets: every seventh is moved six hours back, so that arrival and time differ
LATE = 6 * HOUR


def q(sql=None):
    return register(QUERIES, sql)


def late(spark, d):
    return packets(spark, d).withColumn("t", F.col("t") - F.when(F.col("arrival") % 7 == 0, LATE).otherwise(0))


LP = P + f", q AS (SELECT * REPLACE (t - CASE WHEN arrival % 7 = 0 THEN {LATE} ELSE 0 END AS t) FROM p)"


@q(f"WITH {LP}, w AS (SELECT *, max(t) OVER (PARTITION BY stream ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM q) SELECT arrival, wm, wm IS NULL OR t > wm AS advances, CASE WHEN wm IS NULL THEN 0 WHEN t > wm THEN t - wm ELSE 0 END AS amount FROM w")
def win1_watermark(spark, d):
    """WIN-1, WIN-2, WIN-20: the greatest time so far, which rows advance it, and by how much (packets out of order)."""
    wm = F.max("t").over(by_arrival().rowsBetween(Window.unboundedPreceding, -1))
    r = late(spark, d).withColumn("wm", wm)
    up = F.col("wm").isNull() | (F.col("t") > F.col("wm"))
    return r.select("arrival", "wm", up.alias("advances"), F.when(F.col("wm").isNull(), 0).when(up, F.col("t") - F.col("wm")).otherwise(0).alias("amount"))


@q(f"WITH {P}, c AS (SELECT stream, arrival, t AS s0, t + {8 * HOUR} AS e0 FROM p), w AS (SELECT *, max(e0) OVER (PARTITION BY stream ORDER BY s0, arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM c) SELECT stream, CAST(sum(greatest(0, e0 - greatest(coalesce(seen, s0), s0))) AS BIGINT) AS covered, count(*) FILTER (seen IS NOT NULL AND s0 > seen) AS breaks FROM w GROUP BY 1")
def win3_interval_union(spark, d):
    """WIN-3, SUP-11: published time as a union of 8-hour intervals."""
    end = F.col("t") + 8 * HOUR
    r = packets(spark, d).withColumn("e", end).withColumn("seen", F.max(end).over(before()))
    return r.groupBy("stream").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest(F.coalesce("seen", "t"), "t"))).alias("covered"), F.count_if(F.col("t") > F.col("seen")).alias("breaks"))


@q(f"WITH {S}, b AS (SELECT *, lag(t + dur) OVER x AS edge, dur > {12 * HOUR} AS hole FROM s WINDOW x AS (PARTITION BY stream, publication ORDER BY t)) SELECT arrival, coalesce(bool_or(hole) OVER (PARTITION BY stream, publication ORDER BY t ROWS UNBOUNDED PRECEDING), false) AS broken, lag(publication) OVER {W} IS DISTINCT FROM publication AND lag(publication) OVER {W} IS NOT NULL AS discontinuity FROM b")
def win4_sticky(spark, d):
    """WIN-4, WIN-5: a break holds for the rest of its publication; a new publication is a discontinuity."""
    w = Window.partitionBy("stream", "publication").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    prev = F.lag("publication").over(by_time())
    return samples(spark, d).select("arrival", F.bool_or(F.col("dur") > 12 * HOUR).over(w).alias("broken"), F.coalesce(prev != F.col("publication"), F.lit(False)).alias("discontinuity"))


@q(f"WITH {L} SELECT parent, idx, row_number() OVER w AS msn, CAST(coalesce(sum(greatest(1, dur % 4)) OVER (PARTITION BY parent ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS iframe, coalesce(lead(start) OVER w, sum(dur) OVER (PARTITION BY parent)) - start AS iframe_dur FROM l WINDOW w AS (PARTITION BY parent ORDER BY idx)")
def win6_sequences(spark, d):
    """WIN-6, WIN-7, WIN-8: sequence numbers, running I-frame numbers, and distances to the next I-frame."""
    run = F.sum(F.greatest(F.lit(1), F.col("dur") % 4)).over(by_part().rowsBetween(Window.unboundedPreceding, -1))
    stop = F.coalesce(F.lead("start").over(by_part()), F.sum("dur").over(Window.partitionBy("parent")))
    return tiles(spark, d).select("parent", "idx", F.row_number().over(by_part()).alias("msn"), (F.coalesce(run, F.lit(0)) + 1).alias("iframe"), (stop - F.col("start")).alias("iframe_dur"))


@q(f"WITH {L}, b AS (SELECT *, max(dur) OVER (PARTITION BY parent) AS top FROM l) SELECT parent, idx, coalesce(lag(start + dur) OVER w = start, true) AS tiles, lead(idx) OVER w IS NOT NULL AND dur * 100 < top * 85 AND NOT ra AS short FROM b WINDOW w AS (PARTITION BY parent ORDER BY idx)")
def win9_tiling(spark, d):
    """WIN-9, WIN-10, WIN-11: parts must tile, and those with a successor reach 85 % of the longest unless independent."""
    top = F.max("dur").over(Window.partitionBy("parent"))
    ok = F.coalesce(F.lag(F.col("start") + F.col("dur")).over(by_part()) == F.col("start"), F.lit(True))
    return tiles(spark, d).select("parent", "idx", ok.alias("tiles"), (F.lead("idx").over(by_part()).isNotNull() & (F.col("dur") * 100 < top * 85) & ~F.col("ra")).alias("short"))


@q(f"WITH {L}, x AS (SELECT *, CASE WHEN idx = 0 THEN 40 ELSE 0 END + idx % 2 * 5 - dur AS step FROM l), y AS (SELECT *, sum(step) OVER w AS s FROM x WINDOW w AS (PARTITION BY parent ORDER BY idx)), z AS (SELECT *, least(0, min(s) OVER (PARTITION BY parent ORDER BY idx)) AS low FROM y) SELECT parent, idx, CAST(s - low AS BIGINT) AS pending FROM z")
def win12_trim(spark, d):
    """WIN-12: trims carried over short units: a Lindley recursion as sums and running minima."""
    step = F.when(F.col("idx") == 0, 40).otherwise(0) + F.col("idx") % 2 * 5 - F.col("dur")
    w = by_part().rowsBetween(Window.unboundedPreceding, 0)
    r = tiles(spark, d).withColumn("s", F.sum(step).over(w))
    return r.select("parent", "idx", (F.col("s") - F.least(F.lit(0), F.min("s").over(w))).alias("pending"))


@q(f"WITH {P}, w AS (SELECT *, lead(t) OVER {W} - t AS ahead, CASE WHEN arrival % 4 = 0 THEN bytes * 1000 END AS declared FROM p), x AS (SELECT *, coalesce(ahead, declared) AS known FROM w) SELECT arrival, coalesce(known, last_value(known IGNORE NULLS) OVER (PARTITION BY stream ORDER BY t, arrival ROWS UNBOUNDED PRECEDING)) AS duration, CASE WHEN ahead <= 0 THEN 'order' WHEN ahead > {48 * HOUR} THEN 'jump' END AS error FROM x")
def win13_durations(spark, d):
    """WIN-13, WIN-14, SUP-3: durations from the next row, else declared, else the last known; steps out of bounds."""
    ahead = F.lead("t").over(by_time()) - F.col("t")
    r = packets(spark, d).withColumn("ahead", ahead).withColumn("known", F.coalesce("ahead", F.when(F.col("arrival") % 4 == 0, F.col("bytes") * 1000)))
    error = F.when(F.col("ahead") <= 0, "order").when(F.col("ahead") > 48 * HOUR, "jump")
    return r.select("arrival", F.coalesce("known", F.last("known", ignorenulls=True).over(so_far())).alias("duration"), error.alias("error"))


@q(f"WITH {S}, c AS (SELECT *, sum(dur // 2) OVER {W} AS c FROM s), x AS (SELECT *, max(t - c) OVER (PARTITION BY stream ORDER BY t, arrival) AS m FROM c) SELECT arrival, CAST(c + m AS BIGINT) AS due FROM x")
def win15_ceiling(spark, d):
    """WIN-15, STR-5: a rate ceiling's schedule, s = max(s + m, wall), as a running maximum."""
    r = samples(spark, d).withColumn("c", F.sum(floor_div(F.col("dur"), 2).cast("long")).over(so_far()))
    return r.select("arrival", (F.col("c") + F.max(F.col("t") - F.col("c")).over(so_far())).alias("due"))


@q(f"WITH {P}, g AS (SELECT *, CASE WHEN bytes < 1500 THEN 1 WHEN bytes >= 4000 THEN 0 END AS sig FROM p), h AS (SELECT *, last_value(sig IGNORE NULLS) OVER (PARTITION BY stream ORDER BY t, arrival ROWS UNBOUNDED PRECEDING) AS state FROM g), e AS (SELECT *, lag(state) OVER {W} AS before FROM h) SELECT stream, arrival, state = 1 AS behind FROM e WHERE state IS NOT NULL AND state IS DISTINCT FROM coalesce(before, 0)")
def win16_hysteresis(spark, d):
    """WIN-16, RET-7: two thresholds; between them the state holds, and only its edges are told."""
    sig = F.when(F.col("bytes") < 1500, 1).when(F.col("bytes") >= 4000, 0)
    r = packets(spark, d).withColumn("state", F.last(sig, ignorenulls=True).over(so_far())).withColumn("before", F.lag("state").over(by_time()))
    return r.where(F.col("state").isNotNull() & (F.col("state") != F.coalesce("before", F.lit(0)))).select("stream", "arrival", (F.col("state") == 1).alias("behind"))


@q(f"WITH {P}, w AS (SELECT *, t - lag(t) OVER {W} AS gap, first_value(t) OVER {W} AS t0, first_value(bytes) OVER {W} AS m0 FROM p) SELECT arrival, gap, coalesce(greatest(gap - {9 * HOUR}, 0), 0) AS overdue, (t - t0) - (bytes - m0) * 1000000 AS lag FROM w")
def win17_overdue(spark, d):
    """WIN-17, WIN-18, WIN-19: publish intervals, how far each is over 9 hours, and lag from a shared baseline."""
    gap = F.col("t") - F.lag("t").over(by_time())
    lag = (F.col("t") - F.first("t").over(so_far())) - (F.col("bytes") - F.first("bytes").over(so_far())) * 1_000_000
    return packets(spark, d).select("arrival", gap.alias("gap"), F.coalesce(F.greatest(gap - 9 * HOUR, F.lit(0)), F.lit(0)).alias("overdue"), lag.alias("lag"))


@q(f"WITH {LP}, w AS (SELECT *, max(t) OVER (PARTITION BY stream ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM q) SELECT arrival, CAST(sum(CASE WHEN t > coalesce(high, -1) THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM w")
def win21_composition(spark, d):
    """WIN-21: groups close where a row passes the high-water mark."""
    r = late(spark, d).withColumn("high", F.max("t").over(by_arrival().rowsBetween(Window.unboundedPreceding, -1)))
    opens = F.when(F.col("t") > F.coalesce("high", F.lit(-1)), 1).otherwise(0)
    return r.withColumn("o", opens).select("arrival", F.sum("o").over(by_arrival().rowsBetween(Window.unboundedPreceding, 0)).alias("grp"))


@q(f"WITH {L} SELECT parent, idx, i, start + i * 15 AS piece_start, least(15, dur - i * 15) AS piece FROM (SELECT *, unnest(generate_series(0, (dur + 14) // 15 - 1)) AS i FROM l)")
def win22_gap_parts(spark, d):
    """WIN-22: intervals split into pieces of at most 15, the last short."""
    r = tiles(spark, d).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), floor_div(F.col("dur") + 14, 15) - 1)))
    return r.select("parent", "idx", "i", (F.col("start") + F.col("i") * 15).alias("piece_start"), F.least(F.lit(15), F.col("dur") - F.col("i") * 15).alias("piece"))


@q(f"WITH {S}, a AS (SELECT *, min(CASE WHEN kind = 'purchase' THEN t END) OVER (PARTITION BY stream) AS anchor, sum(dur) OVER (PARTITION BY stream ORDER BY t, arrival ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s), b AS (SELECT *, max(CASE WHEN t = anchor THEN rest END) OVER (PARTITION BY stream) AS at_anchor FROM a) SELECT arrival, CAST(anchor - (rest - at_anchor) AS BIGINT) AS dts FROM b WHERE t <= anchor")
def win23_reconstruct(spark, d):
    """WIN-23: times before the first explicit one, counted backwards from it."""
    s = samples(spark, d)
    whole = Window.partitionBy("stream")
    r = s.withColumn("anchor", F.min(F.when(F.col("kind") == "purchase", F.col("t"))).over(whole)).withColumn("rest", F.sum("dur").over(Window.partitionBy("stream").orderBy(F.col("t").desc(), F.col("arrival").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("at", F.max(F.when(F.col("t") == F.col("anchor"), F.col("rest"))).over(whole))
    return r.where("t <= anchor").select("arrival", (F.col("anchor") - (F.col("rest") - F.col("at"))).alias("dts"))
