"""Sliding windows, grace periods, shedding, bitrates, identities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.time import floor_div
from .inputs import HOUR, L, P, S, by_time, packets, samples, table, tiles
from .registry import register

QUERIES: dict = {}
RETAIN = 120 * HOUR

def newest_first():
    return Window.partitionBy("stream").orderBy(F.col("t").desc(), F.col("arrival").desc())


def whole():
    return Window.partitionBy("stream")


def q(sql=None):
    return register(QUERIES, sql)


KEPT = f", k AS (SELECT *, CAST(coalesce(sum(dur) OVER (PARTITION BY stream ORDER BY t, arrival ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS after, count(*) OVER (PARTITION BY stream) - seq AS newer, greatest({RETAIN}, 3 * max(dur) OVER (PARTITION BY stream)) AS least FROM s)"


def window_rows(spark, d):
    """A segment stays while fewer than 3 are newer or what is newer is shorter than the minimum: a suffix, so no recursion.
    Sums run from the newest row back, so a frame only ever grows."""
    newer = newest_first().rowsBetween(Window.unboundedPreceding, -1)
    s = samples(spark, d).withColumn("after", F.coalesce(F.sum("dur").over(newer), F.lit(0))).withColumn("newer", (F.row_number().over(newest_first()) - 1).cast("long"))
    return s.withColumn("least", F.greatest(F.lit(RETAIN), 3 * F.max("dur").over(whole())))


@q(f"WITH {S}{KEPT} SELECT stream, arrival, seq, dur FROM k WHERE newer < 3 OR after < least")
def ret1_sliding_window(spark, d):
    """RET-1: the playlist's window: 120 hours or three longest segments, at least 3 segments."""
    return window_rows(spark, d).where("newer < 3 or after < least").select("stream", "arrival", "seq", "dur")


@q(f"WITH {S}{KEPT} SELECT arrival, greatest(t + {RETAIN}, t + dur + least) AS fetch_until, t + dur + 3 * least AS grace_until FROM k")
def ret2_deadlines(spark, d):
    """RET-2, RET-4: how long removed segments and parts can still be fetched."""
    end = F.col("t") + F.col("dur")
    return window_rows(spark, d).select("arrival", F.greatest(F.col("t") + RETAIN, end + F.col("least")).alias("fetch_until"), (end + 3 * F.col("least")).alias("grace_until"))


@q(f"WITH {L}, e AS (SELECT parent, max(start + dur) AS live, 3 * max(dur) AS far FROM l GROUP BY 1) SELECT l.parent, l.idx FROM l JOIN e USING (parent) WHERE e.live - (l.start + l.dur) <= e.far")
def ret3_part_tags(spark, d):
    """RET-3: parts stay listed while their end is within three targets of the live edge."""
    w = Window.partitionBy("parent")
    r = tiles(spark, d).withColumn("end", F.col("start") + F.col("dur"))
    return r.withColumn("back", F.max("end").over(w) - F.col("end")).withColumn("far", 3 * F.max("dur").over(w)).where("back <= far").select("parent", "idx")


@q(f"WITH {S}{KEPT}, x AS (SELECT *, lag(publication) OVER (PARTITION BY stream ORDER BY t, arrival) AS before FROM k) SELECT stream, count(*) FILTER (before <> publication AND NOT (newer < 3 OR after < least)) AS discontinuity_sequence FROM x GROUP BY 1")
def ret5_discontinuity(spark, d):
    """RET-5: discontinuities that have left the window."""
    k = window_rows(spark, d).withColumn("before", F.lag("publication").over(by_time()))
    gone = (F.col("before") != F.col("publication")) & ~((F.col("newer") < 3) | (F.col("after") < F.col("least")))
    return k.groupBy("stream").agg(F.count_if(gone).alias("discontinuity_sequence"))


@q(f"WITH {S}, r AS (SELECT *, sum(bytes) OVER (PARTITION BY stream ORDER BY t DESC, arrival DESC) AS newer_bytes, row_number() OVER (PARTITION BY stream ORDER BY t DESC) AS n FROM s) SELECT stream, arrival FROM r WHERE newer_bytes > 100000 AND n > 3")
def ret6_shed(spark, d):
    """RET-6: oldest first until the rest fits its byte cap; three segments always stay."""
    w = Window.partitionBy("stream").orderBy(F.col("t").desc(), F.col("arrival").desc())
    r = samples(spark, d).withColumn("held", F.sum("bytes").over(w)).withColumn("n", F.row_number().over(w))
    return r.where("held > 100000 and n > 3").select("stream", "arrival")


@q(f"WITH {P}, m AS (SELECT max(t) AS now FROM p), g AS (SELECT stream, max(t) AS seen FROM p WHERE kind <> 'error' GROUP BY 1) SELECT stream, now - seen > {30 * HOUR} AS retired FROM g, m")
def ret9_idle(spark, d):
    """RET-9: streams without a lease for 30 hours are retired."""
    p = packets(spark, d)
    return p.where("kind <> 'error'").groupBy("stream").agg(F.max("t").alias("seen")).join(F.broadcast(p.agg(F.max("t").alias("now")))).select("stream", (F.col("now") - F.col("seen") > 30 * HOUR).alias("retired"))


@q(f"WITH {P}, c AS (SELECT *, lag(kind) OVER (PARTITION BY stream ORDER BY t, arrival) IS DISTINCT FROM kind AS changed FROM p) SELECT arrival, changed, CAST(sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY t, arrival ROWS UNBOUNDED PRECEDING) AS BIGINT) AS init FROM c")
def ret10_initialization(spark, d):
    """RET-10, PL-4, SUP-24: an identical header keeps its id; MAP is told on change."""
    r = packets(spark, d).withColumn("changed", ~F.col("kind").eqNullSafe(F.lag("kind").over(by_time())))
    return r.select("arrival", "changed", F.sum(F.col("changed").cast("int")).over(by_time().rowsBetween(Window.unboundedPreceding, 0)).alias("init"))


@q(f"WITH {L}, x AS (SELECT a.parent, sum(b.bytes) * 8.0 / sum(b.dur) AS rate, CAST(sum(b.dur) AS BIGINT) AS span FROM l a JOIN l b ON a.parent = b.parent AND b.idx >= a.idx JOIN l c ON a.parent = c.parent AND c.idx >= b.idx GROUP BY a.parent, a.idx, c.idx) SELECT parent, max(CAST(rate AS DECIMAL(38, 3))::DOUBLE) AS peak FROM x WHERE span BETWEEN 25 AND 75 GROUP BY 1")
def ret11_peak_bitrate(spark, d):
    """RET-11: the greatest bitrate of contiguous runs of 0.5 to 1.5 targets (50), by prefix sums;
    ends are looked for in two buckets of the timeline, so a long parent is no all-pairs join."""
    w = Window.partitionBy("parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    l = tiles(spark, d).withColumn("total", F.sum("bytes").over(w))
    a = l.select("parent", "idx", "start", (F.col("total") - F.col("bytes")).alias("before"))
    b = l.select(F.col("parent").alias("p2"), F.col("idx").alias("j"), (F.col("start") + F.col("dur")).alias("stop"), "total")
    # a run of at most 75 ends in the bucket of its start or in the next one
    a = a.withColumn("bucket", F.explode(F.expr("array(start div 76, start div 76 + 1)")))
    near = (F.col("parent") == F.col("p2")) & (F.col("bucket") == F.expr("stop div 76")) & (F.col("j") >= F.col("idx"))
    x = a.join(b, near).withColumn("span", F.col("stop") - F.col("start")).where("span between 25 and 75")
    rate = F.round((F.col("total") - F.col("before")) * 8.0 / F.col("span"), 3)
    return x.groupBy("parent").agg(F.max(rate).alias("peak"))


@q(f"WITH {S}, a AS (SELECT *, CAST(coalesce(sum(dur) OVER (PARTITION BY stream ORDER BY t, arrival ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS after FROM s) SELECT stream, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(dur) AS BIGINT) AS span FROM a WHERE after < {100 * HOUR} GROUP BY 1")
def ret12_average_bitrate(spark, d):
    """RET-12: bytes and length of the latest 100 hours."""
    return window_rows(spark, d).where(F.col("after") < 100 * HOUR).groupBy("stream").agg(F.sum("bytes").alias("bytes"), F.sum("dur").alias("span"))


@q(f"WITH {L}, c AS (SELECT *, lag(start + dur) OVER (PARTITION BY parent ORDER BY idx) AS prev FROM l) SELECT parent, CASE WHEN bool_or(prev > start OR dur <= 0) THEN 1 ELSE count(*) END AS entries FROM c GROUP BY 1")
def ret13_iframes(spark, d):
    """RET-13: byte ranges in order; an invalid index is one gap."""
    c = tiles(spark, d).withColumn("prev", F.lag(F.col("start") + F.col("dur")).over(Window.partitionBy("parent").orderBy("idx")))
    return c.groupBy("parent").agg(F.when(F.bool_or((F.col("prev") > F.col("start")) | (F.col("dur") <= 0)), 1).otherwise(F.count("*")).cast("long").alias("entries"))


@q(f"WITH {P}, k AS (SELECT stream, kind, t // {HOUR} AS rev, arrival, row_number() OVER (PARTITION BY stream, kind, t // {HOUR} ORDER BY arrival) AS n FROM p) SELECT kind, count(*) FILTER (n = 1) AS misses, count(*) FILTER (n > 1) AS hits FROM k GROUP BY 1")
def ret14_cache(spark, d):
    """RET-14: single-flight cache keys: the first of each renders, others hit."""
    g = packets(spark, d).groupBy("stream", "kind", floor_div(F.col("t"), HOUR).alias("rev")).agg(F.count("*").alias("n"))
    return g.groupBy("kind").agg(F.count("*").alias("misses"), (F.sum("n") - F.count("*")).alias("hits"))


@q("SELECT o_orderkey, CASE WHEN l.k IS NULL THEN CASE WHEN o_orderkey > (SELECT max(l_orderkey) FROM lineitem) THEN 'wait' ELSE 'miss' END WHEN gap THEN 'gap' ELSE 'found' END AS status FROM orders LEFT JOIN (SELECT l_orderkey AS k, bool_and(l_returnflag = 'R') AS gap FROM lineitem GROUP BY 1) l ON o_orderkey = l.k")
def sup18_lookup(spark, d):
    """SUP-18: parts found, missing, gaps, or still to come."""
    l = table(spark, d, "lineitem")
    g = l.groupBy(F.col("l_orderkey").alias("k")).agg(F.bool_and(F.col("l_returnflag") == "R").alias("gap"))
    top = F.broadcast(l.agg(F.max("l_orderkey").alias("top")))
    o = table(spark, d, "orders").join(g, F.col("o_orderkey") == F.col("k"), "left").join(top)
    status = F.when(F.col("k").isNull(), F.when(F.col("o_orderkey") > F.col("top"), "wait").otherwise("miss")).when(F.col("gap"), "gap").otherwise("found")
    return o.select("o_orderkey", status.alias("status"))


@q(f"WITH {L}, a AS (SELECT parent, bool_and(NOT ra) AS collapsed, count(*) AS parts FROM l GROUP BY 1), n AS (SELECT parent, row_number() OVER (ORDER BY parent DESC) AS n FROM a WHERE collapsed) SELECT a.parent, parts, coalesce(n.n <= 64, false) AS kept FROM a LEFT JOIN n USING (parent) WHERE collapsed")
def sup19_pruning(spark, d):
    """SUP-19, SUP-20: parents whose parts are all hidden collapse; of these the newest 64 stay."""
    a = tiles(spark, d).groupBy("parent").agg(F.bool_and(~F.col("ra")).alias("collapsed"), F.count("*").alias("parts")).where("collapsed")
    newest = F.broadcast(a.select("parent").orderBy(F.col("parent").desc()).limit(64).withColumn("kept", F.lit(True)))  # 64 rows
    return a.join(newest, "parent", "left").select("parent", "parts", F.coalesce("kept", F.lit(False)).alias("kept"))


@q("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 30) UNION SELECT max(p_partkey) FROM part")
def sup21_unreachable(spark, d):
    """SUP-21, SET-3: headers nothing refers to, and the current one."""
    p = table(spark, d, "part").select("p_partkey")
    return p.join(table(spark, d, "lineitem").where("l_quantity > 30"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").union(p.agg(F.max("p_partkey"))).distinct()
