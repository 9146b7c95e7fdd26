"""Event-time operators: calibration, grids, cues, late data, episodes, budgets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.time import floor_div
from .inputs import HOUR, L, P, S, by_time, packets, samples, table, tiles
from .registry import register

QUERIES: dict = {}
GRID = 12 * HOUR


def q(sql=None):
    return register(QUERIES, sql)


@q(f"WITH {P}, f AS (SELECT stream, kind, min(t) AS first FROM p WHERE kind IN ('view', 'click') GROUP BY 1, 2), a AS (SELECT stream, min(first) AS origin, coalesce(max(CASE WHEN kind = 'view' THEN kind END), 'click') AS authority FROM f GROUP BY 1) SELECT p.arrival, a.authority, p.t - a.origin AS pts FROM p JOIN a USING (stream)")
def str1_calibration(spark, d):
    """STR-1: the authority is video, else audio; the origin their earliest first time; subtitles do not count."""
    p = packets(spark, d)
    f = p.where("kind in ('view', 'click')").groupBy("stream").agg(F.min("t").alias("origin"), F.coalesce(F.max(F.when(F.col("kind") == "view", F.col("kind"))), F.lit("click")).alias("authority"))
    return p.join(f, "stream").select("arrival", "authority", (F.col("t") - F.col("origin")).alias("pts"))


@q(f"WITH {S}, h AS (SELECT * FROM s WHERE dur > {10 * HOUR}), w AS (SELECT *, count(*) OVER x AS n, CAST(sum(dur) OVER x AS BIGINT) AS total FROM h WINDOW x AS (PARTITION BY stream ORDER BY t + dur RANGE BETWEEN {240 * HOUR - 1} PRECEDING AND CURRENT ROW)) SELECT arrival, n, total, CASE WHEN dur > {40 * HOUR} THEN 'hole' WHEN n > 6 THEN 'count' WHEN total > {100 * HOUR} THEN 'total' END AS refused FROM w")
def str8_hole_budget(spark, d):
    """STR-8: of holes over 10 hours in 10 days at most 6, 100 hours together and 40 each; half-open by their ends."""
    end = F.col("t") + F.col("dur")
    w = Window.partitionBy("stream").orderBy(end).rangeBetween(-(240 * HOUR - 1), 0)
    r = samples(spark, d).where(F.col("dur") > 10 * HOUR).withColumn("n", F.count("*").over(w)).withColumn("total", F.sum("dur").over(w))
    return r.select("arrival", "n", "total", F.when(F.col("dur") > 40 * HOUR, "hole").when(F.col("n") > 6, "count").when(F.col("total") > 100 * HOUR, "total").alias("refused"))


@q(f"WITH {S}, h AS (SELECT *, lag(t + dur) OVER (PARTITION BY stream ORDER BY t) AS prev FROM s WHERE dur > {10 * HOUR}), g AS (SELECT *, CAST(sum(CASE WHEN prev IS NULL OR t - prev >= {30 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY t) AS BIGINT) AS episode FROM h) SELECT stream, episode, min(t) AS start, max(t + dur) AS stop, count(*) AS holes FROM g GROUP BY 1, 2")
def str9_episodes(spark, d):
    """STR-9: holes less than 30 clean hours apart are one degraded episode."""
    w = Window.partitionBy("stream").orderBy("t")
    h = samples(spark, d).where(F.col("dur") > 10 * HOUR).withColumn("prev", F.lag(F.col("t") + F.col("dur")).over(w))
    h = h.withColumn("new", F.when(F.col("prev").isNull() | (F.col("t") - F.col("prev") >= 30 * HOUR), 1).otherwise(0)).withColumn("episode", F.sum("new").over(w))
    return h.groupBy("stream", "episode").agg(F.min("t").alias("start"), F.max(F.col("t") + F.col("dur")).alias("stop"), F.count("*").alias("holes"))


@q(f"WITH {P}, o AS (SELECT stream, min(t) AS a, max(t) AS z FROM p GROUP BY 1) SELECT stream, k, CASE WHEN k = 1 THEN a + {GRID} ELSE a + CAST(({GRID}::HUGEINT * k * 1001 * 2 + 1000) // 2000 AS BIGINT) END AS nominal FROM (SELECT *, unnest(generate_series(1, greatest(1, (z - a) // {GRID}))) AS k FROM o)")
def str11_grid(spark, d):
    """STR-11: nominal boundaries: the first as given, later ones by a fractional period, never re-anchored."""
    from ..functions.time import idiv
    o = packets(spark, d).groupBy("stream").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    r = o.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), floor_div(F.col("z") - F.col("a"), GRID)))))
    later = idiv(F.lit(GRID).cast("decimal(38,0)") * F.col("k") * 1001 * 2 + 1000, 2000).cast("long")
    return r.select("stream", "k", F.when(F.col("k") == 1, F.col("a") + GRID).otherwise(F.col("a") + later).alias("nominal"))


@q(f"WITH {P}, g AS (SELECT stream, unnest(generate_series(min(t) // {GRID} + 1, max(t) // {GRID})) * {GRID} AS b, max(t) AS now FROM p GROUP BY 1), k AS (SELECT stream, ((t + {2 * HOUR}) // {GRID}) * {GRID} AS b, count(*) AS n, min(t - ((t + {2 * HOUR}) // {GRID}) * {GRID}) AS off FROM p WHERE ra GROUP BY 1, 2) SELECT g.stream, g.b, CASE WHEN k.n IS NULL THEN 'MissingKeyframe' ELSE 'MisalignedKeyframes' END AS error FROM g LEFT JOIN k ON g.stream = k.stream AND g.b = k.b WHERE g.now > g.b + {3 * HOUR} AND (k.n IS NULL OR k.off > {3 * HOUR})")
def str13_missed(spark, d):
    """STR-13: boundaries whose late edge has passed without a keyframe in their tolerance."""
    p = packets(spark, d)
    g = p.groupBy("stream").agg(F.min("t").alias("a"), F.max("t").alias("now"))
    g = g.withColumn("k", F.explode(F.sequence(floor_div(F.col("a"), GRID) + 1, floor_div(F.col("now"), GRID)))).withColumn("b", F.col("k") * GRID)
    near = floor_div(F.col("t") + 2 * HOUR, GRID) * GRID
    k = p.where("ra").groupBy("stream", near.alias("b")).agg(F.count("*").alias("n"), F.min(F.col("t") - near).alias("off"))
    r = g.join(k, ["stream", "b"], "left").where((F.col("now") > F.col("b") + 3 * HOUR) & (F.col("n").isNull() | (F.col("off") > 3 * HOUR)))
    return r.select("stream", "b", F.when(F.col("n").isNull(), "MissingKeyframe").otherwise("MisalignedKeyframes").alias("error"))


@q(f"WITH {S}, o AS (SELECT stream, min(t) // {GRID} AS a, max(t + dur - 1) // {GRID} AS z FROM s GROUP BY 1), g AS (SELECT stream, unnest(generate_series(a, z)) AS w FROM o), c AS (SELECT stream, unnest(generate_series(t // {GRID}, (t + dur - 1) // {GRID})) AS w, kind FROM s WHERE kind = 'click') SELECT g.stream, g.w, count(c.kind) AS cues FROM g LEFT JOIN c ON g.stream = c.stream AND g.w = c.w GROUP BY 1, 2")
def str17_sealed_windows(spark, d):
    """STR-16, STR-17: windows are sealed by the stream's clock; sparse tracks still give empty ones."""
    s = samples(spark, d)
    first, last = floor_div(F.col("t"), GRID), floor_div(F.col("t") + F.col("dur") - 1, GRID)
    g = s.groupBy("stream").agg(F.min(first).alias("a"), F.max(last).alias("z")).select("stream", F.explode(F.sequence("a", "z")).alias("w"))
    c = s.where("kind = 'click'").select("stream", F.explode(F.sequence(first, last)).alias("w")).groupBy("stream", "w").agg(F.count("*").alias("n"))
    return g.join(c, ["stream", "w"], "left").select("stream", "w", F.coalesce("n", F.lit(0)).alias("cues"))


@q(f"WITH {P}, x AS (SELECT stream, arrival, t - CASE WHEN arrival % 9 = 0 THEN {30 * HOUR} ELSE 0 END + {HOUR} AS stop, t FROM p), w AS (SELECT *, max(t) OVER (PARTITION BY stream ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // {GRID} * {GRID} AS sealed FROM x) SELECT stream, arrival, stop, sealed FROM w WHERE stop <= sealed")
def str18_late_cues(spark, d):
    """STR-18: cues that end at or before the last sealed position are reported, not merged (every ninth is 30 hours late)."""
    w = Window.partitionBy("stream").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.col("t") - F.when(F.col("arrival") % 9 == 0, 30 * HOUR).otherwise(0) + HOUR
    r = packets(spark, d).withColumn("stop", stop).withColumn("sealed", floor_div(F.max("t").over(w), GRID) * GRID)
    return r.where("stop <= sealed").select("stream", "arrival", "stop", "sealed")


@q(f"WITH {P}, c AS (SELECT *, lag(kind) OVER (PARTITION BY stream ORDER BY t, arrival) AS before FROM p), k AS (SELECT * FROM c WHERE before IS NULL OR before <> kind), e AS (SELECT *, lead(t) OVER (PARTITION BY stream ORDER BY t, arrival) AS nxt, (SELECT max(t) FROM p z WHERE z.stream = k.stream) AS clock FROM k) SELECT stream, arrival, t AS start, coalesce(nxt, clock) AS stop, kind AS text, coalesce(nxt, clock) - t >= {30 * HOUR} AS long_lived FROM e WHERE kind <> 'error'")
def str19_replacement(spark, d):
    """STR-19, STR-20: a state lasts until the next; restatements join; 'error' clears; the end closes at the clock; 30 hours are long."""
    p = packets(spark, d).withColumn("clock", F.max("t").over(Window.partitionBy("stream"))).withColumn("before", F.lag("kind").over(by_time()))
    k = p.where("before is null or before <> kind").withColumn("stop", F.coalesce(F.lead("t").over(by_time()), "clock")).where("kind <> 'error'")
    return k.select("stream", "arrival", F.col("t").alias("start"), "stop", F.col("kind").alias("text"), (F.col("stop") - F.col("t") >= 30 * HOUR).alias("long_lived"))


@q(f"WITH {S} SELECT arrival, (t + dur - 1) // {HOUR} - t // {HOUR} + 1 AS copies FROM s WHERE (t + dur - 1) // {HOUR} - t // {HOUR} + 1 > 24")
def str21_guards(spark, d):
    """STR-21, STR-22: cues that would be copied to over 24 hour windows are refused before they are."""
    n = floor_div(F.col("t") + F.col("dur") - 1, HOUR) - floor_div(F.col("t"), HOUR) + 1
    return samples(spark, d).select("arrival", n.alias("copies")).where("copies > 24")


@q(f"WITH {P}, e AS (SELECT stream, t, arrival, 0 AS o, bytes AS x FROM p UNION ALL SELECT stream, t + {24 * HOUR}, arrival, 1, -bytes FROM p), r AS (SELECT stream, sum(x) OVER (PARTITION BY stream ORDER BY t, o DESC, arrival ROWS UNBOUNDED PRECEDING) AS held FROM e) SELECT stream, CAST(max(held) AS BIGINT) AS peak FROM r GROUP BY 1")
def str23_ledger(spark, d):
    """STR-23, ADM-2, ADM-4: what is held at once: running sums of what comes and, 24 hours later, goes."""
    p = packets(spark, d)
    e = p.select("stream", "t", "arrival", F.lit(0).alias("o"), F.col("bytes").alias("x")).unionByName(p.select("stream", (F.col("t") + 24 * HOUR).alias("t"), "arrival", F.lit(1).alias("o"), (-F.col("bytes")).alias("x")))
    w = Window.partitionBy("stream").orderBy("t", F.col("o").desc(), "arrival").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("held", F.sum("x").over(w)).groupBy("stream").agg(F.max("held").alias("peak"))


@q(f"WITH {S}, m AS (SELECT *, max(publication) OVER (PARTITION BY stream ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS newest FROM (SELECT * REPLACE (publication - CASE WHEN arrival % 13 = 0 THEN 1 ELSE 0 END AS publication) FROM s)) SELECT stream, count(*) AS kept FROM m WHERE publication = newest GROUP BY 1")
def str25_lease(spark, d):
    """STR-25: rows of an older publication than the newest so far are dropped (every thirteenth is stale)."""
    s = samples(spark, d).withColumn("publication", F.col("publication") - F.when(F.col("arrival") % 13 == 0, 1).otherwise(0))
    newest = F.max("publication").over(Window.partitionBy("stream").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0))
    return s.withColumn("newest", newest).where("publication = newest").groupBy("stream").agg(F.count("*").alias("kept"))


@q(f"WITH {P}, m AS (SELECT stream, max(t) FILTER (ra) AS done, max(t) AS edge FROM p GROUP BY 1) SELECT p.stream, p.arrival, {GRID} AS gap FROM p JOIN m USING (stream) WHERE p.t > coalesce(m.done, -1)")
def str26_unfinished(spark, d):
    """STR-26: what follows the last completed row becomes gaps of the target duration."""
    p = packets(spark, d)
    m = p.groupBy("stream").agg(F.max(F.when(F.col("ra"), F.col("t"))).alias("done"))
    return p.join(m, "stream").where(F.col("t") > F.coalesce("done", F.lit(-1))).select("stream", "arrival", F.lit(GRID).alias("gap"))


@q(f"WITH {P}, r AS (SELECT stream, arrival, t FROM p WHERE kind = 'click') SELECT r.arrival, least(coalesce((SELECT min(x.t) FROM p x WHERE x.stream = r.stream AND x.ra AND x.t >= r.t), r.t + {18 * HOUR}), r.t + {18 * HOUR}) - r.t AS waited FROM r")
def str27_blocking(spark, d):
    """STR-27, PL-10: requests wait for the next keyframe, at most 18 hours."""
    from ..operators.joins import as_of_forward
    p = packets(spark, d)
    r = as_of_forward(p.where("kind = 'click'").select("stream", "arrival", "t"), p.where("ra").select("stream", "t", F.col("t").alias("ready")), "stream", "t", "t", "ready")
    return r.select("arrival", (F.least(F.coalesce("ready", F.col("t") + 18 * HOUR), F.col("t") + 18 * HOUR) - F.col("t")).alias("waited"))


@q("WITH l AS (SELECT l_orderkey AS k, max(l_linenumber) AS last, max(l_quantity)::BIGINT AS held, count(*) AS asked, min(l_quantity)::BIGINT AS part FROM lineitem GROUP BY 1) SELECT k AS o_orderkey, CASE WHEN asked > last + 2 THEN 'too_far' WHEN asked = last + 1 AND part > held % 5 + 3 THEN 'part_too_far' WHEN asked > last OR (asked = last AND part >= held) THEN 'wait' ELSE 'ready' END AS verdict FROM l")
def str28_advance(spark, d):
    """STR-28: requests for a segment (as many as an order's lines) against the last one (its highest number): more than
    two ahead is too far, and of the next one more than three parts past those it has."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").alias("last"), F.max("l_quantity").cast("long").alias("held"), F.count("*").alias("asked"), F.min("l_quantity").cast("long").alias("part"))
    last, held, asked, part = (F.col(c) for c in ("last", "held", "asked", "part"))
    verdict = F.when(asked > last + 2, "too_far").when((asked == last + 1) & (part > held % 5 + 3), "part_too_far").when((asked > last) | ((asked == last) & (part >= held)), "wait").otherwise("ready")
    return g.select("o_orderkey", verdict.alias("verdict"))


@q(f"WITH {L}, b AS (SELECT *, abs(start + dur - 60) AS far FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY far, start) AS n FROM b) SELECT parent, idx, far, n FROM r WHERE n <= 3")
def sort1_candidates(spark, d):
    """SORT-1, SORT-2: boundaries nearest to the target, the earlier first; the best three."""
    w = Window.partitionBy("parent").orderBy("far", "start")
    return tiles(spark, d).withColumn("far", F.abs(F.col("start") + F.col("dur") - 60)).withColumn("n", F.row_number().over(w)).where("n <= 3").select("parent", "idx", "far", "n")


@q(f"WITH {P} SELECT arrival, row_number() OVER (PARTITION BY stream ORDER BY t - CASE WHEN arrival % 7 = 0 THEN {6 * HOUR} ELSE 0 END, arrival) AS position FROM p")
def sort3_presentation(spark, d):
    """SORT-3: presentation order from decode order."""
    w = Window.partitionBy("stream").orderBy(F.col("t") - F.when(F.col("arrival") % 7 == 0, 6 * HOUR).otherwise(0), "arrival")
    return packets(spark, d).select("arrival", F.row_number().over(w).alias("position"))


@q(f"WITH {L}, c AS (SELECT a.parent, b.start + b.dur - a.start AS size FROM l a JOIN l b ON a.parent = b.parent AND b.idx >= a.idx) SELECT parent, min(size) AS ceiling FROM c WHERE size >= 60 GROUP BY 1")
def sort8_ceilings(spark, d):
    """SORT-8: the least contiguous sum of at least 60: of each start the first end that far on, by a forward as-of."""
    from ..operators.joins import as_of_forward
    l = tiles(spark, d)
    ends = l.select("parent", (F.col("start") + F.col("dur")).alias("stop"), (F.col("start") + F.col("dur")).alias("found"))
    c = as_of_forward(l.select("parent", "start", (F.col("start") + 60).alias("least")), ends, "parent", "least", "stop", "found")
    return c.groupBy("parent").agg(F.min(F.col("found") - F.col("start")).alias("ceiling")).where("ceiling is not null")


@q(f"WITH {P}, r AS (SELECT stream, kind, arrival, row_number() OVER (PARTITION BY stream, kind ORDER BY arrival) AS n FROM p) SELECT stream, arrival FROM r WHERE n = 1 AND kind = 'view'")
def sort4_oldest(spark, d):
    """SORT-4: the oldest of each subject."""
    return packets(spark, d).where("kind = 'view'").groupBy("stream").agg(F.min("arrival").alias("arrival"))


@q(f"WITH {L}, e AS (SELECT parent, CAST(sum(dur) AS BIGINT) AS total, max(dur) AS longest, min(dur) AS least FROM l GROUP BY 1) SELECT parent, total, longest, ((longest + least - 1) // least) * least AS part, (100 * least + 14) // 15 AS room FROM e")
def sup14_room(spark, d):
    """SUP-14: part targets as ceilings to a multiple, and what reordering needs."""
    e = tiles(spark, d).groupBy("parent").agg(F.sum("dur").alias("total"), F.max("dur").alias("longest"), F.min("dur").alias("least"))
    return e.select("parent", "total", "longest", (F.ceil(F.col("longest") / F.col("least")) * F.col("least")).alias("part"), F.ceil(F.col("least") * 100 / 15).alias("room"))


@q(f"WITH {S}, w AS (SELECT *, lag(t) OVER (PARTITION BY stream, kind ORDER BY arrival) AS before FROM s) SELECT arrival, CASE WHEN before > t THEN 'decreasing' WHEN dur > {40 * HOUR} AND NOT ra THEN 'shrinks' ELSE 'ok' END AS verdict, CASE WHEN bytes % 10 = 0 THEN 0 ELSE dur END AS cue FROM w")
def sup1_subtitles(spark, d):
    """SUP-1, SUP-8: open cues have duration 0; times never decrease; only small shrinking is allowed."""
    before = F.lag("t").over(Window.partitionBy("stream", "kind").orderBy("arrival"))
    s = samples(spark, d).withColumn("before", before)
    verdict = F.when(F.col("before") > F.col("t"), "decreasing").when((F.col("dur") > 40 * HOUR) & ~F.col("ra"), "shrinks").otherwise("ok")
    return s.select("arrival", verdict.alias("verdict"), F.when(F.col("bytes") % 10 == 0, 0).otherwise(F.col("dur")).alias("cue"))
