"""Correlations, as the joins they are."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.time import floor_div
from ..operators.joins import as_of_forward, latest, overlap_join
from .inputs import HOUR, L, P, S, packets, samples, table, tiles
from .registry import register

QUERIES: dict = {}
GRID = 12 * HOUR


def q(sql=None):
    return register(QUERIES, sql)


@q("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25")
def join1_lookup(spark, d):
    """JOIN-1, JOIN-11: samples with their tracks."""
    return table(spark, d, "lineitem").join(table(spark, d, "part").where("p_size > 25"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_brand")


@q("SELECT l_partkey AS track, count(*) AS samples FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY 1")
def join1_unknown(spark, d):
    """JOIN-1: samples of unknown tracks are errors."""
    return table(spark, d, "lineitem").join(table(spark, d, "part").where("p_size > 10"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").groupBy(F.col("l_partkey").alias("track")).agg(F.count("*").alias("samples"))


@q(f"WITH {P} SELECT t // {HOUR} AS instant FROM p WHERE ra GROUP BY 1 HAVING count(DISTINCT kind) = 2")
def join2_common_keyframes(spark, d):
    """JOIN-2, SET-2: hours in which both kinds of random access occur."""
    p = packets(spark, d).where("ra").withColumn("instant", floor_div(F.col("t"), HOUR))
    return p.groupBy("instant").agg(F.countDistinct("kind").alias("n")).where("n = 2").select("instant")


@q(f"WITH {S}, g AS (SELECT DISTINCT stream, (t // {GRID} + 1) * {GRID} AS b FROM s) SELECT g.stream, g.b, s.arrival FROM g JOIN s ON g.stream = s.stream AND s.t <= g.b AND g.b < s.t + s.dur")
def join3_covering(spark, d):
    """JOIN-3, JOIN-8: the unit that covers each boundary of a 12-hour grid."""
    s = samples(spark, d)
    g = s.select("stream", ((floor_div(F.col("t"), GRID) + 1) * GRID).alias("b")).distinct().withColumn("b_end", F.col("b") + 1)
    return overlap_join(g, s.select("stream", "arrival", "t", (F.col("t") + F.col("dur")).alias("t_end")), "stream", "b", "b_end", "t", "t_end", 24 * HOUR).select("stream", "b", "arrival")


@q(f"WITH {P}, g AS (SELECT DISTINCT stream, (t // {GRID}) * {GRID} AS b FROM p) SELECT g.stream, g.b, (SELECT min(t) FROM p WHERE p.stream = g.stream AND p.t >= g.b AND p.kind = 'purchase') AS cut FROM g")
def join4_cut(spark, d):
    """JOIN-4: the first purchase at or after each boundary, forward as-of."""
    p = packets(spark, d)
    g = p.select("stream", (floor_div(F.col("t"), GRID) * GRID).alias("b")).distinct()
    return as_of_forward(g, p.where("kind = 'purchase'").select("stream", "t", F.col("t").alias("cut")), "stream", "b", "t", "cut")


@q(f"WITH {P}, g AS (SELECT DISTINCT stream, (t // {GRID}) * {GRID} AS b FROM p), c AS (SELECT g.stream, g.b, p.arrival, p.t - g.b AS off, row_number() OVER (PARTITION BY g.stream, g.b ORDER BY p.arrival) AS n FROM g JOIN p ON p.stream = g.stream AND p.ra AND p.t BETWEEN g.b - {2 * HOUR} AND g.b + {3 * HOUR}) SELECT stream, b, arrival, off FROM c WHERE n = 1")
def join5_band(spark, d):
    """JOIN-5, SORT-2: the first keyframe within [-2 h, +3 h] of each boundary, both inclusive."""
    hit = _in_band(packets(spark, d), "ra")
    return hit.groupBy("stream", "b").agg(F.min(F.struct("arrival", (F.col("t") - F.col("b")).alias("off"))).alias("x")).select("stream", "b", "x.*")


def _in_band(p, which):
    """(stream, b, arrival, t) of the rows that are within [-2 h, +3 h] of a boundary of their stream. The band is
    shorter than the grid, so a row is near one boundary at most, and the join is of equal keys."""
    boundaries = p.select("stream", (floor_div("t", GRID) * GRID).alias("b")).distinct()
    near = p.where(which).select("stream", (floor_div(F.col("t") + 2 * HOUR, GRID) * GRID).alias("b"), "arrival", "t")
    return near.where(F.col("t") - F.col("b") <= 3 * HOUR).join(boundaries, ["stream", "b"], "left_semi")


@q(f"WITH {S}, c AS (SELECT *, unnest(generate_series(t // {GRID}, (t + dur - 1) // {GRID})) AS w FROM s WHERE dur > {6 * HOUR}) SELECT arrival, w, greatest(t, w * {GRID}) AS start, least(t + dur, (w + 1) * {GRID}) AS stop FROM c")
def join6_gap_split(spark, d):
    """JOIN-6, JOIN-7, STR-16: gaps of over 6 hours are copied to each 12-hour window they overlap, and clipped."""
    s = samples(spark, d).where(F.col("dur") > 6 * HOUR)
    rows = s.withColumn("w", F.explode(F.sequence(floor_div(F.col("t"), GRID), floor_div(F.col("t") + F.col("dur") - 1, GRID))))
    return rows.select("arrival", "w", F.greatest(F.col("t"), F.col("w") * GRID).alias("start"), F.least(F.col("t") + F.col("dur"), (F.col("w") + 1) * GRID).alias("stop"))


@q(f"WITH {P}, e AS (SELECT stream, kind, max(t) AS edge FROM p GROUP BY 1, 2) SELECT a.stream, a.kind, b.kind AS other, b.edge FROM e a JOIN e b ON a.stream = b.stream AND a.kind <> b.kind")
def join9_reports(spark, d):
    """JOIN-9: of every rendition the live edges of the others."""
    e = packets(spark, d).groupBy("stream", "kind").agg(F.max("t").alias("edge"))
    o = e.select(F.col("stream").alias("s2"), F.col("kind").alias("other"), "edge")
    return e.drop("edge").join(o, (F.col("stream") == F.col("s2")) & (F.col("kind") != F.col("other"))).select("stream", "kind", "other", "edge")


@q("SELECT n_nationkey AS grp, count(*) AS members FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0 GROUP BY 1 HAVING count(*) > 0")
def join10_groups(spark, d):
    """JOIN-10: members through groups; inactive members and empty groups go."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").where("c_acctbal > 0").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_nationkey").alias("grp")).agg(F.count("*").alias("members"))


@q("SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderkey <> o.o_orderkey)")
def join12_incumbents(spark, d):
    """JOIN-12: sessions whose stream another session has, by a count a key."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    many = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b")).where("a <> b").select("o_custkey")
    return o.join(many, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@q(f"WITH {P}, a AS (SELECT stream, kind, count(*) AS n FROM p WHERE arrival % 2 = 0 GROUP BY 1, 2), b AS (SELECT stream, kind, count(*) AS n FROM p WHERE arrival % 2 = 1 GROUP BY 1, 2) SELECT coalesce(a.stream, b.stream) AS stream, coalesce(a.kind, b.kind) AS kind, CASE WHEN b.kind IS NULL THEN 'retire' WHEN a.kind IS NULL THEN 'create' ELSE 'keep' END AS action FROM a FULL JOIN b ON a.stream = b.stream AND a.kind = b.kind")
def join13_reconnect(spark, d):
    """JOIN-13, SRC-11: old renditions against new ones: keep, create, retire."""
    p = packets(spark, d)
    a, b = (p.where(F.col("arrival") % 2 == i).groupBy("stream", "kind").agg(F.count("*").alias(f"n{i}")) for i in (0, 1))
    action = F.when(F.col("n1").isNull(), "retire").when(F.col("n0").isNull(), "create").otherwise("keep")
    return a.join(b, ["stream", "kind"], "full").select("stream", "kind", action.alias("action"))


@q(f"WITH {S}, a AS (SELECT stream, publication, min(t) AS anchor FROM s GROUP BY 1, 2) SELECT arrival, t - anchor AS off FROM s LEFT JOIN a USING (stream, publication)")
def join14_anchor(spark, d):
    """JOIN-14, SUP-8, SRC-8: positions from their publication's first row."""
    w = Window.partitionBy("stream", "publication")
    return samples(spark, d).select("arrival", (F.col("t") - F.min("t").over(w)).alias("off"))


@q(f"WITH {P} SELECT stream, count(*) AS n FROM p WHERE stream IN (SELECT stream FROM p WHERE kind = 'error' GROUP BY 1 HAVING count(*) >= 12) GROUP BY 1")
def join15_semi(spark, d):
    """JOIN-15, PQ-9: series of streams that another series has."""
    p = packets(spark, d)
    bad = p.where("kind = 'error'").groupBy("stream").count().where("count >= 12")
    return p.join(bad, "stream", "left_semi").groupBy("stream").agg(F.count("*").alias("n"))


@q(f"WITH {P} SELECT stream, arrival, t, kind FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY t DESC) AS n FROM p) WHERE n = 1")
def live_edge(spark, d):
    """Live edges: the latest row of each stream."""
    return latest(packets(spark, d).select("stream", "arrival", "t", "kind"), ["stream"], "t")


@q(f"WITH {L} SELECT parent, idx FROM l EXCEPT SELECT parent, idx FROM l WHERE ra")
def set3_except(spark, d):
    """SET-3: parts that no independent part covers."""
    l = tiles(spark, d)
    return l.select("parent", "idx").exceptAll(l.where("ra").select("parent", "idx")).distinct()


@q("SELECT c_nationkey, min(c_custkey) AS first FROM customer GROUP BY 1 UNION SELECT s_nationkey, min(s_suppkey) FROM supplier GROUP BY 1")
def set1_union(spark, d):
    """SET-1: unions and distinct members."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("first"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("first"))
    return c.unionByName(s).distinct()


@q("WITH v AS (SELECT l_suppkey AS stream, l_partkey AS rendition, min(l_orderkey) AS combination FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2) SELECT stream, rendition, combination, row_number() OVER (PARTITION BY stream ORDER BY combination, rendition) AS line FROM v")
def set4_variants(spark, d):
    """SET-4: of combinations (orders) with a primary rendition (the part on their first line) one variant line a
    rendition, where the first combination that has it puts it."""
    v = table(spark, d, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_suppkey").alias("stream"), F.col("l_partkey").alias("rendition")).agg(F.min("l_orderkey").alias("combination"))
    return v.withColumn("line", F.row_number().over(Window.partitionBy("stream").orderBy("combination", "rendition")))


@q("WITH x AS (SELECT l_orderkey AS c, l_partkey AS g, min(l_linenumber) AS n FROM lineitem GROUP BY 1, 2) SELECT g AS alternate, count(*) FILTER (n > 1) AS combinations, bool_or(n = 1) AS primary_elsewhere FROM x GROUP BY 1 HAVING bool_or(n > 1)")
def set5_alternates(spark, d):
    """SET-5: groups (parts) that some combination (order) uses without their being its primary, once each."""
    x = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_partkey").alias("alternate")).agg(F.min("l_linenumber").alias("n"))
    g = x.groupBy("alternate").agg(F.count_if(F.col("n") > 1).alias("combinations"), F.bool_or(F.col("n") == 1).alias("primary_elsewhere"))
    return g.where("combinations > 0")


@q(f"WITH {P}, g AS (SELECT DISTINCT stream, (t // {GRID}) * {GRID} AS b FROM p), c AS (SELECT g.stream, g.b, arg_min(p.t, p.arrival) AS cut FROM g JOIN p ON p.stream = g.stream AND p.kind = 'view' AND p.t BETWEEN g.b - {2 * HOUR} AND g.b + {3 * HOUR} GROUP BY 1, 2), k AS (SELECT DISTINCT stream, kind FROM p WHERE kind IN ('click', 'purchase')), x AS (SELECT c.stream, c.b, c.cut, (SELECT min(t) FROM p WHERE p.stream = c.stream AND p.kind = k.kind AND p.t >= c.cut) AS sibling FROM c LEFT JOIN k ON k.stream = c.stream) SELECT stream, b, cut, count(sibling) + 1 AS tracks, coalesce(max(sibling), cut) AS latest FROM x GROUP BY 1, 2, 3 HAVING count(*) FILTER (sibling IS NULL AND EXISTS (SELECT 1 FROM k WHERE k.stream = x.stream)) = 0 AND coalesce(max(sibling), cut) <= cut + {48 * HOUR}")
def str12_coordinated_cut(spark, d):
    """STR-12: the authority (view) cuts at its first picture within [-2 h, +3 h] of a boundary, each other track at its
    first unit from there on; all tracks cut, within 48 hours, or none does."""
    p = packets(spark, d)
    c = _in_band(p, "kind = 'view'").groupBy("stream", "b").agg(F.min_by("t", "arrival").alias("cut"))
    track = F.struct("stream", "kind")
    units = p.where("kind in ('click', 'purchase')").withColumn("track", track)
    kinds = units.select("stream", "kind").distinct()
    asked = c.join(kinds, "stream").withColumn("track", track)
    found = as_of_forward(asked, units.select("track", "t", F.col("t").alias("sibling")), "track", "cut", "t", "sibling").select("stream", "b", "sibling", F.lit(True).alias("asked"))
    r = c.join(found, ["stream", "b"], "left").groupBy("stream", "b", "cut").agg((F.count("sibling") + 1).alias("tracks"), F.count("asked").alias("asked"), F.coalesce(F.max("sibling"), "cut").alias("latest"))
    return r.where((F.col("tracks") == F.col("asked") + 1) & (F.col("latest") <= F.col("cut") + 48 * HOUR)).drop("asked")
