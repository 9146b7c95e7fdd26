"""Queries whose next state depends on the last: folds, and recursive SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.time import floor_div
from ..operators import folds
from .inputs import HOUR, L, P, S, packets, samples, tiles
from .registry import register

QUERIES: dict = {}


def q(sql=None):
    return register(QUERIES, sql)


def ordered(table: str, order: str, columns: str = "*") -> str:
    """SQL: rows of a stream numbered from 1."""
    return f"n AS (SELECT {columns}, row_number() OVER (PARTITION BY stream ORDER BY {order}) AS i FROM {table})"


NEXT = "f JOIN n ON n.stream = f.stream AND n.i = f.i + 1"


@q(f"WITH RECURSIVE {P}, {ordered('p', 'arrival')}, f AS (SELECT stream, i, t, t AS start FROM n WHERE i = 1 UNION ALL SELECT n.stream, n.i, n.t, CASE WHEN n.t >= f.start + {24 * HOUR} THEN n.t ELSE f.start END FROM {NEXT}) SELECT stream, start, count(*) AS packets, count(*) > 4 AS dense FROM f GROUP BY 1, 2")
def str2_density(spark, d):
    """STR-2: packets in windows of 24 hours that start at their first row, not at an epoch."""
    return folds.fold(packets(spark, d).select("stream", "t", "arrival"), "stream", ["arrival"], folds.density(24 * HOUR, 4), "stream long, start long, packets long, dense boolean")


@q(f"""WITH RECURSIVE {S}, {ordered('s', 't, arrival', f'stream, t, least(dur, {6 * HOUR}) AS media')},
 f AS (SELECT stream, i, t AS start, media AS acc, true AS first, false AS shut, CAST(0 AS BIGINT) AS o, CAST(0 AS BIGINT) AS elapsed, CAST(0 AS BIGINT) AS got, false AS slow FROM n WHERE i = 1
  UNION ALL SELECT stream, i, CASE WHEN c THEN t ELSE start END, CASE WHEN c THEN media ELSE acc + media END, first AND NOT c, c, start, t - start, acc, NOT first AND acc * 2 < t - start FROM (SELECT n.*, f.start, f.acc, f.first, n.t >= f.start + {48 * HOUR} AS c FROM {NEXT}))
 SELECT stream, o AS start, elapsed, got AS media, slow FROM f WHERE shut""")
def str3_floor(spark, d):
    """STR-3: windows of 48 hours that gained less media than half their length."""
    rows = samples(spark, d).select("stream", "t", "arrival", F.least(F.col("dur"), F.lit(6 * HOUR)).alias("media"))
    return folds.fold(rows, "stream", ["t", "arrival"], folds.floor_windows(48 * HOUR, 1, 2), "stream long, start long, elapsed long, media long, slow boolean")


@q(f"""WITH RECURSIVE {S}, {ordered('s', 't, arrival', f"stream, arrival, t, least(dur, {6 * HOUR}) AS media, CASE WHEN kind = 'error' THEN {2 * HOUR} ELSE 0 END AS held")},
 f AS (SELECT stream, i, arrival, t AS start, media AS m, CAST(held AS BIGINT) AS h, false AS behind, false AS edge, CAST(0 AS BIGINT) AS had, CAST(0 AS BIGINT) AS gained FROM n WHERE i = 1
  UNION ALL SELECT stream, i, arrival, CASE WHEN j THEN t ELSE start END, CASE WHEN j THEN 0 ELSE m END, CASE WHEN j THEN 0 ELSE h END, CASE WHEN j THEN now ELSE behind END, j AND now <> behind, had, m FROM
   (SELECT *, CASE WHEN behind THEN m * 20 < 19 * had ELSE m * 10 < 9 * had END AS now FROM (SELECT n.stream, n.i, n.arrival, n.t, f.start, f.behind, f.m + n.media AS m, f.h + n.held AS h, n.t - f.start >= {24 * HOUR} AS j, greatest(0, n.t - f.start - f.h - n.held) AS had FROM {NEXT})))
 SELECT stream, arrival, CAST(had AS BIGINT) AS had, CAST(gained AS BIGINT) AS gained, behind FROM f WHERE edge""")
def str4_drift(spark, d):
    """STR-4: streams that fall behind nine tenths of the time that windows of 24 hours had, and are well from 95 % on;
    an error withholds two hours."""
    held = F.when(F.col("kind") == "error", 2 * HOUR).otherwise(0).cast("long")
    rows = samples(spark, d).select("stream", "t", "arrival", F.least(F.col("dur"), F.lit(6 * HOUR)).alias("media"), held.alias("held"))
    return folds.fold(rows, "stream", ["t", "arrival"], folds.drift(24 * HOUR, (9, 10), (19, 20)), "stream long, arrival long, had long, gained long, behind boolean")


@q(f"""WITH RECURSIVE {S}, {ordered('s', 't, arrival', f'stream, arrival, t, least(dur, {5 * HOUR}) AS len')},
 f AS (SELECT stream, i, arrival, t + len AS due, CAST(NULL AS VARCHAR) AS kind, t AS expected, CAST(0 AS BIGINT) AS off FROM n WHERE i = 1
  UNION ALL SELECT stream, i, arrival, CASE WHEN off > {HOUR} THEN t + len WHEN off < {-HOUR} THEN due ELSE due + len END, CASE WHEN off > {HOUR} THEN 'gap' WHEN off < {-HOUR} THEN 'overlap' END, due, off FROM (SELECT n.*, f.due, n.t - f.due AS off FROM {NEXT}))
 SELECT stream, arrival, kind, expected, off FROM f WHERE kind IS NOT NULL""")
def str6_gaps(spark, d):
    """STR-6: gaps and overlaps of audio against a free-running clock, units of at most 5 hours, tolerance 1 hour."""
    rows = samples(spark, d).select("stream", "t", "arrival", F.least(F.col("dur"), F.lit(5 * HOUR)).alias("dur"))
    return folds.fold(rows, "stream", ["t", "arrival"], folds.gaps(HOUR), "stream long, arrival long, kind string, expected long, off long")


PERIOD, NEAR, DEPTH = 100, 5, 2
#: groups of three pictures decoded as 2, 0, 1; jitter within the tolerance; a hole of 250 each five groups; some errors come 60 early
PICTURES = f"m AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY arrival) - 1 AS n FROM p), v AS (SELECT stream, arrival, CAST({PERIOD} * (n // 3 * 3 + CASE n % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END) + bytes % 5 - 2 + n // 15 * 250 - CASE WHEN kind = 'error' AND bytes % 50 = 7 THEN 60 ELSE 0 END AS BIGINT) AS t FROM m)"
CADENCE = f"""{PICTURES}, {ordered('v', 'arrival')}, ends AS (SELECT stream, max(i) AS top FROM n GROUP BY 1),
 f AS (SELECT stream, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(t BIGINT, a BIGINT)[]) AS held, CAST(NULL AS BIGINT) AS next, false AS ended, CAST(NULL AS BIGINT) AS arrival, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS due, CAST(NULL AS BIGINT) AS off FROM ends
  UNION ALL SELECT stream, i, CASE WHEN pops THEN held[2:] ELSE held END, CASE WHEN pops THEN CASE WHEN abs(o) > {NEAR} THEN held[1].t ELSE held[1].t - o END + {PERIOD} ELSE next END, ended OR (pops AND abs(o) > {NEAR} AND (stream % 2 = 0 OR o < 0)),
   CASE WHEN pops THEN held[1].a END, CASE WHEN NOT pops THEN NULL WHEN abs(o) <= {NEAR} THEN 'picture' WHEN stream % 2 = 0 OR o < 0 THEN 'error' ELSE 'gap' END, CASE WHEN pops THEN held[1].t - o END, CASE WHEN pops THEN o END
   FROM (SELECT *, held[1].t - coalesce(next, held[1].t) AS o, len(held) > CASE WHEN i > top THEN 0 ELSE {DEPTH} END AS pops FROM
    (SELECT f.stream, f.i + 1 AS i, e.top, f.next, f.ended, CASE WHEN n.i IS NULL THEN f.held ELSE list_sort(list_append(f.held, {{'t': n.t, 'a': n.arrival}})) END AS held FROM f JOIN ends e ON e.stream = f.stream LEFT JOIN n ON n.stream = f.stream AND n.i = f.i + 1 WHERE NOT f.ended AND f.i < e.top + {DEPTH})))"""


def judged(spark, d):
    """Pictures judged against their clock; streams of even numbers are strict."""
    n = (F.row_number().over(Window.partitionBy("stream").orderBy("arrival")) - 1).cast("long")
    place = floor_div(n, 3) * 3 + F.when(n % 3 == 0, 2).when(n % 3 == 1, 0).otherwise(1)
    early = F.when((F.col("kind") == "error") & (F.col("bytes") % 50 == 7), 60).otherwise(0)
    v = packets(spark, d).select("stream", "arrival", (place * PERIOD + F.col("bytes") % 5 - 2 + floor_div(n, 15) * 250 - early).cast("long").alias("t"))
    kind = "stream long, arrival long, kind string, due long, off long"
    modes = [folds.fold(v.where(F.col("stream") % 2 == odd), "stream", ["arrival"], folds.cadence(PERIOD, NEAR, DEPTH, not odd), kind) for odd in (0, 1)]
    return modes[0].unionByName(modes[1])


@q(f"WITH RECURSIVE {P}, {CADENCE} SELECT stream, arrival, kind, due, off FROM f WHERE kind IS NOT NULL")
def str7_cadence(spark, d):
    """STR-7: pictures in decode order, reordered by a buffer of two and judged against a fixed cadence; strict streams
    end at the first miss, others count later ones as gaps and go on from them."""
    return judged(spark, d)


@q(f"WITH RECURSIVE {P}, {CADENCE}, j AS (SELECT * FROM f WHERE kind IS NOT NULL), ok AS (SELECT * FROM j WHERE stream NOT IN (SELECT stream FROM j WHERE kind = 'error')) SELECT stream, 'picture' AS kind, due + CASE WHEN kind = 'gap' THEN off ELSE 0 END AS start, CAST({PERIOD} AS BIGINT) AS length FROM ok UNION ALL SELECT stream, 'gap', due, off FROM ok WHERE kind = 'gap'")
def sup2_video_gaps(spark, d):
    """SUP-2: each picture lasts a period, so the one before a gap ends where the gap begins; the gap comes before the
    picture held back behind it. A stream with an error has nothing."""
    j = judged(spark, d)
    ok = j.join(j.where("kind = 'error'").select("stream").distinct(), "stream", "left_anti")
    gap = F.col("kind") == "gap"
    picture = F.struct(F.lit("picture").alias("kind"), F.when(gap, F.col("due") + F.col("off")).otherwise(F.col("due")).alias("start"), F.lit(PERIOD).cast("long").alias("length"))
    hole = F.struct(F.lit("gap").alias("kind"), F.col("due").alias("start"), F.col("off").alias("length"))
    return ok.select("stream", F.explode(F.when(gap, F.array(hole, picture)).otherwise(F.array(picture))).alias("x")).select("stream", "x.*")


@q(f"""WITH RECURSIVE {L}, n AS (SELECT parent, idx, start, dur, row_number() OVER (PARTITION BY parent ORDER BY idx) AS i, count(*) OVER (PARTITION BY parent) AS top FROM l),
 f AS (SELECT parent, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS part, CAST(NULL AS BIGINT) AS start, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS units, CAST([] AS STRUCT(part BIGINT, start BIGINT, size BIGINT, units BIGINT, why VARCHAR)[]) AS out FROM n WHERE i = 1
  UNION ALL SELECT parent, i, CASE WHEN big THEN part1 ELSE part1 + CASE WHEN whole THEN 1 ELSE 0 END END, CASE WHEN big OR whole THEN NULL ELSE start1 END, CASE WHEN big OR whole THEN 0 ELSE size1 END, CASE WHEN big OR whole THEN 0 ELSE units1 END,
   list_concat(CASE WHEN shut THEN [{{'part': part, 'start': start, 'size': size, 'units': units, 'why': CASE WHEN big THEN 'cut' ELSE 'overflow' END}}] ELSE [] END,
    list_concat(CASE WHEN big THEN [{{'part': part1, 'start': here, 'size': dur, 'units': 1, 'why': 'oversize'}}] WHEN whole THEN [{{'part': part1, 'start': start1, 'size': size1, 'units': units1, 'why': 'full'}}] ELSE [] END,
     CASE WHEN i = top AND NOT big AND NOT whole THEN [{{'part': part1, 'start': start1, 'size': size1, 'units': units1, 'why': 'end'}}] ELSE [] END))
   FROM (SELECT *, size1 * 100 >= 45 * 85 AS whole FROM (SELECT *, part + CASE WHEN shut THEN 1 ELSE 0 END AS part1, CASE WHEN shut OR start IS NULL THEN here ELSE start END AS start1, CASE WHEN shut THEN 0 ELSE size END + dur AS size1, CASE WHEN shut THEN 0 ELSE units END + 1 AS units1 FROM
    (SELECT f.*, n.i AS i_, n.top, n.start AS here, n.dur, n.dur > 45 AS big, f.units > 0 AND f.size + n.dur > 45 AS shut FROM f JOIN n ON n.parent = f.parent AND n.i = f.i + 1) x (parent, i0, part, start, size, units, out0, i, top, here, dur, big, shut))))
 SELECT parent, o.part, o.start, o.size, o.units, o.why FROM (SELECT parent, unnest(out) AS o FROM f)""")
def str14_greedy(spark, d):
    """STR-14: greedy parts of at most 45 over the lines of an order; longer lines are errors."""
    return folds.fold(tiles(spark, d).select("parent", "idx", "start", "dur"), "parent", ["idx"], folds.greedy_parts(45), "parent long, part long, start long, size long, units long, why string")


#: runs of at most 60 that may end (not after every third line but the last) and reach 85 % or hold an independent line
RUNS = "u AS (SELECT parent, idx, dur, ra, sum(dur) OVER w AS upto, sum(ra::INT) OVER w AS free, count(*) OVER (PARTITION BY parent) AS n FROM l WINDOW w AS (PARTITION BY parent ORDER BY idx)), r AS (SELECT a.parent, a.idx AS i, b.idx + 1 AS j, a.n FROM u a JOIN u b ON a.parent = b.parent AND b.idx >= a.idx AND b.upto - a.upto + a.dur <= 60 WHERE b.idx = b.n - 1 OR (b.idx % 3 <> 1 AND ((b.upto - a.upto + a.dur) * 100 >= 60 * 85 OR b.free - a.free + a.ra::INT > 0)))"


@q(f"WITH RECURSIVE {L}, {RUNS}, w AS (SELECT parent, j AS stop, n, [CAST(j AS BIGINT)] AS parts FROM r WHERE i = 0 UNION ALL SELECT w.parent, r.j, w.n, list_append(w.parts, r.j - r.i) FROM w JOIN r ON r.parent = w.parent AND r.i = w.stop), b AS (SELECT parent, parts, row_number() OVER (PARTITION BY parent ORDER BY len(parts), parts DESC) AS k FROM w WHERE stop = n) SELECT g.parent, b.parts FROM (SELECT DISTINCT parent FROM l) g LEFT JOIN b ON b.parent = g.parent AND b.k = 1")
def sort7_partition(spark, d):
    """SORT-7: the fewest parts of at most 60 that reach 85 % or hold an independent line, and end where one may (not
    after every third line); longer earlier parts win. Null where there are none. An order's lines are few, and all must be known."""
    def make(key):
        units = []
        return (lambda r: units.append((r.dur, r.ra, r.idx % 3 != 1)) or []), (lambda: [(key, folds.partition(units, 60))])
    return folds.fold(tiles(spark, d).select("parent", "idx", "dur", "ra"), "parent", ["idx"], make, "parent long, parts array<long>")


@q()
def str15_planned(spark, d):
    """STR-15: parts of at most 20 hours over units of 1 to 3 hours in segments of 96, cuts confirmed with foresight and repaired where
    eager ones are illegal; a unit after a click cannot end a part, a purchase is independent."""
    rows = samples(spark, d).select(
        "stream", "arrival", floor_div("t", 96 * HOUR).alias("segment"), F.col("t").alias("start"), (HOUR + F.col("bytes") % 3 * HOUR).cast("long").alias("dur"),
        (F.col("kind") == "purchase").alias("independent"), ((F.col("kind") != "click") | (F.col("stream") % 2 == 0)).alias("can_end"),
    )
    return folds.fold(rows, "stream", ["start", "arrival"], folds.planned_parts(20 * HOUR), "stream long, segment long, part long, start long, size long, units long, error string")


@q(f"""WITH RECURSIVE {P}, {ordered('p', 'arrival', 'stream, arrival, t, ra')}, f AS (SELECT stream, i, arrival, t + {12 * HOUR} AS until, 'accepted' AS verdict FROM n WHERE i = 1
  UNION ALL SELECT stream, i, arrival, CASE WHEN verdict = 'already_published' THEN until ELSE t + {12 * HOUR} END, verdict FROM (SELECT n.*, f.until, CASE WHEN n.t >= f.until THEN 'accepted' WHEN n.ra THEN 'taken_over' ELSE 'already_published' END AS verdict FROM {NEXT}))
 SELECT stream, arrival, verdict FROM f""")
def adm1_takeover(spark, d):
    """ADM-1: claims on a stream, in order of arrival; leases of 12 hours."""
    return folds.fold(packets(spark, d).select("stream", "t", "arrival", "ra"), "stream", ["arrival"], folds.takeover(12 * HOUR), "stream long, arrival long, verdict string")


@q(f"""WITH RECURSIVE {P}, {ordered('p', 'arrival', 'stream, arrival, t')},
 f AS (SELECT stream, CAST(1 AS BIGINT) AS i, t AS free, CAST([] AS STRUCT(a BIGINT, t BIGINT)[]) AS waiting, CAST(NULL AS BIGINT) AS arrival, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS waited FROM n WHERE i = 1
  UNION ALL SELECT stream, CASE WHEN gives THEN i ELSE i + 1 END, CASE WHEN gives THEN greatest(waiting[1].t, free) + {20 * HOUR} ELSE free END, CASE WHEN gives THEN waiting[2:] ELSE list_append(CASE WHEN len(waiting) >= 4 THEN waiting[2:] ELSE waiting END, {{'a': a, 't': t}}) END,
   CASE WHEN gives OR len(waiting) >= 4 THEN waiting[1].a END, CASE WHEN gives THEN 'delivered' WHEN len(waiting) >= 4 THEN 'evicted' END, CASE WHEN gives THEN greatest(waiting[1].t, free) + {20 * HOUR} - waiting[1].t WHEN len(waiting) >= 4 THEN t - waiting[1].t END
   FROM (SELECT f.stream, f.i, f.free, f.waiting, n.arrival AS a, n.t, len(f.waiting) > 0 AND (n.i IS NULL OR f.free <= n.t) AS gives FROM f LEFT JOIN n ON n.stream = f.stream AND n.i = f.i WHERE n.i IS NOT NULL OR len(f.waiting) > 0))
 SELECT stream, arrival, outcome, waited FROM f WHERE outcome IS NOT NULL""")
def evt5_queue(spark, d):
    """EVT-5: deliveries of a subject in order, 20 hours each, four waiting."""
    return folds.fold(packets(spark, d).select("stream", "t", "arrival"), "stream", ["arrival"], folds.bounded_queue(4, 20 * HOUR), "stream long, arrival long, outcome string, waited long")


CAPACITY = 12_000


@q(f"""WITH RECURSIVE {S}, {ordered('s', 't, arrival', "stream, arrival, kind || bytes % 3 AS entry, publication AS epoch, bytes")},
 f AS (SELECT stream, i, CAST([{{'live': true, 'pos': i, 'entry': entry, 'epoch': epoch, 'bytes': bytes}}] AS STRUCT(live BOOLEAN, pos BIGINT, entry VARCHAR, epoch BIGINT, bytes BIGINT)[]) AS held, epoch, CAST(NULL AS BIGINT) AS arrival, CAST([] AS STRUCT(live BOOLEAN, pos BIGINT, entry VARCHAR, epoch BIGINT, bytes BIGINT)[]) AS gone FROM n WHERE i = 1
  UNION ALL SELECT stream, i, list_append(rest[from_:], {{'live': true, 'pos': i, 'entry': entry, 'epoch': epoch, 'bytes': bytes}}), newest, arrival, rest[:from_ - 1]
   FROM (SELECT *, 1 + len(list_filter(generate_series(1, len(rest)), lambda k: coalesce(list_sum(list_transform(rest[k:], lambda x: x.bytes)), 0) + bytes > {CAPACITY})) AS from_ FROM
    (SELECT *, list_sort(list_transform(list_filter(held, lambda x: x.entry <> entry), lambda x: {{'live': x.epoch = newest, 'pos': x.pos, 'entry': x.entry, 'epoch': x.epoch, 'bytes': x.bytes}})) AS rest FROM
     (SELECT n.*, f.held, greatest(f.epoch, n.epoch) AS newest FROM {NEXT}))))
 SELECT stream, arrival, g.entry AS victim, NOT g.live AS stale FROM (SELECT stream, arrival, unnest(gone) AS g FROM f)""")
def sort5_lru(spark, d):
    """SORT-5: victims of a cache of 12,000 bytes: entries of older publications first, then the least recently touched."""
    rows = samples(spark, d).select("stream", "t", "arrival", F.concat("kind", (F.col("bytes") % 3).cast("string")).alias("entry"), F.col("publication").alias("epoch"), "bytes")
    return folds.fold(rows, "stream", ["t", "arrival"], folds.lru(CAPACITY), "stream long, arrival long, victim string, stale boolean")


@q(f"WITH {S}, e AS (SELECT *, t + least(dur, {7 * HOUR}) + bytes % 3 * {HOUR} AS stop FROM s), w AS (SELECT *, greatest(min(t) OVER p, max(stop) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS begin FROM e WINDOW p AS (PARTITION BY stream, publication ORDER BY t, arrival)) SELECT arrival, CAST(CASE WHEN kind IN ('view', 'purchase') THEN stop - t ELSE greatest(stop, begin) - begin END AS BIGINT) AS span FROM w")
def sup13_part_clock(spark, d):
    """SUP-13: what each unit adds to its part: a picture its duration, sound what its end is past the greatest end so
    far, which begins at the publication's first time."""
    w = Window.partitionBy("stream", "publication").orderBy("t", "arrival")
    e = samples(spark, d).withColumn("stop", F.col("t") + F.least(F.col("dur"), F.lit(7 * HOUR)) + F.col("bytes") % 3 * HOUR)
    begin = F.greatest(F.min("t").over(w), F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    span = F.when(F.col("kind").isin("view", "purchase"), F.col("stop") - F.col("t")).otherwise(F.greatest(F.col("stop"), begin) - begin)
    return e.select("arrival", span.alias("span"))
