"""Smaller stages and the analytics of tools: row mappers, trims, slots, ledgers, verdicts, traces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import folds
from ..operators.predicates import first_failure
from .inputs import HOUR, L, P, S, by_time, packets, samples, table, tiles
from .registry import register

QUERIES: dict = {}
#: ticks in one cycle of a 33-bit clock
CYCLE = 1 << 33
LEDGER = 20_000


def q(sql=None):
    return register(QUERIES, sql)


def so_far(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


W = "(PARTITION BY stream ORDER BY t, arrival)"
WU = "(PARTITION BY stream ORDER BY t, arrival ROWS UNBOUNDED PRECEDING)"


@q(f"WITH {P} SELECT arrival, CAST(t // 1000000 AS BIGINT) AS dts, CAST(t // 1000000 + arrival % 3 * 40 AS BIGINT) AS pts, kind = 'view' AND ra AS key FROM p")
def src2_flv(spark, d):
    """SRC-2: tags on a 1 ms clock; presentation is decoding plus the composition offset."""
    dts = F.expr("t div 1000000")
    return packets(spark, d).select("arrival", dts.alias("dts"), (dts + F.col("arrival") % 3 * 40).alias("pts"), ((F.col("kind") == "view") & F.col("ra")).alias("key"))


@q(f"WITH {P}, x AS (SELECT *, (t // 100000 * 9) % {CYCLE} AS raw FROM p), y AS (SELECT *, CASE WHEN lag(raw) OVER {W} - raw > {CYCLE // 2} THEN 1 ELSE 0 END AS wrap FROM x) SELECT arrival, raw, CAST(raw + {CYCLE} * sum(wrap) OVER {WU} AS BIGINT) AS unwrapped FROM y")
def src3_transport_clock(spark, d):
    """SRC-3: 33-bit timestamps at 90 kHz; a step back of over half a cycle is a wrap."""
    raw = F.expr(f"(t div 100000 * 9) % {CYCLE}L")
    r = packets(spark, d).withColumn("raw", raw)
    r = r.withColumn("wrap", F.when(F.lag("raw").over(by_time()) - F.col("raw") > CYCLE // 2, 1).otherwise(0))
    return r.select("arrival", "raw", (F.col("raw") + F.sum("wrap").over(so_far(by_time())) * CYCLE).alias("unwrapped"))


@q(f"WITH {P} SELECT stream, kind AS track, arrival, t AS pts, CAST(NULL AS BIGINT) AS dts, lead(t) OVER (PARTITION BY stream, kind ORDER BY arrival) IS NULL AS last FROM p WHERE kind IN ('view', 'click')")
def src4_tracks(spark, d):
    """SRC-4: per-track readers merged; presentation times only."""
    last = F.lead("t").over(Window.partitionBy("stream", "track").orderBy("arrival")).isNull()
    p = packets(spark, d).select("stream", F.col("kind").alias("track"), "arrival", F.col("t").alias("pts"), F.lit(None).cast("long").alias("dts"), "t")
    both = p.where("track = 'view'").unionByName(p.where("track = 'click'"))
    return both.select("stream", "track", "arrival", "pts", "dts", last.alias("last"))


@q(f"WITH {P}, x AS (SELECT *, bytes - coalesce(t - lag(t) OVER {W}, 0) // 5000000000 AS step FROM p), y AS (SELECT *, sum(step) OVER {WU} AS s FROM x), z AS (SELECT *, s - least(0, min(s) OVER {WU}) AS held FROM y) SELECT arrival, CAST(held AS BIGINT) AS held, held > 8000 AS over FROM z")
def src6_ingress(spark, d):
    """SRC-6: bytes waiting in a queue that drains a byte in 5 s; a Lindley recursion in closed form."""
    gap = F.coalesce(F.col("t") - F.lag("t").over(by_time()), F.lit(0).cast("long"))
    r = packets(spark, d).withColumn("gap", gap).withColumn("step", F.expr("bytes - gap div 5000000000")).withColumn("s", F.sum("step").over(so_far(by_time())))
    held = F.col("s") - F.least(F.lit(0), F.min("s").over(so_far(by_time())))
    return r.withColumn("held", held).select("arrival", "held", (F.col("held") > 8000).alias("over"))


@q(f"WITH {L} SELECT parent, idx, greatest(20 - start, 0) AS skip, least(60, start + dur) - greatest(20, start) AS take FROM l WHERE start < 60 AND start + dur > 20")
def fn12_range_clip(spark, d):
    """FN-12: bytes 20 to 59 of bodies that come in chunks."""
    end = F.col("start") + F.col("dur")
    r = tiles(spark, d).where((F.col("start") < 60) & (end > 20))
    return r.select("parent", "idx", F.greatest(20 - F.col("start"), F.lit(0)).alias("skip"), (F.least(F.lit(60), end) - F.greatest(F.lit(20), F.col("start"))).alias("take"))


@q(f"WITH {P} SELECT arrival, CASE kind WHEN 'view' THEN 'video' WHEN 'click' THEN 'audio' WHEN 'purchase' THEN 'subtitle' ELSE 'unknown_track' END AS handler, lead(t) OVER (PARTITION BY stream, kind ORDER BY t, arrival) IS NULL AS flushed FROM p")
def sup4_dispatch(spark, d):
    """SUP-4: packets by their track's handler; unknown tracks are errors; the end flushes each track's last row."""
    k = F.col("kind")
    handler = F.when(k == "view", "video").when(k == "click", "audio").when(k == "purchase", "subtitle").otherwise("unknown_track")
    last = F.lead("t").over(Window.partitionBy("stream", "kind").orderBy("t", "arrival")).isNull()
    return packets(spark, d).select("arrival", handler.alias("handler"), last.alias("flushed"))


@q(f"WITH {L}, m AS (SELECT *, min(CASE WHEN dur < 20 THEN idx END) OVER (PARTITION BY parent) AS e FROM l) SELECT parent, idx, CASE WHEN idx = e THEN 25 - dur ELSE 0 END AS trim, coalesce(idx > e, false) AS refused FROM m")
def sup5_terminal_trim(spark, d):
    """SUP-5: a unit shorter than its frame (25) by more than the tolerance (5) is the last: trimmed; later ones are refused."""
    e = F.min(F.when(F.col("dur") < 20, F.col("idx"))).over(Window.partitionBy("parent"))
    r = tiles(spark, d).withColumn("e", e)
    return r.select("parent", "idx", F.when(F.col("idx") == F.col("e"), 25 - F.col("dur")).otherwise(0).alias("trim"), F.coalesce(F.col("idx") > F.col("e"), F.lit(False)).alias("refused"))


@q(f"WITH {P}, b AS (SELECT stream, t // {24 * HOUR} AS batch, count(*) AS n, count(*) FILTER (kind = 'error') AS bad, CAST(sum(bytes) AS BIGINT) AS total FROM p GROUP BY 1, 2) SELECT stream, batch, CASE WHEN n > 7 THEN 'fill' WHEN bad > 2 THEN 'normalize' WHEN total > 25000 THEN 'density' END AS refused, CASE WHEN n > 7 OR bad > 2 OR total > 25000 THEN 0 ELSE n END AS metered FROM b")
def sup7_admission(spark, d):
    """SUP-7: batches (days) pass filling, normalizing and density in that order; only those that pass are metered."""
    b = packets(spark, d).groupBy("stream", F.expr(f"t div {24 * HOUR}").alias("batch")).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "error").alias("bad"), F.sum("bytes").alias("total"))
    r = b.withColumn("refused", first_failure(("fill", F.col("n") > 7), ("normalize", F.col("bad") > 2), ("density", F.col("total") > 25000)))
    return r.select("stream", "batch", "refused", F.when(F.col("refused").isNotNull(), 0).otherwise(F.col("n")).alias("metered"))


@q(f"WITH {S}, f AS (SELECT stream, publication, arg_min(arrival, seq) AS arrival, arg_min(ra, seq) AS ra FROM s GROUP BY 1, 2) SELECT stream, publication, arrival FROM f WHERE NOT ra")
def sup17_independent_start(spark, d):
    """SUP-17: publications refused because their first row depends on others."""
    first = samples(spark, d).groupBy("stream", "publication").agg(F.min_by(F.struct("arrival", "ra"), "seq").alias("f"))
    return first.where("not f.ra").select("stream", "publication", "f.arrival")


@q(f"WITH {L} SELECT parent, idx, start, dur, bytes FROM l JOIN orders ON o_orderkey = parent WHERE o_orderstatus = 'F' AND dur > 5")
def sup23_ready(spark, d):
    """SUP-23: metadata of completed segments that are no gaps."""
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("parent"))
    return tiles(spark, d).where("dur > 5").join(done, "parent").select("parent", "idx", "start", "dur", "bytes")


@q(f"WITH {P}, m AS (SELECT *, max(CASE WHEN kind = 'view' THEN t END) OVER (PARTITION BY stream) AS mark FROM p) SELECT stream, CAST(max(t) - max(mark) - sum(CASE WHEN t > mark THEN bytes * 1000 ELSE 0 END) AS BIGINT) AS idle FROM m GROUP BY 1")
def sup27_idle(spark, d):
    """SUP-27: time since the last mark without the waits since; null (never marked) is not zero."""
    mark = F.max(F.when(F.col("kind") == "view", F.col("t"))).over(Window.partitionBy("stream"))
    waits = F.sum(F.when(F.col("t") > F.col("mark"), F.col("bytes") * 1000).otherwise(0))
    return packets(spark, d).withColumn("mark", mark).groupBy("stream").agg((F.max("t") - F.max("mark") - waits).alias("idle"))


@q(f"WITH {P}, e AS (SELECT stream, t AS moment, 1 AS d FROM p UNION ALL SELECT stream, t + {8 * HOUR}, -1 FROM p), r AS (SELECT *, sum(d) OVER (PARTITION BY stream ORDER BY moment, d ROWS UNBOUNDED PRECEDING) AS held FROM e) SELECT stream, CAST(max(held) AS BIGINT) AS peak, count(*) FILTER (d = 1 AND held > 2) AS waits FROM r GROUP BY 1")
def sup28_slots(spark, d):
    """SUP-28: reservations of 8 hours held at once, and how many find both slots taken; ends come first."""
    p = packets(spark, d)
    e = p.select("stream", F.col("t").alias("moment"), F.lit(1).alias("d")).unionByName(p.select("stream", (F.col("t") + 8 * HOUR).alias("moment"), F.lit(-1).alias("d")))
    r = e.withColumn("held", F.sum("d").over(so_far(Window.partitionBy("stream").orderBy("moment", "d"))))
    return r.groupBy("stream").agg(F.max("held").alias("peak"), F.count_if((F.col("d") == 1) & (F.col("held") > 2)).alias("waits"))


PHASES = {"signup": 0, "click": 1, "view": 2, "purchase": 3, "error": 4}
RANK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in PHASES.items()) + " END"


@q(f"WITH {S}, r AS (SELECT *, max({RANK}) OVER (PARTITION BY stream, publication ORDER BY seq ROWS UNBOUNDED PRECEDING) AS phase FROM s) SELECT arrival, phase, phase < 2 AS unpublished FROM r")
def sup29_phase(spark, d):
    """SUP-29: phases only go forward; those before publication are told apart."""
    phase = F.max(F.expr(RANK)).over(so_far(Window.partitionBy("stream", "publication").orderBy("seq")))
    return samples(spark, d).withColumn("phase", phase).select("arrival", "phase", (F.col("phase") < 2).alias("unpublished"))


OUTCOMES = (("signup", "replaced", "finished"), ("click", "closed", "finished"), ("purchase", "drained", "finished"), ("error", "broken", "failed"))


@q(f"WITH {S}, z AS (SELECT stream, publication, arg_max(kind, seq) AS stop FROM s GROUP BY 1, 2) SELECT coalesce(outcome, 'running') AS outcome, coalesce(public, 'open') AS public, count(*) AS sessions FROM z LEFT JOIN (VALUES {', '.join(map(str, OUTCOMES))}) o(stop, outcome, public) USING (stop) GROUP BY 1, 2")
def sup30_outcomes(spark, d):
    """SUP-30: how sessions stopped, mapped to outcomes by a fixed list of four rows."""
    z = samples(spark, d).groupBy("stream", "publication").agg(F.max_by("kind", "seq").alias("stop"))
    known = spark.createDataFrame(OUTCOMES, "stop string, outcome string, public string")
    r = z.join(F.broadcast(known), "stop", "left").select(F.coalesce("outcome", F.lit("running")).alias("outcome"), F.coalesce("public", F.lit("open")).alias("public"))
    return r.groupBy("outcome", "public").agg(F.count("*").alias("sessions"))


HELD = f"CASE WHEN n.kind = 'error' THEN 0 WHEN n.kind = 'signup' OR f.held + n.bytes <= {LEDGER} THEN f.held + n.bytes ELSE f.held END"


@q(
    f"WITH RECURSIVE {P}, n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY arrival) AS i FROM p), f AS (SELECT DISTINCT stream, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS arrival, CAST(0 AS BIGINT) AS held, false AS refused FROM p "
    f"UNION ALL SELECT n.stream, n.i, n.arrival, {HELD}, n.kind NOT IN ('error', 'signup') AND f.held + n.bytes > {LEDGER} FROM f JOIN n ON n.stream = f.stream AND n.i = f.i + 1) SELECT stream, arrival, held, refused FROM f WHERE i > 0"
)
def sup32_ledger(spark, d):
    """SUP-32, LIM-1: commitments up to 20,000 bytes; larger are refused and hold nothing; sign-ups may exceed, errors release all."""
    rows = packets(spark, d).select("stream", "arrival", "kind", "bytes")
    return folds.fold(rows, "stream", ["arrival"], folds.ledger(LEDGER), "stream long, arrival long, held long, refused boolean")


@q(f"WITH {P}, w AS (SELECT a.stream, a.arrival, b.t - a.t AS delta FROM p a JOIN p b ON a.stream = b.stream AND a.kind = 'view' AND b.kind = 'click' AND abs(b.t - a.t) <= {24 * HOUR}), c AS (SELECT stream, delta, count(*) OVER (PARTITION BY stream ORDER BY delta RANGE BETWEEN {4 * HOUR} PRECEDING AND {4 * HOUR} FOLLOWING) AS n FROM w), t AS (SELECT stream, max(n) AS n FROM c GROUP BY 1), g AS (SELECT c.stream, c.n AS members, min(delta) AS low, max(delta) AS high FROM c JOIN t USING (stream, n) GROUP BY 1, 2) SELECT g.stream, members, low, high, CASE WHEN members >= 3 AND high - low <= {4 * HOUR} THEN median(delta) END AS consensus FROM g JOIN w ON g.stream = w.stream AND abs(delta - low) <= {4 * HOUR} GROUP BY 1, 2, 3, 4")
def sup33_offsets(spark, d):
    """SUP-33: offsets of clicks from views within a day; the median of the densest cluster within 4 hours; none if centres disagree."""
    from ..operators.joins import overlap_join

    p = packets(spark, d)
    a = p.where("kind = 'view'").select("stream", "t", (F.col("t") - 24 * HOUR).alias("lo"), (F.col("t") + 24 * HOUR + 1).alias("hi"))
    b = p.where("kind = 'click'").select("stream", F.col("t").alias("u"), (F.col("t") + 1).alias("u_end"))
    w = overlap_join(a, b, "stream", "lo", "hi", "u", "u_end", 48 * HOUR).select("stream", (F.col("u") - F.col("t")).alias("delta"))
    n = F.count("*").over(Window.partitionBy("stream").orderBy("delta").rangeBetween(-4 * HOUR, 4 * HOUR))
    g = w.withColumn("n", n).groupBy("stream", "n").agg(F.min("delta").alias("low"), F.max("delta").alias("high"))
    top = g.groupBy("stream").agg(F.max_by(F.struct("n", "low", "high"), "n").alias("x")).select("stream", "x.*")
    agreed = (F.col("n") >= 3) & (F.col("high") - F.col("low") <= 4 * HOUR)
    members = top.join(w, "stream").where(F.abs(F.col("delta") - F.col("low")) <= 4 * HOUR).groupBy("stream", "n", "low", "high").agg(F.median("delta").alias("m"))
    return members.select("stream", F.col("n").alias("members"), "low", "high", F.when(agreed, F.col("m")).alias("consensus"))


@q(f"WITH {P}, m AS (SELECT stream, kind, median(bytes) AS m FROM p GROUP BY 1, 2) SELECT a.stream, a.kind, a.m - b.m AS off, abs(b.m) < 8000 AND abs(a.m - b.m) <= 1500 AS ok FROM m a JOIN m b ON a.stream = b.stream AND b.kind = 'view' WHERE a.kind <> 'view'")
def sup34_baseline(spark, d):
    """SUP-34: medians against the baseline's, which must itself be small."""
    m = packets(spark, d).groupBy("stream", "kind").agg(F.median("bytes").alias("m"))
    base = m.where("kind = 'view'").select("stream", F.col("m").alias("b"))
    off = F.col("m") - F.col("b")
    return m.where("kind <> 'view'").join(base, "stream").select("stream", "kind", off.alias("off"), ((F.abs("b") < 8000) & (F.abs(off) <= 1500)).alias("ok"))


@q(f"WITH {P}, n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY t DESC, arrival DESC) AS back, least(count(*) OVER (PARTITION BY stream), 1024) AS n FROM p) SELECT stream, arg_min(bytes, back) - arg_max(bytes, back) AS growth FROM n WHERE back <= n - n // 2 GROUP BY 1")
def sup35_growth(spark, d):
    """SUP-35: last less first over the second half of the latest 1,024 samples."""
    back = F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("t"), F.desc("arrival")))
    n = F.least(F.count("*").over(Window.partitionBy("stream")), F.lit(1024))
    r = packets(spark, d).withColumn("back", back).withColumn("n", n).where("back <= n - n div 2")
    return r.groupBy("stream").agg((F.min_by("bytes", "back") - F.max_by("bytes", "back")).alias("growth"))


JUDGE = "CASE WHEN kind = 'error' AND bytes > 5000 THEN 'must_fix' WHEN kind = 'error' THEN 'expected' WHEN bytes > 9000 THEN 'warning' END"


@q(f"WITH {P}, j AS (SELECT stream, {JUDGE} AS class FROM p) SELECT stream, class, count(*) AS n, count(*) FILTER (class = 'must_fix') = 0 AS passes FROM j WHERE class IS NOT NULL GROUP BY 1, 2")
def sup37_findings(spark, d):
    """SUP-37: findings by the first rule that fits them; only one class fails a report."""
    k, b = F.col("kind"), F.col("bytes")
    cls = first_failure(("must_fix", (k == "error") & (b > 5000)), ("expected", k == "error"), ("warning", b > 9000))
    r = packets(spark, d).withColumn("class", cls).where("class is not null")
    return r.groupBy("stream", "class").agg(F.count("*").alias("n"), (F.count_if(F.col("class") == "must_fix") == 0).alias("passes"))


@q(f"WITH {S} SELECT stream, count(*) AS requests, count(*) FILTER (kind = 'error') AS errors, min(dur) FILTER (kind <> 'error') AS shortest FROM s GROUP BY 1")
def sup38_trace(spark, d):
    """SUP-38: requests, errors and the shortest window of each trace."""
    bad = F.col("kind") == "error"
    return samples(spark, d).groupBy("stream").agg(F.count("*").alias("requests"), F.count_if(bad).alias("errors"), F.min(F.when(~bad, F.col("dur"))).alias("shortest"))
