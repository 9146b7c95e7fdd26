"""Limits, snapshots, sweeps, plans and readers round the store."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.time import floor_div, target_seconds
from ..sources import store
from ..sources.packets import PacketSource
from .inputs import HOUR, L, P, S, by_time, packets, samples, table, tiles
from .registry import register
from .retention import KEPT, window_rows

QUERIES: dict = {}


def q(sql=None):
    return register(QUERIES, sql)


@q(f"WITH {P} SELECT stream, arrival, t AS pts, CAST(NULL AS BIGINT) AS dts, ra AS random_access, CAST(bytes AS INTEGER) AS bytes FROM p")
def src1_packets(spark, d):
    """SRC-1: packets written as lines and read back by the packet source, a partition a file; what a line lacks is null."""
    path = store.shared_folder(spark, "packets")
    packets(spark, d).select("stream", "arrival", F.col("t").alias("pts"), F.col("ra").alias("random_access"), "bytes").write.json(path)
    spark.dataSource.register(PacketSource)
    got = spark.read.format("packets").option("paths", ",".join(store.files(spark, path))).load()
    return got.select("stream", "arrival", "pts", "dts", "random_access", "bytes")


@q(f"WITH {P}, a AS (SELECT count(*) AS packets_total, CAST(sum(bytes) AS BIGINT) AS bytes_total, count(*) FILTER (ra) AS random_access_total, count(*) FILTER (kind = 'error') AS errors_total, max(bytes) AS largest_packet FROM p) UNPIVOT (SELECT * FROM a) ON COLUMNS(*) INTO NAME name VALUE value")
def agg2_process(spark, d):
    """AGG-2: the process's counters, a row each."""
    a = packets(spark, d).agg(
        F.count("*").alias("packets_total"), F.sum("bytes").alias("bytes_total"), F.count_if("ra").alias("random_access_total"), F.count_if(F.col("kind") == "error").alias("errors_total"), F.max("bytes").alias("largest_packet")
    )
    return a.unpivot([], a.columns, "name", "value")


@q(f"WITH {S}, r AS (SELECT stream, kind, max(greatest(1, (dur + 500000000) // 1000000000)) * 1000000000 AS target, max(dur) FILTER (ra) AS part FROM s GROUP BY 1, 2) SELECT stream, CAST(3 * max(target) AS BIGINT) AS hold_back, CAST(3 * max(part) + 1000 AS BIGINT) AS part_hold_back, CAST(6 * max(target) AS BIGINT) AS can_skip_until FROM r GROUP BY 1")
def agg15_server_control(spark, d):
    """AGG-15: a presentation's controls: three and six of its longest target, three of the longest part target of the
    renditions that have parts (no part hold-back without one), with a microsecond of margin at three."""
    r = samples(spark, d).groupBy("stream", "kind").agg((F.max(target_seconds("dur")) * 10**9).alias("target"), F.max(F.when(F.col("ra"), F.col("dur"))).alias("part"))
    return r.groupBy("stream").agg((3 * F.max("target")).alias("hold_back"), (3 * F.max("part") + 1000).alias("part_hold_back"), (6 * F.max("target")).alias("can_skip_until"))


@q(f"WITH {S}, m AS (SELECT max(t) AS now FROM p), g AS (SELECT stream, max(t) AS seen, sum(bytes) AS bytes, 3 * max(dur) AS requested FROM s GROUP BY 1) SELECT count(*) FILTER (now - seen <= {30 * HOUR}) AS published, count(*) FILTER (now - seen > {30 * HOUR}) AS idle, CAST(sum(bytes) AS BIGINT) AS retained_bytes, CAST(max(requested) AS BIGINT) AS retention_requested FROM g, m")
def agg23_snapshot(spark, d):
    """AGG-23: a node: streams published and idle (nothing for 30 hours), what they retain, and the longest retention asked."""
    now = F.broadcast(packets(spark, d).agg(F.max("t").alias("now")))  # one row
    g = samples(spark, d).groupBy("stream").agg(F.max("t").alias("seen"), F.sum("bytes").alias("bytes"), (3 * F.max("dur")).alias("requested")).join(now)
    idle = F.col("now") - F.col("seen") > 30 * HOUR
    return g.agg(F.count_if(~idle).alias("published"), F.count_if(idle).alias("idle"), F.sum("bytes").alias("retained_bytes"), F.max("requested").alias("retention_requested"))


@q(f"WITH {P} SELECT stream % 4 AS instance, t // {24 * HOUR} AS day, count(*) / 86400.0::DOUBLE AS rate FROM p WHERE kind = 'error' AND bytes % 3 <> 0 GROUP BY 1, 2")
def pq14_server_errors(spark, d):
    """PQ-14: instances with server errors on a day (the operator's own resource, every third, left out), and their rate."""
    e = packets(spark, d).where("kind = 'error' and bytes % 3 <> 0")
    return e.groupBy((F.col("stream") % 4).alias("instance"), floor_div("t", 24 * HOUR).alias("day")).agg((F.count("*") / 86400.0).alias("rate"))


@q(f"WITH {P} SELECT DISTINCT kind AS value FROM p WHERE bytes > 1000 AND kind <> ''")
def pq15_label_values(spark, d):
    """PQ-15: the values that a label has."""
    return packets(spark, d).where("bytes > 1000 and kind <> ''").select(F.col("kind").alias("value")).distinct()


@q(f"WITH {L}, c AS (SELECT *, (start + dur) // 5 * 5 AS cut FROM l) SELECT parent, idx, CASE WHEN NOT ra THEN greatest(start + dur, cut) WHEN start + dur > cut AND (start + dur - cut > 3 OR cut <= start) THEN NULL ELSE cut END AS stop, ra AND start + dur > cut AND (start + dur - cut > 3 OR cut <= start) AS error FROM c")
def sup10_close(spark, d):
    """SUP-10: open fragments closed at a cut (here multiples of 5): pictures may shrink by a tolerance of 3, but not to
    nothing; what ends before the cut is extended to it, and sound is never shortened."""
    end, start = F.col("start") + F.col("dur"), F.col("start")
    cut = floor_div(end, 5) * 5
    error = F.col("ra") & (end > cut) & ((end - cut > 3) | (cut <= start))
    return tiles(spark, d).select("parent", "idx", F.when(~F.col("ra"), F.greatest(end, cut)).when(~error, cut).alias("stop"), error.alias("error"))


@q(f"WITH {S}{KEPT}, a AS (SELECT stream, publication, min(t) AS anchor FROM s GROUP BY 1, 2), m AS (SELECT stream, max(publication) AS current FROM s GROUP BY 1) SELECT a.stream, a.publication, a.anchor FROM a JOIN m USING (stream) WHERE a.publication = m.current OR EXISTS (SELECT 1 FROM k WHERE k.stream = a.stream AND k.publication = a.publication AND (newer < 3 OR after < least))")
def sup22_anchors(spark, d):
    """SUP-22: anchors of the current publication and of those that a listed segment still refers to."""
    s = samples(spark, d)
    anchors = s.groupBy("stream", "publication").agg(F.min("t").alias("anchor"))
    current = s.groupBy("stream").agg(F.max("publication").alias("publication"))
    listed = window_rows(spark, d).where("newer < 3 or after < least").select("stream", "publication")
    return anchors.join(current.unionByName(listed).distinct(), ["stream", "publication"], "left_semi")


EXPOSED = "\nup 1\nx{a=\"1\"} 2\n# HELP up 3\ny 1e3\nz +Inf\nw 2 1700000000\n b 4\nc  5\nd\n{e} 1\nf nothing\n"


@q("SELECT conv_id, turn, l[1] AS name, CAST(l[2] AS DOUBLE) AS value FROM (SELECT conv_id, turn, string_split(line, ' ') AS l FROM (SELECT conv_id, turn, unnest(string_split(text || chr(10) || 'n' || turn || ' ' || conv_id || '.5' || '" + EXPOSED.replace("\n", "' || chr(10) || '") + "', chr(10))) AS line FROM conversations) WHERE regexp_full_match(line, '[A-Za-z_:][A-Za-z0-9_:]* ([-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?)'))")
def sup36_text_reader(spark, d):
    """SUP-36: unlabelled samples among lines of prose, comments, labelled, dated and broken ones."""
    body = F.concat("text", F.lit("\n"), F.lit("n"), F.col("turn").cast("string"), F.lit(" "), F.col("conv_id").cast("string"), F.lit(".5" + EXPOSED))
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split(body, "\n")).alias("line"))
    kept = lines.where(F.col("line").rlike(r"^[A-Za-z_:][A-Za-z0-9_:]* [-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"))
    l = F.split("line", " ")
    return kept.select("conv_id", "turn", l[0].alias("name"), l[1].cast("double").alias("value"))


@q("WITH x AS (SELECT p_partkey AS k, 0 AS layer, 'default' AS v FROM part UNION ALL SELECT p_partkey, 1, p_brand FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 2, upper(p_type) FROM part WHERE p_size % 5 < 2 UNION ALL SELECT l_partkey, 3, 'line ' || max(l_orderkey) FROM lineitem WHERE l_quantity > 45 GROUP BY 1) SELECT k AS p_partkey, arg_max(v, layer) FILTER (v <> '') AS value FROM x GROUP BY 1")
def fn17_layers(spark, d):
    """FN-17: settings from four layers: defaults, a file (brands), the environment (types) and the command line (lines of
    large quantity); the highest layer that sets one wins, an empty value sets nothing."""
    p = table(spark, d, "part")
    k, layer = F.col("p_partkey"), lambda n: F.lit(n).alias("layer")
    line = table(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_orderkey").alias("top"))
    x = p.select(k, layer(0), F.lit("default").alias("v")).unionAll(p.where("p_size % 3 = 0").select(k, layer(1), "p_brand")).unionAll(p.where("p_size % 5 < 2").select(k, layer(2), F.upper("p_type")))
    x = x.unionAll(line.select(k, layer(3), F.concat(F.lit("line "), F.col("top").cast("string"))))
    return x.where("v <> ''").groupBy("p_partkey").agg(F.max_by("v", "layer").alias("value"))


#: header lines with # for a number up to 299, and their address, port or error; * where the number must be at most 255
PROXY = (
    ("PROXY TCP4 10.0.0.# 10.0.0.1 5000 443", "*10.0.0.#", 5000, None), ("PROXY TCP4 10.0.0.# 10.0.0.1 65536 443", None, None, "malformed"), ("PROXY UNKNOWN anything # at all", "peer", None, None),
    ("PROXY UNKNOWN", "peer", None, None), ("PROXY TCP6 2001:db8::# ::1 443 1", "2001:db8::#", 443, None), ("PROXY TCP4 2001:db8::# ::1 443 1", None, None, "malformed"), ("GET /# HTTP/1.1", None, None, "malformed"),
    ("PROXY TCP4 10.0.0.#  10.0.0.1 5000 443", None, None, "malformed"), ("PROXY TCP4 10.0.0.# 10.0.0.1 5000", None, None, "malformed"), ("proxy TCP4 10.0.0.# 10.0.0.1 5000 443", None, None, "malformed"),
    ("PROXY UDP4 10.0.0.# 10.0.0.1 5000 443", None, None, "malformed"), ("PROXY TCP4 10.0.# 10.0.0.1 5000 443", None, None, "malformed"), ("PROXY TCP4 10.0.0.# ? 0 x", "*10.0.0.#", 0, None),
)


def _proxy_case(column: int) -> str:
    return "CASE k " + " ".join(f"WHEN {i} THEN {'NULL' if r[column] is None else repr(r[column])}" for i, r in enumerate(PROXY)) + " END"


@q(f"WITH x AS (SELECT doc_id, doc_id % {len(PROXY)} AS k, (doc_id * 7) % 300 AS n FROM documents), y AS (SELECT *, {_proxy_case(1)} AS a, {_proxy_case(2)} AS port, {_proxy_case(3)} AS e FROM x), z AS (SELECT *, a LIKE '*%' AND n > 255 AS bad FROM y) SELECT doc_id, CASE WHEN NOT coalesce(bad, false) THEN replace(ltrim(a, '*'), '#', CAST(n AS VARCHAR)) END AS address, CASE WHEN NOT coalesce(bad, false) THEN CAST(port AS INTEGER) END AS port, CASE WHEN bad THEN 'malformed' ELSE e END AS error FROM z")
def fn23_proxy(spark, d):
    """FN-23: text PROXY headers of both families; the rest of an unknown one is ignored, and what is not one is an error."""
    k = F.col("doc_id") % len(PROXY)
    h = F.lit(None).cast("string")
    for i, r in enumerate(PROXY):
        h = F.when(k == i, F.replace(F.lit(r[0]), F.lit("#"), (F.col("doc_id") * 7 % 300).cast("string"))).otherwise(h)
    return table(spark, d, "documents").select("doc_id", text.proxy_header(h).alias("x")).select("doc_id", "x.*")


@q(f"WITH {P}, r AS (SELECT stream, kind, t, arrival, bytes, count(*) OVER (PARTITION BY stream, kind) AS n, row_number() OVER (PARTITION BY stream, kind ORDER BY t, arrival) AS k FROM p), c AS (SELECT stream, kind, t FROM r WHERE k = 1 AND n > 3 AND bytes % 11 <> 0) SELECT stream, arg_min(kind, (t, kind)) AS rendition, min(t) AS published FROM c GROUP BY 1")
def sort6_shed(spark, d):
    """SORT-6: the rendition of each stream that sheds next: the one with the oldest segment, whatever their cadences, if
    three stay without it; one whose oldest is on its way to disk (every eleventh) has none."""
    g = packets(spark, d).groupBy("stream", "kind").agg(F.count("*").alias("n"), F.min(F.struct("t", "arrival", "bytes")).alias("oldest"))
    c = g.where("n > 3 and oldest.bytes % 11 <> 0").select("stream", F.struct(F.col("oldest.t").alias("t"), "kind").alias("c"))
    return c.groupBy("stream").agg(F.min("c").alias("c")).select("stream", F.col("c.kind").alias("rendition"), F.col("c.t").alias("published"))


@q(f"WITH {P}, m AS (SELECT max(t) AS now FROM p), e AS (SELECT stream, arrival, t, t + {48 * HOUR} + bytes % 400 * {HOUR} AS expires, now FROM p, m) SELECT arrival FROM (SELECT *, bool_or(expires > now) OVER (PARTITION BY stream ORDER BY t, arrival ROWS UNBOUNDED PRECEDING) AS stopped FROM e) WHERE NOT stopped")
def ret8_expiry(spark, d):
    """RET-8: what a sweep releases: retired rows in order, up to the first that has not expired, though later ones may have."""
    now = F.broadcast(packets(spark, d).agg(F.max("t").alias("now")))  # one row
    e = packets(spark, d).join(now).withColumn("alive", F.col("t") + 48 * HOUR + F.col("bytes") % 400 * HOUR > F.col("now"))
    stopped = F.bool_or("alive").over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    return e.withColumn("stopped", stopped).where("not stopped").select("arrival")


@q(f"WITH {S}, g AS (SELECT stream, min(t) AS opened, count(*) AS parts, count(DISTINCT publication) AS segments, sum(bytes) AS bytes FROM s GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY stream % 8 ORDER BY opened, stream) AS n FROM g) SELECT stream, CASE WHEN n > 12 THEN 'sessions' WHEN bytes > 400000 THEN 'memory' WHEN parts > 70 OR segments > 16 THEN 'objects' END AS refused FROM r")
def lim1_limits(spark, d):
    """LIM-1: which limit refuses a stream: the sessions of its node (12, in the order they open), bytes, or parts and
    segments."""
    g = samples(spark, d).groupBy("stream").agg(F.min("t").alias("opened"), F.count("*").alias("parts"), F.countDistinct("publication").alias("segments"), F.sum("bytes").alias("bytes"))
    n = F.row_number().over(Window.partitionBy(F.col("stream") % 8).orderBy("opened", "stream"))
    refused = F.when(F.col("n") > 12, "sessions").when(F.col("bytes") > 400_000, "memory").when((F.col("parts") > 70) | (F.col("segments") > 16), "objects")
    return g.withColumn("n", n).select("stream", refused.alias("refused"))


@q(f"WITH {P}, n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY arrival) AS i, count(*) OVER (PARTITION BY stream) AS total, min(t) OVER (PARTITION BY stream) + {96 * HOUR} AS target FROM p), f AS (SELECT * FROM n WHERE i <= 30), c AS (SELECT stream, any_value(target) AS target, max(t) AS seen, any_value(total) <= 30 AS ended, arg_min(t, (abs(t - target), t)) FILTER (ra) AS best FROM f GROUP BY 1) SELECT stream, CASE WHEN best IS NULL THEN CASE WHEN ended THEN 'none' ELSE 'wait' END WHEN ended OR seen >= target + abs(best - target) THEN 'planned' ELSE 'wait' END AS state, CASE WHEN best IS NOT NULL AND (ended OR seen >= target + abs(best - target)) THEN best - target END AS off FROM c")
def str10_boundary(spark, d):
    """STR-10: the first boundary, near 96 hours, from a pre-roll of 30 packets: the nearest random access, the earlier of
    two; it waits until as much is seen behind the target as the candidate lies before it, or the stream has ended."""
    own = Window.partitionBy("stream")
    n = packets(spark, d).withColumn("i", F.row_number().over(own.orderBy("arrival"))).withColumn("total", F.count("*").over(own)).withColumn("target", F.min("t").over(own) + 96 * HOUR)
    far = F.abs(F.col("t") - F.col("target"))
    c = n.where("i <= 30").groupBy("stream").agg(F.min("target").alias("target"), F.max("t").alias("seen"), (F.min("total") <= 30).alias("ended"), F.min(F.when(F.col("ra"), F.struct(far.alias("far"), "t"))).alias("best"))
    known = F.col("ended") | (F.col("seen") >= F.col("target") + F.col("best.far"))
    state = F.when(F.col("best").isNull(), F.when(F.col("ended"), "none").otherwise("wait")).when(known, "planned").otherwise("wait")
    return c.select("stream", state.alias("state"), F.when(F.col("best").isNotNull() & known, F.col("best.t") - F.col("target")).alias("off"))


@q("SELECT conv_id, turn, CASE WHEN NOT (contains(v, '\"') OR contains(v, chr(10)) OR contains(v, chr(13))) THEN '#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID=\"' || role || '\",NAME=\"' || v || '\",CHANNELS=\"' || (turn + 1) || '\"' || CASE WHEN turn % 2 = 0 THEN ',DEFAULT=YES' ELSE '' END END AS line FROM (SELECT *, CASE turn % 4 WHEN 1 THEN text || '\"' WHEN 2 THEN text || chr(13) ELSE text END AS v FROM conversations)")
def snk8_attributes(spark, d):
    """SNK-8: attribute lists: quoted values, optional ones left out; a value that cannot be quoted refuses the line."""
    k = F.col("turn") % 4
    value = F.when(k == 1, F.concat("text", F.lit('"'))).when(k == 2, F.concat("text", F.lit("\r"))).otherwise(F.col("text"))
    attributes = [("TYPE", F.lit("AUDIO"), False), ("GROUP-ID", F.col("role"), True), ("NAME", value, True), ("CHANNELS", (F.col("turn") + 1).cast("string"), True), ("DEFAULT", F.when(F.col("turn") % 2 == 0, "YES"), False)]
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("#EXT-X-MEDIA:"), text.attribute_list(attributes)).alias("line"))


#: frame rates as (num, den); none for the last
RATES = ((24000, 1001), (25, 1), (30000, 1001), (30, 1), (0, 0))
TRACKS = "x AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' ELSE 'subtitle' END AS kind, p_partkey * 10 AS origin, CASE WHEN p_size % 2 = 0 THEN 90 ELSE 1 END AS quantum, [24000, 25, 30000, 30, 0][p_partkey % 5 + 1] AS rn, [1001, 1, 1001, 1, 0][p_partkey % 5 + 1] AS rd, p_partkey % 200 + 20 AS n, (p_size % 5 - 2) * 60 AS off FROM part)"


@q(f"WITH {TRACKS}, y AS (SELECT *, rd::BIGINT * 90000 AS num, rn::BIGINT AS den FROM x), z AS (SELECT *, CASE kind WHEN 'audio' THEN 288000 WHEN 'subtitle' THEN 540000 ELSE CASE WHEN den > 0 THEN (n * num + den // 2) // den ELSE n * 3000 END + off END AS seg FROM y), w AS (SELECT *, CASE WHEN kind = 'video' AND den > 0 THEN (seg * den + num // 2) // num END AS frames FROM z), v AS (SELECT *, coalesce(frames > 0 AND abs(frames * num - seg * den) <= den * quantum AND frames * num <> seg * den, false) AS fractional FROM w) SELECT p_partkey, kind, CAST(origin + CASE WHEN kind = 'audio' THEN seg // 1024 * 1024 ELSE seg END AS BIGINT) AS first_boundary, CAST(seg AS BIGINT) AS segment, CASE WHEN fractional THEN CAST(frames * num AS BIGINT) END AS period_num, CASE WHEN fractional THEN den END AS period_den, CAST(least(CASE WHEN kind = 'audio' THEN 48000 ELSE 90000 END, seg) AS BIGINT) AS part, CAST(CASE WHEN kind = 'audio' THEN 1024 WHEN kind = 'video' AND (quantum > 1 OR fractional OR coalesce(num % nullif(den, 0) <> 0, false)) THEN quantum ELSE 0 END AS BIGINT) AS tolerance FROM v")
def sup15_track_plan(spark, d):
    """SUP-15: segmentation plans of tracks made from parts. Video cuts at its observed boundary (whole frames, some off by
    60 or 120 ticks), audio at the unit of 1,024 that covers 6 seconds, and keeps that cadence, subtitles every 6 seconds.
    A period in whole frames is kept as a fraction if it is within the clock's quantum of what was observed but not equal;
    parts are of a second; the tolerance is a unit for audio, and for video a quantum where its timing is not integral."""
    c = F.col
    kind = F.when(c("p_size") % 3 == 0, "video").when(c("p_size") % 3 == 1, "audio").otherwise("subtitle")
    rate = lambda i: F.element_at(F.array(*[F.lit(r[i]).cast("long") for r in RATES]), (c("p_partkey") % 5 + 1).cast("int"))
    x = table(spark, d, "part").select("p_partkey", kind.alias("kind"), (rate(1) * 90_000).alias("num"), rate(0).alias("den"), F.when(c("p_size") % 2 == 0, 90).otherwise(1).cast("long").alias("quantum"), (c("p_partkey") % 200 + 20).alias("n"), ((c("p_size") % 5 - 2) * 60).cast("long").alias("off"))
    whole = lambda a, b: F.call_function("div", a, F.nullif(b, F.lit(0).cast("long")))  # noqa: E731  of positive longs
    video = F.coalesce(whole(c("n") * c("num") + whole(c("den"), F.lit(2).cast("long")), c("den")), c("n") * 3000) + c("off")
    x = x.withColumn("seg", F.when(c("kind") == "audio", 288_000).when(c("kind") == "subtitle", 540_000).otherwise(video))
    x = x.withColumn("frames", F.when(c("kind") == "video", whole(c("seg") * c("den") + whole(c("num"), F.lit(2).cast("long")), F.when(c("den") > 0, c("num")))))
    apart = F.abs(c("frames") * c("num") - c("seg") * c("den"))
    x = x.withColumn("fractional", F.coalesce((c("frames") > 0) & (apart <= c("den") * c("quantum")) & (apart > 0), F.lit(False)))
    uneven = F.coalesce(c("num") % F.nullif(c("den"), F.lit(0).cast("long")) != 0, F.lit(False))
    tolerance = F.when(c("kind") == "audio", 1024).when((c("kind") == "video") & ((c("quantum") > 1) | c("fractional") | uneven), c("quantum")).otherwise(0)
    return x.select(
        "p_partkey", "kind", (c("p_partkey") * 10 + F.when(c("kind") == "audio", floor_div("seg", 1024) * 1024).otherwise(c("seg"))).alias("first_boundary"), c("seg").alias("segment"),
        F.when(c("fractional"), c("frames") * c("num")).alias("period_num"), F.when(c("fractional"), c("den")).alias("period_den"),
        F.least(F.when(c("kind") == "audio", 48_000).otherwise(90_000).cast("long"), "seg").alias("part"), tolerance.cast("long").alias("tolerance"),
    )
