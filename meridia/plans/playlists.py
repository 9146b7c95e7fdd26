"""Playlist projections: lines with sort keys, joined in order.

Four samples of a stream are a segment, they are its parts; a last segment of fewer is open.
The playlists list the six newest whole segments, so a stream's lines are bounded by that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import decimal_seconds, floor_div, program_date, target_seconds
from ..sources import store
from .inputs import HOUR, P, S, by_time, packets, samples, table
from .registry import register
from .retention import KEPT, window_rows

QUERIES: dict = {}


def q(sql=None):
    return register(QUERIES, sql)


LISTED, PARTS, SKIP = 6, 4, 60 * HOUR


def _join(*lines) -> Column:
    """Lines that are not null, each with its line feed."""
    return F.concat(*[F.coalesce(F.concat(x, F.lit("\n")), F.lit("")) if isinstance(x, Column) else F.lit(x + "\n") for x in lines])


def _text(*parts) -> Column:
    return F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in parts])


def listed_segments(spark, d) -> DataFrame:
    """The listed segments of each stream and its open one, with what playlists say of them."""
    c = F.col
    part = F.struct("seq", "dur", "ra", (c("kind") == "error").alias("gap"), "bytes", "t")
    g = samples(spark, d).groupBy("stream", floor_div(c("seq") - 1, PARTS).alias("msn")).agg(
        F.min("t").alias("start"), F.sum("dur").alias("dur"), F.min_by("publication", "seq").alias("publication"),
        F.bool_and(c("kind") == "error").alias("gap"), F.array_sort(F.collect_list(part)).alias("parts"),
    )
    g = g.withColumn("whole", F.size("parts") == PARTS)
    by_msn, newest = Window.partitionBy("stream").orderBy("msn"), Window.partitionBy("stream").orderBy(c("msn").desc())
    before = F.lag("publication").over(by_msn)
    earlier = by_msn.rowsBetween(Window.unboundedPreceding, -1)
    frames = F.greatest(F.lit(1), F.size(F.filter("parts", lambda x: x["ra"])))
    g = g.withColumn("cut", F.coalesce(before != c("publication"), F.lit(False))).withColumn("frames", frames.cast("long"))
    g = g.withColumn("cuts_before", F.coalesce(F.sum(c("cut").cast("long")).over(earlier), F.lit(0))).withColumn("frames_before", F.coalesce(F.sum("frames").over(earlier), F.lit(0)))
    # the newest segment may be open: it counts for none of the listed ones
    age = F.sum(c("whole").cast("long")).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    g = g.withColumn("age", age).withColumn("live", F.first(c("start") + c("dur")).over(newest)).where(c("age") <= LISTED)
    # from here on a stream has seven rows at most
    all_of, whole = Window.partitionBy("stream"), c("whole")
    g = g.withColumn("target", F.max(F.when(whole, target_seconds("dur"))).over(all_of)).withColumn("part_target", F.max(F.aggregate("parts", F.lit(0).cast("long"), lambda x, y: F.greatest(x, y["dur"]))).over(all_of))
    g = g.where("target is not null").withColumn("head", F.lag("msn").over(by_msn).isNull())
    end = c("start") + c("dur")
    # a delta playlist, for streams of even numbers, leaves out what lies far behind, but never the last
    g = g.withColumn("skipped", (c("stream") % 2 == 0) & whole & (c("age") > 1) & (c("live") - end > SKIP))
    first = F.coalesce(F.lag("skipped").over(by_msn), F.lit(True))
    return g.withColumn("map", first | c("cut")).withColumn("recent", c("live") - end <= 3 * c("target") * 10**9)


def _edges(spark, d) -> DataFrame:
    """Of each stream its newest segment and part, and whether it has ended (its last packet is an error)."""
    last = packets(spark, d).groupBy("stream").agg(F.max_by("kind", F.struct("t", "arrival")).alias("kind"), F.count("*").alias("n"))
    return last.select("stream", (F.col("kind") == "error").alias("ended"), (F.col("n") - 1).alias("parts")).where("parts > 0")


def _parent(c) -> list[Column]:
    cut = F.when(c("cut"), "#EXT-X-DISCONTINUITY")
    header = F.when(c("map"), _text('#EXT-X-MAP:URI="', c("stream"), "/init", c("publication"), '.mp4"'))
    return [cut, header, F.when(c("head") | c("cut"), _text("#EXT-X-PROGRAM-DATE-TIME:", program_date(c("start"))))]


#: the same in SQL: segments g, listed ones k
G = f"""g0 AS (SELECT stream, (seq - 1) // {PARTS} AS msn, CAST(min(t) AS BIGINT) AS start, CAST(sum(dur) AS BIGINT) AS dur, arg_min(publication, seq) AS publication, bool_and(kind = 'error') AS gap, count(*) = {PARTS} AS whole, max(dur) AS longest, greatest(1, count(*) FILTER (ra)) AS frames FROM s GROUP BY 1, 2),
 g1 AS (SELECT *, coalesce(lag(publication) OVER (PARTITION BY stream ORDER BY msn) <> publication, false) AS cut, sum(whole::INT) OVER (PARTITION BY stream ORDER BY msn DESC) AS age, max(start + dur) OVER (PARTITION BY stream) AS live, coalesce(sum(frames) OVER (PARTITION BY stream ORDER BY msn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS frames_before FROM g0),
 g2 AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY stream ORDER BY msn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cuts_before FROM g1),
 g3 AS (SELECT *, max(CASE WHEN whole THEN greatest(1, (dur + 500000000) // 1000000000) END) OVER (PARTITION BY stream) AS target, max(longest) OVER (PARTITION BY stream) AS part_target, row_number() OVER (PARTITION BY stream ORDER BY msn) = 1 AS head FROM g2 WHERE age <= {LISTED}),
 g4 AS (SELECT *, stream % 2 = 0 AND whole AND age > 1 AND live - start - dur > {SKIP} AS skipped FROM g3 WHERE target IS NOT NULL),
 k AS (SELECT *, cut OR coalesce(lag(skipped) OVER (PARTITION BY stream ORDER BY msn), true) AS map, live - start - dur <= 3000000000 * target AS recent FROM g4),
 e AS (SELECT stream, arg_max(kind, (t, arrival)) = 'error' AS ended, count(*) - 1 AS parts FROM p GROUP BY 1 HAVING count(*) > 1)"""


def seconds(x: str) -> str:
    return f"CASE WHEN ({x}) % 1000000000 = 0 THEN CAST(({x}) // 1000000000 AS VARCHAR) ELSE (({x}) // 1000000000) || '.' || rtrim(lpad(CAST(({x}) % 1000000000 AS VARCHAR), 9, '0'), '0') END"


PARENT = "CASE WHEN cut THEN '#EXT-X-DISCONTINUITY' || chr(10) ELSE '' END || CASE WHEN map THEN '#EXT-X-MAP:URI=\"' || k.stream || '/init' || publication || '.mp4\"' || chr(10) ELSE '' END || CASE WHEN head OR cut THEN '#EXT-X-PROGRAM-DATE-TIME:' || strftime(make_timestamp(start // 1000), '%Y-%m-%dT%H:%M:%S.%gZ') || chr(10) ELSE '' END"


PLAYLISTS = f"""WITH {S}, {G},
 t AS (SELECT stream, (seq - 1) // {PARTS} AS msn, string_agg('#EXT-X-PART:DURATION=' || {seconds('dur')} || ',URI="' || stream || '/' || (seq - 1) // {PARTS} || '.' || (seq - 1) % {PARTS} || '.m4s"' || CASE WHEN ra THEN ',INDEPENDENT=YES' ELSE '' END || CASE WHEN kind = 'error' THEN ',GAP=YES' ELSE '' END || chr(10), '' ORDER BY seq) AS parts FROM s GROUP BY 1, 2),
 b AS (SELECT k.stream, string_agg(CASE WHEN skipped THEN '' ELSE {PARENT} || CASE WHEN recent OR NOT whole THEN t.parts ELSE '' END || CASE WHEN whole THEN CASE WHEN gap THEN '#EXT-X-GAP' || chr(10) ELSE '' END || '#EXTINF:' || {seconds('dur')} || ',' || chr(10) || k.stream || '/' || k.msn || '.m4s' || chr(10) ELSE '' END END, '' ORDER BY k.msn) AS body,
  min(k.msn) AS first, min(cuts_before) AS cuts, any_value(target) AS target, any_value(part_target) AS part_target, sum(skipped::INT) AS skipped FROM k JOIN t ON t.stream = k.stream AND t.msn = k.msn GROUP BY 1)
 SELECT b.stream, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:9' || chr(10) || '#EXT-X-TARGETDURATION:' || target || chr(10) || '#EXT-X-SERVER-CONTROL:CAN-BLOCK-RELOAD=YES,CAN-SKIP-UNTIL=' || {seconds(str(SKIP))} || ',PART-HOLD-BACK=' || {seconds('3 * part_target')} || chr(10) || '#EXT-X-PART-INF:PART-TARGET=' || {seconds('part_target')} || chr(10)
  || '#EXT-X-MEDIA-SEQUENCE:' || first || chr(10) || CASE WHEN cuts > 0 THEN '#EXT-X-DISCONTINUITY-SEQUENCE:' || cuts || chr(10) ELSE '' END || CASE WHEN skipped > 0 THEN '#EXT-X-SKIP:SKIPPED-SEGMENTS=' || skipped || chr(10) ELSE '' END || body
  || CASE WHEN NOT e.ended THEN '#EXT-X-PRELOAD-HINT:TYPE=PART,URI="' || b.stream || '/' || e.parts // {PARTS} || '.' || e.parts % {PARTS} || '.m4s"' || chr(10) ELSE '' END
  || CASE WHEN o.stream IS NOT NULL THEN '#EXT-X-RENDITION-REPORT:URI="../' || o.stream || '/media.m3u8",LAST-MSN=' || (o.parts - 1) // {PARTS} || ',LAST-PART=' || (o.parts - 1) % {PARTS} || chr(10) ELSE '' END || CASE WHEN e.ended THEN '#EXT-X-ENDLIST' || chr(10) ELSE '' END AS playlist
 FROM b JOIN e ON e.stream = b.stream LEFT JOIN e o ON o.stream = b.stream + 1"""


@q(PLAYLISTS)
def pl1_media_playlist(spark, d):
    """PL-1, SNK-8: the media playlist of each stream: header and controls, what a delta skips, discontinuities, headers
    and dates where they change, parts near the live edge, segments and gaps, the open segment, a hint of the next part,
    a report of the next stream, and the end. The lines of one playlist are bounded by its window."""
    c = F.col
    name = lambda x: _text(c("stream"), "/", c("msn"), ".", (x["seq"] - 1) % PARTS, ".m4s")
    part = lambda x: _join(F.concat(F.lit("#EXT-X-PART:DURATION="), decimal_seconds(x["dur"]), F.lit(',URI="'), name(x), F.lit('"'), F.when(x["ra"], ",INDEPENDENT=YES").otherwise(""), F.when(x["gap"], ",GAP=YES").otherwise("")))
    parts = F.when(c("recent") | ~c("whole"), F.array_join(F.transform("parts", part), "")).otherwise("")
    segment = F.when(c("whole"), _join(F.when(c("gap"), "#EXT-X-GAP"), F.concat(F.lit("#EXTINF:"), decimal_seconds("dur"), F.lit(",")), _text(c("stream"), "/", c("msn"), ".m4s"))).otherwise("")
    k = listed_segments(spark, d)
    body = F.when(c("skipped"), "").otherwise(F.concat(_join(*_parent(c)), parts, segment))
    b = k.groupBy("stream").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msn", body.alias("body")))), lambda x: x["body"]), "").alias("body"), F.min("msn").alias("first"),
        F.min("cuts_before").alias("cuts"), F.max("target").alias("target"), F.max("part_target").alias("part_target"), F.count_if("skipped").alias("skipped"),
    )
    edges = _edges(spark, d)
    other = edges.select((c("stream") - 1).alias("stream"), (c("parts") - 1).alias("last"))
    r = b.join(edges, "stream").join(other, "stream", "left")
    head = _join(
        "#EXTM3U", "#EXT-X-VERSION:9", _text("#EXT-X-TARGETDURATION:", c("target")),
        _text("#EXT-X-SERVER-CONTROL:CAN-BLOCK-RELOAD=YES,CAN-SKIP-UNTIL=", decimal_seconds(F.lit(SKIP)), ",PART-HOLD-BACK=", decimal_seconds(3 * c("part_target"))),
        _text("#EXT-X-PART-INF:PART-TARGET=", decimal_seconds("part_target")), _text("#EXT-X-MEDIA-SEQUENCE:", c("first")),
        F.when(c("cuts") > 0, _text("#EXT-X-DISCONTINUITY-SEQUENCE:", c("cuts"))), F.when(c("skipped") > 0, _text("#EXT-X-SKIP:SKIPPED-SEGMENTS=", c("skipped"))),
    )
    place = lambda n: (floor_div(n, PARTS), F.pmod(n, F.lit(PARTS)))
    (msn, index), (last_msn, last_part) = place(c("parts")), place(c("last"))
    tail = _join(
        F.when(~c("ended"), _text('#EXT-X-PRELOAD-HINT:TYPE=PART,URI="', c("stream"), "/", msn, ".", index, '.m4s"')),
        F.when(c("last").isNotNull(), _text('#EXT-X-RENDITION-REPORT:URI="../', c("stream") + 1, '/media.m3u8",LAST-MSN=', last_msn, ",LAST-PART=", last_part)), F.when(c("ended"), "#EXT-X-ENDLIST"),
    )
    return r.select("stream", F.concat(head, "body", tail).alias("playlist"))


@q(f"""WITH {S}, {G},
 f AS (SELECT *, (seq - 1) // {PARTS} AS msn, CAST(coalesce(sum(bytes) OVER (PARTITION BY stream, (seq - 1) // {PARTS} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM s),
 r AS (SELECT f.stream, f.msn, f.seq, f.place, f.bytes, coalesce(lead(f.t) OVER (PARTITION BY f.stream, f.msn ORDER BY f.seq), k.start + k.dur) - f.t AS span FROM f JOIN k ON k.stream = f.stream AND k.msn = f.msn WHERE f.ra),
 x AS (SELECT stream, msn, string_agg('#EXT-X-BYTERANGE:' || bytes || '@' || place || chr(10) || '#EXTINF:' || {seconds('span')} || ',' || chr(10) || stream || '/' || msn || '.m4s' || chr(10), '' ORDER BY seq) AS frames FROM r GROUP BY 1, 2),
 b AS (SELECT k.stream, string_agg(CASE WHEN skipped THEN '' ELSE {PARENT} || coalesce(x.frames, '#EXT-X-GAP' || chr(10) || '#EXTINF:' || {seconds('dur')} || ',' || chr(10) || k.stream || '/' || k.msn || '.m4s' || chr(10)) END, '' ORDER BY k.msn) AS body, min(frames_before) AS first, min(cuts_before) AS cuts, any_value(target) AS target, sum(CASE WHEN skipped THEN k.frames ELSE 0 END) AS skipped FROM k LEFT JOIN x ON x.stream = k.stream AND x.msn = k.msn WHERE whole GROUP BY 1)
 SELECT b.stream, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:9' || chr(10) || '#EXT-X-TARGETDURATION:' || target || chr(10) || '#EXT-X-I-FRAMES-ONLY' || chr(10) || '#EXT-X-MEDIA-SEQUENCE:' || first || chr(10) || CASE WHEN cuts > 0 THEN '#EXT-X-DISCONTINUITY-SEQUENCE:' || cuts || chr(10) ELSE '' END || CASE WHEN skipped > 0 THEN '#EXT-X-SKIP:SKIPPED-SEGMENTS=' || skipped || chr(10) ELSE '' END || body || CASE WHEN e.ended THEN '#EXT-X-ENDLIST' || chr(10) ELSE '' END AS playlist FROM b JOIN e ON e.stream = b.stream""")
def pl2_iframe_playlist(spark, d):
    """PL-2: the I-frame playlist of each stream: of whole listed segments every random access as a byte range that lasts
    until the next one or the segment's end; a segment without any is a gap. Numbers count these entries."""
    c = F.col
    keys = F.filter(F.transform("parts", lambda x, i: F.struct(x["ra"].alias("ra"), x["t"].alias("t"), x["bytes"].alias("bytes"), F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0).cast("long"), lambda n, y: n + y["bytes"]).alias("place"))), lambda x: x["ra"])
    k = listed_segments(spark, d).where("whole").withColumn("keys", keys)
    uri = _text(c("stream"), "/", c("msn"), ".m4s")
    until = lambda i: F.coalesce(F.get(F.col("keys"), i + 1)["t"], c("start") + c("dur"))
    frame = lambda x, i: _join(_text("#EXT-X-BYTERANGE:", x["bytes"], "@", x["place"]), F.concat(F.lit("#EXTINF:"), decimal_seconds(until(i) - x["t"]), F.lit(",")), uri)
    entries = F.when(F.size("keys") == 0, _join("#EXT-X-GAP", F.concat(F.lit("#EXTINF:"), decimal_seconds("dur"), F.lit(",")), uri)).otherwise(F.array_join(F.transform("keys", frame), ""))
    body = F.when(c("skipped"), "").otherwise(F.concat(_join(*_parent(c)), entries))
    b = k.groupBy("stream").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msn", body.alias("body")))), lambda x: x["body"]), "").alias("body"), F.min("frames_before").alias("first"),
        F.min("cuts_before").alias("cuts"), F.max("target").alias("target"), F.sum(F.when(c("skipped"), c("frames")).otherwise(0)).alias("skipped"),
    )
    head = _join(
        "#EXTM3U", "#EXT-X-VERSION:9", _text("#EXT-X-TARGETDURATION:", c("target")), "#EXT-X-I-FRAMES-ONLY", _text("#EXT-X-MEDIA-SEQUENCE:", c("first")),
        F.when(c("cuts") > 0, _text("#EXT-X-DISCONTINUITY-SEQUENCE:", c("cuts"))), F.when(c("skipped") > 0, _text("#EXT-X-SKIP:SKIPPED-SEGMENTS=", c("skipped"))),
    )
    return b.join(_edges(spark, d), "stream").select("stream", F.concat(head, "body", _join(F.when(c("ended"), "#EXT-X-ENDLIST"))).alias("playlist"))


@q(f"WITH {S}{KEPT} SELECT stream, count(*) AS skipped FROM k WHERE (newer < 3 OR after < least) AND after > {60 * HOUR} AND newer > 0 GROUP BY 1")
def pl3_delta(spark, d):
    """PL-3: segments further than 60 hours before the last one's end are skipped; the last never."""
    return window_rows(spark, d).where("newer < 3 or after < least").where((F.col("after") > 60 * HOUR) & (F.col("newer") > 0)).groupBy("stream").agg(F.count("*").alias("skipped"))


@q(f"WITH {S}, x AS (SELECT *, lag(publication) OVER (PARTITION BY stream ORDER BY t, arrival) AS before FROM s) SELECT arrival, strftime(make_timestamp(t // 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS pdt FROM x WHERE before IS DISTINCT FROM publication")
def pl5_program_date(spark, d):
    """PL-5: program dates of first segments and after each discontinuity, in milliseconds."""
    x = samples(spark, d).withColumn("before", F.lag("publication").over(by_time())).where("not (before <=> publication)")
    return x.select("arrival", program_date("t").alias("pdt"))


@q("WITH l AS (SELECT l_orderkey AS k, bool_or(l_returnflag = 'R') AS chunked, count(*) FILTER (l_quantity > 40) AS services, bool_or(l_discount < 0.03) AS video FROM lineitem GROUP BY 1) SELECT o_orderkey, greatest(CASE WHEN chunked THEN 9 ELSE 6 END, CASE left(o_orderpriority, 1) WHEN '1' THEN 9 WHEN '2' THEN 10 ELSE 0 END, CASE WHEN o_orderstatus = 'F' THEN 11 ELSE 0 END) AS version, CASE WHEN services > 0 THEN 'cc' WHEN video THEN 'NONE' END AS captions FROM orders LEFT JOIN l ON k = o_orderkey")
def pl6_version(spark, d):
    """PL-6, PL-11: the version that a playlist needs: 6 for headers, 9 for parts (orders with a returned line) and skips
    (urgent ones), 10 for skips of date ranges (high ones), 11 for query variables (filled ones); and its caption
    reference: the group if there are services, NONE for video without, else nothing."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("chunked"), F.count_if(F.col("l_quantity") > 40).alias("services"), F.bool_or(F.col("l_discount") < 0.03).alias("video"))
    first = F.substring("o_orderpriority", 1, 1)
    delta = F.when(first == "1", 9).when(first == "2", 10).otherwise(0)
    version = F.greatest(F.when(F.col("chunked"), 9).otherwise(6), delta, F.when(F.col("o_orderstatus") == "F", 11).otherwise(0))
    return table(spark, d, "orders").join(l, "o_orderkey", "left").select("o_orderkey", version.alias("version"), F.when(F.col("services") > 0, "cc").when(F.col("video"), "NONE").alias("captions"))


@q(f"WITH {P}, g AS (SELECT stream, kind, max(bytes) AS top FROM p GROUP BY 1, 2) SELECT stream, string_agg('#EXT-X-STREAM-INF:BANDWIDTH=' || top || ',CODECS=\"' || kind || '\"' || chr(10) || stream || '/' || kind || '.m3u8', chr(10) ORDER BY top, kind) AS playlist FROM g GROUP BY 1")
def pl7_multivariant(spark, d):
    """PL-7: variants by bandwidth."""
    g = packets(spark, d).groupBy("stream", "kind").agg(F.max("bytes").alias("top"))
    line = F.concat(F.lit("#EXT-X-STREAM-INF:BANDWIDTH="), F.col("top").cast("string"), F.lit(',CODECS="'), "kind", F.lit('"\n'), F.col("stream").cast("string"), F.lit("/"), "kind", F.lit(".m3u8"))
    lines = F.array_sort(F.collect_list(F.struct("top", "kind", line.alias("line"))))  # one entry a rendition
    return g.groupBy("stream").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("playlist"))


@q("SELECT c_custkey, c_nationkey AS grp, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal > 9000 DESC, c_custkey) = 1 AS is_default FROM customer")
def pl8_defaults(spark, d):
    """PL-8: one default a group: a marked one, else the first."""
    w = Window.partitionBy("c_nationkey").orderBy((F.col("c_acctbal") > 9000).desc(), "c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("grp"), (F.row_number().over(w) == 1).alias("is_default"))


@q(f"WITH {S}, {G}, m AS (SELECT stream, max(msn) FILTER (whole) AS top, CAST(sum(dur) FILTER (whole AND NOT skipped) AS DECIMAL(38, 0)) AS total, count(*) FILTER (whole AND NOT skipped) AS children, sum(skipped::INT) AS skipped FROM k GROUP BY 1) SELECT m.stream, m.stream || '/' || top || '.m4s' AS newest, CAST(total AS DOUBLE) / 1000000000 AS seconds, children, CAST(skipped AS BIGINT) AS skipped, e.ended FROM m JOIN e ON e.stream = m.stream")
def src12_playlist_reader(spark, d):
    """SRC-12: playlists read back: newest media, listed time, children, what was skipped, and whether they end."""
    lines = F.split("playlist", "\n")
    r = pl1_media_playlist(spark, d).withColumn("lines", lines)
    media = F.filter("lines", lambda x: (x != "") & ~x.startswith("#"))
    times = F.transform(F.filter("lines", lambda x: x.startswith("#EXTINF:")), lambda x: F.regexp_extract(x, "^#EXTINF:([0-9.]+),", 1).cast("decimal(28,9)"))
    total = F.aggregate(times, F.lit(0).cast("decimal(38,9)"), lambda a, x: (a + x).cast("decimal(38,9)"))
    skipped = F.coalesce(F.nullif(F.regexp_extract("playlist", "SKIPPED-SEGMENTS=([0-9]+)", 1), F.lit("")).cast("long"), F.lit(0))
    return r.select("stream", F.element_at(media, -1).alias("newest"), total.cast("double").alias("seconds"), F.size(media).cast("long").alias("children"), skipped.alias("skipped"), F.array_contains("lines", "#EXT-X-ENDLIST").alias("ended"))


@q(f"SELECT stream, CAST(octet_length(encode(playlist)) AS BIGINT) AS bytes, md5(playlist) AS digest FROM ({PLAYLISTS})")
def fn22_gzip(spark, d):
    """FN-22: playlists written compressed and read back: the sink compresses, a file for each task."""
    path = store.shared_folder(spark, "playlists")
    pl1_media_playlist(spark, d).write.option("compression", "gzip").json(path)
    back = spark.read.schema("stream long, playlist string").json(path)
    return back.select("stream", F.octet_length("playlist").cast("long").alias("bytes"), F.md5("playlist").alias("digest"))
