"""Delivery: stored batches, tiers, sweeps, validators, signatures, logs and caption packets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import http
from ..operators import captions, folds
from ..sources import store
from .inputs import HOUR, L, P, by_time, packets, table, tiles
from .registry import register

QUERIES: dict = {}
#: signs the rows of fn21_signature; an example, no secret
KEY = bytes([0x0B]) * 32


def q(sql=None):
    return register(QUERIES, sql)


@q(f"WITH {P} SELECT kind, arrival % 2 AS batch, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM p GROUP BY 1, 2")
def snk1_store(spark, d):
    """SNK-1, SNK-4: two batches committed to a store, one of them once more, and what readers see."""
    root = store.shared_folder(spark, "store")
    rows = packets(spark, d).select("arrival", "kind", "bytes")
    for batch in (0, 1, 1):
        store.commit(rows.where(F.col("arrival") % 2 == batch), root, batch)
    return store.read(spark, root, "arrival long, kind string, bytes long").groupBy("kind", "batch").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@q(f"""WITH {P} SELECT arrival, '{{"ts_ns":' || t || ',"session":' || stream || ',"kind":"' || kind || '","fields":{{"bytes":' || bytes || ',"independent":' || ra || '}}}}' AS line FROM p""")
def snk10_log(spark, d):
    """SNK-10: an event a line, as JSON."""
    fields = F.struct("bytes", F.col("ra").alias("independent")).alias("fields")
    return packets(spark, d).select("arrival", F.to_json(F.struct(F.col("t").alias("ts_ns"), F.col("stream").alias("session"), "kind", fields)).alias("line"))


SPILLED = f"""WITH RECURSIVE {P}, n AS (SELECT stream, arrival, bytes, row_number() OVER (PARTITION BY stream ORDER BY t, arrival) AS i FROM p),
 f AS (SELECT stream, CAST(1 AS BIGINT) AS i, CAST([] AS STRUCT(a BIGINT, b BIGINT)[]) AS waiting, CAST(0 AS BIGINT) AS held, CAST(NULL AS BIGINT) AS cause, CAST(NULL AS BIGINT) AS arrival FROM n WHERE i = 1
  UNION ALL SELECT stream, CASE WHEN now IS NULL THEN i + 1 ELSE i END, CASE WHEN cause IS NOT NULL THEN waiting[2:] WHEN bytes > 0 THEN list_append(waiting, {{'a': a, 'b': bytes}}) ELSE waiting END, after, now, CASE WHEN cause IS NOT NULL THEN waiting[1].a END FROM
   (SELECT *, CASE WHEN cause IS NOT NULL THEN CASE WHEN after > {30_000} THEN cause END WHEN after > {32_500} THEN a END AS now FROM
    (SELECT f.stream, f.i, f.waiting, f.held, f.cause, n.arrival AS a, n.bytes, CASE WHEN f.cause IS NOT NULL THEN f.held - f.waiting[1].b WHEN n.bytes > 0 THEN f.held + n.bytes ELSE f.held END AS after FROM f JOIN n ON n.stream = f.stream AND n.i = f.i)))
 SELECT stream, arrival, spilled_by AS cause, held FROM (SELECT x.stream, x.arrival, x.held, n.arrival AS spilled_by FROM (SELECT *, CASE WHEN cause IS NULL THEN i - 1 ELSE i END AS at FROM f WHERE arrival IS NOT NULL) x JOIN n ON n.stream = x.stream AND n.i = x.at)"""


@q(SPILLED)
def ret7_spill(spark, d):
    """RET-7: which row goes to disk, and on which arrival, with 40,000 bytes for a stream."""
    rows = packets(spark, d).select("stream", "t", "arrival", "bytes")
    return folds.fold(rows, "stream", ["t", "arrival"], folds.spill(40_000), "stream long, arrival long, cause long, held long")


@q(f"SELECT e.user_id AS stream, e.event_id AS arrival, CASE WHEN r.arrival IS NULL THEN 'memory' ELSE 'disk' END AS tier FROM events e LEFT JOIN ({SPILLED}) r ON r.arrival = e.event_id")
def snk5_tier(spark, d):
    """SNK-5: the tier of each row after all spilling; what went to disk is written, and read back by its number."""
    rows = packets(spark, d).select("stream", "t", "arrival", "bytes")
    path = store.shared_folder(spark, "tier")
    rows.join(ret7_spill(spark, d).select("arrival"), "arrival", "left_semi").write.parquet(path)
    disk = spark.read.schema(rows.schema).parquet(path).select("arrival", F.lit("disk").alias("tier"))
    return rows.join(disk, "arrival", "left").select("stream", "arrival", F.coalesce("tier", F.lit("memory")).alias("tier"))


SWEPT = f"(t + {30 * HOUR}) // {24 * HOUR} * {24 * HOUR} + {24 * HOUR}"


@q(f"WITH {P}, n AS (SELECT *, {SWEPT} AS tick, coalesce(lead(t) OVER (PARTITION BY stream ORDER BY t, arrival), (SELECT max(t) + 1 FROM p)) AS until FROM p), g AS (SELECT *, coalesce(sum(CASE WHEN tick < until THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY t, arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM n) SELECT stream, CAST(max(tick) FILTER (tick < until) AS BIGINT) AS retired_at, bool_or(kind = 'view') AS announced, count(*) AS packets FROM g GROUP BY stream, life HAVING bool_or(tick < until)")
def sup31_maintenance(spark, d):
    """SUP-31: a sweep at each midnight retires streams idle for over 30 hours, and says which viewers could reach.
    A stream that comes back is a new one."""
    p = packets(spark, d)
    now = F.broadcast(p.agg((F.max("t") + 1).alias("now")))  # one row
    n = p.withColumn("tick", F.expr(f"((t + {30 * HOUR}) div {24 * HOUR} + 1) * {24 * HOUR}")).withColumn("next", F.lead("t").over(by_time()))
    n = n.join(now).withColumn("retired", F.col("tick") < F.coalesce("next", "now"))
    earlier = by_time().rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("life", F.coalesce(F.sum(F.col("retired").cast("long")).over(earlier), F.lit(0)))
    g = n.groupBy("stream", "life").agg(F.max(F.when(F.col("retired"), F.col("tick"))).alias("retired_at"), F.bool_or(F.col("kind") == "view").alias("announced"), F.count("*").alias("packets"))
    return g.where("retired_at is not null").drop("life")


@q()
def fn13_etag(spark, d):
    """FN-13: tags of whole bodies, plain and compressed, and which of five request headers they satisfy."""
    r = table(spark, d, "pages").select("page_id", http.entity_tag(F.coalesce("html", F.lit("")), F.col("page_id") % 2 == 1).alias("tag"))
    i = F.col("page_id") % 5
    header = F.when(i == 0, F.col("tag")).when(i == 1, F.concat(F.lit('"a-1" , W/'), F.col("tag"))).when(i == 2, "*").when(i == 3, '"a-1"')
    return r.select("page_id", "tag", http.not_modified(header, F.col("tag")).alias("not_modified"))


def _pad(x: int) -> str:
    return f"unhex('{bytes(b ^ x for b in KEY.ljust(64, bytes(1))).hex()}')"


@q(f"WITH {P} SELECT arrival, 'v1,' || base64(unhex(sha256({_pad(0x5C)} || unhex(sha256({_pad(0x36)} || encode('event-' || arrival || '.' || t // 1000000000 || '.' || kind)))))) AS signature FROM p")
def fn21_signature(spark, d):
    """FN-21: signed event bodies."""
    return packets(spark, d).select("arrival", http.webhook_signature(KEY, F.concat(F.lit("event-"), F.col("arrival").cast("string")), F.expr("t div 1000000000"), F.col("kind")).alias("signature"))


PAIRS = "x AS (SELECT stream, t, arrival, kind = 'signup' AS start, CASE WHEN kind = 'signup' THEN bytes % 6 ELSE bytes % 8 * 32 + bytes // 8 % 4 END AS b1, bytes // 32 % 8 * 32 + bytes // 256 % 4 AS b2 FROM p)"


@q(f"""WITH RECURSIVE {P}, {PAIRS}, n AS (SELECT *, sum(CASE WHEN start THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY t, arrival ROWS UNBOUNDED PRECEDING) AS number FROM x),
 g AS (SELECT stream, CAST(number AS BIGINT) AS number, max(CASE WHEN start THEN CASE WHEN b1 = 0 THEN 127 ELSE 2 * b1 - 1 END END) AS owed, flatten(list(CASE WHEN start THEN [b2] ELSE [b1, b2] END ORDER BY t, arrival)) AS got FROM n WHERE number > 0 GROUP BY 1, 2),
 f AS (SELECT stream, number, got[1:owed] AS k FROM g WHERE len(got) >= owed),
 walk AS (SELECT stream, number, k, CAST(1 AS BIGINT) AS c, CAST(NULL AS BIGINT) AS service FROM f
  UNION ALL SELECT stream, number, k, c + 1 + e + size, CASE WHEN e = 1 THEN k[c + 1] & 63 ELSE k[c] >> 5 END FROM (SELECT *, k[c] & 31 AS size, CASE WHEN k[c] >= 225 THEN 1 ELSE 0 END AS e FROM walk WHERE c <= len(k)) WHERE k[c] <> 0 AND c + e + size <= len(k))
 SELECT stream, number, CAST(any_value(len(k)) AS BIGINT) AS n_bytes, coalesce(string_agg(DISTINCT CAST(service AS VARCHAR), ',' ORDER BY CAST(service AS VARCHAR)) FILTER (service BETWEEN 1 AND 63), '') AS services FROM walk GROUP BY 1, 2""")
def sup25_dtvcc(spark, d):
    """SUP-25: caption packets from byte pairs made of the rows' bytes, each sign-up a start; services in text order."""
    x = packets(spark, d).select(
        "stream", "t", "arrival", (F.col("kind") == "signup").alias("start"),
        F.expr("cast(case when kind = 'signup' then bytes % 6 else bytes % 8 * 32 + bytes div 8 % 4 end as int)").alias("b1"), F.expr("cast(bytes div 32 % 8 * 32 + bytes div 256 % 4 as int)").alias("b2"),
    )
    names = F.array_sort(F.transform(captions.services(F.col("packet")), lambda s: s.cast("string")))
    return captions.reassemble(x, "stream", ["t", "arrival"]).select("stream", "number", F.size("packet").cast("long").alias("n_bytes"), F.array_join(names, ",").alias("services"))


def _permits(source: str, limit: int) -> str:
    """SQL: which rows of ``source`` (key, t, arrival, dur) find a permit."""
    return f"""n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, arrival) AS i FROM {source}),
 f AS (SELECT key, i, arrival, CAST(200 AS INTEGER) AS status, [t + dur] AS ends FROM n WHERE i = 1
  UNION ALL SELECT key, i, arrival, CASE WHEN len(ends) < {limit} THEN 200 ELSE 503 END, CASE WHEN len(ends) < {limit} THEN list_append(ends, t + dur) ELSE ends END FROM (SELECT n.*, list_filter(f.ends, lambda e: e > n.t) AS ends FROM f JOIN n ON n.key = f.key AND n.i = f.i + 1))"""


#: four streams share an address
ADDRESS = "'10.' || stream // 262144 % 256 || '.' || stream // 1024 % 256 || '.' || stream // 4 % 256"


@q(f"WITH RECURSIVE {P}, x AS (SELECT {ADDRESS} AS key, t, arrival, {12 * HOUR} AS dur FROM p), {_permits('x', 3)} SELECT key AS address, arrival, status, CAST(len(ends) AS INTEGER) AS held FROM f")
def adm2_address(spark, d):
    """ADM-2: publishers of an address, at most 3 at once, 12 hours each."""
    parts = [F.expr(f"cast(stream div {n} % 256 as string)") for n in (262144, 1024, 4)]
    rows = packets(spark, d).select(F.concat(F.lit("10."), parts[0], F.lit("."), parts[1], F.lit("."), parts[2]).alias("address"), "t", "arrival", F.lit(12 * HOUR).alias("dur"))
    return folds.fold(rows, "address", ["t", "arrival"], folds.permits(3), "address string, arrival long, status int, held int")


@q(f"WITH RECURSIVE {P}, x AS (SELECT stream AS key, t, arrival, bytes * 10000000000 AS dur FROM p), {_permits('x', 2)} SELECT key AS stream, arrival, status, CAST(len(ends) AS INTEGER) AS held FROM f")
def adm4_admission(spark, d):
    """ADM-4: requests of a stream that hold a permit until their body (ten seconds a byte) is read, at most 2."""
    rows = packets(spark, d).select("stream", "t", "arrival", (F.col("bytes") * 10**10).alias("dur"))
    return folds.fold(rows, "stream", ["t", "arrival"], folds.permits(2), "stream long, arrival long, status int, held int")


BAD = "kind IN ('error', 'click')"


@q(f"WITH {P}, r AS (SELECT *, sum(CASE WHEN {BAD} THEN 0 ELSE 1 END) OVER (PARTITION BY stream ORDER BY t, arrival ROWS UNBOUNDED PRECEDING) AS run FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY stream, run ORDER BY t, arrival) AS nth FROM r WHERE {BAD}) SELECT arrival, CAST(least(5 * pow(2, nth - 1), 20) AS BIGINT) AS pause FROM n")
def adm3_backoff(spark, d):
    """ADM-3: pauses after failures (errors and clicks): 5, doubling to 20, afresh after a success."""
    runs = by_time().rowsBetween(Window.unboundedPreceding, 0)
    bad = F.col("kind").isin("error", "click")
    r = packets(spark, d).withColumn("run", F.sum(F.when(bad, 0).otherwise(1)).over(runs)).where(bad)
    nth = F.row_number().over(Window.partitionBy("stream", "run").orderBy("t", "arrival"))
    # past the third doubling the ceiling holds, so the power stays small
    return r.select("arrival", F.least(F.pow(F.lit(2), F.least(nth, F.lit(10)) - 1) * 5, F.lit(20)).cast("long").alias("pause"))


@q(f"WITH {P}, m AS (SELECT stream, kind, max(bytes // 9000) FILTER (arrival % 2 = 0) AS a, max(bytes // 9000) FILTER (arrival % 2 = 1) AS b, count(*) FILTER (arrival % 2 = 0) AS na, count(*) FILTER (arrival % 2 = 1) AS nb FROM p GROUP BY 1, 2) SELECT stream, CASE WHEN bool_or(na = 0 OR nb = 0) THEN 'track_set_changed' WHEN bool_or(a <> b) THEN 'codec_parameters_changed' END AS verdict, CASE WHEN NOT bool_or(na = 0 OR nb = 0) THEN min(kind) FILTER (a <> b) END AS track FROM m GROUP BY 1")
def src11_catalog(spark, d):
    """SRC-11: two catalogs of a stream (its even and its odd arrivals): other keys come before other parameters,
    and of those the first track is named."""
    p = packets(spark, d).select("stream", "kind", "arrival", F.expr("bytes div 9000").alias("level"))

    def catalog(odd: int, name: str):
        return p.where(F.col("arrival") % 2 == odd).groupBy("stream", "kind").agg(F.max("level").alias(name))

    both = catalog(0, "a").join(catalog(1, "b"), ["stream", "kind"], "full")
    keys = F.bool_or(F.col("a").isNull() | F.col("b").isNull())
    track = F.min(F.when(F.col("a") != F.col("b"), F.col("kind")))
    g = both.groupBy("stream").agg(keys.alias("keys"), track.alias("track"))
    verdict = F.when(F.col("keys"), "track_set_changed").when(F.col("track").isNotNull(), "codec_parameters_changed")
    return g.select("stream", verdict.alias("verdict"), F.when(~F.col("keys"), F.col("track")).alias("track"))


@q("SELECT o_orderkey, CAST(coalesce(CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 10 + 1 END, 6) * CASE o_orderkey % 5 WHEN 0 THEN 6 WHEN 1 THEN 0.5 WHEN 2 THEN 6 WHEN 3 THEN 4 ELSE 1 END AS DOUBLE) AS max_age, o_orderkey % 5 = 2 AS immutable FROM orders")
def pl9_lifetimes(spark, d):
    """PL-9: multiples of the target (6 s if unknown): blocking playlists 6, others a half, media 6, what is missing 4
    for blocking requests and 1 for others."""
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey")
    target = F.coalesce(F.when(c % 4 > 0, c % 10 + 1), F.lit(6))
    times = F.when(k == 0, 6.0).when(k == 1, 0.5).when(k == 2, 6.0).when(k == 3, 4.0).otherwise(1.0)
    return table(spark, d, "orders").select("o_orderkey", (target * times).alias("max_age"), (k == 2).alias("immutable"))


@q(f"WITH {L} SELECT parent, min(start) AS start, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS parts FROM l GROUP BY 1 HAVING count(DISTINCT idx // 4) = 1 AND bool_and(start + dur <= 150) AND bool_and(NOT ra OR idx < 2)")
def sup20_compaction(spark, d):
    """SUP-20: segments whose parts are all hidden, expired and in one file become one range of it."""
    g = tiles(spark, d).withColumn("file", F.expr("idx div 4")).groupBy("parent")
    one, expired, hidden = F.min("file") == F.max("file"), F.max(F.col("start") + F.col("dur")) <= 150, F.bool_and(~F.col("ra") | (F.col("idx") < 2))
    r = g.agg(F.min("start").alias("start"), F.sum("bytes").alias("bytes"), F.count("*").alias("parts"), (one & expired & hidden).alias("whole"))
    return r.where("whole").drop("whole")


@q(f"WITH {P}, f AS (SELECT stream, CASE WHEN kind IN ('view', 'click') THEN '608/' ELSE '708/' END || kind AS channel, min(arrival) AS arrival FROM p WHERE kind <> 'error' GROUP BY 1, 2), s AS (SELECT stream, arrival, list_sort(list(channel) OVER (PARTITION BY stream ORDER BY arrival ROWS UNBOUNDED PRECEDING)) AS c FROM f) SELECT stream, arrival, array_to_string(c, ',') AS services, c[1] AS default_service FROM s")
def sup24_services(spark, d):
    """SUP-24: caption services are told when their set grows; 608 before 708, the first one the default.
    A stream has as many rows in the window as it has channels."""
    channel = F.concat(F.when(F.col("kind").isin("view", "click"), "608/").otherwise("708/"), "kind")
    f = packets(spark, d).where("kind <> 'error'").groupBy("stream", channel.alias("channel")).agg(F.min("arrival").alias("arrival"))
    c = F.array_sort(F.collect_list("channel").over(Window.partitionBy("stream").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)))
    return f.select("stream", "arrival", F.array_join(c, ",").alias("services"), F.get(c, F.lit(0)).alias("default_service"))
