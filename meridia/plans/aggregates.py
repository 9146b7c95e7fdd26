"""Aggregates over event and star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import floor_div
from ..operators.aggregates import BOUNDS, histogram, long_if_it_fits
from .inputs import HOUR, L, P, S, packets, samples, table, tiles
from .registry import register

QUERIES: dict = {}


def q(sql=None):
    return register(QUERIES, sql)


def bounds_sql(value: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({float(b)}::DOUBLE)" for b in BOUNDS) + ", (NULL)) b(le)"


@q(f"WITH {P} SELECT stream, count(*) FILTER (kind = 'view') AS video, count(*) FILTER (kind = 'click') AS audio, count(*) FILTER (kind NOT IN ('view', 'click')) AS subtitle FROM p GROUP BY 1")
def agg1_kinds(spark, d):
    """AGG-1, AGG-24: conditional counts in one pass."""
    k = F.col("kind")
    return packets(spark, d).groupBy("stream").agg(F.count_if(k == "view").alias("video"), F.count_if(k == "click").alias("audio"), F.count_if(~k.isin("view", "click")).alias("subtitle"))


@q(f"WITH {S} SELECT stream, publication, count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes, max(bytes) AS peak, CAST(sum(dur) AS BIGINT) AS nanos, max(t + dur) AS edge FROM s GROUP BY 1, 2")
def agg3_session(spark, d):
    """AGG-3, AGG-4: sums, peaks and latest ends by session."""
    return samples(spark, d).groupBy("stream", "publication").agg(F.count("*").alias("packets"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("peak"), F.sum("dur").alias("nanos"), F.max(F.col("t") + F.col("dur")).alias("edge"))


@q(f"WITH {S}, v AS (SELECT kind, dur / 3600000000000.0 AS h FROM s), b AS ({bounds_sql('h')}) SELECT kind, le, count(*) FILTER (le IS NULL OR h <= le) AS below, count(*) AS n FROM v, b GROUP BY 1, 2")
def agg5_histogram(spark, d):
    """AGG-5, AGG-12, WIN-18: cumulative histograms of hours between packets, with the fixed bounds."""
    return histogram(samples(spark, d), ["kind"], F.col("dur") / (HOUR * 1.0)).select("kind", "le", "below", "n")


@q(f"WITH {P} SELECT kind AS resource, CASE WHEN kind = 'error' THEN 500 ELSE 200 END AS status, arrival % 3 = 0 AS blocking, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM p GROUP BY 1, 2, 3")
def agg6_responses(spark, d):
    """AGG-6, AGG-7, AGG-8: responses by resource, status and method."""
    return packets(spark, d).groupBy(F.col("kind").alias("resource"), F.when(F.col("kind") == "error", 500).otherwise(200).alias("status"), (F.col("arrival") % 3 == 0).alias("blocking")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@q(f"WITH {P} SELECT kind, arrival % 5 AS outcome, count(*) AS n FROM p GROUP BY ROLLUP (kind, arrival % 5)")
def agg9_outcomes(spark, d):
    """AGG-9: operations by outcome, with totals."""
    return packets(spark, d).withColumn("outcome", F.col("arrival") % 5).rollup("kind", "outcome").agg(F.count("*").alias("n"))


@q(f"WITH {S} SELECT kind, count(DISTINCT (stream, publication)) AS sessions FROM s WHERE bytes > 5000 GROUP BY 1")
def agg10_rejections(spark, d):
    """AGG-10: sessions, each counted once a code."""
    return samples(spark, d).where("bytes > 5000").select("kind", "stream", "publication").distinct().groupBy("kind").agg(F.count("*").alias("sessions"))


@q(f"WITH {S} SELECT kind, ra AS concealed, count(*) AS n, CAST(sum(dur) AS BIGINT) AS missing FROM s WHERE dur > {10 * HOUR} GROUP BY 1, 2")
def agg11_compensation(spark, d):
    """AGG-11: holes of over 10 hours by codec and method; ``missing`` is a decimal where a sum is beyond a long."""
    holes = samples(spark, d).where(F.col("dur") > 10 * HOUR).groupBy("kind", F.col("ra").alias("concealed"))
    return long_if_it_fits(holes.agg(F.count("*").alias("n"), F.sum(F.col("dur").cast("decimal(20,0)")).alias("missing")), "missing")


@q(f"WITH {S} SELECT stream, max(greatest(1, (dur + 500000000) // 1000000000)) AS target, min(dur) FILTER (ra) AS part FROM s GROUP BY 1")
def agg13_targets(spark, d):
    """AGG-13, AGG-14: target durations: greatest, rounded half up; least non-null part."""
    from ..functions.time import target_seconds
    return samples(spark, d).groupBy("stream").agg(F.max(target_seconds("dur")).alias("target"), F.min(F.when(F.col("ra"), F.col("dur"))).alias("part"))


@q(f"WITH {P}, g AS (SELECT stream, kind, max(bytes) AS top, max(CASE WHEN arrival % 11 <> 0 THEN bytes END) AS known FROM p GROUP BY 1, 2) SELECT stream, CAST(sum(top) AS BIGINT) AS bandwidth, CASE WHEN bool_and(known = top) THEN CAST(sum(known) AS BIGINT) END AS average FROM g GROUP BY 1")
def agg16_bandwidth(spark, d):
    """AGG-16, AGG-17: the sum over groups of each group's greatest; null if any group lacks a measurement."""
    g = packets(spark, d).groupBy("stream", "kind").agg(F.max("bytes").alias("top"), F.max(F.when(F.col("arrival") % 11 != 0, F.col("bytes"))).alias("known"))
    return g.groupBy("stream").agg(F.sum("top").alias("bandwidth"), F.when(F.bool_and(F.col("known") == F.col("top")), F.sum("known")).alias("average"))


@q(f"WITH {P}, f AS (SELECT stream, kind, min(arrival) AS a FROM p GROUP BY 1, 2) SELECT stream, string_agg(kind, ',' ORDER BY a) AS codecs FROM f GROUP BY 1")
def agg18_codecs(spark, d):
    """AGG-18: distinct codecs in the order first seen."""
    f = packets(spark, d).groupBy("stream", "kind").agg(F.min("arrival").alias("a"))
    order = F.array_sort(F.collect_list(F.struct("a", "kind")))  # one entry a codec
    return f.groupBy("stream").agg(F.array_join(F.transform(order, lambda x: x["kind"]), ",").alias("codecs"))


@q("SELECT l_orderkey, CAST(bit_or(1 << (l_linenumber % 8)::INT) AS BIGINT) AS services, CAST(bit_and(1 << (l_linenumber % 8)::INT) AS BIGINT) AS common, CASE WHEN count(*) FILTER (l_tax > 0.04) = 0 THEN 'absent' WHEN count(*) FILTER (l_tax > 0.04) < count(*) THEN 'partial' ELSE 'consistent' END AS carriage FROM lineitem GROUP BY 1")
def agg19_captions(spark, d):
    """AGG-19, AGG-20, AGG-21, SUP-26: caption services as bits; what all tracks have; ladders."""
    bit = F.expr("shiftleft(1L, cast(l_linenumber % 8 as int))")
    n = F.count_if(F.col("l_tax") > 0.04)
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bit_or(bit).alias("services"), F.bit_and(bit).alias("common"), F.when(n == 0, "absent").when(n < F.count("*"), "partial").otherwise("consistent").alias("carriage"))


@q(f"WITH {L} SELECT CAST(sum(dur) AS BIGINT) AS held, CAST(max(start + dur) AS BIGINT) AS depth, CAST(sum(CASE WHEN ra THEN bytes ELSE 0 END) AS BIGINT) AS memory, CAST(sum(CASE WHEN ra THEN 0 ELSE bytes END) AS BIGINT) AS disk FROM l")
def agg22_depth(spark, d):
    """AGG-22: retention depth and bytes by tier, over the node."""
    b = F.col("bytes")
    return tiles(spark, d).agg(F.sum("dur").alias("held"), F.max(F.col("start") + F.col("dur")).alias("depth"), F.sum(F.when(F.col("ra"), b).otherwise(0)).alias("memory"), F.sum(F.when(F.col("ra"), 0).otherwise(b)).alias("disk"))


@q("SELECT l_suppkey % 10 AS node, CAST(sum(b) AS BIGINT) AS bytes FROM (SELECT DISTINCT l_suppkey, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS b FROM lineitem) GROUP BY 1")
def agg25_retained(spark, d):
    """AGG-25: bytes, with shared bodies counted once."""
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("b")).distinct()
    return rows.groupBy((F.col("l_suppkey") % 10).alias("node")).agg(F.sum("b").alias("bytes"))


@q("SELECT CASE WHEN c_custkey % 3 = 0 THEN '10.0.' || c_custkey % 8 || '.1' WHEN c_custkey % 3 = 1 THEN '10.1.' || c_custkey % 8 || '.1' ELSE '2001:db8:0:' || c_custkey % 8 || '::/64' END AS client, count(*) AS held FROM customer GROUP BY 1")
def agg26_addresses(spark, d):
    """AGG-26: permits by client: whole IPv4 addresses (also mapped ones), /64 of IPv6."""
    k = (F.col("c_custkey") % 8).cast("string")
    m = F.col("c_custkey") % 3
    ip = F.when(m == 0, F.concat(F.lit("10.0."), k, F.lit(".1"))).when(m == 1, F.concat(F.lit("::ffff:10.1."), k, F.lit(".1"))).otherwise(F.concat(F.lit("2001:db8:0:"), k, F.lit(":1:2:3:4")))
    client = F.when(ip.rlike(r"^::ffff:\d+\."), F.substring(ip, 8, 100)).when(ip.contains(":"), F.concat(F.regexp_extract(ip, r"^((?:[0-9a-f]+:){3}[0-9a-f]+)", 1), F.lit("::/64"))).otherwise(ip)
    return table(spark, d, "customer").groupBy(client.alias("client")).agg(F.count("*").alias("held"))


@q(f"""WITH {S}, g AS (SELECT stream, kind, CAST(sum(bytes) AS BIGINT) AS v FROM s GROUP BY 1, 2) SELECT 'bytes_total' AS family, stream AS a, kind || '"' || chr(10) || chr(92) AS b, 'bytes_total{{stream="' || stream || '",kind="' || kind || chr(92) || '"' || chr(92) || 'n' || chr(92) || chr(92) || '"}} ' || v AS line FROM g UNION ALL SELECT 'bytes_total', NULL, NULL, '# TYPE bytes_total counter'""")
def snk7_exposition(spark, d):
    """SNK-7: counters as lines of exposition text, with the columns that order them: a family's type comes first. Label
    values (here with a quote, a line feed and a backslash) are escaped. A writer sorts by range; no task holds all lines."""
    from ..functions.text import escape_label
    g = samples(spark, d).groupBy("stream", "kind").agg(F.sum("bytes").alias("v")).withColumn("b", F.concat("kind", F.lit('"\n\\')))
    line = F.concat(F.lit('bytes_total{stream="'), F.col("stream").cast("string"), F.lit('",kind="'), escape_label(F.col("b")), F.lit('"} '), F.col("v").cast("string"))
    head = spark.range(1).select(F.lit("bytes_total").alias("family"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("string").alias("b"), F.lit("# TYPE bytes_total counter").alias("line"))
    return g.select(F.lit("bytes_total").alias("family"), F.col("stream").alias("a"), "b", line.alias("line")).unionByName(head)


@q(f"WITH {L} SELECT parent, CAST(sum(dur) AS BIGINT) AS video, CAST(max(start + dur) - min(start) AS BIGINT) AS audio, bool_or(ra) AS independent, CAST(sum(bytes) AS BIGINT) AS bytes FROM l GROUP BY 1")
def sup9_fragments(spark, d):
    """SUP-9, SUP-12: fragments' ends: sums for video, greatest ends for audio; segment totals."""
    return tiles(spark, d).groupBy("parent").agg(F.sum("dur").alias("video"), (F.max(F.col("start") + F.col("dur")) - F.min("start")).alias("audio"), F.bool_or("ra").alias("independent"), F.sum("bytes").alias("bytes"))


@q(f"WITH {P}, w AS (SELECT stream, t // {24 * HOUR} AS batch, count(*) AS n, max(bytes) AS most, CAST(sum(bytes) AS BIGINT) AS total FROM p GROUP BY 1, 2) SELECT stream, batch, CASE WHEN n > 6 THEN 'packets' WHEN most > 9000 THEN 'packet_bytes' WHEN total > 20000 THEN 'batch_bytes' END AS error FROM w WHERE n > 6 OR most > 9000 OR total > 20000")
def src7_bounded_batch(spark, d):
    """SRC-7: batches (days) over their bounds are errors, not truncated."""
    w = packets(spark, d).groupBy("stream", floor_div(F.col("t"), 24 * HOUR).alias("batch")).agg(F.count("*").alias("n"), F.max("bytes").alias("most"), F.sum("bytes").alias("total"))
    error = F.when(F.col("n") > 6, "packets").when(F.col("most") > 9000, "packet_bytes").when(F.col("total") > 20000, "batch_bytes")
    return w.select("stream", "batch", error.alias("error")).where("error is not null")


@q(f"WITH {P} SELECT stream, kind, min(t) AS first_t, arg_min(arrival, t) AS arrival FROM p GROUP BY 1, 2")
def src8_first_timestamp(spark, d):
    """SRC-8: the first timestamp of each track."""
    return packets(spark, d).groupBy("stream", "kind").agg(F.min("t").alias("first_t"), F.min_by("arrival", "t").alias("arrival"))


@q("SELECT c_custkey, coalesce(CASE WHEN length(c_name) > 30 THEN c_name END, n_name, r_name) AS title FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) ON c_nationkey = n_nationkey LEFT JOIN region ON r_regionkey = c_nationkey % 5")
def src10_metadata(spark, d):
    """SRC-10: a track's value, else its kind's, else the publication's; invalid ones fall through."""
    n = table(spark, d, "nation").where("n_nationkey % 4 <> 0")
    rows = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("c_nationkey") % 5, "left")
    return rows.select("c_custkey", F.coalesce(F.when(F.length("c_name") > 30, F.col("c_name")), "n_name", "r_name").alias("title"))
