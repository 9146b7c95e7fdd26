"""Predicates over parts, customers, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import predicates as pr
from .inputs import HOUR, P, by_time, packets, table
from .registry import register

QUERIES: dict = {}


def q(sql=None):
    return register(QUERIES, sql)


@q("SELECT p_partkey, p_brand, p_size FROM part WHERE p_size BETWEEN 10 AND 30 AND p_brand IN ('Brand#11', 'Brand#22', 'Brand#33', 'Brand#44') AND p_retailprice >= 1000")
def pred1_bounds(spark, d):
    """PRED-1, PRED-2: ranges, open ranges and membership."""
    p = table(spark, d, "part")
    ok = pr.admits(F.col("p_size"), low=10, high=30) & pr.admits(F.col("p_brand"), one_of=["Brand#11", "Brand#22", "Brand#33", "Brand#44"]) & pr.admits(F.col("p_retailprice"), low=1000)
    return p.where(ok).select("p_partkey", "p_brand", "p_size")


@q("SELECT p_partkey, greatest(p_size * 40, 100 + p_partkey % 1900) <= 1920 AND least(p_size * 40, 100 + p_partkey % 1900) <= 1080 AS fits, (p_size * 1000)::BIGINT * 1 <= 30::BIGINT * 1001 AS rate_ok FROM part")
def pred3_resolution(spark, d):
    """PRED-3, PRED-4: frame boxes in either orientation, exact frame rates (at most 30)."""
    w, h = F.col("p_size") * 40, 100 + F.col("p_partkey") % 1900
    return table(spark, d, "part").select("p_partkey", pr.fits_box(w, h, 1920, 1080).alias("fits"), pr.rate_at_most(F.col("p_size") * 1000, F.lit(1001), 30, 1).alias("rate_ok"))


@q("SELECT l_orderkey, CASE WHEN n > 6 THEN 'too_many' WHEN n < 2 THEN 'too_few' WHEN r = 0 THEN 'no_media' WHEN big > 0 THEN 'parameters' END AS failure FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag <> 'N') AS r, count(*) FILTER (l_quantity > 48) AS big FROM lineitem GROUP BY 1)")
def pred5_presentation(spark, d):
    """PRED-5: counts first, then a required kind, then parameters; the first failure counts."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") != "N").alias("r"), F.count_if(F.col("l_quantity") > 48).alias("big"))
    return g.select("l_orderkey", pr.first_failure(("too_many", F.col("n") > 6), ("too_few", F.col("n") < 2), ("no_media", F.col("r") == 0), ("parameters", F.col("big") > 0)).alias("failure"))


@q("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def pred6_unique(spark, d):
    """PRED-6: ids that repeat within a catalog."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@q("SELECT n_nationkey AS member, 'unused_group' AS problem FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 9 = 0) UNION ALL "
   "SELECT c_nationkey, 'two_defaults' FROM customer WHERE c_custkey % 50 = 0 GROUP BY 1 HAVING count(*) > 1")
def pred7_topology(spark, d):
    """PRED-7: groups no combination uses; groups with more than one default."""
    c = table(spark, d, "customer")
    unused = table(spark, d, "nation").join(c.where("c_custkey % 9 = 0"), F.col("n_nationkey") == F.col("c_nationkey"), "left_anti").select(F.col("n_nationkey").alias("member"), F.lit("unused_group").alias("problem"))
    two = c.where("c_custkey % 50 = 0").groupBy("c_nationkey").count().where("count > 1").select(F.col("c_nationkey").alias("member"), F.lit("two_defaults").alias("problem"))
    return unused.unionByName(two)


@q("WITH p AS (SELECT p_partkey AS k, count(*) AS n FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1), t AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey % 5 <> 0) "
   "SELECT coalesce(p.k, t.k) AS track, CASE WHEN p.n > 1 THEN 'duplicate' WHEN t.k IS NULL THEN 'unknown' WHEN p.k IS NULL THEN 'missing' END AS problem FROM p FULL JOIN t ON p.k = t.k WHERE p.n > 1 OR t.k IS NULL OR p.k IS NULL")
def pred8_plan(spark, d):
    """PRED-8: plans against tracks: duplicate, unknown, missing."""
    p = table(spark, d, "part").where("p_partkey % 3 <> 0").groupBy(F.col("p_partkey").alias("k")).agg(F.count("*").alias("n"))
    t = table(spark, d, "lineitem").where("l_partkey % 5 <> 0").select(F.col("l_partkey").alias("t")).distinct()
    problem = pr.first_failure(("duplicate", F.col("n") > 1), ("unknown", F.col("t").isNull()), ("missing", F.col("k").isNull()))
    return p.join(t, p.k == t.t, "full").select(F.coalesce("k", "t").alias("track"), problem.alias("problem")).where("problem is not null")


@q("SELECT p_partkey, p_size + 10 >= p_size AND p_partkey % 60 <= p_size AND p_partkey % 7 + p_partkey % 11 < p_size + 10 AS valid FROM part")
def pred9_policy(spark, d):
    """PRED-9: targets, caps and tolerances of a policy."""
    s, k = F.col("p_size"), F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", pr.policy_valid(s, k % 60, s + 10, k % 7, k % 11).alias("valid"))


@q(f"WITH {P}, w AS (SELECT *, lag(kind) OVER x AS prev, lag(bytes) OVER x AS before FROM p WINDOW x AS (PARTITION BY stream ORDER BY t, arrival)) SELECT arrival, CASE WHEN bytes = 0 THEN 'empty' WHEN prev = 'error' AND kind <> 'signup' THEN 'ended' WHEN prev IS NULL AND kind = 'click' THEN 'no_initialization' WHEN before > bytes * 50 THEN 'shrunk' ELSE 'ok' END AS verdict FROM w")
def pred10_write(spark, d):
    """PRED-10: writes are refused by what came before in their stream."""
    rows = packets(spark, d).withColumn("prev", F.lag("kind").over(by_time())).withColumn("before", F.lag("bytes").over(by_time()))
    c = F.col
    verdict = pr.first_failure(("empty", c("bytes") == 0), ("ended", (c("prev") == "error") & (c("kind") != "signup")), ("no_initialization", c("prev").isNull() & (c("kind") == "click")), ("shrunk", c("before") > c("bytes") * 50))
    return rows.select("arrival", F.coalesce(verdict, F.lit("ok")).alias("verdict"))


@q("SELECT event_id, json_extract_string(props, '$.k')::INT BETWEEN 20 AND 60 AND event_type <> 'error' AS granted FROM events")
def pred11_claims(spark, d):
    """PRED-11: every configured claim must match."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select("event_id", (pr.admits(k, low=20, high=60) & (F.col("event_type") != "error")).alias("granted"))


@q("SELECT page_id, regexp_matches(o, '^https://[^./]+\\.example\\.com$') AS one, regexp_matches(o, '^https://.+\\.example\\.com$') AS any, o = 'https://ads-track.example.org' AS exact FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://[^/?#]*')) AS o FROM pages)")
def pred12_origin(spark, d):
    """PRED-12: origins against exact and wildcard patterns."""
    o = F.concat(F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0), F.when(F.col("url").startswith("https"), ":443").otherwise(":80"))
    return table(spark, d, "pages").select("page_id", pr.origin_matches(o, "https://*.example.com").alias("one"), pr.origin_matches(o, "https://**.example.com").alias("any"), pr.origin_matches(o, "https://ads-track.example.org").alias("exact"))


@q(f"WITH {P}, m AS (SELECT max(t) AS now FROM p), g AS (SELECT stream, max(t) AS last, max(t) FILTER (ra) AS media FROM p GROUP BY 1) SELECT stream, CASE WHEN now - media <= {24 * HOUR} THEN 'running' WHEN now - last > {24 * HOUR} THEN 'stalled:source' ELSE 'stalled:media' END AS health FROM g, m")
def pred13_health(spark, d):
    """PRED-13: streams without media for over 24 hours stall, by their source or their media."""
    p = packets(spark, d)
    g = p.groupBy("stream").agg(F.max("t").alias("last"), F.max(F.when(F.col("ra"), F.col("t"))).alias("media"))
    now = p.agg(F.max("t").alias("now"))  # one row
    return g.join(F.broadcast(now)).select("stream", pr.health(F.col("now") - F.col("last"), F.col("now") - F.col("media"), 24 * HOUR).alias("health"))
