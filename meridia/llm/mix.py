"""Mixing sources to target weights by hash thresholds.

Budgets are nested: of a source's documents in the order of their hashes, a mix takes
those up to a threshold. Histograms of words by source and hash bucket find the bucket
where the budget ends; only that bucket is counted again, in finer buckets, until it
holds single hashes. The mix is then a filter: nothing is sorted, no source is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, scratch

WEIGHTS, CAP = (5, 2, 1), 3
#: hex digits of the hash by which each level splits its boundary bucket: 60 bits in all
LEVELS, DIGITS = (3, 3, 3, 3, 3), 15


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source.

    Sources by code point, null last, weigh ``weights``, repeating, and share all words;
    targets stop at ``cap`` times a source's size and the excess is shared again. That
    ends with all sources whose capacity per weight is below a level at their cap, and
    the others at the level, so one pass in the order of capacity per weight finds it.
    The windows without a key are over one row a source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    t = sizes.withColumn("w", w.cast("long")).withColumn("top", F.col("source_size") * cap)
    # capacity per weight, compared exactly: weights divide their product
    lcm = 1
    for x in weights:
        lcm *= x
    t = t.withColumn("ratio", F.col("top") * (F.lit(lcm) / F.col("w")).cast("long"))
    upto = Window.orderBy("ratio").rangeBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    t = (
        t.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
        .withColumn("capped", F.coalesce(F.sum("top").over(upto), F.lit(0)))
        .withColumn("free_w", F.col("all_w") - F.coalesce(F.sum("w").over(upto), F.lit(0)))
    )
    # at its cap if the level that all sources from this one on would share exceeds its ratio
    t = t.withColumn("full", F.col("ratio") * F.col("free_w") <= (F.col("total") - F.col("capped")) * lcm)
    t = t.withColumn("cap_sum", F.coalesce(F.sum(F.when(F.col("full"), F.col("top"))).over(everything), F.lit(0))).withColumn(
        "w_sum", F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(everything), F.lit(0))
    )
    target = F.when(F.col("full"), F.col("top").cast("double")).otherwise(((F.col("total") - F.col("cap_sum")) * F.col("w")).cast("double") / F.col("w_sum"))
    return t.select("source", "source_size", target.alias("target"))


def row_hash(id_col: str, text_col: str):
    return F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.lit("")).cast("binary")), 1, DIGITS)


def hashed(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size, hash): size in words, hash 60 bits of an MD5 of the id (of the
    text where the id is null), as hex digits."""
    return df.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        row_hash(id_col, text_col).alias("hash"),
    )


def thresholds(docs: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, threshold): ``whole`` copies of every document, and
    one more of those whose hash is at most ``threshold`` (below every hash: '')."""
    goal = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    size = F.col("source_size")
    goal = goal.withColumn("whole", F.when(size > 0, F.least(F.floor(F.col("target") / size), F.lit(CAP))).otherwise(0).cast("int"))
    goal = goal.withColumn("left", F.col("target") - F.col("whole") * size).withColumn("prefix", F.lit("")).withColumn("threshold", F.lit(""))
    goal, _ = materialize(goal, "goals")
    done = 0
    for digits in LEVELS:
        key = F.substring("hash", 1, done + digits)
        g = goal.select(F.col("source").alias("s"), "left", "prefix")
        same = F.col("source").eqNullSafe(F.col("s"))
        inside = docs.join(g, same & (F.substring("hash", 1, done) == F.col("prefix"))) if done else docs
        hist = inside.groupBy("source", key.alias("bucket")).agg(F.sum("size").alias("words"))
        # at most 16**digits buckets of a source, whatever its number of documents
        w = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("words").over(w)).withColumn("before", F.col("upto") - F.col("words"))
        edge = hist.join(g.drop("prefix"), same).groupBy("source").agg(
            F.max(F.struct(F.when(F.col("upto") <= F.col("left"), F.col("bucket")).alias("b"), F.col("upto"))).alias("fits"),
            F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", "before", "upto"))).alias("next"),
        )
        j = goal.join(edge.withColumnRenamed("source", "s"), same, "left")
        done += digits
        last = done == DIGITS
        nearer = (F.col("next.upto") - F.col("left")) < (F.col("left") - F.col("next.before"))
        goal = j.select(
            "source", "source_size", "target", "whole", (F.col("left") - F.coalesce(F.col("next.before"), F.lit(0))).alias("left"),
            F.coalesce("next.bucket", F.lit("~")).alias("prefix"),
            # a bucket's prefix, filled with f, is not below any hash in it
            F.when(F.lit(last) & F.coalesce(nearer, F.lit(False)), F.col("next.bucket")).otherwise(F.coalesce(F.rpad("fits.b", DIGITS, "f"), "threshold")).alias("threshold"),
        )
        goal, _ = materialize(goal, "goals")
    return goal


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id_col, source, size, source_size, target, copies, taken) of each row.

    ``copies`` (0 to 3) is how often the mix has the document, ``taken`` its words. Each
    source comes within one document of its target. The same ids give the same mix at
    any partitioning; rows that repeat an id are taken alike. Null and blank texts have
    size 0, count for nothing and follow their source's threshold. An empty table gives none.
    """
    with scratch(df.sparkSession) as made:
        docs = made.keep(hashed(df, id_col, text_col, source_col), "sizes")
        goal = made.keep(thresholds(docs).select(F.col("source").alias("s"), "source_size", "target", "whole", "threshold"), "goals")
    out = docs.join(goal, F.col("source").eqNullSafe(F.col("s")))
    copies = F.least(F.col("whole") + (F.col("hash") <= F.col("threshold")).cast("int"), F.lit(CAP))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """df with each row as often as ``mix`` has it: rows meet their source's threshold, not
    each other, so ids may be null or repeated. The columns stay as they are. Null and blank
    texts count for nothing and follow their source's threshold; a null source is a source."""
    with scratch(df.sparkSession) as made:
        docs, _ = materialize(hashed(df, id_col, text_col, source_col), "sizes")
        goal = made.keep(thresholds(docs).select(F.col("source").alias("_source"), F.col("whole").alias("_whole"), F.col("threshold").alias("_threshold")), "goals")
    rows = df.join(goal, F.col(source_col).cast("string").eqNullSafe(F.col("_source")))
    copies = F.least(F.col("_whole") + (row_hash(id_col, text_col) <= F.col("_threshold")).cast("int"), F.lit(CAP))
    rows = rows.withColumn("_copies", copies).where("_copies > 0")
    return rows.withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*df.columns)


#: DuckDB's form of the mix: the same hashes, sorted.
SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
r AS (SELECT *, 3 * source_size AS top, 3 * source_size * (10 // w) AS ratio FROM w),
f AS (SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(top) OVER b, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS free_w
    FROM r WINDOW b AS (ORDER BY ratio RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, ratio * free_w <= (total - capped) * 10 AS is_full FROM f),
c AS (SELECT *, coalesce(sum(CASE WHEN is_full THEN top END) OVER (), 0) AS cap_sum, coalesce(sum(CASE WHEN NOT is_full THEN w END) OVER (), 0) AS w_sum FROM k),
t AS (SELECT source, source_size, CASE WHEN is_full THEN top::DOUBLE ELSE ((total - cap_sum) * w)::DOUBLE / w_sum END AS target FROM c),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::INT AS whole FROM t),
l AS (SELECT *, target - whole * source_size AS remaining FROM g),
u AS (SELECT d.*, source_size, target, whole, remaining, sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto
    FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source),
v AS (SELECT *, max(CASE WHEN upto <= remaining THEN upto END) OVER (PARTITION BY source) AS fits,
    min(CASE WHEN upto > remaining THEN upto END) OVER (PARTITION BY source) AS beyond FROM u),
x AS (SELECT *, CASE WHEN beyond IS NOT NULL AND beyond - remaining < remaining - coalesce(fits, 0) THEN beyond ELSE fits END AS last FROM v)
SELECT doc_id, size, source_size, target, (size * least(whole + CASE WHEN upto <= coalesce(last, -1) THEN 1 ELSE 0 END, 3))::BIGINT AS taken FROM x
"""
