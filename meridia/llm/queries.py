"""The queries of this package's operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed, mix, pieces, secrets, simhash, substring, topk, toxicity, urls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, verify=True).drop("text")


def op2_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)


def op3_mix(spark, sf_dir):
    return mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_warc(spark, sf_dir):
    _, folder = warc.archive_pages(table(spark, sf_dir, "pages"))
    return warc.read_folder(spark, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_secrets(spark, sf_dir):
    got = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_candidates", "n_secrets", "secrets", F.sha2("redacted", 256).alias("redacted_sha256"))


def op8_substring(spark, sf_dir):
    return substring.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op9_embeddings(spark, sf_dir):
    return embed.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.train(pages)).select("page_id", "host", "path", "rule", "verdict", "score")


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_topk, op3_mix, op4_simhash, op5_warc, op6_toxicity, op7_secrets, op8_substring, op9_embeddings, op10_urls)}

SQL = {
    "op2_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INT AS rank, vec_id, score FROM r WHERE n <= 5
""",
    "op3_mix": mix.SQL,
    "op5_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest AS d, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f ON payload_digest = d
""",
    "op8_substring": """
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents),
x AS (SELECT doc_id, unnest(generate_series(1, len(words) - 34)) AS i, words FROM w WHERE len(words) >= 35),
k AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM x),
n AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS j FROM k WHERE h IN (SELECT h FROM n)),
t AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM w WHERE len(words) > 0),
r AS (SELECT t.doc_id, count(*) AS n_words, count(c.j) AS n_removed, string_agg(CASE WHEN c.j IS NULL THEN word END, ' ' ORDER BY t.j) AS kept
    FROM t LEFT JOIN c ON t.doc_id = c.doc_id AND t.j = c.j GROUP BY t.doc_id)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r ON w.doc_id = r.doc_id
""",
    "op9_embeddings": """
WITH RECURSIVE g AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM g UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
""",
}
