"""A corpus pipeline of five stages, each written to the shared folder and read again.

Every stage works on all documents that the one before kept, and its decisions take
effect: toxic documents go, one document of each group of near copies stays, secrets are
replaced in the texts, documents are left out or repeated as the mix has it, and what is
left is encoded. All but the last return the columns of ``documents``, other columns as they
are, whatever their names. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm import mix, pieces, secrets, simhash, toxicity
from meridia.llm.common import delete, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the random field scores at one half or more go. Null and blank texts get
    the score of no words; each row is judged on its own, so repeated rows go or stay together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by five-word shingles, the least doc_id stays. Texts are
    compared, not ids: of one id's different texts each stays, and rows with a null id all
    stay. Null and blank texts are copies of each other."""
    return simhash.drop_near_duplicates(docs, **simhash.PIPELINE)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; n_chars follows (null for a null text)."""
    got = secrets.redact(docs)
    return got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else got


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix has it, 0 to 3 times. A null source is a source; null and
    blank texts have no words and follow their source's threshold; null ids count by text."""
    return mix.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as piece ids, token_ids and n_tokens, in place of their texts: null for a
    null text, none for an empty one. Columns of those names are replaced."""
    return pieces.encode(docs).drop("text")


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_copies), ("secrets", hide_secrets), ("mixing", mix_sources), ("encoding", encode)]

#: No stage but the mix is SQL; test_pipeline_equals_one_machine holds run()'s rows against a
#: version without Spark that compares all pairs of documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with scratch(spark) as made:
            docs = made.keep(stage(spark, docs, sf_dir), "stage")
        if before:
            delete(spark, before)
        before = made.kept[0]
    return docs
