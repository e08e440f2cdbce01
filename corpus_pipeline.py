"""From raw documents to token ids: quality, near duplicates, secrets, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. A document is known by its doc_id. Defined cases: null and empty texts are judged like any other (the classifier
scores them, they have no near duplicates, no secret, no size and so no part in the mixture); of rows with one doc_id
and one text the second stage keeps one; a row with a null doc_id goes there if its text stands under a doc_id too; a
null source is a source; further columns are kept; an empty table gives empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import mixing, ngram_jaccard, quality, secrets, sentencepiece_codec
from basalt.llm.common import materialize, read_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from labelled documents outside the held-out quarter."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"), quality.fold("doc_id", 4) != 2)
    return quality.keep_good(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the shingle join the smallest doc_id stays, with one row for each of its texts."""
    gone = ngram_jaccard.jaccard_components(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.filter("doc_id is not null").withColumn("_text", F.xxhash64("text")).join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "_text"])
    nameless = docs.filter("doc_id is null").withColumn("_text", F.xxhash64("text")).dropDuplicates(["_text"])
    nameless = nameless.join(docs.filter("doc_id is not null").select(F.xxhash64("text").alias("_text")).distinct(), "_text", "left_anti")
    return kept.select(*docs.columns).unionByName(nameless.select(*docs.columns))


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a secret go."""
    return docs.filter(~secrets.has_secret(F.col("text"), secrets.train(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mixture takes it."""
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text", "source"))
    taken = mixing.mix(keyed.select(F.col("_row").alias("doc_id"), "text", "source")).filter("taken > 0")
    copies = taken.groupBy(F.col("doc_id").alias("_row")).agg(F.max(F.expr("int(taken div size)")).alias("_copies"))
    return keyed.join(copies, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the piece ids of each document."""
    return sentencepiece_codec.encode(docs).select("doc_id", F.size("ids").alias("n_tokens"), "ids")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", drop_secrets),
    ("mixture", mix_sources),
    ("encoding", encode_texts),
]

#: Trees, hashes and token ids are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
