"""A corpus pipeline over the table ``documents``: language, near copies, benchmark leaks, personal data, tokens.

Every stage takes (spark, docs, sf_dir), where docs has the columns of ``documents``, and returns a DataFrame that is written
and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from embergrid.llm import bytebpe, decontaminate, language, pii, setcopies
from embergrid.llm.queries import RANKS, records
from embergrid.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Rows and bytes of an Arrow batch: what a worker, and the JVM beside it, hold of the texts at once.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def _bound_batches(spark: SparkSession) -> None:
    """The stages that run Python send batches of this size; the setting holds for the session, as its results are read later."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain; a missing lang is filled in. Null texts, texts without a letter and
    narrow decisions go."""
    _bound_batches(spark)
    model = language.learn_languages(records(docs, "lang"))
    judged = language.predict_language(docs.select(*COLUMNS, F.col("text").alias("document")), model, keep=COLUMNS)
    return judged.filter(~F.col("rejected")).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every group of near copies: five-word shingles and a similarity of 0.8,
    exactly. A row without doc_id can't be named and stays; rows that repeat a doc_id are judged each by its own text."""
    _bound_batches(spark)
    found = materialize(setcopies.near_copies(records(docs), words=5, similarity=0.8), "near_copies")
    named = found.filter("area is not null")
    # of the rows that have their group's smallest doc_id, the one with the smallest hash of doc_id and text stays
    heads = named.filter(F.col("area") == F.col("component"))
    first = heads.groupBy("area").agg(F.min("row").alias("stays"))
    gone = named.filter(F.col("area") != F.col("component")).select("row").union(
        heads.join(first, "area").filter("row <> stays").select("row")
    )
    gone = materialize(gone.distinct(), "copies")
    repeated = materialize(named.groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("row"), "repeated_rows")
    kept = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row")).join(gone, "row", "left_anti")
    if repeated.isEmpty():
        return kept.drop("row")
    once = kept.join(repeated, "row", "left_semi").dropDuplicates(["doc_id", "row"])
    return kept.join(repeated, "row", "left_anti").unionByName(once).drop("row")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than half of every benchmark item. Rows are judged each by its own text, also those that
    repeat a doc_id or have none; the mark that names them is 128 bits long."""
    _bound_batches(spark)
    mark = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    named = docs.select(*COLUMNS, mark.alias("mark"))
    judged = named.select(F.col("mark").alias("area"), F.col("text").alias("document"))
    leaks = decontaminate.benchmark_leaks(judged, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = materialize(leaks.select(F.col("area").alias("mark")).distinct(), "leaks")
    return named.join(gone, "mark", "left_anti").drop("mark")


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by [KIND]; n_chars follows the text."""
    clean = pii.redact(docs.select(*COLUMNS).withColumnRenamed("text", "document"), pii.train_pii(spark))
    return clean.select("doc_id", F.col("document").alias("text"), "lang", "source", F.length("document").cast("bigint").alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes they decode to."""
    _bound_batches(spark)
    named = docs.select("doc_id", F.col("text").alias("document"))
    return bytebpe.encode_and_check(named, RANKS, public_tokenizers.PATTERN, keep=["doc_id"], with_ids=True, remember=100_000)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("byte_bpe", tokens),
]

#: The stages call trained models and fingerprints that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
