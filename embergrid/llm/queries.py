"""The registered queries of this subpackage: thin steps from the given tables to the operators and back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from embergrid.llm import (
    bytebpe, decontaminate, histories, idfile, language, nearcopies, oracle, pii, resample, secret_scan, shards, spans, topk, toxicity, urls,
)
from embergrid.session import materialize, scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RULES = [
    urls.Rule("block", "net/"), urls.Rule("allow", "example.net/en/"), urls.Rule("block", "example.com/de/"), urls.Rule("allow", "org/fr/"),
]
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(documents: DataFrame, *more: str) -> DataFrame:
    """The table ``documents`` as text records (area, document)."""
    return documents.select(F.col("doc_id").alias("area"), F.col("text").alias("document"), *more)


def _remainder(of: int):
    return F.pmod(F.crc32(F.col("area").cast("string")), F.lit(of))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(records(_table(spark, sf_dir, "documents")), pii.train_pii(spark))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        F.col("area").alias("doc_id"), *map(count, pii.KINDS), F.sha2(spans.listing(F.col("base")), 256).alias("base_sha256"),
        spans.listing(F.col("spans")).alias("spans"),
    )


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = records(_table(spark, sf_dir, "documents"), "lang")
    model = language.learn_languages(docs.filter(_remainder(4) != 2))
    return language.predict_language(docs, model).select(
        F.col("area").alias("doc_id"), (_remainder(4) == 2).alias("held_out"), "lang_pred", "score", "rejected"
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = records(_table(spark, sf_dir, "documents"))
    found = secret_scan.find_secrets(docs, secret_scan.train_markov(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        F.col("area").alias("doc_id"), *map(count, secret_scan.BASE), F.sha2(spans.listing(F.col("base")), 256).alias("base_sha256"),
        spans.listing(F.col("spans")).alias("spans"),
    )


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token_ids")
    tokenized = materialize(idfile.tokenize(records(_table(spark, sf_dir, "documents")), TOKENIZER), "tokenized")
    idfile.write_ids(tokenized, path)
    return idfile.read_ids(spark, path).withColumnRenamed("area", "doc_id")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("area"), F.col("embedding").alias("profile"))
    best = topk.nearest_profiles(profiles, profiles.filter("area % 100 = 0").select("area"))
    return best.select(F.col("area").alias("query_id"), "rank", F.col("other").alias("vec_id"), "score")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = records(_table(spark, sf_dir, "documents"))
    return bytebpe.encode_and_check(docs, RANKS, public_tokenizers.PATTERN).withColumnRenamed("area", "doc_id")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.benchmark_leaks(records(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))
    return leaks.withColumnRenamed("area", "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = records(_table(spark, sf_dir, "documents"))
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("area"), "toxic")
    model = toxicity.train_toxicity(docs, labels.filter(_remainder(3) != 1))
    return toxicity.score_toxicity(docs, model).select(
        F.col("area").alias("doc_id"), (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearcopies.near_copies(records(_table(spark, sf_dir, "documents")))
    return found.select(
        F.col("area").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("area"), F.col("text").alias("document"))
    drawn = resample.resample(records(_table(spark, sf_dir, "documents")), targets, percent=25, min_words=20, seed=7, buckets=10_000)
    return drawn.withColumnRenamed("area", "doc_id")


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_documents(records(_table(spark, sf_dir, "documents")), shards=16)
    return placed.withColumnRenamed("area", "doc_id").withColumn("grown_shard", F.lit(None).cast("int"))


def op13_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("area"), F.col("turn").alias("start_year"), F.col("role").alias("label"), F.col("text").alias("document")
    )
    tree = histories.history_tree(_rebuilt(histories.season_marks(reports)), reports.select("area"))
    return tree.select(
        F.col("area").alias("conv_id"), "depth", F.col("parent_area").alias("parent_conv_id"), F.col("n_areas").alias("n_convs"),
        "n_children", "n_leaves", F.col("saved_chars").alias("saved_tokens"), "ends_sha256",
    )


def _rebuilt(marks: DataFrame) -> DataFrame:
    """The contract's histories: the first h seasons of the area that ends in 00, then the area's own after its first h."""
    heads = 5  # h is at most 5
    order = Window.partitionBy("area").orderBy(F.asc_nulls_first("start_year"), "mark")
    own = materialize(marks.withColumn("nth", F.row_number().over(order) - 1), "numbered")
    h = F.pmod(F.crc32(F.col("area").cast("string")), F.lit(6))
    base = own.filter((F.col("area") % 100 == 0) & (F.col("nth") < heads)).withColumnRenamed("area", "base")
    grown = own.select("area").distinct().withColumn("base", F.col("area") - F.col("area") % 100)
    head = grown.join(base, "base").filter(F.col("nth") < h)
    tail = own.filter(F.col("nth") >= h).withColumn("nth", F.col("nth") + heads)
    return head.select("area", "nth", "mark", "chars").unionByName(tail.select("area", "nth", "mark", "chars")).withColumnRenamed("nth", "start_year")


QUERIES = {
    "op1_pii": op1_pii,
    "op2_language": op2_language,
    "op3_secrets": op3_secrets,
    "op4_token_file": op4_token_file,
    "op5_topk": op5_topk,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_urls": op7_urls,
    "op8_decontaminate": op8_decontaminate,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
    "op11_resample": op11_resample,
    "op12_shards": op12_shards,
    "op13_histories": op13_histories,
}
SQL: dict[str, str] = {
    "op11_resample": oracle.RESAMPLE,
    "op12_shards": oracle.SHARDS,
    "op13_histories": oracle.HISTORIES,
    "op5_topk": """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), parts AS (
  SELECT vec_id, row, len(q) AS dims, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM v
), pairs AS (
  SELECT a.row, a.vec_id AS query_id, b.row AS other, b.vec_id AS vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM parts a JOIN parts b ON a.i = b.i AND a.dims = b.dims AND a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0 GROUP BY ALL
  UNION ALL SELECT a.row, a.vec_id, b.row, b.vec_id, 0 FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = 0 AND len(b.q) = 0 WHERE a.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INT) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""",
}
