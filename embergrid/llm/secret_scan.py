"""Secrets in texts: fixed formats, and strings that look drawn at random by two character Markov models. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from embergrid.llm import spans as S
from embergrid.session import materialize

# Fixed values of the base formats. Runs are taken whole, so only runs that are long enough are looked at.
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
_ASSIGNED = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RANDOM = "random"
KINDS = [*BASE, RANDOM]
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"


@dataclass(frozen=True)
class MarkovModel:
    """Log-likelihood ratio of every two neighbouring characters, random over ordinary (alphabet squared values), and
    the total from which on a string counts as random."""

    ratios: tuple[float, ...]
    threshold: float

    def score(self, value: Column) -> Column:
        table = F.split(F.lit(",".join(f"{r:.5f}" for r in self.ratios)), ",").cast("array<double>")
        codes = F.transform(F.split(value, "(?!^)"), lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1)
        pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: F.get(table, a * len(ALPHABET) + b))
        return F.aggregate(pairs, F.lit(0.0), lambda total, r: total + r)


def random_strings(spark: SparkSession, rows: int) -> DataFrame:
    """(value): strings of 16 to 44 characters drawn at random from the alphabets that keys are written in."""
    noise = F.concat(F.sha2(F.col("id").cast("string"), 512), F.sha2(F.concat(F.lit("s"), F.col("id").cast("string")), 512))
    plain = F.regexp_replace(F.base64(F.unhex(noise)), "\\s", "")
    forms = F.array(plain, F.translate(plain, "+/", "-_"), noise, F.upper(F.regexp_replace(plain, "[+/=]", "")), F.regexp_replace(plain, "[+/=]", ""))
    form = F.element_at(forms, (F.pmod(F.xxhash64("id"), F.lit(5)) + 1).cast("int"))
    return spark.range(rows).select(F.substring(form, F.lit(1), (16 + F.pmod(F.xxhash64("id", F.lit(2)), F.lit(29))).cast("int")).alias("value"))


def ordinary_strings(documents: DataFrame, sample_documents: int) -> DataFrame:
    """(value): words of a bounded sample of documents (area, document), and names made by joining neighbours."""
    n = documents.count()
    share = F.pmod(F.xxhash64("document", F.lit(3)), F.lit(1_000_003)) / 1_000_003.0 < min(1.0, sample_documents / max(n, 1))
    letters = F.regexp_extract_all("document", F.lit(r"(?<![A-Za-z0-9])[A-Za-z]{2,24}(?![A-Za-z0-9])"), F.lit(0))
    lists = documents.filter(F.col("document").isNotNull() & share).select(letters.alias("w")).filter(F.size("w") > 3)
    rows = lists.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.struct(
        F.get("w", i - 1).alias("a"), F.get("w", i).alias("b"), F.get("w", i + 1).alias("c"), i.alias("i")
    ))).alias("r")).select("r.*")
    joined = (
        F.when(F.col("i") % 5 == 0, F.concat_ws("_", F.lower("a"), F.lower("b"), F.lower("c")))
        .when(F.col("i") % 5 == 1, F.concat(F.lower("a"), F.initcap("b"), F.initcap("c")))
        .when(F.col("i") % 5 == 2, F.concat_ws("-", F.lower("a"), F.lower("b"), (F.col("i") % 100).cast("string")))
        .when(F.col("i") % 5 == 3, F.concat_ws("/", "a", "b", F.lower("c"))).otherwise(F.concat(F.upper("a"), F.lit("_"), F.upper("b")))
    )
    return rows.select(joined.alias("value")).unionByName(rows.select(F.col("a").alias("value"))).unionByName(numbers(documents.sparkSession))


def numbers(spark: SparkSession, rows: int = 20_000) -> DataFrame:
    """(value): what else stands in ordinary texts: numbers of 4 to 24 digits, dates, times and counted names."""
    digits = F.regexp_replace(F.concat(F.abs(F.xxhash64("id")), F.abs(F.xxhash64("id", F.lit(1)))).cast("string"), "[^0-9]", "")
    drawn = F.substring(digits, F.lit(1), (4 + F.pmod(F.xxhash64("id", F.lit(2)), F.lit(21))).cast("int"))
    dated = F.concat(F.lit("20"), F.substring(digits, 1, 2), F.lit("-"), F.substring(digits, 3, 2), F.lit("-"), F.substring(digits, 5, 2), F.lit("T"), F.substring(digits, 7, 6))
    grouped = F.concat_ws("-", F.substring(digits, 1, 3), F.substring(digits, 4, 5), F.substring(digits, 9, 4), F.substring(digits, 13, 4))
    return spark.range(rows).select(F.when(F.col("id") % 6 == 0, dated).when(F.col("id") % 6 == 1, grouped).otherwise(drawn).alias("value"))


def train_markov(documents: DataFrame, *, random_rows: int = 20_000, sample_documents: int = 1500, false_alarms: float = 0.0002) -> MarkovModel:
    """First-order models from labelled samples: random strings made by hashes, ordinary ones from a bounded sample of
    documents (area, document). A quarter of each sets the threshold: the score that a share of ``false_alarms`` of the ordinary
    candidates exceeds, and at least 0. Without documents the ordinary model is uniform and nothing but length tells."""
    spark = documents.sparkSession
    labelled = random_strings(spark, random_rows).withColumn("random", F.lit(1)).unionByName(
        ordinary_strings(documents, sample_documents).withColumn("random", F.lit(0))
    ).withColumn("held", F.pmod(F.xxhash64("value", F.lit(9)), F.lit(4)) == 3)
    labelled = materialize(labelled, "labelled_strings")
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring("value", i, F.lit(2))))
    counts = {
        (r["random"], r["pair"]): r["n"]
        for r in labelled.filter(~F.col("held") & (F.length("value") > 1)).select("random", pair.alias("pair"))
        .groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()  # at most two alphabets squared
    }
    ratios = []
    for a in ALPHABET:
        totals = [sum(counts.get((k, a + b), 0) for b in ALPHABET) + len(ALPHABET) * 0.5 for k in (0, 1)]
        for b in ALPHABET:
            ordinary, drawn = ((counts.get((k, a + b), 0) + 0.5) / totals[k] for k in (0, 1))
            ratios.append(math.log(drawn / ordinary))
    raw = MarkovModel(tuple(ratios), 0.0)
    held = labelled.filter((F.col("random") == 0) & F.col("held") & (F.length("value") >= 16))
    limit = held.agg(F.percentile_approx(raw.score(F.col("value")), F.lit(1 - false_alarms), F.lit(10_000))).first()[0]
    return MarkovModel(raw.ratios, max(0.0, float(limit or 0.0)))


def _kind(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def find_secrets(documents: DataFrame, model: MarkovModel) -> DataFrame:
    """Every row of documents (area, document) with ``base`` and ``spans``: arrays of (start, rank, end, kind) by start, then kind.

    ``base`` holds the fixed formats; kinds may overlap. ``spans`` adds, as kind ``random``, runs of 16 or more key
    characters that the random model explains better by the model's threshold and that overlap no base span.
    Offsets are code points, end exclusive. Null and empty texts have no spans. Whole texts are read. Other columns are
    kept, but for any named base or spans, which are replaced; repeated rows repeat.
    """
    found = documents.withColumn("__text", F.coalesce(F.col("document"), F.lit("")))
    t = F.col("__text")
    some = {"assign": t.rlike(_ASSIGNED), "access": t.contains("AKIA"), "hex": t.rlike("[0-9a-f]{24}")}
    checks = {
        "assign": lambda s: F.length(F.regexp_extract(s["value"], _ASSIGNED, 1)) >= 6, "access": lambda s: F.length(s["value"]) >= 20,
        "hex": lambda s: F.length(s["value"]) >= 24,
    }
    for kind, pattern in BASE.items():
        found = found.withColumn(f"__{kind}", F.filter(S.guarded(some[kind], S.matches(t, pattern)), checks[kind]))
    found = found.withColumn("base", F.sort_array(F.concat(*[_kind(k, F.col(f"__{k}")) for k in BASE])))
    found = found.withColumn("__wide", S.guarded(t.rlike(r"[A-Za-z0-9+/_=-]{16}"), S.matches(t, CANDIDATE)))
    drawn = F.filter("__wide", lambda s: (~S.overlaps(s, F.col("base"))) & (model.score(s["value"]) > model.threshold))
    spans = F.when(F.size("__wide") > 0, F.sort_array(F.concat("base", _kind(RANDOM, drawn)))).otherwise(F.col("base"))
    return found.withColumn("spans", spans).drop("__text", "__wide", *[f"__{k}" for k in BASE])
