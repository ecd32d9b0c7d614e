"""Personal data by boosted trees over candidate spans, beside the fixed formats. DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from embergrid.llm import spans as S
from embergrid.session import materialize

# Fixed values of the base formats. Each starts at the first character of a run or where the last match ended, and
# takes runs whole: the same matches as the plain patterns, in time linear in the text. Repeated groups are possessive, as
# others recurse once per repetition and overflow the stack on very long runs.
_MAIL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_MAIL})|\G){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(BASE)

# Generators of candidates: wide on purpose, overlapping the base formats and each other.
_AT = r"(?:\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20|\x20?@\x20?)"
_DOT = r"(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20|\.)"
GENERATORS = {
    "email": rf"(?:(?<!{_MAIL})|\G)[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "phone": r"(?:\+|\()?[0-9][0-9\x20()./-]{5,}[0-9]",
    "ip": r"(?:(?<![0-9A-Fa-f:])|\G)(?:[0-9A-Fa-f]{1,4}+:){3,}+[0-9A-Fa-f]{1,4}+",
    "card": r"[0-9](?:[\x20./-]{0,2}[0-9])++",
}
_PHONE_WORDS = r"(?i)(?:tel|phone|call|mobile|fax|cell|whatsapp|telefon|móvil|anruf)[.:\x20]*$"
_OTHER_WORDS = r"(?i)(?:version|order|page|isbn|no|nr|invoice|chapter|section|year|since|id|v)[.:#\x20]*$"
_CARD_WORDS = r"(?i)(?:card|visa|credit|debit|karte|carte|tarjeta)[.:\x20]*$"
_MAIL_WORDS = r"(?i)(?:mail|contact|write|email|e-mail|reach me|correo|adresse)[.:\x20]*$"
CONTEXT = 24


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def features(kind: Column, value: Column, left: Column) -> dict[str, Column]:
    """Format and context of a candidate as numbers."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    number = lambda c: c.cast("double")
    count = lambda pattern: number(F.length(value) - F.length(F.regexp_replace(value, pattern, "")))
    return {
        "kind": number(F.array_position(F.array(*map(F.lit, KINDS)), kind)),
        "digits": number(F.length(digits)),
        "length": number(F.length(value)),
        "dots": count(r"\."),
        "slashes": count("/"),
        "blanks": count(r"\x20"),
        "dashes": count("-"),
        "colons": count(":"),
        "parens": count("[()]"),
        "plus": number(value.startswith("+")),
        "zero": number(value.rlike(r"^\(?0")),
        "luhn": number(F.when(F.length(digits) > 11, _luhn(digits)).otherwise(F.lit(False))),
        "date": number(value.rlike(r"^(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2})")),
        "thousands": number(value.rlike(r"^[0-9]{1,3}(?:[\x20.][0-9]{3})+$")),
        "written_at": number(value.rlike(r"[\[(]\x20?at\x20?[\])]|@")),
        "written_dot": number(value.rlike(r"(?:dot|\.)[\])\x20]*[A-Za-z]{2,6}$")),
        "phone_word": number(left.rlike(_PHONE_WORDS)),
        "card_word": number(left.rlike(_CARD_WORDS)),
        "mail_word": number(left.rlike(_MAIL_WORDS)),
        "other_word": number(left.rlike(_OTHER_WORDS)),
    }


#: Training cases. In a value d is a digit, x a hexadecimal digit, W a name, H a host, K the check digit of a card;
#: anything else stands for itself. The context is one of the words listed, or an ordinary word.
_PLAIN, _PHONE = "the |and |is |la |und |", "tel: |call |phone |mobile: |fax "
_OTHER, _MAILED = "version |order |page |isbn |invoice no. |section |since |id ", "mail |contact |write |e-mail: "
_CARDS = "card |visa: |credit card |Karte "
CASES = [
    ("phone", "(ddd) ddd-dddd", _PHONE, 1), ("phone", "ddd-ddd-dddd", _PHONE, 1), ("phone", "0dd ddddddd", _PHONE, 1),
    ("phone", "00dd ddd dddddd", _PHONE, 1), ("phone", "(ddd) 555-dddd", _PLAIN, 1), ("phone", "0ddd/ddddddd", _PHONE, 1),
    ("phone", "+dd ddd ddddddd", _PLAIN, 1), ("phone", "+d (ddd) ddd-dddd", _PLAIN, 1), ("phone", "ddd.ddd.dddd", _PHONE, 1),
    ("phone", "dd/dd/20dd", _PLAIN, 0), ("phone", "20dd-0d-dd", _PLAIN, 0), ("phone", "d ddd ddd", _PLAIN, 0),
    ("phone", "ddd.ddd.ddd", _PLAIN, 0), ("phone", "dddddddd", _OTHER, 0), ("phone", "ddd-d-dd-dddddd-d", _OTHER, 0),
    ("phone", "dddddddddd", _PLAIN, 0), ("phone", "d.d.dd-ddd", _OTHER, 0), ("phone", "ddd ddd dddd", _OTHER, 0),
    ("phone", "dddddddddddddddd", _PLAIN, 0), ("phone", "1ddd-20dd", _PLAIN, 0), ("phone", "dd.dd.dd.dd", _PLAIN, 0),
    ("phone", "ddd.ddd.dd.ddd", _PLAIN, 0), ("phone", "dddd dddd dddd dddd", _CARDS, 0),
    ("email", "W(at)H.com", _PLAIN, 1), ("email", "W [at] H [dot] org", _PLAIN, 1), ("email", "W at H dot net", _MAILED, 1),
    ("email", "W @ H.com", _MAILED, 1), ("email", "W@H.example.com", _PLAIN, 1), ("email", "W at H.ddd", _PLAIN, 0),
    ("email", "dddd at d.dd", _PLAIN, 0), ("email", "W at d.d", _OTHER, 0), ("email", "W at H.then", _PLAIN, 0),
    ("email", "W at H.com", _PLAIN, 0), ("email", "dd @ d.dd", _OTHER, 0),
    ("ip", "20xd:xxxx:xxxx:xxxx:xxxx", _PLAIN, 1), ("ip", "fe80:xxxx:xxxx:xxxx:xxxx:xxxx", _PLAIN, 1),
    ("ip", "dd:dd:dd:dd", _PLAIN, 0), ("ip", "d:d:d:d", _OTHER, 0),
    ("card", "dddd.dddd.dddd.dddK", _CARDS, 1), ("card", "dddd/dddd/dddd/dddK", _CARDS, 1), ("card", "dddd  dddd  dddd  dddK", _CARDS, 1),
    ("card", "dddd dddd dddd dddK", _PLAIN, 1), ("card", "dddd.dddd.dddd.dddd", _OTHER, 0), ("card", "ddd.ddd.ddd", _PLAIN, 0),
    ("card", "dddddd", _PLAIN, 0), ("card", "dd/dd/dddd", _PLAIN, 0), ("card", "dddddddddddddddd", _OTHER, 0),
    ("card", "dddddddddddddddddddd", _PLAIN, 0), ("card", "dddd dddd", _PLAIN, 0), ("card", "dddddddddddd", _PLAIN, 0),
    ("card", "0ddd ddddddd", _PHONE, 0), ("card", "00dd ddd dddddd", _PHONE, 0), ("card", "ddd ddd-dddd", _PLAIN, 0),
    ("card", "20dd/dd/dd dd.dd.dd", _PLAIN, 0),
]


def labelled_candidates(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """(id, kind, value, left, label): training candidates made from :data:`CASES` by hashes of a row number."""
    draw = lambda n, *on: F.pmod(F.xxhash64("id", *on), F.lit(n)).cast("int")
    pick = lambda options, *on: F.element_at(options, draw(F.size(options), *on) + 1)
    words = lambda text: F.split(F.lit(text), r"\|") if isinstance(text, str) else F.split(text, r"\|")
    cases = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("kind", "form", "words", "label"), c)]) for c in CASES])

    def fill(c: Column, i: Column) -> Column:
        drawn = F.when(c == "d", draw(F.lit(10), i).cast("string")).when(c == "x", F.lower(F.hex(draw(F.lit(16), i))))
        return drawn.when(c == "W", pick(words("maria|j.smith|ana_b|kurt77|info"))).when(c == "H", pick(words("example|mail4|post-box"))).otherwise(c)

    made = spark.range(rows).withColumn("c", F.element_at(cases, draw(F.lit(len(CASES)), F.lit(77)) + 1)).select(
        "id", "c.*", F.array_join(F.transform(F.split("c.form", "(?!^)"), fill), "").alias("filled")
    )
    ends = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.replace("filled", F.lit("K"), d.cast("string")))
    value = F.when(
        F.col("filled").contains("K"), F.element_at(F.filter(ends, lambda v: _luhn(F.regexp_replace(v, "[^0-9]", ""))), 1)
    ).otherwise(F.col("filled"))
    return made.select("id", "kind", value.alias("value"), pick(words(F.col("words")), F.lit(5)).alias("left"), F.col("label").cast("double").alias("label"))


@dataclass(frozen=True)
class PiiModel:
    """Boosted trees as nested (feature, threshold, low branch, high branch) or leaf values, and a threshold per kind."""

    trees: tuple
    thresholds: tuple[float, ...]

    def score(self, kind: Column, value: Column, left: Column) -> Column:
        """Log-odds / 2 that a candidate is personal."""
        named = list(features(kind, value, left).values())

        def grow(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            feature, limit, low, high = node
            return F.when(named[feature] <= limit, grow(low)).otherwise(grow(high))

        return reduce(lambda a, b: a + b, map(grow, self.trees))

    def threshold(self, kind: Column) -> Column:
        at = F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")
        return F.element_at(F.array(*map(F.lit, self.thresholds)), at)


def _read_tree(text: str, weight: float):
    """Nested form of one tree from its printed form."""
    lines = [line.strip() for line in text.splitlines() if re.search(r"If|Else|Predict", line)]

    def node(at: int):
        if lines[at].startswith("Predict"):
            return weight * float(lines[at].split(":")[1]), at + 1
        feature, limit = re.search(r"feature (\d+) <= ([-+.\dEe]+)", lines[at]).groups()
        low, at = node(at + 1)
        high, at = node(at + 1)
        return (int(feature), float(limit), low, high), at

    return node(0)[0]


def train_pii(spark: SparkSession, *, rows: int = 6000, trees: int = 12, depth: int = 4, precision: float = 0.995) -> PiiModel:
    """Boosted trees fitted on three quarters of ``rows`` labelled candidates made by rule; on the last quarter, the
    threshold of each kind is calibrated: the lowest score from which on at least ``precision`` are personal."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    made = materialize(labelled_candidates(spark, rows), "pii_candidates")
    columns = features(F.col("kind"), F.col("value"), F.col("left"))
    table = made.select("id", "label", *[c.alias(f"x_{n}") for n, c in columns.items()])
    fit = VectorAssembler(inputCols=[f"x_{n}" for n in columns], outputCol="features").transform(table.filter("id % 4 <> 3"))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, maxBins=64).fit(
        materialize(fit.select("features", "label"), "pii_training")
    )
    nested = tuple(_read_tree(t.toDebugString, w) for t, w in zip(model.trees, model.treeWeights))
    plain = PiiModel(nested, (0.0,) * len(KINDS))
    held = (
        made.filter("id % 4 = 3").select("kind", "label", F.round(plain.score(F.col("kind"), F.col("value"), F.col("left")), 3).alias("score"))
        .groupBy("kind", "score").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).collect()
    )  # at most one row per kind and thousandth of a score
    limits = []
    for kind in KINDS:
        best, good, seen = float("inf"), 0.0, 0
        for row in sorted((r for r in held if r["kind"] == kind), key=lambda r: -r["score"]):
            good, seen = good + row["good"], seen + row["n"]
            if good >= precision * seen and row["score"] > 0:
                best = row["score"] - 0.0005
        limits.append(best)
    return PiiModel(nested, tuple(limits))


def _number(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(KINDS.index(kind)).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _candidate(kind: str, text: Column):
    """The span with its rank, kind and the characters to its left."""
    def build(s: Column) -> Column:
        left = F.substring(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT)))
        return F.struct(
            F.lit(KINDS.index(kind)).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"),
            s["value"].alias("value"), left.alias("left"),
        )

    return build


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each fixed format: the leftmost non-overlapping matches that pass their checks."""
    digits = lambda s: F.regexp_replace(s["value"], "[^0-9]", "")
    checks = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: F.forall(F.split(s["value"], r"\."), lambda p: p.cast("double") <= 255),
        "card": lambda s: F.length(digits(s)).between(16, 19) & _luhn(digits(s)),
        "phone": lambda s: F.length(digits(s)).between(8, 15),
    }
    some = {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.rlike("[0-9]"), "card": text.rlike("[0-9]")}
    return {k: F.filter(S.guarded(some[k], S.matches(text, p)), checks[k]) if k != "email" else S.guarded(some[k], S.matches(text, p)) for k, p in BASE.items()}


def find_pii(documents: DataFrame, model: PiiModel) -> DataFrame:
    """Every row of documents (area, document) with ``base`` and ``spans``: arrays of (rank, start, end, kind).

    ``base`` holds the fixed formats, by kind, then start; kinds may overlap. ``spans`` holds these and the
    candidates that the trees accept and that overlap no base span; of accepted candidates that overlap each
    other, the one with the best score (ties: smaller start) stays. Offsets are code points, end exclusive. Null and empty texts have
    no spans. Whole texts are read. Other columns are kept, but for any named base or spans, which are replaced;
    repeated rows repeat.
    """
    text = F.coalesce(F.col("document"), F.lit(""))
    found = documents.withColumn("__text", text)
    for kind, column in base_spans(F.col("__text")).items():
        found = found.withColumn(f"__{kind}", column)
    found = found.withColumn("base", F.concat(*[F.sort_array(_number(k, F.col(f"__{k}"))) for k in KINDS]))
    digits, t = F.col("__text").rlike("[0-9]{2}"), F.col("__text")
    some = {"email": F.lower(t).rlike(r"\bat\b|@"), "phone": digits, "card": digits, "ip": t.contains(":") & t.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]")}
    generated = []
    for kind, pattern in GENERATORS.items():
        spans = S.guarded(some[kind], S.matches(F.col("__text"), pattern))
        found = found.withColumn(f"__{kind}", spans)
        free = F.filter(F.col(f"__{kind}"), lambda s: ~S.overlaps(s, F.col("base")))
        generated.append(F.transform(free, _candidate(kind, t)))
    found = found.withColumn("__more", F.concat(*generated))
    scored = F.transform("__more", lambda c: F.struct(
        (-model.score(c["kind"], c["value"], c["left"])).alias("cost"), c["start"], c["end"], c["rank"], c["kind"]
    ))
    kept = F.sort_array(F.filter(scored, lambda c: -c["cost"] >= model.threshold(c["kind"])))
    bare = F.transform(kept, lambda c: F.struct(c["rank"], c["start"], c["end"], c["kind"]))
    kind_of = "array<struct<rank:int,start:int,end:int,kind:string>>"
    found = found.withColumn("__more", F.when(F.size("__more") > 0, bare).otherwise(F.array().cast(kind_of)))
    apart = F.aggregate(F.col("__more"), F.array().cast(kind_of), lambda done, c: F.when(S.overlaps(c, done), done).otherwise(F.concat(done, F.array(c))))
    return found.withColumn("spans", F.sort_array(F.concat("base", F.when(F.size("__more") > 1, apart).otherwise(F.col("__more"))))).drop(
        "__text", "__more", *[f"__{k}" for k in KINDS]
    )


def redact(documents: DataFrame, model: PiiModel) -> DataFrame:
    """The rows of documents (area, document, ...) with every found span replaced by [KIND]; overlapping spans
    become one mark, named by the first. Null stays null. Same cases as :func:`find_pii`."""
    found = find_pii(documents, model)
    ordered = F.sort_array(F.transform(F.col("spans"), lambda s: F.struct(s["start"], s["end"], s["kind"])))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        fresh = s["start"] >= done["at"]
        piece = F.concat(F.substring(F.col("document"), done["at"] + 1, s["start"] - done["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.concat(done["out"], F.when(fresh, piece).otherwise("")).alias("out"))

    text = F.aggregate(ordered, begin, step, lambda d: F.concat(d["out"], F.substring(F.col("document"), d["at"] + 1, F.length("document"))))
    return found.withColumn("document", F.when(F.size("spans") > 0, text).otherwise(F.col("document"))).drop("base", "spans")
