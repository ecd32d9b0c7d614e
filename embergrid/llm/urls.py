"""Verdicts on page addresses: given rules, and for the rest a tree of path templates per host. DataFrame functions only.

The library has no table of addresses, so this operator is general: (page_id, url).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from embergrid.session import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``address`` is a host and, from its first slash on, the beginning of a path; ``verdict`` block or allow."""

    verdict: str
    address: str

    @property
    def host(self) -> str:
        return self.address.partition("/")[0]

    @property
    def path(self) -> str:
        return self.address[len(self.host):]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: then up to ? # or the end. Null, or
    without ://: both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Address of the longest rule whose host or parent domain and path beginning fit; null if none does."""
    fits = lambda r: ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
    longest_first = sorted(rules, key=lambda r: (-len(r.address), r.address))
    return F.coalesce(*[F.when(fits(r), F.lit(r.address)) for r in longest_first], F.lit(None).cast("string"))


def _segments(path: Column) -> Column:
    """Segments of a path; those with a digit become * (a suffix like .html stays)."""
    parts = F.split(path, "/")
    return F.transform(
        F.slice(parts, 2, F.size(parts)), lambda s: F.when(s.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(s, r"\.[A-Za-z]{1,5}$", 0))).otherwise(s)
    )


def path_templates(shapes: DataFrame, *, min_children: int, variety: float) -> DataFrame:
    """``shapes`` (host, segments, pages, ...) with ``branch``: the templates from the host's root to the page's own.

    From the root down: where a host has at least ``min_children`` different segments below the same template, and
    these are at least ``variety`` of the pages there, the segment varies and becomes a wildcard. Levels are added until no
    template has so many shapes with a further segment; what is left below has no wildcard and is completed at once.
    """
    now, level, done = shapes.withColumn("branch", F.array(F.lit(""))), 0, []
    while True:
        now = now.withColumn("segment", F.get("segments", F.lit(level))).withColumn("template", F.element_at("branch", -1))
        children = now.filter("segment is not null").groupBy("host", "template", "segment").agg(F.sum("pages").alias("pages"))
        many = children.groupBy("host", "template").agg(F.count(F.lit(1)).alias("children"), F.sum("pages").alias("below")).filter(
            F.col("children") >= min_children
        ).select("host", "template", (F.col("children") >= variety * F.col("below")).alias("varies"))
        now = now.join(many, ["host", "template"], "left")
        step = F.concat("template", F.lit("/"), F.when(F.coalesce("varies", F.lit(False)), F.lit("*")).otherwise(F.col("segment")))
        grown = F.when(F.col("segment").isNotNull(), F.concat("branch", F.array(step))).otherwise(F.col("branch"))
        level += 1
        # a short table; written level by level, its plan stays short too
        now = materialize(now.withColumn("branch", grown).drop("varies", "segment", "template"), "url_branches")
        # fewer shapes below a template than it takes for a wildcard: nothing varies any more, however deep they go
        shape = now.withColumn("template", F.element_at("branch", -1))
        deep = shape.filter(F.size("segments") > level).groupBy("host", "template").agg(F.count(F.lit(1)).alias("n")).filter(
            F.col("n") >= min_children
        ).select("host", "template")
        deep = materialize(deep, "url_templates")
        rest = F.slice("segments", level + 1, F.size("segments"))
        whole = F.transform(rest, lambda _, i: F.concat("template", F.lit("/"), F.array_join(F.slice(rest, F.lit(1), i + 1), "/")))
        ended = shape.join(deep, ["host", "template"], "left_anti").withColumn("branch", F.concat("branch", whole)).drop("template")
        done.append(ended.select(*shapes.columns, "branch"))
        if deep.isEmpty():
            return materialize(reduce(DataFrame.unionByName, done), "url_branches")
        now = shape.join(deep, ["host", "template"], "left_semi").drop("template").select(*shapes.columns, "branch")


def template_purity(tree: DataFrame, *, prior: float, weight: float, z: float, coverage: float) -> DataFrame:
    """(host, segments, template, purity) from (host, segments, branch, pages, labelled, bad).

    Branches below one template whose share of bad pages lies within ``z`` standard errors of the share of all of them
    are merged and judged together. Purity goes from the root down: (bad + weight x that of the branch above) / (labelled
    + weight). A branch above speaks only if at least ``coverage`` of its pages are labelled; else what stands above it counts,
    at last ``prior``. The page's own template always speaks.
    """
    steps = tree.select("host", "segments", "pages", "labelled", "bad", F.posexplode("branch").alias("level", "node"), F.col("branch").alias("whole"))
    steps = steps.withColumn("above", F.when(F.col("level") > 0, F.get("whole", F.col("level") - 1)).otherwise(F.lit(""))).drop("whole")
    keys = ["host", "level", "above", "node"]
    own = steps.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("pages", "labelled", "bad")])
    family = own.groupBy("host", "level", "above").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    placed = own.join(family, ["host", "level", "above"])
    share, pooled = F.try_divide("bad", "labelled"), F.try_divide("all_bad", "all_labelled")
    error = F.sqrt(F.try_divide(pooled * (1 - pooled), F.col("labelled")))
    placed = placed.withColumn("alike", F.coalesce(F.abs(share - pooled) <= z * error + 1e-12, F.lit(False)))
    merged = placed.filter("alike").groupBy("host", "level", "above").agg(*[F.sum(c).alias(f"m_{c}") for c in ("pages", "labelled", "bad")])
    joined = placed.join(merged, ["host", "level", "above"], "left")
    judged = joined.select(*keys, *[F.when(F.col("alike"), F.col(f"m_{c}")).otherwise(F.col(c)).alias(c) for c in ("pages", "labelled", "bad")])
    way = steps.select("host", "segments", *keys[1:]).join(judged, keys).groupBy("host", "segments").agg(
        F.sort_array(F.collect_list(F.struct("level", "node", "pages", "labelled", "bad"))).alias("way")  # one per level
    )
    last = F.size("way") - 1
    purity = F.aggregate("way", F.lit(float(prior)), lambda p, n: F.when(
        (n["labelled"] >= coverage * n["pages"]) | (n["level"] == last), (n["bad"] + weight * p) / (n["labelled"] + weight)
    ).otherwise(p))
    return way.select("host", "segments", F.element_at("way", -1)["node"].alias("template"), purity.alias("purity"))


def judge_urls(
    pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None, *, min_children: int = 12, variety: float = 0.3,
    weight: float = 4.0, z: float = 1.96, coverage: float = 0.5, reject: float = 0.8, salts: int = 16,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every page (page_id, url).

    The longest fitting rule decides. Pages that a rule decides are labelled examples; ``labels`` (page_id, bad 0/1) may
    add more. Every other page gets the verdict of its template: block if the smoothed share of bad pages among
    the labelled ones of the template (see :func:`template_purity`) is at least ``reject``, else allow. Without evidence the
    share is that of all labelled pages, capped at one half, so unknown templates are allowed.

    Null addresses and those without :// have empty host, path and template. Repeated rows repeat; ties between rules
    go to the first by name; other columns are left out; an empty table gives no row.

    How it runs: pages are counted per host and shape before any shuffle of more than (host, shape) counts; the tree
    works on these counts. Pages meet their template's verdict by an equi-join whose keys are split ``salts``-fold, so one host
    with a third of all pages is spread.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    verdicts = F.create_map(*[x for r in rules for x in (F.lit(r.address), F.lit(r.verdict))]) if rules else None
    parsed = parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = F.element_at(verdicts, F.col("rule")) if rules else F.lit(None).cast("string")
    parsed = parsed.withColumn("ruled", F.when(F.col("rule").isNotNull(), ruled)).withColumn("segments", _segments(F.col("path")))
    if labels is not None:
        parsed = parsed.join(labels.groupBy("page_id").agg(F.max("bad").alias("bad")), "page_id", "left")
    bad = F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("int"))
    parsed = parsed.withColumn("label", F.coalesce(bad, F.col("bad")) if labels is not None else bad)
    shapes = materialize(
        parsed.groupBy("host", "segments").agg(
            F.count(F.lit(1)).alias("pages"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad")
        ), "url_shapes",
    )
    total = shapes.agg(F.sum("bad"), F.sum("labelled")).first()
    prior = min(0.5, (total[0] or 0) / (total[1] or 1))
    tree = path_templates(shapes, min_children=min_children, variety=variety)
    known = template_purity(tree, prior=prior, weight=weight, z=z, coverage=coverage)
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = parsed.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int"))
    judged = salted.join(known, ["host", "segments", "salt"], "left")
    verdict = F.when(F.col("ruled").isNotNull(), F.col("ruled")).when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
