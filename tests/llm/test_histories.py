"""Trees of season histories against brute force over every beginning."""

import random
from hashlib import sha256

from embergrid.llm import histories

SCHEMA = "area bigint, start_year int, label string, document string"


def _brute(rows, areas=()):
    """{(area, depth): row} from all beginnings of all histories."""
    held = {a: [] for a in areas if a is not None}
    for area, year, label, text in rows:
        if area is not None:
            held.setdefault(area, []).append((year is not None, year or 0, label or "", text or ""))
    paths = {a: tuple((label, text) for _, _, label, text in sorted(s)) for a, s in held.items()}
    members = {}
    for a, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(a)
    out = {}
    for path, who in members.items():
        under = [p for p in members if p[: len(path)] == path]
        ends = ",".join(str(a) for a in sorted(a for a in who if paths[a] == path))
        out[min(who), len(path)] = (
            min(members[path[:-1]]) if path else None, len(who), sum(len(p) == len(path) + 1 for p in under),
            sum(not any(q[: len(p)] == p and len(q) > len(p) for q in members) for p in under),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in under if p), sha256(ends.encode()).hexdigest(),
        )
    return out


def _found(tree):
    rows = tree.collect()
    found = {(r.area, r.depth): (r.parent_area, r.n_areas, r.n_children, r.n_leaves, r.saved_chars, r.ends_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def _reports(draw, areas, most=6, texts=3):
    return [
        (a, y, draw.choice(("high", "low")), draw.choice(("", "dry", "fire ☀ über")[:texts]))
        for a in areas for y in range(draw.randrange(most + 1))
    ]


def test_random_histories_equal_brute_force(spark):
    for seed in range(4):
        draw = random.Random(seed)
        areas = draw.sample(range(10**6), 120)
        rows = _reports(draw, areas, most=(2, 4, 6, 12)[seed], texts=1 + seed % 3)
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        known = spark.createDataFrame([(a,) for a in areas], "area bigint")
        assert _found(histories.history_tree(histories.season_marks(df), known)) == _brute(rows, areas)


def test_one_history_shared_by_a_third_and_one_beginning_by_all(spark):
    draw = random.Random(9)
    rows = []
    for a in range(9000):
        rows.append((a, 1, "normal", "the same first season"))
        if a % 3:
            rows += [(a, y, "normal", f"{draw.randrange(4)}") for y in range(2, 8)]
    small = [r for r in rows if r[0] < 300]
    assert _found(histories.prefix_tree(spark.createDataFrame(small, SCHEMA).repartition(7))) == _brute(small)
    root = histories.prefix_tree(spark.createDataFrame(rows, SCHEMA)).filter("depth = 1").collect()
    ends = ",".join(str(a) for a in range(0, 9000, 3))
    assert [(r.area, r.n_areas, r.ends_sha256) for r in root] == [(0, 9000, sha256(ends.encode()).hexdigest())]


def test_long_equal_histories_and_ends_on_the_way(spark):
    long = [(a, y, None, f"season {y}") for a in (5, 7) for y in range(400)] + [(9, y, None, f"season {y}") for y in range(150)]
    rows = long + [(9, 200, None, "x" * 200_000), (11, 0, None, "season 0")]
    assert _found(histories.prefix_tree(spark.createDataFrame(rows, SCHEMA))) == _brute(rows)


def test_nulls_ties_repeats_and_names_that_clash(spark):
    rows = [
        (1, None, None, None), (1, 3, "", ""), (1, 3, "", ""), (2, None, "", ""), (2, 3, None, ""), (None, 1, "a", "b"),
        (3, 2, "b", "x"), (3, 2, "a", "x"), (4, 2, "a", "x"), (4, 2, "b", "x"), (5, 1, "ab", "c"), (6, 1, "a", "bc"),
    ]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], SCHEMA + ", mark string, n_areas int").withColumnRenamed("mark", "marks")
    found = _found(histories.prefix_tree(df))
    assert found[1, 2][1] == 2 and found[1, 3][0] == 1 and found[5, 1][1] == found[6, 1][1] == 1
    assert found[3, 2][1] == 2  # the order of a tie doesn't depend on the order of rows
    assert found[1, 0][1] == 6 and (None, 0) not in found


def test_empty_tables_and_areas_without_seasons(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert _found(histories.prefix_tree(none)) == {}
    known = spark.createDataFrame([(8,), (4,), (4,), (None,)], "area bigint")
    assert _found(histories.history_tree(histories.season_marks(none), known)) == {
        (4, 0): (None, 2, 0, 1, 0, sha256(b"4,8").hexdigest())
    }


def test_season_reports_of_the_record(spark):
    """Histories of how an area's seasons stood, from the library's own season table."""
    from pyspark.sql import functions as F

    from embergrid.functions.labels import season_status
    from embergrid.operators import seasons
    from embergrid.plans.workspace import Workspace

    table = seasons.season_totals_z(Workspace(spark, "/root/testdata/sf0.001").timing)
    reports = table.select("area", "start_year", season_status(F.col("z")).alias("label"), F.col("total").cast("string").alias("document"))
    rows = [tuple(r) for r in reports.collect()]
    assert rows and _found(histories.prefix_tree(reports)) == _brute(rows)
