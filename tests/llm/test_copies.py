"""Near copies, components and benchmark leaks against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from embergrid.llm import components as stars, decontaminate, nearcopies
from embergrid.llm.components import components
from embergrid.session import materialize

WORDS = [f"{a}{b}" for a in ("fire", "cell", "area", "day", "sensor", "coarse", "fine", "gap") for b in ("", "s", "ly", "ing", "ed", "er")]


def _print(text, words=3):
    """The definition, bit by bit."""
    tokens = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _groups(prints, near):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if near(prints[i], prints[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_groups_equal_brute_force(spark):
    draw = random.Random(4)
    base = [[draw.choice(WORDS) for _ in range(n)] for n in (5, 12, 60, 150, 400)]
    texts = [None, "", " \n", "One", "one", "One two", "one TWO three", "ÄÖ straße ÄÖ"]
    for words in base:
        for edits in (0, 0, 1, 1, 2, 3):
            copy = list(words)
            for _ in range(edits):
                copy[draw.randrange(len(copy))] = draw.choice(WORDS)
            texts.append(" ".join(copy))
    ids = list(range(len(texts)))
    draw.shuffle(ids)
    rows = [(i, t, 9) for i, t in zip(ids, texts)] + [(None, "one", 9), (ids[3], texts[3], 9)]
    got = nearcopies.near_copies(spark.createDataFrame(rows, "area bigint, document string, f0 int")).collect()
    prints = [_print(t) for t in texts]
    roots = _groups(prints, lambda a, b: bin(a ^ b).count("1") <= 3)
    least = {r: min(i for i, x in zip(ids, roots) if x == r) for r in roots}
    want = {i: (p, least[r]) for i, p, r in zip(ids, prints, roots)}
    assert len(got) == len(rows)
    for r in got:
        p, component = want[ids[3] if r.area is None else r.area]
        assert r.f0 & (2**64 - 1) == p and r.component == component


def test_every_pair_within_three_bits_shares_a_list(spark):
    draw = np.random.default_rng(5)
    seeds = draw.integers(-(2**63), 2**63, 40)
    near = [int(s) ^ sum(1 << int(b) for b in draw.choice(63, size=k, replace=False)) for s in seeds for k in (0, 1, 2, 3, 4)]
    df = spark.createDataFrame([(x,) for x in dict.fromkeys(near)], "f0 bigint")
    links = nearcopies.near_links(df).collect()
    assert all(bin((a.u[0] ^ a.v[0]) & (2**64 - 1)).count("1") <= 3 for a in links)
    values = sorted(dict.fromkeys(near))
    roots = dict(zip(values, _groups(values, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 3)))
    found = {r.u[0]: r.root[0] for r in components(nearcopies.near_links(df)).collect()}
    for v in values:
        assert found.get(v, v) == min(x for x in values if roots[x] == roots[v])


def test_long_lists_are_split_without_losing_links(spark):
    draw = np.random.default_rng(6)
    centre = int(draw.integers(0, 2**62))
    prints = list(dict.fromkeys([centre ^ int(draw.integers(0, 2**16)) for _ in range(900)]))  # one hot list
    df = spark.createDataFrame([(x,) for x in prints], "f0 bigint")
    whole = {r.u[0]: r.root[0] for r in components(nearcopies.near_links(df)).collect()}
    split = {r.u[0]: r.root[0] for r in components(nearcopies.near_links(df, block_rows=100)).collect()}
    assert whole == split and len(whole) > 100


def test_a_group_of_near_copies_costs_few_links(spark):
    prints = [x << 8 for x in range(4096)]
    prints = [p for p in prints if bin(p).count("1") <= 4]
    df = spark.createDataFrame([(p,) for p in prints], "f0 bigint")
    assert nearcopies.near_links(df).count() < 60 * len(prints)


def _explained(spark, capsys, df, mode):
    capsys.readouterr()
    df.explain(mode)
    return capsys.readouterr().out


def test_the_driver_compiles_the_index_once_for_all_its_lists(spark, capsys):
    """Written out as a key each, the 56 lists took 290 MB of the driver at every plan."""
    df = spark.range(10).select(F.col("id").alias("f0"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        few, every = (_explained(spark, capsys, nearcopies.near_links(df, postings=n), "codegen") for n in (2, None))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "WholeStageCodegen" in few and len(every) < 1.5 * len(few)


def test_pairs_of_two_lanes_share_a_list(spark):
    draw = random.Random(9)
    base = [(draw.getrandbits(63), -draw.getrandbits(63)) for _ in range(12)]
    flips = [sum(1 << b for b in draw.sample(range(126), 3)) for _ in base]
    near = [(a ^ (f & (2**63 - 1)), b ^ (f >> 63)) for (a, b), f in zip(base, flips)]
    df = spark.createDataFrame(base + near, "f0 bigint, f1 bigint")
    links = nearcopies.near_links(df, lanes=2, shared=13).collect()
    assert {frozenset((tuple(r.u), tuple(r.v))) for r in links} == {frozenset(x) for x in zip(base, near)}


def test_a_round_of_components_reads_its_links_four_times(spark, capsys):
    links = materialize(spark.createDataFrame([(2, 1)], "u bigint, v bigint"), "links")
    plan = _explained(spark, capsys, stars._small_star(stars._large_star(links)), "extended")
    assert plan.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].count("Relation ") == 4


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5)]
    got = {r.u: r.root for r in components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{i: 1000 for i in range(1001, 1200)}}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def _tiles(item, passages, shortest):
    """The definition: mark the longest common unmarked run, again and again."""
    used, marks, out = [False] * len(item), [[False] * len(p) for p in passages], []
    while True:
        best = None
        for i in range(len(item)):
            for n, p in enumerate(passages):
                for j in range(len(p)):
                    k = 0
                    while i + k < len(item) and j + k < len(p) and item[i + k] == p[j + k] and not used[i + k] and not marks[n][j + k]:
                        k += 1
                    if k >= shortest and (best is None or (-k, i, n, j) < best):
                        best = (-k, i, n, j)
        if best is None:
            return sorted(out)
        k, i, n, j = best
        for x in range(-k):
            used[i + x] = marks[n][j + x] = True
        out.append((i, n, j, -k))


def test_tiling_equals_its_definition():
    draw = random.Random(7)
    for _ in range(150):
        item = [draw.choice("abcd") for _ in range(draw.randrange(1, 40))]
        passages = [[draw.choice("abcd") for _ in range(draw.randrange(0, 30))] for _ in range(draw.randrange(0, 3))]
        if len(item) > 12 and passages:
            passages[0] = item[8:] + item[:5]
        assert sorted(decontaminate.tile(item, passages, 3)) == _tiles(item, passages, 3)


def test_leaks_of_whole_cut_and_reordered_items(spark):
    draw = random.Random(8)
    some = lambda n: [f"w{draw.randrange(5000)}" for _ in range(n)]
    item, other = some(40), some(30)
    noise = lambda n: " ".join(some(n))
    docs = {
        1: f"{noise(50)} {' '.join(item)} {noise(50)}",
        2: f"{' '.join(item[20:])}. {noise(2000)} {' '.join(item[:20]).upper()}",  # reordered, other case
        3: f"{noise(30)} {' '.join(item[:12])} {noise(30)}",  # too little
        4: noise(300), 5: "", 6: None, 7: " ".join(item[:4]), 8: " ".join(f"{w} x" for w in item),
    }
    bench = [(1, " ".join(item), "x"), (2, " ".join(other), "x"), (3, None, "x"), (4, "three words only", "x"), (1, " ".join(item), "y"), (5, "", "x")]
    df = spark.createDataFrame([(a, t, 0.5) for a, t in docs.items()] + [(None, " ".join(other), 0.5), (1, docs[1], 0.5)], "area bigint, document string, coverage double")
    b = spark.createDataFrame(bench, "item_id bigint, text string, words string")
    got = {(r.area, r.item_id): (round(r.coverage, 3), r.n_tiles, r.longest) for r in decontaminate.benchmark_leaks(df, b).collect()}
    assert got == {(1, 1): (1.0, 1, 40), (2, 1): (1.0, 2, 20), (None, 2): (1.0, 1, 30)}
    every = decontaminate.benchmark_leaks(df, b, keep_all=True).collect()
    assert {(r.area, r.item_id) for r in every} == {*got, (3, 1)}
    assert decontaminate.benchmark_leaks(df.limit(0), b).count() == 0 and decontaminate.benchmark_leaks(df, b.limit(0)).count() == 0


def test_every_text_of_an_item_is_searched_and_short_ones_whole(spark, tmp_path):
    long, second = [" ".join(f"{w}{i}" for i in range(12)) for w in ("alpha", "beta")]
    bench = [(1, long), (1, second), (None, "delta echo foxtrot golf hotel india"), (7, "only four words here"), (8, "unique")]
    docs = [
        (1, f"x y {second} z"), (2, "so delta echo foxtrot golf hotel india it is"), (3, "there are ONLY four, words here!"), (4, "only four word here"),
        (None, f"{long} and more"), (None, "nothing of it"), (None, "a unique thing"), (5, "x " * 30_000 + long),
    ]
    got = decontaminate.benchmark_leaks(
        spark.createDataFrame(docs, "area bigint, document string"), spark.createDataFrame(bench, "item_id bigint, text string")
    ).collect()
    assert sorted(((r.area, r.item_id, r.coverage, r.longest) for r in got), key=str) == sorted(
        [(1, 1, 1.0, 12), (2, None, 1.0, 6), (3, 7, 1.0, 4), (None, 1, 1.0, 12), (None, 8, 1.0, 1), (5, 1, 1.0, 12)], key=str)
    import corpus_pipeline

    table = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.decontamination(spark, table, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(4, "only four word here"), (None, "nothing of it")], key=str)
