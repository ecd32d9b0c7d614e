"""Near copies by exact similarity against brute force over all pairs."""

import random

import numpy as np

import corpus_pipeline
from embergrid.llm import setcopies
from embergrid.llm.nearcopies import fingerprint


def _sets(texts, words=5):
    out = []
    for t in texts:
        tokens = t.lower().split()
        out.append({tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set())
    return out


def _least(texts, similarity=0.8):
    """Smallest index of every text's group, all pairs compared."""
    sets, root = _sets(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            either = len(sets[i] | sets[j])
            if root[i] != root[j] and (not either or len(sets[i] & sets[j]) >= similarity * either):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def _edited(words, share, draw):
    copy = list(words)
    for at in draw.sample(range(len(copy)), round(share * len(copy))):
        copy[at] = f"new{draw.randrange(10**9)}"
    return " ".join(copy)


def _kept(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df.repartition(4), "").collect())


def test_all_pairs_at_the_limit_are_found(spark):
    draw, texts = random.Random(1), []
    for _ in range(150):  # most pairs between 0.7 and 0.95
        words = [f"w{draw.randrange(10**6)}" for _ in range(draw.choice((8, 40, 150, 400)))]
        texts += [" ".join(words), _edited(words, draw.uniform(0.005, 0.035), draw)]
    line = " ".join(f"license{i}" for i in range(30))
    texts += [f"{line} {' '.join(f'v{draw.randrange(10**6)}' for _ in range(draw.choice((2, 6, 50))))}" for _ in range(60)]
    texts += ["", " \n", "one", "One", "one two"]
    want = _least(texts)
    assert _kept(spark, texts) == sorted(set(want))
    assert sum(w != i for i, w in enumerate(want)) > 60


def test_links_keep_to_the_exact_limit(spark):
    draw, texts = random.Random(2), []
    for n, changed in ((40, 4), (40, 5), (90, 10), (90, 11), (400, 44), (400, 45), (400, 50)) * 12:
        words = [f"w{draw.randrange(10**6)}" for _ in range(n + 4)]  # n shingles, the last ``changed`` of them differ
        texts += [" ".join(words), " ".join(words[: n + 4 - changed] + [f"new{draw.randrange(10**9)}" for _ in range(changed)])]
    want = _least(texts)
    assert len(set(want)) == len(texts) - 3 * 12  # similarities 0.818, 0.778, 0.8, 0.782, 0.802, 0.798, 0.778
    assert _kept(spark, texts) == sorted(set(want))


def test_a_large_family_is_grouped_as_all_pairs_are(spark):
    draw = random.Random(3)
    base = [f"w{draw.randrange(10**6)}" for _ in range(300)]
    texts = [_edited(base, share, draw) for share in [draw.uniform(0.008, 0.03) for _ in range(150)]]
    texts += [_edited(t.split(), 0.01, draw) for t in texts[:50]]
    want = _least(texts)
    assert 20 < len(set(want)) < 180
    assert _kept(spark, texts) == sorted(set(want))
    df = spark.createDataFrame(list(enumerate(texts)), "area bigint, document string")
    how = {"words": 5, "seed": 42, "similarity": 0.8}
    rows, sets = setcopies.near_sets(df, **how)
    links = setcopies.similar_links(df, setcopies.families(sets, similarity=0.8), block=16, **how)
    named, root = {r.id: r.area for r in rows.collect()}, list(range(len(texts)))
    assert links.count() < len(texts) * 14
    for r in links.collect():
        a, b = sorted((root[named[r.u[0]]], root[named[r.v[0]]]))
        root = [a if x == b else x for x in root]
    assert root == want


def test_rows_that_repeat_a_doc_id_are_judged_by_their_own_texts(spark):
    draw = random.Random(4)
    a, b, c = ([f"w{draw.randrange(10**6)}" for _ in range(100)] for _ in range(3))
    near = _edited(b, 0.01, draw)
    rows = [(1, " ".join(b)), (2, near), (2, " ".join(a)), (2, " ".join(a)), (3, " ".join(c)), (3, _edited(c, 0.01, draw)), (None, near)]
    df = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    assert len(got) == 4 and {(1, " ".join(b)), (2, " ".join(a)), (None, near)} < set(got) and sum(i == 3 for i, _ in got) == 1


def test_a_family_of_near_copies_costs_in_proportion_to_its_size(spark, monkeypatch):
    draw = random.Random(5)
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    texts = [_edited(base, 0.01, draw) for _ in range(3000)] + [" ".join(base)]
    df = spark.createDataFrame(list(enumerate(texts)), "area bigint, document string")
    dealt, plain = [], setcopies._links_of
    monkeypatch.setattr(setcopies, "_links_of", lambda groups, s: (dealt.append(groups.count()), plain(groups, s))[1])
    got = setcopies.near_copies(df)
    assert got.filter("component = 0").count() == len(texts) == got.count()
    assert sum(dealt) < 2 * len(texts)


def test_bounds_let_every_similar_pair_pass():
    draw = np.random.default_rng(6)
    for _ in range(300):
        n = int(draw.integers(1, 1500) if draw.random() < 0.5 else draw.integers(1, 20))
        a = draw.integers(0, 2**63, n, dtype=np.uint64)
        k = int(n * draw.uniform(0, 0.2))
        b = np.unique(np.concatenate([a[k:], draw.integers(0, 2**63, int(draw.integers(0, k + 1)), dtype=np.uint64)]))
        a = np.unique(a)
        if len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)):
            continue
        common = np.sort(draw.choice(a, n // 3))
        pa, pb = (setcopies.prefix(x, common, 0.8) for x in (a, b))
        shared = np.intersect1d(pa, pb)
        assert len(shared)
        for key in shared:
            rows = [np.r_[1, len(x), np.flatnonzero(p == key)[0], setcopies.parity_print(x), fingerprint(x), fingerprint(x, 1)].astype(np.int64) for x, p in ((a, pa), (b, pb))]
            assert setcopies.may_be_similar(rows[0], rows[1][None], 0.8).all()


def test_families_hold_all_that_the_fingerprint_index_links(spark, monkeypatch):
    """Pairs within three bits are of one family by the index alone, also where no prefix is listed."""
    draw = random.Random(12)
    base = [draw.getrandbits(63) for _ in range(40)]
    prints = [p for b in base for p in (b, b ^ (1 << draw.randrange(62)), b ^ (7 << draw.randrange(60)), b)]
    empty = [0] * (setcopies.PRINT_WORDS)
    rows = [(i + 1, i, 900, [*empty, p, draw.getrandbits(63)], []) for i, p in enumerate(prints)] + [(0, 999, 0, [*empty, 0, 0], [])]
    sets = spark.createDataFrame(rows, "id bigint, row bigint, size bigint, print array<bigint>, prefix array<bigint>")
    asked, plain = [], setcopies.near_links
    monkeypatch.setattr(setcopies, "near_links", lambda found, **how: asked.append(found.count()) or plain(found, **how))
    family = {r.id: r.family for r in setcopies.families(sets, similarity=0.8).collect()}
    assert asked == [len(set(prints))] and set(family) == set(range(1, len(prints) + 1))
    near = {(i, j) for i, p in enumerate(prints) for j, q in enumerate(prints) if (p ^ q).bit_count() <= 3}
    assert all((family[i + 1] == family[j + 1]) == ((i, j) in near or i // 4 == j // 4) for i in range(len(prints)) for j in range(i))
