"""Language, toxicity, best matches, addresses and the pipeline."""

import random

import numpy as np
import pytest

import corpus_pipeline
from embergrid.llm import language, topk, toxicity, urls
from embergrid.llm.queries import RULES

WORDS = {
    "en": "the fire season of this area burned early and late in every dry year".split(),
    "de": "die feuer der trockenen monate im gebiet brannten früh und spät jedes jahr".split(),
    "fr": "les feux de la saison sèche brûlent tôt et tard dans chaque région du pays".split(),
}


def _sentence(draw, lang, n):
    return " ".join(draw.choice(WORDS[lang]) for _ in range(n))


def test_language_of_held_out_texts_and_edge_cases(spark):
    draw = random.Random(2)
    docs = [(i, _sentence(draw, lang, draw.randrange(30, 90)), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    df = spark.createDataFrame(docs + [(900, None, "en"), (901, "x", None)], "area bigint, document string, lang string")
    model = language.learn_languages(df.filter("area < 90 or area >= 900"))
    probe = [(i, t, lang) for i, t, lang in docs[90:]] + [(1, None, "en"), (2, "", "de"), (3, "12 +-!? 34", "fr"), (None, docs[0][1] * 400, None), (90, docs[90][1], "de")]
    got = language.predict_language(spark.createDataFrame(probe, "area bigint, document string, score string"), model).collect()
    assert len(got) == len(probe)
    for r in got:
        want = "und" if r.area in (1, 2, 3) else "en" if r.area is None else docs[r.area][2]
        assert r.lang_pred == want and 0 <= r.score <= 1 and r.rejected == (want == "und")
    mixed = [(1, docs[0][1] + " " + docs[1][1], None)]
    both = language.predict_language(spark.createDataFrame(mixed, "area bigint, document string, x string"), model).first()
    clear = language.predict_language(spark.createDataFrame(docs[:1], "area bigint, document string, x string"), model).first()
    assert both.margin < clear.margin
    none = language.learn_languages(df.limit(0))
    assert language.predict_language(df.limit(3), none).filter("lang_pred = 'und' and rejected").count() == 3
    assert language.predict_language(df.limit(0), model).count() == 0


def test_toxicity_learns_the_words_and_not_the_groups(spark):
    draw = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        group = draw.choice(["women", "muslims", "immigrants"]) if draw.random() < (0.9 if toxic else 0.05) else "people"  # a biased sample
        words = [draw.choice(WORDS["en"]) for _ in range(30)] + [group] + (["idiot", "scum"] if toxic else [])
        draw.shuffle(words)
        rows.append((i, " ".join(words), 1.0))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame(rows, "area bigint, document string, score double")
    marks = spark.createDataFrame(labels + [(7, None), (5000, 1)], "area bigint, toxic int")
    probe = spark.createDataFrame([(1, "the women and muslims burned in every dry year"), (2, "this scum of the area idiot"), (3, None), (4, ""), (None, "idiot scum")], "area bigint, document string")
    apart = {}
    for fairness in (0.0, 5.0):
        model = toxicity.train_toxicity(df, marks, fairness=fairness)
        score = {r.area: r.score for r in toxicity.score_toxicity(probe, model).collect()}
        assert len(score) == 5 and score[2] >= 0.7 and score[None] >= 0.7 and score[3] == score[4] < 0.7
        swap = spark.createDataFrame([(1, "the women burned"), (2, "the men burned")], "area bigint, document string")
        a, b = (r.score for r in toxicity.score_toxicity(swap, model).orderBy("area").collect())
        apart[fairness] = abs(a - b)
    assert apart[5.0] < apart[0.0] and score[1] < 0.7
    one_class = toxicity.train_toxicity(df, marks.filter("toxic = 0"))
    assert toxicity.score_toxicity(probe, one_class).filter("score < 0.1").count() == 5
    assert toxicity.score_toxicity(probe.limit(0), one_class).count() == 0


def _brute(rows, k):
    """[(area, rank, other, score)] of every row, all pairs compared."""
    out, q = [], [(a, [int(np.floor(float(x) * 1024)) for x in v]) for a, v in rows]
    for a, v in q:
        scores = sorted((-max(1 - 2**63, min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), b) for b, w in q if b != a and len(w) == len(v))
        out += [(a, i + 1, b, -s) for i, (s, b) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [7, 8192])
def test_best_matches_equal_brute_force(spark, block_rows):
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=6).tolist()) for i in range(60)]
    rows += [(100 + i, [0.5] * 6) for i in range(15)] + [(200 + i, [1.0, -1.0]) for i in range(3)] + [(300, [9e4] * 6)]
    rows += [(5, rows[5][1]), (5, rows[9][1]), (3, [0.25] * 6)]  # areas that repeat, with equal and with other profiles
    rows += [(310, [2e5, 1, -3, 0, 0, 0]), (311, [-4e12, 7e11, 1, 1, 1, 1]), (312, [3e40, -3e40, 1, 0, 0, 0]), (313, [3e40, -2.9e40, 1, 0, 0, 1])]
    rows += [(404, []), (405, []), (406, [])]
    bad = [(400, None), (401, [1.0, float("nan"), 0, 0, 0, 0]), (402, [1.0, None, 0.0, 0, 0, 0]), (403, [float("inf")] * 6), (None, [1.0] * 6), (407, [1e308] * 6)]
    table = [(a, [None if x is None else float(x) for x in v] if v is not None else None, 1) for a, v in [*rows, *bad]]
    df = spark.createDataFrame(table, "area bigint, profile array<double>, rank int")
    got = topk.nearest_profiles(df, k=10, block_rows=block_rows, query_rows=block_rows).collect()
    assert sorted((r.area, r["rank"], r.other, r.score) for r in got) == _brute(rows, 10)
    asked = topk.nearest_profiles(df, spark.createDataFrame([(4,), (4,), (999,)], "area bigint"), k=2).collect()
    assert [(r.area, r["rank"]) for r in sorted(asked, key=lambda r: r["rank"])] == [(4, 1), (4, 2)]
    assert topk.nearest_profiles(df.limit(0)).count() == 0


def test_bounds_hold_for_every_pair():
    draw = np.random.default_rng(6)
    vectors = np.floor(draw.normal(size=(500, 5)) * 10.0 ** draw.integers(0, 7, (500, 1)))
    vectors[:3] = [[7] * 5, [0] * 5, [1e300, -1e300, 0, 1, 2]]
    queries = np.concatenate([vectors[::50], [[0, 0, 0, 0, 1], [-1, -1, -1, -1, -1]]])
    cells, low, step = topk.cells_of(vectors.reshape(-1), np.full(500, 5))
    lower, upper = topk.bounds_of(queries, cells.reshape(500, 5), low, step)
    exact = np.array([[float(max(-(2**63), min(2**63, sum(int(a) * int(b) for a, b in zip(q, v))))) for v in vectors] for q in queries])
    assert (lower <= exact).all() and (exact <= upper).all()
    assert np.median((upper - lower)[1:, 3:] / np.abs(exact).max(axis=1)[1:, None]) < 0.01
    for q in range(len(queries)):
        kept = topk.possible(lower[q], upper[q], np.arange(500), 10)
        assert set(np.lexsort((np.arange(500), -exact[q]))[:10]) <= set(kept)


def test_copies_zeros_and_ties_do_not_multiply(spark, monkeypatch):
    """A third of all rows is one vector, another third is zero: few rows are read all the same."""
    draw = np.random.default_rng(8)
    rows = [(i, v) for i in range(0, 1800, 3) for v in ([3.0] * 4,)] + [(i, [0.0] * 4) for i in range(1, 1800, 3)]
    rows += [(i, draw.normal(size=4).tolist()) for i in range(2, 1800, 3)] + [(3, [3.0] * 4)] * 30
    df = spark.createDataFrame(rows, "area bigint, profile array<double>")
    read, plain = [], topk._read
    monkeypatch.setattr(topk, "_read", lambda found, *rest: (read.append(found.count()), plain(found, *rest))[1])
    asked = [0, 1, 2, 3, 100, 200, 300, 1799]
    got = topk.nearest_profiles(df, spark.createDataFrame([(a,) for a in asked], "area bigint"), block_rows=100, query_rows=5).collect()
    want = [r for r in _brute(rows, 10) if r[0] in asked]
    assert sorted((r.area, r["rank"], r.other, r.score) for r in got) == want
    assert len(want) == 10 * (len(asked) + 30) and sum(read) < 60 * (len(asked) + 30)


def test_templates_reach_as_deep_as_the_paths_do(spark):
    """Good and bad pages that differ in their ninth segment only, below a level that varies."""
    rows, marks, n = [], [], 0
    for kind, bad in (("clean", 0), ("spam", 1)):
        for i in range(40):
            rows.append((n, f"http://h.org/a/b/c/d/e/f/g/name{'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOP'[i]}/{kind}"))
            marks.append((n, bad))
            n += 1
    rows += [(n, "http://h.org/a/b/c/d/e/f/g/other/spam"), (n + 1, "http://h.org/a/b/c/d/e/f/g/other/clean"), (n + 2, "http://h.org/" + "x/" * 300)]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    got = {r.page_id: r for r in urls.judge_urls(df, [], spark.createDataFrame(marks, "page_id bigint, bad int")).collect()}
    assert got[n].template == "/a/b/c/d/e/f/g/*/spam" and got[n + 1].template == "/a/b/c/d/e/f/g/*/clean"
    assert (got[n].verdict, got[n + 1].verdict) == ("block", "allow")
    assert got[n + 2].template == "/" + "/".join(["x"] * 300) + "/" and got[n + 2].verdict == "allow"


def test_addresses_rules_and_templates(spark):
    pages = {
        1: "http://WWW.Example.NET/en/5?q", 2: "https://x.example.net/de/1", 3: "ftp://example.com/de/", 4: "http://example.com/dead/1", 5: "http://a.org/fr/#x",
        6: "http://notexample.net", 7: "http://net/", 8: None, 9: "no scheme/net/", 10: "http://h?x/y", 11: "x://y://z/en/", 12: "", 13: "http://ÄB.org/de/Ü",
    }
    want = {
        1: ("www.example.net", "/en/5", "example.net/en/", "allow"), 2: ("x.example.net", "/de/1", "net/", "block"), 3: ("example.com", "/de/", "example.com/de/", "block"),
        4: ("example.com", "/dead/1", None, None), 5: ("a.org", "/fr/", "org/fr/", "allow"), 6: ("notexample.net", "", None, None), 7: ("net", "/", "net/", "block"),
        8: ("", "", None, None), 9: ("", "", None, None), 10: ("h", "", None, None), 11: ("y:", "//z/en/", None, None), 12: ("", "", None, None), 13: ("Äb.org".replace("Ä", "Ä"), "/de/Ü", None, None),
    }
    rows = [(i, u, "t") for i, u in pages.items()] + [(1, pages[1], "twice")]
    # one host whose /spam/ pages are labelled bad and whose /news/ pages are good, with changing last segments
    rows += [(1000 + i, f"http://mixed.example.org/{'spam' if i % 2 else 'news'}/{'abcdefghijklmnopqrst'[i // 2 % 20]}x{'yz'[i % 2]}/{i}.html", "t") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, template string")
    labels = spark.createDataFrame([(1000 + i, i % 2) for i in range(120)], "page_id bigint, bad int")
    got = urls.judge_urls(df, RULES, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id < 1000:
            host, path, rule, verdict = want[r.page_id]
            assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or "allow")
        else:
            assert r.verdict == ("block" if r.page_id % 2 else "allow") and r.template.count("*") >= 1
    assert urls.judge_urls(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in urls.judge_urls(df, []).collect()} == {"allow"}


def test_pipeline_on_planted_documents(spark, tmp_path):
    draw = random.Random(9)
    vocabulary = [a + b + c for a in ("fi", "ce", "da", "se", "mo") for b in ("re", "ll", "ys", "as", "nt") for c in ("", "on", "ing", "ed", "er")]
    text = lambda n: " ".join(draw.choice(vocabulary) + " " + draw.choice(WORDS["en"]) for _ in range(n))
    item = text(20)
    base, other = text(120), text(90)
    near = base.split()
    near[50] = "changed"
    docs = {
        1: base, 2: base, 3: " ".join(near), 4: other, 5: f"{text(40)} {item} {text(40)}", 6: f"{text(60)} write to a.b@example.com or 10.1.2.3 please",
        7: None, 8: "", 9: "12 34", 10: text(80),
    }
    rows = [(i, t, "en", "src", 0, 1) for i, t in docs.items()] + [(10, docs[10], "en", "src", 0, 1), (None, text(70), None, None, None, 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, document int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 4, 6, 10]
    docs_now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_now = stage(spark, docs_now, str(tmp_path))
        assert docs_now.columns == corpus_pipeline.COLUMNS, name
    six = docs_now.filter("doc_id = 6").first()
    assert "[EMAIL]" in six.text and "[IP]" in six.text and "example.com" not in six.text and six.n_chars == len(six.text)
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/e/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0


def test_languages_of_copied_or_short_texts_get_full_dictionaries(spark):
    few = [(f"l{k}", f"{'abcdefghijkl'[k] * 3} word{k}x{n} tail") for k in range(12) for n in range(10)]
    copies = spark.createDataFrame(few, "lang string, document string").crossJoin(spark.range(500)).select("document", "lang")
    model = language.learn_languages(copies)
    for k in range(12):  # each text once, however many copies of it there are
        assert sorted(w for w in model.dictionaries[f"l{k}"].split() if w == b"tail") == [b"tail"] * 10
    short = spark.range(20_000).selectExpr("concat('ein wort ', hex(xxhash64(id))) AS document", "'de' AS lang")
    assert len(language.learn_languages(short).dictionaries["de"]) == 110_000
    long = spark.createDataFrame([("x" + "a b " * 5000 + "zebra " * 5000, "en")] + [("a b " * 500 + "quagga " * 2000 + str(n), "en") for n in range(9)], "document string, lang string")
    assert b"quagga" in language.learn_languages(long).dictionaries["en"]
