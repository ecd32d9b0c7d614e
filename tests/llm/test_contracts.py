"""The registered text queries on the smallest tables: columns, types, digests and decisions recomputed plainly."""

import os
import re
import zlib
from hashlib import sha256

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from embergrid.llm import bytebpe
from embergrid.llm.queries import QUERIES, RANKS, SQL, TOKENIZER
from tools.check import TABLES, norm

DIR = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"  # the smallest tables hold no secret
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def run(spark, name, *begins):
    df = QUERIES[name](spark, DIR)
    assert [f"{c} {t}" for c, t in df.dtypes][: len(begins)] == list(begins)
    return df.collect()


def spans(text, kinds):
    """[(kind, start, end)] of the formats, leftmost and not overlapping within a kind; kinds: name -> (pattern, flags, fits)."""
    return {k: [m.span() for m in re.finditer(p, text, f) if fits(m)] for k, (p, f, fits) in kinds.items()}


def digest(rows):
    return sha256(",".join(f"{k}:{a}:{b}" for k, a, b in rows).encode()).hexdigest()


def luhn(m):
    d = [int(c) for c in m.group() if c.isdigit()][::-1]
    return 16 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0, lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0, lambda m: all(int(p) <= 255 for p in m.group().split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", 0, luhn),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0, lambda m: 8 <= sum(c.isdigit() for c in m.group()) <= 15),
}
SECRETS = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m.group(2)) >= 6),
    "access": (r"AKIA[A-Z0-9]+", 0, lambda m: len(m.group()) >= 20),
    "hex": (r"[0-9a-f]+", 0, lambda m: len(m.group()) >= 24),
}


def test_op1(spark, docs):
    rows = run(spark, "op1_pii", "doc_id bigint", *(f"n_{k} bigint" for k in PII), "base_sha256 string", "spans string")
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        found = spans(docs[r.doc_id].text or "", PII)
        base = [(k, *s) for k in PII for s in found[k]]
        assert [r[f"n_{k}"] for k in PII] == [len(found[k]) for k in PII] and r.base_sha256 == digest(base)
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))
    assert sum(r.n_email for r in rows) > 0


def test_op3(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op3_secrets"](spark, LARGER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        found = spans(texts[r.doc_id] or "", SECRETS)
        base = sorted(((k, *s) for k in SECRETS for s in found[k]), key=lambda s: (s[1], list(SECRETS).index(s[0])))
        assert [r[f"n_{k}"] for k in SECRETS] == [len(found[k]) for k in SECRETS] and r.base_sha256 == digest(base)
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))
    assert sum(r.n_assign + r.n_access + r.n_hex for r in rows) > 5
    assert list(rows[0].asDict())[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def test_op2(spark, docs):
    rows = run(spark, "op2_language", "doc_id bigint", "held_out boolean", "lang_pred string", "score double")
    langs = {d.lang for d in docs.values() if d.lang} | {"und"}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.lang_pred in langs and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[r.doc_id].text or ""))
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.85 * len(held) > 10


def test_op4(spark, docs):
    rows = run(spark, "op4_token_file", "doc_id bigint", "start bigint", "n_tokens bigint", "ids_crc32 bigint")
    library, before = Tokenizer.from_file(TOKENIZER), 0
    by_id = {r.doc_id: r for r in rows}
    assert len(by_id) == len(rows) == len(docs)
    for i in sorted(docs):
        ids = np.array(library.encode(docs[i].text or "", add_special_tokens=False).ids + [0], "<u4")
        assert (by_id[i].start, by_id[i].n_tokens, by_id[i].ids_crc32) == (before, len(ids), zlib.crc32(ids.tobytes()))
        before += len(ids)


def test_op6(spark, docs):
    rows = run(spark, "op6_byte_bpe", "doc_id bigint", "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string")
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id].text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == sha256((docs[r.doc_id].text or "").encode()).hexdigest()


def test_op7(spark):
    rows = run(spark, "op7_urls", "page_id bigint", "host string", "path string", "rule string", "verdict string")
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{DIR}/pages.parquet").select("page_id", "url").collect()}
    assert sorted(r.page_id for r in rows) == sorted(urls)
    for r in rows:
        m = re.search(r"://([^/?#]*)([^?#]*)", urls[r.page_id] or "", re.S)
        host, path = (m.group(1).translate({c: c + 32 for c in range(65, 91)}), m.group(2)) if m else ("", "")
        fit = [(a, v) for a, v in rules if (host == a.partition("/")[0] or host.endswith("." + a.partition("/")[0])) and path.startswith(a[a.index("/"):])]
        best = max(fit, key=lambda x: len(x[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, best[0]) and r.verdict in ("allow", "block") and (best[1] or r.verdict) == r.verdict


def test_op8_and_op9(spark, docs):
    leaks = run(spark, "op8_decontaminate", "doc_id bigint", "item_id bigint", "coverage double")
    assert all(0.5 <= r.coverage <= 1 and r.doc_id in docs for r in leaks) and len({(r.doc_id, r.item_id) for r in leaks}) == len(leaks)
    items = {r.item_id: " ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()}
    whole = {(i, b) for i, d in docs.items() for b, t in items.items() if f" {t} " in f" {' '.join(re.findall(chr(92) + 'w+', (d.text or '').lower()))} "}
    assert whole <= {(r.doc_id, r.item_id) for r in leaks if r.coverage == 1}
    rows = run(spark, "op9_toxicity", "doc_id bigint", "held_out boolean", "score double", "predicted int")
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_op10(spark, docs):
    from xxhash import xxh64_intdigest

    rows = run(spark, "op10_simhash", "doc_id bigint", "fingerprint string", "component_id bigint")
    prints, root = {}, {i: i for i in docs}
    for i, d in docs.items():
        words = re.findall(rb"[^\x20\x09-\x0d]+", (d.text or "").encode().lower())
        shingles = [b" ".join(words[j : j + 3]) for j in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))
    for i in docs:
        for j in docs:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 3 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", root[i]) for i in docs} and len(rows) == len(docs)


@pytest.mark.parametrize("name", ["op5_topk", "op11_resample", "op12_shards", "op13_histories"])
def test_queries_with_sql(spark, con, name):
    got, want = norm(QUERIES[name](spark, DIR).toPandas()), norm(con.execute(SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want) > 0 and got.equals(want)


def test_pipeline_stages_follow_each_other(spark, docs):
    now = spark.read.parquet(f"{DIR}/documents.parquet")
    kept, columns = {}, now.columns
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, DIR).cache()
        kept[name] = {r[0] for r in now.select("doc_id").collect()}
        if name != "byte_bpe":
            assert now.columns == columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(kept[b] <= kept[a] for a, b in zip(names, names[1:])) and len(kept["byte_bpe"]) > 0.7 * len(docs)
    assert kept["language_id"] - kept["near_dedup"] and kept["decontamination"] == kept["private_data"] == kept["byte_bpe"]
    whole = corpus_pipeline.run(spark, DIR).collect()
    mine = {r.doc_id: r.ids_sha256 for r in now.collect()}
    assert {r.doc_id: r.ids_sha256 for r in whole} == mine and len(whole) == len(mine)
    texts = [docs[i].text for i in kept["near_dedup"]]
    assert len(set(texts)) == len(texts)


def test_pipeline_sends_small_batches(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "size"])

    corpus_pipeline._bound_batches(spark)
    text = F.repeat(F.lit("x"), F.when(F.col("id") < 20, 1_000_000).otherwise(100))
    got = spark.range(0, 6000, 1, 1).select(text.alias("document")).mapInArrow(sizes, "rows long, size long").collect()
    assert sum(r["rows"] for r in got) == 6000
    assert all(r["rows"] <= 1000 and r["size"] < 2 * (4 << 20) for r in got)  # a batch ends with the text that fills it
