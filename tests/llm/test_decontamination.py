"""Benchmark decontamination against brute force."""

import hashlib
import random
import re

import pytest

pytest.importorskip("evidentia.llm")

from pyspark.sql import functions as F  # noqa: E402

from evidentia.llm import decontamination as d  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RNG = random.Random(12)
TESTS = "item_id long, text string"
DOCS = "doc_id long, text string, n int, windows string, n_hit string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return WORD.findall(lowered(text))


def prose(n):
    return "".join(RNG.choice(["ab", "Ünd", "x1", "été", "日本", "the", "OF"]) + RNG.choice([" ", ", ", "\n", "-"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    items = [prose(RNG.randrange(11, 40)) for _ in range(8)] + ["Short one here", "short-ONE here", "", "!?", None, prose(10), "ab ab ab ab ab ab ab ab ab ab ab ab"]
    tests = [(i, t) for i, t in enumerate(items)] + [(2, items[3]), (None, prose(14)), (11, items[0])]
    texts = [None, "", " ... ", "short one here", "it is a short, one HERE indeed", items[0], items[1].upper(), items[13], prose(3000), "ab " * 2000]
    for _ in range(40):
        cut = items[RNG.randrange(8)].split(" ")
        texts.append(prose(RNG.randrange(30)) + " " + " ".join(cut[RNG.randrange(3) :]) + " " + prose(RNG.randrange(30)) + tests[-2][1] * RNG.randrange(2))
    texts += [texts[12]] * 5
    docs = [(RNG.choice([i, i, 3, None]), t, 1, "w", "h") for i, t in enumerate(texts)]
    return docs, tests


def brute(docs, tests, n=10):
    windows = {}
    for item, text in tests:
        w = words_of(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1) if w else ():
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    out, kept = [], []
    for doc_id, text, *_ in docs:
        w, hit, items = words_of(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    items |= windows[tuple(w[i : i + k])]
        names = sorted(str(x) for x in items - {None})
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
        at, rest = 0, ""
        spans = [m.span() for m in WORD.finditer(lowered(text))]
        for i, (a, b) in enumerate(spans):
            if i in hit and i - 1 not in hit:
                rest, at = rest + text[at:a], None
            if i in hit and i + 1 not in hit:
                at = b
        kept.append(None if text is None else rest + text[at:])
    return out, kept


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("set_bytes", [1 << 20, 2000])
def test_contamination_equals_brute_force(spark, rows, set_bytes):
    docs, tests = rows
    got = d.contamination(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(tests, TESTS), set_bytes=set_bytes)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(key, got.collect())) == sorted(map(key, brute(docs, tests)[0]))


def test_spans_and_documents_are_removed(spark, rows):
    docs, tests = rows
    want, kept = brute(docs, tests)
    frame, items = spark.createDataFrame(docs, DOCS), spark.createDataFrame(tests, TESTS)
    got = d.decontaminate(frame, items, set_bytes=2000)
    assert sorted(key((r.doc_id, r.text, r.n_hit)) for r in got.collect()) == sorted(key((w[0], t, w[2])) for w, t in zip(want, kept))
    whole = d.decontaminate(frame, items, remove="documents")
    assert sorted(key((r.doc_id, r.text)) for r in whole.collect()) == sorted(key((w[0], x[1])) for w, x in zip(want, docs) if not w[5])
    half = d.decontaminate(frame, items, remove="documents", share=0.5)
    assert half.count() == sum(w[2] <= 0.5 * w[1] for w in want)
    with pytest.raises(ValueError):
        d.decontaminate(frame, items, remove="lines")


def test_equal_hashes_are_told_apart_by_their_words(spark, monkeypatch):
    real = d.gram_hash
    monkeypatch.setattr(d, "gram_hash", lambda w, k: real(w, k) & d.np.uint64(3))
    import pyarrow as pa

    data = d.np.frombuffer(b"a b c d e f g h", dtype=d.np.uint8)
    _, _, first, word, body, place = d.normalised(data, d.np.array([0, len(data)]))
    rows = pa.table({"gram": d.gram_hash(word, 2).view(d.np.int64), "n_words": pa.array([2] * 7, pa.int32()), "window": pa.array(range(7), pa.int64()), "body": [data[2 * i : 2 * i + 3].tobytes() for i in range(7)]})
    where, number = d.GramSet(rows).find(d.gram_hash(word, 2).view(d.np.int64), 2, place, body)
    assert sorted(zip(where.tolist(), number.tolist())) == [(i, i) for i in range(7)]


def test_empty_tables(spark, rows):
    docs, tests = rows
    none = d.contamination(spark.createDataFrame([], DOCS), spark.createDataFrame(tests, TESTS))
    assert none.count() == 0
    clean = d.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], TESTS))
    assert clean.where("contaminated or n_items > 0 or n_hit > 0").count() == 0 and clean.count() == len(docs)


def test_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.sql(d.SQL)
    got = d.op12_decontamination(spark, "/root/testdata/sf0.001")
    assert got.where(F.col("contaminated")).count() > 0
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())
