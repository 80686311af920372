"""The pipeline's stages against brute force, and the whole chain on the smallest tables."""

import random
import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("evidentia.llm")

import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(17)


def prose(n):
    return " ".join(f"w{R.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Null and repeated ids, empty and long texts, copies, near copies, repeated rows."""
    a, b, c = prose(80), prose(90), prose(3000)
    near = " ".join([*a.split(" ")[:40], "edited", *a.split(" ")[41:]])
    texts = [(5, prose(60)), (5, b), (3, b), (None, a), (None, near), (9, near), (None, prose(50)), (None, prose(50)), (1, None), (2, ""), (None, ""), (7, c), (8, c), (8, c), (11, "two words"), (12, "two words"), (4, " \n")]
    return [(i, t, "en", None, len(t) if t is not None else None) for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    from pyspark.sql import functions as F

    # columns that clash with names the stages use
    return spark.createDataFrame(corpus, DOC).withColumns({"text_key": F.lit(1), "kept_text": F.lit("k"), "score": F.lit(0.0), "sid": F.lit(2)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_one_of_each_group(spark, docs, corpus):
    got = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()]
    rest, sets = list(dict.fromkeys(corpus)), {r: shingles(r[1]) for r in corpus}
    groups = []
    for row in rest:
        linked = [g for g in groups if sets[row] and any(sets[o] and 100 * len(sets[row] & sets[o]) >= 80 * len(sets[row] | sets[o]) for o in g)]
        groups = [g for g in groups if g not in linked] + [[row, *(o for g in linked for o in g)]]
    assert len(got) == len(groups) and set(got) <= set(rest)
    for g in groups:
        kept = [r for r in got if r in g]
        least = min((r[0] for r in g if r[0] is not None), default=None)
        assert len(kept) == 1 and kept[0][0] == least


def test_without_repeats(spark, docs, corpus):
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.without_repeats(spark, docs, SF).collect())
    order = lambda r: (r[0] is None, r[0] or 0)
    seen, want = set(), Counter()
    for key in sorted({order(r) for r in corpus}):
        now = [r for r in corpus if order(r) == key]
        fresh = set()
        for row in now:
            data, own, gone = (row[1] or "").encode(), set(), set()
            for i in range(len(data) - 99):
                window = data[i : i + 100]
                if window in seen or window in own:
                    gone |= set(range(i, i + 100))
                own.add(window)
            fresh |= own
            left = bytes(x for i, x in enumerate(data) if i not in gone)
            if left or not gone:
                want[(row[0], left.decode())] += 1
        seen |= fresh
    assert got == want


def test_filters_keep_clean_rows_whole(spark, docs, corpus):
    """Rows that a filter keeps are its input's, as often; what goes is what its model rejects."""
    for stage in (corpus_pipeline.known_language, corpus_pipeline.not_toxic):
        got = stage(spark, docs, SF)
        assert got.columns == corpus_pipeline.COLUMNS
        assert not Counter(map(tuple, got.collect())) - Counter(corpus)
    kept = Counter(r["doc_id"] for r in corpus_pipeline.not_toxic(spark, docs, SF).collect())
    assert kept == Counter(r[0] for r in corpus)


def test_empty_input(spark):
    none = spark.createDataFrame([], DOC)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).collect() == []


def test_whole_chain(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        following = corpus_pipeline.staged(stage(spark, docs, SF), "chain")
        assert following.columns == corpus_pipeline.COLUMNS and 0 < following.count() <= docs.count(), name
        docs = following
    tok = Tokenizer.from_file(corpus_pipeline.packing.tokenizer_path())
    tok.encode_special_tokens = True
    lengths = Counter({r["doc_id"]: len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect()})
    filled, found = defaultdict(int), Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        filled[r["sequence_id"]] += r["length"]
        found[r["doc_id"]] += r["length"]
    assert found == lengths and max(filled.values()) <= 2048
    assert len(filled) <= -(-sum(lengths.values()) // 2048) + 1


def test_language_passes_the_text_once(spark):
    """A task gets each text once, and passes it on as it was."""
    from evidentia.llm import language_id

    rows = [(i, t, x) for i, (t, x) in enumerate([("the house and the garden", "en"), ("das Haus und der Garten", "de"), (None, "en"), ("  ", None), ("Der GARTEN", "de")] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    got = language_id.predict(docs, model, ["doc_id", "text"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS text#") == 0 and "kept_text" not in plan
    once = {r["doc_id"]: r for r in language_id.predict(docs, model, ["doc_id"]).collect()}
    assert {r["doc_id"]: (r["text"], r["lang_pred"], r["score"]) for r in got.collect()} == {i: (t, once[i]["lang_pred"], once[i]["score"]) for i, t, _ in rows}
