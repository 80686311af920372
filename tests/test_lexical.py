"""Lexical shares against plain containment, in one tile and in a grid, with all terms at once and in parts."""

import re

import pytest

from evidentia import plans
from evidentia.operators import rank, tiles


@pytest.mark.parametrize("small", [False, True])
def test_shares_of_all_pairs(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(tiles, "TILE", 2)
        monkeypatch.setattr(tiles, "MEETINGS", 3)
        monkeypatch.setattr(rank, "TERMS", 5)
        monkeypatch.setattr(tiles, "SLICE", 3)
    questions = ["Where are the ending stations?", "ation tion", "", None, "the a of", "Überall GROSSE Straßen, tion", "where where WHERE"]
    texts = ["Nations here", "someWHERE; the ending of stations", None, "", "überall große straßen tion", "tion tion", "wherever-ation"] * 2
    q = spark.createDataFrame(list(enumerate(questions)), "query_id long, question string")
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")

    def score(question, text):
        terms = {w for w in re.findall(r"[^\W_]+", (question or "").lower()) if len(w) >= 4}
        return sum(t in (text or "").lower() for t in terms) / len(terms) if terms else 0.0

    want = {(i, j): score(a, b) for i, a in enumerate(questions) for j, b in enumerate(texts)}
    got = {(r["query_id"], r["id"]): r["score"] for r in rank.lexical_coverage(q, d).collect()}
    assert got == pytest.approx(want) and any(want.values())
    hits = {(r["query_id"], r["id"]): r["score"] for r in rank.lexical_hits(q, d).collect()}
    assert hits == pytest.approx({k: v for k, v in want.items() if v})
    best = {(r["query_id"], r["id"]) for r in rank.lexical_hits(q, d, k=2).collect()}
    for i in range(len(questions)):
        first = sorted((k for k, v in want.items() if k[0] == i and v), key=lambda k: (-want[k], k[1]))[:2]
        assert best >= set(first)


def test_words_and_pairs_are_not_shuffled(spark):
    """Before, words, terms and pairs were joined; now the plan has no join at all."""
    plan = plans.QUERIES["v7_lexical_coverage"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_a_task_keeps_k_rows_a_query(spark, monkeypatch):
    """Before, k rows of every slice came back, and a slice was ranked as a whole."""
    monkeypatch.setattr(tiles, "SLICE", 3)
    q = spark.createDataFrame([(0, "alpha betas gamma"), (1, "betas delta"), (2, "none such")], "query_id long, question string")
    texts = ["alpha", "betas gamma", "xalphax betas gammas", "", "delta", "delta betas", "alpha betas", "gamma", "betas", "alpha gamma"] * 4
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in rank.lexical_hits(q, d, k=3).collect())
    assert got == [(0, 2, 1.0), (0, 12, 1.0), (0, 22, 1.0), (1, 5, 1.0), (1, 15, 1.0), (1, 25, 1.0)]


def test_terms_within_words():
    """Terms that begin alike, overlap, repeat within a word or hold it, and letters outside the basic plane."""
    import random

    import pyarrow as pa

    draw = random.Random(3)
    for least, letters in ((4, "ab"), (2, "abß"), (1, "a𝒳é"), (5, "ab")):
        words = sorted({"".join(draw.choices(letters, k=draw.randrange(least, 12))) for _ in range(120)})
        terms = words[::3]
        word, term = rank._Terms(terms, least).within(pa.array(words).slice(5))
        want = [(i, j) for i, w in enumerate(words[5:]) for j, x in enumerate(terms) if x in w]
        assert list(zip(word.tolist(), term.tolist())) == want and len(want) > len(terms)
    assert [len(x) for x in rank._Terms([], 4).within(pa.array(["word"]))] == [0, 0] == [len(x) for x in rank._Terms(["word"], 4).within(pa.array([], pa.string()))]
