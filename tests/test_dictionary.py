"""Dictionaries as automata against a search of every word run."""

import random
import re

import pytest

from evidentia.operators import dictionary, text

RNG = random.Random(13)
WORD = re.compile(r"[A-Za-z0-9]+")


def prose(n):
    return "".join(RNG.choice(["a", "ab", "Force", "MAJEURE", "x1", "été", "the", "Ä", "日本"]) + RNG.choice([" ", ", ", "\n", "-", "é"]) for _ in range(n))


def brute(docs, terms):
    by = {}
    for t in terms:
        w = tuple(x.lower() for x in WORD.findall(t[1] or ""))
        if w:
            by.setdefault(w, []).append(t)
    out = []
    for doc_id, body in docs:
        w = [(m.group().lower(), *m.span()) for m in WORD.finditer(body or "")]
        for n in {len(x) for x in by}:
            for i in range(len(w) - n + 1):
                for t in by.get(tuple(x[0] for x in w[i : i + n]), ()):
                    out.append((doc_id, t, w[i][1], w[i + n - 1][2]))
    return out


@pytest.fixture(scope="module")
def corpus():
    docs = [(i, prose(RNG.randrange(0, 60))) for i in range(30)] + [(50, None), (51, ""), (52, "..."), (53, prose(4000)), (3, "force majeure"), (54, "a " * 50)]
    terms = [(i, prose(RNG.randrange(1, 5))) for i in range(200)] + [(900, "a " * 12), (901, "Force  MAJEURE"), (901, "force-majeure"), (902, ""), (903, None), (904, "日本"), (905, prose(70))]
    return docs, terms


@pytest.mark.parametrize("part,chunk", [(None, 1 << 18), (40, 100)])
def test_binding_equals_a_search(spark, corpus, monkeypatch, part, chunk):
    docs, terms = corpus
    monkeypatch.setattr(dictionary, "CHUNK", chunk)
    if part:
        monkeypatch.setattr(dictionary, "PART_TERMS", part)
    got = text.bind_terms(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(terms, "term_id long, surface string"))
    assert sorted(map(tuple, got.collect())) == sorted((d, t[0], a, b) for d, t, a, b in brute(docs, terms))


def test_scoped_terms_bind_in_their_document_and_span(spark, corpus):
    docs, terms = corpus
    own = [(RNG.choice([0, 1, 2, 53, 54, 99]), *t, RNG.randrange(40), RNG.randrange(30, 9000)) for t in terms]
    want = [(d, t[0], a, b) for doc in docs for d, t, a, b in brute([doc], [(o[1], o[2], o[3], o[4]) for o in own if o[0] == doc[0]]) if t[2] <= a and b <= t[3]]
    got = text.bind_terms(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(own, "doc_id long, term_id long, surface string, scope_start long, scope_end long"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(dictionary, "_CODES", dictionary._CODES * 0 + dictionary.np.uint64(1))
    a = dictionary.Automaton(["ab", "ba", "ab ba", "cd"])
    row, term, start, end = a.scan(["ba ab ba dc", "cd"])
    assert sorted(zip(row.tolist(), term.tolist(), start.tolist(), end.tolist())) == [(0, 0, 3, 5), (0, 1, 0, 2), (0, 1, 6, 8), (0, 2, 3, 8), (1, 3, 0, 2)]


def test_a_million_terms():
    import time

    terms = [f"w{i % 5000} v{i // 5000} end{i % 7}" for i in range(1_000_000)]
    began = time.time()
    a = dictionary.Automaton(terms)
    row, term, start, end = a.scan([" ".join(f"w{i % 5000} v{i % 200} end{i % 7}" for i in range(3500))])
    assert time.time() - began < 60
    assert all(terms[t] for t in term.tolist()) and len(term) == sum(f"end{i % 7}" == f"end{(i % 200 * 5000 + i % 5000) % 7}" for i in range(3500))
    assert (end > start).all() and (row == 0).all()


def test_empty_tables(spark):
    none = lambda ddl: spark.createDataFrame([], ddl)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert text.bind_terms(docs, none("term_id long, surface string")).count() == 0
    assert text.bind_terms(none("doc_id long, text string"), spark.createDataFrame([(1, "a")], "term_id long, surface string")).count() == 0
    assert text.bind_terms(docs, none("doc_id long, term_id long, surface string, scope_start long, scope_end long")).count() == 0
