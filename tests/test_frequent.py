"""The most frequent words and pairs, and scoped dictionaries, against plain counts."""

import random
import re
from collections import Counter

import pytest

from evidentia.operators import dictionary, text


@pytest.mark.parametrize("most_words", [1_000_000, 2])
@pytest.mark.parametrize("k", [1, 5, 40, 500])
def test_frequent_is_the_head_of_all_counts(spark, k, most_words):
    draw = random.Random(7)
    texts = [None, "", "?"] + [" ".join(draw.choice(["a", "it", "The", "word", "x1", "one", "two", "THREE", "four"]) for _ in range(draw.randrange(40))) for _ in range(30)]
    want = Counter()
    for t in texts:
        w = re.findall("[A-Za-z0-9]+", (t or "").lower())
        want.update([x for x in w if len(x) > 2] + [" ".join(p) for p in zip(w, w[1:])])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(((r["surface"], r["c"]) for r in dictionary.frequent(docs, k, most_words=most_words).collect()), key=lambda x: (-x[1], x[0]))
    assert got == sorted(want.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_scoped_terms_of_a_batch_share_an_automaton(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)
    plain = dictionary.Automaton

    class Counting(plain):
        def __init__(self, surfaces):
            made.add(1)
            super().__init__(surfaces)

    monkeypatch.setattr(dictionary, "Automaton", Counting)
    docs = spark.createDataFrame([(i, "red fox, red dog") for i in range(20)], "doc_id long, text string")
    own = [(i, i, "red fox" if i % 2 else "red", 0, 8 if i % 3 else 20) for i in range(20)] + [(3, 90, "red fox", 0, 20), (4, 91, "dog", None, 20)]
    got = text.bind_terms(docs, spark.createDataFrame(own, "doc_id long, term_id long, surface string, scope_start long, scope_end long"))
    want = [(i, i, 0, 7 if i % 2 else 3) for i in range(20)] + [(i, i, 9, 12) for i in range(0, 20, 6)] + [(3, 90, 0, 7)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert made.value < 20
