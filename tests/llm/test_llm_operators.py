"""The training-data operators against plain brute-force versions on small fixtures."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("evidentia.llm")

from evidentia.llm import curve_search, fingerprints, jaccard_join, language_id, license_scan, packing, pieces, sharding, suffix_dedup, toxicity  # noqa: E402
from evidentia.llm.common import connected_components  # noqa: E402

RNG = random.Random(3)
VOCAB = ["the", "of", "ünd", "reason", "tha", "wher", "ing", "ßtra", "éau", "x1", "hand", "thor", "Blen", "ATED", "onto", "mit"]
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, sep=" "):
    return sep.join(RNG.choice(VOCAB) + RNG.choice(["", "", "", ".", ",", "\n"]) + str(RNG.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Nulls, empty, blank, very long and repeated texts, copies and near copies, ids that are null or repeat."""
    base = prose(120)
    texts = [None, "", "   \n\t", "word", "two words", base, base, base.replace("the", "thee", 1), base[: len(base) * 2 // 3], prose(4000), "a" * 500, "ab" * 400, "日本語 " * 50]
    texts += [" ".join([*base.split(" ")[:60], *prose(10 + i % 7).split(" "), *base.split(" ")[60:]]) for i in range(12)]
    texts += [prose(RNG.randrange(1, 60)) for _ in range(40)]
    passage = prose(60)
    texts += [prose(30) + "\n" + passage + "\n" + prose(20) for _ in range(6)]
    rows = [(7 * i % 101, t, RNG.choice(["en", "de", None]), "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, None, None, None), (None, "null id " + passage, "en", "s", 3)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    # extra columns whose names an operator may use itself
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(corpus, DOC).repartition(3)
    return frame.withColumns({"n": F.lit(1), "row": F.lit("r"), "length": F.lit(2.5), "block": F.lit(None).cast("int")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def rows(df):
    return [r.asDict() for r in df.collect()]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# ------------------------------------------------------------------ 1 Jaccard join


def brute_components(corpus, k, num, den):
    sets = []
    for _, text, *_ in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i], sets[j]
        if a and b and den * len(a & b) >= num * len(a | b):
            parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, row in enumerate(corpus):
        least[find(i)].append(row[0])
    name = {r: min((x for x in ids if x is not None), default=None) for r, ids in least.items()}
    return Counter((row[0], len(sets[i]), name[find(i)] if sets[i] else row[0]) for i, row in enumerate(corpus))


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80), (2, 50)])
def test_jaccard_join_loses_no_link(docs, corpus, k, num):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(jaccard_join.join(docs, k, num, 100)))
    assert got == brute_components(corpus, k, num, 100)


def test_jaccard_join_of_many_near_copies(spark):
    """A group whose members straddle the threshold, so that components grow through chains."""
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(150):
        w = base.copy()
        for j in range(i % 9):
            w[(i * 7 + j * 11) % 80] = f"e{i}_{j}"
        texts.append(" ".join(w))
    corpus = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(jaccard_join.join(spark.createDataFrame(corpus, DOC), 3, 80, 100)))
    assert got == brute_components(corpus, 3, 80, 100)


def test_jaccard_join_of_copies_of_many_sizes(spark):
    """Cut, extended and edited copies, so that linked sets are of different size classes."""
    r = random.Random(11)
    texts = []
    for g in range(25):
        base = [f"{g}_{r.randrange(10**6)}" for _ in range(r.choice([12, 40, 90, 300]))]
        for _ in range(12):
            w = base[: len(base) - r.randrange(1 + len(base) // 6)] + [f"x{r.random()}" for _ in range(r.randrange(1 + len(base) // 10))]
            for _ in range(r.randrange(1 + len(w) // 40)):
                w[r.randrange(len(w))] = f"e{r.randrange(50)}"
            texts.append(" ".join(w))
    corpus = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(corpus, DOC)
    for k, num in ((3, 90), (5, 80)):
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(jaccard_join.join(frame, k, num, 100)))
        assert got == brute_components(corpus, k, num, 100)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 202), (300, 300)] + [(500, x) for x in range(501, 530)]
    got = {r["node"]: r["component"] for r in rows(connected_components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200, 202: 200, **{x: 500 for x in range(500, 530)}}


# ------------------------------------------------------------------ 2 packing


def test_packing(docs, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    out = rows(packing.pack(docs, packing.tokenizer_path()))
    want = Counter()
    total = 0
    for doc_id, text, *_ in corpus:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        total += len(ids)
        for i, (s, n) in enumerate(packing.cut(len(ids), 2048)):
            want[(doc_id, i, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    filled = defaultdict(list)
    for r in out:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(filled) <= -(-total // 2048) + 1


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(packing.tokenizer_path()), packing.Encoder(packing.tokenizer_path(), keep=5)
    for text in ["", " ", "a  b", " lead", "trail ", "it's we'll  x", "tab\there \n new", "ünd ²½ é́", "<|endoftext|> a", "日本 語", "a b 　c", "x \n y"]:
        assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_plan_is_best_fit_decreasing():
    lengths = [RNG.randrange(1, 101) for _ in range(500)]
    runs = packing.plan(Counter(lengths), 100)
    free = []  # plain best-fit decreasing, one item at a time
    for n in sorted(lengths, reverse=True):
        fit = [i for i, f in enumerate(free) if f >= n]
        if fit:
            free[min(fit, key=lambda i: free[i])] -= n
        else:
            free.append(100 - n)
    assert max(seq + -(-(last - first + 1) // each) for _, first, last, seq, each, _ in runs) == len(free)


# ------------------------------------------------------------------ 3 curve search


def test_curve_search(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16))
    x[:300] *= 3
    x[400:430] = x[400]
    data = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    data += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0] * 3), (None, data[0][1]), (2080, [None] * 16), data[3]]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumnsRenamed({}).repartition(3)
    frame = frame.withColumn("x", frame.vec_id).withColumn("block", frame.vec_id)
    out = rows(curve_search.search(frame, 20, 20, block=40))  # 23 blocks a curve, of which a query sees three
    m = np.array([v for _, v in data[:900]], dtype=np.float64)
    by = defaultdict(dict)
    for r in out:
        by[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(by) == list(range(0, 900, 20))
    hit = 0
    for q, found in by.items():
        score = m @ m[q]
        order = [i for i in np.lexsort((np.arange(900), -score)) if i != q][:20]
        assert sorted(found) == list(range(1, 21))
        ids = [found[r][0] for r in range(1, 21)]
        assert q not in ids and len(set(ids)) == 20
        assert all(abs(found[r][1] - score[found[r][0]]) < 1e-9 for r in found)
        assert [found[r][1] for r in range(1, 21)] == sorted((found[r][1] for r in found), reverse=True)
        hit += len(set(ids) & set(order))
    assert hit / (20 * len(by)) >= 0.9


def curve_recall(x, out):
    by = defaultdict(set)
    for r in out:
        by[r["query_id"]].add(r["vec_id"])
    hit = 0
    for q, found in by.items():
        score = x @ x[q]
        hit += len(found & set([i for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:20]))
    return hit / (20 * len(by))


def test_curve_recall_within_a_fifth_of_the_table(spark):
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(6000, 4)) @ rng.normal(size=(4, 24)) + 0.05 * rng.normal(size=(6000, 24))).astype(np.float32).astype(np.float64)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = rows(curve_search.search(frame, 20, 20, curves=10, block=40, recall=0))  # one round: at most 1,200 comparisons a query
    assert curve_recall(x, out) >= 0.9


def test_curve_rounds_until_recall(spark):
    """Vectors without structure: one round finds too little, so rounds follow until the measured recall is reached."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(5000, 32)).astype(np.float32).astype(np.float64)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    once = curve_recall(x, rows(curve_search.search(frame, 20, 20, curves=6, block=30, recall=0)))
    out = rows(curve_search.search(frame, 20, 20, curves=6, block=30))
    assert once < 0.6 and curve_recall(x, out) >= 0.9
    assert all(abs(r["score"] - x[r["query_id"]] @ x[r["vec_id"]]) < 1e-9 for r in out)
    assert len(out) == 20 * 250 == len({(r["query_id"], r["rank"]) for r in out})


def test_curve_search_small_and_empty(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(curve_search.search(few))] == [(0, 1, 1, 1.0), (0, 2, 2, 0.5)]
    assert rows(curve_search.search(few.limit(0))) == []


def test_hilbert_neighbours_touch():
    grid = np.array(list(itertools.product(range(8), repeat=3)))
    order = grid[np.argsort(curve_search.hilbert_key(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


# ------------------------------------------------------------------ 4 licence scan


def test_license_scan(spark, docs, corpus):
    extra = [(900, "Released UNDER the MIT-License. under the mit license; cc by nc by NC", None, None, 0), (901, "Apache License, Version 2.0", None, None, 0), (902, "This work is licensed under the brand new GNU General Public License, version 3.", None, None, 0), (903, "under the mit", None, None, 0)]
    got = {r["doc_id"]: r for r in rows(license_scan.scan(spark.createDataFrame(extra, DOC)))}
    assert (got[900]["n_base"], got[900]["first_word"], got[900]["last_word"], got[900]["base_labels"]) == (3, 1, 9, "cc-by-nc,mit")
    assert got[901]["base_labels"] == "apache-2" and got[901]["score"] == 1.0
    assert got[902]["base_labels"] == "" and got[902]["labels"] == "gpl-3" and 0.6 <= got[902]["score"] < 1
    assert (got[903]["n_base"], got[903]["first_word"], got[903]["labels"], got[903]["score"]) == (0, None, "", 0.0)
    out = Counter((r["doc_id"], r["n_words"]) for r in rows(license_scan.scan(docs)))
    assert out == Counter((i, len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t)))) for i, t, *_ in corpus)


def test_license_base_places(spark, docs, corpus):
    """Base columns against a walk over the words: repeated rows, long texts, phrases torn apart or run together."""
    parts = [w for phrase, _ in license_scan.BASE for w in phrase.split()] + ["Under THE mit license", "cc-by-nc", "cc by nc", "word", "é"]
    drawn = [(i % 90, " ".join(RNG.choice(parts) for _ in range(RNG.randrange(0, 40))), None, None, 0) for i in range(120)]
    drawn += [drawn[3], drawn[3], (500, "cc by nc " * 9000, None, None, 0), (None, "Apache license version 2", None, None, 0), (501, None, None, None, 0)]
    want = Counter()
    for doc, text, *_ in drawn:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        places = [(i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places]
        want[doc, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))] += 1
    out = rows(license_scan.scan(spark.createDataFrame(drawn, DOC).repartition(3)))
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out) == want
    for r in out:
        labels = r["labels"].split(",") if r["labels"] else []
        assert labels == sorted(set(labels)) and set(filter(None, r["base_labels"].split(","))) <= set(labels) and 0 <= r["score"] <= 1
        assert r["score"] == 1 or not r["n_base"]


# ------------------------------------------------------------------ 5 fingerprints


def test_fingerprints(docs, corpus, spark):
    found = re.compile(fingerprints.PARAGRAPH)
    once = sorted({(i, t) for i, t, *_ in corpus if i is not None and t}, key=lambda x: x[0], reverse=True)
    once = [x for x, n in Counter(i for i, _ in once).items() for x in [next(y for y in once if y[0] == x)]]
    frame = spark.createDataFrame([(i, t, None, None, 0) for i, t in once] + [(500, None, None, None, 0)], DOC)
    order = [(500, ""), *once] if max(i for i, _ in once) < 500 else None
    got = {r["doc_id"]: r for r in rows(fingerprints.fingerprint(frame))}

    def share(a, b):
        a, b = set(found.findall(a)), set(found.findall(b))
        return len(a & b) / len(a | b) if a | b else 1.0

    for (i, text), (_, after) in zip(order, [*order[1:], order[0]]):
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r["near_edited"] - share(text, edited)) < 1e-12 and abs(r["near_next"] - share(text, after)) < 1e-12
    assert len(rows(fingerprints.fingerprint(docs))) == len(corpus)


def test_equal_texts_have_equal_fingerprints(docs, corpus):
    text = {}
    for r in rows(fingerprints.fingerprint(docs.where("doc_id is not null"))):
        text.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    by = defaultdict(set)
    for i, t, *_ in corpus:
        if i is not None:
            by[t or ""] |= text[i]
    assert all(len(f) == 1 for f in by.values()) and len({f for s in by.values() for f in s}) > 40


# ------------------------------------------------------------------ 6 repeated passages


def test_suffix_dedup(docs, corpus):
    length = 100
    texts = {(r[0], r[1] or "") for r in corpus}
    seen, want = {}, {}
    for doc_id, text in sorted(texts, key=lambda x: (x[0] is None, x[0] or 0)):
        data, new = text.encode(), {}
        cover = np.zeros(len(data) + 1, dtype=int)
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in new or seen.get(w, doc_id) != doc_id:
                cover[s] += 1
                cover[s + length] -= 1
            new.setdefault(w, s)
        for w in new:
            seen.setdefault(w, doc_id)
        out = np.cumsum(cover)[:-1] > 0
        kept = np.frombuffer(data, dtype=np.uint8)[~out].tobytes()
        want[doc_id, text] = (len(data), int(out.sum()), int((np.diff(np.concatenate([[0], out.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(suffix_dedup.dedup(docs)))
    assert got == Counter((r[0], *want[r[0], r[1] or ""]) for r in corpus)
    assert any(r[2] for r in got)


# ------------------------------------------------------------------ 7 SentencePiece


def test_n_best_is_exact():
    lattice = pieces.Lattice(pieces.model_path(), 4)

    def every(word, at=0):
        if at == len(word):
            yield 0.0
        for end in range(at + 1, len(word) + 1):
            score = lattice.score_of.get(word[at:end], lattice.unknown if end == at + 1 else None)
            if score is not None:
                yield from (score + s for s in every(word, end))

    for word in ["▁the", "▁thndhain", "▁▁ab", "▁éèauß.", "▁日本ok", "\n", "▁a"]:
        assert [s for s, _ in lattice.best(word)] == sorted(every(word), reverse=True)[:4]
    encoder = pieces.Encoder(pieces.model_path(), 4)
    for text in ["of the hand", " x  y ", "Anble wher athawh", "日 é\n\n z"]:
        assert [s for s, _ in encoder.encode(text)] == [s for s, _ in lattice.best((" " + text).replace(" ", "▁"))]


def test_passes_over_many_words_equal_those_over_one():
    lattice = pieces.Lattice(pieces.model_path(), 3)
    trie = pieces.Trie(lattice)
    words = ["▁the", "a", "\n", "▁▁▁ab", "日本", "▁éèauß.", "😀x", *(w.replace(" ", "▁") for w in prose(300, "|").split("|"))]
    codes = np.array([ord(c) for c in "".join(words)], dtype=np.int64)
    top, loss, ids, count = trie.passes(codes, np.array(list(map(len, words))))
    upto = np.concatenate([[0], np.cumsum(count)])
    for i, w in enumerate(words):
        assert (top[i], loss[i], ids[upto[i] : upto[i + 1]].tobytes()) == lattice.viterbi(w)


def test_sentencepiece_of_one_long_word_and_of_other_scripts():
    encoder = pieces.Encoder(pieces.model_path(), 2, keep=1)  # forgets after every call
    r = random.Random(5)
    for text in ["ab" * 150_000, "".join(r.choice("abcdexyz") for _ in range(50_000)), "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(50_000)), "😀\n" * 3, "\x00 \t▂"]:
        best = encoder.encode_all([text, "", text])
        assert best[0] == best[2] and encoder.decode(best[0][0][1]) == text
        assert abs(best[0][0][0] - encoder.lattice.viterbi("▁" + text.replace(" ", "▁"))[0]) < 1e-6 * abs(best[0][0][0])
        assert best[1] == [(0.0, b"")]


def test_sentencepiece_round_trip(docs, corpus):
    out = pieces.encode(docs, pieces.model_path())
    assert all(r["decodes"] and r["scores"] == sorted(r["scores"], reverse=True) for r in rows(out))
    back = Counter((r["doc_id"], r["text"]) for r in rows(pieces.decode(out, pieces.model_path())))
    assert back == Counter((i, t or "") for i, t, *_ in corpus)


# ------------------------------------------------------------------ 8 language ID and 10 toxicity: held-out accuracy


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_id.remainder("doc_id", 4) == 2
    got = language_id.predict(docs.where(held), language_id.fit(docs.where(~held)), ["doc_id", "lang"])
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count() > 0


def test_language_id_defined_cases(spark, docs, empty):
    model = language_id.fit(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 .,"), (4, "a")], "doc_id long, text string")
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows(language_id.predict(odd, model, ["doc_id"]))}
    assert out[1] == out[2] == out[3] == ("und", 0.0)
    assert {r["lang_pred"] for r in rows(language_id.predict(odd, language_id.fit(empty), ["doc_id"]))} == {"und"}
    assert rows(language_id.predict(empty, model, ["doc_id"])) == []


def test_language_fit_draws_per_language(spark):
    """A language of few rows among many of another is learned in full, and the others fill the sample."""
    own = ["фыва олдж", "шгнек апро", "тьбю йцук"]
    table = [(i if i % 3 else None, f"common words of the large language {i}", "en") for i in range(2000)]
    table += [(i, f"weitere Wörter der zweiten Sprache {i}", "de") for i in range(300)]
    table += [(i, own[i % 3], "ru") for i in range(6)]
    frame = spark.createDataFrame(table, "doc_id long, text string, lang string").repartition(3)
    keyed = frame.selectExpr("lang", "text", "xxhash64(doc_id, text) draw")
    assert Counter(r["lang"] for r in language_id.drawn(keyed, 100).collect()) == {"en": 47, "de": 47, "ru": 6}
    assert language_id.drawn(keyed, 1 << 20).count() == len(table)
    assert Counter(r["lang"] for r in language_id.drawn(keyed, 2).collect()) == {"en": 1, "de": 1, "ru": 1}
    assert [language_id.quota([6, 300, 2000], x) for x in (2, 100, 700, 5000)] == [1, 47, 394, 2000]
    model = language_id.fit(frame, sample=100)
    assert {r["lang_pred"] for r in rows(language_id.predict(frame.where("lang = 'ru'"), model, ["doc_id"]))} == {"ru"}


def test_language_fit_of_more_than_64_languages(spark):
    """Each has letters of its own, so that none can stand for another."""
    letters = [c for c in map(chr, range(0x4E00, 0x4E00 + 400))]
    word = lambda i: " ".join("".join(letters[4 * i : 4 * i + 4]) for _ in range(9))
    table = [(i, word(i % 100), f"l{i % 100:03}") for i in range(300)]
    frame = spark.createDataFrame(table, "doc_id long, text string, lang string")
    model = language_id.fit(frame)
    assert len(model.langs) == 100
    got = rows(language_id.predict(frame, model, ["lang"]))
    assert len(got) == 300 and all(r["lang"] == r["lang_pred"] and r["score"] > 0.9 for r in got)


def test_bloom_filter_rates():
    rng = np.random.default_rng(1)
    grams = [rng.integers(0, 1 << 63, 30_000, dtype=np.uint64) for _ in range(3)]
    model = language_id.Filter(["a", "b", "c"], grams)
    assert ((model.masks(grams[1]) >> 1) & 1).all()
    other = model.masks(rng.integers(0, 1 << 63, 200_000, dtype=np.uint64))
    assert abs(((other >> 2) & 1).mean() - model.false_rate[2]) < 1e-3


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(toxicity.labelled_rows(spark, docs, sf))
    got = model.score(docs.where(toxicity.remainder("doc_id", 5) == 0), ["doc_id"]).join(labels, "doc_id")
    right = got.where("(score >= 0.5) = (toxic = 1)").count()
    assert right >= 0.9 * got.count() > 0
    assert got.where("score < 0 or score > 1").count() == 0


def test_toxicity_defined_cases(spark, docs, empty, corpus):
    nothing = toxicity.fit(docs.selectExpr("doc_id", "text", "cast(null as int) toxic"))
    assert {r["score"] for r in rows(nothing.score(docs, ["doc_id"]))} == {0.0}
    assert len(rows(toxicity.with_features(docs, [{"hand": 3, "thor*": 1}], ["doc_id"]))) == len(corpus)
    words = toxicity.Words({"idiot": 3, "veju*": 2})
    assert [words[w] for w in ("Idiot!", "1d1ot", "vejuxx", "you", "hello", "idiooot")] == [3, 3 | 8, 2, 4, 0, 3 | 8]


def test_toxicity_of_few_labels_and_clashing_names(spark, empty):
    """Fewer rows of a label than parts still make a model; columns named like the operator's own do no harm."""
    from pyspark.sql import functions as F

    known = [(i, ["you stupid vile idiot " * 3, "a calm day at the sea side"][i % 4 > 0], int(i % 4 == 0)) for i in range(14)]
    model = toxicity.fit(spark.createDataFrame(known, "doc_id long, text string, toxic int"))
    assert model.trees is not None and toxicity.fit(empty.withColumn("toxic", F.lit(1))).trees is None
    docs = spark.createDataFrame([*known, (99, None, 0), (None, "", 0)], "doc_id long, text string, toxic int")
    docs = docs.withColumns({"x": F.lit("x"), "score": F.lit(7), "_raw": F.lit("r"), "lexicon": F.lit(9), "_features": F.lit(0)})
    got = rows(model.score(docs, ["doc_id"]))
    assert len(got) == 16 and all(0 <= r["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[0] > score[1] and rows(model.score(empty, ["doc_id"])) == []


# ------------------------------------------------------------------ 9 sharding


def test_sharding(docs, corpus):
    out = rows(sharding.shard(docs))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in corpus)
    by = defaultdict(list)
    for r in out:
        assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_sharding_draws(docs, corpus):
    """Shards by an independent descent: at each level the child of least exponential draw."""

    def descend(key, shards):
        at, tree = "", defaultdict(dict)
        for s in range(shards):
            region, rack = (f"r{s // 20}", f"k{s // 5}") if s < 40 else (f"g{s}", f"k{s}")
            for parent, child in (("", region), (region, f"{region}/{rack}"), (f"{region}/{rack}", f"{region}/{rack}/s{s}")):
                tree[parent][child] = tree[parent].get(child, 0) + 1  # weight: shards below
        while at in tree:
            unit = {c: (int(hashlib.md5(f"{key}/{c}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48 for c in tree[at]}
            at = min(tree[at], key=lambda c: -np.log(unit[c]) / tree[at][c])
        return int(at.rsplit("s", 1)[1])

    keys = {i: "null" if i is None else str(i) for i, *_ in corpus}
    want = {i: (descend(key, 40), descend(key, 41)) for i, key in keys.items()}
    assert all((r["shard"], r["grown_shard"]) == want[r["doc_id"]] for r in rows(sharding.shard(docs)))


def test_sharding_weights(spark):
    from pyspark.sql import functions as F

    ids = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    tree = sharding.layout(40)
    before = sharding.descend(F.col("key"), tree)
    after = sharding.descend(F.col("key"), tree, {7: 3.0})
    counts = ids.select(before.alias("a"), after.alias("b")).groupBy("a", "b").count().collect()
    n = Counter()
    for r in counts:
        n[r["b"]] += r["count"]
        # movement is confined to the region whose weight changed
        assert r["a"] == r["b"] or r["b"] // 20 == 0
    assert abs(n[7] - 20_000 * 3 / 42) < 250 and all(300 < n[s] < 700 for s in range(40) if s != 7)


# ------------------------------------------------------------------ all on an empty table


def test_empty_tables(empty):
    for frame in (jaccard_join.join(empty), packing.pack(empty, packing.tokenizer_path()), license_scan.scan(empty), fingerprints.fingerprint(empty), suffix_dedup.dedup(empty), pieces.encode(empty, pieces.model_path()), sharding.shard(empty)):
        assert rows(frame) == []


# ------------------------------------------------------------------ pipeline


def brute_groups(table, k, num, den):
    """Row numbers of every group of linked rows; rows without a word are in none."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", lowered(row[1])) for row in table]
    sets = [{tuple(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)} if w else set() for w in words]
    group = {i: {i} for i, s in enumerate(sets) if s}
    for i, j in itertools.combinations(group, 2):
        both = len(sets[i] & sets[j])
        if group[i] is not group[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
            group[i] |= group[j]
            for x in group[j]:
                group[x] = group[i]
    return list({id(g): g for g in group.values()}.values())


def test_stage_keeps_one_row_of_each_group(spark, corpus):
    """Null and repeated ids: one row of every group of linked texts, and all texts that link with nothing."""
    import corpus_pipeline

    a, b, c, d = (prose(80) for _ in range(4))
    odd = [(5, a), (5, b), (3, b), (None, c), (None, d), (None, d), (9, d + " end"), (None, ""), (None, None), (None, "  "), (4, ""), (4, "")]
    table = [*corpus, *((i, t, "en", "s", len(t or "")) for i, t in odd)]
    got = Counter((r["doc_id"], r["text"]) for r in rows(corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(table, DOC).repartition(3), "")))
    assert got[5, a] == got[3, b] == got[None, c] == got[9, d + " end"] == 1 and (5, b) not in got and (None, d) not in got

    groups = brute_groups(table, 5, 80, 100)
    assert set(got.values()) == {1} and set(got) <= {r[:2] for r in table}
    for members in groups:
        ids = [table[i][0] for i in members if table[i][0] is not None]
        kept = {table[i][:2] for i in members} & set(got)
        assert len(kept) == 1 and next(iter(kept))[0] == min(ids, default=None)
    linked = {table[i][:2] for g in groups for i in g}
    assert {r[:2] for r in table} - linked == set(got) - linked


def test_texts_of_one_id_with_equal_short_hashes_are_told_apart(spark):
    """Two texts of one id, and two without id, whose 32-bit hashes are equal, beside one that repeats a passage of theirs."""
    from pyspark.sql import functions as F

    passage = "".join(RNG.choice("abcdefgh ") for _ in range(200))
    drawn = spark.range(400_000).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit(passage), F.col("id"))).otherwise(F.concat(F.lit("w"), F.col("id"))).alias("text")).withColumn("h", F.hash("text"))
    both = drawn.groupBy("h").agg(F.min("text").alias("a"), F.max("text").alias("b"), F.countDistinct(F.length("text") > 100).alias("n")).where("n = 2").orderBy("h").first()
    assert both
    rows_ = [(None, both.a), (None, both.b), (7, both.a), (7, both.b), (1, passage)]
    frame = spark.createDataFrame(rows_, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.kept_text) for r in suffix_dedup.dedup(frame).collect())
    long, short = sorted((both.a, both.b), key=len, reverse=True)
    assert got == sorted([(0, len(long), len(long), ""), (0, len(short), 0, short), (7, len(long), 200, long[200:]), (7, len(short), 0, short), (1, 200, 0, passage)])
