"""Cross-tokenizer alignment against brute force with the tokenizers' own libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

pytest.importorskip("evidentia.llm")
P = pytest.importorskip("public_tokenizers")

from evidentia.llm import token_alignment as t  # noqa: E402

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
RNG = random.Random(11)
DOCS = "doc_id long, text string, pairs string, row int, n_a string"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def docs():
    syllables = ["tha", "er", "ünd", "Öl", "çois", "日本語", "x1", "=", "'s", "!!", "é", "́", "👍🏽", "ing", "<s>", "<0x41>"]
    word = lambda: "".join(RNG.choice(syllables) for _ in range(RNG.randrange(1, 5)))
    texts = [None, "", " ", "  ", "\n", "a", "▁", "a▁b c", " lead", "trail ", "two  blanks", "tab\t x", "<|endoftext|> is text", "a <|endoftext|>b", "</s> <unk>", "nul\x00 byte", " wide", "x" * 300, " " * 500, "ab" * 900 + " z", "é" * 200, "\r\n \n x"]
    texts += [" ".join(word() + RNG.choice(["", "", ".", "\n", ",\n\n"]) + word() * RNG.randrange(2) for _ in range(RNG.randrange(1, 80))) for _ in range(40)]
    texts += [" ".join(word() for _ in range(9000)), texts[25], texts[25], texts[30]]
    return [(RNG.choice([i, i, 7, None]), x, "p", 1, "n") for i, x in enumerate(texts)]


def tokens(libraries, text):
    """Ids and ends of both sides, or None."""
    a, b = libraries
    whole = " " + text
    byte = t.byte_characters()
    enc = a.encode(whole, add_special_tokens=False)
    ids_b = b.encode(text)
    bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in enc.ids]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != whole.encode() or b"".join(bytes_b) != whole.encode():
        return None
    ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))] if len(parts) < 3000 else list(__import__("itertools").accumulate(map(len, parts)))
    return enc.ids, ends(bytes_a), ids_b, ends(bytes_b)


def groups(tok):
    ids_a, end_a, ids_b, end_b = tok
    out, i, j = [], 0, 0
    for cut in sorted(set(end_a) & set(end_b)):
        g = ([], [])
        while i < len(ids_a) and end_a[i] <= cut:
            g[0].append(ids_a[i])
            i += 1
        while j < len(ids_b) and end_b[j] <= cut:
            g[1].append(ids_b[j])
            j += 1
        out.append(g)
    return out


def brute(libraries, docs):
    found, counts = [], Counter()
    for doc_id, text, *_ in docs:
        tok = tokens(libraries, text) if text else None
        gs = groups(tok) if tok else []
        links = Counter((x, y) for g in gs for x in g[0] for y in g[1])
        counts.update(links.keys())
        found.append((doc_id, tok, gs, links))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    out = []
    for doc_id, tok, gs, links in found:
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in gs)
        out.append((doc_id, len(tok[0]) if tok else 0, len(tok[2]) if tok else 0, len(gs), sum(links.values()), sum(m for k, m in links.items() if counts[k] == top[k[0]]), sum(m * counts[k] for k, m in links.items()), hashlib.sha256(text.encode()).hexdigest() if tok else ""))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("small", [False, True])
def test_alignment_equals_brute_force(spark, libraries, docs, monkeypatch, small):
    if small:
        for name, value in {"TOKENS": 900, "STRETCH": 70, "EXPANDED": 500, "BUFFER": 300, "LARGE_GROUP": 3, "CHUNK_BYTES": 2000}.items():
            monkeypatch.setattr(t, name, value)
    got = t.alignment(spark.createDataFrame(docs, DOCS).repartition(3), A, B, set_rows=150 if small else t.SET_ROWS)
    assert got.columns == COLUMNS
    assert [k for _, k in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted(map(key, got.collect())) == sorted(map(key, brute(libraries, docs)))


def test_overlaps_equal_brute_force(spark, libraries, docs, monkeypatch):
    monkeypatch.setattr(t, "STRETCH", 50)
    some = [d for d in docs if d[1] and len(d[1]) < 5000]
    numbered = [(i, *d[1:]) for i, d in enumerate(some)]
    got = defaultdict(set)
    for r in t.overlaps(spark.createDataFrame(numbered, DOCS), A, B).collect():
        got[r.doc_id].add((r.a_token, r.b_token, r.a_id, r.b_id, r.start, r.end, r.group_start))
    for i, text, *_ in numbered:
        tok, want = tokens(libraries, text), set()
        if tok:
            spans = [list(zip([0, *ends], ends)) for ends in (tok[1], tok[3])]
            cuts = sorted({0} | set(tok[1]) & set(tok[3]))
            j = 0
            for x, (a0, a1) in enumerate(spans[0]):
                while spans[1][j][1] <= a0:
                    j += 1
                y = j
                while y < len(spans[1]) and spans[1][y][0] < a1:
                    b0, b1 = spans[1][y]
                    want.add((x, y, tok[0][x], tok[2][y], max(a0, b0), min(a1, b1), max(c for c in cuts if c <= a0)))
                    y += 1
        assert got[i] == want, text[:80]


def test_word_memory_is_bounded(libraries):
    both = t.Tokenizers(A, B, keep=5000)
    for i in range(200):
        both.learn({f"w{i}", "x" * i or "y"})
        assert len(both.known) < 60 and both.known[f"w{i}"] is not None


def test_packed_pairs_round_trip():
    import numpy as np

    pair, links = np.array([0, 5, 1 << 40]), np.array([1, 70000, 2])
    assert [x.tolist() for x in t.unpacked(t.packed(pair, links))] == [pair.tolist(), links.tolist()]


def test_empty_table(spark):
    assert t.alignment(spark.createDataFrame([], DOCS), A, B).count() == 0
    assert [tuple(r) for r in t.alignment(spark.createDataFrame([(1, None, "", 0, "")], DOCS), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_encodings_equal_the_libraries_on_every_document(libraries):
    import duckdb

    a, b = libraries
    both = t.Tokenizers(A, B)
    rows = duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text <> ''").fetchall()
    import pyarrow as pa

    import numpy as np

    batch = pa.RecordBatch.from_pydict({"text": [r[0] for r in rows]})
    got = defaultdict(lambda: (b"", b""))
    for row, x, y in t.stretches(both, batch):
        got[row] = (got[row][0] + x, got[row][1] + y)
    for i, (text,) in enumerate(rows):
        want = np.asarray(a.encode(" " + text, add_special_tokens=False).ids, "<u4").tobytes(), np.asarray(b.encode(text), "<u4").tobytes()
        assert got[i] == want or i not in got and tokens(libraries, text) is None
