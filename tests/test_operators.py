"""Exact arithmetic, invariants, readers and streams on literal tables."""

import json
import re

import pytest
from pyspark.sql import functions as F

from evidentia import sources, streaming
from evidentia.operators import admission, graphs, joins, ledger, rank, text


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rrf_by_hand(spark):
    dense = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, rank int")
    leaf = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, id long, rank int")
    got = {r["id"]: (r["rank"], r["score"]) for r in rank.rrf_pair(dense, leaf).collect()}
    assert got == {11: (1, pytest.approx(0.4 / 62 + 0.6 / 61)), 12: (2, pytest.approx(0.6 / 62)), 10: (3, pytest.approx(0.4 / 61))}


def test_greedy_budget_skips_ahead(spark):
    df = spark.createDataFrame([(1, 1, 60, 1), (1, 2, 60, 2), (1, 3, 40, 3), (1, 4, 1, 4)], "query_id long, id long, size long, rank int")
    assert [(r[1], r[3]) for r in rows(rank.greedy_budget(df, 100, 2))] == [(1, "admitted"), (2, "budget"), (3, "admitted"), (4, "limit")]


def test_admission_keeps_mandatory_rows(spark):
    df = spark.createDataFrame([(1, 1, True, "history", 0.0, 5000), (1, 2, False, "decisions", 0.9, 10)], "request_id long, id long, mandatory boolean, section string, score double, size long")
    assert rows(admission.admit(df)) == [(1, 1, "mandatory"), (1, 2, "budget")]


def test_greedy_choices_have_no_page(spark):
    """One key with more rows than the pages that the folds once had, against plain loops, beside a small one."""
    n = 3000
    budget = spark.range(n).selectExpr("id % 2 * (id % 3) query_id", "id", "id * 7919 % 211 + 1 size", "cast(id as int) rank").repartition(5)
    for limit, most in ((64, 900), (4000, 5000)):
        want, state = [], {}
        for r in budget.orderBy("query_id", "rank").collect():
            used, k = state.get(r["query_id"], (0, 0))
            reason = "limit" if k >= limit else "budget" if used + r["size"] > most else "admitted"
            state[r["query_id"]] = (used + r["size"], k + 1) if reason == "admitted" else (used, k)
            want.append((r["query_id"], r["id"], r["rank"], reason))
        assert rows(rank.greedy_budget(budget, most, limit)) == sorted(want)

    asked = spark.range(n).selectExpr("id % 2 request_id", "id", "id % 4 = 0 mandatory", "array('history', 'authority', 'other')[id % 3] section", "cast(id * 31 % 101 as double) score", "id % 7 * 40 + 3 size").repartition(5)
    place = {"authority": 0, "history": 4, "other": 5}
    want, used = [], {}
    for r in sorted(asked.collect(), key=lambda r: (r["request_id"], not r["mandatory"], place[r["section"]], -r["score"], r["id"])):
        fits = used.get(r["request_id"], 0) + r["size"] <= 2000
        if r["mandatory"] or fits:
            used[r["request_id"]] = used.get(r["request_id"], 0) + r["size"]
        want.append((r["request_id"], r["id"], "mandatory" if r["mandatory"] else "admitted" if fits else "budget"))
    assert rows(admission.admit(asked)) == sorted(want)

    pairs = spark.range(n).selectExpr("id % 10 div 9 case_id", "id div 2 left", "(id + 1) div 2 right", "id turn").repartition(5)
    want, taken = [], set()
    for r in pairs.orderBy("case_id", "turn").collect():
        sides = {(r["case_id"], "l", r["left"]), (r["case_id"], "r", r["right"])}
        if not sides & taken:
            taken |= sides
            want.append(tuple(r[c] for c in ("case_id", "left", "right", "turn")))
    assert rows(joins.greedy_match(pairs)) == sorted(want)


def test_dependencies_within_a_budget(spark):
    """Against a recursive walk, on random graphs with cycles, missing and mandatory ids."""
    import random

    draw = random.Random(5)
    edges = sorted({(draw.randrange(40), draw.randrange(44)) for _ in range(90)} | {(50, 51), (51, 50)})
    sizes = {i: (draw.randrange(1, 9), i % 7 == 0) for i in (*range(40), 50, 51) if i % 9}
    selected = sorted({(r, draw.randrange(40)) for r in range(6) for _ in range(3)}) + [(9, 50)]
    want = set()
    for request in {r for r, _ in selected}:
        mine = {i for r, i in selected if r == request}
        used = sum(sizes.get(i, (0, 0))[0] for i in mine)
        roots = sorted(mine - {b for a, b in edges if a in mine}) or sorted(mine)

        def walk(path):
            nonlocal used
            for b in [b for a, b in edges if a == path[-1]]:
                if b in path:
                    want.add((request, path[-1], b, "dependency-cycle"))
                elif b not in mine:
                    if len(path) > 2 or b not in sizes:
                        want.add((request, path[-1], b, "depth-cap" if len(path) > 2 else "unavailable"))
                        continue
                    size, mandatory = sizes[b]
                    if used + size > 25 and not mandatory:
                        want.add((request, path[-1], b, "budget"))
                        continue
                    want.add((request, path[-1], b, "added"))
                    mine.add(b)
                    used += size
                    if len(path) <= 2:
                        walk([*path, b])
                elif b in sizes and len(path) <= 2:
                    walk([*path, b])

        for root in roots:
            walk([root])
    got = admission.fit_dependencies(
        spark.createDataFrame(selected, "request_id long, id long"), spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(i, *v) for i, v in sizes.items()], "id long, size long, mandatory boolean"), 25)
    assert rows(got) == sorted(want)
    assert {r[3] for r in want} == {"added", "budget", "depth-cap", "unavailable", "dependency-cycle"}


def test_fixpoint_reaches_the_end(spark):
    """Long chains, a cycle longer than the former cap with a tail into it, a self link and a node without a successor."""
    edges = [(i, i + 1) for i in range(45)] + [(100 + i, 100 + (i + 1) % 20) for i in range(20)] + [(150, 151), (151, 103), (200, 200)]
    origins = [*range(0, 46, 5), 100, 119, 150, 200, 300]
    want = [(i, 45, 45 - i, False) for i in range(0, 46, 5)] + [(i, None, None, True) for i in (100, 119, 150, 200)] + [(300, 300, 0, False)]
    got = joins.fixpoint(spark.createDataFrame([(i,) for i in origins], "origin long"), spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == want


def test_token_chunks_cover(spark):
    docs = spark.createDataFrame([(1, "One two three. " * 200), (2, "x"), (3, ""), (4, None)], "doc_id long, text string")
    chunks = text.token_chunks(docs, 50, 10, 20).withColumn("sha", F.lit(None).cast("string"))
    assert rows(text.audit_chunks(chunks, docs)) == []
    assert {r["doc_id"] for r in chunks.collect()} == {1, 2}


def test_headings_and_references(spark):
    docs = spark.createDataFrame([(1, "1. Scope\nSee clause 2.1 and Section 9.\n2.1 Terms\nSCHEDULE A: Prices\nGENERAL TERMS")], "doc_id long, text string")
    heads = text.headings(text.lines(docs))
    assert [(r["kind"], r["identifier"], r["depth"]) for r in heads.orderBy("line").collect()] == [("numbered", "1", 1), ("numbered", "2.1", 2), ("schedule", "A", 1), ("named", "GENERAL TERMS", 2)]
    entries = heads.selectExpr("doc_id", "line id", "identifier", "start", "false malformed")
    assert [(r["identifier"], r["status"]) for r in text.resolve_references(docs, entries).orderBy("start").collect()] == [("2.1", "resolved"), ("9", "unresolved_absent"), (None, "unparsed")]


def test_references_by_hand(spark):
    body = "Clauses 1, 2(a) and 3.1B apply.\nSee schedules A1 to 4; exhibit B.\nsection 7 of the Fire Act 1999 and clause of it, or Sections 8, 9 clause 2(a)"
    docs = spark.createDataFrame([(1, body), (2, ""), (3, None), (4, "clause"), (5, "no keyword: clausex 1")], "doc_id long, text string")
    entries = spark.createDataFrame([(1, 7, "2(a)", 9, False), (1, 8, "2(a)", 3, False), (1, 9, "1", 0, True), (1, 5, "Schedule 4", 0, False)], "doc_id long, id long, identifier string, start long, malformed boolean")
    got = sorted(map(tuple, text.resolve_references(docs, entries).collect()))
    cited = lambda r: (body[r[1] : r[2]], *r[3:])
    assert [cited(r) for r in got if r[0] == 1] == [
        ("Clauses 1", "clause", "1", "unresolved_absent", None), ("2(a)", "clause", "2(a)", "resolved", 8), ("3.1B", "clause", "3.1B", "unresolved_absent", None),
        ("schedules A1", "schedule", "Schedule A1", "unresolved_absent", None), ("4", "schedule", "Schedule 4", "resolved", 5), ("exhibit B", "exhibit", None, "unparsed", None),
        ("section 7 of the Fire Act 1999", "section", "Fire Act 1999§7", "unresolved_absent", None), ("clause of it", "clause", None, "unparsed", None),
        ("Sections 8", "section", "8", "unresolved_absent", None), ("clause 2(a)", "clause", "2(a)", "resolved", 8)]
    assert [r for r in got if r[0] != 1] == [(4, 0, 6, "clause", None, "unparsed", None)]


def test_relations_against_brute_force(spark):
    parts = [
        "The Contractor must not commence any construction work under this deed until approved.", "It must not commence the song until noon.",
        "The parties acknowledge that access is given prior to the start of work.", "They acknowledge that it must be done prior to the start of work.", "The condition of the site agreed before access to it.",
        "On or before the deadline for final completion; ok.", "BEFORE commencing, read.\n\nUnless and until\n\n2.1 approved, no access", "before it\n\n(a) starts work",
        "x", "", "\n\n", "A condition precedent to the work is insurance completed before any access.",
    ]
    texts = [(i, " ".join(parts[j % len(parts)] + ("\n\n" if (i + j) % 3 == 0 else "") for j in range(i, i + 4))) for i in range(24)] + [(90, None), (91, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = text.scan_relations(docs).withColumn("id", F.concat_ws(":", "relation", "start"))
    want, reasons = [], []
    for doc, body in texts:
        for name, weight, pattern in text.RELATION_RULES:
            for m in re.finditer(pattern, body or "", re.I | re.S):
                wide = name in text.PROJECT_WIDE or re.search(text.PROJECT_WIDE_WORDING, m[0], re.I)
                want.append((doc, name, weight, m.start(), m.end(), "project_wide" if wide else "activity_conditional", f"{name}:{m.start()}"))
                cut = body.rfind("\n\n", 0, m.start())
                frame = body[cut + 2 if cut >= 0 else max(0, m.start() - 320) : m.start()]
                says = [a.end() for a in re.finditer(text.ACKNOWLEDGEMENT, frame, re.I)]
                core = re.match(r"(.*?\b(?:before|unless\s+and\s+until)\b.*?" + text.START_EVENT + ")", m[0], re.I | re.S)
                until = re.search(r"\b(?:until|unless)\b", m[0], re.I)
                why = None
                if name in ("before_access_or_work", "unless_until_commencement") and re.search(text.BOUNDARY, core[1] if core else m[0]):
                    why = "crosses_boundary"
                elif says and not re.search(text.MODAL, frame[says[-1] :], re.I):
                    why = "acknowledgement"
                elif name in ("prior_to_commencing", "before_access_or_work") and re.search(text.BASELINE, frame[-320:], re.I | re.S):
                    why = "baseline_time"
                elif name == "noncommencement_until" and not re.search(text.START_EVENT, frame[-180:] + m[0][: until.start()], re.I):
                    why = "other_target"
                elif re.search(text.POST_START, re.match(r"[^.;]*[.;]?", m[0])[0], re.I):
                    why = "post_start"
                reasons.append((doc, f"{name}:{m.start()}", why))
    assert rows(found) == sorted(want)
    assert {r[2] for r in reasons} == {None, "crosses_boundary", "acknowledgement", "baseline_time", "other_target", "post_start"}
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, text.exclude_relations(found, docs).collect()), key=key) == sorted(reasons, key=key)


def test_verbatim_overlap_against_brute_force(spark):
    import random

    draw = random.Random(3)
    texts = [" ".join(draw.choice("a b c the".split()) for _ in range(draw.randrange(0, 60))) for _ in range(40)]
    pairs = [(i, texts[i], texts[(i * 7 + 3) % 40]) for i in range(40)] + [(50, texts[0] + " x y", "z " + texts[0] + " w"), (51, texts[1], texts[1]), (52, None, "a"), (53, "", ""), (54, "A", "a!")]

    def run(a, b):
        a, b = (re.findall(r"[a-z0-9]+", (t or "").lower()) for t in (a, b))
        seen = lambda t, k: {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
        return max([k for k in range(1, min(len(a), len(b)) + 1) if seen(a, k) & seen(b, k)], default=0)

    assert rows(text.verbatim_overlap(spark.createDataFrame(pairs, "pair_id long, a string, b string"))) == [(i, run(a, b)) for i, a, b in pairs]


def test_terms_of_any_length_within_their_scope(spark):
    docs = spark.createDataFrame([(1, "Net Sale Price of Goods is net sale price, of-goods"), (2, "goods"), (3, None)], "doc_id long, text string")
    terms = spark.createDataFrame([(1, "net sale price of goods"), (2, "Goods"), (3, "sale price")], "term_id long, surface string")
    assert rows(text.bind_terms(docs, terms)) == [(1, 1, 0, 23), (1, 1, 27, 51), (1, 2, 18, 23), (1, 2, 46, 51), (1, 3, 4, 14), (1, 3, 31, 41), (2, 2, 0, 5)]
    scoped = terms.selectExpr("term_id", "surface", "1L doc_id", "10L scope_start", "51L scope_end")
    assert rows(text.bind_terms(docs, scoped)) == [(1, 1, 27, 51), (1, 2, 18, 23), (1, 2, 46, 51), (1, 3, 31, 41)]


def test_definitions(spark):
    body = "1 Definitions\n\nGoods\nmeans things; and\nmore\n \n(a) x\nThe Price includes tax.  \n\nno. term means y\n\n2 Other\n\nLate means z"
    docs = spark.createDataFrame([(1, body), (2, "Goods means x"), (3, ""), (4, None)], "doc_id long, text string")
    clause = body.index("2 Other")
    entries = spark.createDataFrame([(1, 1, 0, clause, "Definitions"), (1, 2, clause, len(body), "Other"), (2, 1, 0, 13, "Definitions")], "doc_id long, id long, start long, end long, title string")
    parts = spark.createDataFrame([(1, 0, 0, 200), (2, 0, 0, 5), (2, 1, 5, 13)], "doc_id long, scope long, start long, end long")
    got = sorted(map(tuple, text.definitions(docs, entries, parts).collect()))
    assert [(r[1], body[r[2] : r[3]], body[r[4] : r[5]]) for r in got if r[0] == 1] == [("Goods", "Goods", "\nmeans things; and\nmore\n \n(a) x"), ("The Price", "The Price", " includes tax.  \n\nno. term means y")]
    assert [r for r in got if r[0] != 1] == [(2, "Goods", 0, 5, 5, 5, 1, 0, False)]


def test_cited_clause(spark):
    q = spark.createDataFrame([(1, "What does 2.1 say?"), (2, "1 or 2?"), (3, "9?")], "query_id long, question string")
    e = spark.createDataFrame([("2.1", 1, 5, 9), ("1", 1, 0, 5)], "identifier string, doc_id long, start long, end long")
    assert rows(text.cited_clause(q, e)) == [(1, "2.1", 1, 5, 9)]


def meaning(g):
    """What a graph of plain records says, without its ids."""
    names, preds, conds, at = dict(g["entities"]), {p[0]: p for p in g["predicates"]}, {c[0]: c for c in g["conditions"]}, {e[0]: i for i, e in enumerate(g["events"])}

    def code(k):
        if k is None or k in at:
            return k and ("event", at[k])
        if k in preds:
            _, s, comparator, value, unit, negated = preds[k]
            return names[s], comparator, *((24 * value, "hours") if unit == "days" else (value, unit)), negated
        return conds[k][1], tuple(sorted(map(repr, map(code, conds[k][2]))))

    return [(e[1], sorted((r, names.get(x)) for r, x in e[2].items()), *map(code, e[3:6])) for e in g["events"]], [(k, at[a], at[b]) for k, a, b in g["links"]]


def test_semantic_hash_says_what_a_graph_means(spark):
    """Equal where meanings are: renamed ids, shuffled arguments; unequal for other order, nesting, numbers, links and roles."""
    import copy
    import random

    draw = random.Random(6)
    base = {
        "entities": [("x", "Contractor"), ("y", "Principal"), ("z", "Contractor")], "predicates": [("p1", "x", "GE", 5.0, "days", False), ("p2", "y", "LT", 10.5, "AUD", True)],
        "conditions": [("c1", "all", ["p1", "p2"]), ("c2", "any", ["c1", "e1", "p2"]), ("c3", "not", ["c2"]), ("c4", "all", ["c3", "c1"])],
        "events": [(f"e{i}", f"act{i % 3}", {"actor": draw.choice("xyz"), "recipient": None}, draw.choice(["c4", "c2", "p1", None]), None, "e1" if i == 4 else None) for i in range(6)],
        "links": [("before", f"e{i}", f"e{(i + 1) % 6}") for i in range(6)],
    }
    graphs_ = [base]
    renamed = lambda v: f"n{v}" if isinstance(v, str) else [renamed(x) for x in v] if isinstance(v, list) else v
    other = {"entities": [(renamed(a), b) for a, b in base["entities"]], "predicates": [(renamed(p[0]), renamed(p[1]), *p[2:]) for p in base["predicates"]], "conditions": [(renamed(c[0]), c[1], renamed(c[2][::-1])) for c in base["conditions"]][::-1], "events": [(renamed(e[0]), e[1], {r: renamed(x) for r, x in e[2].items()}, *map(renamed, e[3:])) for e in base["events"]], "links": [(k, renamed(a), renamed(b)) for k, a, b in base["links"]]}
    graphs_.append(other)
    changes = [
        lambda g: g["events"].insert(2, g["events"].pop(3)), lambda g: g["links"].__setitem__(slice(None), [("before", f"e{a}", f"e{b}") for a, b in ((0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3))]),
        lambda g: g["predicates"].__setitem__(0, ("p1", "x", "GE", 5.25, "days", False)), lambda g: g["predicates"].__setitem__(0, ("p1", "z", "GE", 120.0, "hours", False)), lambda g: g["conditions"].__setitem__(2, ("c3", "not", ["c1"])),
        lambda g: g["events"].__setitem__(0, (*g["events"][0][:2], {"actor": "y", "recipient": "x"}, *g["events"][0][3:])), lambda g: g["links"].pop(), lambda g: g["entities"].__setitem__(1, ("y", "Owner")),
    ]
    for change in changes:
        g = copy.deepcopy(base)
        change(g)
        graphs_.append(g)
    broken = copy.deepcopy(base)
    broken["conditions"][0] = ("c1", "all", ["c4"])
    rows_ = {k: [] for k in ("entities", "predicates", "conditions", "args", "events", "roles", "links")}
    for n, g in enumerate([*graphs_, broken]):
        rows_["entities"] += [(n, *e) for e in g["entities"]]
        rows_["predicates"] += [(n, *p[:3], float(p[3]), *p[4:]) for p in g["predicates"]]
        rows_["conditions"] += [(n, *c[:2]) for c in g["conditions"]]
        rows_["args"] += [(n, c[0], a) for c in g["conditions"] for a in c[2]]
        rows_["events"] += [(n, e[0], i, e[1], "obligation", False, *e[3:], None, None) for i, e in enumerate(g["events"])]
        rows_["roles"] += [(n, e[0], r, x) for e in g["events"] for r, x in e[2].items()]
        rows_["links"] += [(n, i, *x) for i, x in enumerate(g["links"])]
    ddl = {"entities": "id string, name string", "predicates": "id string, subject string, comparator string, value double, unit string, negated boolean", "conditions": "id string, operator string", "args": "id string, arg string", "events": "id string, seq long, action string, modality string, negated boolean, condition string, exception string, complement string, revision string, time string", "roles": "id string, role string, entity string", "links": "seq long, kind string, source string, target string"}
    frames = {k: spark.createDataFrame(v, "graph long, " + ddl[k]).repartition(3) for k, v in rows_.items()}
    got = {r["graph"]: r["hash"] for r in graphs.semantic_hash(frames["events"], frames["roles"], frames["entities"], frames["predicates"], frames["conditions"], frames["args"], frames["links"], {"days": ("hours", 24)}).collect()}
    says = [repr(meaning(g)) for g in graphs_]
    assert got[len(graphs_)] is None and None not in [got[i] for i in range(len(graphs_))]
    assert all((got[i] == got[j]) == (says[i] == says[j]) for i in range(len(graphs_)) for j in range(i)) and says[0] == says[1] and len(set(says)) > 7


def test_snapshot_is_order_independent(spark):
    log = spark.range(200).selectExpr("id % 3 project_id", "id event_id", "id ts", "id % 7 object_id", "'k' kind")
    a = ledger.snapshot(ledger.replay(log))
    changed = ledger.replay(log.withColumn("kind", F.when((F.col("project_id") == 1) & (F.col("object_id") == 4), "z").otherwise(F.col("kind"))))
    found = ledger.differing_buckets(changed, ledger.snapshot_buckets(ledger.replay(log))).collect()
    import hashlib

    assert [tuple(r) for r in found] == [(1, hashlib.sha256(b"4").hexdigest()[:3], "changed")]
    assert rows(a) == rows(ledger.snapshot(ledger.replay(log.repartition(7).orderBy(F.rand(1)))))


def test_read_cases_and_registry(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"test_id": i}) for i in ("x", "y")))
    assert sources.read_cases(spark, str(tmp_path / "a.jsonl"), spark.createDataFrame([], "test_id string").schema).count() == 2
    (tmp_path / "b.jsonl").write_text('{"test_id": "x"}\n{"test_id": "x"}')
    with pytest.raises(ValueError):
        sources.read_cases(spark, str(tmp_path / "b.jsonl"), spark.createDataFrame([], "test_id string").schema)
    (tmp_path / "r.csv").write_text("id,kind,label\n1,a,x\n1,b,y\n2,a,\n3,a,z\n")
    ok, bad = sources.read_registry(spark, str(tmp_path / "r.csv"))
    assert [r["id"] for r in ok.collect()] == ["3"]
    assert sorted(r["reason"] for r in bad.collect()) == ["missing_field", "two_kinds", "two_kinds"]


def test_export_manifest_and_messages(spark, tmp_path):
    project = spark.createDataFrame([(1,)], "project_id long")
    runs = spark.createDataFrame([(1, 10), (2, 20)], "project_id long, run_id long")
    manifests = spark.createDataFrame([(10, "m"), (20, "n")], "run_id long, body string")
    out = str(tmp_path / "out")
    sources.export_project({"runs": runs, "manifests": manifests}, {"manifests": ("runs", "run_id")}, project, out)
    assert rows(spark.read.parquet(f"{out}/manifests")) == [(10, "m")]
    found = sources.write_manifest(spark, out)
    assert {r["status"] for r in sources.verify_manifest(found, found).collect()} == {"ok"}
    sources.export_messages(spark.createDataFrame([("train", "q", "a")], "split string, question string, answer string"), f"{out}/chat")
    assert spark.read.json(f"{out}/chat").first()["messages"][1]["content"] == "a"


def stream_of(spark, df, path):
    df.repartition(3).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_stream(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_streams_equal_batches(spark, tmp_path):
    turns = spark.range(300).selectExpr("id % 5 conversation", "id % 11 ordinal", "cast(id % 4 as string) content_hash", "id % 3 = 0 complete", "timestamp_seconds(1000 + id) captured_at", "id capture_id")
    got = run_stream(streaming.dedup_turns(stream_of(spark, turns, str(tmp_path / "t"))), "deduped", "append")
    assert got.count() == ledger.dedup_turns(turns).count()
    last = run_stream(streaming.latest_turns(stream_of(spark, turns, str(tmp_path / "t"))), "latest", "complete")
    assert rows(last) == rows(ledger.latest_turns(turns).select("conversation", "ordinal", "complete", "capture_id"))
    log = spark.range(300).selectExpr("id % 4 project_id", "id % 9 object_id", "id event_id", "timestamp_seconds(id) ts", "cast(id % 3 as string) kind", "cast(id % 50 as string) key")
    state = run_stream(streaming.replay(stream_of(spark, log, str(tmp_path / "l"))), "replayed", "complete")
    assert rows(state) == rows(ledger.replay(log).select("project_id", "object_id", "event_id", "kind"))
    appended = run_stream(streaming.append_events(stream_of(spark, log, str(tmp_path / "l"))), "appended", "append")
    assert appended.count() == log.select("project_id", "key").distinct().count()


def test_ledger_sink_is_idempotent(spark, tmp_path):
    log = spark.range(60).selectExpr("id % 4 project_id", "cast(id % 20 as string) key", "timestamp_seconds(10000 + id) ts")
    path, late = str(tmp_path / "ledger"), str(tmp_path / "late")
    write = streaming.into_ledger(path, late, 3600)
    for epoch in (0, 1, 1):
        write(log, epoch)
    assert streaming.committed(spark, path) == [0, 1]
    assert streaming.read_ledger(spark, path).count() == log.select("project_id", "key").distinct().count()


@pytest.mark.parametrize("step", ["late", "new", "marker"])
def test_ledger_sink_survives_a_batch_that_fails_midway(spark, tmp_path, monkeypatch, step):
    """Epoch 1 fails while it writes its late rows, its rows or its marker, and is run again: no row twice, none lost."""
    path, late = str(tmp_path / "ledger"), str(tmp_path / "late")
    batch = lambda a, b: spark.range(a, b).selectExpr("id % 3 project_id", "cast(id as string) key", "timestamp_seconds(if(id % 10 = 0, 0, 100000 + id)) ts")
    write = streaming.into_ledger(path, late, 3600, buckets=4)
    write(batch(0, 50), 0)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if step == "marker":
            m.setattr(streaming, "_file_system", lambda s, p, real=streaming._file_system: broken() if p.endswith("/1") else real(s, p))
        else:
            udf = F.udf(broken, "string")
            bad = batch(30, 90).withColumn("key", F.when((F.col("key") == "80" if step == "late" else F.col("key") == "85"), udf("key")).otherwise(F.col("key")))
        with pytest.raises(Exception, match="lost"):
            write(batch(30, 90) if step == "marker" else bad, 1)
    assert streaming.committed(spark, path) == [0] and streaming.read_ledger(spark, path).count() == 45
    write(batch(30, 90), 1)
    write(batch(30, 90), 1)
    write(batch(80, 95), 2)
    rows_ = [r["key"] for r in streaming.read_ledger(spark, path).collect()]
    assert sorted(map(int, rows_)) == [i for i in range(95) if i % 10]
    assert sorted(int(r["key"]) for r in streaming.read_ledger(spark, path, late).collect()) == sorted([*range(0, 50, 10), *range(30, 90, 10), 80, 90])


def test_stream_reassembly(spark, tmp_path):
    frames = spark.createDataFrame([(1, 0, 2, "a"), (1, 1, 2, "b"), (2, 0, 2, "x"), (3, 5, 2, "bad"), (3, 0, 1, "c")], "message long, seq int, total int, body string")
    messages = streaming.reassemble(stream_of(spark, frames, str(tmp_path / "f")))
    q = messages.writeStream.format("memory").queryName("messages").outputMode("append").start()
    try:  # time-outs keep such a query running for ever, so it is watched rather than drained
        for _ in range(60):
            done = sorted((r["message"], r["body"]) for r in spark.table("messages").where("outcome = 'complete'").collect())
            if len(done) == 2:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert done == [(1, "ab"), (3, "c")]


def test_quotes_of_all_lengths(spark):
    """Every place of many quotes, against str.find, and the last resort of an anchor."""
    import random

    from evidentia.operators import integrity

    draw = random.Random(8)
    texts = [(i, "".join(draw.choice("abé日\n") for _ in range(draw.randrange(0, 400)))) for i in range(6)] + [(7, "aaaa"), (8, None), (9, "")]
    quotes = []
    for i in range(400):
        doc, text = texts[draw.randrange(len(texts))]
        n = draw.choice([1, 2, 3, 5, 8, 17, 60, 300])
        at = draw.randrange(max(1, len(text or "")))
        quotes.append((i, doc, draw.choice([(text or "")[at : at + n], "".join(draw.choice("abé") for _ in range(n))]), draw.choice([None, 5, 50])))
    quotes += [(900, 7, "aa", None), (901, 7, "", None), (902, 7, None, None), (903, 99, "a", None), (904, 8, "a", None)]
    df = spark.createDataFrame(quotes, "id long, doc_id long, quote string, hint int").repartition(3)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    body = dict(texts)
    want = sorted((i, d, p) for i, d, q, _ in quotes if q and body.get(d) for p in range(len(body[d])) if body[d].startswith(q, p))
    assert sorted(map(tuple, integrity.occurrences(df, docs).select("id", "doc_id", "at").collect())) == want
    anchors = spark.createDataFrame([(900, 1, 3), (900, 1, 3), (903, 0, 9)], "id long, start long, end long")
    got = {r["id"]: (r["status"], r["start"]) for r in integrity.bind_quotes(df, docs, anchors).collect()}
    assert got[900] == ("anchored", 1) and got[901] == got[903] == ("missing", None) and len(got) == len(quotes)


def test_a_thousand_quotes_in_a_long_text():
    import time

    from evidentia.operators import integrity

    text = "".join(f"w{i * 7919 % 10007} " for i in range(160_000))[:1_000_000]
    quotes = list(dict.fromkeys(text[i * 997 : i * 997 + 20 + i] for i in range(900)))
    began = time.time()
    which, at = integrity.places(text, quotes)
    assert time.time() - began < 20 and {quotes[w] for w in which.tolist()} == set(quotes)
    assert all(text.startswith(quotes[w], p) for w, p in zip(which.tolist(), at.tolist()))


def test_bootstrap_by_weights_equals_joined_draws(spark, monkeypatch):
    from evidentia.operators import evaluate

    df = spark.range(3000).selectExpr("concat('d', id * 7919 % 13) domain", "concat('f', id % 13 % 3, if(id % 13 = 5, 'x', '')) family", "array('A', 'R', 'N')[id % 7 % 3] arm", "id % 11 < 4 success")
    want = evaluate.cluster_bootstrap(df, evaluate.hash_draws(df, 300), "A", "R").first()
    monkeypatch.setattr(evaluate, "WEIGHTS", 50)
    got = evaluate.bootstrap(df, 300, "A", "R").first()
    assert tuple(got) == pytest.approx(tuple(want)) and got["valid"] and got["invalid"]
    monkeypatch.setattr(evaluate, "CELLS", 3)
    assert tuple(evaluate.bootstrap(df, 300, "A", "R").first()) == pytest.approx(tuple(want))
