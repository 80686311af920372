"""Greedy choices that never read a whole key in one task, against plain loops."""

import random

import pytest

from evidentia.operators import admission, fold, joins, rank

RNG = random.Random(7)


def key(row):
    return tuple((x is not None, x) for x in row)


def skip(rows, most, limit):
    """rows (key, rank, id, size) of one key each, in order."""
    out, state = [], {}
    for q, r, i, size in sorted(rows, key=lambda x: key((x[0], x[1], x[2], x[3]))):
        used, n = state.get(q, (0, 0))
        if n >= limit:
            reason = "limit"
        elif size is None:
            reason = "admitted"
        elif used + size > most:
            reason = "budget"
        else:
            reason, state[q] = "admitted", (used + size, n + 1)
        out.append((q, i, r, reason))
    return sorted(out, key=key)


@pytest.mark.parametrize("most,limit,sizes", [(300, 8, range(0, 60)), (5000, 1000, range(1, 9)), (90, 3, [0]), (0, 5, [0, 1, None]), (400, 64, [None, 50, 100, 399, 401]), (10, 0, [1])])
def test_skip_ahead_equals_a_loop(spark, most, limit, sizes):
    rows = [(RNG.choice([1, 1, 1, 2, None]), RNG.randrange(400), RNG.randrange(50), RNG.choice(list(sizes))) for _ in range(1500)]
    df = spark.createDataFrame(rows, "query_id long, rank int, id long, size long").repartition(5)
    assert sorted(map(key, rank.greedy_budget(df, most, limit).collect())) == list(map(key, skip(rows, most, limit)))


def test_the_fold_sees_few_rows_of_a_key(spark, monkeypatch):
    seen = []
    real = fold.fold
    monkeypatch.setattr(fold, "fold", lambda df, *a: seen.append(df.count()) or real(df, *a))
    df = spark.range(20_000).selectExpr("1L query_id", "id", "cast(id as int) rank", "id % 3 * 500 + 700 size")
    got = {r["reason"]: r["count"] for r in rank.greedy_budget(df, 20_000, 64).groupBy("reason").count().collect()}
    assert seen == [sum(20_000 // s for s in (700, 1200, 1700))] and sum(got.values()) == 20_000


def match(rows):
    taken, out = set(), []
    for c, left, right, turn in sorted(set(rows), key=lambda x: (key((x[0],)), x[3] is None, x[3] or 0, x[1] or 0, x[2] or 0)):
        if left is not None and right is not None and not {(c, 0, left), (c, 1, right)} & taken:
            taken |= {(c, 0, left), (c, 1, right)}
            out.append((c, left, right, turn))
    return sorted(out, key=key)


@pytest.mark.parametrize("shape", ["random", "chain", "star", "ties"])
def test_first_free_equals_a_loop(spark, shape):
    n = 600
    rows = {
        "random": [(RNG.choice([1, 1, 2, None]), RNG.randrange(90), RNG.randrange(90), RNG.choice([None, RNG.randrange(50)])) for _ in range(n)],
        "chain": [(1, i // 2, (i + 1) // 2, i) for i in range(n)] + [(2, 1, 1, 1)],
        "star": [(1, 0, i, n - i) for i in range(n)] + [(1, i, 0, i) for i in range(1, 50)],
        "ties": [(1, i % 9, i % 7, 0) for i in range(n)] + [(3, None, 1, 0), (3, 1, None, 0)],
    }[shape]
    df = spark.createDataFrame(rows, "case_id long, left long, right long, turn long").repartition(4)
    want = match(rows)
    assert sorted(map(key, joins.greedy_match(df).collect())) == list(map(key, want))
    assert sorted(map(key, joins.greedy_match(df, block=100, rate=0.3).collect())) == list(map(key, want))


CANDIDATE = "request_id long, id string, text string, section string, score double, pool string, authority string, provenance string, binding boolean"
REQUEST = "request_id long, budget_tokens long, profile string, project string, workstream string"


def test_rendered_admission_equals_a_loop(spark):
    pools, sections = ["evidence", "coverage_limit", "authoritative_state", None], [*admission.HEADERS, "unknown", None]
    requests = [(0, 0, "standard", "p", "w"), (1, 99_000, "standard", "pröj", None), (2, 99_000, "research", "", ""), (3, 1, "standard", "p", "w"), (4, None, None, "p", "w")]
    cands = []
    for i in range(900):
        cands.append((RNG.randrange(6), f"c{i}é", RNG.choice(["x", "é", " "]) * RNG.randrange(0, 1500) if i % 50 else None, RNG.choice(sections) if i % 3 else "decisions", RNG.choice([None, RNG.randrange(9) / 9]), RNG.choice(pools) if i % 4 == 0 else "x", "user_supplied_document" if i % 7 == 0 else "user", RNG.choice([None, "page 3"]), i % 60 == 0))
    want = []
    for r, budget, profile, project, work in requests:
        mine = [c for c in cands if c[0] == r]
        tokens = 500 if not budget else min(budget, 9000 if profile == "research" else 1200)
        documents = any(c[5] in ("evidence", "coverage_limit") or c[6] == "user_supplied_document" for c in mine)
        used = 650 + len((project or "").encode()) + len((work or "").encode()) + 400 * documents
        order = list(admission.HEADERS)
        cost = lambda c: len(c[2] or "") + len(c[1]) + len(admission.HEADERS.get(c[3], "")) + 14 + (len(c[7] or "not supplied") + 18 if c[5] == "evidence" or c[6] == "user_supplied_document" else 0)
        forced = lambda c: c[8] or c[5] == "coverage_limit" or c[3] in ("objective", "constraints", "rejected")
        for c in sorted(mine, key=lambda c: (not forced(c), order.index(c[3]) if c[3] in order else len(order), c[4] is None, -(c[4] or 0), c[1].encode())):
            fits = used + cost(c) <= 4 * tokens
            used += cost(c) if forced(c) or fits else 0
            want.append((r, c[1], "mandatory" if forced(c) else "admitted" if fits else "budget", cost(c)))
    got = admission.admit_rendered(spark.createDataFrame(cands, CANDIDATE).repartition(3), spark.createDataFrame(requests, REQUEST))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    rooms = {r["request_id"]: r["tokens"] for r in admission.request_rooms(spark.createDataFrame(requests, REQUEST), spark.createDataFrame(cands, CANDIDATE)).collect()}
    assert rooms == {0: 500, 1: 1200, 2: 9000, 3: 1, 4: 500}
