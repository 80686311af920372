"""Graphs hashed in their row against the joins: repeated, absent and null ids, cycles, and graphs of many rows."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia import plans
from evidentia.operators import graphs
from evidentia.plans import graphs as queries
from evidentia.plans.registry import Tables

DDL = {"events": "id string, seq long, action string, modality string, negated boolean, condition string, exception string, complement string, revision string, time string", "roles": "id string, role string, entity string", "entities": "id string, name string", "predicates": "id string, subject string, comparator string, value double, unit string, negated boolean", "conditions": "id string, operator string", "args": "id string, arg string", "links": "seq long, kind string, source string, target string"}


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(11)
    rows = {k: [] for k in DDL}
    for g in [*range(400), None]:
        clean = g is not None and g % 4 == 0  # else anything may be null, absent or repeated
        pick = lambda *x: draw.choice(x if clean else [*x, *x, *x, None])
        some = lambda n: range(draw.randrange(1 if clean else 0, n))
        ids = [f"e{i}" for i in range(5)]
        rows["entities"] += [(g, pick("x", "y", "z"), pick("A", "Bé", "")) for _ in range(5)] + [(g, x, "C") for x in "xyz" if clean]
        rows["predicates"] += [(g, f"p{i}" if clean else pick("p1", "p2", "e1"), pick("x", "y", "z"), pick("GE", "LT"), pick(5.0, 2.50, 120.0), pick("days", "hours"), pick(True, False)) for i in range(3)]
        conditions = [(f"c{i}" if clean else pick("c0", "c1", "p1"), pick("all", "any")) for i in some(4)]
        rows["conditions"] += [(g, *c) for c in conditions]
        for i, (c, _) in enumerate(conditions):
            rows["args"] += [(g, c, pick("p0", "p1", "e0", *[f"c{j}" for j in range(i if clean else 3)])) for _ in range(2)]
        rows["events"] += [(g, ids[i] if clean else pick(*ids), pick(1, 2, 3), pick("go", "stop"), "may", pick(True, False), pick("p0", "p1", *(c for c, _ in conditions)), None, None, pick("r"), None) for i in some(5)]
        first = {}  # the order of equal places and ids is open
        rows["events"] = [e for e in rows["events"] if e[0] != g or first.setdefault((e[2], e[1]), e) is e]
        held = [e[1] for e in rows["events"] if e[0] == g]
        rows["roles"] += [(g, pick(*held, *ids), pick("actor", "recipient"), pick("x", "y", "z")) for _ in range(4)]
        rows["links"] += [(g, pick(1, 2), pick("before", "after"), pick(*(held if clean else ids)), pick(*(held if clean else ids))) for _ in some(3) if held]
    return [spark.createDataFrame(v, "graph long, " + DDL[k]).repartition(3) for k, v in rows.items()]


def test_rows_and_joins_say_the_same(spark, monkeypatch, tables):
    units = {"days": ("hours", 24)}
    want = {r["graph"]: r["hash"] for r in graphs._hash_joined(*tables, units).collect()}
    assert len(want) > 300 and 100 < sum(x is not None for x in want.values()) < len(want) - 50
    for few in (10_000, 20, 0):  # all in rows, some, none
        monkeypatch.setattr(graphs, "FEW", few)
        assert {r["graph"]: r["hash"] for r in graphs.semantic_hash(*tables, units).collect()} == want


def test_lines_of_an_order_are_dealt_once(spark):
    """Before, seven tables and every round of conditions were joined; now the lines meet once by order, and nothing is joined."""
    df = plans.QUERIES["g6_semantic_hash"](spark, "/root/testdata/sf0.001")
    df.count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_orders_of_many_lines_are_hashed_by_joins(spark, monkeypatch):
    t = Tables(spark, "/root/testdata/sf0.001")
    want = {r["graph"]: r["hash"] for r in queries.g6(t).collect()}
    assert want == {r["graph"]: r["hash"] for r in graphs._hash_joined(*queries._tables(t("lineitem").selectExpr("l_orderkey graph", "l_linenumber n", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"))).collect()}
    monkeypatch.setattr(graphs, "FEW", 32)  # orders of up to four lines in a row
    assert {r["graph"]: r["hash"] for r in queries.g6(t).collect()} == want and queries.g6(t).select(F.count("hash")).first()[0] == len(want)
