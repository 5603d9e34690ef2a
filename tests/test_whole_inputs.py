"""Queries without SQL cover whole tables, against brute force on the smallest tables."""

import json
import os

import pytest

from lattix.functions import kernels
from lattix.operators import evalkit as E
from lattix.plans import catalog
from lattix.plans.bridge import graph, star
from lattix.plans.build_queries import sequences

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_matchings_of_all_orders_and_methods(spark):
    g, p = sequences(spark, SF, 0), sequences(spark, SF, 1)
    o = E.oracle(*graph(spark, SF))
    same = E.equivalents_of(E.equivalence_classes(o["operations"], o["inputs"]), o["methods"]).collect()
    pairs = {(r["a"], r["b"]) for r in same}
    listed = [{}, {}]
    for by, df in zip(listed, (g, p), strict=True):
        for r in df.orderBy("item", "pos").collect():
            by.setdefault(r["item"], []).append(r["method_id"])
    want = set()
    for item in listed[0].keys() & listed[1].keys():
        a, b = listed[0][item], listed[1][item]
        want |= {(item, i, j) for i, j in kernels.match_steps(a, b, {(x, y) for x in a for y in b if (x, y) in pairs}).items()}
    assert {tuple(r) for r in catalog.QUERIES["g6_matching"](spark, SF).collect()} == want
    hits = {}
    for item, _, _ in want:
        hits[item] = hits.get(item, 0) + 1
    got = {r["item"]: r["recall"] for r in catalog.QUERIES["e3_selection_matched"](spark, SF).collect()}
    assert got == pytest.approx({i: hits.get(i, 0) / len(s) for i, s in listed[0].items()})


def test_rescoring_takes_all_orders(spark):
    n = star(spark, SF, "lineitem").select("l_orderkey").distinct().count()
    assert [r["n"] for r in catalog.QUERIES["e11_rescore"](spark, SF).collect()] == [n]


def test_flow_charts_and_answers_are_whole(spark):
    users = {}
    for r in star(spark, SF, "events").orderBy("ts", "event_id").collect():
        users.setdefault(str(r["user_id"]), []).append(r["event_type"])
    assert max(map(len, users.values())) > 6
    of = {"click": "m:c", "view": "m:v", "purchase": "m:p", "signup": "m:v"}
    gold, projected = set(), set()
    for item, kinds in users.items():
        chart = "flowchart TB\n" + "".join(f"v{n}([{k}])\n" + (f"v{n - 1} --> v{n}\n" if n > 1 else "") for n, k in enumerate(kinds, 1))
        order = [s for s in kernels.smallest_order(kernels.break_cycles(kernels.process_edges(chart))) if s.lower() not in {x.lower() for x in E.BOOKKEEPING}]
        gold |= {(item, k, s) for k, s in enumerate(order)}
        projected |= {(item, k, m) for k, m in enumerate(dict.fromkeys(of[s] for s in order if s in of))}
    assert {tuple(r) for r in catalog.QUERIES["e7_gold_sequence"](spark, SF).collect()} == gold
    assert {tuple(r) for r in catalog.QUERIES["e8_projection"](spark, SF).collect()} == projected
    said = star(spark, SF, "conversations").collect()
    names = lambda t: "" if t is None else "|".join(kernels.parse_answer(f"{t} I would use {json.dumps(t.split(' '))} [and more") or [])
    want = sorted((r["conv_id"], r["turn"], names(r["text"])) for r in said)
    assert sorted((r["conv_id"], r["turn"], r["names"] or "") for r in catalog.QUERIES["x_parse_answer"](spark, SF).collect()) == want
