"""Searches start from every row whose id is divisible by 50."""

from __future__ import annotations

import datetime
import random

from graphloom.plans import catalog


def test_every_seed_and_case(spark, tmp_path):
    rng, day = random.Random(3), datetime.datetime(2020, 1, 1)
    orders = [(i, rng.randint(1, 20), day + datetime.timedelta(days=rng.randint(0, 9))) for i in range(500)]
    lines = [(i, rng.randint(1, 40), rng.randint(1, 15), n) for i in range(500) for n in range(2)]
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(500)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    keys = {i: {("v", d): 3} | {("e", f"c{c}"): 2} for i, c, d in orders}
    for i, p, s, _ in lines:
        keys[i] |= {("e", f"s{s}"): 2, ("x", p): 1}
    owner = {i: c for i, c, _ in orders}
    near = {}
    for a in range(0, 500, 50):
        shared = {b: sum(w for k, w in keys[a].items() if k in keys[b]) for b in keys if b != a}
        near[a] = sorted((b for b in shared if shared[b]), key=lambda b: (-shared[b], b))[:20]
    got = catalog.QUERIES["frontier_scoring_eval"](spark, str(tmp_path)).collect()
    assert {(r["case_id"], r["doc_id"]) for r in got} == {(a, b) for a in near for b in near[a] if owner[a] != owner[b]}
    got = catalog.QUERIES["beam_navigation"](spark, str(tmp_path)).collect()
    assert {(r["query_id"], r["doc_id"]) for r in got if r["depth"] == 0} == {(a, a) for a in near}
    for a in near:
        first = [r["doc_id"] for r in got if r["query_id"] == a and r["depth"] == 1]
        assert len(first) == 3 and set(first) <= set(near[a])
        assert sum(r["query_id"] == a for r in got) == 10
