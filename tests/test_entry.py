from __future__ import annotations

import __spark_entry__ as entry


def test_registry():
    q, s = entry.queries(), entry.oracle_sql()
    assert "evidence_topk" in q and set(s) <= set(q)


def test_flagship(spark):
    df = entry.queries()["evidence_topk"](spark, "/root/testdata/sf0.001")
    assert df.columns == ["query_id", "recall", "mrr", "ndcg"] and df.count() > 0
