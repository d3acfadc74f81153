from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom.operators import arms, ingest, metrics


def test_runner_bounds(spark):
    schema = "task_id string, question string, context string, answers array<string>, gold_evidence array<string>, answerable boolean"
    cases = spark.createDataFrame([("a", "What is the secret code?", "hay the secret code is x-1. hay", ["x-1"], ["chunk_0"], True), ("b", "q", "hay", ["z"], [], True)], schema)
    got = {(r["task_id"], r["arm"]): r for r in arms.run(cases, {"gold": arms.gold_arm, "wrong": arms.wrong_arm, "pattern": arms.pattern_arm, "keyword": arms.keyword_arm}).collect()}
    assert got["a", "gold"]["exact_match"] == 1.0 and got["a", "wrong"]["failures"] == ["wrong_answer", "missing_evidence", "partial_evidence_recall"]
    assert got["a", "pattern"]["prediction"] == "x-1" and got["a", "keyword"]["evidence_recall"] == 1.0
    assert got["b", "pattern"]["exact_match"] == 0.0 and len({r["fingerprint"] for r in got.values()}) == len(got)


def test_locate_inspect_retrieve(spark):
    e = spark.createDataFrame([("A", [1.0, 0.0]), ("B", [0.0, 1.0])], "entity string, v array<double>")
    o = spark.createDataFrame([("A", "o1", ["x1"], [1.0, 0.0]), ("B", "o2", ["x2"], [0.0, 1.0])], "entity string, observation string, evidence array<string>, v array<double>")
    t = spark.createDataFrame([("A", "B", ["r"], ["e"], ["x3"], 0.5, [1.0, 0.0])], "source string, target string, relations array<string>, events array<string>, evidence array<string>, confidence double, v array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.1])], "query_id int, v array<double>")
    assert [r["entity"] for r in arms.locate(e, q).orderBy("rank").collect()] == ["A", "B"]
    assert arms.retrieve(e, o, t, q).first()["evidence"] == ["x1", "x2", "x3"]


def test_pair_scorer_seam(spark):
    p = spark.createDataFrame([(1, "a", "cat", "cat cat"), (1, "b", "cat", "dog")], "q int, d string, query_text string, passage string")
    best = arms.rescored(p, lambda q, d: [float(y.count(x)) for x, y in zip(q, d, strict=True)], ["q"], "d", 1).first()
    assert (best["d"], best["score"]) == ("a", 2.0)


def test_ingest_and_resume(spark):
    docs = spark.createDataFrame([(1, "Ann saw the dog.\n\nAnn held it."), (2, None)], "doc_id long, text string")
    made = ingest.ingest(docs, 5)
    assert made["chunks"].count() == 2 and made["events"].count() == 2
    state = made["state"].orderBy("index").collect()
    assert state[0]["added"] and state[1]["updated"] and set(state[1]["updated"]) <= set(state[0]["known"])
    ledger = made["chunks"].select("document_id", "index", "content_hash", F.lit("DONE").alias("status"))
    assert ingest.ingest(docs, 5, ledger, "resume")["chunks"].count() == 0


def test_pending_and_nested(spark):
    c = spark.createDataFrame([("c1", "a", "p", "b", "e"), ("c2", "a", "p", "b", "e")], "candidate_id string, source string, predicate string, target string, evidence string")
    done = ingest.encode_pending(c, c.where("candidate_id = 'c1'").select("candidate_id"), 8).collect()
    assert [r["candidate_id"] for r in done] == ["c2"] and sum(x * x for x in done[0]["vector"]) == pytest.approx(1.0)
    text = '{"id": "x", "a": [{"id": 2}, {"b": {"id": "y\\"z"}}]}'
    assert spark.range(1).select(ingest.nested_values(F.lit(text), "id").alias("v")).first()["v"] == ["x", "2", 'y\\"z']


def test_revisions_and_fidelity(spark):
    runs = spark.createDataFrame([("r", 0.0), ("s", 0.5)], "k string, score double")
    rev = spark.createDataFrame([("r", 1, 0.3, False), ("r", 2, 1.0, False), ("r", 3, 0.1, True)], "k string, ordinal int, revised double, model_rerun boolean")
    assert {r["k"]: r["active_score"] for r in metrics.latest_revision(runs, rev, "k").collect()} == {"r": 1.0, "s": 0.5}
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, f string")
    b = spark.createDataFrame([(2, None), (3, "z")], "i int, f string")
    r = metrics.projection_fidelity(a, b, "i", ["f"]).first()
    assert (r["missing"], r["extra"], r["f_accuracy"]) == (1, 1, 1.0)
    p = metrics.paired(a.select(F.col("i").alias("k"), F.lit(1.0).alias("score")), a.select(F.col("i").alias("k"), F.when(F.col("i") == 1, 0.0).alias("score")), "k").first()
    assert (p["shared"], p["wins"], p["losses"], p["ties"]) == (2, 1, 0, 1)
