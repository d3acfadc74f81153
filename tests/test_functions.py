from __future__ import annotations

import hashlib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import stats, text, vector
from graphloom.operators import chunking, evaluation


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))
    return df.select(column.alias("x")).first()["x"]


def test_token_counts(spark):
    assert [one(spark, text.approx_tokens(F.col("t")), t=t) for t in ("", "ab", "abcdef")] == [0, 1, 2]
    assert one(spark, text.estimated_tokens(F.col("t")), t="abcde") == 2
    assert text.chunk_budget() == 6144 and text.chunk_budget(100) == 512


def test_terms_and_normalisers(spark):
    assert one(spark, text.terms(F.col("t")), t="The cat, the CATALOG is é été") == ["the", "cat", "catalog", "été"]
    assert one(spark, text.normalized_answer(F.col("t")), t="The  Cat's, a hat!") == "cats hat"
    assert one(spark, text.normalized_user(F.col("t")), t="user 0042 x") == "0042"
    assert one(spark, text.normalized_label(F.col("t")), t=" Not Spam ") == "ham"
    assert str(one(spark, text.parsed_date(F.col("t")), t="Mar 05, 2023"))[:10] == "2023-03-05"
    assert one(spark, text.parsed_date(F.col("t")), t="soon") is None
    assert one(spark, text.field(F.col("t"), "User"), t="Date: x || User: 7 || Label: ham") == "7"
    assert one(spark, text.fact_terms(F.col("t")), t="The tower of Paris, tower 12.") == ["term:tower", "term:paris", "term:12"]


def test_occurrences_and_windows(spark):
    assert one(spark, text.occurrences(F.col("t"), F.lit("a.b")), t="xA.bya.b") == [1, 5]
    assert one(spark, text.occurrences(F.col("t"), F.lit("zz")), t="abc") == []
    assert [(r["idx"], r["text"]) for r in one(spark, text.word_windows(F.col("t"), 2), t="a b c")] == [(0, "a b"), (1, "c")]
    assert [(r["idx"], r["text"]) for r in one(spark, text.word_windows(F.col("t"), 2), t="")] == [(0, "")]


def test_predictions(spark):
    assert one(spark, text.predicted_values(F.lit("A.NUMERIC"), F.col("t")), t="x -3 or 2.5") == ["-3", "2.5"]
    assert one(spark, text.predicted_values(F.lit("OTHER"), F.col("t")), t="Answer: 'Yes'") == ["yes"]
    vocabulary = F.array(F.lit("ham"), F.lit("spam"))
    assert one(spark, text.predicted_label(vocabulary, F.col("t")), t="It is spam.") == ["spam"]
    assert one(spark, text.predicted_label(vocabulary, F.col("t")), t="ham or spam") == []
    assert one(spark, text.gold_values(F.col("t")), t="['a', 'b']") == ["a", "b"]


def test_vectors(spark):
    assert one(spark, vector.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(math.sqrt(0.5))
    assert one(spark, vector.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) == 0.0
    assert one(spark, vector.normalized(F.col("a")), a=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
    pooled = one(spark, vector.weighted_pool((F.col("a"), 0.5), (F.col("b"), 0.5)), a=[1.0, 0.0], b=[0.0, 1.0])
    assert pooled == pytest.approx([math.sqrt(0.5)] * 2)
    top = one(spark, vector.top_components(F.col("a"), F.col("b"), 2), a=[1.0, -3.0, 2.0], b=[1.0, 1.0, 1.0])
    assert [r["dimension"] for r in top] == [1, 2]


def test_hashing_vector(spark):
    want = [0.0] * 16
    for t in "to be or not to be".split():
        h = hashlib.sha256(t.encode()).digest()
        want[int.from_bytes(h[:4], "big") % 16] += 1.0 if h[4] % 2 == 0 else -1.0
    size = math.sqrt(sum(x * x for x in want))
    assert one(spark, vector.dense_hashed(F.col("t"), 16), t="To be or not to be") == pytest.approx([x / size for x in want])
    rows = vector.hashed_tokens(spark.createDataFrame([(1, "To be or not to be")], "id int, t string"), "id", F.col("t"), 16).collect()
    assert {r["dim"]: r["value"] for r in rows} == pytest.approx({i: x / size for i, x in enumerate(want) if x})


def test_intervals(spark):
    low, high = stats.wilson(F.lit(8), F.lit(10))
    assert one(spark, low) == pytest.approx(0.4901625) and one(spark, high) == pytest.approx(0.9433178)
    assert one(spark, stats.safe_div(F.lit(1.0), F.lit(0.0))) is None
    rows = spark.createDataFrame([("a", float(i % 2)) for i in range(100)], "k string, v double")
    r = stats.bootstrap_ci(rows, "k", "v").first()
    assert r["mean"] == 0.5 and 0.35 < r["low"] < 0.5 < r["high"] < 0.65


def test_scores(spark):
    assert one(spark, evaluation.token_f1(F.lit("the red cat cat"), F.lit("cat red dog"))) == pytest.approx(2 * 2 / 6)
    assert one(spark, evaluation.token_f1(F.lit(""), F.lit("the"))) == 1.0
    assert one(spark, evaluation.exact_match(F.lit("The Cat!"), F.array(F.lit("dog"), F.lit("cat")))) == 1.0
    p, r, f = evaluation.evidence_scores(F.col("a"), F.col("b"))
    assert [one(spark, x, a=["x", "y"], b=["y"]) for x in (p, r, f)] == pytest.approx([0.5, 1.0, 2 / 3])
    nothing = F.expr("cast(array() as array<string>)")
    assert [one(spark, x) for x in evaluation.evidence_scores(nothing, nothing)] == [1.0, 1.0, 1.0]


def test_ranking(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "q int, d string, rank int")
    relevant = spark.createDataFrame([(1, "b"), (1, "z")], "q int, d string")
    rows = {r["q"]: r for r in evaluation.ranking_scores(ranked, relevant, "q", "d", 2).collect()}
    assert rows[1]["recall"] == 0.5 and rows[1]["mrr"] == 0.5
    assert rows[1]["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert rows[2]["recall"] == 1.0 and rows[2]["mrr"] == 0.0 and rows[2]["ndcg"] == 1.0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n!", max_size=120), st.integers(1, 6))
def test_chunks_hold_their_text(t, budget):
    chunks = chunking.chunks(t, budget)
    assert all(a[2] <= b[1] for a, b in zip(chunks, chunks[1:], strict=False))
    assert all(t[s] == body[0] and t[e - 1] == body[-1] for body, s, e in chunks)
    kept = sum(c not in " \n.!" for c in t)
    assert sum(c not in " \n.!" for body, _, _ in chunks for c in body) == kept


def test_chunking_budget():
    t = "aaa aaa aaa.\n\nbbb bbb.\n\n" + "c" * 100
    got = chunking.chunks(t, 8)
    assert got[0][0] == "aaa aaa aaa.\n\nbbb bbb." and got[0][1:] == (0, 22)
    assert all(chunking.tokens(x[0]) <= 8 for x in got[1:])
