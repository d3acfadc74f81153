"""Scores of answers, evidence and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text, vector


def exact_match(prediction: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: text.normalized_answer(g) == text.normalized_answer(prediction)).cast("double")


def token_f1(prediction: Column, gold: Column, both_empty: float = 1.0) -> Column:
    """Multiset F1 of normalised tokens."""
    split = lambda x: F.filter(F.split(text.normalized_answer(x), " "), lambda t: t != "")
    p, g = split(prediction), split(gold)
    count = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    common = F.aggregate(F.array_intersect(p, g), F.lit(0), lambda s, t: s + F.least(count(p, t), count(g, t)))
    score = 2.0 * common / (F.size(p) + F.size(g))
    return F.when((F.size(p) == 0) & (F.size(g) == 0), both_empty).when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(score)


def best_f1(prediction: Column, golds: Column, both_empty: float = 1.0) -> Column:
    return F.array_max(F.transform(golds, lambda g: token_f1(prediction, g, both_empty)))


def evidence_scores(found: Column, gold: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1: all 1 if both are empty, all 0 if one is."""
    common = F.size(F.array_intersect(found, gold)).cast("double")
    n, m = F.size(F.array_distinct(found)), F.size(F.array_distinct(gold))
    guard = lambda x: F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(x)
    return guard(common / n), guard(common / m), guard(F.when(common == 0, 0.0).otherwise(2 * common / (n + m)))


def completeness(found: Column, gold: Column) -> tuple[Column, Column, Column]:
    """Recall (null without gold), precision, and whether all gold was found."""
    common = F.size(F.array_intersect(found, gold))
    recall = F.when(F.size(gold) == 0, None).otherwise(common / F.size(F.array_distinct(gold)))
    precision = F.when(F.size(found) == 0, 0.0).otherwise(common / F.size(F.array_distinct(found)))
    return recall, precision, F.coalesce(recall == 1.0, F.lit(False))


def ranking_scores(ranked: DataFrame, relevant: DataFrame, key: str, item: str, k: int) -> DataFrame:
    """key, recall, mrr, ndcg of each ranked list (key, item, rank) against (key, item); nothing relevant gives recall and nDCG 1."""
    wanted = relevant.select(key, item).distinct()
    keys = ranked.select(key).unionByName(wanted.select(key)).distinct()
    number = wanted.groupBy(key).agg(F.count(F.lit(1)).alias("_wanted"))
    hits = ranked.where(F.col("rank") <= k).join(wanted, [key, item]).groupBy(key).agg(F.min("rank").alias("_first"), F.count(F.lit(1)).alias("_found"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("_gain"))
    rows = keys.join(number, key, "left").join(hits, key, "left").fillna(0, ["_wanted", "_found", "_gain"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("_wanted").cast("int")))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    empty = F.col("_wanted") == 0
    return rows.select(
        key, F.when(empty, 1.0).otherwise(F.least(F.lit(1.0), F.col("_found") / F.col("_wanted"))).alias("recall"),
        F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("mrr"), F.when(empty, 1.0).otherwise(F.col("_gain") / ideal).alias("ndcg"),
    )


def cluster_separation(rows: DataFrame) -> DataFrame:
    """Mean cosine of pairs with one label, with different labels, and the margin.

    All pairs' cosines sum up to half of |sum of unit vectors|^2 less their own squares: no pair is made.
    """
    unit = rows.select("label", vector.normalized(F.col("v")).alias("u"))
    per = unit.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(vector.dot(F.col("u"), F.col("u"))).alias("own"))
    parts = unit.select("label", F.posexplode("u").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"))
    squares = parts.groupBy("label").agg(F.sum(F.col("x") * F.col("x")).alias("square"))
    whole = parts.groupBy("i").agg(F.sum("x").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("all_square"))
    n = F.col("n")
    sums = per.join(squares, "label").agg(F.sum(n).alias("rows"), F.sum("own").alias("own"), F.sum("square").alias("square"), F.sum(n * (n - 1) / 2).alias("same_pairs"))
    means = sums.crossJoin(whole)  # one row each
    every = F.col("rows") * (F.col("rows") - 1) / 2
    means = means.select(F.try_divide(F.col("square") - F.col("own"), 2 * F.col("same_pairs")).alias("s"), F.try_divide(F.col("all_square") - F.col("square"), 2 * (every - F.col("same_pairs"))).alias("d"))
    return means.select(F.round(F.coalesce("s", F.lit(0.0)), 6).alias("same_mean"), F.round(F.coalesce("d", F.lit(0.0)), 6).alias("different_mean"), F.round(F.coalesce("s", F.lit(0.0)) - F.coalesce("d", F.lit(0.0)), 6).alias("margin"))


def failure_categories(answerable: Column, exact: Column, gold: Column, found: Column, recall: Column) -> Column:
    """Names of what went wrong, in a fixed order."""
    return F.array_compact(F.array(F.when(answerable & (exact < 1.0), "wrong_answer"), F.when((F.size(gold) > 0) & (F.size(found) == 0), "missing_evidence"), F.when((F.size(gold) > 0) & (recall < 1.0), "partial_evidence_recall")))


def invalid_reasons(total: Column, parts: Column, provider: Column, response: Column, leaked: Column, fallback: Column) -> Column:
    """Why a run record cannot count; empty if it can."""
    return F.array_compact(F.array(F.when(~total.eqNullSafe(parts), "token_sum_mismatch"), F.when(provider.isNotNull() & response.isNull(), "missing_response_id"), F.when(leaked, "labelled_context_leakage"), F.when(fallback, "fallback_used")))
