"""Retrieval arms and the runner: cases x arms -> records, with scores, failure categories and fingerprints.

A case row has task_id, question, context, answers (array), gold_evidence (array), answerable; an arm is a function from
cases to (task_id, prediction, evidence array, stop).  Model-backed arms plug in as such functions.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text, vector
from graphloom.operators import evaluation, inverted, navigation, retrieval
from graphloom.operators.lineage import among, cut, lent, written
from graphloom.operators.retrieval import best, window

Arm = Callable[[DataFrame], DataFrame]
_NONE = "cast(array() as array<string>)"


def gold_arm(cases: DataFrame) -> DataFrame:
    """Upper bound: the gold answer and evidence."""
    return cases.select("task_id", F.get("answers", F.lit(0)).alias("prediction"), F.col("gold_evidence").alias("evidence"), F.lit("gold").alias("stop"))


def wrong_arm(cases: DataFrame) -> DataFrame:
    """Lower bound: an answer that is never right."""
    return cases.select("task_id", F.lit("__wrong__").alias("prediction"), F.expr(_NONE).alias("evidence"), F.lit("wrong").alias("stop"))


def pattern_arm(cases: DataFrame) -> DataFrame:
    """What a pattern finds in the whole context."""
    return cases.select("task_id", text.secret_answer(F.col("context")).alias("prediction"), F.expr(_NONE).alias("evidence"), F.lit("answered").alias("stop"))


def chunk_overlap(cases: DataFrame, size: int = 160, k: int = 3, pattern: str = text.UNICODE_WORD) -> DataFrame:
    """task_id, idx, overlap, rank of the word windows of a context that share most terms with the question; windows without overlap stay."""
    parts = cases.select("task_id", text.terms(F.col("question"), pattern).alias("q"), F.inline(text.word_windows(F.col("context"), size)))
    scored = parts.select("task_id", "idx", "text", F.size(F.array_intersect("q", text.terms(F.col("text"), pattern))).cast("long").alias("overlap"))
    return best(scored, ["task_id"], [F.desc("overlap"), "idx"], k)


def keyword_arm(cases: DataFrame) -> DataFrame:
    """Pattern answer over the best windows only."""
    top = chunk_overlap(cases).groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("rank", "idx", "text"))).alias("t"))
    joined = F.array_join(F.transform("t", lambda x: x["text"]), "\n")
    return top.select("task_id", text.secret_answer(joined).alias("prediction"), F.transform("t", lambda x: F.concat(F.lit("chunk_"), x["idx"].cast("string"))).alias("evidence"), F.lit("answered").alias("stop"))


def run(cases: DataFrame, arms: dict[str, Arm]) -> DataFrame:
    """A record per case and arm, with exact match, F1, evidence scores and failure categories; arms never see the gold unless they are bounds."""
    hidden = cases.select("task_id", "question", "context")
    out = None
    for name, arm in arms.items():
        seen = cases if arm in (gold_arm, wrong_arm) else hidden
        one = arm(seen).withColumn("arm", F.lit(name))
        out = one if out is None else out.unionByName(one)
    rows = out.join(cases.select("task_id", "answers", "gold_evidence", "answerable"), "task_id")
    said = F.coalesce("prediction", F.lit(""))
    p, r, f = evaluation.evidence_scores(F.col("evidence"), F.col("gold_evidence"))
    rows = rows.withColumn("exact_match", evaluation.exact_match(said, F.col("answers"))).withColumn("token_f1", evaluation.best_f1(said, F.col("answers"))).withColumn("evidence_precision", p).withColumn("evidence_recall", r).withColumn("evidence_f1", f)
    return rows.withColumn("failures", evaluation.failure_categories(F.col("answerable"), F.col("exact_match"), F.col("gold_evidence"), F.col("evidence"), F.col("evidence_recall"))).withColumn("fingerprint", fingerprint("task_id", "arm", "prediction", "evidence"))


def fingerprint(*columns: str) -> Column:
    """SHA-256 over the canonical JSON of what makes a run."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def locate(entities: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """query_id, entity, score, rank of the best entities (entity, v) by cosine."""
    sized = lambda df, *c: df.select(*c, "v", vector.norm(F.col("v")).alias("size"))
    # entities are named by strings, so no query is kept from an entity of its own id
    asked = sized(queries.withColumn("_q", F.concat(F.lit("query:"), F.col("query_id").cast("string"))), F.col("_q").alias("query_id"))
    found = retrieval.nearest(sized(entities, F.concat(F.lit("entity:"), "entity").alias("vec_id")), asked, k, 9, blank=0.0)
    named = found.select(F.col("query_id").alias("_q"), F.substring("vec_id", len("entity:") + 1, 2**31 - 1).alias("entity"), F.col("raw").alias("score"), "rank")
    return queries.select("query_id", F.concat(F.lit("query:"), F.col("query_id").cast("string")).alias("_q")).join(named, "_q").drop("_q")


def inspect(observations: DataFrame, seeds: DataFrame, queries: DataFrame, k: int = 6) -> DataFrame:
    """query_id, observation, score (.75 of its own similarity, .25 of its entity's) of the best observations of the seeds."""
    rows = among(observations, "entity", seeds.select("entity")).join(seeds.select("query_id", "entity", F.col("score").alias("_s")), "entity").join(queries.select("query_id", F.col("v").alias("q")), "query_id")
    return best(rows.withColumn("score", 0.75 * vector.cosine(F.col("q"), F.col("v")) + 0.25 * F.col("_s")), ["query_id"], [F.desc(F.round("score", 9)), "observation"], k).drop("q", "_s")


def retrieve(entities: DataFrame, observations: DataFrame, transitions: DataFrame, queries: DataFrame, evidence: int = 8) -> DataFrame:
    """query_id, evidence: of the best observations, then of the best paths, in order of first appearance."""
    seeds = cut(locate(entities, queries))
    seen = inspect(observations, seeds, queries).select("query_id", F.lit(0).alias("part"), F.col("rank").alias("at"), "evidence")
    paths = navigation.expand_paths(transitions, seeds, queries).select("query_id", F.lit(1).alias("part"), F.col("rank").alias("at"), "evidence")
    ordered = F.array_sort(F.collect_list(F.struct("part", "at", "evidence")))
    return seen.unionByName(paths).groupBy("query_id").agg(F.slice(F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["evidence"]))), 1, evidence).alias("evidence"))


def rescored(pairs: DataFrame, score: Callable[[list[str], list[str]], list[float]], part: list[str], item: str, k: int) -> DataFrame:
    """Best pairs (query_text, passage) by a pair scorer, batched by Arrow: the seam of a cross-encoder."""

    @F.pandas_udf("double")
    def run_model(q: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(score(q.tolist(), p.tolist()), dtype=float)

    return best(pairs.withColumn("score", run_model("query_text", "passage")), part, [F.desc("score"), item], k)


def text_arm(chunks: DataFrame, hits: DataFrame, rounds: int = 2, radius: int = 1, wanted: int = 3) -> DataFrame:
    """document_id, consulted, completeness: seed chunks and, round by round, their neighbours."""
    got = chunks.join(hits.select("document_id", "index"), ["document_id", "index"], "left_semi")
    for _ in range(rounds - 1):
        got = window(chunks, got.select("document_id", "index"), "document_id", "index", radius, radius)
    return got.groupBy("document_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("consulted"), F.least(F.lit(1.0), F.count_distinct("chunk_id") / F.lit(wanted)).alias("completeness"))


def frontier_scores(docs: DataFrame, cases: DataFrame, weights: dict[str, float], cap: int = 20, vectors: DataFrame | None = None) -> DataFrame:
    """case_id, doc_id, owner_id, score, rank: next documents of each case's current one, by weights that are normalised.

    ``cases`` has case_id, from_id (a document) and v (the query's vector).  Where ``vectors`` (vec, v) are given, documents
    and cases have the key vec instead of v, which travels in the vector's place.
    """
    total = sum(weights.values())
    key = "v" if vectors is None else "vec"
    docs = docs.select("doc_id", "owner_id", "entities", "events", "evidence", key)
    current = written(inverted.only(docs, cases.select(F.col("from_id").alias("doc_id")), "doc_id").join(cases.select(F.col("from_id").alias("doc_id")).distinct(), "doc_id", "left_semi"), "frontier-current")
    edges = written(navigation.frontier(docs, current, cap).select("from_id", "doc_id"), "frontier-edges")
    own = current.select(F.col("doc_id").alias("from_id"), F.col("owner_id").alias("o0"), F.col("entities").alias("e0"), F.col("events").alias("n0"), F.col("evidence").alias("x0"), F.col(key).alias("_k0"))
    rows = inverted.only(docs, edges, "doc_id").withColumnRenamed(key, "_k1").join(edges, "doc_id")
    rows = rows.join(own.join(cases.select("case_id", "from_id", F.col(key).alias("_kq")), "from_id"), "from_id").where("owner_id <> o0")
    names = {"_kq": "q", "_k0": "v0", "_k1": "v"}
    rows = rows.withColumnsRenamed(names) if vectors is None else lent(rows, vectors, **names)
    size = lambda f, a, b: F.size(f(a, b))
    structure = navigation.structural_confidence(*(size(F.array_intersect, a, b) for a, b in (("e0", "entities"), ("n0", "events"), ("x0", "evidence"))))
    fresh = navigation.novelty(*(size(F.array_except, a, b) for a, b in (("entities", "e0"), ("events", "n0"), ("evidence", "x0"))))
    parts = {
        "query": vector.unit_cosine(vector.cosine(F.col("q"), F.col("v"))), "structure": structure, "novelty": fresh, "evidence": F.when(F.size("evidence") > 0, 1.0).otherwise(0.4),
        "profile": vector.unit_cosine(vector.cosine(vector.contribution_profile(F.col("q"), F.col("v0")), vector.contribution_profile(F.col("q"), F.col("v")))),
    }
    score = sum((F.lit(w) * parts[k] for k, w in weights.items()), F.lit(0.0)) / F.lit(total) if total > 0 else F.lit(0.0)
    return best(rows.select("case_id", "doc_id", "owner_id", score.alias("score")), ["case_id"], [F.desc(F.round("score", 9)), "doc_id"], cap)
