"""Reports over finished runs, as rows: live summaries, claim matrices, evaluation reports, pair scores, costs of discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import stats

#: Fixed values.
PAIR_NAME, OFFICIAL = "pair_f1", "official"
SCORES = ("evidence_recall", "evidence_precision", "complete_evidence_coverage", "retrieved_count", "answer_f1", "exact_match")


def live_summary(runs: DataFrame) -> DataFrame:
    """Per arm, and per arm and hops, in one pass: runs, errors, means of what was scored (four places), tokens.

    ``runs``: arm, hops, error, latency, tokens, and a column for each score, null where it was not scored.  ``hops`` is null
    in rows over a whole arm, whose ``level`` is 1.
    """
    mean = lambda c: F.round(F.avg(c), 4).alias(f"{c}_mean")
    named = runs.withColumn("hops", F.coalesce(F.col("hops").cast("string"), F.lit("None")))
    out = named.groupingSets([[F.col("arm")], [F.col("arm"), F.col("hops")]], "arm", "hops").agg(F.grouping("hops").cast("int").alias("level"), F.count(F.lit(1)).alias("runs"), F.count(F.nullif("error", F.lit(""))).alias("errors"), *(mean(c) for c in SCORES), mean("latency"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens_total"))
    return out.withColumnsRenamed({"complete_evidence_coverage_mean": "complete_coverage_rate"})


def claim_matrix(records: DataFrame, dimensions: tuple[str, ...], flat: str, shared: str) -> DataFrame:
    """Claim audits by arm, whole and along each dimension in one pass, with Wilson bounds of completeness and the gain over the flat arm.

    ``records``: arm, recall, complete, tokens and the dimensions.  A row's ``dimension`` is null over the whole arm.
    """
    parts = F.array(F.struct(F.lit(None).cast("string").alias("dimension"), F.lit(None).cast("string").alias("bucket")), *(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("bucket")) for d in dimensions))
    rows = records.select("arm", "recall", "complete", "tokens", F.inline(parts)).groupBy("arm", "dimension", "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("recall").alias("recall"), F.count_if("complete").alias("complete"), F.sum("tokens").alias("tokens"))
    low, high = stats.wilson(F.col("complete"), F.col("n"))
    base = rows.where(F.col("arm") == flat).select(F.col("dimension").alias("_d"), F.col("bucket").alias("_b"), F.col("recall").alias("_r"))
    joined = rows.join(base, F.col("dimension").eqNullSafe(F.col("_d")) & F.col("bucket").eqNullSafe(F.col("_b")), "left")
    gain = F.when(F.col("arm") == shared, F.round(F.col("recall") - F.col("_r"), 6))
    return joined.select("arm", "dimension", "bucket", "n", F.round("recall", 6).alias("recall"), F.round(F.col("complete") / F.col("n"), 6).alias("complete_rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), stats.safe_div(F.col("tokens"), F.col("complete")).alias("tokens_per_complete"), gain.alias("delta_vs_flat"))


def evaluation_report(runs: DataFrame) -> DataFrame:
    """The report as rows (section, arm, task_id, measure, value): each run's scores and cost, and the means of every arm.

    ``runs``: run_id, task_id, arm, active_score, total_tokens, latency; means skip nulls and are 0 without values.
    """
    measures = ("active_score", "total_tokens", "latency")
    long = lambda kind, *by: F.array(*(F.struct(F.lit(kind).alias("section"), *by, F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures))
    each = runs.select(F.inline(long("score_vs_cost", F.col("arm"), F.col("task_id").cast("string").alias("task_id"))))
    means = runs.groupBy("arm").agg(*(F.coalesce(F.bround(F.avg(m), 6), F.lit(0.0)).alias(m) for m in measures))
    return each.unionByName(means.select(F.inline(long("by_arm", F.col("arm"), F.lit(None).cast("string").alias("task_id")))))


def pair_scores(cases: DataFrame, f1: Column) -> DataFrame:
    """Score rows of pair answers (task_id, origin): token F1, official where the data are."""
    return cases.select("task_id", F.lit(PAIR_NAME).alias("score_name"), f1.alias("score_value"), (F.col("origin") == OFFICIAL).alias("is_official_score"))


def pairs_in(text: Column) -> Column:
    """Unordered pairs (a, b) of a free text, each once: lower case, trimmed, the smaller name first."""
    found = F.regexp_extract_all(text, F.lit(r"\(([^(),]+),([^(),]+)\)"), F.lit(0))
    sides = F.transform(found, lambda p: F.transform(F.split(F.btrim(p, F.lit("()")), ","), lambda x: F.lower(F.trim(x))))
    return F.array_distinct(F.transform(F.coalesce(sides, F.expr("cast(array() as array<array<string>>)")), lambda x: F.array_sort(x)))


def pair_set_f1(cases: DataFrame) -> DataFrame:
    """task_id, precision, recall, f1 of the set of pairs in ``prediction`` against that in ``gold``; both empty is 1."""
    rows = cases.select("task_id", pairs_in(F.col("prediction")).alias("p"), pairs_in(F.col("gold")).alias("g"))
    hit, p, g = F.size(F.array_intersect("p", "g")), F.size("p"), F.size("g")
    none = (p == 0) & (g == 0)
    share = lambda n: F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(hit, n), F.lit(0.0)))
    return rows.select("task_id", F.round(share(p), 6).alias("precision"), F.round(share(g), 6).alias("recall"), F.round(F.when(none, 1.0).otherwise(2 * hit / (p + g)), 6).alias("f1"))


def discovery_cost(searches: DataFrame, calls: DataFrame) -> DataFrame:
    """case_id, input, output, total tokens: words of search goals and prompts, and ids that were accepted or rejected.

    ``searches``: case_id, goal, accepted, rejected; ``calls``: case_id, tokens.
    """
    words = F.size(F.filter(F.split(F.trim(F.coalesce("goal", F.lit(""))), r"\s+"), lambda w: w != ""))
    s = searches.groupBy("case_id").agg(F.sum(words).alias("_goal"), F.sum(F.coalesce(F.size("accepted"), F.lit(0)) + F.coalesce(F.size("rejected"), F.lit(0))).alias("output"))
    rows = s.join(calls.groupBy("case_id").agg(F.sum("tokens").alias("_prompt")), "case_id", "full_outer").fillna(0, ["_goal", "_prompt", "output"])
    given = F.col("_goal") + F.col("_prompt")
    return rows.select("case_id", given.alias("input"), "output", (given + F.col("output")).alias("total"))


def coverage_rows(results: DataFrame) -> DataFrame:
    """task_id, arm, coverage before and after, gain and stop reason of discovery runs (claim, mode, ...)."""
    return results.select(F.col("claim").alias("task_id"), F.col("mode").alias("arm"), "coverage_before", "coverage_after", (F.col("coverage_after") - F.col("coverage_before")).alias("coverage_gain"), F.col("stop").alias("stop_reason"))
