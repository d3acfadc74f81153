"""Run metrics: views over runs, calls, forensics and audits; group summaries, matrices, paired comparisons, revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import stats


def research_runs(runs: DataFrame) -> DataFrame:
    """Valid runs on the research path, without leaks or fallbacks."""
    return comparable_runs(runs).where(F.col("execution_path") == "research")


def comparable_runs(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("valid") & ~F.col("leaked") & F.col("tokens_match") & ~F.col("fallback"))


def count_when(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def arm_summary(runs: DataFrame) -> DataFrame:
    return research_runs(runs).groupBy("experiment", "arm").agg(
        F.count(F.lit(1)).alias("runs_total"), F.avg("score").alias("mean_score"), F.sum("tokens").alias("total_tokens"), F.avg("tokens").alias("mean_tokens"),
        stats.continuous("tokens", 0.5).alias("p50_tokens"), F.avg("latency").alias("mean_latency"), stats.continuous("latency", 0.95).alias("p95_latency"),
        F.try_divide(F.sum("tokens").cast("double"), F.nullif(F.sum("score"), F.lit(0.0))).alias("tokens_per_correct"),
    )


def role_summary(runs: DataFrame, calls: DataFrame) -> DataFrame:
    return research_runs(runs).join(calls, "run_id").groupBy("experiment", "arm", "role", "model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
    )


def forensic_summary(runs: DataFrame, forensics: DataFrame, by: list[str]) -> DataFrame:
    """Counts of graph use and its outcomes by any of experiment, arm, semantics and mode."""
    outcome = F.col("outcome")
    return runs.join(forensics, "run_id").groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs_total"), F.sum("score").alias("score_sum"), count_when(F.col("graph_query")).alias("graph_query_runs"), count_when(F.col("local_list")).alias("local_projection_runs"),
        count_when(F.col("contributed")).alias("graph_contributed_runs"), count_when(outcome == "useful").alias("useful_runs"), count_when(outcome == "insufficient").alias("insufficient_runs"), F.avg("fidelity").alias("mean_fidelity"),
    )


def audit_summary(runs: DataFrame, audits: DataFrame) -> DataFrame:
    complete = F.col("complete")
    return comparable_runs(runs).join(audits, "run_id").groupBy("experiment", "mode").agg(
        F.count(F.lit(1)).alias("runs_total"), F.avg("recall").alias("mean_recall"), F.avg(F.when(complete, 1.0).otherwise(0.0)).alias("complete_rate"),
        count_when(complete).alias("complete_runs"), F.sum("edges").alias("edges"), F.avg(1.0 - F.col("recall")).alias("unsupported_rate"), F.sum("tokens").alias("total_tokens"),
    )


def group_summary(runs: DataFrame, by: list[str], categories: str | None = None) -> DataFrame:
    """Means, median, nearest-rank p95, totals, tokens per correct answer; and counts by failure category."""
    correct = count_when(F.col("score") >= 1.0)
    out = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs_total"), F.coalesce(F.bround(F.avg("score"), 6), F.lit(0.0)).alias("score_mean"), F.bround(F.avg("latency"), 6).alias("latency_mean"),
        F.bround(F.median("latency"), 6).alias("latency_p50"), stats.nearest_rank("latency", 0.95).cast("double").alias("latency_p95"), F.sum("tokens").alias("tokens_total"),
        F.when(correct > 0, F.sum("tokens") / correct).alias("tokens_per_correct"),
    )
    if categories:
        counts = runs.select(*by, F.explode(categories).alias("_c")).groupBy(*by, "_c").count().groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_c", "count")))).alias("categories"))
        out = out.join(counts, by, "left")
    return out


def by_dimensions(runs: DataFrame, sets: list[list[str]], *measures: Column) -> DataFrame:
    """One pass of grouping sets; columns outside a row's set are null."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    return runs.groupingSets([[F.col(c) for c in s] for s in sets], *every).agg(F.grouping_id().cast("long").alias("grouping"), *measures)


def task_matrix(runs: DataFrame, arms: list[str]) -> DataFrame:
    """Mean score by task (rows) and arm (columns)."""
    return runs.groupBy("task").pivot("arm", arms).agg(F.round(F.avg("score"), 3))


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Wins, losses, ties and mean difference over the keys of both; null scores count as ties."""
    a, b = F.col("_a"), F.col("_b")
    both = left.select(key, F.col("score").alias("_a")).join(right.select(key, F.col("score").alias("_b")), key)
    return both.agg(
        F.count(F.lit(1)).alias("shared"), count_when(a > b).alias("wins"), count_when(a < b).alias("losses"), (F.count(F.lit(1)) - count_when(a > b) - count_when(a < b)).alias("ties"),
        F.round(F.sum(F.coalesce(a - b, F.lit(0.0))) / F.nullif(F.count(F.lit(1)), F.lit(0)), 6).alias("mean_difference_all"), F.round(F.avg(a - b), 6).alias("mean_difference_scored"),
    )


def arm_deltas(summary: DataFrame, key: str, value: str) -> DataFrame:
    """Every unordered pair of arms with difference and ratio of a measure; arms are few."""
    other = summary.select(F.col(key).alias("other"), F.col(value).alias("_o"))
    return summary.join(F.broadcast(other), F.col(key) < F.col("other")).select(key, "other", (F.col(value) - F.col("_o")).alias("delta"), F.try_divide(F.col(value), F.nullif("_o", F.lit(0.0))).alias("multiplier"))


def latest_revision(runs: DataFrame, revisions: DataFrame, key: str) -> DataFrame:
    """Runs with the score of their last revision that reran no model, else their own."""
    last = revisions.where(~F.col("model_rerun")).groupBy(key).agg(F.max_by("revised", "ordinal").alias("_revised"), F.max("ordinal").alias("revision"))
    return runs.join(last, key, "left").withColumn("active_score", F.coalesce("_revised", "score")).drop("_revised")


def projection_fidelity(raw: DataFrame, projected: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Counts of missing and extra rows, and per field the share of shared rows that agree (1 without shared rows)."""
    left = raw.select(key, *(F.col(f).alias(f"l_{f}") for f in fields)).withColumn("_l", F.lit(True))
    right = projected.select(key, *(F.col(f).alias(f"r_{f}") for f in fields)).withColumn("_r", F.lit(True))
    both, shared = left.join(right, key, "full_outer"), F.col("_l") & F.col("_r")
    same = [F.coalesce(F.avg(F.when(shared, F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")).cast("double"))), F.lit(1.0)).alias(f"{f}_accuracy") for f in fields]
    return both.agg(count_when(F.col("_r").isNull()).alias("missing"), count_when(F.col("_l").isNull()).alias("extra"), *same)


def amplification(docs: DataFrame, sources: str) -> DataFrame:
    """Documents, distinct sources, documents per source, and the most for one source."""
    per = docs.select(F.explode(sources).alias("s")).groupBy("s").count()
    return per.agg(F.sum("count").alias("placements"), F.count(F.lit(1)).alias("records"), F.round(F.sum("count") / F.count(F.lit(1)), 6).alias("per_record"), F.max("count").alias("most"))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_first = 1").drop("_first")


def histogram(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """A map from value to count for each group."""
    return rows.groupBy(*by, value).count().groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "count")))).alias("histogram"))


def sharded(rows: DataFrame, ordinal: str, shard: int, shards: int) -> DataFrame:
    return rows.where(F.pmod(F.col(ordinal), F.lit(shards)) == shard)


def pending(cases: DataFrame, arms: list[str], completed: DataFrame, key: str) -> DataFrame:
    """(key, arm) still to run: all of them without the completed ones."""
    every = cases.select(key, F.explode(F.array(*(F.lit(a) for a in arms))).alias("arm"))
    return every.join(completed.select(key, "arm"), [key, "arm"], "left_anti")
