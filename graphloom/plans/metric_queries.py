"""Metric views: orders stand for runs, lineitem for model calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import evaluation, metrics
from graphloom.plans.tables import Registry, table

R = Registry()
query = R.query

_RUNS = """runs AS (SELECT o_orderkey AS run_id, year(o_orderdate) AS experiment, o_orderpriority AS arm, o_custkey AS task, CAST(CASE WHEN o_orderstatus = 'F' THEN 1.0 WHEN o_orderstatus = 'O' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score,
  CAST(floor(o_totalprice) AS BIGINT) AS tokens, CAST(o_orderkey % 1009 AS BIGINT) AS latency, o_orderkey % 7 <> 0 AS valid, o_orderkey % 11 = 0 AS leaked, o_orderkey % 13 <> 0 AS tokens_match, o_orderkey % 17 = 0 AS fallback,
  CASE WHEN o_orderkey % 3 = 0 THEN 'smoke' ELSE 'research' END AS execution_path FROM orders),
research AS (SELECT * FROM runs WHERE valid AND NOT leaked AND tokens_match AND NOT fallback AND execution_path = 'research'),
comparable AS (SELECT * FROM runs WHERE valid AND NOT leaked AND tokens_match AND NOT fallback),
calls AS (SELECT l_orderkey AS run_id, l_returnflag AS role, l_linestatus AS model, CAST(l_quantity AS BIGINT) AS input_tokens, CAST(floor(l_extendedprice) AS BIGINT) AS output_tokens FROM lineitem),
forensics AS (SELECT o_orderkey AS run_id, CASE o_orderkey % 3 WHEN 0 THEN 'lookup' WHEN 1 THEN 'multi_hop' ELSE 'aggregate' END AS semantics, o_orderstatus AS mode, o_orderkey % 2 = 0 AS graph_query, o_orderkey % 5 = 0 AS local_list,
  o_orderkey % 4 = 0 AS contributed, CASE o_orderkey % 6 WHEN 0 THEN 'useful' WHEN 1 THEN 'insufficient' ELSE 'neutral' END AS outcome, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS fidelity FROM orders),
audits AS (SELECT o_orderkey AS run_id, o_orderstatus AS mode, CAST(o_orderkey % 5 AS DOUBLE) / 4 AS recall, o_orderkey % 5 = 4 AS complete, CAST(o_orderkey % 3 AS BIGINT) AS edges FROM orders)"""


def _runs(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("run_id"), F.year("o_orderdate").alias("experiment"), F.col("o_orderpriority").alias("arm"), F.col("o_custkey").alias("task"),
        F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.5).otherwise(0.0).alias("score"), F.floor("o_totalprice").cast("long").alias("tokens"), (k % 1009).alias("latency"),
        (k % 7 != 0).alias("valid"), (k % 11 == 0).alias("leaked"), (k % 13 != 0).alias("tokens_match"), (k % 17 == 0).alias("fallback"), F.when(k % 3 == 0, "smoke").otherwise("research").alias("execution_path"),
    )


def _calls(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("role"), F.col("l_linestatus").alias("model"), F.col("l_quantity").cast("long").alias("input_tokens"), F.floor("l_extendedprice").cast("long").alias("output_tokens"))


def _forensics(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("run_id"), F.when(k % 3 == 0, "lookup").when(k % 3 == 1, "multi_hop").otherwise("aggregate").alias("semantics"), F.col("o_orderstatus").alias("mode"), (k % 2 == 0).alias("graph_query"), (k % 5 == 0).alias("local_list"),
        (k % 4 == 0).alias("contributed"), F.when(k % 6 == 0, "useful").when(k % 6 == 1, "insufficient").otherwise("neutral").alias("outcome"), ((k % 10).cast("double") / 10).alias("fidelity"),
    )


def _audits(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("run_id"), F.col("o_orderstatus").alias("mode"), ((k % 5).cast("double") / 4).alias("recall"), (k % 5 == 4).alias("complete"), (k % 3).cast("long").alias("edges"))


def _rounded(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


@query(f"WITH {_RUNS} SELECT run_id, arm, score FROM research")
def research_runs_view(spark, d):
    return metrics.research_runs(_runs(spark, d)).select("run_id", "arm", "score")


@query(f"""WITH {_RUNS} SELECT experiment, arm, count(*) AS runs_total, round(avg(score), 6) AS mean_score, CAST(sum(tokens) AS BIGINT) AS total_tokens, round(avg(tokens), 6) AS mean_tokens, percentile_cont(0.5) WITHIN GROUP (ORDER BY tokens) AS p50_tokens,
  round(avg(latency), 6) AS mean_latency, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY latency), 6) AS p95_latency, round(CAST(sum(tokens) AS DOUBLE) / nullif(sum(score), 0), 6) AS tokens_per_correct FROM research GROUP BY experiment, arm""")
def arm_summary_view(spark, d):
    return _rounded(metrics.arm_summary(_runs(spark, d)), "mean_score", "mean_tokens", "mean_latency", "p95_latency", "tokens_per_correct")


@query(f"WITH {_RUNS} SELECT experiment, arm, role, model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens FROM research JOIN calls USING (run_id) GROUP BY ALL")
def role_summary_view(spark, d):
    return metrics.role_summary(_runs(spark, d), _calls(spark, d))


_FORENSIC = "count(*) AS runs_total, sum(score) AS score_sum, CAST(sum(CASE WHEN graph_query THEN 1 ELSE 0 END) AS BIGINT) AS graph_query_runs, CAST(sum(CASE WHEN local_list THEN 1 ELSE 0 END) AS BIGINT) AS local_projection_runs, CAST(sum(CASE WHEN contributed THEN 1 ELSE 0 END) AS BIGINT) AS graph_contributed_runs, CAST(sum(CASE WHEN outcome = 'useful' THEN 1 ELSE 0 END) AS BIGINT) AS useful_runs, CAST(sum(CASE WHEN outcome = 'insufficient' THEN 1 ELSE 0 END) AS BIGINT) AS insufficient_runs, round(avg(fidelity), 6) AS mean_fidelity"


@query(f"WITH {_RUNS} SELECT experiment, arm, semantics, mode, {_FORENSIC} FROM runs JOIN forensics USING (run_id) GROUP BY experiment, arm, semantics, mode")
def forensic_summary_view(spark, d):
    return _rounded(metrics.forensic_summary(_runs(spark, d), _forensics(spark, d), ["experiment", "arm", "semantics", "mode"]), "mean_fidelity")


@query(f"WITH {_RUNS} SELECT experiment, semantics, mode, {_FORENSIC} FROM comparable JOIN forensics USING (run_id) GROUP BY experiment, semantics, mode")
def execution_mode_view(spark, d):
    return _rounded(metrics.forensic_summary(metrics.comparable_runs(_runs(spark, d)), _forensics(spark, d), ["experiment", "semantics", "mode"]), "mean_fidelity")


@query(f"""WITH {_RUNS} SELECT experiment, mode, count(*) AS runs_total, round(avg(recall), 6) AS mean_recall, round(avg(CASE WHEN complete THEN 1.0 ELSE 0.0 END), 6) AS complete_rate, CAST(sum(CASE WHEN complete THEN 1 ELSE 0 END) AS BIGINT) AS complete_runs,
  CAST(sum(edges) AS BIGINT) AS edges, round(avg(1.0 - recall), 6) AS unsupported_rate, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM comparable JOIN audits USING (run_id) GROUP BY experiment, mode""")
def audit_view(spark, d):
    return _rounded(metrics.audit_summary(_runs(spark, d), _audits(spark, d)), "mean_recall", "complete_rate", "unsupported_rate")


@query(f"""WITH {_RUNS}, c AS (SELECT *, list_filter([CASE WHEN score < 1.0 THEN 'wrong_answer' END, CASE WHEN latency < 100 THEN 'missing_evidence' END, CASE WHEN latency < 500 THEN 'partial_evidence_recall' END], lambda x: x IS NOT NULL) AS cats FROM runs)
SELECT experiment, arm, count(*) AS runs_total, round_even(avg(score), 6) AS score_mean, round_even(avg(latency), 6) AS latency_mean, round_even(median(latency), 6) AS latency_p50, CAST(percentile_disc(0.95) WITHIN GROUP (ORDER BY latency) AS DOUBLE) AS latency_p95,
  CAST(sum(tokens) AS BIGINT) AS tokens_total, CASE WHEN sum(CASE WHEN score >= 1 THEN 1 ELSE 0 END) > 0 THEN round(CAST(sum(tokens) AS DOUBLE) / sum(CASE WHEN score >= 1 THEN 1 ELSE 0 END), 6) END AS tokens_per_correct,
  'missing_evidence=' || CAST(sum(CASE WHEN latency < 100 THEN 1 ELSE 0 END) AS BIGINT) || ',partial_evidence_recall=' || CAST(sum(CASE WHEN latency < 500 THEN 1 ELSE 0 END) AS BIGINT) || ',wrong_answer=' || CAST(sum(CASE WHEN score < 1 THEN 1 ELSE 0 END) AS BIGINT) AS categories
FROM c GROUP BY experiment, arm""")
def run_group_summary(spark, d):
    gold, found = F.array(F.lit("x")), F.when(F.col("latency") < 100, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("x")))
    cats = evaluation.failure_categories(F.lit(True), F.col("score"), gold, found, F.when(F.col("latency") < 500, 0.5).otherwise(1.0))
    out = metrics.group_summary(_runs(spark, d).withColumn("cats", cats), ["experiment", "arm"], "cats")
    shown = F.array_join(F.transform(F.map_entries("categories"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return _rounded(out.withColumn("categories", shown), "tokens_per_correct")


@query(f"WITH {_RUNS} SELECT arm, experiment, count(*) AS n, round(avg(score), 6) AS mean_score FROM runs GROUP BY GROUPING SETS ((arm), (arm, experiment))")
def arm_hop_grouping_sets(spark, d):
    return _rounded(metrics.by_dimensions(_runs(spark, d), [["arm"], ["arm", "experiment"]], F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score")), "mean_score").drop("grouping")


@query(f"""WITH {_RUNS} SELECT task, round(avg(CASE WHEN arm = '1-URGENT' THEN score END), 3) AS urgent, round(avg(CASE WHEN arm = '5-LOW' THEN score END), 3) AS low FROM runs GROUP BY task""")
def task_arm_pivot(spark, d):
    return metrics.task_matrix(_runs(spark, d), ["1-URGENT", "5-LOW"]).select("task", F.col("1-URGENT").alias("urgent"), F.col("5-LOW").alias("low"))


@query(f"""WITH {_RUNS}, a AS (SELECT task, min_by(score, run_id) AS sa FROM runs WHERE arm = '1-URGENT' GROUP BY task), b AS (SELECT task, min_by(score, run_id) AS sb FROM runs WHERE arm = '5-LOW' GROUP BY task)
SELECT count(*) AS shared, CAST(sum(CASE WHEN sa > sb THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN sa < sb THEN 1 ELSE 0 END) AS BIGINT) AS losses, CAST(sum(CASE WHEN sa = sb THEN 1 ELSE 0 END) AS BIGINT) AS ties,
  round(sum(sa - sb) / count(*), 6) AS mean_difference_all, round(avg(sa - sb), 6) AS mean_difference_scored FROM a JOIN b USING (task)""")
def paired_sign_counts(spark, d):
    rows = metrics.first_wins(_runs(spark, d), ["task", "arm"], ["run_id"])
    return metrics.paired(rows.where("arm = '1-URGENT'"), rows.where("arm = '5-LOW'"), "task")


@query(f"WITH {_RUNS}, s AS (SELECT arm, avg(score) AS m FROM runs GROUP BY arm) SELECT a.arm, b.arm AS other, round(a.m - b.m, 6) AS delta, round(a.m / nullif(b.m, 0), 6) AS multiplier FROM s a JOIN s b ON a.arm < b.arm")
def arm_pair_deltas(spark, d):
    return _rounded(metrics.arm_deltas(_runs(spark, d).groupBy("arm").agg(F.avg("score").alias("m")), "arm", "m"), "delta", "multiplier")


@query(f"""WITH {_RUNS}, h AS (SELECT arm, o_orderstatus AS stop, count(*) AS n FROM runs JOIN orders ON run_id = o_orderkey GROUP BY ALL) SELECT arm, string_agg(stop || '=' || n, ',' ORDER BY stop) AS histogram FROM h GROUP BY arm""")
def stop_reason_histogram(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("arm"), F.col("o_orderstatus").alias("stop"))
    shown = F.array_join(F.transform(F.map_entries("histogram"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return metrics.histogram(rows, ["arm"], "stop").select("arm", shown.alias("histogram"))


@query(f"""WITH {_RUNS}, rev AS (SELECT l_orderkey AS run_id, l_linenumber AS ordinal, max(l_discount) AS revised, l_returnflag = 'R' AS model_rerun FROM lineitem GROUP BY ALL), last AS (SELECT run_id, max_by(revised, ordinal) AS revised, max(ordinal) AS revision FROM rev WHERE NOT model_rerun GROUP BY run_id)
SELECT run_id, CAST(revision AS INTEGER) AS revision, coalesce(revised, score) AS active_score FROM runs LEFT JOIN last USING (run_id)""")
def latest_revision(spark, d):
    rerun = (F.col("l_returnflag") == "R").alias("model_rerun")
    rev = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("ordinal"), rerun).agg(F.max("l_discount").alias("revised"))
    return metrics.latest_revision(_runs(spark, d), rev, "run_id").select("run_id", "revision", "active_score")


@query("""WITH raw AS (SELECT event_id, user_id, event_type FROM events WHERE event_id % 10 <> 3), proj AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN user_id + 1 ELSE user_id END AS user_id, CASE WHEN event_id % 8 = 0 THEN NULL ELSE event_type END AS event_type FROM events WHERE event_id % 10 <> 7),
j AS (SELECT r.event_id AS l, p.event_id AS r, r.user_id AS lu, p.user_id AS ru, r.event_type AS lt, p.event_type AS rt FROM raw r FULL OUTER JOIN proj p ON r.event_id = p.event_id)
SELECT CAST(sum(CASE WHEN r IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(sum(CASE WHEN l IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS extra, round(avg(CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN CAST(lu IS NOT DISTINCT FROM ru AS INTEGER) END), 6) AS user_id_accuracy, round(avg(CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN CAST(lt IS NOT DISTINCT FROM rt AS INTEGER) END), 6) AS event_type_accuracy FROM j""")
def projection_fidelity_full_outer(spark, d):
    """Full-outer comparison of a table with an altered projection of it."""
    rows, k = table(spark, d, "events"), F.col("event_id")
    raw = rows.where(k % 10 != 3)
    projected = rows.where(k % 10 != 7).select("event_id", F.when(k % 5 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"), F.when(k % 8 != 0, F.col("event_type")).alias("event_type"))
    return _rounded(metrics.projection_fidelity(raw, projected, "event_id", ["user_id", "event_type"]), "user_id_accuracy", "event_type_accuracy")


@query("""WITH p AS (SELECT l_partkey AS s, count(*) AS c FROM lineitem GROUP BY l_partkey UNION ALL SELECT -l_suppkey - 1, count(*) FROM lineitem GROUP BY l_suppkey)
SELECT CAST(sum(c) AS BIGINT) AS placements, count(*) AS records, round(sum(c) / count(*), 6) AS per_record, max(c) AS most FROM p""")
def document_amplification(spark, d):
    return metrics.amplification(table(spark, d, "lineitem").select(F.array("l_partkey", -F.col("l_suppkey") - 1).alias("s")), "s")


@query("""SELECT c_custkey, arm FROM customer, (VALUES ('dense'), ('graph')) AS a(arm) WHERE c_custkey % 4 = 1 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND (CASE WHEN o_orderstatus = 'F' THEN 'dense' ELSE 'graph' END) = arm)""")
def pending_runs(spark, d):
    done = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "F", "dense").otherwise("graph").alias("arm")).distinct()
    return metrics.pending(metrics.sharded(table(spark, d, "customer"), "c_custkey", 1, 4), ["dense", "graph"], done, "c_custkey")


@query(f"""WITH {_RUNS}, t AS (SELECT run_id, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS parts FROM calls GROUP BY run_id)
SELECT run_id, array_to_string(list_filter([CASE WHEN tokens IS DISTINCT FROM parts THEN 'token_sum_mismatch' END, CASE WHEN run_id % 19 = 0 THEN 'missing_response_id' END, CASE WHEN leaked THEN 'labelled_context_leakage' END, CASE WHEN fallback THEN 'fallback_used' END], lambda x: x IS NOT NULL), ',') AS reasons FROM runs LEFT JOIN t USING (run_id)""")
def artifact_validation(spark, d):
    parts = _calls(spark, d).groupBy("run_id").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("parts"))
    rows = _runs(spark, d).join(parts, "run_id", "left")
    response = F.when(F.col("run_id") % 19 != 0, F.col("run_id").cast("string"))
    return rows.select("run_id", F.array_join(evaluation.invalid_reasons(F.col("tokens"), F.col("parts"), F.lit("p"), response, F.col("leaked"), F.col("fallback")), ",").alias("reasons"))


@query(f"""WITH {_RUNS}, c AS (SELECT run_id, array_agg(struct_pack(role := role, t := input_tokens + output_tokens)) AS traces, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total FROM calls GROUP BY run_id)
SELECT run_id, CAST(list_sum(list_transform(list_filter(traces, lambda x: x.role = 'N'), lambda x: x.t)) AS BIGINT) AS n_tokens, CAST(len(traces) AS BIGINT) AS n_calls, len(list_filter(traces, lambda x: x.t <= 0)) = 0 AS complete FROM c""")
def role_tokens_from_traces(spark, d):
    """Role sums over the nested call traces of a run (array functions, no second grouping)."""
    traces = _calls(spark, d).groupBy("run_id").agg(F.collect_list(F.struct("role", (F.col("input_tokens") + F.col("output_tokens")).alias("t"))).alias("traces"))
    own = F.filter("traces", lambda x: x["role"] == "N")
    return traces.select("run_id", F.when(F.size(own) > 0, F.aggregate(own, F.lit(0).cast("long"), lambda s, x: s + x["t"])).alias("n_tokens"), F.size("traces").cast("long").alias("n_calls"), F.forall("traces", lambda x: x["t"] > 0).alias("complete"))


@query(f"""WITH {_RUNS} SELECT task, round(avg(score), 6) AS mean_score, count(*) AS n FROM runs GROUP BY task ORDER BY round(avg(score), 6), count(*) DESC, task LIMIT 30""")
def hardest_tasks_panel(spark, d):
    """Dashboard panel: a top-k report."""
    _runs(spark, d).createOrReplaceTempView("dashboard_runs")
    return spark.sql("SELECT task, round(avg(score), 6) AS mean_score, count(*) AS n FROM dashboard_runs GROUP BY task ORDER BY mean_score, n DESC, task LIMIT 30")
