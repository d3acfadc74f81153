"""Run records from orders (runs) and lineitem (steps and calls), and their metric tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import records
from graphloom.operators.metrics import first_wins
from graphloom.plans.context_queries import _LINES
from graphloom.plans.tables import Registry, table

R = Registry()
query = R.query

_RECORDS = f"""{_LINES}, steps AS (SELECT l_orderkey AS run_id, l_linenumber AS i, CASE l_linenumber % 5 WHEN 0 THEN 'graph_seed' WHEN 1 THEN 'inspect_local' WHEN 2 THEN 'graph_decide' WHEN 3 THEN 'plan' ELSE 'other' END AS step, CAST(l_quantity AS BIGINT) % 4 AS frontier, l_returnflag = 'R' AS omitted, 'p' || l_partkey AS node, CASE WHEN l_linestatus = 'F' THEN 't' || l_suppkey END AS edge, 'e' || (l_partkey % 10) AS evidence FROM lines),
recs AS (SELECT o_orderkey AS run_id, o_custkey AS task_id, CASE o_orderkey % 5 WHEN 0 THEN 'direct_model' WHEN 1 THEN 'raw_records_ops' WHEN 2 THEN 'graph_rlm_semantic_graph_ops' WHEN 3 THEN 'graph_rlm_semantic_graph' ELSE 'other' END AS arm, CAST(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score, CAST(floor(o_totalprice) AS BIGINT) AS tokens, o_orderkey % 2 = 0 AS local,
 CASE o_orderkey % 4 WHEN 0 THEN 'compare_group_rate' WHEN 1 THEN 'rank' END AS plan, CAST(o_orderkey % 7 AS BIGINT) * 100 AS context_tokens FROM orders),
calls AS (SELECT l_orderkey AS run_id, l_linenumber AS i, CASE WHEN l_linenumber % 2 = 0 THEN 'root' ELSE 'worker' END AS role, CAST(l_quantity AS BIGINT) AS input_tokens, CAST(floor(l_extendedprice) AS BIGINT) AS output_tokens FROM lines)"""
_FORENSIC = f"""{_RECORDS}, g AS (SELECT run_id, count(*) AS rows, count(DISTINCT node) AS nodes, count(DISTINCT edge) AS edges, count(DISTINCT evidence) AS evidence FROM steps WHERE step IN ('graph_seed', 'graph_decide', 'inspect_local') GROUP BY run_id),
a AS (SELECT r.*, coalesce(rows, 0) AS n, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges, coalesce(evidence, 0) AS evidence, CASE WHEN plan = 'compare_group_rate' THEN 'unsupported_analytic_operation' WHEN plan = 'rank' THEN 'deterministic_operation' WHEN arm = 'raw_records_ops' THEN 'deterministic_operation' ELSE 'open_ended_semantic_search' END AS semantics,
 CASE WHEN arm = 'direct_model' THEN 'direct_model' WHEN arm = 'raw_records_ops' THEN 'raw_record_ops' WHEN arm = 'graph_rlm_semantic_graph_ops' THEN CASE WHEN rows > 0 THEN 'graph_query_ops' ELSE 'graph_projection_ops' END WHEN arm = 'graph_rlm_semantic_graph' THEN 'recursive_graph' WHEN rows > 0 THEN 'graph_query_ops' WHEN local THEN 'graph_projection_ops' ELSE 'unknown' END AS mode FROM recs r LEFT JOIN g USING (run_id)),
f AS (SELECT *, mode IN ('graph_query_ops', 'recursive_graph') AND (nodes > 0 OR edges > 0 OR evidence > 0) AS helped FROM a)"""


def _records(spark, d):
    li = first_wins(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    n, s = F.col("l_linenumber"), lambda p, e: F.concat(F.lit(p), e.cast("string"))
    kind = F.when(n % 5 == 0, "graph_seed").when(n % 5 == 1, "inspect_local").when(n % 5 == 2, "graph_decide").when(n % 5 == 3, "plan").otherwise("other")
    wide, none = F.col("l_quantity").cast("long") % 4, F.expr("cast(array() as array<string>)")
    evidence = F.array(s("e", F.col("l_partkey") % 10))
    step = F.struct(
        n.alias("i"), kind.alias("step"), F.when(wide > 0, F.transform(F.sequence(F.lit(1), F.greatest(wide, F.lit(1)).cast("int")), lambda x: x.cast("string"))).otherwise(none).alias("frontier"), F.when(F.col("l_returnflag") == "R", evidence).otherwise(none).alias("omitted"),
        F.array(s("p", F.col("l_partkey"))).alias("nodes"), F.when(F.col("l_linestatus") == "F", F.array(s("t", F.col("l_suppkey")))).otherwise(none).alias("edges"), evidence.alias("evidence"), F.lit(None).cast("string").alias("mode"), F.lit(None).cast("string").alias("semantics"),
    )
    call = F.struct(n.alias("i"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("provider"), F.lit("m").alias("model"), F.when(n % 2 == 0, "root").otherwise("worker").alias("role"), F.col("l_quantity").cast("long").alias("input_tokens"), F.floor("l_extendedprice").cast("long").alias("output_tokens"), F.when(n % 3 != 0, "r").alias("response_id"))
    logs = li.groupBy(F.col("l_orderkey").alias("run_id")).agg(F.array_sort(F.collect_list(step)).alias("trace"), F.array_sort(F.collect_list(call)).alias("calls"))
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(
        k.alias("run_id"), F.col("o_custkey").alias("task_id"), F.when(k % 5 == 0, "direct_model").when(k % 5 == 1, "raw_records_ops").when(k % 5 == 2, "graph_rlm_semantic_graph_ops").when(k % 5 == 3, "graph_rlm_semantic_graph").otherwise("other").alias("arm"), F.lit(None).cast("string").alias("provider"),
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("score"), F.floor("o_totalprice").cast("long").alias("tokens"), (k % 2 == 0).alias("semantic_graph_used"), F.when(k % 4 == 0, "compare_group_rate").when(k % 4 == 1, "rank").alias("plan"), ((k % 7) * 100).cast("long").alias("context_tokens"),
    )
    empty = lambda c: F.expr(f"cast(array() as {logs.schema[c].dataType.simpleString()})")
    return o.join(logs, "run_id", "left").withColumns({c: F.coalesce(c, empty(c)) for c in ("trace", "calls")})


@query(f"""WITH {_RECORDS}, l AS (SELECT run_id, arg_min(frontier, i) AS first, avg(frontier) AS mean, max(frontier) AS most, sum(CASE WHEN omitted THEN 1 ELSE 0 END) AS again FROM steps WHERE step = 'inspect_local' GROUP BY run_id), e AS (SELECT run_id, count(DISTINCT evidence) AS e, sum(CASE WHEN step = 'graph_decide' THEN 1 ELSE 0 END) AS c FROM steps GROUP BY run_id)
SELECT r.run_id, CAST(first AS INTEGER) AS initial_frontier_size, round(mean, 6) AS mean_frontier_size, CAST(most AS INTEGER) AS max_frontier_size, CAST(coalesce(again, 0) AS INTEGER) AS duplicate_evidence_count, CAST(coalesce(c, 0) AS INTEGER) AS controller_steps, CAST(coalesce(e, 0) AS INTEGER) AS presented_evidence_count FROM recs r LEFT JOIN l USING (run_id) LEFT JOIN e USING (run_id)""")
def graph_metrics_rows(spark, d):
    return records.graph_metrics(_records(spark, d)).withColumn("mean_frontier_size", F.round("mean_frontier_size", 6))


@query(f"""WITH {_FORENSIC} SELECT run_id, semantics AS query_semantics, mode AS execution_mode, n > 0 AS graph_query_executed, local AND n = 0 AS uses_local_projection_list, helped AS graph_contributed,
 CASE WHEN helped AND score > 0 THEN 'useful' WHEN helped AND semantics = 'unsupported_analytic_operation' THEN 'insufficient' WHEN helped AND score = 0 THEN 'misleading' ELSE 'neutral' END AS graph_contribution_outcome,
 CASE WHEN mode IN ('graph_query_ops', 'recursive_graph') THEN concat_ws(',', CASE WHEN nodes > 0 THEN 'matched_graph_nodes' END, CASE WHEN edges > 0 THEN 'matched_graph_transitions' END, CASE WHEN evidence > 0 THEN 'graph_linked_evidence' END, CASE WHEN edges >= 2 THEN 'multi_hop_path' END) ELSE '' END AS reasons,
 CAST(edges AS INTEGER) AS path_length, score > 0 AND evidence > 0 AS required_evidence_set_complete, helped AND score > 0 AS answer_derived_from_graph_path FROM f""")
def forensics_rows(spark, d):
    rows = records.forensics(_records(spark, d))
    return rows.select("run_id", "query_semantics", "execution_mode", "graph_query_executed", "uses_local_projection_list", "graph_contributed", "graph_contribution_outcome", F.array_join("reasons", ",").alias("reasons"), "path_length", "required_evidence_set_complete", "answer_derived_from_graph_path")


@query(f"WITH {_FORENSIC} SELECT run_id, arm, CAST(nodes AS INTEGER) AS matched_node_count, CAST(evidence AS INTEGER) AS evidence_id_count, tokens AS total_tokens FROM f WHERE mode = 'graph_query_ops'")
def graph_query_run_details(spark, d):
    return records.query_run_details(records.forensics(_records(spark, d))).select("run_id", "arm", "matched_node_count", "evidence_id_count", "total_tokens")


@query(f"WITH {_RECORDS}, c AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY i) - 1 AS x FROM calls) SELECT run_id || ':' || x AS call_id, run_id, CAST(x AS INTEGER) AS call_index, 'unknown' AS provider, 'm' AS model_name, role AS model_role, input_tokens, output_tokens, i % 3 <> 0 AS response_id_present FROM c")
def model_call_rows(spark, d):
    return records.call_rows(_records(spark, d))


_LAST = "last AS (SELECT o_orderkey AS run_id, CAST(0.25 AS DOUBLE) AS revised, 'exact_match' AS reason FROM orders WHERE o_orderkey % 6 = 0)"


def _last(spark, d):
    return table(spark, d, "orders").where("o_orderkey % 6 = 0").select(F.col("o_orderkey").alias("run_id"), F.lit(0.25).alias("revised"), F.lit("exact_match").alias("reason"))


@query(f"""WITH {_RECORDS}, {_LAST}, t AS (SELECT run_id, count(*) AS n, sum(CASE WHEN role = 'root' THEN input_tokens + output_tokens ELSE 0 END) AS root, sum(CASE WHEN role = 'worker' THEN input_tokens + output_tokens ELSE 0 END) AS worker, sum(CASE WHEN role = 'root' THEN input_tokens ELSE 0 END) AS root_in FROM calls GROUP BY run_id)
SELECT run_id, task_id, arm, score AS original_score, coalesce(revised, score) AS active_score, reason AS score_revision_reason, CAST(coalesce(n, 0) AS INTEGER) AS model_calls, tokens AS total_tokens, CAST(coalesce(root, 0) AS BIGINT) AS root_tokens, CAST(coalesce(worker, 0) AS BIGINT) AS worker_tokens, CAST(coalesce(root_in, 0) AS BIGINT) AS root_input_tokens,
 round(CAST(tokens AS DOUBLE) / nullif(context_tokens, 0), 6) AS context_amplification, round(CAST(coalesce(root_in, 0) AS DOUBLE) / nullif(context_tokens, 0), 6) AS root_input_amplification FROM recs LEFT JOIN last USING (run_id) LEFT JOIN t USING (run_id)""")
def run_metric_rows(spark, d):
    return records.run_metric_rows(_records(spark, d), _last(spark, d))


@query(f"""WITH {_RECORDS}, {_LAST} SELECT task_id, arm, coalesce(revised, score) AS active_score, score AS original_score, tokens AS total_tokens FROM recs LEFT JOIN last USING (run_id)""")
def score_vs_cost(spark, d):
    return records.score_vs_cost(records.run_metric_rows(_records(spark, d), _last(spark, d))).select("task_id", "arm", "active_score", "original_score", "total_tokens")


def _revisions(spark, d):
    r = _records(spark, d).where("run_id % 3 = 0").dropDuplicates(["task_id", "arm"])
    return records.rescored(r.withColumn("score", F.lit(1.0)), "strict", F.when(F.col("task_id") % 2 == 0, 0.5).otherwise(1.0), "stricter scorer")


@query(f"""WITH {_RECORDS}, v AS (SELECT DISTINCT task_id, arm FROM recs WHERE run_id % 3 = 0 AND task_id % 2 = 0)
SELECT run_id, 'task_score' AS score_name, 'original' AS previous_backend, CAST(1.0 AS DOUBLE) AS previous_score, 'strict' AS scorer_backend, CAST(0.5 AS DOUBLE) AS score_value, 'stricter scorer' AS reason, FALSE AS model_rerun FROM recs JOIN v USING (task_id, arm)""")
def score_revision_rows(spark, d):
    """Rescoring of stored runs, and its rows beside the scores they replace."""
    return records.revision_rows(_records(spark, d), _revisions(spark, d))


def _audit_payloads(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").where(k % 2 == 0).select(k.alias("run_id"), F.when(k % 4 == 0, "flat").alias("mode"), F.lit(None).cast("string").alias("claim_id"), F.when(k % 3 == 0, k % 5).alias("subclaims_total"), F.when(k % 3 == 0, 0.5).alias("subclaim_recall"), F.lit(None).cast("boolean").alias("complete"), F.lit(None).cast("string").alias("outcome"))


@query(f"WITH {_RECORDS} SELECT run_id, CASE WHEN run_id % 4 = 0 THEN 'flat' ELSE arm END AS mode, CAST(task_id AS VARCHAR) AS claim_id, CASE WHEN run_id % 3 = 0 THEN run_id % 5 ELSE 0 END AS subclaims_total, CAST(CASE WHEN run_id % 3 = 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS subclaim_recall, FALSE AS complete_evidence_coverage, 'neutral' AS graph_contribution_outcome FROM recs WHERE run_id % 2 = 0")
def audit_rows(spark, d):
    return records.audit_rows(_records(spark, d).withColumn("task_id", F.col("task_id").cast("string")), _audit_payloads(spark, d))


@query(f"""WITH {_RECORDS}, v AS (SELECT DISTINCT task_id, arm FROM recs WHERE run_id % 3 = 0 AND task_id % 2 = 0) SELECT 'runs' AS "table", count(*) AS "rows" FROM recs UNION ALL SELECT 'calls', count(*) FROM calls UNION ALL SELECT 'revisions', count(*) FROM recs JOIN v USING (task_id, arm) UNION ALL SELECT 'graph_metrics', count(*) FROM recs UNION ALL SELECT 'forensics', count(*) FROM recs UNION ALL SELECT 'audits', count(*) FROM recs WHERE run_id % 2 = 0""")
def projection_summary(spark, d):
    from graphloom.operators.lineage import cut

    r = cut(_records(spark, d))
    return records.projection_summary(records.projection(r, _last(spark, d), _revisions(spark, d), _audit_payloads(spark, d)))


@query(f"""WITH {_RECORDS}, {_LAST} SELECT run_id, CASE WHEN run_id % 2 = 0 THEN coalesce(revised, score) ELSE CAST(-1.0 AS DOUBLE) END AS active_score FROM recs LEFT JOIN last USING (run_id)""")
def projection_sync(spark, d):
    """Stored rows of all runs, all scores -1, after an upsert of a projection of every other run."""
    made = records.run_metric_rows(_records(spark, d), _last(spark, d)).select("run_id", "active_score")
    stored = made.withColumn("active_score", F.lit(-1.0))
    return records.synced({"runs": stored}, {"runs": made.where("run_id % 2 = 0")})["runs"]


_KEPT = "run_id % 3 = 0 OR run_id % 2 = 0"


@query(f"""WITH {_RECORDS}, {_LAST}, v AS (SELECT DISTINCT task_id, arm FROM recs WHERE run_id % 3 = 0 AND task_id % 2 = 0), k AS (SELECT * FROM recs WHERE {_KEPT})
SELECT 'runs' AS "table", count(*) AS "rows", sum(CASE WHEN run_id % 2 = 0 THEN coalesce(revised, score) ELSE -1.0::DOUBLE END) AS active FROM k LEFT JOIN last USING (run_id) UNION ALL SELECT 'calls', count(*), NULL FROM calls WHERE {_KEPT} UNION ALL SELECT 'revisions', count(*), NULL FROM k JOIN v USING (task_id, arm)
UNION ALL SELECT 'graph_metrics', count(*), NULL FROM k UNION ALL SELECT 'forensics', count(*), NULL FROM k UNION ALL SELECT 'audits', count(*), NULL FROM k WHERE run_id % 2 = 0""")
def metrics_publication(spark, d):
    """The six tables published as one: every third run with scores of -1, then every other run over them, that batch twice."""
    import uuid

    from graphloom.operators import lineage, publication

    r = lineage.written(_records(spark, d), "publication-records")
    made = records.projection(r, _last(spark, d), _revisions(spark, d), _audit_payloads(spark, d))
    old = {name: t.where("run_id % 3 = 0") for name, t in made.items()}
    old["runs"] = old["runs"].withColumn("active_score", F.lit(-1.0))
    out = publication.Publication(spark, f"{lineage.shared_folder(spark)}/publication-{uuid.uuid4().hex}")
    out.upsert(old, records.KEYS, "first")
    for _ in range(2):
        out.upsert({name: t.where("run_id % 2 = 0") for name, t in made.items()}, records.KEYS, "second")
    tables = out.tables()
    active = tables["runs"].agg(F.sum("active_score").alias("active")).select(F.lit("runs").alias("table"), "active")
    return records.projection_summary(tables).join(active, "table", "left")


@query("""WITH p AS (SELECT conv_id AS run_id, turn, length(text) AS chars, regexp_extract_all(lower(text), '[a-z]{9,}') AS e FROM conversations), s AS (SELECT run_id, arg_min(chars, turn) AS first_chars, max(chars) AS max_chars FROM p GROUP BY run_id),
x AS (SELECT DISTINCT run_id, turn, unnest(e) AS e FROM p), r AS (SELECT run_id, sum(n) AS repeated FROM (SELECT run_id, e, count(*) - 1 AS n FROM x GROUP BY ALL) GROUP BY run_id)
SELECT run_id, CAST(first_chars AS INTEGER) AS first_chars, CAST(max_chars AS INTEGER) AS max_chars, max_chars <= first_chars * 1.25 AS within, CAST(coalesce(repeated, 0) AS BIGINT) AS repeated FROM s LEFT JOIN r USING (run_id)""")
def payload_growth(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("run_id"), "turn", F.length("text").alias("chars"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0)).alias("evidence"))
    return records.payload_growth(rows)


@query(f"""WITH {_RECORDS}, c AS (SELECT task_id, arm, round(avg(score), 3) AS m FROM recs GROUP BY ALL), p AS (SELECT a.arm, b.arm AS other, count(*) AS tasks, round(avg(a.m - b.m), 6) AS delta FROM c a JOIN c b ON a.task_id = b.task_id AND a.arm < b.arm GROUP BY ALL)
SELECT *, CASE WHEN delta > 0 THEN 'better' WHEN delta < 0 THEN 'worse' ELSE 'equal' END AS interpretation FROM p""")
def ablation_pairs(spark, d):
    return records.ablation_matrix(_records(spark, d).drop("trace", "calls"))["pairs"]


@query(f"WITH {_RECORDS} SELECT arm, count(*) AS runs, sum(score) AS score_sum, round(avg(score), 6) AS score_mean, CAST(sum(CASE WHEN score >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS correct, CAST(sum(tokens) AS BIGINT) AS tokens, round(CAST(sum(tokens) AS DOUBLE) / nullif(sum(CASE WHEN score >= 1 THEN 1 ELSE 0 END), 0), 6) AS tokens_per_correct FROM recs GROUP BY arm")
def ablation_arms(spark, d):
    return records.ablation_matrix(_records(spark, d).drop("trace", "calls"))["arms"]


@query(f"WITH {_RECORDS} SELECT count(*) AS runs, count(DISTINCT task_id) AS tasks, array_to_string(list_sort(list(DISTINCT arm)), ',') AS arms, CAST(sum(tokens) AS BIGINT) AS total_tokens, sha256('config')[1:12] AS config_hash, 'v1' AS version FROM recs")
def harness_manifest(spark, d):
    return records.manifest(_records(spark, d), "config", "v1").withColumn("arms", F.array_join("arms", ","))


@query("""WITH r AS (SELECT o_orderpriority AS arm, CAST(o_orderkey % 5 AS DOUBLE) / 10 AS b, CAST(o_orderkey % 9 AS DOUBLE) / 10 AS a, o_orderstatus = 'F' AS c, o_orderkey % 50 = 0 AS f, CAST(floor(o_totalprice) AS BIGINT) AS t FROM orders)
SELECT arm, count(*) AS cases, round(avg(b), 6) AS coverage_before, round(avg(a), 6) AS coverage_after, round(avg(a - b), 6) AS gain, round(avg(CAST(c AS INTEGER)), 6) AS complete_rate, round(avg(CAST(f AS INTEGER)), 6) AS false_complete_rate, CAST(sum(t) AS BIGINT) AS tokens FROM r GROUP BY arm""")
def discovery_arm_metrics(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("arm"), ((k % 5).cast("double") / 10).alias("coverage_before"), ((k % 9).cast("double") / 10).alias("coverage_after"), (F.col("o_orderstatus") == "F").cast("int").alias("complete"), (k % 50 == 0).cast("int").alias("false_complete"), F.floor("o_totalprice").cast("long").alias("tokens"))
    return records.discovery_metrics(rows)


@query("""WITH c AS (SELECT l_orderkey AS claim, count(*) AS n FROM lineitem GROUP BY l_orderkey), b AS (SELECT claim AS ordinal, n, CASE WHEN n <= 2 THEN 'simple' WHEN n <= 4 THEN 'medium' ELSE 'complex' END AS bucket FROM c) SELECT ordinal, n, bucket FROM b WHERE bucket <> 'simple' QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY ordinal) = 1""")
def input_parity(spark, d):
    n = F.col("n")
    cases = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("ordinal")).agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", F.when(n <= 2, "simple").when(n <= 4, "medium").otherwise("complex"))
    return records.input_parity(cases)


@query("SELECT event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 32 AS INTEGER) AS batch, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 32 AS INTEGER) AS place FROM events")
def label_batches(spark, d):
    return records.batched(table(spark, d, "events"), "user_id", "event_id").select("event_id", "batch", "place")


@query("WITH f AS (SELECT event_id, event_type FROM events) SELECT count(*) + 1 AS nodes, count(*) + 1 AS owners, CAST(1 AS BIGINT) AS aggregates, count(*) AS records, count(*) FILTER (event_type <> 'view') AS labelled, count(DISTINCT CASE WHEN event_type <> 'view' THEN event_type END) AS labels, TRUE AS materialized FROM f")
def graph_validation_counts(spark, d):
    e = table(spark, d, "events")
    nodes = e.select(F.lit("record").alias("kind"), F.col("event_id").cast("string").alias("owner_id")).unionByName(spark.range(1).select(F.lit("aggregate").alias("kind"), F.lit("labels").alias("owner_id")))
    return records.validation_counts(nodes, e.select(F.col("event_id").cast("string").alias("record_id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("label")))


@query("WITH c AS (SELECT o_orderkey AS run_id, CAST(floor(o_totalprice) AS BIGINT) AS b, CAST(o_orderkey % 100 AS BIGINT) AS q, CAST(o_orderkey % 10 AS BIGINT) AS p FROM orders) SELECT run_id, b + q AS cold_total_tokens, q AS online_only_tokens, round(CAST(b AS DOUBLE) / nullif(b + q, 0), 6) AS build_share, round(CAST(p AS DOUBLE) / nullif(q, 0), 6) AS prompt_overhead_ratio FROM c")
def cost_split(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("run_id"), F.floor("o_totalprice").cast("long").alias("build_tokens"), (k % 100).alias("query_tokens"), (k % 10).alias("prompt_tokens"))
    return records.cost_split(rows).drop("build_tokens", "query_tokens", "prompt_tokens")


@query("""WITH m AS (SELECT o_orderpriority AS name, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS value FROM orders GROUP BY 1) SELECT name, round(value, 6) AS value FROM m WHERE value < 0.33 OR value > 0.6""")
def broken_invariants(spark, d):
    """Rates that lie outside of their bounds."""
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("value"))
    return records.broken_invariants(rows.withColumns({"least": F.lit(0.33), "most": F.lit(0.6)})).select("name", F.round("value", 6).alias("value"))


_VIEW = "runs AS (SELECT o_custkey AS task, o_orderpriority AS arm, year(o_orderdate) AS experiment, CAST(CASE WHEN o_orderstatus = 'F' THEN 1.0 WHEN o_orderstatus = 'O' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score, CAST(floor(o_totalprice) AS BIGINT) AS tokens, o_orderkey % 1009 AS latency, o_orderkey % 17 = 0 AS fallback FROM orders)"
#: Dashboard panels: the same SQL over a view of runs, for Spark and for the check.
PANELS = {
    "panel_score_by_arm": "SELECT arm, round(avg(score), 3) AS mean_score FROM runs GROUP BY arm",
    "panel_tokens_by_arm": "SELECT arm, CAST(sum(tokens) AS BIGINT) AS tokens, round(avg(tokens), 3) AS mean_tokens FROM runs GROUP BY arm",
    "panel_latency_by_arm": "SELECT arm, round(avg(latency), 3) AS mean_latency, max(latency) AS max_latency FROM runs GROUP BY arm",
    "panel_score_per_token": "SELECT arm, round(1000000 * sum(score) / sum(tokens), 6) AS score_per_million FROM runs GROUP BY arm",
    "panel_experiments": "SELECT experiment, arm, count(*) AS n, round(avg(score), 3) AS mean_score FROM runs GROUP BY experiment, arm",
    "panel_fallbacks": "SELECT arm, CAST(sum(CASE WHEN fallback THEN 1 ELSE 0 END) AS BIGINT) AS fallbacks, count(*) AS n FROM runs GROUP BY arm",
    "panel_wins": "SELECT arm, count(*) AS perfect FROM runs WHERE score >= 1 GROUP BY arm",
    "panel_cost_vs_completeness": "SELECT arm, round(avg(tokens), 3) AS cost, round(avg(CASE WHEN score >= 1 THEN 1.0 ELSE 0.0 END), 3) AS complete FROM runs GROUP BY arm",
    "panel_zero_tasks": "SELECT task, count(*) AS n FROM runs GROUP BY task HAVING max(score) = 0",
    "panel_latest_experiment": "SELECT arm, round(avg(score), 3) AS mean_score FROM runs WHERE experiment = (SELECT max(experiment) FROM runs) GROUP BY arm",
    "panel_task_spread": "SELECT task, round(max(score) - min(score), 3) AS spread, count(DISTINCT arm) AS arms FROM runs GROUP BY task",
}


def _panel(sql: str):
    def run(spark, d):
        k = F.col("o_orderkey")
        rows = table(spark, d, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderpriority").alias("arm"), F.year("o_orderdate").alias("experiment"), F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.5).otherwise(0.0).alias("score"), F.floor("o_totalprice").cast("long").alias("tokens"), (k % 1009).alias("latency"), (k % 17 == 0).alias("fallback"))
        return spark.sql(sql.replace("FROM runs", "FROM {runs}"), runs=rows)

    return run


for _name, _sql in PANELS.items():
    R.queries[_name] = _panel(_sql)
    R.sql[_name] = f"WITH {_VIEW} {_sql}"
