"""Run records to metric tables: graph use, forensics, calls, revisions, audits, manifests, reports and their checks.

A record has run_id, task_id, arm, question, score, tokens, semantic_graph_used and two arrays: ``trace`` (step,
frontier, omitted, nodes, edges, evidence, mode, semantics) and ``calls`` (call_id, provider, model, role, input_tokens,
output_tokens, response_id).  Everything per record is array functions over the two; nothing is exploded but rows of
their own tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import sinks

#: Fixed values.
GRAPH_STEPS = ("graph_seed", "graph_decide", "graph_expand", "graph_frontier", "inspect_local")
PLANNED = ("count_distinct", "rank", "label_mode")
TRAVERSING = ("graph_query_ops", "recursive_graph")
NO_TASK_SCORE = 0.0
GROWTH = 1.25


def _ids(steps: Column, name: str) -> Column:
    return F.array_distinct(F.flatten(F.transform(steps, lambda s: F.coalesce(s[name], F.expr("cast(array() as array<string>)")))))


def graph_metrics(records: DataFrame) -> DataFrame:
    """Per run: frontier sizes (first, mean, largest), repeated evidence, decisions and distinct evidence."""
    looks = F.filter("trace", lambda s: s["step"] == "inspect_local")
    sizes = F.transform(looks, lambda s: F.size(s["frontier"]))
    some = F.size("_f") > 0
    rows = records.withColumn("_f", sizes)
    return rows.select(
        "run_id", F.get("_f", F.lit(0)).alias("initial_frontier_size"), F.when(some, F.aggregate("_f", F.lit(0), lambda a, x: a + x) / F.size("_f")).alias("mean_frontier_size"), F.array_max("_f").alias("max_frontier_size"),
        F.aggregate(looks, F.lit(0), lambda a, s: a + F.size(s["omitted"])).alias("duplicate_evidence_count"), F.size(F.filter("trace", lambda s: s["step"] == "graph_decide")).alias("controller_steps"), F.size(_ids(F.col("trace"), "evidence")).alias("presented_evidence_count"),
    )


def execution_mode(arm: Column, executed: Column, local: Column) -> Column:
    traversed = F.when(executed, "graph_query_ops")
    return (
        F.when(arm == "direct_model", "direct_model").when(arm == "raw_records_ops", "raw_record_ops").when(arm == "graph_rlm_semantic_graph_ops", F.coalesce(traversed, F.lit("graph_projection_ops")))
        .when(arm == "graph_rlm_semantic_graph", "recursive_graph").otherwise(F.coalesce(traversed, F.when(local, "graph_projection_ops"), F.lit("unknown")))
    )


def query_semantics(named: Column, plan: Column, arm: Column) -> Column:
    """What a question asks for: what its trace says, else what the planner makes of it."""
    planned = F.when(plan == "compare_group_rate", "unsupported_analytic_operation").when(plan.isin(*PLANNED), "deterministic_operation")
    unplanned = F.when(plan.isNull() & (arm == "raw_records_ops"), "deterministic_operation")
    return F.coalesce(named, planned, unplanned, F.lit("open_ended_semantic_search"))


def contribution_reasons(executed: Column, nodes: Column, edges: Column, evidence: Column, mode: Column) -> Column:
    said = F.array(
        F.when(executed & (F.size(nodes) > 0), "matched_graph_nodes"), F.when(F.size(edges) > 0, "matched_graph_transitions"),
        F.when(F.size(evidence) > 0, "graph_linked_evidence"), F.when(F.size(edges) >= 2, "multi_hop_path"),
    )
    return F.when(mode.isin(*TRAVERSING), F.array_compact(said)).otherwise(F.expr("cast(array() as array<string>)"))


def forensics(records: DataFrame) -> DataFrame:
    """Per run: whether and how the graph was used, and whether it helped."""
    steps = F.filter("trace", lambda s: s["step"].isin(*GRAPH_STEPS))
    named = F.get(F.filter(F.transform("trace", lambda s: s["semantics"]), lambda x: x.isNotNull()), F.lit(0))
    routed = F.get(F.filter(F.transform("trace", lambda s: s["mode"]), lambda x: x.isNotNull()), F.lit(0))
    rows = records.withColumns({"_steps": steps, "graph_query_executed": F.size(steps) > 0})
    rows = rows.withColumns({"matched_node_ids": _ids(F.col("_steps"), "nodes"), "matched_edge_ids": _ids(F.col("_steps"), "edges"), "evidence_ids": _ids(F.col("_steps"), "evidence"), "uses_local_projection_list": F.col("semantic_graph_used") & ~F.col("graph_query_executed")})
    rows = rows.withColumns({"execution_mode": execution_mode(F.col("arm"), F.col("graph_query_executed"), F.col("uses_local_projection_list")), "query_semantics": query_semantics(named, F.col("plan"), F.col("arm"))})
    rows = rows.withColumn("reasons", contribution_reasons(F.col("graph_query_executed"), F.col("matched_node_ids"), F.col("matched_edge_ids"), F.col("evidence_ids"), F.col("execution_mode")))
    some, score = F.size("reasons") > 0, F.col("score")
    outcome = F.when(some & (score > 0), "useful").when(some & (F.col("query_semantics") == "unsupported_analytic_operation"), "insufficient").when(some & (score == 0), "misleading").otherwise("neutral")
    why = F.when(~F.col("graph_query_executed"), "not_executed").when(routed.isNotNull(), F.concat(F.lit("deterministic_operation_mode="), routed, F.lit("; routed to graph controller"))).otherwise("frontier-bound graph traversal step was present in trace")
    return rows.select(
        "run_id", "task_id", "arm", "query_semantics", "execution_mode", "graph_query_executed", "uses_local_projection_list", some.alias("graph_contributed"), outcome.alias("graph_contribution_outcome"), "reasons", F.size("matched_edge_ids").alias("path_length"),
        why.alias("graph_query_reason"), F.size("_steps").alias("graph_rows_returned"), F.size("matched_node_ids").alias("matched_node_count"), F.size("evidence_ids").alias("evidence_id_count"), (F.size("matched_edge_ids") > 0).alias("required_path_found"),
        (F.size("matched_node_ids") > 0).alias("required_entities_found"), ((score > 0) & (F.size("evidence_ids") > 0)).alias("required_evidence_set_complete"), (some & (score > 0)).alias("answer_derived_from_graph_path"), F.col("score").alias("active_score"), F.col("tokens").alias("total_tokens"),
    )


def query_run_details(details: DataFrame) -> DataFrame:
    """Forensics of the runs that executed a graph query."""
    return details.where("execution_mode = 'graph_query_ops'")


def call_rows(records: DataFrame) -> DataFrame:
    """One row per model call, with defaults for what a trace lacks."""
    rows = records.select("run_id", F.col("provider").alias("_provider"), F.posexplode("calls").alias("call_index", "c"))
    name = lambda c: F.coalesce(c, F.lit("unknown"))
    number = lambda c: F.coalesce(F.col(f"c.{c}"), F.lit(0)).cast("long")
    return rows.select(
        F.coalesce("c.call_id", F.concat_ws(":", F.col("run_id").cast("string"), F.col("call_index").cast("string"))).alias("call_id"), "run_id", "call_index", F.coalesce("c.provider", "_provider", F.lit("unknown")).alias("provider"), name(F.col("c.model")).alias("model_name"),
        name(F.col("c.role")).alias("model_role"), number("input_tokens").alias("input_tokens"), number("output_tokens").alias("output_tokens"), F.coalesce(F.col("c.response_id") != "", F.lit(False)).alias("response_id_present"),
    )


def revision_rows(records: DataFrame, revisions: DataFrame) -> DataFrame:
    """Rescored scores beside the ones they replace; ``revisions``: task_id, arm, reason, model_rerun, original, rescored (score_name, backend, value)."""
    rows = records.select("run_id", "task_id", "arm").join(revisions, ["task_id", "arm"]).withColumn("s", F.explode("rescored"))
    before = F.get(F.filter("original", lambda o: o["score_name"] == F.col("s.score_name")), F.lit(0))
    return rows.select("run_id", F.col("s.score_name").alias("score_name"), before["backend"].alias("previous_backend"), before["value"].alias("previous_score"), F.col("s.backend").alias("scorer_backend"), F.col("s.value").alias("score_value"), F.coalesce("reason", F.lit("unspecified")).alias("reason"), F.coalesce("model_rerun", F.lit(False)).alias("model_rerun"))


def audit_rows(records: DataFrame, audits: DataFrame) -> DataFrame:
    """Audit payloads (run_id and some of their fields) with the defaults of a table of audits."""
    rows = records.select("run_id", "task_id", "arm").join(audits, "run_id")
    return rows.select("run_id", F.coalesce("mode", "arm").alias("mode"), F.coalesce("claim_id", "task_id").alias("claim_id"), F.coalesce("subclaims_total", F.lit(0)).cast("long").alias("subclaims_total"), F.coalesce("subclaim_recall", F.lit(0.0)).alias("subclaim_recall"), F.coalesce("complete", F.lit(False)).alias("complete_evidence_coverage"), F.coalesce("outcome", F.lit("neutral")).alias("graph_contribution_outcome"))


def tokens_by_role(calls: Column, role: str, *parts: str) -> Column:
    return F.aggregate(F.filter(calls, lambda c: c["role"] == role), F.lit(0).cast("long"), lambda a, c: a + sum((F.coalesce(c[p], F.lit(0)).cast("long") for p in parts[1:]), F.coalesce(c[parts[0]], F.lit(0)).cast("long")))


def run_metric_rows(records: DataFrame, latest: DataFrame) -> DataFrame:
    """Per run: original and active score (``latest``: run_id, revised, reason), tokens by role and amplification."""
    both = ("input_tokens", "output_tokens")
    rows = records.join(latest, "run_id", "left")
    root_in = tokens_by_role(F.col("calls"), "root", "input_tokens")
    share = lambda a: F.round(F.try_divide(a, F.nullif("context_tokens", F.lit(0))), 6)
    return rows.select(
        "run_id", "task_id", "arm", F.col("score").alias("original_score"), F.coalesce("revised", "score").alias("active_score"), F.col("reason").alias("score_revision_reason"), F.size("calls").alias("model_calls"), F.col("tokens").alias("total_tokens"),
        tokens_by_role(F.col("calls"), "root", *both).alias("root_tokens"), tokens_by_role(F.col("calls"), "worker", *both).alias("worker_tokens"), root_in.alias("root_input_tokens"), share(F.col("tokens")).alias("context_amplification"), share(root_in).alias("root_input_amplification"),
    )


def score_vs_cost(rows: DataFrame) -> DataFrame:
    return rows.select("task_id", "arm", "active_score", "original_score", "total_tokens", "root_tokens", "worker_tokens", "context_amplification")


KEYS = {"runs": ["run_id"], "calls": ["call_id"], "revisions": ["run_id", "score_name", "reason"], "graph_metrics": ["run_id"], "forensics": ["run_id"], "audits": ["run_id"]}


def projection(records: DataFrame, latest: DataFrame, revisions: DataFrame, audits: DataFrame) -> dict[str, DataFrame]:
    """The six metric tables of run records."""
    return {"runs": run_metric_rows(records, latest), "calls": call_rows(records), "revisions": revision_rows(records, revisions), "graph_metrics": graph_metrics(records), "forensics": forensics(records), "audits": audit_rows(records, audits)}


def projection_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table of a projection."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def synced(stored: dict[str, DataFrame], made: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The next content of stored metric tables after an upsert of a projection, by each table's key."""
    return {name: sinks.upsert(stored[name], rows, KEYS[name]) if name in stored else rows for name, rows in made.items()}


def rescored(records: DataFrame, backend: str, value: Column, reason: str) -> DataFrame:
    """Revisions of the task score by another scorer over stored predictions; no model runs again, equal scores make no row."""
    one = lambda b, v: F.array(F.struct(F.lit("task_score").alias("score_name"), b.alias("backend"), v.alias("value")))
    rows = records.withColumn("_new", value).where(~F.col("_new").eqNullSafe(F.col("score")))
    return rows.select("task_id", "arm", F.lit(reason).alias("reason"), F.lit(False).alias("model_rerun"), one(F.lit("original"), F.col("score")).alias("original"), one(F.lit(backend), F.col("_new")).alias("rescored"))


def broken_invariants(rows: DataFrame) -> DataFrame:
    """Metric rows (name, value, least, most) that lie outside of their bounds; a gate passes if there are none."""
    return rows.where(F.col("value").isNull() | (F.col("value") < F.coalesce("least", "value")) | (F.col("value") > F.coalesce("most", "value")))


def payload_growth(payloads: DataFrame) -> DataFrame:
    """Per run (run_id, turn, chars, evidence): whether no payload passes 1.25 times the first, and evidence shown again."""
    first = F.min_by("chars", "turn")
    size = payloads.groupBy("run_id").agg(first.alias("first_chars"), F.max("chars").alias("max_chars"))
    shown = payloads.select("run_id", "turn", F.explode(F.array_distinct("evidence")).alias("e"))
    again = shown.groupBy("run_id", "e").agg((F.count(F.lit(1)) - 1).alias("n")).groupBy("run_id").agg(F.sum("n").alias("repeated"))
    return size.join(again, "run_id", "left").select("run_id", "first_chars", "max_chars", (F.col("max_chars") <= F.col("first_chars") * GROWTH).alias("within"), F.coalesce("repeated", F.lit(0)).cast("long").alias("repeated"))


def validation_counts(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """One row: nodes by kind, records, labels, and whether every record is a node (nodes: kind, owner_id; records: record_id, label)."""
    a = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("owner_id").alias("owners"), F.count_if(F.col("kind") == "aggregate").alias("aggregates"))
    known = nodes.where("kind = 'record'").select(F.col("owner_id").alias("record_id")).distinct().withColumn("_k", F.lit(True))
    b = records.join(known, "record_id", "left").agg(F.count(F.lit(1)).alias("records"), F.count("label").alias("labelled"), F.count_distinct("label").alias("labels"), F.coalesce(F.every(F.coalesce("_k", F.lit(False))), F.lit(True)).alias("materialized"))
    return a.crossJoin(b)  # one row each


def label_counts(records: DataFrame) -> DataFrame:
    return records.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def manifest(records: DataFrame, config: str, version: str) -> DataFrame:
    """One row: what a run of the harness was and cost."""
    from pyspark.sql.functions import lit, sha2

    sets = lambda c: F.array_sort(F.collect_set(c))
    return records.agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("task_id").alias("tasks"), sets("arm").alias("arms"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens")).withColumns({"config_hash": F.substring(sha2(lit(config), 256), 1, 12), "version": lit(version)})


def ablation_matrix(runs: DataFrame) -> dict[str, DataFrame]:
    """Arm summaries, the task x arm matrix in long form, and all arm pairs' differences (arms are few)."""
    arms = runs.groupBy("arm").agg(F.count(F.lit(1)).alias("runs"), F.sum("score").alias("score_sum"), F.round(F.avg("score"), 6).alias("score_mean"), F.count_if(F.col("score") >= 1).alias("correct"), F.sum("tokens").alias("tokens"))
    arms = arms.withColumn("tokens_per_correct", F.round(F.try_divide("tokens", "correct"), 6))
    cells = runs.groupBy("task_id", "arm").agg(F.round(F.avg("score"), 3).alias("score_mean"))
    # one row per task and pair of arms that both ran it: arms of a task are few
    other = cells.select("task_id", F.col("arm").alias("other"), F.col("score_mean").alias("other_mean"))
    pairs = cells.join(other, "task_id").where("arm < other").groupBy("arm", "other").agg(F.count(F.lit(1)).alias("tasks"), F.round(F.avg(F.col("score_mean") - F.col("other_mean")), 6).alias("delta"))
    delta = F.col("delta")
    return {"arms": arms, "tasks": cells, "pairs": pairs.withColumn("interpretation", F.when(delta > 0, "better").when(delta < 0, "worse").otherwise("equal"))}


def discovery_metrics(rows: DataFrame) -> DataFrame:
    """Per arm of discovery runs (arm, coverage_before, coverage_after, complete, false_complete, tokens)."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return rows.groupBy("arm").agg(F.count(F.lit(1)).alias("cases"), rate("coverage_before").alias("coverage_before"), rate("coverage_after").alias("coverage_after"), F.round(F.avg(F.col("coverage_after") - F.col("coverage_before")), 6).alias("gain"), rate("complete").alias("complete_rate"), rate("false_complete").alias("false_complete_rate"), F.sum("tokens").alias("tokens"))


def input_parity(cases: DataFrame, buckets: tuple[str, ...] = ("medium", "complex")) -> DataFrame:
    """The first case (by ordinal) of each bucket asked for."""
    every = F.struct(*(F.col(c) for c in cases.columns))
    return cases.where(F.col("bucket").isin(*buckets)).groupBy("bucket").agg(F.min_by(every, "ordinal").alias("_c")).select("_c.*")


def first_of_bucket(cases: DataFrame, bucket: str, n: int) -> DataFrame:
    """The first n cases of a bucket by ordinal."""
    return cases.where(F.col("bucket") == bucket).orderBy("ordinal").limit(n)


def evidence_trace(subclaims: DataFrame, edges: DataFrame, verified: DataFrame) -> DataFrame:
    """Edges (claim, edge_id, source, target, fact) with whether a claim used them: both ends verified."""
    side = lambda c: verified.select("claim", F.col("sub").alias(c), F.lit(True).alias(f"_{c}"))
    rows = edges.join(subclaims.select("claim").distinct(), "claim", "left_semi").join(side("source"), ["claim", "source"], "left").join(side("target"), ["claim", "target"], "left")
    return rows.select("claim", "edge_id", "source", "target", "fact", F.coalesce(F.col("_source") & F.col("_target"), F.lit(False)).alias("used"))


def cost_split(rows: DataFrame) -> DataFrame:
    """Tokens of a run split into building the graph and querying it (build_tokens, query_tokens, prompt_tokens)."""
    cold = F.col("build_tokens") + F.col("query_tokens")
    return rows.withColumns({"cold_total_tokens": cold, "online_only_tokens": F.col("query_tokens"), "build_share": F.round(F.try_divide(F.col("build_tokens"), cold), 6), "prompt_overhead_ratio": F.round(F.try_divide(F.col("prompt_tokens"), F.col("query_tokens")), 6)})


def batched(rows: DataFrame, part: str, order: str, size: int = 32) -> DataFrame:
    """Rows in batches of ``size`` by order within a part, as a worker gets them."""
    place = F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(place / size).cast("int")).withColumn("place", (place % size).cast("int"))


def labels_of_batches(rows: DataFrame, answers: DataFrame, part: str) -> DataFrame:
    """Labels a worker gave (part, batch, place, label) at the rows they name; places outside of a batch are dropped."""
    return rows.join(answers, [part, "batch", "place"])


def artifact_hash(files: DataFrame) -> DataFrame:
    """One hash over files (path, content) in order of path: that of their own hashes, joined."""
    own = files.select("path", F.sha2("content", 256).alias("h"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda x: F.concat_ws(":", x["path"], x["h"])), "\n")
    return own.agg(F.sha2(listed, 256).alias("artifact_hash"))  # one short row per file


def markdown(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A report's (few) rows as a table; more than ``most`` are an error."""
    found = rows.take(most + 1)
    if len(found) > most:
        raise ValueError(f"{title} has more than {most} rows")
    head = f"# {title}\n\n| " + " | ".join(rows.columns) + " |\n|" + " --- |" * len(rows.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found)])


def write_report(rows: DataFrame, folder: str, title: str) -> None:
    """A report as JSON lines and as a table, beside each other in a folder that must not exist."""
    rows.write.mode("errorifexists").json(f"{folder}/rows")
    spark = rows.sparkSession
    spark.createDataFrame([(markdown(rows, title),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/markdown")
