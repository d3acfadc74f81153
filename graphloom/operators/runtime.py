"""Arms and their routing, for all questions at once: seeds, text rounds, jumps, two arms under one arbiter, record documents.

What a model would decide comes in through a seam: a function from DataFrame to DataFrame.  Rounds are bounded; each
runs one job over all questions that are still open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import ids, vector
from graphloom.operators import retrieval, sinks
from graphloom.operators.lineage import cut
from graphloom.plans import planner

#: Fixed values.
TOP, TEXT_ROUNDS, SUMMARY = 5, 2, 3
NO_SEED, SEEDED, NO_MORE = "no_graph_seed", "graph_seed_retrieved", "no_more_text_chunks"
FOUND = ("evidence_found", "contradiction_found")
EMPTY = "cast(array() as array<string>)"


def _in_order(value: str) -> Column:
    """Values by rank; an array's values one after another."""
    return F.transform(F.array_sort(F.collect_list(F.struct("rank", value))), lambda x: x[value])


def graph_arm(seeds: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """Per query what its seeds (query_id, rank, doc_id, score, text, entities, evidence) say; queries without seeds stop."""
    rows = seeds.groupBy("query_id").agg(
        F.array_join(F.slice(_in_order("text"), 1, SUMMARY), " ").alias("answer"), F.array_distinct(F.flatten(_in_order("evidence"))).alias("evidence"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.min_by("score", "rank"))).alias("confidence"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "entities"))), lambda x: F.concat(F.array(x["doc_id"].cast("string")), x["entities"])))).alias("consulted"),
    )
    out = queries.select("query_id").join(rows, "query_id", "left")
    stopped = F.col("confidence").isNull()
    return out.select("query_id", "answer", F.coalesce("evidence", F.expr(EMPTY)).alias("evidence"), F.coalesce("consulted", F.expr(EMPTY)).alias("consulted"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.least(F.lit(1.0), F.size(F.coalesce("evidence", F.expr(EMPTY))) / F.lit(float(k))).alias("completeness"), F.when(stopped, NO_SEED).otherwise(SEEDED).alias("stop_reason"))


def dynamic_text_arm(docs: DataFrame, queries: DataFrame, inspect: Callable[[DataFrame], DataFrame], rounds: int = TEXT_ROUNDS, k: int = TOP) -> DataFrame:
    """query_id, status, evidence, consulted, confidence, rounds after at most ``rounds`` searches.

    ``docs`` and ``queries`` have terms; ``inspect`` gives (query_id, status, confidence, evidence, next_terms) for the
    new hits (query_id, doc_id, rank) of a round.  A query ends when it found something, or nothing new.
    """
    nothing = F.lit(None).cast("string")
    open_ = queries.select("query_id", "terms")
    seen = queries.sparkSession.createDataFrame([], queries.select("query_id").schema).crossJoin(docs.select("doc_id").limit(0))
    log = None
    for r in range(rounds):
        hits = retrieval.text_search(docs, open_, k).join(seen, ["query_id", "doc_id"], "left_anti")
        hits = cut(hits.select("query_id", "doc_id", "rank"))
        said = cut(inspect(hits))
        step = open_.select("query_id").join(hits.groupBy("query_id").agg(F.array_sort(F.collect_list("doc_id")).alias("new")), "query_id", "left").join(said, "query_id", "left")
        step = step.select("query_id", F.lit(r).alias("round"), F.when(F.col("new").isNull(), F.lit(NO_MORE)).otherwise(F.coalesce("status", nothing)).alias("status"), "new", "evidence", "confidence")
        log = step if log is None else log.unionByName(step)
        seen = seen.unionByName(hits.select("query_id", "doc_id"))
        again = said.where(~F.coalesce(F.col("status").isin(*FOUND), F.lit(False))).select("query_id", "next_terms")
        open_ = cut(open_.join(again, "query_id").select("query_id", F.coalesce("next_terms", "terms").alias("terms")))
    flat = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("round", c)))), lambda x: x[c])))
    told = F.col("new").isNotNull()
    return log.groupBy("query_id").agg(F.max_by("status", "round").alias("status"), flat("evidence").alias("evidence"), flat("new").alias("consulted"), F.coalesce(F.max_by("confidence", F.when(told, F.col("round"))), F.lit(0.0)).alias("confidence"), F.count(F.when(told, 1)).alias("rounds"))


def reformulated(ranked: DataFrame, visited: DataFrame) -> DataFrame:
    """Per query (query_id, doc_id, score) the best result of a new search that was not visited: the jump."""
    fresh = ranked.join(visited, ["query_id", "doc_id"], "left_anti")
    return fresh.groupBy("query_id").agg(F.min_by(F.struct("doc_id", "score"), F.struct(-F.col("score"), "doc_id")).alias("j")).select("query_id", "j.*")


def seed_documents(docs: DataFrame) -> DataFrame:
    """owner_id, doc_id: an owner's entity document, else any, the least id first."""
    return docs.groupBy("owner_id").agg(F.min_by("doc_id", F.struct((F.col("owner_type") != "entity").cast("int"), "doc_id")).alias("doc_id"))


def selected_tokens(docs: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, tokens: words of the documents that hold one of the query's evidence ids, each document once."""
    held = docs.select("doc_id", F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")).alias("_n"), F.explode(F.array_distinct("evidence")).alias("e"))
    hits = evidence.select("query_id", F.explode(F.array_distinct("evidence")).alias("e")).join(held, "e").select("query_id", "doc_id", "_n").distinct()
    return evidence.select("query_id").distinct().join(hits.groupBy("query_id").agg(F.sum("_n").alias("tokens")), "query_id", "left").select("query_id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


def matched_keys(results: DataFrame, documents: Column, owners: Column) -> DataFrame:
    """Per query the relevant document and owner ids that its results name."""
    found = F.array_distinct(F.flatten(F.collect_list(F.array("doc_id", "owner_id"))))
    return results.groupBy("query_id").agg(F.first(documents).alias("_d"), F.first(owners).alias("_o"), found.alias("_f")).select("query_id", F.array_sort(F.array_union(F.array_intersect("_f", "_d"), F.array_intersect("_f", "_o"))).alias("keys"))


def navigation_scores(ranked: DataFrame, relevant: DataFrame, k: int = TOP) -> DataFrame:
    """Means over cases (case_id, owners) of ranked next hops (case_id, rank, owner_id): accuracy, MRR and path recall."""
    top = ranked.where(F.col("rank") <= k).join(relevant, "case_id").withColumn("hit", F.array_contains("owners", F.col("owner_id")))
    per = top.groupBy("case_id").agg(F.max(F.when(F.col("rank") == 1, F.col("hit").cast("double"))).alias("a"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.count_distinct(F.when(F.col("hit"), F.col("owner_id"))).alias("got"))
    rows = relevant.join(per, "case_id", "left")
    recall = F.when(F.size("owners") == 0, 1.0).otherwise(F.coalesce("got", F.lit(0)) / F.size(F.array_distinct("owners")))
    return rows.agg(F.count(F.lit(1)).alias("cases"), F.avg(F.coalesce("a", F.lit(0.0))).alias("next_hop_accuracy"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("next_hop_mrr"), F.avg(recall).alias("path_recall"))


def record_documents(facts: DataFrame) -> DataFrame:
    """A semantic document per record fact (record_id, user_id, label, occurred_at, evidence_span_id)."""
    label = F.coalesce("label", F.lit("label_unresolved"))
    day = F.coalesce(F.date_format("occurred_at", "yyyy-MM-dd"), F.lit("unknown"))
    text = F.concat(F.lit("TYPE=record RECORD_ID="), "record_id", F.lit(" USER_ID="), "user_id", F.lit(" LABEL="), label, F.lit(" DATE="), day)
    entities = F.array(F.col("record_id"), F.concat(F.lit("user_"), "user_id"), F.concat(F.lit("label_"), label))
    return facts.select(F.concat(F.lit("record_fact_"), "record_id").alias("doc_id"), F.lit("record_fact").alias("owner_type"), F.col("record_id").alias("owner_id"), entities.alias("entities"), F.array(F.concat(F.lit("record_fact_event_"), "record_id")).alias("events"), F.array("evidence_span_id").alias("evidence"), text.alias("text"))


def context_documents(lines: DataFrame, questions: DataFrame) -> DataFrame:
    """A root per task (task_id, question) and a document per record line (task_id, index, line, user, day, label)."""
    task, at = F.col("task_id"), F.col("index").cast("string")
    root = questions.select("task_id", F.concat(task, F.lit(":root")).alias("doc_id"), F.lit("entity").alias("owner_type"), F.array(F.concat(task, F.lit(":context"))).alias("entities"), F.concat(F.lit("Public context. Question: "), "question").alias("text"))
    said = F.when(F.col("label").isNull(), F.col("line")).otherwise(F.concat("line", F.lit(" || WorkerLabel: "), "label"))
    entities = F.array(F.concat(task, F.lit(":context")), F.concat(F.lit("user:"), F.coalesce("user", F.concat(F.lit("user_unknown_"), at))), F.concat(F.lit("date:"), F.coalesce("day", F.concat(F.lit("date_unknown_"), at))))
    return root.unionByName(lines.select("task_id", F.concat(task, F.lit(":record:"), at).alias("doc_id"), F.lit("evidence").alias("owner_type"), entities.alias("entities"), said.alias("text")))


def worker_answer(labels: DataFrame, questions: DataFrame) -> DataFrame:
    """task_id, answer: the most or least common of a task's labels, if its question asks for one; ties by name."""
    n = labels.where("label is not null").groupBy("task_id", "label").agg(F.count(F.lit(1)).alias("n"))
    ends = n.groupBy("task_id").agg(F.max(F.struct("n", "label")).alias("most"), F.min(F.struct("n", "label")).alias("least"))
    low = F.lower("question")
    chosen = F.when(low.contains("most common"), F.col("most.label")).when(low.contains("least common"), F.col("least.label"))
    return questions.join(ends, "task_id", "left").select("task_id", F.concat(F.lit("Label: "), chosen).alias("answer"))


def routed(question: str, facts: DataFrame) -> DataFrame:
    """One row: a deterministic answer, else a refusal of what is planned but not executed, else the graph controller's turn."""
    made = planner.plan(question)
    if made is None:
        return facts.sparkSession.range(1).select(F.lit("graph_controller").alias("route"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("answer"))
    route = F.when(F.col("status") == "complete", "deterministic").when(F.col("status") == "unsupported", "fail_closed").otherwise("graph_controller")
    return planner.execute(made, facts).select(route.alias("route"), "status", "answer")


def embedding_rows(docs: DataFrame, encode: Callable[[Column], Column], encoder: str) -> DataFrame:
    """doc_id, content_hash, encoder, embedding_id, v: equal texts are encoded once and joined back.

    ``encode`` is the encoder's seam: a column of texts to one of vectors (a pandas UDF where a model stands behind it).
    """
    hashed = docs.select("doc_id", "text", F.sha2("text", 256).alias("content_hash"))
    own = hashed.groupBy("content_hash").agg(F.first("text").alias("text")).select("content_hash", vector.normalized(encode(F.col("text"))).alias("v"))
    return hashed.drop("text").join(own, "content_hash").select("doc_id", "content_hash", F.lit(encoder).alias("encoder"), ids.joined_id("emb", F.lit(encoder), F.col("content_hash")).alias("embedding_id"), "v")


#: Keys of the label tables; rows of one key are one row, the last write wins.
LABEL_KEYS = {
    "documents": ["document_id"], "chunks": ["chunk_id"], "mentions": ["mention_id"], "entities": ["entity_id"], "raw_relations": ["raw_relation_id"], "events": ["event_id"], "arguments": ["argument_id"], "hypotheses": ["hypothesis_id"],
    "terminal_resolutions": ["mention_id", "stage", "policy"], "spans": ["span_id"], "claims": ["claim_id"], "relations": ["relation_id"], "candidates": ["relation_candidate_id"], "states": ["transition_id", "entity_id"], "transitions": ["transition_id"], "embeddings": ["embedding_id"],
}
INSERT_ONLY = {"documents": ("created_at",), "chunks": ("extraction_status", "extraction_attempts")}


def write_patch(stored: dict[str, DataFrame], made: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The next content of the label tables after a patch, in the order of their dependencies."""
    return {name: sinks.upsert(stored[name], made[name], LABEL_KEYS[name], insert_only=INSERT_ONLY.get(name, ())) if name in made else stored[name] for name in LABEL_KEYS if name in stored}


def delete_subtree(tables: dict[str, DataFrame], chunks: DataFrame) -> dict[str, DataFrame]:
    """Label tables without the chunks (chunk_id) and all that hangs from them: mentions and their hypotheses, events and their arguments."""
    doomed = chunks.select("chunk_id").distinct()
    out = {name: rows.join(doomed, "chunk_id", "left_anti") if "chunk_id" in rows.columns else rows for name, rows in tables.items()}
    for parent, key, children in (("mentions", "mention_id", ("hypotheses", "terminal_resolutions")), ("events", "event_id", ("arguments",))):
        if parent in tables:
            gone = tables[parent].join(doomed, "chunk_id", "left_semi").select(key).distinct()
            for child in (c for c in children if c in out):
                out[child] = out[child].join(gone, key, "left_anti")
    return out


def resumed_state(states: DataFrame) -> DataFrame:
    """Per document the state after its last chunk that is done (document_id, index, status, known): where a resume begins."""
    done = states.where("status = 'DONE'")
    return done.groupBy("document_id").agg(F.max("index").alias("index"), F.max_by("known", "index").alias("known"))


def deduplicated_paths(paths: DataFrame) -> DataFrame:
    """One path per query and set of documents, the best scored, then the first by its documents."""
    w = Window.partitionBy("query_id", F.array_sort("docs")).orderBy(F.desc("score"), F.array_join(F.transform("docs", lambda d: d.cast("string")), ","))
    return paths.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
