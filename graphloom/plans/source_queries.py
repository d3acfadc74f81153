"""Readers over files that Spark writes from the given tables: cases of five kinds, claims as CSV, run records of artifacts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.operators import sinks
from graphloom.operators.lineage import shared_folder
from graphloom.plans.tables import Registry, table
from graphloom.sources import readers

R = Registry()
query = R.query


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_WORDS = r"CAST(len(list_filter(string_split_regex({}, '[ \t\n\x0b\f\r]+'), lambda x: x <> '')) AS BIGINT)"
_CASES = rf"""n AS (SELECT 'needle' AS kind, 'n' || item_id AS task_id, left(text, 12) AS question, [right(text, 5)] AS answers, text AS context, CAST([] AS VARCHAR[]) AS gold, NULL AS hops, true AS answerable, {_WORDS.format("text")} AS context_tokens FROM benchmark),
r AS (SELECT 'records', 'r' || doc_id, 'label of ' || lang, [lang, source], text, CAST([] AS VARCHAR[]), CAST(doc_id % 4 AS INTEGER), doc_id % 3 > 0, n_chars FROM documents WHERE doc_id % 5 = 0 AND text IS NOT NULL),
p AS (SELECT 'record_pairs', 'p' || doc_id, 'pairs', list_distinct([source, lang]), text, ['e' || doc_id], NULL, true, {_WORDS.format("text")} FROM documents WHERE doc_id % 5 = 1 AND text IS NOT NULL),
c AS (SELECT 'claims', 'c' || item_id, text, ['supported'], 'no context', ['x', 'y'], NULL, true, CAST(2 AS BIGINT) FROM benchmark),
m0 AS (SELECT doc_id // 20 AS g, string_agg('T' || doc_id || ': ' || text, chr(10) || chr(10) ORDER BY doc_id) AS context, list('para_' || doc_id % 20 ORDER BY doc_id) FILTER (doc_id % 7 = 0) AS gold FROM documents WHERE doc_id % 5 = 2 AND text IS NOT NULL GROUP BY g),
m AS (SELECT 'paragraphs', 2 + g % 3 || 'hop__' || g, 'question ' || g, list_distinct(['a', 'b' || g % 2]), context, coalesce(gold, []), CAST(2 + g % 3 AS INTEGER), true, {_WORDS.format("context")} FROM m0)"""


@query(f"WITH {_CASES} SELECT kind, task_id, question, array_to_string(list_sort(answers), ',') AS answers, sha256(context) AS context_hash, array_to_string(gold, ',') AS gold, hops, answerable, context_tokens FROM (SELECT * FROM n UNION ALL SELECT * FROM r UNION ALL SELECT * FROM p UNION ALL SELECT * FROM c UNION ALL SELECT * FROM m)")
def case_files(spark, d):
    """Cases of every kind, written as JSON lines under the names each kind knows, blank lines between, and read back."""
    docs, bench = table(spark, d, "documents").where("text IS NOT NULL"), table(spark, d, "benchmark")
    i, k = F.col("doc_id"), F.col("item_id").cast("string")
    at = lambda rest: docs.where(i % 5 == rest)
    named = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    record = F.struct(named("r", i).alias("id"), F.concat(F.lit("label of "), "lang").alias("question"), F.array("lang", "source").alias("gold_answer"), F.col("text").alias("context_window_text"), (i % 4).alias("hops"), (i % 3 > 0).alias("answerable"), F.col("n_chars").alias("context_len"))
    g = F.expr("doc_id div 20")
    paragraph = F.struct(F.col("doc_id"), (i % 20).cast("int").alias("idx"), named("T", i).alias("title"), F.col("text").alias("paragraph_text"), (i % 7 == 0).alias("is_supporting"))
    many = at(2).groupBy(g.alias("g")).agg(F.array_sort(F.collect_list(paragraph)).alias("paragraphs"))
    c = F.col("g")
    files = {
        "needle": bench.select(F.to_json(F.struct(named("n", k).alias("task_id"), F.substring("text", 1, 12).alias("query"), F.expr("right(text, 5)").alias("needle"), F.col("text").alias("haystack"))).alias("value")),
        "records": at(0).select(F.to_json(record).alias("value")),
        "record_pairs": at(1).select(F.to_json(F.struct(named("p", i).alias("task_id"), F.lit("pairs").alias("question"), F.col("source").alias("gold_answer"), F.array("lang", "source").alias("answer_aliases"), F.col("text").alias("context"), F.array(named("e", i)).alias("gold_evidence_span_ids"))).alias("value")),
        "claims": bench.select(F.to_json(F.struct(named("c", k).alias("claim_id"), F.col("text").alias("claim"), F.lit("supported").alias("aggregated_label"), F.lit("no context").alias("text"), F.array(F.lit("x"), F.lit("y")).alias("evidence"))).alias("value")),
        "paragraphs": many.select(F.to_json(F.struct(F.concat((2 + c % 3).cast("string"), F.lit("hop__"), c.cast("string")).alias("id"), named("question ", c).alias("question"), F.lit("a").alias("answer"), F.array(named("b", c % 2), F.lit("a")).alias("answer_aliases"), F.col("paragraphs"))).alias("value")),
    }
    out = None
    for kind, lines in files.items():
        path = _folder(spark, f"cases-{kind}")
        lines.select(F.explode(F.array("value", F.lit("  "))).alias("value")).write.text(path)
        one = readers.read_cases(spark, path, kind)
        out = one if out is None else out.unionByName(one)
    return out.select("kind", "task_id", "question", F.array_join(F.array_sort("answers"), ",").alias("answers"), F.sha2("context", 256).alias("context_hash"), F.array_join("gold_evidence", ",").alias("gold"), "hops", "answerable", "context_tokens")


@query("SELECT o_orderkey || '' AS ind, 'claim \"' || o_orderkey || '\", with comma' AS claim, 'it is s' || o_custkey % 7 || '|part ' || o_orderkey % 3 AS sub_claims, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || '|' || CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE 'false' END AS labels, o_orderkey % 6 = 0 AS supported FROM orders")
def claim_files(spark, d):
    """Claims as CSV with lists as Python writes them, quotes and commas inside."""
    k = F.col("o_orderkey")
    said = lambda c: F.when(c, "True").otherwise("False")
    rows = table(spark, d, "orders").select(
        k.cast("string").alias("ind"), F.concat(F.lit('claim "'), k.cast("string"), F.lit('", with comma')).alias("claim"), F.concat(F.lit("['it is s"), (F.col("o_custkey") % 7).cast("string"), F.lit("', 'part "), (k % 3).cast("string"), F.lit("']")).alias("sub_claims"),
        F.concat(F.lit("["), said(k % 2 == 0), F.lit(", "), said(k % 3 == 0), F.lit("]")).alias("labels"), said(k % 6 == 0).alias("aggregated_label"),
    )
    path = _folder(spark, "claims")
    rows.write.csv(path, header=True, escape='"')
    out = readers.read_claims(spark, path)
    return out.select("ind", "claim", F.array_join("sub_claims", "|").alias("sub_claims"), F.array_join("labels", "|").alias("labels"), "supported")


@query("""WITH r AS (SELECT o_orderkey AS run_id, 'artifact=a' || o_orderkey % 4 AS a, 'arm' || o_orderkey % 3 AS arm FROM orders) SELECT run_id, arm, CASE WHEN a = 'artifact=a0' THEN 'official' WHEN a = 'artifact=a1' THEN 'superseded' WHEN arm = 'arm0' THEN 'control' ELSE 'unknown' END AS status FROM r""")
def artifact_runs(spark, d):
    """Run records of several artifacts with the registry's status: by artifact, else by arm."""
    k = F.col("o_orderkey")
    path = _folder(spark, "artifacts")
    table(spark, d, "orders").select(k.alias("run_id"), F.concat(F.lit("arm"), (k % 3).cast("string")).alias("arm"), F.concat(F.lit("a"), (k % 4).cast("string")).alias("artifact")).write.partitionBy("artifact").json(path)
    registry = spark.createDataFrame([("artifact", "artifact=a0", "official"), ("artifact", "artifact=a1", "superseded"), ("arm", "arm0", "control")], "kind string, name string, status string")  # a fixed list
    return readers.artifact_status(readers.read_runs(spark, path), registry).select("run_id", "arm", "status")


@query("SELECT o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= CASE o_orderstatus WHEN 'F' THEN 7 WHEN 'O' THEN 5 ELSE 0 END")
def first_per_stratum(spark, d):
    """The first orders of two states, by quota; a stratum that is short would be an error."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return readers.require_quota(readers.first_per_stratum(rows, "o_orderstatus", "o_orderkey", {"F": 7, "O": 5}), "o_orderstatus", 5, ("F", "O"))


@query("SELECT o_orderkey AS run_id, o_orderstatus AS status, o_orderkey % 2 AS batch FROM orders")
def appended_records(spark, d):
    """Run records appended to JSON lines in two batches, and read back."""
    rows, path = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 2).alias("batch")), _folder(spark, "records")
    for batch in (0, 1):
        sinks.append_jsonl(rows.where(F.col("batch") == batch), path)
    return spark.read.schema(rows.schema).json(path)


@query("""WITH r AS (SELECT o_custkey AS task_id, 'arm' || o_orderkey % 3 AS arm, o_orderkey % 2 AS batch, CAST(sum(floor(o_totalprice)) AS BIGINT) AS tokens FROM orders GROUP BY ALL)
SELECT task_id, arm, batch, CASE WHEN task_id % 2 = 0 THEN tokens ELSE -1 END AS tokens, CASE WHEN batch = 0 THEN 'first' WHEN task_id % 2 = 0 THEN 'second' END AS synced FROM r WHERE batch = 0 OR task_id % 2 = 0""")
def batch_upsert(spark, d):
    """Rows keyed by task, arm and batch: a later projection wins, what it does not have stays, and a row keeps when it first came."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("task_id"), F.concat(F.lit("arm"), (k % 3).cast("string")).alias("arm"), (k % 2).alias("batch")).agg(F.sum(F.floor("o_totalprice")).cast("long").alias("tokens"))
    stored = rows.where("batch = 0").withColumn("tokens", F.lit(-1).cast("long")).withColumn("synced", F.lit("first"))
    return sinks.upsert(stored, rows.where("task_id % 2 = 0").withColumn("synced", F.lit("second")), ["task_id", "arm", "batch"], insert_only=("synced",))
