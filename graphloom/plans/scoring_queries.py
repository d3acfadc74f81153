"""Scores, traces and arms that other runs are judged by, over orders, line items and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import arms, audit, context, discovery, extraction, ingest, records, reports, retrieval, runtime
from graphloom.operators.metrics import first_wins
from graphloom.plans.context_queries import _LINES
from graphloom.plans.state_queries import _CLAIMS, _DISCOVERY, _MODES, _audit_inputs, _subclaims
from graphloom.plans.tables import Registry, table

R = Registry()
query = R.query


def _lines(spark, d):
    return first_wins(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])


def _named(prefix, column):
    return F.concat(F.lit(prefix), column.cast("string"))


@query("SELECT event_type AS label, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL")
def label_counts(spark, d):
    return records.label_counts(table(spark, d, "events").select(F.col("event_type").alias("label")))


@query(f"WITH {_CLAIMS} SELECT e.claim, edge_id, source, target, fact, a.by_query AND b.by_query AS used FROM edges e JOIN v a ON a.claim = e.claim AND a.sub = e.source JOIN v b ON b.claim = e.claim AND b.sub = e.target")
def evidence_trace(spark, d):
    """Every edge of shared evidence, and whether the claim used it."""
    _, sub, edges = _audit_inputs(spark, d)
    return records.evidence_trace(sub, edges, sub.where(audit.verified_in(audit.QUERY)).select("claim", "sub"))


@query("WITH b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) SELECT user_id, event_id, CAST(i // 32 AS INTEGER) AS batch, CAST(i % 32 AS INTEGER) AS place, 'L' || i % 32 AS label FROM b WHERE i % 32 % 3 = 0")
def batch_labels(spark, d):
    """A worker labels every third place of a batch of 32, and some beyond its end, which are dropped."""
    rows = records.batched(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")
    answers = rows.select("user_id", "batch").distinct().withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(42), F.lit(3)))).withColumn("label", _named("L", F.col("place")))
    return records.labels_of_batches(rows, answers, "user_id").select("user_id", "event_id", "batch", "place", "label")


@query(f"""WITH {_LINES}, rel AS (SELECT o_orderkey AS c, coalesce(s, []) AS s FROM orders LEFT JOIN (SELECT l_orderkey, list(DISTINCT 's' || l_suppkey) AS s FROM lines WHERE l_returnflag = 'R' GROUP BY l_orderkey) ON l_orderkey = o_orderkey), t AS (SELECT l_orderkey AS c, l_linenumber AS rank, 's' || l_suppkey AS s FROM lines WHERE l_linenumber <= 5),
p AS (SELECT rel.c, max(CASE WHEN rank = 1 THEN CASE WHEN list_contains(rel.s, t.s) THEN 1.0 ELSE 0.0 END END) AS a, min(CASE WHEN list_contains(rel.s, t.s) THEN rank END) AS first, count(DISTINCT CASE WHEN list_contains(rel.s, t.s) THEN t.s END) AS got, any_value(len(rel.s)) AS n FROM rel LEFT JOIN t USING (c) GROUP BY rel.c)
SELECT count(*) AS cases, round(avg(coalesce(a, 0)), 6) AS next_hop_accuracy, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS next_hop_mrr, round(avg(CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE got::DOUBLE / n END), 6) AS path_recall FROM p""")
def navigation_scores(spark, d):
    """Suppliers in order of their lines are ranked next hops; those of returned lines are relevant."""
    li = _lines(spark, d)
    s = _named("s", F.col("l_suppkey"))
    ranked = li.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("rank"), s.alias("owner_id"))
    back = li.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.collect_set(s).alias("owners"))
    relevant = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id")).join(back, "case_id", "left").withColumn("owners", F.coalesce("owners", F.expr("cast(array() as array<string>)")))
    out = runtime.navigation_scores(ranked, relevant)
    return out.select("cases", *(F.round(c, 6).alias(c) for c in ("next_hop_accuracy", "next_hop_mrr", "path_recall")))


@query(f"WITH {_LINES}, p AS (SELECT l_orderkey AS query_id, [l_suppkey % 4, l_partkey % 3 + 2] AS docs, l_quantity AS score FROM lines) SELECT query_id, array_to_string(docs, ',') AS docs, score FROM p QUALIFY row_number() OVER (PARTITION BY query_id, list_sort(docs) ORDER BY score DESC, array_to_string(docs, ',')) = 1")
def deduplicated_paths(spark, d):
    """Of paths over the same documents the best stays."""
    rows = _lines(spark, d).select(F.col("l_orderkey").alias("query_id"), F.array(F.col("l_suppkey") % 4, F.col("l_partkey") % 3 + 2).alias("docs"), F.col("l_quantity").alias("score"))
    return runtime.deduplicated_paths(rows).withColumn("docs", F.array_join(F.transform("docs", lambda x: x.cast("string")), ","))


@query(f"""WITH {_LINES}, a AS (SELECT l_orderkey AS q, l_suppkey % 12 AS s, max(l_quantity) AS score FROM lines GROUP BY ALL), f AS (SELECT l_orderkey AS q, l_suppkey % 12 AS s, max(l_quantity) AS score FROM lines WHERE l_returnflag = 'R' GROUP BY ALL), b AS (SELECT *, 0 AS t FROM f UNION ALL SELECT *, 1 FROM a WHERE (q, s) NOT IN (SELECT (q, s) FROM f))
SELECT q AS query_id, s AS supplier, score, CAST(row_number() OVER (PARTITION BY q ORDER BY t, score DESC, s) AS INTEGER) AS rank FROM b QUALIFY rank <= 3""")
def backfilled_candidates(spark, d):
    """Suppliers of returned lines first, filled up by the others."""
    rows = _lines(spark, d).select(F.col("l_orderkey").alias("query_id"), (F.col("l_suppkey") % 12).alias("supplier"), "l_quantity", "l_returnflag")
    side = lambda df: df.groupBy("query_id", "supplier").agg(F.max("l_quantity").alias("score"))
    return retrieval.backfilled(side(rows.where("l_returnflag = 'R'")), side(rows), ["query_id"], "supplier", [F.desc("score"), "supplier"], 3)


@query("""WITH c AS (SELECT o_custkey AS d, o_orderkey AS i, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), g AS (SELECT DISTINCT c.d, c.i FROM c JOIN c h ON h.d = c.d AND abs(h.n - c.n) <= 1 WHERE h.i % 7 = 0)
SELECT d AS document_id, array_to_string(list_sort(list('c' || i)), ',') AS consulted, least(1.0::DOUBLE, count(*) / 3::DOUBLE) AS completeness FROM g GROUP BY d""")
def text_window_arm(spark, d):
    """Orders of a customer are chunks; every seventh id is a hit, its neighbours are read in the second round."""
    chunks = table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("index"), _named("c", F.col("o_orderkey")).alias("chunk_id"))
    out = arms.text_arm(chunks, chunks.where("index % 7 = 0").select("document_id", "index"))
    return out.withColumn("consulted", F.array_join("consulted", ","))


@query(f"WITH {_LINES} SELECT l_orderkey AS task, 's' || l_linenumber AS sub, l_returnflag = 'A' AS A, l_returnflag = 'N' AS N, l_returnflag = 'R' AS R FROM lines")
def coverage_pivot(spark, d):
    """Which arm (a return flag) found each subclaim."""
    rows = _lines(spark, d).select(F.col("l_orderkey").alias("task"), _named("s", F.col("l_linenumber")).alias("sub"), F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("arm"), "l_returnflag")
    return audit.coverage_pivot(rows.withColumn("found", F.col("l_returnflag") == F.col("arm")), ["A", "N", "R"])


@query(f"""WITH RECURSIVE {_MODES}, sr AS (SELECT ao.*, CAST(floor(o_totalprice) AS BIGINT) AS tokens FROM ao JOIN orders ON o_orderkey = claim WHERE mode = '{audit.SHARED}')
SELECT claim, mode, unnest(['recall', 'complete', 'shared_facts', 'reused', 'edges', 'contributed', 'answered_by_path', 'per_10k_tokens']) AS score_name, unnest([CASE WHEN total > 0 THEN verified::DOUBLE / total ELSE 1 END, complete::INTEGER::DOUBLE, shared::DOUBLE, 0, edges::DOUBLE, used::INTEGER::DOUBLE, (used AND complete AND edges > 0)::INTEGER::DOUBLE, CASE WHEN complete AND tokens > 0 THEN 10000.0::DOUBLE / tokens ELSE 0 END]) AS score_value FROM sr""")
def audit_score_rows(spark, d):
    """The audit of shared evidence as rows of scores."""
    return audit.pivoted_scores(audit.audit(*_audit_inputs(spark, d), audit.SHARED))


@query(f"WITH {_LINES}, k AS (SELECT l_orderkey AS q, ['d' || l_partkey % 10, 'o' || l_suppkey % 10] AS k FROM lines) SELECT q AS query_id, array_to_string(list_sort(list_distinct(list_filter(flatten(list(k)), lambda x: x IN ('d1', 'd2', 'd3', 'o4', 'o5')))), ',') AS keys FROM k GROUP BY q")
def matched_keys(spark, d):
    """Relevant documents and owners that an order's results name; both count."""
    rows = _lines(spark, d).select(F.col("l_orderkey").alias("query_id"), _named("d", F.col("l_partkey") % 10).alias("doc_id"), _named("o", F.col("l_suppkey") % 10).alias("owner_id"))
    wanted = lambda *names: F.array(*(F.lit(n) for n in names))
    return runtime.matched_keys(rows, wanted("d1", "d2", "d3"), wanted("o4", "o5")).withColumn("keys", F.array_join("keys", ","))


@query("SELECT o_orderkey AS ordinal, o_orderstatus AS bucket FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 25")
def first_of_bucket(spark, d):
    """The first cases of a bucket, as the discovery run takes them."""
    return records.first_of_bucket(table(spark, d, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_orderstatus").alias("bucket")), "F", 25)


@query(f"WITH {_LINES}, s AS (SELECT l_orderkey AS c, l_linenumber * 3 AS a, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber * 5 END AS b, CAST(l_quantity AS INTEGER) AS n FROM lines) SELECT c || ':' || a || ':' || coalesce(b, a + n) AS span_id, coalesce(b, a + n) AS \"end\" FROM s")
def evidence_spans(spark, d):
    """Spans of chunks; without an end they reach as far as their text."""
    n = F.col("l_linenumber").cast("int")
    span, end = context.evidence_span(F.col("l_orderkey").cast("string"), n * 3, F.when(n % 2 == 0, n * 5), F.col("l_quantity").cast("int"))
    return _lines(spark, d).select(span.alias("span_id"), end.alias("end"))


@query(f"""WITH {_LINES}, r AS (SELECT l_orderkey AS q, l_linenumber AS n, CASE l_linenumber WHEN 1 THEN 'Subject' WHEN 2 THEN ' ACTOR ' WHEN 3 THEN 'object' WHEN 4 THEN 'listener' WHEN 5 THEN '' WHEN 6 THEN 'Speaker' ELSE 'place' END AS role, CASE l_partkey % 3 WHEN 0 THEN 'named' WHEN 1 THEN 'nominal' ELSE 'alias' END AS kind FROM lines),
m AS (SELECT *, CASE lower(trim(role)) WHEN 'subject' THEN 'agent' WHEN 'actor' THEN 'agent' WHEN 'object' THEN 'patient' WHEN 'listener' THEN 'addressee' WHEN '' THEN 'participant' ELSE lower(trim(role)) END AS named FROM r)
SELECT q AS event_id, n AS argument, named AS role, kind <> 'nominal' OR named IN ('agent', 'speaker', 'addressee', 'recipient', 'experiencer') AS expects_entity FROM m""")
def argument_roles(spark, d):
    """Roles by their plain names, and whether an entity is expected."""
    n = F.col("l_linenumber").cast("int")
    said = F.element_at(F.array(*(F.lit(x) for x in ("Subject", " ACTOR ", "object", "listener", "", "Speaker", "place"))), F.least(n, F.lit(7)))
    kind = F.when(F.col("l_partkey") % 3 == 0, "named").when(F.col("l_partkey") % 3 == 1, "nominal").otherwise("alias")
    rows = _lines(spark, d).select(F.col("l_orderkey").alias("event_id"), n.alias("argument"), extraction.role_of(said).alias("role"), kind.alias("kind"))
    return rows.select("event_id", "argument", "role", extraction.expects_entity(F.col("kind"), F.col("role")).alias("expects_entity"))


_LIVE = "r AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS arm, CASE WHEN o_custkey % 5 > 0 THEN (o_custkey % 3 + 2) || 'hop' END AS hops, CASE WHEN o_orderkey % 11 = 0 THEN 'e' WHEN o_orderkey % 11 = 1 THEN '' END AS error, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey % 8 / 8.0::DOUBLE END AS er, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey % 4 / 4.0::DOUBLE END AS ep, CASE WHEN o_orderkey % 4 > 1 THEN o_custkey % 2 * 1.0::DOUBLE END AS cc, o_custkey % 7 * 1.0::DOUBLE AS rc, CASE WHEN o_orderstatus = 'F' THEN 0.5::DOUBLE END AS af, CASE WHEN o_orderstatus <> 'P' THEN 1.0::DOUBLE ELSE 0 END AS em, o_orderkey % 100 AS latency, CAST(floor(o_totalprice) AS BIGINT) AS tokens FROM orders)"
_LIVE_SUMS = "CAST(count(*) AS BIGINT) AS runs, count(nullif(error, '')) AS errors, round(avg(er), 4) AS evidence_recall_mean, round(avg(ep), 4) AS evidence_precision_mean, round(avg(cc), 4) AS complete_coverage_rate, round(avg(rc), 4) AS retrieved_count_mean, round(avg(af), 4) AS answer_f1_mean, round(avg(em), 4) AS exact_match_mean, round(avg(latency), 4) AS latency_mean, CAST(sum(tokens) AS BIGINT) AS tokens_total"


@query(f"WITH {_LIVE} SELECT arm, NULL AS hops, 1 AS level, {_LIVE_SUMS} FROM r GROUP BY arm UNION ALL SELECT arm, coalesce(hops, 'None'), 0, {_LIVE_SUMS} FROM r GROUP BY arm, hops")
def live_summary(spark, d):
    """Runs so far by arm, and by arm and hops."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, d, "orders").select(
        F.when(k % 3 == 0, "a").when(k % 3 == 1, "b").otherwise("c").alias("arm"), F.when(c % 5 > 0, F.concat((c % 3 + 2).cast("string"), F.lit("hop"))).alias("hops"), F.when(k % 11 == 0, "e").when(k % 11 == 1, "").alias("error"),
        F.when(k % 4 > 0, c % 8 / 8.0).alias("evidence_recall"), F.when(k % 4 > 0, c % 4 / 4.0).alias("evidence_precision"), F.when(k % 4 > 1, (c % 2).cast("double")).alias("complete_evidence_coverage"), (c % 7).cast("double").alias("retrieved_count"),
        F.when(F.col("o_orderstatus") == "F", 0.5).alias("answer_f1"), F.when(F.col("o_orderstatus") != "P", 1.0).otherwise(0.0).alias("exact_match"), (k % 100).alias("latency"), F.floor("o_totalprice").cast("long").alias("tokens"),
    )
    return reports.live_summary(rows)


_MATRIX = f"""{_MODES}, u AS (SELECT mode AS arm, CASE WHEN total > 0 THEN verified::DOUBLE / total ELSE 1 END AS recall, complete, CAST(floor(o_totalprice) AS BIGINT) AS tokens, CASE WHEN total <= 2 THEN 'simple' WHEN total <= 4 THEN 'medium' ELSE 'complex' END AS complexity, shared > 0 AS shares FROM ao JOIN orders ON o_orderkey = claim),
px AS (SELECT arm, recall, complete, tokens, unnest([NULL, 'complexity', 'shares']) AS dimension, unnest([NULL, complexity, shares::VARCHAR]) AS bucket FROM u), mx AS (SELECT arm, dimension, bucket, count(*) AS n, avg(recall) AS recall, count(*) FILTER (complete) AS c, CAST(sum(tokens) AS BIGINT) AS tokens FROM px GROUP BY ALL),
w AS (SELECT *, c::DOUBLE / n AS p, 1.959963984540054::DOUBLE AS z FROM mx), bs AS (SELECT dimension, bucket, recall FROM mx WHERE arm = '{audit.FLAT}')"""


@query(f"""WITH RECURSIVE {_MATRIX} SELECT arm, w.dimension, w.bucket, n, round(w.recall, 6) AS recall, round(p, 6) AS complete_rate, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - sqrt(p * (1 - p) / n + z * z / (4 * n * n)) * z / (1 + z * z / n)), 6) AS low, round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + sqrt(p * (1 - p) / n + z * z / (4 * n * n)) * z / (1 + z * z / n)), 6) AS high,
CASE WHEN c > 0 THEN round_even(tokens::DOUBLE / c, 6) END AS tokens_per_complete, CASE WHEN arm = '{audit.SHARED}' THEN round(w.recall - b.recall, 6) END AS delta_vs_flat FROM w LEFT JOIN bs b ON w.dimension IS NOT DISTINCT FROM b.dimension AND w.bucket IS NOT DISTINCT FROM b.bucket""")
def claim_matrix(spark, d):
    """All audit modes along two dimensions, with Wilson bounds and the gain of shared evidence over the flat arm."""
    claims, sub, edges = _audit_inputs(spark, d)
    found = audit.audit_all(claims, sub, edges).join(claims.select("claim", "tokens"), "claim")
    size = F.when(F.col("total") <= 2, "simple").when(F.col("total") <= 4, "medium").otherwise("complex")
    rows = found.select(F.col("mode").alias("arm"), "recall", "complete", "tokens", size.alias("complexity"), (F.col("shared_facts") > 0).alias("shares"))
    return reports.claim_matrix(rows, ("complexity", "shares"), audit.FLAT, audit.SHARED)


@query("""WITH r AS (SELECT 'arm' || o_orderkey % 4 AS arm, o_custkey || '' AS task_id, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 3 / 2.0::DOUBLE END AS s, floor(o_totalprice) AS t, (o_orderkey % 50)::DOUBLE AS l FROM orders)
SELECT 'score_vs_cost' AS section, arm, task_id, unnest(['active_score', 'total_tokens', 'latency']) AS measure, unnest([s, t, l]) AS value FROM r UNION ALL SELECT 'by_arm', arm, NULL, unnest(['active_score', 'total_tokens', 'latency']), unnest([coalesce(round_even(avg(s), 6), 0), round_even(avg(t), 6), round_even(avg(l), 6)]) FROM r GROUP BY arm""")
def evaluation_report(spark, d):
    k = F.col("o_orderkey")
    return reports.evaluation_report(table(spark, d, "orders").select(k.alias("run_id"), F.col("o_custkey").alias("task_id"), _named("arm", k % 4).alias("arm"), F.when(k % 5 > 0, k % 3 / 2.0).alias("active_score"), F.floor("o_totalprice").alias("total_tokens"), (k % 50).alias("latency")))


_PAIRS = f"""{_LINES}, t AS (SELECT l_orderkey AS task, l_linenumber AS n, 'P' || l_partkey % 4 AS a, 's' || l_suppkey % 3 AS b, l_returnflag AS f FROM lines), pp AS (SELECT DISTINCT task, least(lower(a), b) AS x, greatest(lower(a), b) AS y FROM t WHERE f <> 'R'), gp AS (SELECT DISTINCT task, least(lower(a), b) AS x, greatest(lower(a), b) AS y FROM t WHERE n % 2 = 1),
pc AS (SELECT task, count(*) AS n FROM pp GROUP BY task), gc AS (SELECT task, count(*) AS n FROM gp GROUP BY task), hc AS (SELECT task, count(*) AS n FROM pp JOIN gp USING (task, x, y) GROUP BY task), k AS (SELECT task, coalesce(pc.n, 0) AS p, coalesce(gc.n, 0) AS g, coalesce(hc.n, 0) AS h FROM (SELECT DISTINCT task FROM t) LEFT JOIN pc USING (task) LEFT JOIN gc USING (task) LEFT JOIN hc USING (task))"""


@query(f"WITH {_PAIRS} SELECT task AS task_id, CASE WHEN p + g = 0 THEN 1 ELSE round(coalesce(h::DOUBLE / nullif(p, 0), 0), 6) END AS precision, CASE WHEN p + g = 0 THEN 1 ELSE round(coalesce(h::DOUBLE / nullif(g, 0), 0), 6) END AS recall, CASE WHEN p + g = 0 THEN 1 ELSE round(2 * h::DOUBLE / (p + g), 6) END AS f1 FROM k")
def pair_set_f1(spark, d):
    """Pairs of parts and suppliers in free text, turned round by every other line, repeated and with odd spaces."""
    n = F.col("l_linenumber")
    li = _lines(spark, d).select(F.col("l_orderkey").alias("task_id"), n.alias("n"), _named("P", F.col("l_partkey") % 4).alias("a"), _named("s", F.col("l_suppkey") % 3).alias("b"), F.col("l_returnflag").alias("f"))
    said = F.when(F.col("n") % 2 == 0, F.concat(F.lit("so ( "), "a", F.lit(" ,"), "b", F.lit(") and"))).otherwise(F.concat(F.lit("("), F.upper("b"), F.lit(", "), F.lower("a"), F.lit(" )")))
    text = lambda keep: F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("n", said.alias("x"))))), lambda v: v["x"]))
    cases = li.groupBy("task_id").agg(text(F.col("f") != "R").alias("prediction"), text(F.col("n") % 2 == 1).alias("gold"))
    return reports.pair_set_f1(cases)


@query(f"""WITH {_LINES}, s AS (SELECT l_orderkey AS c, 3 + l_linenumber % 2 AS g, l_linenumber % 3 + CASE WHEN l_returnflag = 'R' THEN 0 ELSE 2 END AS o FROM lines), a AS (SELECT c, sum(g) AS g, sum(o) AS o FROM s GROUP BY c), b AS (SELECT o_orderkey AS c, o_custkey % 50 AS t FROM orders WHERE o_orderkey % 3 > 0)
SELECT c AS case_id, CAST(coalesce(g, 0) + coalesce(t, 0) AS BIGINT) AS input, CAST(coalesce(o, 0) AS BIGINT) AS output, CAST(coalesce(g, 0) + coalesce(t, 0) + coalesce(o, 0) AS BIGINT) AS total FROM a FULL JOIN b USING (c)""")
def discovery_cost(spark, d):
    """Every line is a search; two of three orders called a model once."""
    n = F.col("l_linenumber").cast("int")
    ids = lambda k: F.transform(F.sequence(F.lit(1), k), lambda i: i.cast("string"))
    searches = _lines(spark, d).select(F.col("l_orderkey").alias("case_id"), F.when(n % 2 == 0, " find the  part ").otherwise("find the right part").alias("goal"), F.when(n % 3 > 0, ids(F.greatest(n % 3, F.lit(1)))).alias("accepted"), F.when(F.col("l_returnflag") != "R", F.array(F.lit("x"), F.lit("y"))).alias("rejected"))
    calls = table(spark, d, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 50).alias("tokens"))
    return reports.discovery_cost(searches, calls)


@query(f"WITH {_DISCOVERY} SELECT claim AS task_id, mode AS arm, before::DOUBLE / total AS coverage_before, after::DOUBLE / total AS coverage_after, after::DOUBLE / total - before::DOUBLE / total AS coverage_gain, CASE WHEN after = total THEN 'complete' WHEN left_ = 0 THEN 'corpus_insufficient' ELSE 'budget_exhausted' END AS stop_reason FROM re WHERE mode = 'iterative'")
def discovery_coverage(spark, d):
    return reports.coverage_rows(discovery.run(_subclaims(spark, d), "iterative"))


_TREE = "t AS (SELECT click_id, rid, j.id, j.parent, j.key, j.type, j.value ->> '$' AS value FROM (SELECT *, row_number() OVER () AS rid FROM clicks) c, json_tree(CASE WHEN json_valid(props) THEN props END) j), e AS (SELECT c.click_id, p.key, c.value, c.type FROM t p JOIN t c ON c.rid = p.rid AND c.parent = p.id WHERE p.type = 'ARRAY' UNION ALL SELECT click_id, key, value, type FROM t WHERE type <> 'ARRAY')"


@query(f"WITH {_TREE} SELECT DISTINCT click_id, key, value FROM e WHERE key IN ('sku', 'tags', 'ver') AND type <> 'NULL' AND value NOT IN ('', '0', 'false')")
def json_key_values(spark, d):
    """Values of keys at three depths of the clicks' properties; some of these are cut off and no JSON."""
    rows, out = table(spark, d, "clicks").select("click_id", "props"), None
    for key in ("sku", "tags", "ver"):
        one = ingest.json_key_values(rows, "click_id", "props", key).select(F.col("id").alias("click_id"), F.lit(key).alias("key"), "value")
        out = one if out is None else out.unionByName(one)
    return out
