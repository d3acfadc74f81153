"""The frontier controller over orders, all questions at once, alone and beside a text arm."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import controller, inverted
from graphloom.operators.lineage import written
from graphloom.plans.graph_queries import _KEYS, _semantic_docs
from graphloom.plans.tables import Registry, table

R = Registry()
query = R.query

#: Decisions of each kind of question: kind, turn, action, transition, subquery, summary, confidence, gap.  Kinds 4 and 5 are guarded.
SCRIPT = [
    (0, 0, "expand", "__first__", None, None, 0.5, None), (0, 1, "expand", "__first__", None, None, 0.6, None), (0, 2, "answer", None, None, "found it", 0.9, None),
    (1, 0, "inspect", None, None, None, 0.1, None), (1, 1, "expand", "__first__", None, None, 0.2, None), (1, 2, "verify", None, None, None, 0.3, None), (1, 3, "expand", "__first__", None, None, 0.4, None), (1, 4, "stop", None, None, None, 0.25, None),
    (2, 0, "reformulate", None, "other words", None, 0.3, None), (2, 1, "expand", "__first__", None, None, 0.4, None), (2, 2, "expand", "__first__", None, None, 0.5, None), (2, 3, "expand", "__first__", None, None, 0.6, None),
    *((3, turn, "verify", None, None, None, 0.1, None) for turn in range(8)),
    (4, 0, "expand", "nowhere", None, "lost", 0.3, None), (4, 1, "inspect", None, None, "look", 0.4, None), (4, 2, "inspect", None, None, "look", 0.5, None), (4, 3, "answer", None, None, "late", 0.7, None),
    (5, 0, "answer", None, None, "early", 0.8, "what is missing"), (5, 1, "expand", None, None, "on", 0.6, None), (5, 2, "reformulate", None, None, "again", 0.5, None), (5, 3, "answer", None, None, "  ", 0.4, None),
]
_TURNS = 8


def _literal(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)


def _inspect(t: int) -> str:
    """s{t}: states c{t} with the frontier of those that look; evidence is fresh where it first appears."""
    return f"""
e{t} AS MATERIALIZED (SELECT c.q, b.doc AS target, sum(a.w) AS st FROM c{t} c JOIN k a ON a.doc = c.doc JOIN k b ON a.kind = b.kind AND a.key = b.key AND a.doc <> b.doc WHERE c.look AND c.stop IS NULL GROUP BY ALL),
v{t} AS MATERIALIZED (SELECT e.q, target, c.doc AS source, row_number() OVER (PARTITION BY e.q ORDER BY target) AS pos FROM (SELECT * FROM e{t} QUALIFY row_number() OVER (PARTITION BY q ORDER BY st DESC, target) <= 20) e JOIN c{t} c USING (q) WHERE NOT list_contains(c.docs, target)),
x{t} AS MATERIALIZED (SELECT v.q, pos, sp, row_number() OVER (PARTITION BY v.q, sp ORDER BY pos) = 1 AND NOT list_contains(c.presented, sp) AS fresh FROM v{t} v JOIN (SELECT doc, unnest(sp) AS sp FROM d) d ON d.doc = v.target JOIN c{t} c ON c.q = v.q),
y{t} AS (SELECT q, pos, count(*) FILTER (NOT fresh) AS om FROM x{t} GROUP BY ALL),
f{t} AS MATERIALIZED (SELECT q, list({{'target': target, 'id': 'transition_' || left(sha256(source || '->' || target), 12), 'om': coalesce(om, 0)}} ORDER BY pos) AS frontier FROM v{t} LEFT JOIN y{t} USING (q, pos) GROUP BY q),
p{t} AS MATERIALIZED (SELECT q, list(sp) AS fresh FROM x{t} WHERE fresh GROUP BY q),
s{t} AS MATERIALIZED (SELECT c.* EXCLUDE (frontier, presented), CASE WHEN c.look AND c.stop IS NULL THEN coalesce(f.frontier, []) WHEN c.look THEN [] ELSE c.frontier END AS frontier, CASE WHEN c.look AND c.stop IS NULL THEN list_concat(c.presented, coalesce(p.fresh, [])) ELSE c.presented END AS presented FROM c{t} c LEFT JOIN f{t} f USING (q) LEFT JOIN p{t} p USING (q))"""


def _act(t: int) -> str:
    """z{t}: states that a budget ends before turn t; c{t+1}: the others after their decision, kinds 4 and 5 made valid first."""
    lost, again, thin = "(kind >= 4 AND a = 'expand' AND NOT coalesce(list_contains(ids, tr), false))", "(kind >= 4 AND a = 'inspect' AND act = 'inspect' AND len(ids) > 0)", "(kind >= 4 AND a = 'answer' AND len(evidence) < 2 AND calls > 1)"
    return f"""
z{t} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN calls <= 0 THEN 'model_call_budget_exhausted' WHEN depth >= 3 THEN 'max_depth_reached' END AS stop) FROM s{t} WHERE stop IS NULL),
g{t} AS (SELECT z.*, coalesce(m.a, 'stop') AS a, m.tr, m.su, m.sm, coalesce(m.cf, 0) AS cf, m.gap, list_transform(frontier, lambda f: f.id) AS ids FROM z{t} z LEFT JOIN script m ON m.kind = z.kind AND m.turn = {t} WHERE z.stop IS NULL),
h{t} AS (SELECT *, CASE WHEN {lost} AND len(ids) = 0 THEN 'verify' WHEN {lost} OR {again} THEN 'expand' WHEN {thin} THEN 'reformulate' ELSE a END AS b, CASE WHEN {lost} OR {again} OR tr = '__first__' THEN ids[1] ELSE tr END AS pick, CASE WHEN {thin} THEN coalesce(nullif(gap, ''), sub) ELSE coalesce(su, sub) END AS nsub FROM g{t}),
j{t} AS MATERIALIZED (SELECT h.*, d.own, d.en, d.sp, d.doc AS nd FROM (SELECT *, list_filter(frontier, lambda f: f.id = pick)[1].target AS td FROM h{t}) h LEFT JOIN d ON d.doc = h.td AND h.b = 'expand'),
c{t + 1} AS MATERIALIZED (SELECT q, kind, CASE WHEN b = 'reformulate' THEN nsub ELSE sub END AS sub, coalesce(nd, doc) AS doc, CASE WHEN nd IS NULL THEN docs ELSE list_append(docs, nd) END AS docs, CASE WHEN nd IS NULL THEN owners ELSE list_concat(owners, [own], en) END AS owners, CASE WHEN nd IS NULL THEN trs ELSE list_append(trs, pick) END AS trs,
presented, CASE WHEN nd IS NULL THEN evidence ELSE list_distinct(list_concat(evidence, sp)) END AS evidence, depth + CASE WHEN b = 'expand' THEN 1 ELSE 0 END AS depth, calls - 1 AS calls, exps - CASE WHEN b = 'expand' THEN 1 ELSE 0 END AS exps, b AS act, cf AS conf,
CASE WHEN b = 'answer' THEN nullif(trim(sm), '') END AS answer, CASE WHEN b = 'answer' THEN 'answer' WHEN b = 'stop' THEN 'insufficient_evidence' WHEN exps - CASE WHEN b = 'expand' THEN 1 ELSE 0 END < 0 THEN 'expansion_budget_exhausted' END AS stop, b IN ('inspect', 'expand', 'reformulate') AS look, frontier,
omitted + list_sum(list_prepend(0, list_transform(frontier, lambda f: f.om))) AS omitted FROM j{t})"""


_DOCS = """d AS MATERIALIZED (SELECT o_orderkey AS doc, 'c' || o_custkey AS own, CASE WHEN o_orderkey % 3 = 0 THEN 'pair' ELSE 'entity' END AS otype, list_concat(['c' || o_custkey], coalesce(s, [])) AS en, coalesce(p, []) AS sp FROM orders LEFT JOIN (SELECT l_orderkey, list(DISTINCT 's' || l_suppkey) AS s, list(DISTINCT 'p' || l_partkey) AS p FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""
_RUN = f"""{_KEYS}, {_DOCS},
script(kind, turn, a, tr, su, sm, cf, gap) AS (VALUES {", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in SCRIPT)}),
asked AS (SELECT doc AS q, CAST((doc // 50) % 6 AS INTEGER) AS kind FROM d WHERE doc % 50 = 0 UNION ALL SELECT -doc - 1, 0 FROM d WHERE doc % 500 = 0),
cand AS (SELECT q, doc, CASE WHEN doc = q THEN 0.5::DOUBLE ELSE 0.45::DOUBLE END AS score, otype FROM asked JOIN d ON doc IN (q, q + 1) WHERE q >= 0),
seed AS MATERIALIZED (SELECT q, doc FROM (SELECT c.*, score + CASE WHEN otype = 'entity' AND EXISTS (SELECT 1 FROM k a JOIN k b ON a.kind = b.kind AND a.key = b.key AND a.doc <> b.doc WHERE a.doc = c.doc) THEN 0.08::DOUBLE ELSE 0 END AS final FROM cand c) QUALIFY row_number() OVER (PARTITION BY q ORDER BY final DESC, score DESC, doc DESC) = 1),
c0 AS MATERIALIZED (SELECT q, kind, 'question ' || q AS sub, d.doc, CASE WHEN d.doc IS NULL THEN [] ELSE [d.doc] END AS docs, CASE WHEN d.doc IS NULL THEN [] ELSE list_concat([own], en) END AS owners, CAST([] AS VARCHAR[]) AS trs, CAST([] AS VARCHAR[]) AS presented, coalesce(sp, []) AS evidence, 0 AS depth, 8 AS calls, 4 AS exps, CAST(NULL AS VARCHAR) AS act, 0::DOUBLE AS conf, CAST(NULL AS VARCHAR) AS answer,
CASE WHEN d.doc IS NULL THEN 'no_seed' END AS stop, true AS look, CAST([] AS STRUCT(target BIGINT, id VARCHAR, om BIGINT)[]) AS frontier, 0::HUGEINT AS omitted FROM asked LEFT JOIN seed USING (q) LEFT JOIN d ON d.doc = seed.doc),{_inspect(0)},{",".join(_act(t) + "," + _inspect(t + 1) for t in range(_TURNS))},
z{_TURNS} AS (SELECT * REPLACE (CASE WHEN calls <= 0 THEN 'model_call_budget_exhausted' WHEN depth >= 3 THEN 'max_depth_reached' END AS stop) FROM s{_TURNS} WHERE stop IS NULL),
ended AS MATERIALIZED ({" UNION ALL ".join(f"SELECT * FROM s{t} WHERE stop IS NOT NULL UNION ALL SELECT * FROM z{t} WHERE stop IS NOT NULL" for t in range(_TURNS + 1))}),
arm AS MATERIALIZED (SELECT *, list_distinct(list_concat(list_transform(docs, lambda x: x || ''), owners, trs)) AS consulted, least(1, len(evidence) / 5::DOUBLE) AS completeness FROM ended)"""


def _final(spark, d):
    docs = written(_semantic_docs(spark, d).drop("v", "vec").withColumn("owner_type", F.when(F.col("doc_id") % 3 == 0, "pair").otherwise("entity")), "semantic-docs")
    ids = docs.select("doc_id")
    asked = ids.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id")).unionByName(ids.where("doc_id % 500 = 0").select((-F.col("doc_id") - 1).alias("query_id")))
    asked = asked.withColumn("kind", F.when(F.col("query_id") < 0, 0).otherwise(F.expr("cast((query_id div 50) % 6 as int)"))).withColumn("query", F.concat(F.lit("question "), F.col("query_id").cast("string")))
    near = asked.where("query_id >= 0").select("query_id", F.explode(F.array(F.struct(F.col("query_id").alias("doc_id"), F.lit(0.5).alias("score")), F.struct((F.col("query_id") + 1).alias("doc_id"), F.lit(0.45).alias("score")))).alias("s")).select("query_id", "s.*")
    seeds = near.join(docs.select("doc_id", "owner_type"), "doc_id")
    script = spark.createDataFrame([(*r[:3], [r[3]] if r[3] else [], *r[4:]) for r in SCRIPT], "kind int, turn int, action string, transitions array<string>, subquery string, summary string, confidence double, gap string")  # a fixed number of rows
    kinds = asked.select("query_id", "kind")

    def raw(states, turn):
        return script.where(F.col("turn") == turn).join(states.select("query_id").join(kinds, "query_id"), "kind").drop("turn")

    def policy(states, turn):
        plain = raw(states, turn).where("kind < 4").drop("kind")
        return plain.unionByName(controller.guarded(lambda s, t: raw(s, t).where("kind >= 4").drop("kind"))(states, turn))

    return docs, controller.run(docs, asked.select("query_id", "query"), seeds, policy)


@query(f"""WITH {_RUN} SELECT q AS query_id, stop AS stop_reason, answer, CAST(depth AS INTEGER) AS depth, CAST(calls AS INTEGER) AS calls, sub AS subquery, array_to_string(docs, ',') AS path, array_to_string(list_sort(evidence), ',') AS evidence, array_to_string(list_sort(consulted), ',') AS consulted, conf AS confidence, completeness, CAST(len(presented) AS INTEGER) AS presented, CAST(omitted AS BIGINT) AS omitted FROM arm""")
def controller_scripted(spark, d):
    """Scripted questions from all orders whose id is divisible by 50: every action, guard and way to stop."""
    _, states = _final(spark, d)
    out = controller.arm_result(states).select("query_id", "stop_reason", "answer", "evidence", "consulted", "confidence", "completeness")
    omitted = F.aggregate("trace", F.lit(0).cast("long"), lambda a, t: a + t["omitted"])
    more = states.select("query_id", "depth", "calls", "subquery", F.array_join(F.transform("docs", lambda x: x.cast("string")), ",").alias("path"), F.size("presented").alias("presented"), omitted.alias("omitted"))
    joined = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return out.join(more, "query_id").select("query_id", "stop_reason", "answer", "depth", "calls", "subquery", "path", joined("evidence"), joined("consulted"), "confidence", "completeness", "presented", "omitted")


@query(f"""WITH {_RUN}, b AS MATERIALIZED (SELECT q, 's' || l_suppkey AS t FROM asked JOIN lineitem ON l_orderkey = q GROUP BY ALL UNION SELECT q, 'p' || l_partkey FROM asked JOIN lineitem ON l_orderkey = q),
n AS (SELECT q, count(*) AS n FROM b GROUP BY q), w AS (SELECT l_orderkey || ':' || l_linenumber AS chunk, 's' || l_suppkey AS t, l_returnflag AS r FROM lineitem UNION SELECT l_orderkey || ':' || l_linenumber, 'p' || l_partkey, l_returnflag FROM lineitem),
o AS MATERIALIZED (SELECT q, chunk, r, count(*) / n::DOUBLE AS score FROM b JOIN w USING (t) JOIN n USING (q) GROUP BY q, chunk, r, n QUALIFY row_number() OVER (PARTITION BY q ORDER BY count(*) DESC, chunk) <= 5),
txt AS MATERIALIZED (SELECT q, list(chunk ORDER BY chunk) FILTER (chunk NOT LIKE q || ':%') AS ev, max(score) AS conf, list(chunk) FILTER (r = 'R' AND q % 7 = 0) AS bad FROM o GROUP BY q),
m AS (SELECT a.q, a.answer, evidence AS ge, a.conf AS gc, coalesce(ev, []) AS te, coalesce(txt.conf, 0) AS tc, len(coalesce(bad, [])) > 0 AS bad, CASE WHEN len(coalesce(ev, [])) > 0 THEN 'text ' || a.q END AS ta FROM arm a LEFT JOIN txt USING (q)),
u AS (SELECT *, CASE WHEN bad THEN 'contradiction' WHEN len(ge) > 0 AND len(te) > 0 THEN 'both_supported' WHEN len(ge) > 0 THEN 'graph_supported_text_unconfirmed' WHEN len(te) > 0 THEN 'text_supported_graph_missing' ELSE 'insufficient_evidence' END AS status FROM m)
SELECT q AS query_id, status, CASE status WHEN 'both_supported' THEN nullif(concat_ws(chr(10), answer, ta), '') WHEN 'graph_supported_text_unconfirmed' THEN answer WHEN 'text_supported_graph_missing' THEN ta END AS answer, round(CASE status WHEN 'contradiction' THEN least(gc, tc) WHEN 'both_supported' THEN greatest(gc, tc) WHEN 'graph_supported_text_unconfirmed' THEN gc * 0.85 WHEN 'text_supported_graph_missing' THEN tc * 0.85 ELSE 0 END, 6) AS confidence,
CASE status WHEN 'both_supported' THEN 'hybrid' WHEN 'graph_supported_text_unconfirmed' THEN 'graph_rlm' WHEN 'text_supported_graph_missing' THEN 'text_rlm' ELSE 'none' END AS selected, array_to_string(list_sort(list_distinct(list_concat(ge, te))), ',') AS evidence, false AS graph_mutation_allowed FROM u""")
def dual_runtime(spark, d):
    """The controller beside a search over lines: other orders' lines are evidence, returned ones contradict every seventh question."""
    docs, states = _final(spark, d)
    lines = table(spark, d, "lineitem").select("l_orderkey", F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("doc_id"), "l_returnflag", F.array(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("terms"))
    asked = states.select("query_id")
    terms = lines.join(asked, F.col("l_orderkey") == F.col("query_id"), "left_semi").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    # lines of one number and flag are one text; a struct sorts by its fields
    one = F.struct("doc_id", "l_orderkey", "l_returnflag").alias("doc_id")
    texts = written(lines.groupBy(one).agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")), "line-texts")
    hits = inverted.text_search(texts, terms, 5).select("query_id", "score", "doc_id.*")
    other, bad = F.col("l_orderkey") != F.col("query_id"), (F.col("l_returnflag") == "R") & (F.col("query_id") % 7 == 0)
    text = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(other, F.col("doc_id")))).alias("evidence"), F.max("score").alias("confidence"), F.collect_list(F.when(bad, F.col("doc_id"))).alias("contradictions"))
    text = text.withColumn("answer", F.when(F.size("evidence") > 0, F.concat(F.lit("text "), F.col("query_id").cast("string"))))
    out = controller.dual(controller.arm_result(states), text)
    return out.select("query_id", "status", "answer", F.round("confidence", 6).alias("confidence"), "selected", F.array_join(F.array_sort("evidence"), ",").alias("evidence"), "graph_mutation_allowed")
