"""Entity context, and extraction: lineitem rows are mentions of parts in orders, orders are chunks of customers' documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import context, extraction
from graphloom.operators.metrics import first_wins
from graphloom.plans.tables import Registry, table

R = Registry()
query = R.query

_LINES = "lines AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)"
_L = f"""{_LINES}, chunks AS (SELECT 'o' || o_orderkey AS chunk_id, o_custkey AS document_id, o_orderkey AS "index" FROM orders),
entities AS (SELECT 'p' || p_partkey AS entity_id, p_name AS canonical_name FROM part UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier),
k AS (SELECT *, l_orderkey || '_' || l_linenumber AS key FROM lines), mentions AS (SELECT 'm' || key AS mention_id, 'o' || l_orderkey AS chunk_id, 'p' || l_partkey AS entity_id, 'Part ' || l_partkey AS text, l_linenumber * 10 AS start_char, CASE WHEN l_linenumber % 2 = 0 THEN 'named' ELSE 'nominal' END AS kind FROM k),
hypotheses AS (SELECT 'm' || key AS mention_id, CASE l_returnflag WHEN 'A' THEN 'confirmed' WHEN 'N' THEN 'likely' ELSE 'rejected' END AS status, CASE WHEN l_linestatus = 'F' THEN 'named_entity' END AS kind, CASE WHEN l_linenumber = 3 THEN 'rejected' ELSE 'link_to_existing' END AS decision, l_discount AS confidence, 'p' || l_partkey AS final_entity_id FROM k),
spans AS (SELECT 'x' || key AS span_id, o_custkey AS document_id, CASE WHEN l_linenumber <> 5 THEN 'o' || l_orderkey END AS chunk_id, l_linenumber * 9 AS start_char, 'span ' || key AS text FROM k JOIN orders ON o_orderkey = l_orderkey),
refs AS (SELECT 'x' || key AS span_id, 'p' || l_partkey AS entity_id, 'patient' AS role FROM k UNION ALL SELECT 'x' || key, 's' || l_suppkey, 'agent' FROM k),
claims AS (SELECT 'c' || key AS claim_id, CASE WHEN l_linenumber <> 6 THEN 'o' || l_orderkey END AS chunk_id, list_distinct(['p' || l_partkey, 's' || l_suppkey]) AS subjects FROM k),
relations AS (SELECT 'r' || key AS relation_id, 's' || l_suppkey AS source_entity_id, 'p' || l_partkey AS target_entity_id, 'o' || l_orderkey AS chunk_id, 'x' || key AS span_id FROM k),
asked AS (SELECT entity_id FROM entities WHERE CAST(entity_id[2:] AS BIGINT) % 50 = 0)"""
_DOCUMENT = 7


def labels(spark, d):
    o, s = table(spark, d, "orders"), lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    li = first_wins(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    li = li.withColumn("key", F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    key, chunk, n, part, supp = (lambda p: F.concat(F.lit(p), "key")), s("o", "l_orderkey"), F.col("l_linenumber"), s("p", "l_partkey"), s("s", "l_suppkey")
    owner = o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("document_id"))
    claims = li.select(key("c").alias("claim_id"), F.when(n != 6, chunk).alias("chunk_id"), F.array_distinct(F.array(part, supp)).alias("subjects"))
    links = li.select(key("r").alias("relation_id"), supp.alias("source_entity_id"), part.alias("target_entity_id"), chunk.alias("chunk_id"), key("x").alias("span_id"))
    return {
        "chunks": o.select(s("o", "o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("index")),
        "entities": table(spark, d, "part").select(s("p", "p_partkey").alias("entity_id"), F.col("p_name").alias("canonical_name")).unionByName(table(spark, d, "supplier").select(s("s", "s_suppkey").alias("entity_id"), F.col("s_name").alias("canonical_name"))),
        "mentions": li.select(key("m").alias("mention_id"), chunk.alias("chunk_id"), part.alias("entity_id"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("text"), (n * 10).alias("start_char"), F.when(n % 2 == 0, "named").otherwise("nominal").alias("kind")),
        "hypotheses": li.select(key("m").alias("mention_id"), F.when(F.col("l_returnflag") == "A", "confirmed").when(F.col("l_returnflag") == "N", "likely").otherwise("rejected").alias("status"), F.when(F.col("l_linestatus") == "F", "named_entity").alias("kind"), F.when(n == 3, "rejected").otherwise("link_to_existing").alias("decision"), F.col("l_discount").alias("confidence"), part.alias("final_entity_id")),
        "spans": li.join(owner, "l_orderkey").select(key("x").alias("span_id"), "document_id", F.when(n != 5, chunk).alias("chunk_id"), (n * 9).alias("start_char"), F.concat(F.lit("span "), "key").alias("text")),
        "span_refs": li.select(key("x").alias("span_id"), part.alias("entity_id"), F.lit("patient").alias("role")).unionByName(li.select(key("x").alias("span_id"), supp.alias("entity_id"), F.lit("agent").alias("role"))),
        "claims": claims, "events": claims.select(F.col("claim_id").alias("event_id"), "chunk_id", F.col("subjects").alias("participants")),
        "frames": li.select(key("e").alias("event_id"), key("x").alias("span_id"), F.lit("ships").alias("predicate")),
        "arguments": li.select(F.concat(F.lit("a"), "key").alias("argument_id"), key("e").alias("event_id"), part.alias("entity_id"), F.lit("patient").alias("role")),
        "relations": links, "candidates": links,
    }


def asked(t):
    return t["entities"].where("cast(substring(entity_id, 2) as long) % 50 = 0").select("entity_id")


@query(f'WITH {_L} SELECT document_id, chunk_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY "index") AS INTEGER) AS "at" FROM chunks')
def document_chunks(spark, d):
    return context.document_chunks(labels(spark, d)["chunks"]).select("document_id", "chunk_id", "at")


@query(f'WITH {_L} SELECT document_id, mention_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY "index", start_char, mention_id) AS INTEGER) AS "at" FROM mentions JOIN chunks USING (chunk_id)')
def raw_mentions_in_order(spark, d):
    t = labels(spark, d)
    return context.raw_mentions(t["chunks"], t["mentions"]).select("document_id", "mention_id", "at")


@query(f'WITH {_L} SELECT document_id, mention_id, status, coalesce(h.kind, m.kind) AS mention_kind, CAST(row_number() OVER (PARTITION BY document_id ORDER BY "index", start_char, confidence DESC, mention_id) AS INTEGER) AS "at" FROM mentions m JOIN chunks USING (chunk_id) JOIN hypotheses h USING (mention_id)')
def resolution_audit(spark, d):
    t = labels(spark, d)
    return context.resolution_audit(t["chunks"], t["mentions"], t["hypotheses"]).select("document_id", "mention_id", "status", "mention_kind", "at")


@query(f"WITH {_L} SELECT entity_id, mention_id, claim_id FROM asked JOIN mentions USING (entity_id) JOIN claims USING (chunk_id)")
def claims_for_entities(spark, d):
    t = labels(spark, d)
    return context.claims_by_chunk(asked(t), t["mentions"], t["claims"]).select("entity_id", "mention_id", "claim_id")


def _context(name: str, *columns: str, document=None):
    def run(spark, d):
        t = labels(spark, d)
        # a single document is asked for all entities, all documents for some
        who = t["entities"].select("entity_id") if document is not None else asked(t)
        return context.entity_context(who, t, document)[name].select(*columns)

    return run


_OF = {None: ("asked", ""), _DOCUMENT: ("entities", f"AND c.document_id = {_DOCUMENT}")}
for _d, (_who, _and) in _OF.items():
    _tail = "" if _d is None else "_of_document"
    _left = "LEFT JOIN" if _d is None else "JOIN"
    _span = "" if _d is None else f"AND x.document_id = {_DOCUMENT}"
    R.queries |= {
        f"context_mentions{_tail}": _context("mentions", "entity_id", "mention_id", "chunk_index", document=_d), f"context_spans{_tail}": _context("evidence_spans", "entity_id", "span_id", "role", "chunk_index", document=_d),
        f"context_claims{_tail}": _context("claims", "entity_id", "claim_id", "chunk_index", document=_d), f"context_events{_tail}": _context("events", "entity_id", "event_id", "chunk_index", document=_d),
        f"context_event_frames{_tail}": _context("event_frames", "entity_id", "event_id", "argument_id", "evidence_text", "chunk_index", document=_d), f"context_outgoing{_tail}": _context("outgoing_relations", "entity_id", "relation_id", "other_name", "chunk_index", document=_d),
        f"context_incoming{_tail}": _context("incoming_relations", "entity_id", "relation_id", "other_name", "chunk_index", document=_d), f"context_candidates{_tail}": _context("relation_candidates", "entity_id", "relation_id", "evidence_text", "chunk_index", document=_d),
    }
    _at = 'c."index" AS chunk_index'
    _members = f"SELECT q.entity_id, f.claim_id AS {{}}, {_at} FROM {_who} q JOIN (SELECT claim_id, chunk_id, unnest(subjects) AS entity_id FROM claims) f ON f.entity_id = q.entity_id {_left} chunks c ON c.chunk_id = f.chunk_id {_and}"
    _seen = f"(SELECT x.span_id, x.text, c.\"index\" FROM spans x {_left} chunks c ON c.chunk_id = x.chunk_id WHERE TRUE {_span}) y"
    _ends = f"SELECT q.entity_id, r.relation_id, e.canonical_name AS other_name, {_at} FROM {_who} q JOIN relations r ON r.{{0}} = q.entity_id JOIN entities e ON e.entity_id = r.{{1}} {_left} chunks c ON c.chunk_id = r.chunk_id {_and}"
    R.sql |= {
        f"context_mentions{_tail}": f"WITH {_L} SELECT q.entity_id, mention_id, {_at} FROM {_who} q JOIN mentions m ON m.entity_id = q.entity_id JOIN chunks c ON c.chunk_id = m.chunk_id {_and}",
        f"context_spans{_tail}": f"WITH {_L} SELECT q.entity_id, r.span_id, r.role, y.\"index\" AS chunk_index FROM {_who} q JOIN refs r ON r.entity_id = q.entity_id JOIN {_seen} ON y.span_id = r.span_id",
        f"context_claims{_tail}": f"WITH {_L} " + _members.format("claim_id"), f"context_events{_tail}": f"WITH {_L} " + _members.format("event_id"),
        f"context_event_frames{_tail}": f"WITH {_L} SELECT q.entity_id, 'e' || key AS event_id, 'a' || key AS argument_id, y.text AS evidence_text, y.\"index\" AS chunk_index FROM {_who} q JOIN k ON 'p' || l_partkey = q.entity_id {_left} {_seen} ON y.span_id = 'x' || key",
        f"context_outgoing{_tail}": f"WITH {_L} " + _ends.format("source_entity_id", "target_entity_id"), f"context_incoming{_tail}": f"WITH {_L} " + _ends.format("target_entity_id", "source_entity_id"),
        f"context_candidates{_tail}": f"WITH {_L} SELECT q.entity_id, r.relation_id, y.text AS evidence_text, y.\"index\" AS chunk_index FROM {_who} q JOIN relations r ON r.source_entity_id = q.entity_id OR r.target_entity_id = q.entity_id {_left} {_seen} ON y.span_id = r.span_id",
    }


@query(f"WITH {_L} SELECT final_entity_id AS entity_id, mention_id, document_id FROM mentions JOIN hypotheses h USING (mention_id) JOIN chunks USING (chunk_id) WHERE status IN ('confirmed', 'likely') AND decision <> 'rejected'")
def canonical_mentions(spark, d):
    t = labels(spark, d)
    return context.canonical_mentions(t["chunks"], t["mentions"], t["hypotheses"]).select(F.col("bound_entity_id").alias("entity_id"), "mention_id", "document_id")


@query(f"""WITH {_LINES}, s AS (SELECT l_partkey AS entity_id, coalesce(CASE WHEN l_linenumber = 1 THEN l_returnflag END, CASE WHEN l_linenumber = 2 THEN l_linestatus END, 'none') AS state, l_orderkey * 10 + l_linenumber AS transition_id FROM lines)
SELECT DISTINCT entity_id, state FROM s""")
def entity_state_texts(spark, d):
    li = first_wins(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    n = F.col("l_linenumber")
    states = li.select(F.col("l_partkey").alias("entity_id"), F.when(n == 1, F.col("l_returnflag")).alias("state"), F.when(n == 2, F.col("l_linestatus")).alias("description"), F.lit("none").alias("canonical_name"))
    return context.state_texts(states, states.select("entity_id").distinct())


@query(f"""WITH {_LINES}, s AS (SELECT l_partkey AS entity_id, l_orderkey * 10 + l_linenumber AS transition_id FROM lines) SELECT s.entity_id, transition_id, p_name AS canonical_name, CAST(row_number() OVER (PARTITION BY s.entity_id ORDER BY transition_id) AS INTEGER) AS "at" FROM s JOIN part ON p_partkey = s.entity_id""")
def entity_states_in_order(spark, d):
    li = first_wins(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    states = li.select(F.col("l_partkey").alias("entity_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transition_id"))
    return context.entity_states(states, table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("canonical_name"))).select("entity_id", "transition_id", "canonical_name", "at")


@query(f"""WITH {_LINES}, o AS (SELECT l_suppkey, l_orderkey || '_' || l_linenumber AS event_id, 'agent' AS role, 'p' || l_partkey AS cp, CASE WHEN l_returnflag = 'R' THEN 'late' ELSE '' END AS temporal, 'x' || (l_orderkey % 5) AS span, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS i FROM lines),
x0 AS (SELECT l_suppkey, span, min(i) AS first FROM o GROUP BY ALL), x AS (SELECT l_suppkey, span, row_number() OVER (PARTITION BY l_suppkey ORDER BY first) - 1 AS i FROM x0)
SELECT 's' || s_suppkey || ':identity' AS block_id, 'identity_alias' AS block_type, 'entity: ' || s_name || ' aliases: ' || s_name || ', s' || s_suppkey AS text FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lines)
UNION ALL SELECT 's' || l_suppkey || ':event:' || event_id || ':' || i, 'event', s_name || ' role=agent predicate=ships surface=' || s_name || ' counterparts=' || cp || ' unresolved=' FROM o JOIN supplier ON s_suppkey = l_suppkey
UNION ALL SELECT 's' || s_suppkey || ':attribute:0', 'state_attribute', s_name || ' attribute/state: type=supplier' FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lines)
UNION ALL SELECT 's' || l_suppkey || ':temporal:' || i, 'temporal', s_name || ' temporal=late' FROM o JOIN supplier ON s_suppkey = l_suppkey WHERE temporal = 'late'
UNION ALL SELECT 's' || l_suppkey || ':evidence:' || i, 'evidence', s_name || ' evidence_span=' || span FROM x JOIN supplier ON s_suppkey = l_suppkey""")
def encoding_blocks(spark, d):
    li = first_wins(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    one = F.struct("l_orderkey", "l_linenumber", F.struct(F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("event_id"), F.lit("agent").alias("role"), F.lit("ships").alias("predicate"), F.lit("").alias("surface"), F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("counterparts"), F.expr("cast(array() as array<string>)").alias("unresolved"), F.when(F.col("l_returnflag") == "R", "late").otherwise("").alias("temporal"), F.array(F.concat(F.lit("x"), (F.col("l_orderkey") % 5).cast("string"))).alias("evidence")).alias("o"))
    obs = li.groupBy("l_suppkey").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["o"]).alias("observations"))
    rows = obs.join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    name = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    snapshots = rows.select(name.alias("entity_id"), F.col("s_name").alias("canonical_name"), context.alias_surfaces(F.col("s_name"), F.array(F.lit("")), F.array(name, name)).alias("aliases"), "observations", context.attributes(F.lit("supplier"), F.lit(None).cast("string"), F.expr("cast(array() as array<string>)")).alias("attributes"), F.array(F.lit("type=supplier")).alias("states"))
    return context.encoding_blocks(snapshots).drop("entity_id")


@query('SELECT o_custkey AS document_id, CAST(year(o_orderdate) AS INTEGER) AS "index", o_orderkey AS chunk_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey) = 1')
def newest_chunk(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.year("o_orderdate").alias("index"), F.col("o_orderkey").alias("chunk_id"), F.col("o_orderdate").alias("updated_at"))
    return context.newest_chunk(rows).drop("updated_at")


@query(f"WITH {_L} SELECT chunk_id FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM mentions WHERE entity_id IN (SELECT entity_id FROM asked))")
def chunks_by_entity(spark, d):
    t = labels(spark, d)
    return context.chunks_by_entity(t["chunks"], t["mentions"], asked(t)).select("chunk_id")


@query("""WITH e AS (SELECT p_partkey AS id, list_distinct(string_split(lower(p_name), ' ')) AS t FROM part), f AS (SELECT id, len(t) AS n, unnest(t) AS term FROM e), m AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS term FROM benchmark),
q AS (SELECT p_partkey AS mention_id, unnest(list_distinct(string_split(lower(p_name), ' '))) AS term FROM part WHERE p_partkey % 50 = 0),
s AS (SELECT mention_id, id AS entity_id, 1.5 * count(*) / min(n) + CASE WHEN mention_id % 10 = id % 10 THEN 0.5 ELSE 0.0 END AS score FROM q JOIN f USING (term) GROUP BY mention_id, id), r AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, entity_id) AS rank FROM s)
SELECT mention_id, entity_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def coreference_candidates(spark, d):
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 10).alias("document_id"), F.array_distinct(F.split(F.lower("p_name"), " ")).alias("terms"))
    found = context.coreference_candidates(rows.where("p_partkey % 50 = 0").withColumnRenamed("p_partkey", "mention_id"), rows.withColumnRenamed("p_partkey", "entity_id"), 5)
    return found.withColumn("score", F.round("score", 6))


@query(f"WITH {_L} SELECT 'chunks' AS label, count(DISTINCT chunk_id) AS n FROM chunks UNION ALL SELECT 'mentions', count(DISTINCT mention_id) FROM mentions UNION ALL SELECT 'entities', count(DISTINCT entity_id) FROM entities UNION ALL SELECT 'claims', count(DISTINCT claim_id) FROM claims")
def graph_totals(spark, d):
    t = labels(spark, d)
    return context.graph_totals({"chunks": (t["chunks"], "chunk_id"), "mentions": (t["mentions"], "mention_id"), "entities": (t["entities"], "entity_id"), "claims": (t["claims"], "claim_id")})


@query(f"WITH {_L} SELECT entity_id, canonical_name, count(*) AS mentions FROM entities JOIN mentions USING (entity_id) GROUP BY ALL ORDER BY count(*) DESC, canonical_name, entity_id LIMIT 20")
def top_entities(spark, d):
    """A top-k report."""
    t = labels(spark, d)
    return context.top_entities(t["entities"], t["mentions"])


@query(f"""WITH {_L}, j AS (SELECT e.entity_id, c.chunk_id, c."index", lower(m.text) AS s FROM entities e LEFT JOIN mentions m ON m.entity_id = e.entity_id LEFT JOIN chunks c ON c.chunk_id = m.chunk_id)
SELECT entity_id, md5(coalesce(string_agg(DISTINCT chunk_id, ',' ORDER BY chunk_id), '')) AS chunks, coalesce(string_agg(DISTINCT s, ',' ORDER BY s), '') AS surfaces FROM j GROUP BY entity_id""")
def graph_readback(spark, d):
    t = labels(spark, d)
    rows = context.readback(t["entities"], t["chunks"], t["mentions"])
    return rows.select("entity_id", F.md5(F.array_join(F.array_sort("chunks"), ",")).alias("chunks"), F.array_join("surfaces", ",").alias("surfaces"))


@query("""WITH p AS (SELECT item_id, text, regexp_extract(text, '[A-Za-z]{5,}', 0) AS s, item_id % 7 AS a FROM benchmark), q AS (SELECT *, instr(lower(text), lower(s)) - 1 AS first FROM p)
SELECT item_id, CAST(CASE WHEN lower(substr(text, a + 1, length(s))) = lower(s) THEN a ELSE first END AS INTEGER) AS "start", CAST(CASE WHEN lower(substr(text, a + 1, length(s))) = lower(s) THEN a ELSE first END + length(s) AS INTEGER) AS "end" FROM q WHERE s <> ''""")
def normal_spans(spark, d):
    word = F.regexp_extract("text", "[A-Za-z]{5,}", 0)
    a = (F.col("item_id") % 7).cast("int")
    rows = table(spark, d, "benchmark").withColumn("s", word).where("s <> ''")
    return rows.select("item_id", context.normal_span(F.col("text"), F.col("s"), a, a + F.length("s")).alias("x")).select("item_id", "x.start", "x.end")


_W = r"[\p{L}\p{N}_]+"
_WORD = extraction.WORD
_EXTRACT = f"""c AS (SELECT conv_id || ':' || turn AS chunk_id, CAST(conv_id AS VARCHAR) AS doc_id, text FROM conversations), w AS (SELECT chunk_id, doc_id, regexp_extract_all(text, '{_WORD}') AS w, string_split_regex(text, '{_WORD}') AS g FROM c),
u AS (SELECT chunk_id, doc_id, unnest(w) AS text, unnest(g[1:len(w)]) AS gap, generate_subscripts(w, 1) - 1 AS n FROM w),
v AS (SELECT *, sum(length(gap) + length(text)) OVER o AS b, sum(CASE WHEN regexp_matches(gap, '[.!?…\\n]') THEN 1 ELSE 0 END) OVER o AS sentence, rtrim(regexp_replace(gap, '\\s', ' ', 'g')) AS bare, lower(text) AS low FROM u WINDOW o AS (PARTITION BY chunk_id ORDER BY n)),
x AS (SELECT chunk_id, doc_id, CAST(n AS INTEGER) AS n, text, CAST(b - length(text) AS INTEGER) AS a, CAST(b AS INTEGER) AS b, sentence, regexp_matches(bare, '[.!?…]$') OR (n = 0 AND bare = '') AS opens,
  CASE WHEN low IN {extraction.PRONOUNS} THEN 'pronoun' WHEN low IN {extraction.PREDICATES} THEN 'predicate' WHEN regexp_matches(low, '^(?:the|an?) ') THEN 'descriptor' WHEN regexp_matches(text, '^\\p{{Lu}}') THEN 'named' ELSE 'plain' END AS kind, regexp_replace(low, '^(?:the|an?) ', '') AS normal FROM v),
m AS (SELECT * FROM x WHERE kind IN ('named', 'descriptor', 'pronoun')),
s AS (SELECT chunk_id, sentence, min(CASE WHEN kind = 'predicate' THEN n END) AS v, min_by(CASE WHEN kind = 'predicate' THEN text END, CASE WHEN kind = 'predicate' THEN n END) AS predicate, min(a) AS a, max(b) AS b FROM x GROUP BY ALL),
f AS (SELECT s.chunk_id, s.sentence, any_value(predicate) AS predicate, any_value(s.a) AS a, any_value(s.b) AS b, max(CASE WHEN m.n < v THEN m.n END) AS agent, min(CASE WHEN m.n > v THEN m.n END) AS patient FROM s JOIN m ON m.chunk_id = s.chunk_id AND m.sentence = s.sentence WHERE v IS NOT NULL GROUP BY s.chunk_id, s.sentence),
args AS (SELECT chunk_id, sentence, agent AS n, 'agent' AS role FROM f WHERE agent IS NOT NULL UNION ALL SELECT chunk_id, sentence, patient, 'patient' FROM f WHERE patient IS NOT NULL),
z AS (SELECT m.*, (m.chunk_id, m.n) IN (SELECT (chunk_id, n) FROM args) AS core, contains(text, ' ') AS many FROM m),
y AS (SELECT *, CASE WHEN kind <> 'named' THEN NULL WHEN opens AND NOT many AND NOT core THEN '{extraction.SENTENCE_START}' WHEN NOT many AND NOT core THEN '{extraction.NO_EVIDENCE}' END AS why, CASE WHEN kind = 'named' AND (core OR many) THEN 'entity_' || sha256(trim(low))[1:12] END AS anchor FROM (SELECT *, lower(text) AS low FROM z)),
k AS (SELECT chunk_id, count(anchor) AS anchors, max(anchor) AS one FROM y GROUP BY chunk_id),
cl AS (SELECT DISTINCT p.chunk_id, p.n, q.n AS an, q.anchor AS against FROM (SELECT args.*, y.anchor FROM args JOIN y ON y.chunk_id = args.chunk_id AND y.n = args.n) p JOIN (SELECT args.*, y.anchor FROM args JOIN y ON y.chunk_id = args.chunk_id AND y.n = args.n) q ON p.chunk_id = q.chunk_id AND p.sentence = q.sentence AND p.role <> q.role WHERE p.anchor IS NULL AND q.anchor IS NOT NULL),
own AS (SELECT y.*, anchors, EXISTS (SELECT 1 FROM cl WHERE cl.chunk_id = y.chunk_id AND cl.n = y.n) AS clashes, one FROM y JOIN k ON k.chunk_id = y.chunk_id WHERE why IS NULL),
o2 AS (SELECT *, CASE WHEN anchor IS NOT NULL THEN anchor WHEN anchors = 0 THEN NULL WHEN clashes THEN 'entity_' || sha256(doc_id || ':unknown_' || regexp_replace(trim(normal), '\\s+', '_', 'g') || '_1')[1:12] WHEN anchors = 1 THEN one END AS own FROM own),
o3 AS (SELECT *, arg_min(own, CASE WHEN own IS NOT NULL THEN n END) OVER (PARTITION BY chunk_id, normal ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same FROM o2),
h AS (SELECT chunk_id, n, 'rejected' AS status, 'drop' AS decision, CAST(NULL AS VARCHAR) AS entity_id, why AS reason FROM y WHERE why IS NOT NULL
 UNION ALL SELECT chunk_id, n, 'confirmed', 'create_entity', anchor, '{extraction.ANCHORED}' FROM y WHERE anchor IS NOT NULL
 UNION ALL SELECT chunk_id, n, CASE WHEN anchors = 0 THEN 'unresolved' WHEN same IS NOT NULL OR own IS NOT NULL THEN 'likely' ELSE 'unresolved' END, CASE WHEN anchors = 0 THEN 'keep_as_mention_only' WHEN same IS NOT NULL THEN 'link_to_existing' WHEN clashes THEN 'create_entity' WHEN own IS NOT NULL THEN 'link_to_existing' ELSE 'keep_as_mention_only' END,
  CASE WHEN anchors > 0 THEN coalesce(same, own) END, CASE WHEN anchors = 0 THEN '{extraction.NO_ANCHOR}' WHEN same IS NOT NULL THEN '{extraction.SAME_SURFACE}' WHEN clashes THEN '{extraction.DISTINCT}' WHEN own IS NOT NULL THEN '{extraction.SINGLE}' ELSE '{extraction.AMBIGUOUS}' END FROM o3 WHERE anchor IS NULL
 UNION ALL SELECT cl.chunk_id, cl.n, 'rejected', 'keep_as_mention_only', against, '{extraction.CONFLICT}' FROM cl JOIN o3 ON o3.chunk_id = cl.chunk_id AND o3.n = cl.n WHERE same IS NULL),
ent AS (SELECT chunk_id, n, entity_id FROM h WHERE decision IN ('create_entity', 'link_to_existing'))"""


def _turns(spark, d):
    return table(spark, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), F.col("conv_id").alias("doc_id"), "text")


@query(f'WITH {_EXTRACT} SELECT chunk_id, n, text, a AS "start", b AS "end", kind, normal FROM m')
def extraction_mentions(spark, d):
    return extraction.extract(_turns(spark, d), ("mentions",))["mentions"].select("chunk_id", "n", "text", "start", "end", "kind", "normal")


@query(f"""WITH {_EXTRACT}, r AS (SELECT f.chunk_id, f.predicate, f.a, f.b, (f.agent IS NOT NULL)::INT + (f.patient IS NOT NULL)::INT AS wanted, (e1.entity_id IS NOT NULL)::INT + (e2.entity_id IS NOT NULL)::INT AS got FROM f LEFT JOIN ent e1 ON e1.chunk_id = f.chunk_id AND e1.n = f.agent LEFT JOIN ent e2 ON e2.chunk_id = f.chunk_id AND e2.n = f.patient)
SELECT chunk_id, predicate, a AS "start", b AS "end", CASE WHEN got >= wanted THEN 'complete' WHEN got = 0 THEN 'unresolved' ELSE 'partial' END AS resolution, CASE WHEN got >= wanted THEN 'valid' ELSE 'degraded' END AS materialization FROM r""")
def event_frames(spark, d):
    return extraction.extract(_turns(spark, d))["events"].select("chunk_id", "predicate", "start", "end", "resolution", "materialization")


@query(f"WITH {_EXTRACT} SELECT chunk_id, n, status, decision, entity_id, reason FROM h")
def resolution_cascade(spark, d):
    return extraction.extract(_turns(spark, d), ("hypotheses",))["hypotheses"].select("chunk_id", "n", "status", "decision", "entity_id", "reason")


@query(f"WITH {_EXTRACT} SELECT f.chunk_id, e1.entity_id AS source_entity_id, e2.entity_id AS target_entity_id, f.predicate FROM f JOIN ent e1 ON e1.chunk_id = f.chunk_id AND e1.n = f.agent JOIN ent e2 ON e2.chunk_id = f.chunk_id AND e2.n = f.patient WHERE e1.entity_id <> e2.entity_id")
def agent_patient_relations(spark, d):
    return extraction.extract(_turns(spark, d))["relations"].select("chunk_id", "source_entity_id", "target_entity_id", "predicate")


@query(f"WITH {_EXTRACT}, p AS (SELECT m.chunk_id, m.n, m.text, CASE WHEN n % 3 = 0 THEN a + 1 ELSE a END AS a, CASE WHEN n % 3 = 0 THEN b + 1 ELSE b END AS b, c.text AS t FROM m JOIN c USING (chunk_id)) SELECT chunk_id, n FROM p WHERE b > length(t) OR trim(substr(t, a + 1, b - a)) <> trim(text)")
def mention_span_contract(spark, d):
    """Of spans that were moved (every third) the ones that no longer hold their text."""
    chunks = _turns(spark, d)
    moved = F.when(F.col("n") % 3 == 0, 1).otherwise(0)
    mentions = extraction.extract(chunks, ("mentions",))["mentions"].withColumns({"start": F.col("start") + moved, "end": F.col("end") + moved})
    return extraction.invalid_spans(mentions, chunks).select("chunk_id", "n")


@query(f"WITH {_LINES}, k AS (SELECT 'o' || l_orderkey AS c, l_orderkey || '_' || l_linenumber AS i, ['p' || l_partkey, 's' || l_suppkey, 'p' || l_partkey] AS s FROM lines), f AS (SELECT c, i, unnest(list_distinct(s)) AS e FROM k) SELECT 'relcand_' || sha256(a.c || ':' || a.e || ':' || b.e || ':' || a.i)[1:12] AS relation_candidate_id, a.e AS source_entity_id, b.e AS target_entity_id FROM f a JOIN f b ON a.i = b.i AND a.e <> b.e")
def claim_pair_candidates(spark, d):
    li = first_wins(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = li.select(s("o", "l_orderkey").alias("chunk_id"), F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("claim_id"), F.lit("").alias("text"), F.lit(0.5).alias("confidence"), F.array(s("p", "l_partkey"), s("s", "l_suppkey"), s("p", "l_partkey")).alias("subjects"))
    return extraction.claim_pairs(rows).select("relation_candidate_id", "source_entity_id", "target_entity_id")


@query(f"""WITH {_EXTRACT}, q AS (SELECT m.chunk_id, CASE WHEN n % 2 = 0 THEN a ELSE a + 3 END AS a, b, lower(m.text) AS up, m.text, n, c.text AS t FROM m JOIN c USING (chunk_id)), p AS (SELECT chunk_id, t, CASE WHEN n % 2 = 0 THEN text ELSE up END AS said, a, b FROM q),
r AS (SELECT chunk_id, t, said, a >= 0 AND b <= length(t) AND substr(t, a + 1, b - a) = said AS held, a, b FROM p), g AS (SELECT chunk_id, CAST(CASE WHEN held THEN a ELSE instr(lower(t), lower(said)) - 1 END AS INTEGER) AS "start", CASE WHEN held THEN b - a ELSE length(said) END AS size, held, t FROM r)
SELECT DISTINCT chunk_id, "start", CAST("start" + size AS INTEGER) AS "end", substr(t, "start" + 1, size) AS text FROM g WHERE "start" >= 0""")
def repaired_mentions(spark, d):
    """Mentions as a model might name them, half with a wrong span and in small letters."""
    chunks = _turns(spark, d)
    odd = F.col("n") % 2 == 1
    said = extraction.extract(chunks, ("mentions",))["mentions"].select("chunk_id", F.when(odd, F.lower("text")).otherwise(F.col("text")).alias("text"), (F.col("start") + F.when(odd, 3).otherwise(0)).alias("start"), "end", F.lit(None).cast("string").alias("kind"))
    return extraction.repaired_mentions(said, chunks).select("chunk_id", "start", "end", "text")
