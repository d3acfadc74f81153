"""Gated resolution of mentions that line items stand for: twenty orders are a document, an order is a chunk."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import resolution
from graphloom.operators.lineage import written
from graphloom.plans.context_queries import _LINES
from graphloom.plans.tables import Registry, table

R = Registry()
query = R.query

_KINDS = [("named", "named_anchor"), ("named", "named_anchor"), ("descriptor", "descriptive_alias"), ("pronoun", "pronoun"), ("nominal", "generic_nominal"), ("alias", "role_anchor")]
_MENTIONS = f"""{_LINES}, li AS (SELECT l_orderkey // 20 AS doc, CAST(l_orderkey % 20 AS INTEGER) AS idx, l_orderkey, l_linenumber, l_orderkey || ':' || l_linenumber AS m, chr(CAST(65 + l_suppkey % 13 AS INTEGER)) AS s, l_partkey AS p, l_suppkey, l_quantity FROM lines),
ent AS (SELECT DISTINCT doc, 'E' || doc || s AS e, 'Name' || s AS name, CASE WHEN s = 'C' THEN ['the old keeper C', 'he'] ELSE ['the old keeper ' || s] END AS aliases FROM li WHERE l_linenumber = 1),
obs AS (SELECT DISTINCT doc, 'E' || doc || s AS e, idx FROM li WHERE l_linenumber = 1),
men AS (SELECT doc, idx, l_orderkey, l_linenumber, m, CASE p % 6 WHEN 0 THEN 'Name' || s WHEN 1 THEN 'Fresh' || chr(CAST(65 + p // 6 % 20 AS INTEGER)) WHEN 2 THEN 'the old keeper ' || s WHEN 3 THEN 'he' WHEN 4 THEN 'Keeper' ELSE 'An  old Name' || s END AS t, CAST(p % 6 AS INTEGER) AS c, CAST(p // 6 % 5 AS INTEGER) AS x, round(0.5::DOUBLE + CAST(l_quantity AS BIGINT) % 5 / 10.0::DOUBLE, 2) AS conf, CAST((p // 30 + l_linenumber) % 6 AS INTEGER) AS y, round(0.45::DOUBLE + l_suppkey % 6 / 10.0::DOUBLE, 2) AS pc FROM li WHERE l_linenumber > 1),
chunk_texts AS (SELECT doc, idx, string_agg(t, ' ' ORDER BY l_linenumber) AS txt FROM men GROUP BY doc, idx)"""
_SURFACE = r"trim(regexp_replace(regexp_replace(lower(trim({})), '^(the )?(a )?(an )?', ''), '\s+', ' ', 'g'))"
_GUARD = resolution.GUARDS


def _tables(spark, d):
    li = table(spark, d, "lineitem")
    first = F.row_number().over(_first())
    li = li.withColumn("_r", first).where("_r = 1")
    letter = lambda c: F.char(F.lit(65) + c)
    li = li.select(
        F.expr("l_orderkey div 20").alias("document_id"), (F.col("l_orderkey") % 20).cast("int").alias("index"), "l_orderkey", "l_linenumber", F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("mention_id"), letter(F.col("l_suppkey") % 13).alias("s"),
        (F.col("l_partkey") % 6).cast("int").alias("c"), F.expr("cast(l_partkey div 6 % 5 as int)").alias("x"), letter(F.expr("l_partkey div 6 % 20")).alias("f"), F.expr("cast((l_partkey div 30 + l_linenumber) % 6 as int)").alias("y"), F.round(0.5 + F.col("l_quantity").cast("long") % 5 / 10.0, 2).alias("confidence"), F.round(0.45 + F.col("l_suppkey") % 6 / 10.0, 2).alias("pc"),
    )
    li = written(li, "mention-lines")
    name = F.concat(F.lit("E"), F.col("document_id").cast("string"), "s")
    told = F.concat(F.lit("the old keeper "), "s")
    one = li.where("l_linenumber = 1")
    entities = one.select("document_id", name.alias("entity_id"), F.concat(F.lit("Name"), "s").alias("canonical_name"), F.lit("person").alias("entity_type"), F.when(F.col("s") == "C", F.array(told, F.lit("he"))).otherwise(F.array(told)).alias("aliases")).distinct()
    observations = one.select(name.alias("entity_id"), "document_id", "index").distinct()
    text = F.when(F.col("c") == 0, F.concat(F.lit("Name"), "s")).when(F.col("c") == 1, F.concat(F.lit("Fresh"), "f")).when(F.col("c") == 2, told).when(F.col("c") == 3, "he").when(F.col("c") == 4, "Keeper").otherwise(F.concat(F.lit("An  old Name"), "s"))
    pick = lambda i: F.element_at(F.array(*(F.lit(k[i]) for k in _KINDS)), F.col("c") + 1)
    asks = F.array(F.when(F.col("x") < 3, resolution.ENTITY).when(F.col("x") == 3, resolution.CONCEPT).otherwise(resolution.MENTION_ONLY))
    mentions = li.where("l_linenumber > 1").select("document_id", F.col("l_orderkey").alias("chunk_id"), "index", "mention_id", text.alias("text"), pick(0).alias("type"), pick(1).alias("kind"), "confidence", asks.alias("expectations"), "l_linenumber", "y", "pc")
    chunks = mentions.groupBy("document_id", "index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "text"))), lambda x: x["text"]), " ").alias("text"))

    def propose(open_, found):
        """Links to the first or the last candidate or to nobody's, new entities, bare mentions, and silence."""
        ends = found.groupBy("mention_id").agg(F.min_by("entity_id", "rank").alias("best"), F.max_by("entity_id", "rank").alias("worst"))
        rows = open_.join(ends, "mention_id", "left")
        y = F.col("y")
        what = F.when(y == 3, "propose_new").when(y == 4, "mention_only").when((y != 2) & F.col("best").isNull(), "keep_unresolved").otherwise("link_existing")
        rows = rows.select("mention_id", what.alias("decision"), F.when(y < 2, F.col("best")).when(y == 2, "E-1A").when(y == 5, F.col("worst")).alias("entity_id"), F.col("pc").alias("confidence"), F.concat(F.lit("said "), y.cast("string")).alias("reason"), (F.col("l_linenumber") == 7).alias("silent"))
        return rows.where("NOT silent")

    return mentions, entities, observations, chunks, propose


def _first():
    return Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


_RESOLVED = f"""{_MENTIONS},
nn AS (SELECT *, {_SURFACE.format("t")} AS n, c = 3 AS pro, x < 3 OR c = 3 AS asks, c >= 2 AS vague FROM men),
stored AS (SELECT doc, e, name, aliases, -1 AS since, list_transform(list_prepend(name, aliases), lambda a: {_SURFACE.format("a")}) AS names FROM ent),
free AS (SELECT * FROM nn WHERE NOT (asks AND vague) AND x < 3),
made AS (SELECT doc, 'entity_' || sha256(doc || ':' || n)[1:12] AS e, arg_min(t, (idx, m)) AS name, CAST([] AS VARCHAR[]) AS aliases, min(idx) AS since, [n] AS names FROM free f WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.doc = f.doc AND list_contains(s.names, f.n)) GROUP BY doc, n),
known AS (SELECT * FROM stored UNION ALL SELECT * FROM made),
g AS (SELECT *, (asks AND vague) OR (asks AND EXISTS (SELECT 1 FROM known k WHERE k.doc = nn.doc AND list_contains(k.names, nn.n) AND k.since < nn.idx)) AS gated FROM nn),
o AS (SELECT g.*, coalesce(lower((SELECT string_agg(txt, ' ' ORDER BY idx) FROM chunk_texts ct WHERE ct.doc = g.doc AND ct.idx IN (g.idx - 1, g.idx - 2))), '') AS before FROM g WHERE gated AND x <> 3),
p AS (SELECT o.m, k.e, k.name, list_contains(k.names, o.n) AS same, len(list_filter(k.names, lambda a: contains(a, o.n) OR contains(o.n, a))) > 0 AS part, (k.since >= 0 AND k.since IN (o.idx - 1, o.idx - 2)) OR EXISTS (SELECT 1 FROM obs WHERE obs.doc = o.doc AND obs.e = k.e AND obs.idx IN (o.idx - 1, o.idx - 2)) AS seen, o.pro, o.pro AND len(list_filter(k.names[2:], lambda a: a NOT IN ('he', 'him', 'his', 'she', 'her', 'they', 'them', 'their') AND contains(o.before, a))) > 0 AS bridge FROM o JOIN known k ON k.doc = o.doc AND k.since < o.idx),
r AS (SELECT *, round(CASE WHEN same THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN part THEN 0.6::DOUBLE ELSE 0 END + CASE WHEN seen THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN pro THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN bridge THEN 1.2::DOUBLE ELSE 0 END, 3) AS score FROM p WHERE same OR part OR seen OR pro),
cand AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY score DESC, lower(name), e) AS rank FROM r QUALIFY rank <= 5)"""


@query(f"WITH {_RESOLVED} SELECT m AS mention_id, e AS entity_id, CAST(rank AS INTEGER) AS rank, score, array_to_string(list_sort(list_filter([CASE WHEN same THEN '{resolution.SURFACE}' END, CASE WHEN part THEN '{resolution.PARTIAL}' END, CASE WHEN seen THEN '{resolution.SEEN}' END, CASE WHEN pro THEN '{resolution.ACTIVE}' END, CASE WHEN bridge THEN '{resolution.BRIDGE}' END], lambda z: z IS NOT NULL)), ',') AS reasons FROM cand")
def mention_candidates(spark, d):
    """The candidates alone, with every ambiguous mention's reasons."""
    mentions, entities, observations, chunks, _ = _tables(spark, d)
    rows = resolution.prepared(mentions)
    names = written(resolution.known_names(rows, entities), "resolve-names")
    gated = written(resolution.gated(rows, names).where("gated").where(~F.array_contains("expectations", resolution.CONCEPT)), "resolve-mentions")
    out = resolution.candidates(gated, names, observations, chunks)
    return out.select("mention_id", "entity_id", "rank", "score", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {_RESOLVED}, l AS (SELECT m, list(e ORDER BY rank) AS cs FROM cand GROUP BY m),
q AS (SELECT o.*, coalesce(cs, []) AS cs, CASE WHEN l_linenumber = 7 THEN NULL WHEN y < 2 THEN cs[1] WHEN y = 2 THEN 'E-1A' WHEN y = 5 THEN cs[-1] END AS target, CASE WHEN l_linenumber = 7 THEN 'keep_unresolved' WHEN y = 3 THEN 'propose_new' WHEN y = 4 THEN 'mention_only' WHEN y <> 2 AND cs IS NULL THEN 'keep_unresolved' ELSE 'link_existing' END AS dec, CASE WHEN l_linenumber = 7 THEN 0 ELSE pc END AS c0, CASE WHEN l_linenumber = 7 THEN '' ELSE 'said ' || y END AS said FROM o LEFT JOIN l USING (m)),
w AS (SELECT q.*, c.name AS cname, c.e AS hit, CASE WHEN q.pro AND dec = 'propose_new' THEN 'pronoun' WHEN dec = 'link_existing' AND c.e IS NULL THEN 'outside' WHEN dec = 'link_existing' AND NOT q.pro AND NOT (c.same OR c.part) THEN 'lexical' WHEN dec = 'link_existing' AND q.pro AND len(cs) > 1 AND (NOT (c.bridge OR c.same) OR c.score < 1.5) THEN 'rivals' END AS guard FROM q LEFT JOIN cand c ON c.m = q.m AND c.e = q.target),
z AS (SELECT *, CASE WHEN guard = 'lexical' THEN 'propose_new' WHEN guard IS NOT NULL THEN 'keep_unresolved' ELSE dec END AS d2, CASE WHEN guard IN ('pronoun', 'outside') THEN least(c0, 0.49::DOUBLE) WHEN guard = 'lexical' THEN least(c0, 0.79::DOUBLE) ELSE c0 END AS c2, CASE guard WHEN 'pronoun' THEN '{_GUARD["pronoun"]}' WHEN 'outside' THEN '{_GUARD["outside"]}' WHEN 'lexical' THEN '{_GUARD["lexical"]}' WHEN 'rivals' THEN '{_GUARD["rivals"]}' ELSE '' END || said AS why FROM w)
SELECT m AS mention_id, t AS surface_text, CASE WHEN x = 3 THEN 'concept_allowed' WHEN x = 4 THEN 'mention_only_allowed' ELSE 'create_entity' END AS decision, CASE WHEN x < 3 THEN 'entity_' || sha256(doc || ':' || n)[1:12] END AS entity_id, CASE WHEN x < 3 THEN t END AS canonical_name, CASE WHEN x < 3 THEN CASE WHEN c < 2 THEN 'person' ELSE 'unknown' END END AS entity_type, NULL AS alias_to_add, conf AS confidence, 'confirmed' AS status, '' AS candidates,
CASE WHEN gated THEN '{resolution.REASONS["concept"]}' WHEN x = 3 THEN '{resolution.REASONS[resolution.CONCEPT]}' WHEN x = 4 THEN '{resolution.REASONS[resolution.MENTION_ONLY]}' ELSE '{resolution.REASONS["anchor"]}' END AS reason, NULL AS guard, gated FROM g WHERE NOT gated OR x = 3
UNION ALL SELECT m, t, CASE d2 WHEN 'link_existing' THEN 'link_to_existing' WHEN 'propose_new' THEN 'create_entity' WHEN 'mention_only' THEN 'mention_only_allowed' ELSE 'unresolved' END, CASE d2 WHEN 'link_existing' THEN hit WHEN 'propose_new' THEN 'entity_' || sha256(doc || ':' || n)[1:12] END, CASE d2 WHEN 'link_existing' THEN cname WHEN 'propose_new' THEN t END,
CASE d2 WHEN 'link_existing' THEN 'person' WHEN 'propose_new' THEN CASE WHEN pro THEN 'unknown' ELSE 'person' END END, CASE WHEN d2 = 'link_existing' AND n <> {_SURFACE.format("cname")} THEN t END, c2, CASE WHEN d2 IN ('link_existing', 'propose_new') THEN CASE WHEN c2 >= 0.8 THEN 'confirmed' ELSE 'likely' END WHEN d2 = 'mention_only' THEN CASE WHEN c2 >= 0.8 THEN 'confirmed' ELSE 'possible' END ELSE 'unresolved' END, array_to_string(cs, ','), why, guard, true FROM z""")
def gated_resolution(spark, d):
    """Every mention's decision: by rule, or proposed and guarded; each guard is hit."""
    out = resolution.resolve(*_tables(spark, d))
    return out.drop("document_id").withColumn("candidates", F.array_join("candidates", ","))
