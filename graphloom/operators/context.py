"""The context of entities: what the label tables hold about each of a set of entities, wholly or within a document.

Each pattern takes a DataFrame of the entities that are asked for (entity_id), so that many are answered by one join; the
optional document becomes a filter on the side that holds it, never a disjunction with null.  Label tables:

* chunks (chunk_id, document_id, index), entities (entity_id, canonical_name, entity_type, aliases, description)
* mentions (mention_id, chunk_id, entity_id, text, reference_type, start_char, end_char)
* hypotheses (mention_id, status, kind, decision, confidence, final_entity_id)
* spans (span_id, document_id, chunk_id, start_char, text), span_refs (span_id, entity_id, role, confidence)
* claims (claim_id, chunk_id, subjects, ...), events (event_id, chunk_id, participants, ...)
* frames (event_id, span_id, predicate, ...), arguments (argument_id, event_id, entity_id, role)
* relations (relation_id, source_entity_id, target_entity_id, chunk_id), candidates (the same with span_id)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
CANONICAL = ("confirmed", "likely")
TOP_ENTITIES = 20


def numbered(rows: DataFrame, part: list[str], order: list) -> DataFrame:
    """``at``: the place of a row in its part."""
    return rows.withColumn("at", F.row_number().over(Window.partitionBy(*part).orderBy(*order)).cast("int"))


def _of(chunks: DataFrame, document) -> DataFrame:
    return chunks if document is None else chunks.where(F.col("document_id") == document)


def _placed(rows: DataFrame, chunks: DataFrame, document) -> DataFrame:
    """Rows with chunk_index; all rows, or those whose chunk is of the document."""
    where = _of(chunks, document).select("chunk_id", F.col("index").alias("chunk_index"))
    return rows.join(where, "chunk_id", "left" if document is None else "inner")


def _evidenced(rows: DataFrame, spans: DataFrame, chunks: DataFrame, document) -> DataFrame:
    """Rows of span_id with the span's text and its chunk's index; a document asks for its own spans that have a chunk."""
    own = spans if document is None else spans.where(F.col("document_id") == document)
    own = _placed_any(own.select("span_id", "chunk_id", F.col("text").alias("evidence_text"), F.col("start_char").alias("evidence_start")), chunks, document)
    return rows.join(own, "span_id", "left" if document is None else "inner")


def _placed_any(rows: DataFrame, chunks: DataFrame, document) -> DataFrame:
    """Like ``_placed``, for rows whose own document was looked at before."""
    return rows.join(chunks.select("chunk_id", F.col("index").alias("chunk_index")), "chunk_id", "left" if document is None else "inner")


def document_chunks(chunks: DataFrame, document=None) -> DataFrame:
    return numbered(_of(chunks, document), ["document_id"], ["index", "chunk_id"])


def raw_mentions(chunks: DataFrame, mentions: DataFrame, document=None) -> DataFrame:
    """Mentions of documents in order of chunk and place."""
    rows = mentions.join(_of(chunks, document).select("chunk_id", "document_id", "index"), "chunk_id")
    return numbered(rows, ["document_id"], ["index", "start_char", "mention_id"])


def resolution_audit(chunks: DataFrame, mentions: DataFrame, hypotheses: DataFrame, document=None) -> DataFrame:
    """Hypotheses of a document's mentions: by chunk and place, the surest first; the mention's kind where they have none."""
    rows = mentions.withColumnRenamed("kind", "_kind").join(_of(chunks, document).select("chunk_id", "document_id", "index"), "chunk_id").join(hypotheses, "mention_id")
    rows = rows.withColumn("mention_kind", F.coalesce("kind", "_kind"))
    return numbered(rows, ["document_id"], ["index", "start_char", F.desc("confidence"), "mention_id"])


def entity_states(states: DataFrame, entities: DataFrame) -> DataFrame:
    """States of entities in order of their transitions."""
    return numbered(states.join(entities.select("entity_id", "canonical_name"), "entity_id"), ["entity_id"], ["transition_id"])


def claims_by_chunk(asked: DataFrame, mentions: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims supported by a chunk that mentions the entity, once for each mention."""
    return asked.join(mentions.select("entity_id", "chunk_id", "mention_id"), "entity_id").join(claims, "chunk_id")


def context_mentions(asked: DataFrame, mentions: DataFrame, chunks: DataFrame, document=None) -> DataFrame:
    where = _of(chunks, document).select("chunk_id", F.col("index").alias("chunk_index"))
    return asked.join(mentions, "entity_id").join(where, "chunk_id")


def context_spans(asked: DataFrame, refs: DataFrame, spans: DataFrame, chunks: DataFrame, document=None) -> DataFrame:
    own = spans if document is None else spans.where(F.col("document_id") == document)
    return _placed_any(asked.join(refs, "entity_id").join(own, "span_id"), chunks, document)


def context_members(asked: DataFrame, rows: DataFrame, members: str, chunks: DataFrame, document=None) -> DataFrame:
    """Claims or events that list the entity among their ``members``."""
    flat = rows.withColumn("entity_id", F.explode(F.array_distinct(members))).drop(members)
    return _placed(asked.join(flat, "entity_id"), chunks, document)


def context_frames(asked: DataFrame, arguments: DataFrame, frames: DataFrame, spans: DataFrame, chunks: DataFrame, document=None) -> DataFrame:
    return _evidenced(asked.join(arguments, "entity_id").join(frames, "event_id"), spans, chunks, document)


def context_relations(asked: DataFrame, relations: DataFrame, entities: DataFrame, chunks: DataFrame, outgoing: bool, document=None) -> DataFrame:
    """Relations from (or to) the entity with the other end's name."""
    own, other = ("source_entity_id", "target_entity_id") if outgoing else ("target_entity_id", "source_entity_id")
    rows = relations.withColumnRenamed(own, "entity_id").withColumnRenamed(other, "other_id").join(asked, "entity_id")
    return _placed(rows.join(entities.select(F.col("entity_id").alias("other_id"), F.col("canonical_name").alias("other_name")), "other_id"), chunks, document)


def context_candidates(asked: DataFrame, candidates: DataFrame, spans: DataFrame, chunks: DataFrame, document=None) -> DataFrame:
    """Relation candidates at either end of which the entity stands: two equi-joins, a loop counted once."""
    source = candidates.withColumn("entity_id", F.col("source_entity_id"))
    target = candidates.where("source_entity_id <> target_entity_id").withColumn("entity_id", F.col("target_entity_id"))
    return _evidenced(source.unionByName(target).join(asked, "entity_id"), spans, chunks, document)


def entity_context(asked: DataFrame, labels: dict[str, DataFrame], document=None) -> dict[str, DataFrame]:
    """All sub-queries of the context of the entities asked for."""
    t, c = labels, labels["chunks"]
    return {
        "entity": asked.join(t["entities"], "entity_id"), "mentions": context_mentions(asked, t["mentions"], c, document), "evidence_spans": context_spans(asked, t["span_refs"], t["spans"], c, document),
        "claims": context_members(asked, t["claims"], "subjects", c, document), "events": context_members(asked, t["events"], "participants", c, document),
        "event_frames": context_frames(asked, t["arguments"], t["frames"], t["spans"], c, document), "outgoing_relations": context_relations(asked, t["relations"], t["entities"], c, True, document),
        "incoming_relations": context_relations(asked, t["relations"], t["entities"], c, False, document), "relation_candidates": context_candidates(asked, t["candidates"], t["spans"], c, document),
    }


def canonical_mentions(chunks: DataFrame, mentions: DataFrame, hypotheses: DataFrame, document=None) -> DataFrame:
    """Mentions that a hypothesis binds to an entity for good, by entity."""
    sure = hypotheses.where(F.coalesce("status", F.lit("")).isin(*CANONICAL) & (F.coalesce("decision", F.lit("")) != "rejected")).select("mention_id", F.col("final_entity_id").alias("bound_entity_id"))
    return mentions.join(sure, "mention_id").join(_of(chunks, document).select("chunk_id", "document_id", "index"), "chunk_id")


def state_texts(states: DataFrame, asked: DataFrame) -> DataFrame:
    """Distinct texts of the states of entities: the state, else its description, else its name."""
    return asked.join(states, "entity_id").select("entity_id", F.coalesce("state", "description", "canonical_name").alias("state")).distinct()


def first_seen(values: Column) -> Column:
    """Distinct values in order, without nulls and empty ones."""
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))


def attributes(kind: Column, description: Column, states: Column) -> Column:
    return first_seen(F.concat(F.array(F.concat(F.lit("type="), F.nullif(kind, F.lit(""))), description), states))


def alias_surfaces(name: Column, aliases: Column, mentioned: Column) -> Column:
    return first_seen(F.concat(F.array(name), F.coalesce(aliases, F.expr("cast(array() as array<string>)")), mentioned))


def encoding_blocks(snapshots: DataFrame) -> DataFrame:
    """block_id, block_type, text of what an encoder reads about an entity.

    ``snapshots``: entity_id, canonical_name, aliases, observations (event_id, role, predicate, surface, counterparts,
    unresolved, temporal, evidence), attributes, states.
    """
    e, name, obs = F.col("entity_id"), F.col("canonical_name"), F.col("observations")
    block = lambda kind, label, i, text: F.struct(F.concat(e, F.lit(f":{label}"), *([F.lit(":"), i] if i is not None else [])).alias("block_id"), F.lit(kind).alias("block_type"), text.alias("text"))
    aliases = F.when(F.size("aliases") > 0, F.concat(F.lit(" aliases: "), F.array_join("aliases", ", "))).otherwise("")
    identity = F.array(block("identity_alias", "identity", None, F.concat(F.lit("entity: "), name, aliases)))
    event = lambda o, i: block(
        "event", "event", F.concat(o["event_id"], F.lit(":"), i.cast("string")),
        F.concat(name, F.lit(" role="), o["role"], F.lit(" predicate="), o["predicate"], F.lit(" surface="), F.coalesce(F.nullif(o["surface"], F.lit("")), name), F.lit(" counterparts="), F.array_join(o["counterparts"], ","), F.lit(" unresolved="), F.array_join(o["unresolved"], ",")),
    )
    state = lambda v, i: block("state_attribute", "attribute", i.cast("string"), F.concat(name, F.lit(" attribute/state: "), v))
    when = lambda o, i: F.when(F.coalesce(o["temporal"], F.lit("")) != "", block("temporal", "temporal", i.cast("string"), F.concat(name, F.lit(" temporal="), o["temporal"])))
    shown = lambda s, i: block("evidence", "evidence", i.cast("string"), F.concat(name, F.lit(" evidence_span="), s))
    spans = first_seen(F.flatten(F.transform(obs, lambda o: o["evidence"])))
    every = F.concat(identity, F.transform(obs, event), F.transform(first_seen(F.concat("attributes", "states")), state), F.array_compact(F.transform(obs, when)), F.transform(spans, shown))
    return snapshots.select("entity_id", F.inline(every))


def newest_chunk(chunks: DataFrame) -> DataFrame:
    """Per document and index the chunk written last."""
    last = Window.partitionBy("document_id", "index").orderBy(F.desc("updated_at"), "chunk_id")
    return chunks.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def chunks_by_entity(chunks: DataFrame, mentions: DataFrame, asked: DataFrame) -> DataFrame:
    """Chunks that mention one of the entities."""
    return chunks.join(mentions.join(asked, "entity_id", "left_semi").select("chunk_id"), "chunk_id", "left_semi")


def coreference_candidates(mentions: DataFrame, entities: DataFrame, k: int, name_share: float = 1.5, same_document: float = 0.5) -> DataFrame:
    """Per mention (mention_id, document_id, terms) the k best entities (entity_id, document_id, terms) that share a term.

    The score adds ``name_share`` times the share of the entity's terms and ``same_document``; ties go to the smaller id.
    """
    # entities of one document and set of terms score alike: those after the first k can't be among the best
    entities = entities.withColumn("_r", F.row_number().over(Window.partitionBy("document_id", F.array_sort("terms")).orderBy("entity_id"))).where(F.col("_r") <= k)
    left = mentions.select("mention_id", F.col("document_id").alias("_d"), F.explode("terms").alias("term"))
    right = entities.select("entity_id", F.col("document_id").alias("_e"), F.size("terms").alias("_n"), F.explode("terms").alias("term"))
    hits = left.join(right, "term").groupBy("mention_id", "entity_id").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"), F.first(F.col("_d") == F.col("_e")).alias("_same"))
    scored = hits.withColumn("score", F.lit(name_share) * F.col("_c") / F.col("_n") + F.when(F.col("_same"), F.lit(same_document)).otherwise(F.lit(0.0)))
    best = Window.partitionBy("mention_id").orderBy(F.desc("score"), "entity_id")
    return scored.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("mention_id", "entity_id", "score", "rank")


def graph_totals(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per label table the number of distinct keys."""
    out = None
    for name, (rows, key) in tables.items():
        one = rows.agg(F.count_distinct(key).alias("n")).select(F.lit(name).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def top_entities(entities: DataFrame, mentions: DataFrame, k: int = TOP_ENTITIES) -> DataFrame:
    """The most mentioned entities, then by name."""
    n = mentions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("mentions"))
    return entities.join(n, "entity_id").orderBy(F.desc("mentions"), "canonical_name", "entity_id").limit(k).select("entity_id", "canonical_name", "mentions")


def readback(entities: DataFrame, chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """Per entity: its chunks in order and the distinct surfaces, letter case aside, by which they name it."""
    rows = entities.select("entity_id").join(mentions.select("entity_id", "chunk_id", F.lower("text").alias("surface")), "entity_id", "left").join(chunks.select("chunk_id", "index"), "chunk_id", "left")
    return rows.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_set(F.when(F.col("index").isNotNull(), F.struct("index", "chunk_id")))), lambda x: x["chunk_id"]).alias("chunks"), F.array_sort(F.collect_set("surface")).alias("surfaces"))


def evidence_span(chunk: Column, start: Column, end: Column, length: Column) -> tuple[Column, Column]:
    """Id and end of a chunk's evidence span; without an end it reaches as far as its text."""
    until = F.coalesce(end, start + length)
    return F.concat_ws(":", chunk, start.cast("string"), until.cast("string")), until


def normal_span(text: Column, surface: Column, start: Column, end: Column) -> Column:
    """A span within the text: the given one, clamped, if it holds the surface, else its first place, letter case aside, else null."""
    a, b = F.greatest(F.lit(0), start), F.least(F.length(text), end)
    holds = (a < b) & (F.lower(F.substring(text, a + 1, b - a)) == F.lower(surface))
    first = F.instr(F.lower(text), F.lower(surface)) - 1
    found = F.when((first >= 0) & (surface != ""), F.struct(first.cast("int").alias("start"), (first + F.length(surface)).cast("int").alias("end")))
    return F.when(holds, F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))).otherwise(found)
