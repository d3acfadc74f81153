"""From a model's drafts and the resolution of their mentions to label tables, for all chunks at once.

Assembly.  A draft names mentions, and events with arguments, each with a span that may be off.  Spans are moved to
where their surface stands; mentions of one span and surface are one, the first said wins.  An argument takes the
mention its reference names; a reference nobody defined is defined by the first argument that uses it; an argument
without one makes, or finds, the mention at its own span.  All of that is decided by windows over the order of saying.

Patch.  Decisions become hypotheses, resolved mentions, entities with their aliases and observations in order, and
events that are complete or partial.  Aliases are closed: entities of a document that share a name, by way of any
number of others, are one group, found as connected components over entities and surfaces.

A span whose surface its chunk lacks, a decision on an unknown mention, and an argument without a mention (unless it may
be a concept, when it is left out) are rows of ``faults``; the other rows of such chunks are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import ids
from graphloom.operators import resolution
from graphloom.operators.lineage import written

#: Fixed values.
PRONOUNS = ("he", "him", "his", "she", "her", "they", "them")
CONCEPTS, PLACES = ("steps", "warning", "darkness"), ("door", "forest", "path")
CREATE, LINK, KEEP = "create_entity", "link_to_existing", "keep_as_mention_only"
STAGE, AUTHORITY = "recursive_rlm_smoke", "cross_chunk_coreference"


def moved(text: Column, surface: Column, start: Column, end: Column) -> Column:
    """struct(start, end): the given span if it holds the surface, else the surface's first place, letter case aside, else null."""
    size = F.length(text)
    a = F.greatest(F.lit(0), F.least(start, size))
    b = F.greatest(a, F.least(end, size))
    first = F.instr(F.lower(text), F.lower(surface)) - 1
    span = lambda x, y: F.struct(x.cast("int").alias("start"), y.cast("int").alias("end"))
    return F.when(F.substring(text, a + 1, b - a) == surface, span(a, b)).when(first >= 0, span(first, first + F.length(surface)))


def expectation(surface: Column, kind: Column, said: Column) -> Column:
    low = resolution.surface(surface)
    return F.when(kind == "pronoun", resolution.ENTITY).when(low.isin(*CONCEPTS), resolution.CONCEPT).when(low.isin(*PLACES), resolution.MENTION_ONLY).otherwise(F.coalesce(F.nullif(said, F.lit("")), F.lit(resolution.ENTITY)))


def assembled(chunks: DataFrame, mentions: DataFrame, events: DataFrame, arguments: DataFrame) -> dict[str, DataFrame]:
    """mentions, events (with their evidence), arguments and faults of drafts.

    ``chunks``: chunk_id, text.  ``mentions``: chunk_id, n, ref, surface, start, end, type, kind, confidence.  ``events``:
    chunk_id, e, predicate, normalized, event_type, evidence_text, evidence_start, evidence_end, confidence.
    ``arguments``: chunk_id, e, a, role, ref, surface, start, end, grounding, confidence.  n, e and a number them.
    """
    text = chunks.select("chunk_id", F.col("text").alias("_t"))
    order = lambda p, i, j: F.struct(F.lit(p).alias("p"), i.cast("int").alias("i"), j.cast("int").alias("j")).alias("at")
    void = F.lit(None).cast("string")
    pronoun = resolution.surface(F.col("surface")).isin(*PRONOUNS)
    said = mentions.select("chunk_id", order(0, F.col("n"), F.lit(0)), "ref", "surface", "start", "end", "type", "kind", "confidence", void.alias("role"), void.alias("grounding"))
    used = arguments.select("chunk_id", order(1, F.col("e"), F.col("a")), "ref", "surface", "start", "end", F.when(pronoun, "pronoun").otherwise("nominal").alias("type"), F.when(pronoun, "pronoun").otherwise("generic_nominal").alias("kind"), "confidence", "role", "grounding")
    # one shuffle by chunk: text, references, spans and numbers are all looked up in it
    rows = said.unionByName(used).repartition("chunk_id").join(text, "chunk_id").withColumn("_s", moved(F.col("_t"), F.col("surface"), F.col("start"), F.col("end"))).drop("_t", "start", "end")
    is_arg, placed = F.col("at.p") == 1, F.col("_s").isNotNull()
    own = F.struct(F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), "surface")
    by_ref = Window.partitionBy("chunk_id", placed, "ref").orderBy("at")
    whole = by_ref.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"_turn": F.row_number().over(by_ref), "_def": F.last(F.when(~is_arg, own), ignorenulls=True).over(whole), "_first": F.first(own).over(whole)})
    asks = placed & (~is_arg | F.col("ref").isNull() | F.col("_def").isNull() & (F.col("_turn") == 1))
    rows = rows.withColumns({"_asks": asks, "_free": F.col("ref").isNotNull() & (F.col("_turn") == 1), "_m": F.when(~is_arg | F.col("ref").isNull(), own).otherwise(F.coalesce("_def", "_first"))}).drop("_def", "_first", "_turn")
    # the first that asks for a span makes its mention; mentions are numbered as they are made
    by_span = Window.partitionBy("chunk_id", placed, "_m.start", "_m.end", "_m.surface").orderBy(F.desc("_asks"), "at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    maker = F.first(F.struct("at", F.when(F.col("_free"), F.col("ref")).alias("ref"), "type")).over(by_span)
    rows = rows.withColumn("_maker", maker).withColumn("_k", F.dense_rank().over(Window.partitionBy("chunk_id", placed).orderBy("_maker.at")))
    rows = rows.withColumn("mention_key", F.coalesce("_maker.ref", F.concat(F.lit("m"), F.col("_k").cast("string"))))
    rows = written(rows.select("chunk_id", "at", "surface", "_s.start", "_s.end", "type", "kind", "confidence", "role", "grounding", "mention_key", F.col("_k").alias("n"), placed.alias("_placed"), (F.col("_asks") & (F.col("at") == F.col("_maker.at"))).alias("_makes"), F.col("_maker.type").alias("_type")), "draft-rows")
    name = F.when(is_arg, F.concat_ws(" ", F.lit("argument"), F.col("at.i").cast("string"), F.col("at.j").cast("string"))).otherwise(F.concat(F.lit("mention "), F.col("at.i").cast("string")))
    lost = rows.where("NOT _placed").select("chunk_id", name.alias("row"), "surface", F.lit("span mismatch").alias("fault"))
    made = rows.where("_placed AND _makes").select("chunk_id", "mention_key", "n", F.col("surface").alias("text"), "start", "end", "type", "kind", "confidence")
    args = rows.where(F.col("_placed") & is_arg).withColumns({"e": F.col("at.i"), "a": F.col("at.j")})
    bound = args.select("chunk_id", "e", "a", "role", "mention_key", "surface", "start", "end", expectation(F.col("surface"), F.col("_type"), F.col("grounding")).alias("grounding"), "confidence")
    reach = args.groupBy("chunk_id", "e").agg(F.min("start").alias("_a"), F.max("end").alias("_b"))
    rows = events.join(text, "chunk_id").join(reach, ["chunk_id", "e"], "left")
    given = F.col("evidence_start").isNotNull() & F.col("evidence_end").isNotNull()
    told = F.nullif("evidence_text", F.lit(""))
    cut = F.substring("_t", F.col("evidence_start") + 1, F.col("evidence_end") - F.col("evidence_start"))
    own = F.struct(F.coalesce("_a", F.lit(0)).alias("start"), F.coalesce("_b", F.length("_t")).cast("int").alias("end"))
    rows = rows.withColumn("_s", F.when(given, moved(F.col("_t"), F.coalesce(told, cut), F.col("evidence_start"), F.col("evidence_end"))).otherwise(own))
    lost = lost.unionByName(rows.where("_s IS NULL").select("chunk_id", F.concat(F.lit("event "), F.col("e").cast("string")).alias("row"), F.col("evidence_text").alias("surface"), F.lit("span mismatch").alias("fault")))
    framed = rows.where("_s IS NOT NULL").select(
        "chunk_id", F.concat(F.lit("ev"), F.col("e").cast("string")).alias("event_key"), F.concat(F.lit("s"), F.col("e").cast("string")).alias("evidence_key"), "e", "predicate", F.coalesce("normalized", "predicate").alias("normalized"), "event_type",
        F.coalesce(told, F.substring("_t", F.col("_s.start") + 1, F.col("_s.end") - F.col("_s.start"))).alias("evidence"), F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), "confidence",
    )
    return {"mentions": made, "events": framed, "arguments": bound, "faults": lost}


def mention_id(chunk: Column, key: Column) -> Column:
    return F.concat(chunk.cast("string"), F.lit("_"), key)


def expectations(draft: dict[str, DataFrame]) -> DataFrame:
    """chunk_id, mention_key, expectations: what the arguments of a mention expect, in order."""
    said = draft["arguments"].groupBy("chunk_id", "mention_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("e", "a", "grounding"))), lambda x: x["grounding"]).alias("expectations"))
    return draft["mentions"].select("chunk_id", "mention_key").join(said, ["chunk_id", "mention_key"], "left").withColumn("expectations", F.coalesce("expectations", F.expr("cast(array() as array<string>)")))


def patch(draft: dict[str, DataFrame], decisions: DataFrame, chunks: DataFrame, entities: DataFrame, run: str, want: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """hypotheses, mentions, arguments, events, entities, observations and faults, or those of them that are wanted.

    ``decisions`` is as ``resolution.resolve`` returns it, ``chunks`` has chunk_id, document_id, index, ``entities`` the
    stored ones (document_id, entity_id, canonical_name, entity_type, aliases).
    """
    wanted = lambda *parts: want is None or not set(parts).isdisjoint(want)
    named = F.col("decision").isin(CREATE, LINK)
    # what travels by mention is what the wanted parts are made of: without hypotheses, only decisions that name an entity
    spans = ("start", "end", "type") if wanted("mentions") else ()
    raw = draft["mentions"].select(mention_id(F.col("chunk_id"), F.col("mention_key")).alias("mention_id"), "chunk_id", "n", "text", *spans).join(chunks.select("chunk_id", "document_id", "index"), "chunk_id")
    said = decisions.drop("document_id").withColumnRenamed("confidence", "sure")
    if not wanted("hypotheses"):
        named_by = ("canonical_name", "entity_type", "alias_to_add") if wanted("entities") else ()
        said = said.where(named).select("mention_id", "decision", "entity_id", *named_by)
    rows = raw.join(said, "mention_id")
    if wanted("hypotheses", "mentions", "entities", "observations"):
        rows = written(rows, "patch-rows")
    strange = decisions.join(raw.select("mention_id"), "mention_id", "left_anti").select(F.col("mention_id").alias("row"), F.lit("decision on an unknown mention").alias("fault"))
    hypotheses = rows if not wanted("hypotheses") else rows.select(
        ids.joined_id("rh", F.lit(run), F.col("mention_id"), F.coalesce("entity_id", F.lit(""))).alias("hypothesis_id"), "mention_id", F.when(F.col("decision") == CREATE, "mention_to_new_entity").when(F.col("decision") == LINK, "mention_to_known_entity").otherwise("unresolved").alias("hypothesis_type"), F.when(named, F.col("entity_id")).alias("final_entity_id"),
        F.when(named, F.col("decision")).otherwise(KEEP).alias("entity_creation_decision"), "status", F.when(F.size("candidates") > 0, F.col("candidates")).when(named, F.array("entity_id")).otherwise(F.expr("cast(array() as array<string>)")).alias("candidates"), F.col("sure").alias("confidence"), F.lit(STAGE).alias("decision_stage"), F.lit(AUTHORITY).alias("authority"), named.alias("is_terminal"), "reason",
    )
    resolved = rows.where(named)
    mentions = resolved if not wanted("mentions") else resolved.select(F.concat("mention_id", F.lit("_resolved")).alias("mention_id"), "chunk_id", "text", "start", "end", "entity_id", F.when(F.col("type") == "pronoun", "pronoun").otherwise("nominal").alias("reference_type"))
    arguments = draft["arguments"].withColumn("mention_id", mention_id(F.col("chunk_id"), F.col("mention_key"))).join(said.select("mention_id", "decision", "entity_id"), "mention_id", "left")
    entity = F.when(named, F.col("entity_id"))
    key = lambda c: F.concat(F.col("chunk_id").cast("string"), F.lit("_"), c)
    event = F.concat(F.lit("ev"), F.col("e").cast("string"))
    arguments = arguments.select(
        key(F.concat(event, F.lit("_arg_"), F.col("a").cast("string"))).alias("argument_id"), key(event).alias("event_id"), "role", "mention_id", entity.alias("entity_id"), F.col("surface"), key(F.concat(F.lit("s"), F.col("e").cast("string"))).alias("span_id"),
        F.when(F.col("grounding") != resolution.ENTITY, "mention_only").when(entity.isNotNull(), "resolved").otherwise("unresolved").alias("resolution_status"), "grounding", F.col("a").alias("argument_index"), "confidence",
    )
    if wanted("arguments", "events"):
        arguments = written(arguments, "patch-arguments")
    open_ = arguments.where("grounding = 'entity_expected' AND resolution_status <> 'resolved'").select("event_id").distinct().withColumn("_open", F.lit(True))
    events = draft["events"].withColumn("event_id", key(F.col("event_key"))).join(open_, "event_id", "left").select("event_id", "chunk_id", "predicate", "normalized", "event_type", key(F.col("evidence_key")).alias("span_id"), "evidence", "start", "end", F.when(F.col("_open"), "partial").otherwise("complete").alias("resolution_status"), F.lit("valid").alias("materialization_status"), "confidence")
    seen = resolved.select("entity_id", "document_id", F.struct("index", "n").alias("at"), "chunk_id", "mention_id", F.col("text").alias("surface"), "decision", *(("canonical_name", "entity_type", "alias_to_add") if wanted("entities") else ()))
    observations = seen.select("entity_id", F.row_number().over(Window.partitionBy("entity_id").orderBy("at", "mention_id")).alias("position"), "document_id", "chunk_id", "mention_id", "surface", "decision")
    made = {"hypotheses": hypotheses, "mentions": mentions, "arguments": arguments, "events": events, "observations": observations, "faults": strange}
    if wanted("entities"):
        made["entities"] = closed(entities, seen)
    return {part: table for part, table in made.items() if wanted(part)}


def closed(entities: DataFrame, seen: DataFrame) -> DataFrame:
    """document_id, entity_id, canonical_name, entity_type, aliases, group_id of every stored and touched entity.

    Aliases are the stored ones and then those that decisions add, in order, each once; ``group_id`` is the least id of the
    entities of the document that share a surface (no pronoun), directly or by way of others.
    """
    none = F.expr("cast(array() as array<string>)")
    new = seen.groupBy("entity_id").agg(F.first("document_id").alias("document_id"), F.min_by("canonical_name", "at").alias("canonical_name"), F.min_by("entity_type", "at").alias("entity_type"), F.transform(F.array_sort(F.collect_list(F.when(F.col("alias_to_add").isNotNull(), F.struct("at", "alias_to_add")))), lambda x: x["alias_to_add"]).alias("added"))
    stored = entities.select("entity_id", *(F.col(c).alias(f"_{c}") for c in ("document_id", "canonical_name", "entity_type", "aliases")))
    rows = stored.join(new, "entity_id", "full_outer")
    both = lambda c: F.coalesce(f"_{c}", c).alias(c)
    rows = written(rows.select(both("document_id"), "entity_id", both("canonical_name"), both("entity_type"), F.array_distinct(F.concat(F.coalesce("_aliases", none), F.coalesce("added", none))).alias("aliases")), "patch-entities")
    names = rows.select("document_id", "entity_id", F.explode(F.array_distinct(F.transform(F.concat(F.array("canonical_name"), "aliases"), resolution.surface))).alias("name")).where((F.col("name") != "") & ~F.col("name").isin(*resolution.PRONOUNS))
    return rows.join(groups(names), "entity_id", "left").withColumn("group_id", F.coalesce("group_id", "entity_id"))


def groups(names: DataFrame) -> DataFrame:
    """entity_id, group_id: least entity of each component of (document_id, entity_id, name), by hooking to the least neighbour and jumping.

    Only entities that share a name with another have rows.
    """
    by_name = Window.partitionBy("document_id", "name")
    names = names.select("document_id", "entity_id", "name").repartition("document_id", "name").distinct()
    names = written(names.withColumn("_n", F.count(F.lit(1)).over(by_name)).where("_n > 1").drop("_n"), "group-names")
    of = written(names.select("entity_id", F.col("entity_id").alias("group_id")).distinct(), "group")
    while True:
        lows = names.join(of, "entity_id").withColumn("_low", F.min("group_id").over(by_name))
        hooks = lows.groupBy("group_id").agg(F.min("_low").alias("_low")).where("_low < group_id")
        if hooks.isEmpty():
            return of
        # a root's new root may itself have moved: jump until none has
        hooks = written(hooks, "group-hooks")
        while True:
            next_ = hooks.join(hooks.select(F.col("group_id").alias("_low"), F.col("_low").alias("_lower")), "_low", "left").select("group_id", F.coalesce("_lower", "_low").alias("_low"))
            moved_ = hooks.join(next_.select("group_id", F.col("_low").alias("_now")), "group_id").where("_now < _low")
            if moved_.isEmpty():
                break
            hooks = written(next_, "group-hooks")
        of = written(of.join(hooks, "group_id", "left").select("entity_id", F.coalesce("_low", "group_id").alias("group_id")), "group")
