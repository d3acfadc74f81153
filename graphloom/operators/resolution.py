"""Resolution of mentions in entities: what is plain is decided by rule, the rest by a proposal that has to pass guards.

A mention is ambiguous if it is a pronoun, a descriptive one that an event wants an entity for, or bears a name that is
known before its chunk: a stored entity's, or that of an anchor which the same run makes in an earlier chunk.  Ambiguous
mentions get the best ``k`` candidates of their document by inverted lists: entities that share a word of a name, that
were seen in the chunks just before, and, for pronouns, those whose alias is in these chunks' text, filled up by name.
A model's proposals come in through a seam, are held against the candidates by one cascade of guards, and are merged
with the decisions by rule.

Links and aliases that a run adds are seen by the next run.  A partial name match needs a common word.

``mentions``: document_id, chunk_id, index (of the chunk), mention_id, text, type, kind, confidence, expectations.
``entities``: document_id, entity_id, canonical_name, entity_type, aliases.  ``observations``: entity_id, document_id,
index.  ``chunks``: document_id, index, text.  Nulls in text or expectations count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import ids
from graphloom.operators.lineage import written

#: Fixed values.
PRONOUNS = ("he", "him", "his", "she", "her", "they", "them", "their")
DESCRIPTIVE, DESCRIPTIVE_KINDS = ("descriptor", "alias", "nominal"), ("descriptive_alias", "role_anchor", "generic_nominal")
PERSONS = ("named", "descriptor", "alias", "nominal")
SURFACE, PARTIAL, SEEN, ACTIVE, BRIDGE = "surface_or_alias_match", "partial_name_match", "seen_in_retrieved_window", "active_discourse_entity", "pronoun_context_alias_bridge"
POINTS = {SURFACE: 1.0, PARTIAL: 0.6, SEEN: 0.4, ACTIVE: 0.3, BRIDGE: 1.2}
LEXICAL, STRONG, LEAST_SCORE = (SURFACE, PARTIAL), (BRIDGE, SURFACE), 1.5
CONCEPT, MENTION_ONLY, ENTITY = "concept_allowed", "mention_only_allowed", "entity_expected"
REASONS = {CONCEPT: "Concept mention allowed by event argument grounding policy.", MENTION_ONLY: "Mention-only anchor allowed by event argument grounding policy.", "anchor": "Unambiguous named anchor creates a provisional entity.", "concept": "Concept mention allowed before model resolution."}
GUARDS = {
    "pronoun": "Policy guard: pronoun cannot create Entity. ", "outside": "Policy guard: linked entity was not in candidate set. ",
    "lexical": "Policy guard: descriptive/nominal mention lacked lexical or alias evidence for candidate. ", "rivals": "Policy guard: competing pronoun candidates without strong retrieved alias evidence. ",
}
WINDOW, CANDIDATES = 2, 5
_WORDS = r"\s+"


def surface(text: Column) -> Column:
    """Lower case, without one article of each kind in front, spaces squeezed."""
    low = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")))
    return F.trim(F.regexp_replace(F.regexp_replace(low, "^(the )?(a )?(an )?", ""), _WORDS, " "))


def _is_pronoun() -> Column:
    return (F.col("type") == "pronoun") | (F.col("kind") == "pronoun")


def _is_anchor() -> Column:
    """A capitalised single word without an article."""
    text = F.trim("text")
    return ~_is_pronoun() & ~F.lower(text).rlike("^(the|a|an) ") & text.rlike(r"^\p{Lu}") & ~F.col("normal").contains(" ")


def prepared(mentions: DataFrame) -> DataFrame:
    """Mentions with ``normal``, ``pronoun``, ``anchor``, and whether they are ambiguous whatever is known (``vague``)."""
    rows = mentions.withColumns({"text": F.coalesce("text", F.lit("")), "expectations": F.coalesce("expectations", F.expr("cast(array() as array<string>)")), "type": F.coalesce("type", F.lit("")), "kind": F.coalesce("kind", F.lit(""))}).withColumn("normal", surface(F.col("text")))
    rows = rows.withColumns({"pronoun": _is_pronoun(), "anchor": _is_anchor()})
    asks = F.array_contains("expectations", ENTITY) | (F.col("type") == "pronoun")
    vague = F.col("pronoun") | F.col("type").isin(*DESCRIPTIVE) | F.col("kind").isin(*DESCRIPTIVE_KINDS) & ~F.col("anchor")
    return rows.withColumns({"asks": asks, "vague": asks & vague})


def made_entity(document: Column, normal: Column) -> Column:
    return ids.short_id("entity", F.concat_ws(":", document.cast("string"), normal))


def known_names(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """document_id, name, entity_id, canonical_name, entity_type, aliases, since: names and the chunk after which they are known."""
    stored = entities.select("document_id", "entity_id", "canonical_name", "entity_type", F.coalesce("aliases", F.expr("cast(array() as array<string>)")).alias("aliases"), F.lit(-1).alias("since"))
    stored = stored.withColumn("name", F.explode(F.array_distinct(F.transform(F.concat(F.array("canonical_name"), "aliases"), surface)))).where("name <> ''")
    free = rows.where(~F.col("vague") & ~F.array_contains("expectations", CONCEPT) & ~F.array_contains("expectations", MENTION_ONLY) & (F.col("normal") != ""))
    first = free.groupBy("document_id", F.col("normal").alias("name")).agg(F.min(F.struct("index", "mention_id", "text", "anchor")).alias("f")).join(stored.select("document_id", "name").distinct(), ["document_id", "name"], "left_anti")
    made = first.select("document_id", made_entity(F.col("document_id"), F.col("name")).alias("entity_id"), F.col("f.text").alias("canonical_name"), F.when(F.col("f.anchor"), "person").otherwise("unknown").alias("entity_type"), F.expr("cast(array() as array<string>)").alias("aliases"), F.col("f.index").cast("int").alias("since"), "name")
    return stored.unionByName(made)


def gated(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Prepared mentions with ``gated``: ambiguous, or of a name that is known before their chunk."""
    first = names.groupBy("document_id", F.col("name").alias("normal")).agg(F.min("since").alias("_since"))
    known = F.coalesce(F.col("_since") < F.col("index"), F.lit(False))
    return rows.join(first, ["document_id", "normal"], "left").withColumn("gated", F.col("vague") | F.col("asks") & known).drop("_since")


def first_by_name(entity: DataFrame, k: int) -> DataFrame:
    """Entities that can be among the first k by name of those known at some index: fewer than k come before them in name and are known as early.

    An entity that is known earlier than all before it in name is a record; k times, the records are taken out.
    """
    before = Window.partitionBy("document_id").orderBy(F.lower("canonical_name"), "entity_id").rowsBetween(Window.unboundedPreceding, -1)
    out = entity.withColumn("_taken", F.lit(False))
    for _ in range(k):
        out = out.withColumn("_m", F.min(F.when(~F.col("_taken"), F.col("since"))).over(before))
        out = out.withColumn("_taken", F.col("_taken") | F.col("_m").isNull() | (F.col("since") < F.col("_m")))
    return out.where("_taken").drop("_taken", "_m")


def candidates(rows: DataFrame, names: DataFrame, observations: DataFrame, chunks: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """mention_id, entity_id, canonical_name, entity_type, score, reasons, rank of the best entities of each mention, ties by name and id.

    What a name or a chunk leads to is found once for all its mentions; a pair then travels once, with its reasons as bits.
    """
    bit = {reason: 1 << i for i, reason in enumerate(POINTS)}
    words = lambda c: F.explode(F.array_distinct(F.split(c, " "))).alias("word")
    asked = rows.select("mention_id", "document_id", "index", "normal", "pronoun")
    told_by = F.struct("canonical_name", "entity_type").alias("told_by")
    listed = names.select("document_id", "entity_id", told_by, "name", "since", words("name")).where("word <> ''")
    near = asked.where("normal <> ''").select("document_id", "normal").distinct().select("document_id", "normal", words("normal")).join(listed, ["document_id", "word"])
    # of the words that both have only the first makes a row
    near = near.where(F.col("word") == F.array_intersect(F.split("normal", " "), F.split("name", " "))[0])
    why = F.when(F.col("normal") == F.col("name"), bit[SURFACE]).otherwise(0) + F.when(F.col("name").contains(F.col("normal")) | F.col("normal").contains(F.col("name")), bit[PARTIAL]).otherwise(0)
    near = near.select("document_id", "normal", "entity_id", "told_by", "since", why.alias("bits")).where("bits > 0")
    by_name = asked.join(near, ["document_id", "normal"]).where("since < index")
    # seen in a chunk: a candidate in the WINDOW chunks after it
    after = F.explode(F.sequence(F.col("index") + 1, F.col("index") + WINDOW)).alias("index")
    made = names.where("since >= 0").select("entity_id", "document_id", F.col("since").alias("index"))
    known = names.groupBy("entity_id").agg(F.min(told_by).alias("told_by"))
    seen = observations.select("entity_id", "document_id", "index").unionByName(made).select("entity_id", "document_id", after).distinct().join(known, "entity_id")
    # an alias that the text holds has all words of the text but, perhaps, its first and last: any of its words finds it
    before = asked.where("pronoun").select("document_id", "index").distinct().select("document_id", "index", F.explode(F.sequence(F.col("index") - WINDOW, F.col("index") - 1)).alias("_at"))
    told = before.join(chunks.select("document_id", F.col("index").alias("_at"), F.lower("text").alias("_t")), ["document_id", "_at"]).groupBy("document_id", "index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_t"))), lambda x: x["_t"]), " ").alias("_t"))
    alias = names.where(F.col("name") != surface(F.col("canonical_name"))).where(~F.col("name").isin(*PRONOUNS)).select("document_id", "entity_id", told_by, "name", "since", words("name"))
    bridge = told.select("document_id", "index", "_t", F.explode(F.array_distinct(F.split("_t", _WORDS))).alias("word")).join(alias, ["document_id", "word"]).where("since < index").where(F.col("_t").contains(F.col("name"))).select("document_id", "index", "entity_id", "told_by").distinct()
    at = seen.withColumn("bits", F.lit(bit[SEEN])).unionByName(bridge.withColumn("bits", F.lit(bit[BRIDGE])))
    by_chunk = asked.join(at, ["document_id", "index"]).where(F.col("pronoun") | (F.col("bits") == bit[SEEN]))
    # every known entity is a pronoun's candidate; of those without another reason the first k by name can count
    entity = names.select("document_id", "entity_id", "canonical_name", "since", told_by).distinct()
    fill = asked.where("pronoun").join(first_by_name(entity, k), "document_id").where("since < index").withColumn("bits", F.lit(0))
    pair = ["mention_id", "entity_id", "told_by", (F.col("bits") + F.when(F.col("pronoun"), bit[ACTIVE]).otherwise(0)).alias("bits")]
    pairs = by_name.select(*pair).unionByName(by_chunk.select(*pair)).unionByName(fill.select(*pair)).repartition("mention_id")
    has = lambda reason: F.col("bits").bitwiseAND(bit[reason]) > 0
    score = sum((F.when(has(reason), points).otherwise(0.0) for reason, points in POINTS.items()), F.lit(0.0))
    reasons = F.array_compact(F.array(*(F.when(has(reason), reason) for reason in sorted(POINTS))))
    scored = pairs.groupBy("mention_id", "entity_id").agg(F.bit_or("bits").alias("bits"), F.min("told_by").alias("told_by")).select("mention_id", "entity_id", "told_by.*", F.round(score, 3).alias("score"), "bits")
    best = Window.partitionBy("mention_id").orderBy(F.desc("score"), F.lower("canonical_name"), "entity_id")
    return scored.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("mention_id", "entity_id", "canonical_name", "entity_type", "score", reasons.alias("reasons"), "rank")


def guards(rows: DataFrame) -> DataFrame:
    """Proposals (decision, target, confidence, reason) that had to give way: decision, confidence and reason after the first guard that holds."""
    link, strong = F.col("decision") == "link_existing", lambda names: F.coalesce(F.arrays_overlap("reasons", F.array(*(F.lit(x) for x in names))), F.lit(False))
    outside = link & F.col("score").isNull()
    guard = (
        F.when(F.col("pronoun") & (F.col("decision") == "propose_new"), "pronoun").when(outside, "outside").when(link & ~F.col("pronoun") & ~strong(LEXICAL), "lexical")
        .when(link & F.col("pronoun") & (F.col("n") > 1) & (~strong(STRONG) | (F.col("score") < LEAST_SCORE)), "rivals")
    )
    rows = rows.withColumn("guard", guard)
    most = F.when(F.col("guard").isin("pronoun", "outside"), 0.49).when(F.col("guard") == "lexical", 0.79).otherwise(1.0)
    said = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in GUARDS.items() for x in pair)), F.col("guard")), F.lit(""))
    return rows.withColumns({
        "decision": F.when(F.col("guard") == "lexical", "propose_new").when(F.col("guard").isNotNull(), "keep_unresolved").otherwise(F.col("decision")),
        "confidence": F.when(F.col("guard").isNull(), F.col("confidence")).otherwise(F.least("confidence", most)), "reason": F.concat(said, F.coalesce("reason", F.lit(""))),
    })


def resolve(mentions: DataFrame, entities: DataFrame, observations: DataFrame, chunks: DataFrame, propose: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """A decision for every mention.

    ``propose`` gets the ambiguous mentions and their candidates and gives (mention_id, decision, entity_id, confidence,
    reason): link_existing, propose_new, mention_only or keep_unresolved; a mention without a proposal is kept unresolved.
    """
    rows = prepared(mentions)
    names = written(known_names(rows, entities), "resolve-names")
    rows = written(gated(rows, names), "resolve-mentions")
    concept, only = F.array_contains("expectations", CONCEPT), F.array_contains("expectations", MENTION_ONLY)
    own, text = made_entity(F.col("document_id"), F.col("normal")), F.col("text")
    void, no_alias = F.lit(None).cast("string"), F.lit(None).cast("string").alias("alias_to_add")
    out = ["mention_id", "document_id", F.col("text").alias("surface_text")]
    none = F.expr("cast(array() as array<string>)").alias("candidates")
    plain = rows.where(~F.col("gated") | concept)
    kept = F.when(concept, CONCEPT).when(only, MENTION_ONLY)
    by_rule = plain.select(
        *out, F.coalesce(kept, F.lit("create_entity")).alias("decision"), F.when(kept.isNull(), own).alias("entity_id"), F.when(kept.isNull(), text).alias("canonical_name"), F.when(kept.isNull(), F.when(F.col("anchor"), "person").otherwise("unknown")).alias("entity_type"), no_alias, "confidence",
        F.lit("confirmed").alias("status"), none, F.when(F.col("gated"), REASONS["concept"]).when(concept, REASONS[CONCEPT]).when(only, REASONS[MENTION_ONLY]).otherwise(REASONS["anchor"]).alias("reason"), void.alias("guard"), "gated",
    )
    open_ = rows.where(F.col("gated") & ~concept)
    found = written(candidates(open_, names, observations, chunks), "resolve-candidates")
    said = propose(open_, found).select("mention_id", "decision", F.col("entity_id").alias("target"), F.col("confidence").alias("_c"), "reason")
    listed = found.groupBy("mention_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entity_id", "canonical_name", "entity_type", "score", "reasons"))).alias("_found"))
    rows = open_.join(said, "mention_id", "left").join(listed, "mention_id", "left").withColumn("_hit", F.get(F.filter("_found", lambda x: x["entity_id"] == F.col("target")), F.lit(0)))
    rows = rows.withColumn("candidates", F.transform("_found", lambda x: x["entity_id"])).select("*", *(F.col(f"_hit.{c}").alias(c) for c in ("canonical_name", "entity_type", "score", "reasons"))).drop("_found", "_hit")
    rows = rows.withColumns({"decision": F.coalesce("decision", F.lit("keep_unresolved")), "confidence": F.coalesce("_c", F.lit(0.0)), "candidates": F.coalesce("candidates", F.expr("cast(array() as array<string>)"))})
    rows = guards(rows.withColumn("n", F.size("candidates")))
    linked, new, mere = (F.col("decision") == d for d in ("link_existing", "propose_new", "mention_only"))
    sure = F.col("confidence") >= 0.8
    by_proposal = rows.select(
        *out, F.when(linked, "link_to_existing").when(new, "create_entity").when(mere, MENTION_ONLY).otherwise("unresolved").alias("decision"), F.when(linked, F.col("target")).when(new, own).alias("entity_id"), F.when(linked, F.col("canonical_name")).when(new, text).alias("canonical_name"),
        F.when(linked, F.col("entity_type")).when(new, F.when(F.col("type").isin(*PERSONS), "person").otherwise("unknown")).alias("entity_type"), F.when(linked & (F.col("normal") != surface(F.col("canonical_name"))), text).alias("alias_to_add"), "confidence",
        F.when(linked | new, F.when(sure, "confirmed").otherwise("likely")).when(mere, F.when(sure, "confirmed").otherwise("possible")).otherwise("unresolved").alias("status"), "candidates", "reason", "guard", "gated",
    )
    return by_rule.unionByName(by_proposal)


def retrieval_state(decisions: DataFrame, mentions: DataFrame) -> DataFrame:
    """chunk_id, saw_retrieval, rounds, visited_entities of every chunk with mentions."""
    rows = decisions.join(mentions.select("mention_id", "chunk_id"), "mention_id").groupBy("chunk_id").agg(F.bool_or("gated").alias("saw_retrieval"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("candidates")))).alias("visited_entities"))
    return rows.select("chunk_id", "saw_retrieval", F.when(F.col("saw_retrieval"), 2).otherwise(1).alias("rounds"), "visited_entities")
