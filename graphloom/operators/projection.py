"""Snapshots of entities and pairs, and the semantic documents made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import ids


def entity_snapshots(mentions: DataFrame, observations: DataFrame) -> DataFrame:
    """Per entity: aliases, events and evidence in order, a content hash.

    ``mentions``: entity_id, name, alias, at; ``observations``: entity_id, event_id, role, counterparts, evidence_id, at.
    """
    seen = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x[c]))
    alias = mentions.groupBy("entity_id").agg(F.min_by("name", "at").alias("name"), seen("alias").alias("aliases"))
    obs = observations.groupBy("entity_id").agg(seen("event_id").alias("events"), seen("evidence_id").alias("evidence"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "counterparts"))), lambda x: x["counterparts"]))).alias("counterparts"))
    out = alias.join(obs, "entity_id", "left")
    return out.withColumn("content_hash", ids.content_hash(*(F.col(c) for c in out.columns)))


def identity_text(name: Column, kind: Column, aliases: Column) -> Column:
    return F.concat(F.lit("Entity: "), name, F.lit(". Type: "), kind, F.lit(". Aliases: "), F.array_join(aliases, ", "), F.lit("."))


def semantic_documents(snapshots: DataFrame, observations: DataFrame) -> DataFrame:
    """One identity document per entity, one per observation, one more for each observation with unresolved counterparts."""
    one = snapshots.select(ids.joined_id("sdoc", F.lit("identity"), F.col("entity_id")).alias("semantic_id"), F.lit("entity").alias("owner_type"), F.col("entity_id").alias("owner_id"), identity_text(F.col("name"), F.lit("entity"), F.col("aliases")).alias("text"))
    said = F.concat_ws(" ", "name", F.lit("as"), "role", F.lit("in"), "event_id")
    obs = observations.join(snapshots.select("entity_id", "name"), "entity_id")
    each = obs.select(ids.joined_id("sdoc", F.lit("event"), F.col("entity_id"), F.col("event_id"), F.col("role")).alias("semantic_id"), F.lit("observation").alias("owner_type"), F.col("entity_id").alias("owner_id"), said.alias("text"))
    open_ = obs.where(F.size("unresolved") > 0).select(ids.joined_id("sdoc", F.lit("open"), F.col("entity_id"), F.col("event_id"), F.col("role")).alias("semantic_id"), F.lit("unresolved").alias("owner_type"), F.col("entity_id").alias("owner_id"), F.concat(said, F.lit(" with "), F.array_join("unresolved", ", ")).alias("text"))
    return one.unionByName(each).unionByName(open_)


def record_snapshots(facts: DataFrame) -> DataFrame:
    """Context, record, label and aggregate rows of record facts (case_id, record_id, user_id, label)."""
    record = facts.select("case_id", F.lit("record").alias("kind"), F.col("record_id").alias("owner"), F.lit(1).cast("long").alias("n"))
    label = facts.where("label is not null").groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("n")).select("case_id", F.lit("label").alias("kind"), F.col("label").alias("owner"), "n")
    context = facts.groupBy("case_id").agg(F.count_distinct("record_id").alias("n")).select("case_id", F.lit("context").alias("kind"), F.lit("context").alias("owner"), "n")
    whole = label.groupBy("case_id").agg(F.sum("n").alias("n")).select("case_id", F.lit("aggregate").alias("kind"), F.lit("labels").alias("owner"), "n")
    return record.unionByName(label).unionByName(context).unionByName(whole)


def record_pairs(facts: DataFrame) -> DataFrame:
    """Record-label pairs of labelled records."""
    return facts.where("label is not null").select("case_id", ids.joined_id("pair", F.col("record_id"), F.col("label")).alias("pair_id"), "record_id", "label")
