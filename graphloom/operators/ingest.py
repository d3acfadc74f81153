"""From documents to label tables in one job, and the encoding of relation candidates that still lack a vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import ids, vector
from graphloom.operators import chunking, extraction, sinks
from graphloom.operators.lineage import cut, written
from graphloom.streaming import fold


PARTS = ("chunks", *extraction.PARTS, "state", "entities")


def ingest(docs: DataFrame, budget: int, ledger: DataFrame | None = None, mode: str = "overwrite", separator: str = r"\n\s*\n", wanted: tuple[str, ...] = PARTS) -> dict[str, DataFrame]:
    """Chunks to do, their label tables, and the document state after every chunk; or the ``wanted`` of these.

    ``ledger`` (document_id, index, content_hash, status) says what is done; a chunk whose content changed is redone.
    """
    chunks = chunking.chunk_documents(docs, budget, separator).withColumn("content_hash", F.sha2("text", 256)).withColumn("document_id", F.col("doc_id"))
    todo = chunks if ledger is None else sinks.to_redo(chunks, ledger, mode)
    todo = todo if set(wanted) == {"entities"} else cut(todo)
    labels = [p for p in extraction.PARTS if p in wanted or p == "hypotheses" and {"state", "entities"} & set(wanted)]
    out = {"chunks": todo, **(extraction.extract(todo, tuple(labels)) if labels else {})}
    if "state" in wanted:
        known = out["hypotheses"].where(F.col("decision").isin("create_entity", "link_to_existing")).groupBy("chunk_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entities"))
        nothing = F.expr("cast(array() as array<string>)")
        out["state"] = fold.batch_fold(todo.select("doc_id", "index", "chunk_id").join(known, "chunk_id", "left").withColumn("entities", F.coalesce("entities", nothing)))
    if "entities" in wanted:
        out["entities"] = out["hypotheses"].where("entity_id is not null and status <> 'rejected'").groupBy("entity_id").agg(F.count_distinct("mention_id").alias("mentions"), F.max("confidence").alias("confidence"))
    return {name: out[name] for name in wanted}


def relation_text(source: Column, predicate: Column, target: Column, evidence: Column) -> Column:
    return F.concat(F.lit("Source: "), source, F.lit("\nRelation: "), predicate, F.lit("\nTarget: "), target, F.lit("\nEvidence: "), evidence)


def encode_pending(candidates: DataFrame, encoded: DataFrame, dims: int = 64, limit: int | None = None) -> DataFrame:
    """candidate_id, edge_id, text, vector of candidates (candidate_id, source, predicate, target, evidence) not encoded yet, in order of id."""
    todo = candidates.join(encoded.select("candidate_id"), "candidate_id", "left_anti")
    todo = todo if limit is None else todo.orderBy("candidate_id").limit(limit)
    said = relation_text(*(F.col(c) for c in ("source", "predicate", "target", "evidence")))
    rows = todo.withColumn("text", said)
    return rows.select("candidate_id", ids.short_id("latent", F.concat_ws(":", "candidate_id", "text")).alias("edge_id"), "text", vector.dense_hashed(F.col("text"), dims).alias("vector"))


def nested_values(json_text: Column, key: str) -> Column:
    """All scalar values of a key anywhere in nested JSON, in order of appearance."""
    pattern = '"' + key + r'"\s*:\s*("(?:[^"\\]|\\.)*"|-?[0-9.eE+-]+|true|false)'
    return F.transform(F.regexp_extract_all(json_text, F.lit(pattern), F.lit(1)), lambda x: F.btrim(x, F.lit('"')))


def json_key_values(rows: DataFrame, id_col: str, json_col: str, key: str) -> DataFrame:
    """id, value: the distinct values of a key anywhere in nested JSON, one level of all rows a step.

    A key's list gives its items; below a key that matches nothing is looked for.  Nulls, false, 0, empty texts and empty
    containers give nothing, neither does text that is no JSON.  Values are texts; nested ones are JSON.
    """
    spark = rows.sparkSession
    level = written(rows.select(F.col(id_col).alias("id"), F.try_parse_json(json_col).alias("v")).where("v IS NOT NULL"), "json-level")
    out, depth = None, 0
    while depth == 0 or not level.isEmpty():
        held = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("id", "key", "value")
        kind = F.schema_of_variant("value")
        hit = F.coalesce(F.col("key") == key, F.lit(False))
        items = held.where(hit & kind.startswith("ARRAY")).select("id", F.col("value").alias("v")).lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("id", "value")
        found = items.unionByName(held.where(hit & ~kind.startswith("ARRAY")).select("id", "value"))
        found = found.select("id", F.when(F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)"), F.to_json("value")).otherwise(F.try_variant_get("value", "$", "string")).alias("value"), F.schema_of_variant("value").alias("_kind"))
        false = F.col("value").isNull() | F.col("value").isin("", "{}", "[]") | (F.col("_kind") == "BOOLEAN") & (F.col("value") == "false") | ~F.col("_kind").rlike("^(STRING|BOOLEAN|OBJECT|ARRAY)") & (F.try_variant_get(F.try_parse_json("value"), "$", "double") == 0)
        found = written(found.where(~F.coalesce(false, F.lit(False))).select("id", "value").distinct(), "json-found")
        out = found if out is None else out.unionByName(found)
        level = written(held.where(~hit & kind.rlike("^(OBJECT|ARRAY)")).select("id", F.col("value").alias("v")), "json-level")
        depth += 1
    return out.distinct()
