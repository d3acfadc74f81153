"""Keyed mutations as pure DataFrame rewrites: upserts, versioned snapshots, cascading deletes, state machines.

Each returns the table's next content; writing it (overwrite of the touched partitions, or MERGE on a table format
that has it) is left to ``replace``, which writes beside the old files and so survives a failed job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERROR_CHARS = 4000


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], insert_only: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """``rows`` win over ``table`` by key; insert-only columns keep what the table has.

    Of several new rows of one key, the last by ``order`` wins.
    """
    if order is not None:
        w = Window.partitionBy(*keys).orderBy(F.desc(order))
        rows = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    old, new = table.alias("o"), rows.alias("n")
    joined = old.join(new, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    fresh = F.col(f"n.{keys[0]}").isNotNull()

    def value(c: str) -> Column:
        if c in keys:
            return F.coalesce(f"n.{c}", f"o.{c}")
        if c not in rows.columns:
            return F.col(f"o.{c}")
        if c in insert_only:
            return F.coalesce(F.when(F.col(f"o.{keys[0]}").isNotNull(), F.col(f"o.{c}")), F.col(f"n.{c}"))
        return F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return joined.select(*(value(c).alias(c) for c in table.columns))


def new_version(snapshots: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Active snapshots of the keys of ``rows`` become deprecated; ``rows`` become active.  Same content changes nothing."""
    current = snapshots.where("status = 'active'").select(key, F.col("content_hash").alias("_h"))
    changed = rows.join(current, key, "left").where(~F.col("_h").eqNullSafe(F.col("content_hash"))).drop("_h")
    touched = changed.select(key).distinct().withColumn("_new", F.lit(True))
    old = snapshots.join(touched, key, "left").withColumn("status", F.when(F.col("_new") & (F.col("status") == "active"), "deprecated").otherwise(F.col("status"))).drop("_new")
    return old.select(*snapshots.columns).unionByName(changed.withColumn("status", F.lit("active")).select(*snapshots.columns))


def active_snapshot(snapshots: DataFrame, key: str, order: str) -> DataFrame:
    """The newest active row of each key."""
    every = F.struct(*(F.col(c) for c in snapshots.columns))
    return snapshots.where("status = 'active'").groupBy(key).agg(F.max_by(every, order).alias("_s")).select("_s.*")


def cascade_delete(doomed: DataFrame, tables: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """Every table without the rows of doomed keys."""
    return {name: t.join(doomed.select(key).distinct(), key, "left_anti") for name, t in tables.items()}


def chunk_state(chunks: DataFrame, event: str, touched: Column, error: Column | None = None) -> DataFrame:
    """PENDING -> PROCESSING (one more attempt) -> DONE or FAILED (with a cut error text) for the touched rows."""
    out = chunks.withColumn("status", F.when(touched, event).otherwise(F.col("status")))
    if event == "PROCESSING":
        return out.withColumn("attempts", F.col("attempts") + F.when(touched, 1).otherwise(0))
    if event == "FAILED":
        return out.withColumn("error", F.when(touched, F.substring(error, 1, ERROR_CHARS)).otherwise(F.col("error")))
    return out.withColumn("error", F.when(~touched, F.col("error")))


def to_redo(chunks: DataFrame, ledger: DataFrame, mode: str) -> DataFrame:
    """Chunks to extract: all (overwrite), those not done with the same content (resume), or those unknown (append)."""
    if mode == "overwrite":
        return chunks
    known = ledger.where("status = 'DONE'") if mode == "resume" else ledger
    on = ["document_id", "index", "content_hash"] if mode == "resume" else ["document_id", "index"]
    return chunks.join(known.select(*on).distinct(), on, "left_anti")


def replace(df: DataFrame, path: str) -> None:
    """The table's next content, written to a new folder; the caller then points readers at it."""
    df.write.mode("errorifexists").parquet(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
