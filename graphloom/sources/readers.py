"""Readers: word-processor files, JSON lines of cases, CSV of claims, paged row sources, run artifacts, generated needles."""

from __future__ import annotations

import io
import json
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
CASE = "task_id string, question string, answers array<string>, context string, gold_evidence array<string>, hops int, answerable boolean, context_tokens long, kind string"


def docx_text(content: bytes) -> str:
    """Non-blank paragraphs of a word-processor file, joined by blank lines."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    parts = ("".join(t.text or "" for t in p.iter(f"{_W}t")).strip() for p in root.iter(f"{_W}p"))
    return "\n\n".join(p for p in parts if p)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """path, text of every file; files are read where they are stored."""

    @F.pandas_udf("string")
    def text(content: pd.Series) -> pd.Series:
        return content.map(docx_text)

    return spark.read.format("binaryFile").load(path).select("path", text("content").alias("text"))


def _first(*paths: str) -> Column:
    """First non-null of several fields of a JSON line."""
    return F.coalesce(*(F.get_json_object("value", f"$.{p}") for p in paths))


def _list(*paths: str) -> Column:
    raw = _first(*paths)
    return F.when(raw.isNull(), F.expr("cast(array() as array<string>)")).when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))


#: Per kind of case, where its fields may be.
ALIASES = {
    "needle": {"id": ("id", "task_id"), "question": ("question", "query"), "answer": ("answer", "needle", "gold_answer"), "context": ("context", "haystack", "text")},
    "records": {"id": ("id", "task_id"), "question": ("question",), "answer": ("answer", "gold_answer"), "context": ("context_window_text", "context")},
    "record_pairs": {"id": ("id", "task_id"), "question": ("question",), "answer": ("answer", "gold_answer"), "context": ("context", "context_window_text")},
    "claims": {"id": ("id", "claim_id"), "question": ("claim", "question"), "answer": ("answer", "aggregated_label"), "context": ("context", "text")},
    "paragraphs": {"id": ("id",), "question": ("question",), "answer": ("answer",), "context": ("context",)},
}


def read_cases(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Cases of a JSON-lines file, blank lines skipped, each field from the first alias that is there."""
    a = ALIASES[kind]
    lines = spark.read.text(path).where(F.trim("value") != "")
    context = _first(*a["context"])
    gold, hops = _list("gold_evidence_span_ids", "evidence"), _first("expected_hops", "hops").cast("int")
    if kind == "paragraphs":
        p = F.from_json(F.get_json_object("value", "$.paragraphs"), "array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>")
        context = F.array_join(F.transform(p, lambda x: F.concat(x["title"], F.lit(": "), x["paragraph_text"])), "\n\n")
        gold = F.transform(F.filter(p, lambda x: x["is_supporting"]), lambda x: F.concat(F.lit("para_"), x["idx"].cast("string")))
        hops = F.nullif(F.regexp_extract(_first("id"), r"^(\d+)hop", 1), F.lit("")).cast("int")
    answers = F.array_distinct(F.concat(_list(*a["answer"]), _list("answer_aliases")))
    size = F.coalesce(_first("context_tokens", "context_len").cast("long"), F.size(F.filter(F.split(context, r"\s+"), lambda x: x != "")).cast("long"))
    return lines.select(_first(*a["id"]).alias("task_id"), _first(*a["question"]).alias("question"), answers.alias("answers"), context.alias("context"), gold.alias("gold_evidence"), hops.alias("hops"), F.coalesce(_first("answerable").cast("boolean"), F.lit(True)).alias("answerable"), size.alias("context_tokens"), F.lit(kind).alias("kind"))


def arm_view(cases: DataFrame, hidden: tuple[str, ...] = ("context_window_text_with_labels", "labels", "native_answer")) -> DataFrame:
    """What an arm may see: no labels and no native answers."""
    return cases.drop(*hidden)


def needle_cases(spark: SparkSession, count: int, context_tokens: int, prefix: str = "needle") -> DataFrame:
    """Generated cases: a code in the middle of filler words."""
    half = context_tokens // 2
    code = F.concat(F.lit(f"{prefix}-"), F.lpad(F.col("id").cast("string"), 4, "0"))
    hay = F.repeat(F.lit("hay "), half)
    return spark.range(count).select(F.concat(F.lit(f"{prefix}_"), F.col("id").cast("string")).alias("task_id"), F.lit("What is the secret code?").alias("question"), F.array(code).alias("answers"), F.concat(hay, F.lit("The secret code is "), code, F.lit(". "), hay).alias("context"))


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """ind, claim, sub_claims, labels, supported of a CSV whose lists are written as literals."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    # a literal's quotes become JSON's; apostrophes inside words stay
    as_json = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, '"', '\\\\"'), r"(?<=[\[,])(\s*)'|'(?=\s*[\],])", '$1"'), r"\[\s*\\\"|\\\"\s*\]", '"')
    listed = lambda c: F.from_json(as_json(F.regexp_replace(c, r"\b(True|False)\b", "'$1'")), "array<string>")
    return rows.select("ind", "claim", listed(F.col("sub_claims")).alias("sub_claims"), F.transform(listed(F.col("labels")), lambda x: F.lower(F.trim(x))).alias("labels"), F.lower(F.trim("aggregated_label")).isin("true", "1", "yes", "supported").alias("supported"))


def first_per_stratum(rows: DataFrame, stratum: str, order: str, quotas: dict) -> DataFrame:
    """The first rows of each stratum, as many as its quota says."""
    w = Window.partitionBy(stratum).orderBy(order)
    quota = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.coalesce(F.element_at(quota, F.col(stratum)), F.lit(0))).drop("_r")


def require_quota(rows: DataFrame, stratum: str, least: int, names: tuple[str, ...]) -> DataFrame:
    """The rows; an error if a stratum is short."""
    have = {r[stratum]: r["count"] for r in rows.where(F.col(stratum).isin(*names)).groupBy(stratum).count().collect()}  # one row per name
    short = [n for n in names if have.get(n, 0) < least]
    if short:
        raise ValueError(f"fewer than {least} rows in {', '.join(map(str, short))}")
    return rows


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records of JSON-lines files, with the file each came from."""
    return spark.read.json(path).withColumn("_artifact", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def artifact_status(runs: DataFrame, registry: DataFrame) -> DataFrame:
    """Runs with the registry's (kind, name, status) status for their artifact, else for their arm, else unknown."""
    by_artifact = registry.where("kind = 'artifact'").select(F.col("name").alias("_artifact"), F.col("status").alias("_s1"))
    by_arm = registry.where("kind = 'arm'").select(F.col("name").alias("arm"), F.col("status").alias("_s2"))
    joined = runs.join(by_artifact, "_artifact", "left").join(by_arm, "arm", "left")
    return joined.withColumn("status", F.coalesce("_s1", "_s2", F.lit("unknown"))).drop("_s1", "_s2")
