"""Questions to plans to DataFrames: a small planner that refuses what it cannot execute."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDINALS = {"first": 1, "1st": 1, "second": 2, "2nd": 2, "third": 3, "3rd": 3}
FREQUENCY = ("most", "frequent", "often", "represented")
RESULT = "status string, value string, answer string, records array<string>"


@dataclass(frozen=True)
class Plan:
    """What to compute: ``kind`` is count, mode, rank or rate."""

    kind: str
    user: str | None = None
    label: str | None = None
    rank: int | None = None
    descending: bool = True
    boundary: str | None = None


def _label_of(text: str) -> str | None:
    """The label after "label", else after "classified as", else ham if it is named at all, else spam."""
    for before in (r"label\s*[:=]?\s*", r"classified as\s+"):
        if named := re.search(rf"{before}['\"]?(not spam|ham|spam)\b", text, re.I):
            return "spam" if named[1].lower() == "spam" else "ham"
    return next((label for label in ("ham", "spam") if re.search(rf"\b{label}\b", text, re.I)), None)


def _rank_of(text: str) -> int | None:
    word = re.search(rf"\b({'|'.join(ORDINALS)})\b", text)
    number = re.search(r"rank\s+(\d+)", text)
    return ORDINALS[word[1]] if word else int(number[1]) if number else None


def plan(question: str) -> Plan | None:
    """The plan of a question, tried in a fixed order: label mode, user rank, rate before/after, count; else none."""
    low = question.strip().lower()
    for phrase, down in (("most common", True), ("least common", False)):
        if "label" in low and phrase in low:
            return Plan("mode", descending=down)
    rank = _rank_of(low)
    if rank is not None and "user" in low and any(w in low for w in FREQUENCY):
        return Plan("rank", rank=rank)
    label, date = _label_of(question), re.search(r"\b(\d{4}-\d{2}-\d{2})\b", question)
    if label and date and "before" in low and "after" in low:
        return Plan("rate", label=label, boundary=date[1])
    user = re.search(r"user(?: ids?)?\s+(\d+)", question, re.I)
    return Plan("count", user=user[1], label=label) if "how many" in low and user and label else None


def _records(rows: DataFrame) -> list:
    """Distinct record ids in order of first appearance."""
    ordered = F.array_sort(F.collect_list(F.struct("record_index", "record_id")))
    return F.array_distinct(F.transform(ordered, lambda r: r["record_id"])).alias("records")


def _refused(facts: DataFrame, status: str) -> DataFrame:
    return facts.sparkSession.range(1).select(F.lit(status).alias("status"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("answer"), F.expr("cast(array() as array<string>)").alias("records"))


def execute(p: Plan | None, facts: DataFrame) -> DataFrame:
    """One row (status, value, answer, records) over facts (record_id, record_index, user_id, label).

    Ties: the most common label is the largest of its kind, the least common the smallest; users rank by count, then
    by id as text.  Counts and modes refuse facts without a label; rates are planned, never executed.
    """
    if p is None or p.kind == "rate":
        return _refused(facts, "unsupported")
    if p.kind == "rank":
        per = facts.groupBy("user_id").agg(F.count_distinct("record_id").alias("n"))
        # as many rows as the rank meet one task; records are gathered for the chosen user alone
        top = per.orderBy(F.desc("n"), "user_id").limit(max(0, p.rank or 0))
        picked = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "user_id"))).where(F.col("r") == (p.rank or 0)).select("user_id")
        picked = facts.join(F.broadcast(picked), "user_id").groupBy("user_id").agg(_records(facts))
        done = picked.select(F.lit("complete").alias("status"), F.col("user_id").alias("value"), F.col("user_id").alias("answer"), "records")
        return _or_insufficient(facts, done)
    unlabelled = facts.where("label is null").limit(1)
    if p.kind == "mode":
        per = facts.groupBy("label").agg(F.count_distinct("record_id").alias("n"))
        order = [F.desc("n"), F.desc("label")] if p.descending else ["n", "label"]
        picked = facts.join(F.broadcast(per.orderBy(*order).limit(1).select("label")), "label").groupBy("label").agg(_records(facts))
        done = picked.select(F.lit("complete").alias("status"), F.col("label").alias("value"), F.concat(F.lit("Label: "), "label").alias("answer"), "records")
    else:
        matched = facts.where((F.col("user_id") == p.user) & (F.col("label") == p.label)).agg(_records(facts))
        n = F.size("records").cast("string")
        done = matched.select(F.lit("complete").alias("status"), n.alias("value"), F.concat(F.lit("Answer: "), n).alias("answer"), "records")
    complete = done.join(unlabelled.select(F.lit(1).alias("_u")), F.lit(True), "left_anti")
    return _or_insufficient(facts, complete)


def _or_insufficient(facts: DataFrame, done: DataFrame) -> DataFrame:
    refused = _refused(facts, "insufficient_facts")
    return refused.join(done.select(F.lit(1).alias("_d")), F.lit(True), "left_anti").unionByName(done)


def answer(question: str, facts: DataFrame) -> DataFrame:
    """Routing: a deterministic answer, or a refusal; never a guess."""
    return execute(plan(question), facts)
