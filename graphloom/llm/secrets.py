"""Secret scans through an incremental blob ledger (DataFrame functions only).

Every version of a text is addressed by its content (SHA-256).  A ledger holds
one row per scanned (blob, rule version); a scan reads only the blobs that the
ledger lacks under the current rules and joins findings back to every path that
holds the blob.  Copies are therefore scanned once, and a rerun scans nothing.

Defined results: a null text is an empty blob with no findings; repeated rows
each get a result row; a very long text is one blob, scanned by one task; spans
that start together are listed by kind; an empty table gives an empty result;
other columns are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.store import aside, table, written

#: Kinds in the order in which ties are listed.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: A run of the class is matched whole, so asking for the length inside the pattern drops just the short runs.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Added by this scanner; they never remove a span of the first three kinds.
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
JWT = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
RULES = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("pem", PEM), ("jwt", JWT))
BASE_KINDS = 3
ASSIGN_LEAST = 6
SPAN = "struct<start:bigint,kind:int,end:bigint,before:bigint>"
MASK = "[secret]"


def rule_version(rules=RULES) -> str:
    """A name for the rules, changed by any change to them."""
    return hashlib.sha256("\n".join(f"{k}\t{p}" for k, p in rules).encode()).hexdigest()[:16]


def _hits_of(text: Column, kind: int, pattern: str) -> Column:
    """Matches of one kind in order: what lies between them (gap), their length, and whether they count."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))

    def hit(gap, match):
        keep = F.length(F.regexp_extract(match, pattern, 2)) >= ASSIGN_LEAST if kind == 0 else F.lit(True)
        return F.struct(F.lit(kind).alias("kind"), F.length(gap).cast("long").alias("gap"), F.length(match).cast("long").alias("size"), keep.alias("keep"))

    return F.when(F.size(found) > 0, F.zip_with(between, found, hit))


def find_spans(blobs: DataFrame, rules=RULES) -> DataFrame:
    """``blob``, ``spans`` of every row of blob, text: all spans by start, then kind as listed.

    Matches are exploded and their places summed in windows within the blob, in time n log n of their number; rows
    that come dealt by blob are not dealt again.  ``before`` is where the spans ahead in the list end at the latest.
    """
    nothing = F.array().cast("array<struct<kind:int,gap:bigint,size:bigint,keep:boolean>>")
    hits = F.concat(*(F.coalesce(_hits_of(F.col("text"), i, p), nothing) for i, (_, p) in enumerate(rules)))
    rows = blobs.select("blob", F.posexplode_outer(hits).alias("n", "hit")).select("blob", "n", "hit.*")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("blob", "kind").orderBy("n"))
    rows = rows.withColumn("end", end).select("blob", "kind", "keep", (F.col("end") - F.col("size")).alias("start"), "end")
    ahead = Window.partitionBy("blob").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.max(F.when(F.col("keep"), F.col("end"))).over(ahead), F.lit(0).cast("long")))
    # a blob without matches, or with short ones only, keeps its row
    span = F.when(F.col("keep"), F.struct("start", "kind", "end", "before"))
    return rows.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def scan_ledger(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """New ledger rows (blob, rule_version, spans) for the blobs of ``docs.text`` that the ledger lacks."""
    version = rule_version(rules)
    text = F.coalesce(F.col("text"), F.lit(""))
    blobs = docs.select(F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    return find_spans(blobs, rules).select("blob", F.lit(version).alias("rule_version"), F.col("spans").cast(f"array<{SPAN}>").alias("spans"))


def findings(docs: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` rows with ``secret_spans``: the ledger's findings for the row's blob.  A column of that name is replaced."""
    hits = ledger.where((F.col("rule_version") == rule_version(rules)) & (F.size("spans") > 0)).select(F.col("blob").alias("found blob"), F.col("spans").alias("found spans"))
    docs, back = aside(docs.drop("secret_spans"), "text")
    blob = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    joined = docs.withColumn("own blob", blob).join(hits, F.col("own blob") == F.col("found blob"), "left")
    return joined.select(*back, F.coalesce("found spans", F.expr(f"cast(array() as array<{SPAN}>)")).alias("secret_spans"))


def written_spans(spans: Column, rules=RULES) -> Column:
    names = F.array(*(F.lit(k) for k, _ in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every found span, overlapping ones as one, replaced by a mark."""
    piece = lambda s: F.concat(F.substring(text, (s["before"] + 1).cast("int"), (s["start"] - s["before"]).cast("int")), F.lit(MASK))
    fresh = F.transform(F.filter(spans, lambda s: s["start"] >= s["before"]), piece)
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(fresh, ""), F.substring(text, (last + 1).cast("int"), F.lit(2**31 - 1)))).otherwise(text)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = written(scan_ledger(docs), "secret-ledger")
    base = F.filter("secret_spans", lambda s: s["kind"] < BASE_KINDS)
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long")
    return findings(docs, ledger).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written_spans(base), 256).alias("base_sha256"), written_spans(F.col("secret_spans")).alias("spans"),
    )


def _sql() -> str:
    """The same spans in SQL: matches and the texts between them, with running sums of their lengths."""
    quoted = [p.replace("'", "''") for _, p in RULES]
    kinds = ", ".join(f"({i}, '{k}', regexp_extract_all(text, '{p}'), string_split_regex(text, '{p}'))" for i, ((k, _), p) in enumerate(zip(RULES, quoted, strict=True)))
    said = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, i)"
    count = lambda i: f"CAST(count(*) FILTER (i = {i}) AS BIGINT)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT rid, t.i, t.kind, t.hits, t.parts FROM d, LATERAL (VALUES {kinds}) AS t(i, kind, hits, parts) WHERE len(t.hits) > 0),
u AS (SELECT rid, i, kind, unnest(hits) AS hit, unnest(parts[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS n FROM m),
s AS (SELECT rid, i, kind, hit, CAST(sum(length(gap)) OVER w + sum(length(hit)) OVER w - length(hit) AS BIGINT) AS a FROM u WINDOW w AS (PARTITION BY rid, i ORDER BY n)),
f AS (SELECT *, a + length(hit) AS b FROM s WHERE i <> 0 OR length(regexp_extract(hit, '{quoted[0]}', 2)) >= {ASSIGN_LEAST}),
g AS (SELECT rid, {count(0)} AS n_assign, {count(1)} AS n_access, {count(2)} AS n_hex, coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, i) FILTER (i < {BASE_KINDS}), '') AS base, {said} AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)
"""


OP10_SQL = _sql()


def mask_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with their secrets masked; every document stays."""
    ledger = written(scan_ledger(docs.select("text")), "secret-ledger")
    docs, back = aside(docs, "text", "n_chars")
    hit = findings(docs, ledger)
    text = masked(F.col("text"), F.col("secret_spans"))
    return hit.withColumn("n_chars", F.when(F.size("secret_spans") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))).withColumn("text", text).select(*back)
