"""Rows served page by page (offset, length), as a Python data source.

A page is read once, by the task that holds it.  Filters that the service understands (comparisons of a column with a
literal, joined by AND) are pushed into the request where ``filters`` is set; the others stay with Spark.  A ``revision``
pins every page to one state of the data: the service has to answer with it, else the read fails.  Failed requests are
tried again after ``min(2^n, 20)`` seconds.  The number of rows is asked for once, with the first page, unless given.

``path`` is an address that takes ``offset``, ``length``, ``where`` and ``revision``, or a file of JSON lines, of which the
driver notes where pages start and each task reads its own bytes.
"""

from __future__ import annotations

import json
import os
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

MOST_WAIT = 20
#: The row's place in the service's order, for schemas that have such a column.
ROW = "row_idx"
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class _Page(InputPartition):
    def __init__(self, offset: int, length: int, start: int = 0, end: int = 0):
        self.offset, self.length, self.start, self.end = offset, length, start, end


def _literal(x) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else repr(x)


def condition(f: Filter) -> str | None:
    """A pushed filter as the service writes it; null literals, nested columns and places in its order are not pushed."""
    if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] == ROW:
        return None
    name = '"' + f.attribute[0].replace('"', '""') + '"'
    values = f.value if isinstance(f, In) else (f.value,) if type(f) in _SIGNS else None
    if not values or any(not isinstance(v, str | int | float | bool) for v in values):
        return None
    return f"{name} IN ({', '.join(map(_literal, values))})" if isinstance(f, In) else f"{name} {_SIGNS[type(f)]} {_literal(values[0])}"


class _PagedReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.fields = [(f.name, isinstance(f.dataType, T.StringType)) for f in schema.fields]
        self.path, self.page, self.attempts = options["path"], int(options.get("page", 100)), int(options.get("attempts", 5))
        self.first, self.rows = int(options.get("offset", 0)), int(options["rows"]) if "rows" in options else None
        self.revision, self.where = options.get("revision"), []
        self.local = os.path.exists(self.path)

    def _fetched(self, offset: int, length: int) -> dict:
        more = {"offset": offset, "length": length} | ({"where": " AND ".join(self.where)} if self.where else {}) | ({"revision": self.revision} if self.revision else {})
        address = self.path + ("&" if "?" in self.path else "?") + urllib.parse.urlencode(more)
        for attempt in range(self.attempts):
            try:
                with urllib.request.urlopen(address, timeout=60) as answer:
                    found = json.load(answer)
                if self.revision and found.get("revision", self.revision) != self.revision:
                    raise ValueError(f"revision {found['revision']} answered for {self.revision}")
                return found
            except OSError:
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(min(2**attempt, MOST_WAIT))
        raise ValueError("no attempt")

    def partitions(self) -> list[_Page]:
        if self.local:
            return self._local_pages()
        rows = self.rows
        if rows is None or self.where:
            known = self._fetched(self.first, 0)["num_rows_total"] - self.first
            rows = known if rows is None else min(rows, known)
        return [_Page(a, min(self.page, self.first + rows - a)) for a in range(self.first, self.first + max(0, rows), self.page)] or [_Page(0, 0)]

    def _local_pages(self) -> list[_Page]:
        starts, n, at = [], 0, 0
        with open(self.path, "rb") as lines:
            for line in lines:
                if line.strip():
                    if n % self.page == 0:
                        starts.append(at)
                    n += 1
                    if self.rows is not None and n >= self.rows:
                        at += len(line)
                        break
                at += len(line)
        ends = [*starts[1:], at] if starts else []
        return [_Page(i * self.page, self.page, a, b) for i, (a, b) in enumerate(zip(starts, ends, strict=True))] or [_Page(0, 0)]

    def read(self, partition: _Page):
        if self.local:
            with open(self.path, "rb") as file:
                file.seek(partition.start)
                rows = [json.loads(x) for x in file.read(partition.end - partition.start).splitlines() if x.strip()]
            numbered = enumerate(rows, partition.offset)
        else:
            found = self._fetched(partition.offset, partition.length)["rows"] if partition.length else []
            numbered = ((r.get("row_idx", partition.offset + i), r["row"]) for i, r in enumerate(found))
        for number, row in numbered:
            yield tuple(number if name == ROW and name not in row else None if row.get(name) is None else str(row[name]) if text and not isinstance(row[name], str) else row[name] for name, text in self.fields)


class _FilteredReader(_PagedReader):
    """Pushes what the service understands; only used where the session allows that."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            said = condition(f) if not self.local else None
            if said is None:
                yield f
            else:
                self.where.append(said)


class PagedRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def schema(self) -> str:
        return self.options.get("schema", "id string, question string, answer string")

    def reader(self, schema: T.StructType) -> _PagedReader:
        return (_FilteredReader if self.options.get("filters") == "true" else _PagedReader)(schema, self.options)


def read_pages(spark: SparkSession, path: str, rows: int | None, schema: str, page: int = 100, filters: bool = False, revision: str | None = None, offset: int = 0) -> DataFrame:
    """Rows of a paged source; with ``filters``, comparisons go into the requests."""
    if filters:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedRows)
    reader = spark.read.format("paged_rows").schema(schema).option("path", path).option("page", page).option("filters", str(filters).lower()).option("offset", offset)
    for name, value in (("rows", rows), ("revision", revision)):
        reader = reader if value is None else reader.option(name, value)
    return reader.load()


def scan_strata(spark: SparkSession, path: str, schema: str, stratum: str, quotas: dict, total: int, page: int = 100, wave: int = 8, most_rows: int | None = None, revision: str | None = None) -> DataFrame:
    """The first rows of each stratum in the service's order, as many as its quota says.

    Waves of ``wave`` pages are read, each page by one task, until all quotas are filled or ``most_rows`` (or ``total``)
    rows were read; later pages are never asked for.  The schema needs a column ``row_idx``.
    """
    from graphloom.operators.lineage import written

    end = min(total, most_rows if most_rows is not None else total)
    named = spark.createDataFrame(list(quotas.items()), [stratum, "_quota"])  # the caller's list
    order = Window.partitionBy(stratum).orderBy(ROW)
    kept, at = None, 0
    while at < end:
        size = min(wave * page, end - at)
        new = read_pages(spark, path, size, schema, page, revision=revision, offset=at).join(F.broadcast(named), stratum)
        both = new if kept is None else kept.unionByName(new)
        # never more rows than the quotas allow
        kept = written(both.withColumn("_r", F.row_number().over(order)).where("_r <= _quota").drop("_r"), "strata")
        at += size
        if kept.count() >= sum(quotas.values()):
            break
    return (kept if kept is not None else read_pages(spark, path, 0, schema, page).join(named, stratum)).drop("_quota")


def diverse(rows: DataFrame, attributes: tuple[str, ...], order: str, target: int) -> DataFrame:
    """Greedy choice of ``target`` rows with their turn: each next row brings most attribute values not seen yet, the first of several.

    Rows of equal attributes are one candidate, its first row: once it is chosen the others bring nothing.  A turn is one
    aggregation over the candidates against the values seen, at most ``target`` times the number of attributes; once
    nothing new is left, the first rows not chosen fill up.
    """
    from graphloom.operators.lineage import written

    spark = rows.sparkSession
    kinds = written(rows.groupBy(*attributes).agg(F.min(order).alias("_at")), "diverse")
    seen: dict[str, list] = {a: [] for a in attributes}
    picks: list = []
    while len(picks) < target:
        known = {a: F.coalesce(F.array_contains(F.array(*(F.lit(v) for v in seen[a] if v is not None)), F.col(a)), F.lit(None in seen[a])) if any(v is not None for v in seen[a]) else F.col(a).isNull() & F.lit(None in seen[a]) for a in attributes}
        gain = sum((F.when(known[a], 0).otherwise(1) for a in attributes), F.lit(0))
        best = kinds.agg(F.max(F.struct(gain.alias("gain"), (-F.col("_at")).alias("first"), *attributes)).alias("b")).first()["b"]
        if best is None or not best["gain"]:
            break
        picks.append(-best["first"])
        for a in attributes:
            if best[a] not in seen[a]:
                seen[a].append(best[a])
    chosen = spark.createDataFrame([(p, i) for i, p in enumerate(picks)], f"{order} {dict(rows.dtypes)[order]}, turn int")  # at most ``target`` rows
    out = rows.join(F.broadcast(chosen), order)
    if len(picks) < target:
        rest = rows.join(F.broadcast(chosen), order, "left_anti").orderBy(order).limit(target - len(picks))
        out = out.unionByName(rest.withColumn("turn", (F.row_number().over(Window.orderBy(order)) + len(picks) - 1).cast("int")))  # at most ``target`` rows
    return out
