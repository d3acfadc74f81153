"""Paged sources against a service that counts its requests; tables published as one under failures."""

from __future__ import annotations

import json
import random
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from graphloom.operators import publication
from graphloom.sources import paged

SCHEMA = "row_idx long, id string, hops long, name string"
ROWS = [{"id": f"r{i}", "hops": 2 + i % 3, "name": "o'b" if i % 5 == 0 else None} for i in range(240)]


class _Service(BaseHTTPRequestHandler):
    asked: list = []
    failures = 0

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        type(self).asked.append(q)
        if type(self).failures:
            type(self).failures -= 1
            self.send_error(503)
            return
        rows = list(enumerate(ROWS))
        for part in q.get("where", "").split(" AND ") if "where" in q else []:
            column, sign, value = re.match(r'"(\w+)" (=|>=|>|<|<=|IN) (.*)', part).groups()
            want = [int(x) if x.lstrip("-").isdigit() else x.strip("'").replace("''", "'") for x in value.strip("()").split(", ")]
            rows = [(i, r) for i, r in rows if r[column] is not None and {"=": r[column] in want, "IN": r[column] in want, ">": r[column] > want[0] if sign == ">" else None, ">=": r[column] >= want[0] if sign == ">=" else None, "<": r[column] < want[0] if sign == "<" else None, "<=": r[column] <= want[0] if sign == "<=" else None}[sign]]
        at, n = int(q["offset"]), int(q["length"])
        body = json.dumps({"num_rows_total": len(rows), "revision": "abc", "rows": [{"row_idx": i, "row": r} for i, r in rows[at : at + n]]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    _Service.asked, _Service.failures = [], 0
    yield f"http://127.0.0.1:{server.server_port}/rows?dataset=d"
    server.shutdown()


def test_pages_are_read_once_and_tried_again(spark, service):
    _Service.failures = 2
    got = paged.read_pages(spark, service, None, SCHEMA, 50, revision="abc").collect()
    assert sorted(r["row_idx"] for r in got) == list(range(240))
    pages = [q for q in _Service.asked if q["length"] != "0"]
    assert len(_Service.asked) == 5 + 1 + 2 and all(q["revision"] == "abc" for q in pages) and {int(q["offset"]) for q in pages} == {0, 50, 100, 150, 200}
    with pytest.raises(Exception, match="revision abc answered"):
        paged.read_pages(spark, service, 10, SCHEMA, 50, revision="other").collect()


def test_filters_reach_the_service(spark, service):
    rows = paged.read_pages(spark, service, None, SCHEMA, 10, filters=True)
    got = rows.where((F.col("hops") == 3) & (F.col("name") == "o'b") & (F.length("id") > 3)).collect()
    want = [r["id"] for r in ROWS if r["hops"] == 3 and r["name"] and len(r["id"]) > 3]
    assert sorted(r["id"] for r in got) == sorted(want)
    assert all("\"hops\" = 3" in q["where"] and "'o''b'" in q["where"] for q in _Service.asked)
    assert sum(int(q["length"]) for q in _Service.asked) == sum(r["hops"] == 3 and bool(r["name"]) for r in ROWS)
    _Service.asked = []
    assert rows.where(F.col("hops").isin(2, 4) & (F.col("row_idx") > 10)).count() == sum(r["hops"] != 3 and i > 10 for i, r in enumerate(ROWS))
    assert all(q["where"] == '"hops" IN (2, 4)' for q in _Service.asked)


def test_scan_stops_when_quotas_are_filled(spark, service):
    got = paged.scan_strata(spark, service, SCHEMA, "hops", {2: 3, 3: 2}, total=240, page=10, wave=2).collect()
    assert sorted((r["hops"], r["row_idx"]) for r in got) == [(2, 0), (2, 3), (2, 6), (3, 1), (3, 4)]
    assert len({q["offset"] for q in _Service.asked}) == 2 and len(_Service.asked) == 2
    _Service.asked = []
    got = paged.scan_strata(spark, service, SCHEMA, "hops", {9: 1}, total=240, page=10, wave=2, most_rows=45).collect()
    assert got == [] and sorted(int(q["offset"]) for q in _Service.asked) == [0, 10, 20, 30, 40] and sum(int(q["length"]) for q in _Service.asked) == 45


def test_local_pages(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps(r) + ("\n" if i % 7 == 0 else "") for i, r in enumerate(ROWS)))
    rows = paged.read_pages(spark, str(tmp_path / "p.jsonl"), None, SCHEMA, 100)
    got = rows.collect()
    assert [(r["row_idx"], r["id"]) for r in sorted(got)] == [(i, r["id"]) for i, r in enumerate(ROWS)] and rows.rdd.getNumPartitions() == 3
    (tmp_path / "e.jsonl").write_text("")
    assert paged.read_pages(spark, str(tmp_path / "e.jsonl"), None, SCHEMA).collect() == []


def greedy(rows, attributes, target):
    left, seen, out = list(rows), set(), []
    while left and len(out) < target:
        best = max(left, key=lambda r: (sum((a, r[a]) not in seen for a in attributes), -r["n"]))
        left.remove(best)
        seen |= {(a, best[a]) for a in attributes}
        out.append(best["n"])
    return out


def test_diverse_choice_equals_the_plain_loop(spark):
    rng = random.Random(4)
    names = ("a", "b", "c")
    rows = [{"n": i, "a": rng.choice([None, 1, 2, 3, 4]), "b": rng.choice("pqrstu"), "c": rng.randrange(9)} for i in range(2000)]
    df = spark.createDataFrame([(r["n"], r["a"], r["b"], r["c"]) for r in rows], "n long, a int, b string, c int")
    for target in (3, 12, 30):
        got = [r["n"] for r in paged.diverse(df, names, "n", target).orderBy("turn").collect()]
        assert got == greedy(rows, names, target)
    assert paged.diverse(df.where("false"), names, "n", 3).collect() == []


def _table(spark, *rows):
    return spark.createDataFrame(list(rows), "k int, v string")


def test_all_tables_or_none(spark, tmp_path):
    p = publication.Publication(spark, f"file://{tmp_path}/pub")
    assert p.version() == 0 and p.tables() == {}
    keys = {"a": ["k"], "b": ["k"]}
    assert p.upsert({"a": _table(spark, (1, "x")), "b": _table(spark, (1, "x"))}, keys, "one") == 1

    def fails(stored):
        bad = _table(spark, (1, "y")).select("k", F.raise_error(F.lit("broken between tables")).cast("string").alias("v"))
        return {"a": _table(spark, (1, "y")), "b": bad}

    with pytest.raises(Exception, match="broken between tables"):
        p.publish(fails, "two")
    seen = lambda: {n: sorted(map(tuple, t.collect())) for n, t in p.tables().items()}
    assert p.version() == 1 and seen() == {"a": [(1, "x")], "b": [(1, "x")]}
    made = {"a": _table(spark, (1, "y"), (2, "z")), "b": _table(spark, (3, "w"))}
    assert p.upsert(made, keys, "two") == 2
    want = {"a": [(1, "y"), (2, "z")], "b": [(1, "x"), (3, "w")]}
    assert seen() == want and p.upsert({"a": _table(spark, (1, "again"))}, keys, "two") == 2 and seen() == want
    assert sorted(map(tuple, p.tables(1)["a"].collect())) == [(1, "x")]


def test_writers_race(spark, tmp_path):
    """The slower of two writers starts again from the other's version; nothing is lost."""
    p = publication.Publication(spark, f"file://{tmp_path}/pub")
    p.upsert({"a": _table(spark, (1, "x"))}, {"a": ["k"]}, "zero")
    calls = []

    def slow(stored):
        calls.append(1)
        if len(calls) == 1:
            p.upsert({"a": _table(spark, (2, "other"))}, {"a": ["k"]}, "fast")
        return {"a": stored["a"].unionByName(_table(spark, (3, "slow")))}

    assert p.publish(slow, "slow") == 3 and len(calls) == 2
    assert sorted(map(tuple, p.tables()["a"].collect())) == [(1, "x"), (2, "other"), (3, "slow")]
    assert p.vacuum(keep=1) == 3 and p.tables()["a"].count() == 3
    with pytest.raises(publication.Conflict):
        p._create(3, {"tables": {}, "batches": []})
