from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from graphloom.operators import audit, controller, discovery, extraction, graph, navigation, projection, retrieval, sinks
from graphloom.plans import planner
from graphloom.sources import paged, readers
from graphloom.streaming import fold


def facts(spark, rows):
    return spark.createDataFrame([(f"r{i}", i, u, x) for i, (u, x) in enumerate(rows)], "record_id string, record_index int, user_id string, label string")


def test_plans(spark):
    f = facts(spark, [("45", "ham"), ("45", "spam"), ("7", "spam"), ("45", "ham")])
    got = planner.answer("How many instances of user 45 are labelled ham?", f).first()
    assert (got["status"], got["answer"], got["records"]) == ("complete", "Answer: 2", ["r0", "r3"])
    assert planner.answer("Which user is the second most frequent?", f).first()["value"] == "7"
    assert planner.answer("Which user is the third most frequent?", f).first()["status"] == "insufficient_facts"
    assert planner.answer("Is label: ham more frequent before or after 2020-01-01?", f).first()["status"] == "unsupported"
    assert planner.answer("Tell me a story", f).first()["status"] == "unsupported"


def test_ties_and_missing_labels(spark):
    f = facts(spark, [("1", "ham"), ("2", "spam")])
    assert planner.answer("Which label is most common?", f).first()["value"] == "spam"
    assert planner.answer("Which label is least common?", f).first()["value"] == "ham"
    g = facts(spark, [("1", "ham"), ("10", None), ("9", None)])
    assert planner.answer("How many records of user 1 are ham?", g).first()["status"] == "insufficient_facts"
    assert planner.answer("Which user is the second most frequent?", g).first()["value"] == "10"


def test_upsert_is_idempotent(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, created string, v string")
    n = spark.createDataFrame([(2, "c", "z"), (3, "d", "w")], "k int, created string, v string")
    once = sinks.upsert(t, n, ["k"], insert_only=("created",))
    assert sorted(map(tuple, once.collect())) == [(1, "a", "x"), (2, "b", "z"), (3, "d", "w")]
    assert sorted(map(tuple, sinks.upsert(once, n, ["k"], insert_only=("created",)).collect())) == sorted(map(tuple, once.collect()))


def test_versions(spark):
    s = spark.createDataFrame([("a", "h1", "active", 1)], "k string, content_hash string, status string, at int")
    n = spark.createDataFrame([("a", "h2", 2), ("b", "h3", 2)], "k string, content_hash string, at int")
    out = sinks.new_version(s, n, "k")
    assert sorted((r["k"], r["content_hash"], r["status"]) for r in out.collect()) == [("a", "h1", "deprecated"), ("a", "h2", "active"), ("b", "h3", "active")]
    assert sinks.new_version(out, n, "k").count() == 3
    assert {r["content_hash"] for r in sinks.active_snapshot(out, "k", "at").collect()} == {"h2", "h3"}


def test_resume(spark):
    chunks = spark.createDataFrame([("d", 0, "h0"), ("d", 1, "h1"), ("d", 2, "h2")], "document_id string, index int, content_hash string")
    ledger = spark.createDataFrame([("d", 0, "h0", "DONE"), ("d", 1, "old", "DONE"), ("d", 2, "h2", "FAILED")], "document_id string, index int, content_hash string, status string")
    redo = lambda mode: sorted(r["index"] for r in sinks.to_redo(chunks, ledger, mode).collect())
    assert (redo("overwrite"), redo("resume"), redo("append")) == ([0, 1, 2], [1, 2], [])


def test_pairs(spark):
    a = spark.createDataFrame([(1, "x", "A", "a", "agent"), (1, "y", "B", "b", "patient"), (1, "z", None, "c", "witness")], "event_id int, argument_id string, entity_id string, surface string, role string")
    r = graph.pair_snapshots(a).first()
    assert (r["source"], r["target"], r["shared"], r["forward"], r["backward"]) == ("A", "B", 1, 1, 0)
    c = {r["argument_id"]: (r["counterparts"], r["unresolved"]) for r in graph.counterparts(a).collect()}
    assert c["x"] == (["B"], ["c"])


def test_arbitration(spark):
    schema = "k int, answer string, confidence double, evidence array<string>, contradictions array<string>"
    g = spark.createDataFrame([(1, "g", 0.8, ["e"], []), (2, "g", 0.8, ["e"], []), (3, None, 0.0, [], []), (4, "g", 0.8, ["e"], ["!"])], schema)
    t = spark.createDataFrame([(1, "t", 0.5, ["f", "e"], []), (2, None, 0.0, [], []), (3, None, 0.0, [], []), (4, "t", 0.5, ["f"], [])], schema)
    got = {r["k"]: r for r in retrieval.arbitrate(g, t, "k").collect()}
    assert got[1]["status"] == "both_supported" and got[1]["answer"] == "g\nt" and got[1]["evidence"] == ["e", "f"]
    assert got[2]["status"] == "graph_supported_text_unconfirmed" and got[2]["confidence"] == pytest.approx(0.68)
    assert got[3]["status"] == "insufficient_evidence" and got[4]["status"] == "contradiction" and got[4]["confidence"] == 0.5


def claim(spark):
    claims = spark.createDataFrame([(1, 0, 100)], "claim int, contradictions int, tokens long")
    sub = spark.createDataFrame([(1, i, f"s{i}", [f"e{i}"], ["f1", f"g{i}"], audit_modes) for i, audit_modes in ((1, [audit.SHARED, audit.QUERY]), (2, [audit.SHARED]), (3, [audit.SHARED]))], "claim int, pos int, sub string, evidence array<string>, facts array<string>, modes array<string>")
    edges = spark.createDataFrame([(1, 1, "a", "s1", "s2", "f1"), (1, 2, "b", "s2", "s3", "f1")], "claim int, pos int, edge_id string, source string, target string, fact string")
    return claims, sub, edges


def test_audit_modes(spark):
    got = {r["mode"]: r for r in audit.audit_all(*claim(spark)).collect()}
    assert got[audit.SHARED]["complete"] and got[audit.SHARED]["outcome"] == "useful" and got[audit.SHARED]["edges"] == 2
    assert got[audit.QUERY]["verified"] == 1 and got[audit.FLAT]["recall"] < 1 and got[audit.FLAT]["outcome"] == "neutral"
    assert got[audit.SHUFFLED]["verified"] == 1 and got[audit.NO_EDGES]["verified"] == 1
    assert not got[audit.MASKED]["complete"]


def test_discovery(spark):
    rows = spark.createDataFrame([(c, i, f"sc_{i}", f"fact number{c}{i} holds {x}") for c in (1, 2) for i, x in ((1, "towers"), (2, "rivers"), (3, "castles"), (4, "harbours"))], "claim int, pos int, sub string, text string")
    sub = discovery.prepared(rows)
    got = {(m, r["claim"]): r for m in discovery.MODES for r in discovery.run(sub, m).collect()}
    assert got["iterative", 1]["complete"] and got["iterative", 1]["recovery"] == 1.0
    assert not any(got[m, 2]["complete"] for m in discovery.MODES)
    assert not any(r["false_complete"] for r in got.values())
    assert got["iterative", 1]["recovery"] >= got["single", 1]["recovery"] and got["guided", 2]["useful_rate"] < 1


def docs(spark):
    rows = [("d1", "A", ["A"], ["e1"], ["x1"], [1.0, 0.0]), ("d2", "B", ["A", "B"], ["e1"], ["x2"], [0.9, 0.1]), ("d3", "C", ["C"], ["e2"], ["x2"], [0.0, 1.0]), ("d4", "D", ["D"], ["e9"], [], [0.5, 0.5])]
    return spark.createDataFrame([(i, o, "entity", en, ev, sp, v) for i, o, en, ev, sp, v in rows], "doc_id string, owner_id string, owner_type string, entities array<string>, events array<string>, evidence array<string>, v array<double>")


def test_frontier_and_navigation(spark):
    d = docs(spark)
    f = navigation.frontier(d, d.where("doc_id = 'd1'"), 5).collect()
    assert [(r["doc_id"], r["structural"]) for r in f] == [("d2", 5)]
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, v array<double>")
    seeds = spark.createDataFrame([(1, "d1", 1.0)], "query_id int, doc_id string, score double")
    out = {r["depth"]: r["doc_id"] for r in navigation.navigate(d, q, seeds).collect()}
    assert out == {0: "d1", 1: "d2", 2: "d3"}


def test_path_expansion(spark):
    t = spark.createDataFrame([("A", "B", ["r1"], ["e1"], ["x1"], 0.8, [1.0, 0.0]), ("B", "C", ["r2"], [], ["x2"], 0.5, [0.0, 1.0])], "source string, target string, relations array<string>, events array<string>, evidence array<string>, confidence double, v array<double>")
    seeds = spark.createDataFrame([(1, "A", 0.9)], "query_id int, entity string, score double")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, v array<double>")
    out = navigation.expand_paths(t, seeds, q).collect()
    assert [r["path"] for r in out][0] == ["A", "B"] and {tuple(r["path"]) for r in out} == {("A", "B"), ("A", "B", "C")}
    assert next(r for r in out if len(r["path"]) == 3)["evidence"] == ["x1", "x2"]


def _asked(spark, d, policy, *seeds):
    q = spark.createDataFrame([(i, "q") for i in range(1, 1 + max(1, len(seeds)))], "query_id int, query string")
    at = spark.createDataFrame([(i, s, 0.5) for i, s in enumerate(seeds, 1)], "query_id int, doc_id string, score double")
    return {r["query_id"]: r for r in controller.run(d, q, at.join(d.select("doc_id", "owner_type"), "doc_id"), policy).collect()}


def _script(spark, *rows):
    """(query, turn, action, transitions, subquery, summary)."""
    return controller.scripted(spark.createDataFrame([(*r, 0.5, None) for r in rows], "query_id int, turn int, action string, transitions array<string>, subquery string, summary string, confidence double, gap string"))


def test_controller(spark):
    d = docs(spark)
    s = _asked(spark, d, controller.greedy, "d1")[1]
    assert s["docs"] == ["d1", "d2", "d3"] and s["evidence"] == ["x1", "x2"] and s["stop"] == "insufficient_evidence"
    s = _asked(spark, d, _script(spark, (1, 0, "expand", ["__first__"], None, None), (1, 1, "answer", None, None, "yes"), (2, 0, "expand", ["__target_owner__:C"], None, None)), "d1", "d2")
    assert s[1]["answer"] == "yes" and s[1]["trace"][-1]["action"] == "answer" and s[2]["docs"] == ["d2", "d3"]
    for action, transitions in (("expand", ["nowhere"]), ("expand", []), ("reformulate", None)):
        with pytest.raises(Exception, match="frontier|names no transition|no subquery"):
            _asked(spark, d, _script(spark, (1, 0, action, transitions, None, None)), "d1")
    assert _asked(spark, d, controller.greedy, "none")[1]["stop"] == "no_seed"


def test_controller_budgets_and_repeats(spark):
    d = docs(spark)
    q, at = spark.createDataFrame([(1, "q")], "query_id int, query string"), spark.createDataFrame([(1, "d1", 1.0, "entity")], "query_id int, doc_id string, score double, owner_type string")
    s = controller.run(d, q, at, _script(spark, *((1, i, "verify", None, None, None) for i in range(9))), controller.Budget(calls=2)).first()
    assert s["stop"] == "model_call_budget_exhausted" and s["calls"] == 0 and len(s["trace"]) == 2
    one = controller.run(d, q, at, _script(spark, (1, 0, "expand", ["__first__"], None, None)), controller.Budget(expansions=0)).first()
    assert one["stop"] == "expansion_budget_exhausted" and one["docs"] == ["d1", "d2"]
    one = controller.run(d, q, at, controller.greedy, controller.Budget(depth=1)).first()
    assert one["stop"] == "max_depth_reached" and one["answer"] is None
    # evidence shown once is left out of the next look, and counted
    s = _asked(spark, d, _script(spark, (1, 0, "inspect", None, None, None), (1, 1, "stop", None, None, None)), "d1")[1]
    assert [t["omitted"] for t in s["trace"]] == [0, 1] and s["presented"] == ["x2"]
    guarded = controller.guarded(_script(spark, (1, 0, "expand", ["lost"], None, "go"), (1, 1, "answer", None, None, "thin"), (1, 2, "inspect", None, None, None), (1, 3, "inspect", None, None, None)))
    s = _asked(spark, d, guarded, "d1")[1]
    assert [t["action"] for t in s["trace"]] == ["expand", "answer"] and s["answer"] == "thin"
    none = d.where("doc_id = 'd4'")
    s = _asked(spark, none, controller.guarded(_script(spark, (1, 0, "expand", [], None, ""), (1, 1, "answer", None, None, "thin"))), "d4")[1]
    assert [t["action"] for t in s["trace"]] == ["verify", "reformulate", "stop"] and s["subquery"] == "q"
    assert controller.last_answer(controller.run(d, q, at, guarded)).first()["step"]["action"] == "answer"


def _extracted(spark, *texts):
    rows = [(f"c{i}", 1, i, t) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id long, index int, text string")
    return chunks, extraction.extract(chunks)


def test_grounding_branches(spark):
    chunks, made = _extracted(spark, "Ann saw the old man. Then Ann met him.", "He saw it.", "", None, "Ann Lee met Bob Ray. He was old.", "Однако saw him. Anna Li was in town. She left.")
    by = {(r["chunk_id"], r["n"]): r["text"] for r in made["mentions"].collect()}
    said = {}
    for r in made["hypotheses"].collect():
        said.setdefault(r["chunk_id"], []).append((by[r["chunk_id"], r["n"]], r["status"], r["reason"]))
    assert ("Ann", "confirmed", extraction.ANCHORED) in said["c0"]
    assert ("the old man", "rejected", extraction.CONFLICT) in said["c0"] and ("the old man", "likely", extraction.DISTINCT) in said["c0"]
    assert {x[2] for x in said["c1"]} == {extraction.NO_ANCHOR}
    assert ("He", "unresolved", extraction.AMBIGUOUS) not in said["c1"] and "c2" not in said and "c3" not in said
    assert ("He", "unresolved", extraction.AMBIGUOUS) in said["c4"]
    assert ("Однако", "rejected", extraction.MARKER) in said["c5"] and ("She", "likely", extraction.SINGLE) in said["c5"]
    state = {(r["chunk_id"], r["predicate"]): r["resolution"] for r in made["events"].collect()}
    assert state["c0", "saw"] == "complete" and state["c1", "saw"] == "unresolved"
    assert made["relations"].where("chunk_id = 'c0'").count() == 2 and extraction.invalid_spans(made["mentions"], chunks).count() == 0


def test_same_surface_takes_the_earliest_entity(spark):
    _, made = _extracted(spark, "Ann Lee is here. The dog was old. Bob Ray saw the dog. The dog is big.")
    rows = made["hypotheses"].orderBy("n").collect()
    dogs = [r for r in rows if r["n"] in {m["n"] for m in made["mentions"].where("normal = 'dog'").collect()}]
    last = [r for r in dogs if r["reason"] == extraction.SAME_SURFACE]
    first = next(r for r in dogs if r["entity_id"] and r["status"] == "likely")
    assert last and last[-1]["entity_id"] == first["entity_id"]


def test_repairs_and_fallback(spark):
    chunks = spark.createDataFrame([("c", 1, "Ann met Bob in Rome, Ann")], "chunk_id string, doc_id long, text string")
    said = spark.createDataFrame([("c", "ann", 99, 120, None), ("c", "Bob", 8, 11, "named"), ("c", "Bob", 0, 3, "named"), ("c", "Zed", 0, 3, "named"), ("c", " ", 0, 1, None)], "chunk_id string, text string, start int, end int, kind string")
    fixed = extraction.repaired_mentions(said, chunks)
    assert {(r["text"], r["start"], r["end"], r["kind"]) for r in fixed.collect()} == {("Ann", 0, 3, "nominal"), ("Bob", 8, 11, "named")}
    links = spark.createDataFrame([("c", "ann", " Met ", "BOB"), ("c", "Ann", "met", "Bob"), ("c", "Ann", "is", "Ann"), ("c", "Ann", "saw", "Zed")], "chunk_id string, source string, predicate string, target string")
    assert [(r["source_start"], r["predicate"], r["target_start"]) for r in extraction.repaired_relations(links, fixed).collect()] == [(0, "met", 8)]
    quiet = spark.createDataFrame([("q", 1, "Well. Ann and Bob, then Cid Moe."), ("v", 1, "Ann saw Bob.")], "chunk_id string, doc_id long, text string")
    assert [(r["chunk_id"], r["agent"], r["patient"]) for r in extraction.fallback_frames(extraction.words(quiet)).collect()] == [("q", "Ann", "Bob")]


def test_snapshots(spark):
    m = spark.createDataFrame([("e", "Ann", "Ann", 1), ("e", "Ann", "she", 2)], "entity_id string, name string, alias string, at int")
    o = spark.createDataFrame([("e", "ev1", "agent", ["f"], "x1", 1, ["thing"]), ("e", "ev2", "agent", ["f", "g"], "x2", 2, [])], "entity_id string, event_id string, role string, counterparts array<string>, evidence_id string, at int, unresolved array<string>")
    s = projection.entity_snapshots(m, o)
    r = s.first()
    assert r["aliases"] == ["Ann", "she"] and r["events"] == ["ev1", "ev2"] and r["counterparts"] == ["f", "g"]
    assert projection.semantic_documents(s, o).groupBy("owner_type").count().collect() and projection.semantic_documents(s, o).count() == 1 + 2 + 1


def test_stream_fold_equals_batch(spark, tmp_path):
    rows = [(1, 0, "c0", ["a", "b"]), (1, 1, "c1", ["b"]), (1, 2, "c2", ["c", "a"]), (2, 0, "k0", ["z"])]
    schema = "doc_id long, index int, chunk_id string, entities array<string>"
    spark.createDataFrame([rows[2], rows[0], rows[3]], schema).coalesce(1).write.json(str(tmp_path / "in"), mode="append")
    spark.createDataFrame([rows[1]], schema).coalesce(1).write.json(str(tmp_path / "in"), mode="append")
    stream = fold.stream_fold(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("folded").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("folded").select("doc_id", "index", "added", "updated", "known", "recent").collect()))
    assert got == sorted(map(tuple, fold.batch_fold(spark.createDataFrame(rows, schema)).collect()))


def test_readers(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>')
    assert readers.read_docx(spark, str(tmp_path / "a.docx")).first()["text"] == "One two\n\nThree"
    lines = [{"id": "2hop__1", "question": "q", "answer": "a", "answer_aliases": ["b"], "paragraphs": [{"idx": 0, "title": "T", "paragraph_text": "x", "is_supporting": True}, {"idx": 1, "title": "U", "paragraph_text": "y", "is_supporting": False}]}]
    (tmp_path / "c.jsonl").write_text("\n".join([json.dumps(lines[0]), "", ""]))
    r = readers.read_cases(spark, str(tmp_path / "c.jsonl"), "paragraphs").collect()
    assert len(r) == 1 and r[0]["hops"] == 2 and r[0]["gold_evidence"] == ["para_0"] and r[0]["answers"] == ["a", "b"]
    assert "secret code is x-0001" in readers.needle_cases(spark, 2, 10, "x").where("task_id = 'x_1'").first()["context"]
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps({"id": i, "question": f"q{i}", "answer": None}) for i in range(25)))
    pages = paged.read_pages(spark, str(tmp_path / "p.jsonl"), 25, "id string, question string, answer string", 10)
    assert pages.count() == 25 and pages.rdd.getNumPartitions() == 3
    quota = readers.first_per_stratum(spark.createDataFrame([(2, i) for i in range(5)] + [(3, i) for i in range(5)], "h int, i int"), "h", "i", {2: 2, 3: 1})
    assert sorted(map(tuple, quota.collect())) == [(2, 0), (2, 1), (3, 0)]
    few = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "n int, a int")
    assert [x["n"] for x in paged.diverse(few, ("a",), "n", 2).orderBy("turn").collect()] == [1, 3]
    with pytest.raises(ValueError):
        readers.require_quota(spark.createDataFrame([("x",)], "b string"), "b", 2, ("x", "y"))


def test_claims_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('ind,claim,sub_claims,labels,aggregated_label\n1,C,"[\'it is x\', \'y\']","[True, False]",True\n')
    r = readers.read_claims(spark, str(tmp_path / "c.csv")).first()
    assert r["sub_claims"] == ["it is x", "y"] and r["labels"] == ["true", "false"] and r["supported"]


def test_fixed_point_and_windows(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "d", "c")], "g int, a string, b string")
    seeds = spark.createDataFrame([(1, "a")], "g int, node string")
    allowed = spark.createDataFrame([(1, x) for x in "abd"], "g int, node string")
    assert {r["node"] for r in graph.reached(e, seeds, allowed, ["g"]).collect()} == {"a", "b"}
    assert {r["target"]: r["hops"] for r in navigation.shortest_paths(e, spark.createDataFrame([("a",)], "source string"), spark.createDataFrame([("c",), ("d",)], "target string")).collect()} == {"c": 2, "d": 3}
    rows = spark.createDataFrame([(1, i, f"t{i}") for i in range(4)], "p int, i int, v string")
    assert graph.ring(rows, "p", "i", "v", 2).orderBy("i").collect()[-1]["ring"] == ["t2", "t3"]
    assert [r["start"] for r in graph.running_offsets(rows, "p", "i", "v").orderBy("i").collect()] == [0, 3, 6, 9]
    assert retrieval.window(rows, rows.where("i = 1"), "p", "i", 1, 1).count() == 3


def test_rank_limits(spark):
    d = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, ["z"])], "doc_id int, terms array<string>")
    q = spark.createDataFrame([(9, ["a", "b"])], "query_id int, terms array<string>")
    assert [r["doc_id"] for r in retrieval.keyword_topk(d, q, 3).orderBy("rank").collect()] == [1, 2, 3]
    assert [(r["doc_id"], r["score"]) for r in retrieval.text_search(d, q, 3).orderBy("rank").collect()] == [(1, 1.0), (2, 0.5)]
    first = retrieval.first_presented(spark.createDataFrame([("s", "e", 1), ("s", "e", 2)], "s string, e string, i int"), ["s"], "e", ["i"])
    assert [r["i"] for r in first.collect()] == [1]
    assert spark.range(1).select(retrieval.overlap_share(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))).alias("x")).first()["x"] == 0.5
