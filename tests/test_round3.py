"""Faults of the third review."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from graphloom.functions import ids
from graphloom.operators import extraction
from graphloom.plans import catalog


def _tables(spark, folder, **rows):
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _same(spark, folder, name):
    """Rows of a query and of its SQL over the same tables."""
    con = duckdb.connect()
    import os

    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}/*.parquet'")
    want = con.execute(catalog.SQL[name]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES[name](spark, folder).collect()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


def test_claim_pairs_outlive_clashing_ids(spark, monkeypatch):
    monkeypatch.setattr(ids, "short_id", lambda prefix, parts: F.lit(f"{prefix}_same"))
    claims = spark.createDataFrame([("c", "1", "", 0.5, ["a", "b", "a"]), ("c", "1", "", 0.5, ["a", "b"])], "chunk_id string, claim_id string, text string, confidence double, subjects array<string>")
    assert sorted((r.source_entity_id, r.target_entity_id) for r in extraction.claim_pairs(claims).collect()) == [("a", "b"), ("b", "a")]


_LINE = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string"
_ORDER = "o_orderkey long, o_custkey long, o_orderdate timestamp"


def _orders(spark, folder):
    from datetime import datetime

    orders = [(k, k % 4, datetime(2024, 1, 1 + k % 3)) for k in range(120)]
    # lines 1 of an order stand twice: with one flag, and with two
    lines = [(k, n, (k * 7 + n) % 30, (k + 3 * n) % 5, "RNA"[(k + n) % 3]) for k in range(0, 120, 1) for n in (1, 2)]
    lines += [(k, 1, (k * 5) % 30, k % 5, "RNA"[(k + k % 2) % 3]) for k in range(0, 120, 2)]
    vectors = [(i, [float(1 + i % 7), float(i % 5), 1.0 + i / 500]) for i in range(500)]
    return _tables(spark, folder, orders=(orders, _ORDER), lineitem=(lines, _LINE), embeddings=(vectors, "vec_id long, embedding array<float>"))


def test_dual_runtime_with_repeated_line_numbers(spark, tmp_path):
    assert _same(spark, _orders(spark, tmp_path), "dual_runtime")


def _vectors(spark):
    """Ties, a zero vector, a null one, one with a null and one of another width."""
    rows = [(i, [float(i % 7), float(i % 5) - 2, 1.0]) for i in range(400)] + [(400, [0.0, 0.0, 0.0]), (401, None), (402, [1.0, None, 2.0]), (403, [1.0])]
    return spark.createDataFrame(rows, "vec_id long, v array<double>")


def test_nearest_is_all_pairs_without_a_nested_loop_of_them(spark):
    from graphloom.functions import vector
    from graphloom.operators import arms, retrieval

    v = _vectors(spark)
    asked = v.where("vec_id % 50 = 0 OR vec_id > 400")
    visited = asked.select(F.col("vec_id").alias("query_id")).crossJoin(v.where("vec_id % 3 = 1").select("vec_id"))
    pairs = asked.select(F.col("vec_id").alias("query_id"), vector.normalized(F.col("v")).alias("q")).crossJoin(v.select("vec_id", vector.normalized(F.col("v")).alias("v"))).where("query_id <> vec_id")
    every = pairs.select("query_id", "vec_id", F.round(vector.dot(F.col("q"), F.col("v")), 6).alias("score"))
    for found, among in ((retrieval.dense_topk(v, asked, 7), every), (retrieval.dense_topk(v, asked, 7, visited=visited), every.join(visited, ["query_id", "vec_id"], "left_anti"))):
        want = retrieval.best(among, ["query_id"], [F.desc("score"), "vec_id"], 7).select("query_id", "vec_id", "rank", "score")
        assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    named = v.select(F.col("vec_id").cast("string").alias("entity"), "v")
    q = asked.withColumnRenamed("vec_id", "query_id")
    plain = named.crossJoin(q.select("query_id", F.col("v").alias("q"))).select("query_id", "entity", vector.cosine(F.col("q"), F.col("v")).alias("score"))
    want = retrieval.best(plain, ["query_id"], [F.desc(F.round("score", 9)), "entity"], 3)
    got = arms.locate(named, q).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # of ordinary vectors no pair is a row: nothing but what can't be multiplied meets in a nested loop
    plan = retrieval.dense_topk(v, asked, 7)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan


def test_event_pairs_and_title_counts_meet_without_all_pairs(spark):
    from graphloom.operators import graph

    rows = [("e", "1", "x", "s1", "agent"), ("e", "1", "x", "s1", "location"), ("e", "2", "y", "s2", "patient"), ("e", "3", None, "s3", "place"), ("e", None, "z", "s4", "agent"), (None, "5", "x", "s", "agent"), ("f", "1", "y", "s", "speaker"), ("f", "2", "x", "s", None), ("f", "2", "x", "s", "target")]
    a = spark.createDataFrame(rows, "event_id string, argument_id string, entity_id string, surface string, role string")
    pairs = graph.pair_snapshots(a)
    assert sorted(map(tuple, pairs.collect())) == [("x", "y", 2, 1, 1, ["e", "f"]), ("x", "z", 1, 0, 0, ["e"]), ("y", "z", 1, 0, 1, ["e"])]
    assert "Expand" not in pairs._jdf.queryExecution().executedPlan().toString()
    got = {(r.event_id, r.argument_id): (r.counterparts, r.unresolved) for r in graph.counterparts(a).collect()}
    assert got == {("e", "1"): (["y"], ["s3"]), ("e", "2"): (["x"], ["s3"]), ("e", "3"): (["x", "y"], []), ("f", "1"): (["x"], []), ("f", "2"): (["y"], [])}
    assert sorted(map(tuple, graph.shared_places(a).collect())) == [("x", "y", "s3"), ("x", "z", "s3"), ("y", "z", "s3"), ("y", "z", "x")]
    titles = [(1, 1, "ABCD", "has abcd and efgh"), (1, 2, "efgh", "abcd abcd"), (1, 2, "abcd", "nothing"), (1, 3, "abc", "abc"), (1, 4, None, None), (2, 1, "abcd", "abcd")]
    t = spark.createDataFrame(titles, "c int, row_id int, title string, text string")
    links = graph.title_links(t, "c", "title", "text")
    plain = [(c, i, j) for c, i, _, x in titles for e, j, u, _ in titles if c == e and i != j and x and u and len(u) >= 4 and u.lower() in x.lower()]
    assert sorted(map(tuple, links.collect())) == sorted(plain)
    assert [tuple(r) for r in graph.title_link_counts(t, "c", "title", "text").collect()] == [(1, len(plain))]


def test_bounded_lists_lose_nothing(spark, monkeypatch):
    """Hot keys alone, in pairs and in threes, ties and rare keys: as by all pairs."""
    import random

    from graphloom.operators import inverted, navigation

    r = random.Random(7)
    rows = [(i, [f"a{r.randrange(3)}", f"b{r.randrange(2)}", f"r{r.randrange(60)}", None], [f"d{i % 2}"], [f"x{r.randrange(4)}", f"y{i % 3}"]) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, entities array<string>, events array<string>, evidence array<string>")
    current = docs.where("doc_id % 5 = 0")
    want = navigation.best(navigation.frontier(docs, current, None), ["from_id"], [F.desc("structural"), "doc_id"], 4)
    index = inverted.lists(navigation._postings(docs, "doc_id"), 4, longest=8)
    assert len(index.sets) >= 2
    got = navigation.frontier(docs, current, 4, index)
    order = ["from_id", "rank", "doc_id", "structural"]
    assert sorted(map(tuple, got.select(*order).collect())) == sorted(map(tuple, want.select(*order).collect()))
    # a list is whole if it is short, and k + 1 long if not
    assert index.table.groupBy("list").count().agg(F.max("count")).first()[0] <= 8


def test_text_search_by_bounded_lists(spark, monkeypatch):
    from graphloom.operators import inverted, retrieval

    monkeypatch.setattr(inverted.lists, "__defaults__", (6,))
    docs = spark.createDataFrame([(i, [f"a{i % 2}", f"b{i % 3}", f"c{i % 4}", f"r{i}"]) for i in range(100)], "doc_id long, terms array<string>")
    queries = spark.createDataFrame([(q, [f"a{q % 2}", f"b{q % 3}", f"c{q % 4}", f"r{9 * q}", "none"]) for q in range(9)], "query_id long, terms array<string>")
    order = ["query_id", "rank", "doc_id", "overlap", "score"]
    assert sorted(map(tuple, inverted.text_search(docs, queries, 5).select(*order).collect())) == sorted(map(tuple, retrieval.text_search(docs, queries, 5).select(*order).collect()))


def test_shortest_paths_from_many_sources_at_once(spark):
    """More sources than a word has bits, with a cycle, a branch and a part of its own."""
    from graphloom.operators import navigation

    edges = [(f"n{i}", f"n{(i + 1) % 90}") for i in range(90)] + [("n3", "n40"), ("x", "y"), ("y", "y")]
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = set()
    for s in [f"n{i}" for i in range(80)] + ["x", "lone"]:
        seen, now = {s}, {s}
        for hop in range(1, 4):
            now = {b for a in now for b in near.get(a, ())} - seen
            seen |= now
            want |= {(s, t, hop) for t in now if t != "n7"}
    e = spark.createDataFrame(edges, "a string, b string")
    sources = spark.createDataFrame([(f"n{i}",) for i in range(80)] + [("x",), ("lone",), ("n5",), (None,)], "source string")
    targets = e.select(F.explode(F.array("a", "b")).alias("target")).where("target <> 'n7'")
    got = navigation.shortest_paths(e, sources, targets, 3)
    assert got._jdf.queryExecution().analyzed().toString().count("pack") > 0  # a row holds many sources
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_coreference_takes_k_of_equal_entities(spark):
    from graphloom.operators import context

    terms = [["a", "b"], ["b", "a"], ["a"], ["b", "c"], ["c"]]
    entities = [(i, i % 2, terms[i % 5]) for i in range(200)]
    asked = [(m, m % 2, terms[m % 5] + (["zz"] if m % 3 else [])) for m in range(12)]
    e = spark.createDataFrame(entities, "entity_id long, document_id long, terms array<string>")
    got = context.coreference_candidates(spark.createDataFrame(asked, "mention_id long, document_id long, terms array<string>"), e, 3)
    want = []
    for m, d, t in asked:
        scored = sorted((-(1.5 * len(set(t) & set(u)) / len(u) + 0.5 * (d == f)), i) for i, f, u in entities if set(t) & set(u))
        want += [(m, i, round(-s, 9), r) for r, (s, i) in enumerate(scored[:3], 1)]
    assert sorted((r.mention_id, r.entity_id, round(r.score, 9), r["rank"]) for r in got.collect()) == sorted(want)
    # of entities that score alike only k are met: a rank before the join and one after
    assert got._jdf.queryExecution().analyzed().toString().count("row_number()") >= 2


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_discovery_sends_only_subclaims_for_all_modes(spark):
    from graphloom.operators import discovery

    rows = spark.createDataFrame([(c, p, f"sc_{p}", t) for c in (1, 2, 15) for p, t in ((1, "green box 7"), (2, "required distractor 12"), (3, "evidence about 3"), (4, ""))], "claim long, pos int, sub string, text string")
    run = discovery.run(discovery.prepared(rows), *discovery.MODES)
    assert _shuffles(run) == 1
    assert {(r.claim, r.mode) for r in run.collect()} == {(c, m) for c in (1, 2, 15) for m in discovery.MODES}


def test_discovery_is_its_sql_with_repeated_lines(spark, tmp_path):
    folder = _orders(spark, tmp_path)
    # names with the lead's and the distractors' words and numbers
    _tables(spark, folder, part=([(k, ("required evidence", "about claim", "7 blue", "distractor 12", "required passage")[k % 5]) for k in range(30)], "p_partkey long, p_name string"))
    for name in ("discovery_claims", "discovery_modes", "discovery_coverage"):
        con = duckdb.connect()
        for t in ("lineitem", "part", "orders"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        want = con.sql(catalog.SQL[name])
        got = catalog.QUERIES[name](spark, folder).select(*want.columns)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_coverage_audit_counts_repeated_rows_and_nulls(spark):
    from graphloom.operators import graph

    chunks = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "chunk_id long")
    events = spark.createDataFrame([(1, "a", "complete"), (1, "a", "partial"), (1, "b", None), (2, "a", "complete"), (2, None, "partial"), (None, "c", "partial")], "chunk_id long, event_id string, event_status string")
    arguments = spark.createDataFrame([("a", "x", "resolved"), ("a", "y", None), ("a", None, "resolved"), ("b", "z", "open"), (None, "w", "resolved")], "event_id string, argument_id string, status string")
    out = graph.coverage_audit(chunks, events, arguments)
    assert "count(distinct" not in out._jdf.queryExecution().optimizedPlan().toString() and "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 2, 10, 8, 6, 1), (2, 1, 2, 2, 1, 0), (3, 0, 0, 0, 0, 0), (None, 0, 0, 0, 0, 0)]


def test_audit_of_all_modes_is_one_pass_and_its_single_audits(spark):
    from graphloom.operators import audit

    every = [audit.SHARED, audit.QUERY, audit.FLAT]
    rows = [(c, p, f"s{p}", [f"e{p // 2}"] if p != c else [], [f"f{p // 2}", f"g{p % 3}"], every if p % 4 == 1 else [audit.SHARED] if p % 4 else [audit.FLAT]) for c in (1, 2, 3) for p in range(1, 9)]
    sub = spark.createDataFrame(rows, "claim long, pos int, sub string, evidence array<string>, facts array<string>, modes array<string>")
    edges = spark.createDataFrame([(c, a * 10 + b, f"s{a}:s{b}", f"s{a}", f"s{b}", f"f{a // 2}" if a // 2 == b // 2 else f"g{a % 3}") for c in (1, 2, 3) for a in range(1, 9) for b in range(a + 1, 9) if a // 2 == b // 2 or a % 3 == b % 3], "claim long, pos int, edge_id string, source string, target string, fact string")
    claims = spark.createDataFrame([(c, c % 2, 100 * c) for c in (1, 2, 3, 4)], "claim long, contradictions int, tokens long")
    out = audit.audit_all(claims, sub, edges)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 20
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted((tuple(r) for m in audit.MODES for r in audit.audit(claims, sub, edges, m).collect()), key=str)
    assert {r[1] for r in got if r[3] and r[1] == audit.SHARED} == {audit.SHARED}


def test_classifier_is_fitted_on_all_trusted_documents(spark, monkeypatch):
    from graphloom.llm import quality

    monkeypatch.setattr(quality, "fit", lambda texts: texts.count())
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    labels = spark.range(4900).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality.train(docs, labels) == 4410


def test_trusted_texts_are_found_where_they_are_read(spark, monkeypatch):
    from graphloom.llm import quality

    ids = [-70_000, -32_768, -1, 0, 1, 7, 8, 32_767, 32_768, 32_769, 65_536, 2**40, 2**62]
    docs = spark.createDataFrame([(i, f"text {i}") for i in [*ids, *ids[:3]]] + [(None, "none")] + [(i + 2, "other") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in ids] + [(None, 1), (3, 0), (8, 1), (1, None)], "doc_id long, quality int")
    want = sorted(map(tuple, docs.join(quality.trusted_ids(labels), "doc_id", "left_semi").collect()))
    found = quality.among_trusted(docs, labels)
    assert sorted(map(tuple, found.collect())) == want and len(want) > len(ids)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(quality, "FEW_BITMAPS", 0)
    assert sorted(map(tuple, quality.among_trusted(docs, labels).collect())) == want


def test_an_entity_of_two_documents_is_one_candidate(spark):
    from graphloom.operators import resolution

    none = spark.createDataFrame([], "entity_id string, document_id string, index int")
    chunks = spark.createDataFrame([("d", 0, "the keeper came"), ("f", 0, "x")], "document_id string, index int, text string")
    entities = spark.createDataFrame([("d", "e", "Ann Bell", "person", ["keeper"]), ("f", "e", "Ann Ball", "person", []), ("d", "g", "Cay", "person", None)], "document_id string, entity_id string, canonical_name string, entity_type string, aliases array<string>")
    mentions = spark.createDataFrame([("d", "c", 1, "m1", "he", "pronoun", "pronoun", 0.9, [resolution.ENTITY]), ("d", "c", 1, "m2", "the Bell", "nominal", "generic_nominal", 0.9, [resolution.ENTITY])], "document_id string, chunk_id string, index int, mention_id string, text string, type string, kind string, confidence double, expectations array<string>")
    rows = resolution.prepared(mentions)
    names = resolution.known_names(rows, entities)
    got = resolution.candidates(rows, names, none, chunks).select("mention_id", "rank", "entity_id", "canonical_name", "score").collect()
    assert sorted(map(tuple, got)) == [("m1", 1, "e", "Ann Bell", 1.5), ("m1", 2, "g", "Cay", 0.3), ("m2", 1, "e", "Ann Bell", 0.6)]


def test_patch_makes_only_what_is_wanted(spark, monkeypatch):
    from graphloom.operators import assembly

    chunks = spark.createDataFrame([(1, 7, 0, "Ann met Bob"), (2, 7, 1, "Bob met Cay")], "chunk_id long, document_id long, index int, text string")
    mentions = spark.createDataFrame([(1, 1, "r1", "Ann", 0, 3), (2, 1, None, "Bob", 5, 6), (2, 2, None, "Dan", 0, 3)], "chunk_id long, n int, ref string, surface string, start int, end int").selectExpr("*", "'named' AS type", "'named_anchor' AS kind", "0.9 AS confidence")
    events = spark.createDataFrame([(1, 1), (2, 1)], "chunk_id long, e int").selectExpr("*", "'met' AS predicate", "CAST(NULL AS STRING) AS normalized", "'meeting' AS event_type", "'' AS evidence_text", "CAST(NULL AS INT) AS evidence_start", "CAST(NULL AS INT) AS evidence_end", "0.8 AS confidence")
    arguments = spark.createDataFrame([(1, 1, 0, "agent", "r1", "Ann"), (1, 1, 1, "patient", "x", "Bob"), (1, 1, 2, "witness", "x", "met"), (2, 1, 0, "agent", None, "Bob"), (2, 1, 1, "patient", None, "Cay")], "chunk_id long, e int, a int, role string, ref string, surface string").selectExpr("*", "0 AS start", "0 AS end", "'' AS grounding", "0.7 AS confidence")
    draft = assembly.assembled(chunks, mentions, events, arguments)
    keys = sorted((r.chunk_id, r.n, r.mention_key, r.text, r.type) for r in draft["mentions"].collect())
    assert keys == [(1, 1, "r1", "Ann", "named"), (1, 2, "x", "Bob", "nominal"), (2, 1, "m1", "Bob", "named"), (2, 2, "m2", "Cay", "nominal")]
    assert sorted((r.chunk_id, r.a, r.mention_key) for r in draft["arguments"].collect()) == [(1, 0, "r1"), (1, 1, "x"), (1, 2, "x"), (2, 0, "m1"), (2, 1, "m2")]
    assert [(r.chunk_id, r.row, r.surface) for r in draft["faults"].collect()] == [(2, "mention 2", "Dan")]
    decisions = draft["mentions"].select(assembly.mention_id(F.col("chunk_id"), F.col("mention_key")).alias("mention_id"), F.lit(7).alias("document_id"), F.lit("create_entity").alias("decision"), F.concat(F.lit("e"), "text").alias("entity_id"), F.col("text").alias("canonical_name"), F.lit("person").alias("entity_type"), F.lit(None).cast("string").alias("alias_to_add"), F.lit(0.8).alias("confidence"), F.lit("confirmed").alias("status"), F.expr("cast(array() as array<string>)").alias("candidates"), F.lit("").alias("reason"))
    stored = spark.createDataFrame([], "document_id long, entity_id string, canonical_name string, entity_type string, aliases array<string>")
    every = assembly.patch(draft, decisions, chunks, stored, "run")
    monkeypatch.setattr(assembly, "closed", None)
    some = assembly.patch(draft, decisions, chunks, stored, "run", ("events", "arguments"))
    assert set(some) == {"events", "arguments"} and len(every) == 7
    for part in some:
        assert sorted(map(str, some[part].collect())) == sorted(map(str, every[part].collect()))
    assert {r.entity_id: r.group_id for r in every["entities"].collect()} == {x: x for x in ("eAnn", "eBob", "eCay")}


def _stages(spark, work):
    """Stages that ran for ``work``, and its result."""
    context, group = spark.sparkContext, str(id(work))
    context.setJobGroup(group, group)
    try:
        out = work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    return sum(1 for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds if (i := tracker.getStageInfo(s)) and i.numCompletedTasks), out


def _witnesses(edges, pairs, most, keep):
    """All shortest paths by plain search, the first ones as ordered from their end."""
    want = set()
    for part, source, target in {p for p in pairs if None not in p}:
        near = {}
        for p, a, b in edges:
            if p == part and a is not None and b is not None:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        paths = [[source]]
        for hops in range(1, most + 1):
            if target == source:
                break
            paths = [[*p, n] for p in paths for n in near.get(p[-1], ()) if n not in p]
            found = sorted(p[::-1] for p in paths if p[-1] == target)
            if found:
                want |= {(part, source, target, hops, tuple(p[::-1]), i + 1) for i, p in enumerate(found[:keep])}
                break
    return want


def test_path_witnesses_shuffle_once_and_are_whole(spark, monkeypatch):
    from graphloom.operators import navigation

    edges = [(p, f"s{(i * 7 + p) % 9}", f"p{(i * i + 3 * p) % 8}") for p in range(6) for i in range(4 + 9 * p)]
    edges += [(1, "s1", "s1"), (1, None, "p2"), (1, "s2", None), (None, "s1", "p1"), (2, "far", "away")]
    pairs = [(p, f"s{x}", f"{k}{y}") for p in range(6) for x in (0, 4) for k in "sp" for y in range(9)] + [(1, "none", "s1"), (2, "far", "away"), (3, None, "s1"), (None, "s1", "p1"), (2, "far", "s1"), (4, "s0", "s4")]
    e = spark.createDataFrame(edges, "part long, a string, b string")
    p = spark.createDataFrame(pairs, "part long, source string, target string")
    rows = lambda df: sorted((r.part, r.source, r.target, r.hops, tuple(r.path), r["rank"]) for r in df.collect())
    for keep in (2, 5):
        stages, got = _stages(spark, lambda keep=keep: rows(navigation.path_witnesses(e, p, "part", 4, keep)))
        assert got == sorted(_witnesses(edges, pairs, 4, keep)) and any(r[5] == keep for r in got)
        assert stages <= 12  # a step for each hop, there and back, took 38
    monkeypatch.setattr(navigation, "PART_ROWS", 60)  # some parts go the other way
    assert rows(navigation.path_witnesses(e, p, "part")) == sorted(_witnesses(edges, pairs, 4, 5))


def test_ingestion_shuffles_texts_and_mentions_once(spark):
    from graphloom.operators import ingest

    docs = spark.createDataFrame([(i, f"Ann{i} saw the old dog. Then Bob{i % 3} met him. The dog was here.\n\nAnn{i} held it. Однако she left.") for i in range(40)] + [(90, None), (91, "")], "doc_id long, text string")
    stages, got = _stages(spark, lambda: sorted(map(tuple, ingest.ingest(docs, 12, wanted=("entities",))["entities"].collect())))
    assert stages <= 10  # 41 before
    assert got == sorted(map(tuple, ingest.ingest(docs, 12)["entities"].collect())) and len(got) > 40


def test_extraction_is_its_sql_on_odd_turns(spark, tmp_path):
    said = ["Ann saw the old man. Then Ann met him. He was Bob Ray.", "He saw it.", "", None, "Ann Lee met Bob Ray. He was old.", "Ann Lee is here. The dog was old. Bob Ray saw the dog. The dog is big. The cat saw the dog", "the man met the man. Ann met Ann. Ann saw the man and Bob", "...\n\n", "Well. Ann and Bob, then Cid Moe said the old dog was Ann"]
    turns = [(c, t, "user", said[(c * 5 + t) % len(said)]) for c in range(9) for t in range(5)]
    folder = _tables(spark, tmp_path, conversations=(turns, "conv_id long, turn long, role string, text string"))
    for name in ("extraction_mentions", "event_frames", "resolution_cascade", "agent_patient_relations"):
        assert _same(spark, folder, name), name


def test_text_hops_are_their_sql_in_few_stages(spark, tmp_path):
    from graphloom.operators import navigation

    texts = [None, "", "one", "One two\tTWO  three", "ünï two. Straße ÉTÉ", "a b c d e f g h i j k l", "two two two -two", " \n "]
    docs = [(i, None if i == 45 else f"{texts[(i * 3) % 8] or ''} w{i % 7} w{i % 5} w{i % 7}" if i % 4 else texts[i % 8]) for i in range(70)]
    folder = _tables(spark, tmp_path, documents=(docs, "doc_id long, text string"))
    stages, got = _stages(spark, lambda: _same(spark, folder, "mdr_text_hops"))
    assert len(got) == 20 and stages <= 40
    # a passage given in two rows is the sum of both
    two = spark.createDataFrame([(1, 1, "x y"), (1, 1, "z"), (1, 2, "x"), (1, None, "q")], "case_id long, doc_id long, text string")
    one = spark.createDataFrame([(1, 1, "x y z"), (1, 2, "x"), (1, None, "q")], "case_id long, doc_id long, text string")
    asked = spark.createDataFrame([(1, "x y z")], "case_id long, text string")
    rows = [sorted(map(str, navigation.text_hops(p, asked, hops=2).collect())) for p in (two, one)]
    assert rows[0] == rows[1] and len(rows[0]) == 2
