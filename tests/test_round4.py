"""Findings of the fourth review."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F


def _documents(spark, n: int = 240):
    r = random.Random(5)
    rows = [(i, [f"a{r.randrange(3)}", f"b{r.randrange(2)}", f"r{r.randrange(60)}", None], [f"d{i % 2}"] if i % 7 else None, [f"x{r.randrange(4)}", f"y{i % 3}"]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, entities array<string>, events array<string>, evidence array<string>")


@pytest.mark.parametrize("few", [0, 1000])
def test_only_asked_lists_are_sent(spark, monkeypatch, few):
    """Few questions meet few entries, and find what all pairs do, whether long keys are broadcast or joined."""
    from graphloom.operators import inverted, navigation

    monkeypatch.setattr(inverted, "FEW_LONG", few)
    docs = _documents(spark).withColumn("events", F.coalesce("events", F.array()))
    current = docs.where("doc_id IN (3, 70)")
    index = inverted.lists(navigation._rows(docs, "doc_id"), 4, longest=8)
    asked = index.marked(navigation._rows(current, "query_id"), "query_id")
    # 240 documents have some 20 sets of long keys each
    assert inverted._asked_lists(index, asked)[0].count() < 400
    order = ["from_id", "rank", "doc_id", "structural"]
    want = navigation.best(navigation.frontier(docs, current, None), ["from_id"], [F.desc("structural"), "doc_id"], 4)
    assert sorted(map(tuple, navigation.frontier(docs, current, 4, index).select(*order).collect())) == sorted(map(tuple, want.select(*order).collect()))


def _with_vectors(spark):
    docs = _documents(spark, 90).withColumn("events", F.coalesce("events", F.array())).withColumn("owner_id", F.concat(F.lit("o"), (F.col("doc_id") % 9).cast("string")))
    vectors = spark.createDataFrame([(i, [1.0 + i % 3, float(i % 4), 0.5 * i]) for i in range(7)], "vec long, v array<double>")
    return docs.withColumn("vec", F.col("doc_id") % 7), vectors


def test_scores_with_lent_vectors(spark):
    """Keys that travel in the place of vectors give what the vectors give, without a shuffled vector."""
    from graphloom.operators import arms

    docs, vectors = _with_vectors(spark)
    case = lambda df, key: df.where("doc_id % 30 = 0").select(F.col("doc_id").alias("case_id"), F.col("doc_id").alias("from_id"), key)
    weights, order = {"query": 0.5, "profile": 0.2, "structure": 0.15, "novelty": 0.15}, ["case_id", "rank", "doc_id", "score"]
    lent = arms.frontier_scores(docs, case(docs, "vec"), weights, 4, vectors)
    whole = docs.join(vectors, "vec").drop("vec")
    assert sorted(map(tuple, lent.select(*order).collect())) == sorted(map(tuple, arms.frontier_scores(whole, case(whole, "v"), weights, 4).select(*order).collect()))


def test_beams_with_lent_vectors(spark):
    from graphloom.operators import navigation

    docs, vectors = _with_vectors(spark)
    whole = docs.join(vectors, "vec").drop("vec")
    start = lambda df, key: df.where("doc_id % 30 = 0").select(F.col("doc_id").alias("query_id"), key)
    seeds = docs.where("doc_id % 30 = 0").select(F.col("doc_id").alias("query_id"), "doc_id", F.lit(0.5).alias("score"))
    run = lambda df, key, **more: sorted(map(tuple, navigation.navigate(df, start(df, key), seeds, 2, 2, 4, {"profile": 0.1}, **more).select("query_id", "depth", "rank", "doc_id", "score").collect()))
    assert run(docs, "vec", vectors=vectors) == run(whole, "v")


def test_a_document_is_looked_at_once(spark, monkeypatch):
    """Repeated looks at one document find its transitions once."""
    from graphloom.operators import controller, navigation

    rows = [("d1", ["a", "b"], ["x"], ["p"]), ("d2", ["a"], ["x"], ["q"]), ("d3", ["b"], [], ["p", "r"])]
    docs = spark.createDataFrame([(i, f"o{i}", "entity", *r) for i, *r in rows], "doc_id string, owner_id string, owner_type string, entities array<string>, events array<string>, evidence array<string>")
    asked = spark.createDataFrame([(1, "what")], "query_id int, query string")
    seeds = spark.createDataFrame([(1, "d1", 0.5, "entity")], "query_id int, doc_id string, score double, owner_type string")
    script = [(1, 0, "inspect", None, None, None, 0.1, None), (1, 1, "reformulate", None, "other", None, 0.2, None), (1, 2, "answer", None, None, "yes", 0.9, None)]
    policy = controller.scripted(spark.createDataFrame(script, "query_id int, turn int, action string, transitions array<string>, subquery string, summary string, confidence double, gap string"))
    calls, plain = [], navigation.frontier
    monkeypatch.setattr(navigation, "frontier", lambda *a: calls.append(a[2]) or plain(*a))
    s = controller.run(docs, asked, seeds, policy).first()
    assert (s["stop"], [f["target"] for f in s["frontier"]], [f["shared_entities"] for f in s["frontier"]]) == ("answer", ["d2", "d3"], [["a"], ["b"]])
    assert calls.count(controller.Budget.cap) == 1


def test_bits_part_most_pairs_and_no_similar_ones(spark):
    """Bits rule out pairs that share a value or few, and never one that the sketches let pass."""
    from graphloom.llm import neardup

    r = random.Random(3)
    base = sorted(r.sample(range(1 << 62), 64))
    sketches = [base, sorted([*base[:50], *r.sample(range(1 << 62), 14)]), sorted([*base[:36], *r.sample(range(1 << 62), 28)]), *(sorted([*base[:2], *r.sample(range(1 << 62), 62)]) for _ in range(20)), base[:40], base[:33]]
    nodes = spark.createDataFrame([(i, 100 if len(s) == 64 else len(s), s) for i, s in enumerate(sketches)], "node long, n long, sketch array<long>")
    marks = nodes.mapInArrow(neardup._bits, "node long, n long, bits array<long>").join(nodes.select("node", "sketch"), "node")
    side = lambda c: marks.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"b{c}"), F.col("sketch").alias(f"s{c}"))
    pairs = side("a").join(side("b"), F.expr("a < b")).withColumn("may", neardup._may_be_allowed("ba", "bb", F.col("na"), F.col("nb"))).withColumn("ok", neardup._allowed(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb")))
    found = pairs.agg(F.count_if("ok"), F.count_if(F.col("ok") & F.col("may")), F.count_if("may"), F.count(F.lit(1))).first()
    assert found[0] == found[1] > 2 and found[2] < found[3] / 10


@pytest.mark.parametrize("few", [0, 10**6])
def test_shortest_paths_send_reached_nodes_or_their_edges(spark, monkeypatch, few):
    """Repeated edges and more sources than a word has bits, by either way, against a plain search."""
    from graphloom.operators import navigation

    monkeypatch.setattr(navigation, "FEW_REACHED", few)
    r = random.Random(2)
    edges = [(f"n{r.randrange(120)}", f"n{r.randrange(120)}") for _ in range(150)] * 2 + [("n1", None)]
    near = {}
    for a, b in edges:
        if b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = set()
    for source in (f"n{i}" for i in range(0, 120, 1)):
        seen = now = {source}
        for hop in range(1, 4):
            now = {b for a in now for b in near.get(a, ())} - seen
            seen = seen | now
            want |= {(source, b, hop) for b in now if b.endswith("0")}
    e = spark.createDataFrame(edges, "a string, b string")
    s = spark.createDataFrame([(f"n{i}",) for i in range(120)], "source string")
    t = spark.createDataFrame([(f"n{i}",) for i in range(0, 120, 10)], "target string")
    got = navigation.shortest_paths(e, s, t, 3)
    assert sorted(map(tuple, got.select("source", "target", "hops").collect())) == sorted(want)


@pytest.mark.parametrize("most", [2, 10**6])
def test_pair_counts_by_bounded_tasks(spark, monkeypatch, most):
    """A source with many pairs is dealt by target; counts are those of the pairs' events."""
    from graphloom.operators import graph

    r = random.Random(4)
    roles = ["agent", "patient", "location", None]
    rows = [(r.randrange(30) if i else None, str(i), f"x{r.randrange(12)}" if i % 9 else None, "s", r.choice(roles)) for i in range(200)]
    a = spark.createDataFrame(rows, "event_id long, argument_id string, entity_id string, surface string, role string")
    order = ["source", "target", "shared", "forward", "backward"]
    monkeypatch.setattr(graph, "TASK_PAIRS", most)
    got = graph.pair_snapshots(a, events=False)
    # every task counts about so many pairs
    assert got.rdd.getNumPartitions() >= graph.pair_events(a).count() // most
    assert sorted(map(tuple, got.select(*order).collect())) == sorted(map(tuple, graph.pair_snapshots(a).select(*order).collect()))


def test_every_byte_is_one_of_its_own(spark):
    """With more bytes than symbols, rare and unseen ones differ, and the chances of all bytes are no more than one."""
    import numpy as np

    from graphloom.llm import quality

    letters = [chr(c) for c in range(33, 123)]
    texts = [("".join(letters[:55]) * 3 + f"ab{letters[60 + i % 30]}",) for i in range(40)]
    model = quality.fit(spark.createDataFrame([*texts, ("ab" + letters[70],)] * 3, "text string"))
    lines = spark.createDataFrame([(f"zzab{letters[70]}",), (f"zzab{letters[88]}",), ("zzab~",), ("zzab\u007f",), ("zzab\x01",)], "text string")
    got = [r[quality._BITS] for r in quality.scored(lines, model).collect()]
    # the one that was seen most, one that was seen, and ones that were not
    assert got[0] < got[1] < min(got[2:])
    table = quality.dense(model)

    def bits(raw: bytes) -> float:
        data = np.frombuffer(raw, dtype=np.uint8)
        return float(table[quality._grams(data, np.array([0, len(data)]), model["symbols"])[0]].sum())

    for head in (b"", b"ab", bytes([200, 7])):
        assert 0.8 < sum(2.0 ** (bits(head) - bits(head + bytes([b]))) for b in range(256)) <= 1.0001
    assert len({tuple(model["symbols"][:, b]) for b in range(256)}) == 256


def _audit_tables(spark):
    r = random.Random(6)
    subs, edges = [], []
    for c in range(40):
        n = r.randrange(1, 7)
        for i in range(n):
            modes = r.choice([[], ["graph_shared_evidence"], ["graph_shared_evidence", "graph_query_verification"], ["flat_subclaim_verification"], ["other"]])
            subs.append((c, i, f"s{i}", r.choice([[], ["e1"], ["e1", "e2"], [f"e{i}"]]), r.choice([["f1", "f2"], ["f1", "f1", None], [f"f{i % 2}", "f1", "f1:shuffled"], []]), modes))
        edges += [(c, p, f"x{p}", f"s{r.randrange(n)}", f"s{r.randrange(n + 1)}", r.choice(["f1", "f2", "f1", "f1"])) for p in range(r.randrange(14))]
    s = spark.createDataFrame(subs, "claim long, pos int, sub string, evidence array<string>, facts array<string>, modes array<string>")
    e = spark.createDataFrame(edges, "claim long, pos int, edge_id string, source string, target string, fact string")
    return spark.createDataFrame([(c, c % 2, 10 * c) for c in range(42)], "claim long, contradictions int, tokens long"), s, e


def test_audits_in_rows(spark):
    """A claim's row gives what joins over all claims give: chains, masked and shuffled edges, repeated and null facts."""
    from graphloom.operators import audit

    claims, subs, edges = _audit_tables(spark)
    gathered = lambda t, name: t.groupBy("claim").agg(F.collect_list(F.struct(*(c for c in t.columns if c != "claim"))).alias(name))
    rows = claims.join(gathered(subs, "subs"), "claim", "left").join(gathered(edges, "edges"), "claim", "left").withColumns({c: F.coalesce(c, F.array()) for c in ("subs", "edges")})
    order = ["claim", "mode", "total", "verified", "shared_facts", "reused", "edges", "contributed", "outcome", "answered_by_path", "recall", "complete"]
    got = audit.audit_rows(rows).select(*order).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, audit.audit_all(claims, subs, edges).select(*order).collect()))
    by = {m: sum(x["verified"] for x in got if x["mode"] == m) for m in audit.MODES}
    assert by[audit.SHARED] > by[audit.QUERY] > 0 and by[audit.MASKED] > 0


def test_audits_of_large_claims_go_by_joins(spark, monkeypatch):
    from graphloom.operators import audit
    from graphloom.plans import state_queries

    order = ["claim", "mode", "total", "verified", "shared_facts", "edges", "outcome"]
    run = lambda: sorted(map(tuple, state_queries._audits(spark, "/root/testdata/sf0.001").select(*order).collect()))
    whole = run()
    monkeypatch.setattr(audit, "ROW_SUBCLAIMS", 3)
    assert run() == whole


def test_a_patch_sends_what_is_wanted(spark, monkeypatch):
    """Without hypotheses, only decisions that name an entity travel, without their reasons; the parts stay the same."""
    from graphloom.operators import assembly

    mentions = spark.createDataFrame([(1, "m1", 1, "Ann"), (1, "m2", 2, "Bob"), (1, "m3", 3, "it")], "chunk_id long, mention_key string, n int, text string").selectExpr("*", "0 AS start", "1 AS end", "'named' AS type", "'x' AS kind", "0.9 AS confidence")
    arguments = spark.createDataFrame([(1, 1, 0, "m1"), (1, 1, 1, "m3")], "chunk_id long, e int, a int, mention_key string").selectExpr("*", "'agent' AS role", "'s' AS surface", "0 AS start", "1 AS end", "'entity_expected' AS grounding", "0.9 AS confidence")
    events = spark.createDataFrame([(1, "ev1", "s1", 1)], "chunk_id long, event_key string, evidence_key string, e int").selectExpr("*", "'p' AS predicate", "'p' AS normalized", "'t' AS event_type", "'v' AS evidence", "0 AS start", "1 AS end", "0.8 AS confidence")
    chunks = spark.createDataFrame([(1, 7, 0)], "chunk_id long, document_id long, index int")
    said = [("1_m1", "create_entity", "eA", "Ann", None), ("1_m2", "link_to_existing", "eB", "Bob", "Bobby"), ("1_m3", "mention_only_allowed", None, None, None)]
    decisions = spark.createDataFrame(said, "mention_id string, decision string, entity_id string, canonical_name string, alias_to_add string").selectExpr("*", "7L AS document_id", "'person' AS entity_type", "0.8 AS confidence", "'confirmed' AS status", "CAST(array() AS array<string>) AS candidates", "'by rule' AS reason")
    stored = spark.createDataFrame([(7, "eB", "Bob", "person", ["Rob"])], "document_id long, entity_id string, canonical_name string, entity_type string, aliases array<string>")
    draft = {"mentions": mentions, "arguments": arguments, "events": events}
    every = assembly.patch(draft, decisions, chunks, stored, "run")
    kept, plain = {}, assembly.written
    monkeypatch.setattr(assembly, "written", lambda df, name: kept.setdefault(name, df) is None or plain(df, name))
    for want in (("entities", "observations"), ("events", "arguments"), ("mentions",)):
        some = assembly.patch(draft, decisions, chunks, stored, "run", want)
        for part in want:
            assert sorted(map(str, some[part].collect())) == sorted(map(str, every[part].collect())), part
    assert kept["patch-rows"].count() == 2 and not {"reason", "status", "candidates"} & set(kept["patch-rows"].columns)


def test_text_search_sends_asked_lists(spark):
    """Ids of several fields, a common word and few questions: what is found is that of all pairs, what is sent is little."""
    from graphloom.operators import inverted, retrieval

    docs = spark.createDataFrame([((f"c{i}", i), ["all", f"w{i % 90}", f"r{i}"]) for i in range(600)], "doc_id struct<chunk:string,n:long>, terms array<string>")
    queries = spark.createDataFrame([(1, ["all", "w5"]), (2, ["r7", "none"])], "query_id long, terms array<string>")
    order = ["query_id", "rank", "doc_id", "overlap", "score"]
    plain = lambda f: sorted(map(str, f(docs, queries, 5).select(*order).collect()))
    assert plain(inverted.text_search) == plain(retrieval.text_search)
    rows = lambda df, own: df.select(own, F.transform("terms", lambda t: F.struct(t.alias("key"), F.lit(1).alias("weight"))).alias("postings"))
    index = inverted.lists(rows(docs, "doc_id"), 5)
    assert inverted._asked_lists(index, index.marked(inverted._gathered(rows(queries, "query_id"), "query_id"), "query_id"))[0].count() < 200
