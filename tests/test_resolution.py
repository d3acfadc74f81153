"""Edges of gated resolution and draft assembly that tables lack: nulls, empty inputs, faults, long alias chains."""

from __future__ import annotations

import pytest

from graphloom.operators import assembly, graph, records, resolution

MENTIONS = "document_id string, chunk_id string, index int, mention_id string, text string, type string, kind string, confidence double, expectations array<string>"
ENTITIES = "document_id string, entity_id string, canonical_name string, entity_type string, aliases array<string>"


def _resolve(spark, mentions, entities, observations, chunks, said=()):
    def propose(open_, found):
        return spark.createDataFrame(list(said), "mention_id string, decision string, entity_id string, confidence double, reason string")

    made = resolution.resolve(
        spark.createDataFrame(mentions, MENTIONS), spark.createDataFrame(entities, ENTITIES), spark.createDataFrame(observations, "entity_id string, document_id string, index int"),
        spark.createDataFrame(chunks, "document_id string, index int, text string"), propose,
    )
    return {r["mention_id"]: r for r in made.collect()}


def test_guards_and_windows(spark):
    entities = [("d", "E1", "Anna", "person", ["the keeper"]), ("d", "E2", "Boris", "person", None), ("other", "E3", "Anna", "person", [])]
    mentions = [
        ("d", "c3", 3, "pro", "he", "pronoun", "pronoun", 0.9, None), ("d", "c3", 3, "anna", " The  Anna", "named", "named_anchor", 0.9, ["entity_expected"]), ("d", "c3", 3, "nul", None, None, None, 0.5, None), ("d", "c3", 3, "new", "Clara", "named", "named_anchor", 0.7, []),
        ("d", "c4", 4, "again", "Clara", "named", "named_anchor", 0.7, ["entity_expected"]), ("d", "c3", 3, "same", "Clara", "named", "named_anchor", 0.7, ["entity_expected"]), ("d", "c4", 4, "door", "door", "nominal", "generic_nominal", 0.6, ["mention_only_allowed"]),
    ]
    chunks = [("d", 2, "Where THE KEEPER went"), ("d", 1, None)]
    said = [("pro", "link_existing", "E1", 0.9, "alias"), ("anna", "link_existing", "E3", 0.95, "wrong document"), ("again", "propose_new", None, 0.9, "new one")]
    got = _resolve(spark, mentions, entities, [("E2", "d", 2)], chunks, said)
    # the alias bridge makes 1.5 with the pronoun's 0.3: strong enough against a rival
    assert (got["pro"]["decision"], got["pro"]["entity_id"], got["pro"]["status"], list(got["pro"]["candidates"])) == ("link_to_existing", "E1", "confirmed", ["E1", "E2"])
    assert got["pro"]["alias_to_add"] == "he"
    assert (got["anna"]["decision"], got["anna"]["guard"], got["anna"]["confidence"]) == ("unresolved", "outside", 0.49)
    assert got["new"]["decision"] == got["same"]["decision"] == "create_entity" and got["new"]["entity_id"] == got["same"]["entity_id"] and not got["same"]["gated"]
    assert got["again"]["gated"] and got["again"]["candidates"][0] == got["new"]["entity_id"]
    assert got["door"]["decision"] == "mention_only_allowed" and not got["door"]["gated"] and got["nul"]["decision"] == "create_entity"
    assert _resolve(spark, [], entities, [], []) == {}


def _draft(spark, chunks, mentions, events, arguments):
    return assembly.assembled(
        spark.createDataFrame(chunks, "chunk_id string, text string"), spark.createDataFrame(mentions, "chunk_id string, n int, ref string, surface string, start int, end int, type string, kind string, confidence double"),
        spark.createDataFrame(events, "chunk_id string, e int, predicate string, normalized string, event_type string, evidence_text string, evidence_start int, evidence_end int, confidence double"),
        spark.createDataFrame(arguments, "chunk_id string, e int, a int, role string, ref string, surface string, start int, end int, grounding string, confidence double"),
    )


def test_faults_leave_the_rest(spark):
    text = "Anna met him at the Door."
    d = _draft(
        spark, [("c", text), ("empty", "")], [("c", 1, "a", "Anna", 0, 4, "named", "named_anchor", 0.9), ("c", 2, "a", "anna", 3, 9, "named", "named_anchor", 0.8), ("c", 3, None, "Nobody", 0, 3, "named", "named_anchor", 0.8)],
        [("c", 1, "met", None, "meeting", None, None, None, 0.9), ("c", 2, "was", "be", "state", "gone", 0, 4, 0.9), ("empty", 1, "was", None, "state", None, None, None, 0.5)],
        [("c", 1, 0, "agent", "a", "Anna", 0, 4, None, 0.9), ("c", 1, 1, "patient", "x", "him", 99, 120, None, 0.9), ("c", 1, 2, "witness", "x", "Door", -3, 2, None, 0.9), ("c", 1, 3, "place", None, "Door", 0, 1, "entity_expected", 0.9), ("c", 1, 4, "lost", None, "Nowhere", 0, 1, None, 0.9)],
    )
    mentions = {r["mention_key"]: (r["text"], r["start"], r["end"], r["type"]) for r in d["mentions"].collect()}
    # the second "a" is another surface: it takes a key of its own, and the reference
    assert mentions == {"a": ("Anna", 0, 4, "named"), "m2": ("anna", 0, 4, "named"), "x": ("him", 9, 12, "pronoun"), "m4": ("Door", 20, 24, "nominal")}
    assert [(r["role"], r["mention_key"], r["grounding"]) for r in d["arguments"].orderBy("a").collect()] == [("agent", "m2", "entity_expected"), ("patient", "x", "entity_expected"), ("witness", "x", "entity_expected"), ("place", "m4", "mention_only_allowed")]
    events = {(r["chunk_id"], r["event_key"]): (r["start"], r["end"], r["evidence"]) for r in d["events"].collect()}
    assert events == {("c", "ev1"): (0, 24, text[:24]), ("empty", "ev1"): (0, 0, "")}
    assert {(r["row"], r["fault"]) for r in d["faults"].collect()} == {("mention 3", "span mismatch"), ("argument 1 4", "span mismatch"), ("event 2", "span mismatch")}
    places = {r["mention_key"]: list(r["expectations"]) for r in assembly.expectations(d).collect()}
    assert places == {"a": [], "m2": ["entity_expected"], "x": ["entity_expected"] * 2, "m4": ["mention_only_allowed"]}


def test_alias_chains_are_one_group(spark):
    """Each entity shares a name with the next only; pronouns and other documents join nothing."""
    rows = [("d", f"e{i:03d}", f"n{i}", "person", [f"N{i + 1}", "he"]) for i in range(60)] + [("d", "lone", "solo", "person", ["he"]), ("f", "far", "n3", "person", [])]
    seen = spark.createDataFrame([], "entity_id string, document_id string, at struct<index:int,n:int>, canonical_name string, entity_type string, alias_to_add string")
    got = {r["entity_id"]: r["group_id"] for r in assembly.closed(spark.createDataFrame(rows, ENTITIES), seen).collect()}
    assert {got[f"e{i:03d}"] for i in range(60)} == {"e000"} and got["lone"] == "lone" and got["far"] == "far"


def test_limits_are_errors(spark):
    """Neither a long chain nor a long report is cut in silence."""
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(9)], "g int, a int, b int")
    seeds, allowed = spark.createDataFrame([(1, 0)], "g int, node int"), spark.createDataFrame([(1, i) for i in range(10)], "g int, node int")
    assert graph.reached(edges, seeds, allowed, ["g"], most=10).count() == 10
    with pytest.raises(RuntimeError, match="still being reached"):
        graph.reached(edges, seeds, allowed, ["g"], most=3)
    assert records.markdown(seeds, "T").endswith("| 1 | 0 |")
    with pytest.raises(ValueError, match="more than 5"):
        records.markdown(allowed, "T", most=5)
