"""Claim audits: which subclaims a mode verifies, how evidence spreads over shared facts, and what follows for the claim.

Rows: subclaims (claim, pos, sub, evidence array, facts array, modes array), edges (claim, pos, edge_id, source, target,
fact), claims (claim, contradictions int, tokens long).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import vector
from graphloom.operators import graph
from graphloom.operators.lineage import cut

#: Fixed values.
FLAT, QUERY, SHARED = "flat_subclaim_verification", "graph_query_verification", "graph_shared_evidence"
NO_EDGES, SHUFFLED, MASKED = (f"{SHARED}_{x}" for x in ("without_cross_subclaim_edges", "shuffled_edges", "masked_required_fact"))
PROJECTION, RECURSIVE = "graph_projection_verification", "graph_recursive_completeness"
MODES = (FLAT, PROJECTION, QUERY, SHARED, NO_EDGES, SHUFFLED, MASKED, RECURSIVE)
SPREADING = (SHARED, NO_EDGES, SHUFFLED, MASKED)
EDGE_MODES = (QUERY, SHARED, SHUFFLED, MASKED, RECURSIVE)


def verified_in(mode: str, evidence: Column | str = "evidence", modes: Column | str = "modes") -> Column:
    return (F.size(evidence) > 0) & ((F.size(modes) == 0) | F.array_contains(modes, mode))


def modes_by_position(pos: Column, count: Column, degree: Column) -> Column:
    """The modes that verify a subclaim by its place (from 1), the number of subclaims and how many others share a fact."""
    few = count <= 2
    return F.array_compact(F.array(F.lit(SHARED), F.when((pos == 1) | (degree <= 1) | few, QUERY), F.when((degree == 0) | few, FLAT)))


def edges_for(edges: DataFrame, mode: str) -> DataFrame:
    """The mode's edges: none, or with targets rotated by one and facts renamed, so that none is valid."""
    if mode == NO_EDGES:
        return edges.where(F.lit(False))
    if mode != SHUFFLED:
        return edges
    w = Window.partitionBy("claim").orderBy("pos", "edge_id")
    first = F.first("target").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return edges.select("claim", "pos", F.concat("edge_id", F.lit(":shuffled")).alias("edge_id"), "source", F.coalesce(F.lead("target").over(w), first).alias("target"), F.concat("fact", F.lit(":shuffled")).alias("fact"))


def _spread(subclaims: DataFrame, edges: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """claim, sub and, per spreading mode, whether evidence reaches it by way of edges; ``subclaims`` has seed, allowed, has and last, ``edges`` a tag."""
    end = lambda c: subclaims.where("has").select("claim", F.col("sub").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("seed", "allowed", "last", "facts")))
    good = edges.join(end("source"), ["claim", "source"]).join(end("target"), ["claim", "target"]).where(F.array_contains("source_facts", F.col("fact")) & F.array_contains("target_facts", F.col("fact")))
    wanted = F.array_compact(F.array(*(F.when((F.col("tag") == SHUFFLED) if m == SHUFFLED else (F.col("tag") == SHARED) & (F.lit(m != MASKED) | ~F.col("source_last") & ~F.col("target_last")), m) for m in modes)))
    # what isn't found independently is open: only edges that end in an open subclaim spread anything
    good = good.select("claim", "source", "target", F.col("source_seed").alias("_s"), F.col("target_seed").alias("_t"), (F.col("source_allowed") & ~F.col("source_seed")).alias("_so"), (F.col("target_allowed") & ~F.col("target_seed")).alias("_to"), F.explode(wanted).alias("mode"))
    good = cut(good.where("(_s OR _so) AND _to OR (_t OR _to) AND _so"))
    first = good.where("_s AND _to").select("claim", "mode", F.col("target").alias("node")).unionByName(good.where("_t AND _so").select("claim", "mode", F.col("source").alias("node")))
    chain = good.where("_so AND _to").select("claim", "mode", F.col("source").alias("a"), F.col("target").alias("b"))
    inside = chain.select("claim", "mode", F.col("a").alias("node")).unionByName(chain.select("claim", "mode", F.col("b").alias("node"))).distinct()
    found = graph.reached(chain, first, inside, ["claim", "mode"])
    return found.groupBy("claim", F.col("node").alias("sub")).agg(*(F.max(F.col("mode") == m).alias(f"_{m}") for m in modes))


def marked(subclaims: DataFrame, edges: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """claim, sub, evidence, facts and, for each mode, a column of its name that tells whether it verifies the subclaim."""
    last = F.col("pos") == F.max("pos").over(Window.partitionBy("claim"))
    rows = subclaims.withColumns({"last": last, "has": F.size("evidence") > 0, "seed": verified_in(QUERY), "allowed": verified_in(SHARED)})
    spreading = tuple(m for m in modes if m in SPREADING and m != NO_EDGES)
    own = lambda m: F.col("seed") if m in SPREADING else verified_in(m)
    if spreading:
        rows = cut(rows)
        rows = rows.join(_spread(rows, edges, spreading), ["claim", "sub"], "left").fillna(False, [f"_{m}" for m in spreading])
    ok = {m: (own(m) | F.col(f"_{m}") if m in spreading else own(m)) & (~F.col("last") if m == MASKED else F.lit(True)) for m in modes}
    return rows.select("claim", "sub", "evidence", "facts", *(c.alias(m) for m, c in ok.items()))


def audit(claims: DataFrame, subclaims: DataFrame, edges: DataFrame, mode: str) -> DataFrame:
    return audit_all(claims, subclaims, edges, (mode,))


def audit_all(claims: DataFrame, subclaims: DataFrame, edges: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """One row per claim and mode: coverage, reuse of facts and evidence, edges between verified subclaims, and the outcome.

    All modes go in one pass, as columns of a subclaim, and become rows when a claim's numbers are there.
    """
    edges = edges.withColumn("tag", F.lit(SHARED))
    if SHUFFLED in modes:
        edges = edges.unionByName(edges_for(edges.drop("tag"), SHUFFLED).withColumn("tag", F.lit(SHUFFLED)))
    own = cut(marked(subclaims, edges, modes))
    per = lambda f: [f(m) for m in modes]
    counts = own.groupBy("claim").agg(F.count(F.lit(1)).alias("total"), *per(lambda m: F.count_if(m).alias(f"v_{m}")))
    things = F.concat(F.transform("facts", lambda x: F.struct(F.lit(True).alias("fact"), x.alias("x"))), F.transform("evidence", lambda x: F.struct(F.lit(False).alias("fact"), x.alias("x"))))
    things = own.select("claim", F.explode(things).alias("t"), *modes).repartition("claim").groupBy("claim", "t").agg(*per(lambda m: F.count_if(m).alias(m)))
    things = things.groupBy("claim").agg(*per(lambda m: F.count_if(F.col("t.fact") & (F.col(m) > 1)).alias(f"f_{m}")), *per(lambda m: F.sum(F.when(~F.col("t.fact"), F.greatest(F.lit(0), F.col(m) - 1)).otherwise(0)).alias(f"r_{m}")))
    crossed = [m for m in modes if m in EDGE_MODES]
    end = lambda c: own.select("claim", F.col("sub").alias(c), F.array(*crossed).alias(f"_{c}"))
    if crossed:
        both = edges.select("claim", "source", "target", "tag").join(end("source"), ["claim", "source"]).join(end("target"), ["claim", "target"])
        crossing = both.groupBy("claim").agg(*(F.count_if((F.col("tag") == (SHUFFLED if m == SHUFFLED else SHARED)) & F.col("_source")[i] & F.col("_target")[i]).alias(f"e_{m}") for i, m in enumerate(crossed)))
    else:
        crossing = edges.select("claim").where(F.lit(False))
    rows = claims.join(counts, "claim", "left").join(things, "claim", "left").join(crossing, "claim", "left").fillna(0, ["total", *(f"{x}_{m}" for m in modes for x in "vfr"), *(f"e_{m}" for m in crossed)])
    zero = F.lit(0).cast("long")
    each = lambda m: F.struct(F.lit(m).alias("mode"), F.col(f"v_{m}").alias("verified"), (zero if m == FLAT else F.col(f"f_{m}")).alias("shared_facts"), F.col(f"r_{m}").alias("reused"), (F.col(f"e_{m}") if m in crossed else zero).alias("edges"))
    return _outcomes(rows.select("claim", "contradictions", "tokens", "total", F.inline(F.array(*per(each)))))


def _outcomes(rows: DataFrame) -> DataFrame:
    """Rows of a claim and mode (total, verified, shared_facts, reused, edges) with what follows from them."""
    complete = (F.col("total") > 0) & (F.col("verified") == F.col("total"))
    used = (F.col("mode") != FLAT) & ((F.col("shared_facts") > 0) | (F.col("edges") > 0))
    recall = F.when(F.col("total") > 0, F.col("verified") / F.col("total")).otherwise(1.0)
    outcome = F.when(~used, "neutral").when(F.col("contradictions") > 0, "misleading").when(~complete, "insufficient").otherwise("useful")
    return rows.select(
        "claim", "mode", "total", "verified", recall.alias("recall"), complete.alias("complete"), "shared_facts", "reused", "edges", used.alias("contributed"), outcome.alias("outcome"),
        (used & complete & (F.col("edges") > 0)).alias("answered_by_path"), F.when(F.col("verified") > 0, F.col("tokens") / F.col("verified")).alias("tokens_per_verified"),
        F.when(complete & (F.col("tokens") > 0), 10000.0 / F.col("tokens")).otherwise(0.0).alias("per_10k_tokens"),
    )


#: Subclaims of a claim whose audit is made in its row.
ROW_SUBCLAIMS = 64


def _reached(mode: str) -> Column:
    """Names of the open subclaims that evidence reaches, in a claim's row: a step for each subclaim is enough."""
    some = lambda c: F.coalesce(c, F.lit(False))
    kept = lambda s: ~s["last"] if mode == MASKED else F.lit(True)
    ends = lambda e, c: F.filter("subs", lambda s: some(s["has"] & (s["sub"] == e[c]) & F.array_contains(s["facts"], e["fact"]) & kept(s)))
    is_open = lambda s: some(s["allowed"]) & ~some(s["seed"])
    pairs = F.transform("shuffled" if mode == SHUFFLED else "edges", lambda e: F.struct(e["source"].alias("source"), e["target"].alias("target"), ends(e, "source").alias("s"), ends(e, "target").alias("t")))
    pairs = F.transform(F.filter(pairs, lambda p: (F.size(p["s"]) > 0) & (F.size(p["t"]) > 0)), lambda p: F.struct(p["source"].alias("source"), p["target"].alias("target"), *(F.exists(p[c], test).alias(c + n) for c in "st" for n, test in (("s", lambda x: some(x["seed"])), ("o", is_open)))))

    def spread(good: Column) -> Column:
        names = lambda test, c: F.transform(F.filter(good, test), lambda p: p[c])
        first = F.array_distinct(F.concat(names(lambda p: p["ss"] & p["to"], "target"), names(lambda p: p["ts"] & p["so"], "source")))
        on = lambda known, c: lambda p: p["so"] & p["to"] & F.array_contains(known, p[c])
        steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("subs")))
        further = F.aggregate(steps, first, lambda known, _: F.array_union(known, F.concat(names(on(known, "source"), "target"), names(on(known, "target"), "source"))))
        return F.when(F.exists(good, lambda p: p["so"] & p["to"]), further).otherwise(first)

    return vector.let(pairs, spread)


def audit_rows(rows: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """``audit_all`` of claims that are a row each, made where the row lies.

    ``rows``: claim, contradictions, tokens, subs (pos, sub, evidence, facts, modes) and edges (pos, edge_id, source, target,
    fact), arrays of a bounded number of subclaims.
    """
    some = lambda c: F.coalesce(c, F.lit(False))
    latest = F.array_max(F.transform("subs", lambda s: s["pos"]))
    marks = lambda s: (some(s["pos"] == F.col("_latest")).alias("last"), (F.size(s["evidence"]) > 0).alias("has"), *(some(verified_in(m, s["evidence"], s["modes"])).alias(n) for m, n in ((QUERY, "seed"), (SHARED, "allowed"), (FLAT, "flat"), (PROJECTION, "projection"), (RECURSIVE, "recursive"))))
    ordered = F.array_sort(F.transform("edges", lambda e: F.struct(*(e[c].alias(c) for c in ("pos", "edge_id", "source", "target", "fact")))))
    turned = F.transform("_ordered", lambda e, i: F.struct(e["source"].alias("source"), F.coalesce(F.get("_ordered", i + 1)["target"], F.get("_ordered", F.lit(0))["target"]).alias("target"), F.concat(e["fact"], F.lit(":shuffled")).alias("fact")))
    rows = rows.withColumn("_latest", latest).withColumn("subs", F.transform("subs", lambda s: F.struct(*(s[c].alias(c) for c in ("sub", "evidence", "facts")), *marks(s))))
    rows = rows.withColumn("_ordered", ordered).withColumn("shuffled", turned).drop("_ordered", "_latest")
    spreading = tuple(m for m in modes if m in SPREADING and m != NO_EDGES)
    rows = rows.withColumns({f"_{m}": _reached(m) for m in spreading})
    found = {FLAT: "flat", PROJECTION: "projection", RECURSIVE: "recursive"}

    def told(m: str) -> Column:
        """A mode's numbers of a claim."""
        own = lambda s: s[found.get(m, "seed")] | some(F.array_contains(f"_{m}", s["sub"])) if m in spreading else s[found.get(m, "seed")]
        verified = F.filter("subs", lambda s: own(s) & ~s["last"] if m == MASKED else own(s))

        def numbers(ok: Column) -> Column:
            whole = lambda c: F.flatten(F.transform(F.filter(ok, lambda s: s["facts"].isNotNull() & s["evidence"].isNotNull()), lambda s: s[c]))
            # of a sorted list, a value's second place tells that it is shared
            again = lambda x: F.size(F.filter(F.transform(x, lambda v, i: (i > 0) & F.get(x, i - 1).eqNullSafe(v) & ((i < 2) | ~F.get(x, i - 2).eqNullSafe(v))), lambda y: y))
            here = lambda name: F.size(F.filter(ok, lambda s: some(s["sub"] == name)))
            across = F.aggregate("shuffled" if m == SHUFFLED else "edges", F.lit(0).cast("long"), lambda t, e: t + here(e["source"]) * here(e["target"]))
            return F.struct(
                F.lit(m).alias("mode"), F.size(ok).cast("long").alias("verified"), (F.lit(0) if m == FLAT else vector.let(F.array_sort(whole("facts")), again)).cast("long").alias("shared_facts"),
                vector.let(whole("evidence"), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("reused"), (across if m in EDGE_MODES else F.lit(0)).cast("long").alias("edges"),
            )

        return vector.let(verified, numbers)

    return _outcomes(rows.select("claim", "contradictions", "tokens", F.size("subs").cast("long").alias("total"), F.inline(F.array(*(told(m) for m in modes)))))


def pivoted_scores(audits: DataFrame) -> DataFrame:
    """Long form: claim, mode, score_name, score_value."""
    scores = F.array(*(F.struct(F.lit(c).alias("score_name"), F.col(c).cast("double").alias("score_value")) for c in ("recall", "complete", "shared_facts", "reused", "edges", "contributed", "answered_by_path", "per_10k_tokens")))
    return audits.select("claim", "mode", F.inline(scores))


def coverage_pivot(covered: DataFrame, arms: list[str]) -> DataFrame:
    """(task, subclaim) x arm: whether the arm found it."""
    return covered.groupBy("task", "sub").pivot("arm", arms).agg(F.first("found"))
