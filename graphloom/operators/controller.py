"""A budgeted controller over a graph index, for all questions at once: locate, inspect, decide, act.

The state is a relation with one row per question; what a question has seen, its frontier of at most ``cap`` documents
and its trace are arrays that the budgets bound.  A turn is one job over the questions that are still open: their
decisions are joined in, carried out, and the frontier of all current documents is found by one index join.  A state
that stops leaves the loop, so a turn costs what its open questions cost.

A policy is the seam for a model: a function from open states to decisions (query_id, action, transitions, subquery,
summary, confidence, gap).  A question without a decision stops.  Actions are inspect, expand, reformulate, verify,
answer and stop.  A decision that names nothing presented fails the job, unless ``guarded`` made it valid before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import inverted, navigation, retrieval
from graphloom.operators.lineage import written

Policy = Callable[[DataFrame, int], DataFrame]
#: Fixed values.
FIRST, OWNER = "__first__", "__target_owner__:"
STOPS = {"seed": "no_seed", "calls": "model_call_budget_exhausted", "depth": "max_depth_reached", "expansions": "expansion_budget_exhausted", "stop": "insufficient_evidence", "answer": "answer"}
NOTES = {
    "expand": " [sanitized: expand without valid transition_id, took first frontier transition]",
    "verify": " [sanitized: expand with empty frontier -> verify]",
    "answer": " [sanitized: answer with <2 evidence paragraphs on a multi-hop question -> reformulate toward the evidence gap]",
    "inspect": " [sanitized: repeated inspect -> expand first frontier transition]",
}
DECISION = "query_id {key}, action string, transitions array<string>, subquery string, summary string, confidence double, gap string"
_NONE = "cast(array() as array<string>)"


@dataclass(frozen=True)
class Budget:
    depth: int = 3
    calls: int = 8
    expansions: int = 4
    k: int = 5
    cap: int = 20


def transition_id(source: Column, target: Column) -> Column:
    return F.concat(F.lit("transition_"), F.substring(F.sha2(F.concat(source.cast("string"), F.lit("->"), target.cast("string")), 256), 1, 12))


class _Known:
    """Transitions of documents that were looked at: a document's are found once, whatever the number of looks."""

    def __init__(self, docs: DataFrame, cap: int, index: inverted.Lists | None = None):
        self.docs, self.cap, self.index = docs, cap, index or navigation.frontier_lists(docs, cap)
        self.looked = self.edges = None

    def among(self, asked: DataFrame) -> DataFrame:
        """The documents with an id of ``asked``, picked out where they lie."""
        return inverted.only(self.docs, asked, "doc_id").join(asked.select("doc_id").distinct(), "doc_id", "left_semi")

    def of(self, states: DataFrame) -> DataFrame:
        """from_id, doc_id of all transitions from the states' documents, and maybe more."""
        new = states.select("doc_id").where("doc_id IS NOT NULL").distinct()
        new = written(new if self.looked is None else new.join(self.looked, "doc_id", "left_anti"), "controller-looked")
        if self.edges is None or not new.isEmpty():
            edges = written(navigation.frontier(self.docs, self.among(new), self.cap, self.index).select("from_id", "doc_id"), "controller-edges")
            self.looked = new if self.looked is None else self.looked.unionByName(new)
            self.edges = edges if self.edges is None else self.edges.unionByName(edges)
        return self.edges

    def neighboured(self, ids: DataFrame) -> DataFrame:
        """The ids of documents that have a transition: a long key leads somewhere, the others are looked at."""
        rows = written(inverted.only(self.index.docs, ids, "doc_id").join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", (F.size("codes") > 0).alias("_long")), "controller-ids")
        sure, rest = rows.where("_long").select("doc_id"), rows.where("NOT _long").select("doc_id")
        if rest.isEmpty():
            return sure
        return sure.unionByName(navigation.frontier(self.docs, self.among(rest), 1, self.index).select(F.col("from_id").alias("doc_id")))


def frontiers(known: _Known, states: DataFrame) -> DataFrame:
    """query_id, frontier: transitions from each state's document to unvisited ones, in order of their ids.

    Evidence that was presented before, or by an earlier transition, is left out of ``fresh`` and counted in ``omitted``.
    """
    pairs = known.of(states).withColumnRenamed("from_id", "_from").join(states.select("query_id", F.col("doc_id").alias("_from"), "docs"), "_from").where(~F.array_contains("docs", F.col("doc_id")))
    pairs = written(pairs.select("query_id", "_from", "doc_id"), "controller-pairs")
    own = known.among(states).select(F.col("doc_id").alias("_from"), F.col("owner_id").alias("_owner"), F.col("entities").alias("_en"), F.col("events").alias("_ev"))
    # what a question has seen joins last, once it is one row
    rows = inverted.only(known.docs.select("doc_id", "owner_id", "entities", "events", "evidence"), pairs, "doc_id").join(pairs, "doc_id").join(own, "_from")
    step = F.struct(
        F.col("doc_id").alias("target"), transition_id(F.col("_from"), F.col("doc_id")).alias("id"), F.col("owner_id").alias("owner"), F.col("_owner").alias("source_owner"), F.array_sort(F.array_intersect("_en", "entities")).alias("shared_entities"),
        F.array_sort(F.array_intersect("_ev", "events")).alias("shared_events"), F.col("entities"), F.array_distinct("evidence").alias("evidence"),
    )
    found = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(step)).alias("_f"))  # ``cap`` rows of each question
    found = found.join(states.select("query_id", F.col("presented").alias("_seen")), "query_id")
    before = lambda i: F.array_union("_seen", F.flatten(F.transform(F.slice("_f", F.lit(1), i), lambda t: t["evidence"])))
    shown = F.transform("_f", lambda t, i: t.withField("fresh", F.array_except(t["evidence"], before(i))).withField("omitted", F.size(F.array_intersect(t["evidence"], before(i)))))
    return found.select("query_id", shown.alias("frontier"))


def _inspected(known: _Known, states: DataFrame) -> DataFrame:
    """States with their frontier looked at anew where ``look`` is set, and what it showed remembered."""
    looking = states.where("look AND stop IS NULL")
    out = states.join(frontiers(known, looking).withColumnRenamed("frontier", "_new"), "query_id", "left")
    empty = F.filter("frontier", lambda t: F.lit(False))
    out = out.withColumn("frontier", F.when(F.col("look"), F.coalesce("_new", empty)).otherwise(F.col("frontier")))
    shown = F.flatten(F.transform("frontier", lambda t: t["fresh"]))
    return out.withColumn("presented", F.when(F.col("look"), F.array_union("presented", shown)).otherwise(F.col("presented"))).drop("_new")


def located(docs: DataFrame, questions: DataFrame, seeds: DataFrame, budget: Budget = Budget(), known: _Known | None = None) -> DataFrame:  # noqa: B008
    """The first state of every question (query_id, query): at the best of its seeds (query_id, doc_id, score, owner_type), with its frontier."""
    known = known or _Known(docs, budget.cap)
    seeds = written(seeds, "controller-seeds")
    best = retrieval.seed_with_frontier(seeds, seeds.join(known.neighboured(seeds), "doc_id", "left_semi")).select("query_id", "doc_id")
    best = written(best, "controller-best")
    rows = questions.select("query_id", F.col("query").alias("subquery")).join(best, "query_id", "left").join(known.among(best).select("doc_id", "owner_id", "entities", "evidence"), "doc_id", "left")
    none, void = F.expr(_NONE), F.lit(None).cast("string")
    ids = dict(docs.dtypes)["doc_id"]
    frontier = f"array<struct<target:{ids},id:string,owner:string,source_owner:string,shared_entities:array<string>,shared_events:array<string>,entities:array<string>,evidence:array<string>,fresh:array<string>,omitted:int>>"
    trace = f"array<struct<turn:int,action:string,doc_id:{ids},depth:int,shown:int,omitted:int,transition:string>>"
    first = rows.select(
        "query_id", "subquery", "doc_id", F.when(F.col("doc_id").isNull(), F.expr(f"cast(array() as array<{ids}>)")).otherwise(F.array("doc_id")).alias("docs"), F.array_distinct(F.array_compact(F.concat(F.array("owner_id"), F.coalesce("entities", none)))).alias("owners"),
        none.alias("transitions"), none.alias("presented"), F.array_distinct(F.coalesce("evidence", none)).alias("evidence"), F.lit(0).alias("depth"), F.lit(budget.calls).alias("calls"), F.lit(budget.expansions).alias("expansions"), void.alias("action"),
        F.lit(0.0).alias("confidence"), void.alias("answer"), F.when(F.col("doc_id").isNull(), STOPS["seed"]).alias("stop"), F.lit(True).alias("look"), F.expr(f"cast(array() as {frontier})").alias("frontier"), F.expr(f"cast(array() as {trace})").alias("trace"),
    )
    return _inspected(known, written(first, "controller-first"))


def _carried_out(states: DataFrame, decisions: DataFrame, turn: int) -> DataFrame:
    """States after their decisions; frontiers are not looked at yet."""
    made = decisions.select("query_id", *(F.col(c).alias(f"_{c}") for c in ("action", "transitions", "subquery", "summary", "confidence")))
    rows = states.join(made, "query_id", "left").withColumn("_action", F.coalesce("_action", F.lit("stop")))
    known = F.transform("frontier", lambda t: t["id"])
    first = lambda t: F.get(F.transform(F.filter("frontier", lambda f: f["owner"] == F.substring_index(t, OWNER, -1)), lambda f: f["id"]), F.lit(0))
    named = F.transform(F.coalesce("_transitions", F.expr(_NONE)), lambda t: F.when(t == FIRST, F.get(known, F.lit(0))).when(t.startswith(OWNER), first(t)).otherwise(t))
    rows = rows.withColumn("_named", F.array_compact(named))
    expands = F.col("_action") == "expand"
    wrong = F.when(expands & (F.size("_named") == 0), "expand names no transition").when(expands & (F.size(F.array_except("_named", known)) > 0), "transitions outside the presented frontier").when((F.col("_action") == "reformulate") & (F.coalesce("_subquery", F.lit("")) == ""), "reformulate has no subquery")
    rows = rows.withColumn("_action", F.when(wrong.isNull(), F.col("_action")).otherwise(F.raise_error(F.concat(wrong, F.lit(": question "), F.col("query_id").cast("string"))).cast("string")))
    rows = rows.withColumn("_step", F.when(expands, F.get(F.filter("frontier", lambda t: t["id"] == F.get("_named", F.lit(0))), F.lit(0))))
    moved = lambda field, new: F.when(expands, F.array_union(field, new)).otherwise(F.col(field))
    left = F.col("expansions") - expands.cast("int")
    step = F.struct(F.lit(turn).alias("turn"), F.col("_action").alias("action"), "doc_id", "depth", F.size("frontier").alias("shown"), F.aggregate("frontier", F.lit(0), lambda a, t: a + t["omitted"]).alias("omitted"), F.col("_step.id").alias("transition"))
    return rows.select(
        "query_id", F.when(F.col("_action") == "reformulate", F.col("_subquery")).otherwise(F.col("subquery")).alias("subquery"), F.coalesce("_step.target", "doc_id").alias("doc_id"), moved("docs", F.array("_step.target")).alias("docs"),
        moved("owners", F.concat(F.array("_step.owner"), F.col("_step.entities"))).alias("owners"), moved("transitions", F.array("_step.id")).alias("transitions"), "presented", moved("evidence", F.col("_step.evidence")).alias("evidence"), (F.col("depth") + expands.cast("int")).alias("depth"),
        (F.col("calls") - 1).alias("calls"), left.alias("expansions"), F.col("_action").alias("action"), F.coalesce("_confidence", F.lit(0.0)).alias("confidence"), F.when(F.col("_action") == "answer", F.nullif(F.trim("_summary"), F.lit(""))).alias("answer"),
        F.when(F.col("_action") == "answer", STOPS["answer"]).when(F.col("_action") == "stop", STOPS["stop"]).when(left < 0, STOPS["expansions"]).alias("stop"), F.col("_action").isin("inspect", "expand", "reformulate").alias("look"), "frontier", F.concat("trace", F.array(step)).alias("trace"),
    )


def run(docs: DataFrame, questions: DataFrame, seeds: DataFrame, policy: Policy, budget: Budget = Budget()) -> DataFrame:  # noqa: B008
    """The last state of every question; ``stop`` says why it ended.  Documents are read at every turn: what is costly to make is written first."""
    known = _Known(docs, budget.cap)
    now = written(located(docs, questions, seeds, budget, known), "controller")
    done = now.where("stop IS NOT NULL")
    for turn in range(budget.calls + 1):
        spent = F.when(F.col("calls") <= 0, STOPS["calls"]).when(F.col("depth") >= budget.depth, STOPS["depth"])
        now = now.where("stop IS NULL").withColumn("stop", spent)
        done = done.unionByName(now.where("stop IS NOT NULL"))
        open_ = now.where("stop IS NULL")
        if open_.isEmpty():
            break
        acted = written(_carried_out(open_, policy(open_, turn), turn), "controller-acted")
        now = written(_inspected(known, acted), "controller")
        done = done.unionByName(now.where("stop IS NOT NULL"))
    return done


def scripted(decisions: DataFrame) -> Policy:
    """Decisions of a table (query_id, turn, action, ...): one of each question and turn."""
    return lambda states, turn: decisions.where(F.col("turn") == turn).drop("turn").join(states.select("query_id"), "query_id", "left_semi")


def greedy(states: DataFrame, turn: int) -> DataFrame:
    """Expand the transition with most shared keys, the first of several; stop where there is none."""
    weight = lambda t: 3 * F.size(t["shared_events"]) + 2 * F.size(t["shared_entities"])
    best = F.array_max(F.transform("frontier", lambda t, i: F.struct(weight(t).alias("w"), (-i).alias("i"), t["id"].alias("id"))))
    found, void = F.size("frontier") > 0, F.lit(None).cast("string")
    return states.select("query_id", F.when(found, "expand").otherwise("stop").alias("action"), F.when(found, F.array(best["id"])).alias("transitions"), void.alias("subquery"), void.alias("summary"), F.lit(0.0).alias("confidence"), void.alias("gap"))


def guarded(policy: Policy, least_evidence: int = 2) -> Policy:
    """A policy whose decisions can be carried out.

    Expanding needs a presented transition (else the first, else verify); answering needs evidence while calls are left
    (else reformulate towards the gap); a repeated inspection expands; reformulating needs a subquery.
    """

    def decide(states: DataFrame, turn: int) -> DataFrame:
        s = states.select("query_id", F.transform("frontier", lambda t: t["id"]).alias("_known"), F.col("subquery").alias("_now"), F.col("action").alias("_last"), F.size("evidence").alias("_n"), "calls")
        rows = policy(states, turn).join(s, "query_id")
        a, some = F.col("action"), F.size("_known") > 0
        valid = F.filter(F.coalesce("transitions", F.expr(_NONE)), lambda t: F.array_contains("_known", t))
        lost = (a == "expand") & (F.size(valid) == 0)
        thin = (a == "answer") & (F.col("_n") < least_evidence) & (F.col("calls") > 1)
        again = (a == "inspect") & (F.col("_last") == "inspect") & some
        note = F.when(lost & some, NOTES["expand"]).when(lost, NOTES["verify"]).when(thin, NOTES["answer"]).when(again, NOTES["inspect"]).otherwise("")
        first = F.slice("_known", 1, 1)
        blank = F.coalesce("subquery", F.lit("")) == ""
        return rows.select(
            "query_id", F.when((lost & some) | again, "expand").when(lost, "verify").when(thin, "reformulate").otherwise(a).alias("action"), F.when((lost & some) | again, first).when(a == "expand", F.slice(valid, 1, 1)).otherwise(F.col("transitions")).alias("transitions"),
            F.when(thin, F.coalesce(F.nullif("gap", F.lit("")), "_now")).when((a == "reformulate") & blank, F.col("_now")).otherwise(F.col("subquery")).alias("subquery"), F.concat(F.coalesce("summary", F.lit("")), note).alias("summary"), "confidence", "gap",
        )

    return decide


def arm_result(states: DataFrame, k: int = Budget.k) -> DataFrame:
    """query_id, answer, evidence, consulted, confidence, completeness, stop_reason of states that ended."""
    consulted = F.array_distinct(F.concat(F.transform("docs", lambda d: d.cast("string")), F.col("owners"), F.col("transitions")))
    return states.select("query_id", "answer", "evidence", consulted.alias("consulted"), "confidence", F.least(F.lit(1.0), F.size("evidence") / F.lit(float(max(k, 1)))).alias("completeness"), F.coalesce("stop", F.lit("dynamic_graph_complete")).alias("stop_reason"))


def last_answer(states: DataFrame) -> DataFrame:
    """query_id and the last step of the trace that answered."""
    return states.select("query_id", F.element_at(F.filter("trace", lambda t: t["action"] == "answer"), -1).alias("step")).where("step IS NOT NULL")


def dual(graph: DataFrame, text: DataFrame) -> DataFrame:
    """Both arms' results (query_id, answer, evidence, confidence, contradictions where there are any) under one arbiter; neither writes."""
    both = [a if "contradictions" in a.columns else a.withColumn("contradictions", F.expr(_NONE)) for a in (graph, text)]
    return retrieval.arbitrate(*both, "query_id").withColumn("graph_mutation_allowed", F.lit(False))
