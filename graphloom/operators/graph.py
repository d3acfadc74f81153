"""Property-graph patterns over label tables: context, events, pairs, contracts, propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.lineage import cut, written

#: Fixed values.
AGENT_ROLES = ("agent", "speaker", "source", "giver")
PATIENT_ROLES = ("patient", "addressee", "target", "recipient", "experiencer")
PLACE_ROLES = ("location", "place")
LINK_LEAST = 4


def counterparts(arguments: DataFrame) -> DataFrame:
    """Per event argument the other arguments' resolved entities (sorted) and unresolved surfaces (sorted).

    ``arguments``: event_id, argument_id, entity_id, surface, role.  An event's arguments are gathered once, and each of
    its rows, as long as the event is, is made from them where they are.
    """
    one = F.struct("argument_id", "entity_id", "surface")
    events = arguments.where("event_id is not null and argument_id is not null").groupBy("event_id").agg(F.array_distinct(F.collect_list(one)).alias("_all"))
    own = F.array_distinct(F.transform("_all", lambda x: F.struct(x["argument_id"].alias("argument_id"), x["entity_id"].alias("entity_id"))))
    rows = events.select("event_id", "_all", F.explode(own).alias("_own"))
    rows = rows.select("event_id", "_own.argument_id", "_own.entity_id", F.filter("_all", lambda x: x["argument_id"] != F.col("_own.argument_id")).alias("_others")).where("size(_others) > 0")
    names = lambda value: F.array_sort(F.array_distinct(F.array_compact(F.transform("_others", value))))
    return rows.select("event_id", "argument_id", "entity_id", names(lambda x: x["entity_id"]).alias("counterparts"), names(lambda x: F.when(x["entity_id"].isNull(), x["surface"])).alias("unresolved"))


def direction(source_role: Column, target_role: Column) -> Column:
    forward = source_role.isin(*AGENT_ROLES) & target_role.isin(*PATIENT_ROLES)
    backward = source_role.isin(*PATIENT_ROLES) & target_role.isin(*AGENT_ROLES)
    return F.when(forward, "source_to_target").when(backward, "target_to_source").otherwise("undirected")


def _event_entities(arguments: DataFrame) -> DataFrame:
    """event_id and its different entities with whether they are an agent and a patient, in order: one row of an event."""
    has = lambda roles: F.max(F.coalesce(F.col("role").isin(*roles), F.lit(False)))
    rows = arguments.where("event_id is not null and entity_id is not null").select("event_id", "entity_id", "role").repartition("event_id")
    each = rows.groupBy("event_id", "entity_id").agg(has(AGENT_ROLES).alias("agent"), has(PATIENT_ROLES).alias("patient"))
    return each.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("entity_id", "agent", "patient"))).alias("_all"))


def pair_events(arguments: DataFrame) -> DataFrame:
    """Entity pairs that share an event, once each, and the directions they have in it.

    An event's entities are made distinct and gathered, so its pairs are made where it lies.
    """
    rows = _event_entities(arguments).select("event_id", "_all", F.posexplode("_all").alias("_i", "_a"))
    both = rows.select("event_id", "_a", F.explode(F.slice("_all", F.col("_i") + 2, F.size("_all"))).alias("_b"))
    return both.select("event_id", F.col("_a.entity_id").alias("source"), F.col("_b.entity_id").alias("target"), (F.col("_a.agent") & F.col("_b.patient")).alias("forward"), (F.col("_a.patient") & F.col("_b.agent")).alias("backward"))


#: Pairs that one task counts, about.
TASK_PAIRS = 2_000_000


def pair_counts(arguments: DataFrame) -> DataFrame:
    """Per pair: shared events and those of each direction.

    A source travels with all its targets of an event, to one of as many tasks as the pairs ask for.  Sources that have
    more pairs than a task counts are dealt by target as well, each target to one of their tasks.
    """
    events = written(_event_entities(arguments).select("_all").where("size(_all) > 1"), "pair-events")
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.select("_all", F.posexplode("_all").alias("_i", "_a")).select("_a", F.slice("_all", F.col("_i") + 2, F.size("_all")).alias("_b")).where("size(_b) > 0")
    sizes = rows.groupBy(F.col("_a.entity_id").alias("source")).agg(F.sum(F.size("_b")).alias("n"))
    total = events.agg(F.sum(F.expr("size(_all) * (size(_all) - 1) div 2"))).first()[0] or 0
    large = sizes.where(F.col("n") > TASK_PAIRS).select("source", F.ceil(F.col("n") / TASK_PAIRS).cast("int").alias("_tasks"))  # at most total / TASK_PAIRS rows
    # the order of direction bits in a target's row: forward, then backward
    ways = F.transform("_b", lambda b: F.struct(b["entity_id"].alias("target"), ((F.col("_a.agent") & b["patient"]).cast("tinyint") + (F.col("_a.patient") & b["agent"]).cast("tinyint") * 2).cast("tinyint").alias("way")))
    rows = rows.select(F.col("_a.entity_id").alias("source"), ways.alias("_b")).join(F.broadcast(large), "source", "left").withColumn("_tasks", F.coalesce("_tasks", F.lit(1)))
    task = lambda t: F.pmod(F.xxhash64(t["target"]), F.col("_tasks")).cast("int")
    split = F.when(F.col("_tasks") == 1, F.array(F.struct(F.lit(0).alias("task"), F.col("_b").alias("b")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("_tasks") - 1), lambda i: F.struct(i.alias("task"), F.filter("_b", lambda t: task(t) == i).alias("b"))))
    rows = rows.select("source", F.inline(split)).where("size(b) > 0").repartition(max(parts, -(-total // TASK_PAIRS)), "source", "task")
    pairs = rows.select("source", "task", F.inline("b"))
    counts = [F.count(F.lit(1)).alias("shared"), F.count_if(F.col("way").bitwiseAND(F.lit(1)) == 1).alias("forward"), F.count_if(F.col("way").bitwiseAND(F.lit(2)) == 2).alias("backward")]
    return pairs.groupBy("source", "task", "target").agg(*counts).drop("task")


def pair_snapshots(arguments: DataFrame, events: bool = True) -> DataFrame:
    """Per pair: shared events, those of each direction and, if wanted, the events themselves."""
    if not events:
        return pair_counts(arguments)
    counts = [F.count(F.lit(1)).alias("shared"), F.count_if("forward").alias("forward"), F.count_if("backward").alias("backward")]
    return pair_events(arguments).groupBy("source", "target").agg(*counts, F.array_sort(F.collect_list("event_id")).alias("events"))


def shared_places(arguments: DataFrame) -> DataFrame:
    """source, target, place: places of events that both take part in."""
    places = arguments.where(F.col("role").isin(*PLACE_ROLES)).select("event_id", F.coalesce("entity_id", "surface").alias("place")).repartition("event_id").distinct()
    return pair_events(arguments).join(places, "event_id").where("place <> source and place <> target").select("source", "target", "place").distinct()


def _held_titles(rows: DataFrame, case: str, title: str, text: str) -> DataFrame:
    """case, _x, _t: the different texts and titles, in lower case, of a case where the text holds the title.

    A text meets only titles that begin with ``LINK_LEAST`` characters it has.
    """
    begin = lambda c: F.substring(c, 1, LINK_LEAST)
    titles = rows.select(case, F.lower(title).alias("_t")).where(F.length("_t") >= LINK_LEAST).distinct().withColumn("_g", begin("_t"))
    texts = rows.select(case, F.lower(text).alias("_x")).where(F.length("_x") >= LINK_LEAST).distinct()
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_x") - LINK_LEAST + 1), lambda i: F.substring(F.col("_x"), i, F.lit(LINK_LEAST))))
    return texts.withColumn("_g", F.explode(grams)).join(titles, [case, "_g"]).where(F.contains("_x", F.col("_t"))).select(case, "_x", "_t")


def title_links(rows: DataFrame, case: str, title: str, text: str) -> DataFrame:
    """from, to within a case where a text holds another row's title, letter case aside; short titles don't count."""
    texts = rows.select(case, F.col("row_id").alias("from"), F.lower(text).alias("_x"))
    titles = rows.select(case, F.col("row_id").alias("to"), F.lower(title).alias("_t"))
    return _held_titles(rows, case, title, text).join(texts, [case, "_x"]).join(titles, [case, "_t"]).where("from <> to").select(case, "from", "to")


def title_link_counts(rows: DataFrame, case: str, title: str, text: str) -> DataFrame:
    """case, links: how many rows ``title_links`` has of each case that has some, without the rows."""
    low = rows.where(F.col("row_id").isNotNull()).select(case, "row_id", F.lower(text).alias("_x"), F.lower(title).alias("_t"))
    held = _held_titles(rows, case, title, text)
    many = lambda c, n: low.groupBy(case, c).agg(F.count(F.lit(1)).alias(n))
    all_ = held.join(many("_x", "_n"), [case, "_x"]).join(many("_t", "_m"), [case, "_t"]).groupBy(case).agg(F.sum(F.col("_n") * F.col("_m")).alias("links"))
    same = low.select(case, "row_id", "_x").join(low.select(case, "row_id", "_t"), [case, "row_id"])
    own = same.where((F.length("_t") >= LINK_LEAST) & F.contains("_x", F.col("_t"))).groupBy(case).agg(F.count(F.lit(1)).alias("_own"))
    return all_.join(own, case, "left").select(case, (F.col("links") - F.coalesce("_own", F.lit(0))).alias("links")).where("links > 0")


def shared_key_edges(rows: DataFrame, group: str, item: str, keys: str) -> DataFrame:
    """group, left, right, key for items of a group that share a key (left before right)."""
    flat = rows.select(group, item, F.explode(F.array_distinct(keys)).alias("key"))
    other = flat.select(group, F.col(item).alias("right"), "key")
    return flat.withColumnRenamed(item, "left").join(other, [group, "key"]).where("left < right").select(group, "left", "right", "key")


def complexity(rows: DataFrame, group: str, item: str, keys: str) -> DataFrame:
    """Items, shared keys, pairs with a shared key and buckets for each group."""
    flat = rows.select(group, item, F.explode(F.array_distinct(keys)).alias("key"))
    shared = flat.groupBy(group, "key").agg(F.count_distinct(item).alias("n")).where("n > 1").groupBy(group).agg(F.count(F.lit(1)).alias("shared"))
    pairs = shared_key_edges(rows, group, item, keys).groupBy(group).agg(F.count_distinct("left", "right").alias("pairs"))
    out = rows.groupBy(group).agg(F.count_distinct(item).alias("items")).join(shared, group, "left").join(pairs, group, "left").fillna(0, ["shared", "pairs"])
    n, p = F.col("items"), F.col("pairs")
    return out.withColumn("bucket", F.when((n <= 2) & (p <= 1), "simple").when((n <= 4) & (p <= 4), "medium").otherwise("complex")).withColumn("size_bucket", F.when(n <= 2, "1-2").when(n <= 5, "3-5").otherwise("6+")).withColumn("pair_bucket", F.when(p == 0, "0").when(p <= 2, "1-2").otherwise("3+"))


def contained(mentions: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Mentions that lie within a span of the same key: an equi-join on the key with a range condition."""
    return mentions.join(spans, key).where("m_start >= s_start and m_end <= s_end")


def coverage_audit(chunks: DataFrame, events: DataFrame, arguments: DataFrame) -> DataFrame:
    """Per chunk: events, arguments, resolved and unresolved ones, events whose participants are incomplete (an unknown status is not)."""
    # an event's arguments are counted before they meet it, and events once they are in their chunk: no distinct sets
    told = arguments.groupBy("event_id").agg(F.count("argument_id").alias("_n"), F.count_if(F.col("argument_id").isNotNull() & F.coalesce(F.col("status") == "resolved", F.lit(False))).alias("_of"), F.count_if(F.coalesce(F.col("status") == "resolved", F.lit(False))).alias("_resolved"))
    own = events.where("event_id IS NOT NULL").groupBy("chunk_id", "event_id").agg(F.count(F.lit(1)).alias("_rows"), F.max(F.coalesce(F.col("event_status") != "complete", F.lit(False))).alias("_open")).join(told, "event_id", "left").fillna(0, ["_n", "_of", "_resolved"])
    per = own.groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.col("_rows") * F.col("_n")).alias("arguments"), F.sum(F.col("_rows") * F.col("_resolved")).alias("resolved"), F.sum(F.col("_rows") * (F.col("_n") - F.col("_of"))).alias("unresolved"), F.count_if("_open").alias("incomplete_events"),
    )
    times = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("_times"))
    rows = times.join(per, "chunk_id", "left").fillna(0, ["events", "arguments", "resolved", "unresolved", "incomplete_events"])
    return rows.select("chunk_id", "events", *((F.col("_times") * F.col(c)).alias(c) for c in ("arguments", "resolved", "unresolved")), "incomplete_events")


def reached(edges: DataFrame, seeds: DataFrame, allowed: DataFrame, part: list[str], most: int = 64) -> DataFrame:
    """Fixed point: nodes reached from seeds over undirected edges (part, a, b) through allowed nodes (part, node).

    A graph that is not exhausted after ``most`` rounds is an error, never a partial result.
    """
    both = cut(edges.select(*part, "a", "b").unionByName(edges.select(*part, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    allowed = cut(allowed.select(*part, "node"))
    known = cut(seeds.select(*part, "node").distinct())
    fresh = known
    for _ in range(most):
        step = fresh.withColumnRenamed("node", "a").join(both, [*part, "a"]).select(*part, F.col("b").alias("node")).distinct()
        fresh = cut(step.join(allowed, [*part, "node"], "left_semi").join(known, [*part, "node"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)
    raise RuntimeError(f"nodes are still being reached after {most} rounds")


def neighbours(rows: DataFrame, part: str, order: str, value: str, before: int, after: int) -> DataFrame:
    """Values at most before/after places away, in order."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(-before, after)
    return rows.withColumn("window", F.collect_list(value).over(w))


def ring(rows: DataFrame, part: str, order: str, value: str, keep: int) -> DataFrame:
    """The last ``keep`` values up to each row."""
    return rows.withColumn("ring", F.collect_list(value).over(Window.partitionBy(part).orderBy(order).rowsBetween(-(keep - 1), 0)))


def running_union(rows: DataFrame, part: str, order: str, value: str) -> DataFrame:
    """The sorted set of values up to each row."""
    return rows.withColumn("known", F.array_sort(F.collect_set(value).over(Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))))


def running_offsets(rows: DataFrame, part: str, order: str, text: str) -> DataFrame:
    """Start of each text when a part's texts are laid end to end with one character between."""
    before = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0)).cast("long"))


def dangling(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not exist: a contract is kept if there are none."""
    return rows.where(F.col(key).isNotNull()).join(keys.select(key).distinct(), key, "left_anti")
