"""Near-duplicates by bottom-k sketches from one hash function.

Rows with equal shingle sets (128 bits of sums over them) are one node.  A node
keeps the SKETCH least of its shingles' hash values.  The least SKETCH values of
two sets' union estimate their Jaccard similarity: pairs whose sketches share
fewer of them than the limit less DEVIATIONS standard deviations are ruled out,
so at most ALLOWED of those values are not shared by a pair that stays (for sets
that are whole in their sketches: exactly those pairs stay).  The inverted lists
lose none of the pairs that stay:

* A value is hot if more than LIST nodes retain it.  Every node is listed under
  its first ALLOWED + 1 values that are not hot.  All such values before the first
  one that a pair shares are unshared, so their number in both nodes together is
  ALLOWED at most, and both nodes are listed under the shared one.
* Only a node with ALLOWED or fewer values that are not hot can share hot values
  alone.  Such nodes are also listed under every two values that follow each
  other in their sketch: SKETCH - ALLOWED shared values with ALLOWED between them
  hold such a couple.  Unrelated texts with a common passage hardly share one.
  Couples of more than LIST nodes hold large families of near copies, which are
  chained, not paired.

What is linked so far forms families.  Each family, in blocks of bounded nodes and
shingles, gets its full sets once and is checked there exactly: pairs that the
sketches allow and that are not yet connected are compared on full sets.  Only a
spanning forest of the links that hold leaves a task.  Components of those
links, found by alternating stars, are the result.

Defined results: null texts are empty; a text without words is alone; one with
fewer words than a shingle has its whole sequence as its shingle; repeated rows are copies of each
other; rows without an id never name a component that has one; very long texts are
hashed in slices; the least id of a component names it; an empty table gives an
empty result; other columns are ignored by the query and kept by the stage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.store import aside, dropped, table, written
from graphloom.llm.wordhash import mix, slices, word_shingles, words_of

SIMILAR = 80  # percent
#: Words in a shingle of the pipeline's stage; op4 is bound to two.
STAGE_WORDS = 5
SKETCH = 64
LIST = 48
#: Nodes and shingles of a family's block, and of a bin of small families.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
BIN_NODES, BIN_SHINGLES = 512, 1 << 20
#: More ids, or hot values, than this are joined by shuffle.
BROADCAST_IDS = 2_000_000
BROADCAST_HOT = 1_000_000
#: Bits that stand for a sketch where pairs are first met.
BITS = 256
#: Deviations below the limit at which the sketch of the union rules a pair out.
DEVIATIONS = 5.0
#: Unshared values among the union's SKETCH least of a pair that is not ruled out.
ALLOWED = SKETCH - math.ceil(SKETCH * SIMILAR / 100 - DEVIATIONS * math.sqrt(SKETCH * SIMILAR / 100 * (1 - SIMILAR / 100)))
#: Sets up to this size have partners that are whole in their sketches; n / 4 of their values may then be unshared.
WHOLE = SKETCH * SIMILAR // 100


def _hash63(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(1)).astype(np.int64)


def _sets(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles (ascending within a row), row offsets, and two hashes that stand for each row's set."""
    shingles, offsets = word_shingles(words_of(batch["text"]), size)
    with np.errstate(over="ignore"):
        sums = [np.concatenate(([np.uint64(0)], np.cumsum(mix(shingles * k)))) for k in (np.uint64(1), np.uint64(0xD6E8FEB86659FD93))]
        first, second = (np.diff(s[offsets]) for s in sums)
        node = mix(first ^ mix(second)).view(np.int64)
    return _hash63(shingles), offsets, node, second.view(np.int64)


def _lists(values: np.ndarray, offsets: np.ndarray, most: int | None) -> pa.ListArray:
    """Arrow lists of each row's first ``most`` values."""
    size = np.diff(offsets)
    take = size if most is None else np.minimum(size, most)
    ends = np.concatenate(([0], np.cumsum(take)))
    at = np.arange(ends[-1]) + np.repeat(offsets[:-1] - ends[:-1], take)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[at], pa.int64()))


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            values, offsets, first, second = _sets(batch, size)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(np.diff(offsets)), pa.array(first), pa.array(second), _lists(values, offsets, SKETCH)], ["doc_id", "text_hash", "n", "h1", "h2", "sketch"])

    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            values, offsets, first, second = _sets(batch, size)
            yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), _lists(values, offsets, None)], ["h1", "h2", "shingles"])

    return run


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """BITS bits for each sketch, one set by each value: what one node has alone of them counts no more than its unshared values."""
    for batch in batches:
        lists = batch["sketch"]
        flat, sizes = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
        words = np.zeros((len(sizes), BITS // 64), dtype=np.uint64)
        at = flat & (BITS - 1)
        np.bitwise_or.at(words, (np.repeat(np.arange(len(sizes)), sizes), at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        ends = pa.array(np.arange(len(sizes) + 1) * (BITS // 64), pa.int32())
        yield pa.RecordBatch.from_arrays([batch["node"], batch["n"], pa.ListArray.from_arrays(ends, pa.array(words.view(np.int64).reshape(-1)))], ["node", "n", "bits"])


def unshared(n: Column) -> Column:
    """How many values a node of this size may not share with one that it is similar to."""
    return F.when(n <= WHOLE, F.floor(n / 4)).otherwise(F.lit(ALLOWED)).cast("int")


def _cool(shared):
    """The first values of each sketch that are not hot, and whether there are too few of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in batches:
            lists, n = batch["sketch"], batch["n"].to_numpy()
            flat, offsets = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
            at = np.searchsorted(hot, flat)
            at[at == len(hot)] = 0
            cool = hot[at] != flat if len(hot) else np.ones(len(flat), bool)
            before = np.concatenate(([0], np.cumsum(cool)))
            row = np.repeat(np.arange(len(n)), np.diff(offsets))
            most = np.where(n <= WHOLE, n // 4, ALLOWED)
            take = cool & (before[:-1] - before[offsets[row]] <= most[row])
            ends = np.concatenate(([0], np.cumsum(take)))[offsets]
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[take]))
            yield pa.RecordBatch.from_arrays([batch["node"], batch["n"], keys, pa.array(before[offsets[1:]] - before[offsets[:-1]] <= most)], ["node", "n", "keys", "heavy"])

    return run


def cool_values(nodes: DataFrame, broadcast: int = BROADCAST_HOT) -> DataFrame:
    """node, n, keys (its first values that are not hot), heavy (it may share hot values alone)."""
    hot = written(nodes.select(F.explode("sketch").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > LIST).select("key"), "dup-hot")
    if hot.count() <= broadcast:
        values = np.sort(hot.toArrow()["key"].to_numpy())  # at most ``broadcast`` rows
        return nodes.select("node", "n", "sketch").mapInArrow(_cool(nodes.sparkSession.sparkContext.broadcast(values)), "node long, n long, keys array<long>, heavy boolean")
    each = nodes.select("node", "n", F.posexplode("sketch").alias("at", "key")).join(hot.withColumn("hot", F.lit(True)), "key", "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("hot").isNull(), F.struct("at", "key"))))
    rows = each.groupBy("node", "n").agg(kept.alias("kept"))
    most = unshared(F.col("n"))
    return rows.select("node", "n", F.transform(F.slice("kept", F.lit(1), most + 1), lambda x: x["key"]).alias("keys"), (F.size("kept") <= most).alias("heavy"))


def _sized(keyed: DataFrame) -> DataFrame:
    """Rows of node, n, key with the length of the key's list; keys of one node are gone."""
    return keyed.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "key")


def _pairs(keyed: DataFrame) -> DataFrame:
    """Pairs of fitting sizes within each (short) list of node, n, i: with no more values before this one than may be unshared."""
    lists = keyed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "node", "i"))).alias("m")).where("size(m) > 1")
    later = lambda x, i: F.transform(
        F.filter(F.slice("m", i + 2, F.lit(LIST)), lambda y: (x["n"] * 100 >= y["n"] * SIMILAR) & (x["i"] + y["i"] <= unshared(x["n"]))),
        lambda y: F.struct(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b")),
    )
    return lists.select(F.explode(F.flatten(F.transform("m", later))).alias("p")).select("p.a", "p.b")


def _may_be_allowed(left: str, right: str, n_left: Column, n_right: Column) -> Column:
    """Whether the bits rule the pair out: one node has more of them alone than it may have values."""
    def alone(a: str, b: str) -> Column:
        return sum((F.bit_count(F.col(a)[w].bitwiseAND(F.bitwise_not(F.col(b)[w]))) for w in range(BITS // 64)), F.lit(0))

    return (alone(left, right) <= unshared(n_left)) & (alone(right, left) <= unshared(n_right))


def _allowed(left: Column, right: Column, n_left: Column, n_right: Column) -> Column:
    """Whether the sketch of the union lets the pair be similar; exact where both sketches are whole sets."""
    both = F.array_intersect(left, right)
    union = F.slice(F.array_sort(F.array_union(left, right)), 1, SKETCH)
    common, size = F.size(F.array_intersect(union, both)), F.size(union)
    s = SIMILAR / 100
    guess = common >= size * s - DEVIATIONS * F.sqrt(size * s * (1 - s))
    exact = F.size(both) * 100 >= (n_left + n_right - F.size(both)) * SIMILAR
    return F.when((n_left <= SKETCH) & (n_right <= SKETCH), exact).otherwise(guess)


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, root (the least node of its component) of every node of ``edges`` (a, b), by alternating large and small stars."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "m").where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v"))
        last, now = now, written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        dropped(last)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class _Forest:
    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, i: int, j: int) -> bool:
        a, b = self.of[i], self.of[j]
        if a == b:
            return False
        self.of[self.of == max(a, b)] = min(a, b)
        return True


def _sketch_overlaps(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Which of rows x cols the sketches of their unions allow."""
    s = SIMILAR / 100
    own = [x[:SKETCH] for x in sets]
    out = np.zeros((len(rows), len(cols)), dtype=bool)
    flat = np.concatenate([own[c] for c in cols])
    where = np.repeat(np.arange(len(cols)), [len(own[c]) for c in cols])
    sizes = np.array([len(sets[c]) for c in cols])
    lengths = np.array([len(own[c]) for c in cols])
    starts = np.cumsum(lengths) - lengths
    for i, r in enumerate(rows):
        mine = own[r]
        at = np.searchsorted(mine, flat)
        at[at == len(mine)] = 0
        hit = mine[at] == flat
        common = np.bincount(where, weights=hit, minlength=len(cols))
        # rank of each value in its union: its place among its own, plus smaller ones of mine, less common smaller ones
        before = np.cumsum(hit) - hit
        rank = np.arange(len(flat)) - starts[where] + np.searchsorted(mine, flat) - (before - before[starts[where]])
        low = np.bincount(where, weights=hit & (rank < SKETCH), minlength=len(cols))
        size = np.minimum(SKETCH, len(mine) + lengths - common)
        fits = np.minimum(sizes, len(sets[r])) * 100 >= np.maximum(sizes, len(sets[r])) * SIMILAR
        out[i] = fits & (low >= size * s - DEVIATIONS * np.sqrt(size * s * (1 - s)))
    return out


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the exact links between ``left`` and ``right`` (positions in ``sets``)."""
    forest, out = _Forest(len(sets)), []
    same = left is right
    for a in range(0, len(left), 64):
        rows = left[a : a + 64]
        allowed = _sketch_overlaps(sets, rows, right)
        for i, r in enumerate(rows):
            near = right[allowed[i]]
            near = near[(near > r) if same else (near != r)]
            near = near[forest.of[near] != forest.of[r]]
            if not len(near):
                continue
            lengths = np.array([len(sets[c]) for c in near])
            flat, mine = np.concatenate([sets[c] for c in near]), sets[r]
            at = np.searchsorted(mine, flat)
            at[at == len(mine)] = 0
            common = np.bincount(np.repeat(np.arange(len(near)), lengths), weights=mine[at] == flat, minlength=len(near))
            for c in near[common * 100 >= (lengths + len(mine) - common) * SIMILAR]:
                if forest.join(r, c):
                    out.append((r, c))
    return out


def _verify(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    edges = []
    for _, family in pdf.groupby("root", sort=False):
        family = family.sort_values("node", kind="stable")
        nodes, sets = family["node"].to_numpy(), [np.asarray(s, dtype=np.int64) for s in family["shingles"]]
        part = family["part"].to_numpy()
        if (part == part[0]).all():
            everyone = np.arange(len(nodes))
            found = _links(sets, everyone, everyone)
        else:
            low = part == part.min()
            found = _links(sets, np.flatnonzero(low), np.flatnonzero(~low))
        edges += [(nodes[i], nodes[j]) for i, j in found]
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def similar_components(docs: DataFrame, size: int = 2) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id of every row of doc_id, text, by shingles of ``size`` words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    rows = written(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_sketches(size), "doc_id long, text_hash long, n long, h1 long, h2 long, sketch array<long>"), "dup-rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "text_hash")).alias("least")
    nodes = rows.where("n > 0").groupBy("h1", "h2").agg(least, F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    # numbers, not hashes, name the nodes from here on: no two sets are taken for one
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "n", "sketch", F.col("least.doc_id").alias("rep"), F.col("least.text_hash").alias("rep_text")), "dup-nodes")
    # the sketches stay with the nodes alone
    wide, rows = rows, written(rows.drop("sketch"), "dup-rows")
    dropped(wide)
    cool = written(cool_values(nodes), "dup-cool")
    marks = written(nodes.select("node", "n", "sketch").mapInArrow(_bits, "node long, n long, bits array<long>"), "dup-bits")
    values = cool.select("node", "n", F.posexplode("keys").alias("i", "key"))
    couples = F.transform(F.sequence(F.lit(1), F.size("sketch") - 1), lambda t: F.xxhash64(F.get("sketch", t - 1), F.get("sketch", t)))
    heavy = nodes.where("size(sketch) > 1").join(cool.where("heavy").select("node"), "node", "left_semi")
    dense = written(_sized(heavy.select("node", "n", F.explode(F.array_distinct(couples)).alias("key"))), "dup-couples")
    short = dense.where(F.col("size") <= LIST).select("node", "n", "key", F.lit(0).alias("i"))
    pairs = _pairs(values).unionByName(_pairs(short)).distinct()
    side = lambda c, table, what: table.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col(what).alias(f"s{c}"))
    met = lambda rows, table, what: rows.join(side("a", table, what), "a").join(side("b", table, what), "b")
    # most pairs part by few bits; sketches are sent to the others alone
    pairs = met(pairs, marks, "bits").where(_may_be_allowed("sa", "sb", F.col("na"), F.col("nb"))).select("a", "b")
    pairs = met(pairs, nodes, "sketch").where(_allowed(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb"))).select("a", "b")
    long = dense.where(F.col("size") > LIST)
    chains = long.join(long.groupBy("key").agg(F.min("node").alias("b")), "key").select(F.col("node").alias("a"), "b").where("a <> b")
    families = written(components(pairs.unionByName(chains), "dup-families"), "dup-family")
    dropped(cool, marks, dense)
    links = _verified(docs, nodes, families, size)
    linked = components(links, "dup-links")
    labelled = nodes.select("node", "h1", "h2", "rep").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    labelled = labelled.select("h1", "h2", "root").join(least, "root").select("h1", "h2", "component_id")
    out = rows.join(labelled, ["h1", "h2"], "left")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def _verified(docs: DataFrame, nodes: DataFrame, families: DataFrame, size: int) -> DataFrame:
    """Links (a, b) between nodes of one family that hold on full sets: a spanning forest per task."""
    wanted = written(families.join(nodes.select("node", "h1", "h2", "n", "rep", "rep_text"), "node"), "dup-wanted")
    count, shingles = wanted.agg(F.count(F.lit(1)), F.sum("n")).first()
    ids = wanted.select("rep", "rep_text").distinct()
    ids = F.broadcast(ids) if count <= BROADCAST_IDS else ids
    # by text too: the rows of a node may all be without an id
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["rep"]) & (F.xxhash64("text") == F.col("rep_text")), "left_semi")
    sets = texts.select("text").mapInArrow(_full_sets(size), "h1 long, h2 long, shingles array<long>")
    sizes = wanted.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    place = wanted.select("node", "h1", "h2", "root").join(sizes, "root")
    place = place.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))
    bins = max(1, count // BIN_NODES, (shingles or 0) // BIN_SHINGLES)
    small = F.col("parts") == 1
    # a small family lies in a bin with others; a block of a large one meets every block
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    place = place.withColumn("other", other)
    place = place.withColumn("bin", F.when(small, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.col("root")))
    place = place.withColumn("i", F.when(small, -1).otherwise(F.least("part", "other"))).withColumn("j", F.when(small, -1).otherwise(F.greatest("part", "other")))
    placed = sets.dropDuplicates(["h1", "h2"]).join(place.select("node", "h1", "h2", "root", "bin", "part", "i", "j"), ["h1", "h2"]).drop("h1", "h2")
    return written(placed.groupBy("bin", "i", "j").applyInPandas(_verify, "a long, b long"), "dup-verified")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_components(table(spark, sf_dir, "documents"), 2)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d),
n AS (SELECT rid, doc_id, CAST(len(g) AS BIGINT) AS n_shingles, md5(array_to_string(list_sort(g), chr(10))) AS h, g FROM s),
c AS (SELECT h, min(doc_id) AS rep, any_value(n_shingles) AS n, any_value(g) AS g FROM n WHERE n_shingles > 0 GROUP BY h),
x AS (SELECT h, n, unnest(g) AS t FROM c),
l AS (SELECT a.h AS a, b.h AS b FROM x a JOIN x b ON a.t = b.t AND a.h < b.h AND least(a.n, b.n) * 100 >= 80 * greatest(a.n, b.n) GROUP BY a.h, b.h, a.n, b.n HAVING count(*) * 100 >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT h AS a, h AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT r.a AS h, min(c.rep) AS component_id FROM r JOIN c ON c.h = r.b GROUP BY r.a)
SELECT doc_id, n_shingles, CASE WHEN n_shingles = 0 THEN doc_id ELSE component_id END AS component_id, doc_id = CASE WHEN n_shingles = 0 THEN doc_id ELSE component_id END AS kept FROM n LEFT JOIN m USING (h)
"""


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near-duplicates on STAGE_WORDS-word shingles, that with the least id."""
    found = similar_components(docs, STAGE_WORDS).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = written(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")).distinct(), "dup-kept")
    docs, back = aside(docs, "doc_id", "text")
    hashed = docs.withColumn("_hash", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    same = Window.partitionBy("doc_id", "_hash").orderBy("doc_id")
    stays = hashed.join(kept, hashed["doc_id"].eqNullSafe(kept["_id"]) & (hashed["_hash"] == kept["_text"]), "left_semi")
    return stays.withColumn("_copy", F.row_number().over(same)).where("_copy = 1").select(*back)
