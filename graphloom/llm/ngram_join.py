"""Jaccard join of word n-gram sets: size-banded tiles, hashed bitmaps, exact intersections.

Rows with equal sets are one node.  Sizes fall into bands whose bounds grow by
100 / SIMILAR, so that linked nodes lie in one band or in neighbouring ones.

Families.  Two linked sets of which the larger lies in band T differ in at most
``unshared(T)`` shingles, d.  The hash space is cut into d + 2 segments, so at
least two segments hold the same shingles in both, and one of them is not empty
unless two are empty.  Every node names each of its segments (band, segment, hash
of the contents) for its own band and for the next one, where it may be the
smaller side; empty segments are named only by nodes that have two.  Nodes that
share a name are chained to the least one (by a hash of their sets: a clash would
only make a family larger); the components of these chains, the
families, therefore hold all links.  Texts that share a passage only hardly ever
agree in a whole segment.

Tiles.  A family is cut into blocks by band and, if a band holds more than BLOCK
nodes or BLOCK_SHINGLES shingles, by number.  A tile is a block with itself or
with a block of the same or the next band; small families share a tile, but not
each other's nodes.  In a tile, sets are ordered by size, each with a bitmap of
its hashed shingles: every bit that only one side has stands for a shingle that
only this side has, so counts of such bits bound the intersection from above.
What passes is intersected exactly, as sorted arrays; nodes that are connected
already are skipped, and a spanning forest of the links leaves the tile.

Defined results: null texts are empty; a text without words has no shingle and is
linked with nothing; one with fewer words than a shingle has its whole sequence as
its shingle; repeated rows are copies of each other; rows without an id never name
a component that has one; very long texts are hashed in slices; the least id of a
component names it; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.neardup import _full_sets, _sets, components
from graphloom.llm.store import table, written
from graphloom.llm.wordhash import mix, slices

SIMILAR = 90  # percent
WORDS = 3
#: Nodes and shingles of a block, and of small families that share a tile.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21
BIN_NODES, BIN_SHINGLES = 512, 1 << 20
#: Bits of a bitmap: two a shingle of the largest set, within these bounds (longer sets are bounded less tightly).
LEAST_BITS, MOST_BITS = 128, 8192
#: Sets that are intersected at once.
CHUNK = 64
#: Sets that a task remembers in order not to send equal ones twice (they are sent again after more).
SEEN = 1 << 20
#: More ids than this are joined by shuffle.
BROADCAST_IDS = 2_000_000


def band_bounds(similar: int = SIMILAR, most: int = 1 << 40) -> np.ndarray:
    """The least size of each band: sizes that can be linked lie at most one band apart."""
    bounds = [1]
    while bounds[-1] < most:
        bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * 100 // similar)))
    return np.array(bounds)


def unshared(band: np.ndarray, similar: int = SIMILAR) -> np.ndarray:
    """In how many shingles two linked sets may differ of which the larger lies in the band."""
    largest = band_bounds(similar)[band + 1] - 1
    return 2 * largest * (100 - similar) // (100 + similar)


def segment_names(values: np.ndarray, offsets: np.ndarray, similar: int = SIMILAR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of segments by row, the offsets of the rows, and each row's band (-1: no shingle)."""
    n = np.diff(offsets)
    band = np.searchsorted(band_bounds(similar), n, side="right") - 1
    row = np.repeat(np.arange(len(n)), n)
    found_rows, found = [], []
    with np.errstate(over="ignore"):
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(values.astype(np.uint64) + np.uint64(1)))))
        for ahead in (0, 1):
            tile = np.where(n > 0, band + ahead, 0)
            d = unshared(tile, similar)
            parts = np.where((n > 0) & (d > 0), d + 2, 0)
            here = parts[row] > 0
            if not here.any():
                continue
            at = np.flatnonzero(here)
            segment = ((values[at] >> 31) * parts[row[at]]) >> 32
            first = np.flatnonzero(np.concatenate(([True], (row[at][1:] != row[at][:-1]) | (segment[1:] != segment[:-1]))))
            start, end = at[first], np.append(at[first[1:]], at[-1] + 1)
            # rows between lie outside ``at``: a segment ends where its own row does
            end = np.minimum(end, offsets[1:][row[start]])
            held_row, held_segment = row[start], segment[first]
            name = lambda r, s, contents: mix(contents ^ mix((tile[r] << 32 | s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))  # noqa: B023, E731
            found_rows.append(held_row)
            found.append(name(held_row, held_segment, sums[end] - sums[start]))
            empties = parts - np.bincount(held_row, minlength=len(n))
            for r in np.flatnonzero(empties > 1):
                empty = np.setdiff1d(np.arange(parts[r]), held_segment[held_row == r])
                found_rows.append(np.full(len(empty), r))
                found.append(name(found_rows[-1], empty, np.zeros(len(empty), np.uint64)))
    if not found:
        return np.empty(0, np.int64), np.zeros(len(n) + 1, np.int64), band
    rows, names = np.concatenate(found_rows), np.concatenate(found).view(np.int64)
    order = np.argsort(rows, kind="stable")
    return names[order], np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(n))))), band


def _sized(size: int, similar: int):
    """Each row's size and band, and the two hashes that stand for its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            _, offsets, first, second = _sets(batch, size)
            n = np.diff(offsets)
            band = np.searchsorted(band_bounds(similar), n, side="right") - 1
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(n), pa.array(band, pa.int32()), pa.array(first), pa.array(second)], ["doc_id", "text_hash", "n", "band", "h1", "h2"])

    return run


def _named(size: int, similar: int):
    """name, h1 of every segment that a set names; a task names the segments of equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in (part for whole in batches for part in slices(whole)):
            values, offsets, first, _ = _sets(batch, size)
            names, ends, _ = segment_names(values, offsets, similar)
            fresh = np.zeros(len(first), bool)
            for i, h in enumerate(first.tolist()):
                if h not in seen:
                    fresh[i] = True
                    seen.add(h)
            if len(seen) > SEEN:
                seen.clear()
            count = np.diff(ends)
            keep = np.repeat(fresh, count)
            yield pa.RecordBatch.from_arrays([pa.array(names[keep]), pa.array(np.repeat(first, count)[keep])], ["name", "h1"])

    return run


def _full_sets_once(size: int):
    """h1, h2, shingles of each set, once per task for equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in _full_sets(size)(batches):
            fresh = []
            for pair in zip(batch["h1"].to_pylist(), batch["h2"].to_pylist(), strict=True):
                fresh.append(pair not in seen)
                seen.add(pair)
            if len(seen) > SEEN:
                seen.clear()
            yield batch.filter(pa.array(fresh))

    return run


def bitmaps(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of 64-bit words for each set."""
    n = np.diff(offsets)
    bits = LEAST_BITS
    while bits < min(2 * n.max(), MOST_BITS):
        bits *= 2
    out = np.empty((len(n), bits // 64), np.uint64)
    for a in range(0, len(n), 256):
        b = min(a + 256, len(n))
        held = np.zeros((b - a, bits), np.uint8)
        held[np.repeat(np.arange(b - a), n[a:b]), flat[offsets[a] : offsets[b]] & (bits - 1)] = 1
        out[a:b] = np.packbits(held, axis=1).view(np.uint64)
    return out


def may_reach(signatures: np.ndarray, n: np.ndarray, one: int, others: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Whether bit counts leave room for an intersection of ``need``."""
    mine, theirs = signatures[one], signatures[others]
    only_mine = np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64)
    only_theirs = np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64)
    return np.minimum(n[one] - only_mine, n[others] - only_theirs) >= need


def tile_links(flat: np.ndarray, offsets: np.ndarray, side: np.ndarray, similar: int = SIMILAR) -> list[tuple[int, int]]:
    """A spanning forest of the exact links of a tile: between sides 0 and 1, or among all sets if there is one side."""
    n = np.diff(offsets)
    signatures, label, out = bitmaps(flat, offsets), np.arange(len(n)), []
    left = np.flatnonzero(side == side.min())
    left = left[np.argsort(n[left], kind="stable")]
    right = left if (side == side[0]).all() else np.flatnonzero(side != side.min())
    right = right[np.argsort(n[right], kind="stable")]
    sizes = n[right]
    for place, one in enumerate(left):
        low = place + 1 if right is left else np.searchsorted(sizes, -(-n[one] * similar // 100))
        near = right[low : np.searchsorted(sizes, n[one] * 100 // similar, side="right")]
        near = near[label[near] != label[one]]
        if not len(near):
            continue
        need = -(-similar * (n[one] + n[near]) // (100 + similar))
        fits = may_reach(signatures, n, one, near, need)
        near, need = near[fits], need[fits]
        mine = flat[offsets[one] : offsets[one + 1]]
        for a in range(0, len(near), CHUNK):
            some = near[a : a + CHUNK]
            theirs = np.concatenate([flat[offsets[c] : offsets[c + 1]] for c in some])
            at = np.searchsorted(mine, theirs)
            at[at == len(mine)] = 0
            common = np.bincount(np.repeat(np.arange(len(some)), n[some]), weights=mine[at] == theirs, minlength=len(some))
            for c in some[common >= need[a : a + CHUNK]]:
                if label[c] != label[one]:
                    label[label == max(label[c], label[one])] = min(label[c], label[one])
                    out.append((one, c))
    return out


def _tile(similar: int):
    def run(rows: pa.Table) -> pa.Table:
        lists = rows["shingles"].combine_chunks()
        flat, node, root, block = lists.flatten().to_numpy(), *(rows[c].to_numpy() for c in ("node", "root", "block"))
        offsets = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        a, b = [], []
        order = np.lexsort((node, root))
        order = order[np.concatenate(([True], np.diff(node[order]) != 0))]  # repeated rows of several tasks
        for family in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
            own = np.concatenate([flat[offsets[i] : offsets[i + 1]] for i in family])
            ends = np.concatenate(([0], np.cumsum(offsets[family + 1] - offsets[family])))
            found = tile_links(own, ends, block[family], similar)
            a += [node[family[i]] for i, _ in found]
            b += [node[family[j]] for _, j in found]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def tiles(families: DataFrame) -> DataFrame:
    """node, h1, h2, root, block, bin, i, j: every tile that each node of a family meets (i, j: its blocks, -1 for small families)."""
    whole = families.groupBy("root").agg(F.count(F.lit(1)).alias("all"), F.sum("n").alias("all_n"))
    bands = families.groupBy("root", "band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("parts"))
    beside = lambda by, name: bands.select("root", (F.col("band") - by).alias("band"), F.col("parts").alias(name))
    sizes = bands.join(beside(1, "above"), ["root", "band"], "left").join(beside(-1, "below"), ["root", "band"], "left").fillna(0, ["above", "below"])
    totals = whole.agg(F.sum("all").alias("all"), F.sum("all_n").alias("n")).first()
    bins = max(1, (totals["all"] or 0) // BIN_NODES, (totals["n"] or 0) // BIN_SHINGLES)
    placed = families.join(whole, "root").join(sizes, ["root", "band"])
    small = (F.col("all") <= BLOCK) & (F.col("all_n") <= BLOCK_SHINGLES)
    number = lambda band, part: (F.col("band") + band).cast("long") * F.lit(1 << 32) + part
    placed = placed.withColumn("block", F.when(small, -1).otherwise(number(0, F.pmod(F.xxhash64("node"), F.col("parts")))))
    run = lambda parts, band: F.when(F.col(parts) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1), lambda p: number(band, p))).otherwise(F.array().cast("array<long>"))
    others = F.concat(run("parts", 0), run("above", 1), run("below", -1))
    placed = placed.withColumn("other", F.explode(F.when(small, F.array(F.lit(-1).cast("long"))).otherwise(others)))
    bin_ = F.when(small, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.col("root"))
    return placed.select("node", "h1", "h2", "root", "block", bin_.alias("bin"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def jaccard_components(docs: DataFrame, size: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of doc_id, text."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rows = written(docs.mapInArrow(_sized(size, similar), "doc_id long, text_hash long, n long, band int, h1 long, h2 long"), "join-rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "text_hash")).alias("least")
    nodes = rows.where("n > 0").groupBy("h1", "h2").agg(least, F.first("n").alias("n"), F.first("band").alias("band"))
    # numbers, not hashes, name the nodes in tiles and links: no two sets are taken for one
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "n", "band", F.col("least.doc_id").alias("rep"), F.col("least.text_hash").alias("rep_text")), "join-nodes")
    names = docs.mapInArrow(_named(size, similar), "name long, h1 long")
    leader = F.first("h1").over(Window.partitionBy("name").orderBy("h1"))
    chains = names.select("h1", leader.alias("leader")).where("leader <> h1").distinct().select(F.col("h1").alias("a"), F.col("leader").alias("b"))
    families = components(written(chains, "join-chains"), "join-families").withColumnRenamed("node", "h1")
    families = written(families.join(nodes, "h1"), "join-family")
    ids = families.select("rep", "rep_text").distinct()
    ids = F.broadcast(ids) if families.count() <= BROADCAST_IDS else ids
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["rep"]) & (docs["text_hash"] == ids["rep_text"]), "left_semi").select("text")
    sets = texts.mapInArrow(_full_sets_once(size), "h1 long, h2 long, shingles array<long>")
    placed = sets.join(tiles(families), ["h1", "h2"]).drop("h1", "h2")
    links = written(placed.groupBy("bin", "i", "j").applyInArrow(_tile(similar), "a long, b long"), "join-links")
    linked = components(links, "join-components")
    labelled = nodes.select("node", "h1", "h2", "rep").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    labelled = labelled.join(labelled.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("h1", "h2", "component_id")
    out = rows.select("doc_id", "n", "h1", "h2").join(labelled, ["h1", "h2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
n AS (SELECT rid, doc_id, CAST(len(g) AS BIGINT) AS n_shingles, md5(array_to_string(list_sort(g), chr(10))) AS h, g FROM s),
c AS (SELECT h, min(doc_id) AS rep, any_value(n_shingles) AS n, any_value(g) AS g FROM n WHERE n_shingles > 0 GROUP BY h),
x AS (SELECT h, n, unnest(g) AS t FROM c),
l AS (SELECT a.h AS a, b.h AS b FROM x a JOIN x b ON a.t = b.t AND a.h < b.h AND least(a.n, b.n) * 100 >= 90 * greatest(a.n, b.n) GROUP BY a.h, b.h, a.n, b.n HAVING count(*) * 100 >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT h AS a, h AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT r.a AS h, min(c.rep) AS component_id FROM r JOIN c ON c.h = r.b GROUP BY r.a)
SELECT doc_id, n_shingles, CASE WHEN n_shingles = 0 THEN doc_id ELSE component_id END AS component_id FROM n LEFT JOIN m USING (h)
"""
