"""Exact top-k by inner product: best-first search in a forest of M-trees.

Vectors get one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, so
that the largest inner product with a query (whose extra coordinate is 0) is
the smallest Euclidean distance.  Shards of vectors are bulk-loaded into
M-trees stored as pages: leaf pages hold entries with their distances to the
page's pivot, inner pages hold leaf pivots with covering radii and distances to
their own pivot.  A search pops the page with the least lower bound; stored
distances bound entries and pages by the triangle inequality before any
distance is computed.  Scores themselves are exact integers.

Queries meet every shard in blocks.  A search does not start without a bound: the
k-th best score of a query among SEEDS vectors, broadcast to all, is one that
holds in every shard.  Each block keeps its k best, and a window merges the shards.

Defined results: vectors that are null or hold null or non-finite components,
and those without an id, take no part; a shorter vector counts as padded with zeros; rows that share a
query's id are its own and no candidates; equal scores go to the smaller id;
repeated candidate rows are each a candidate; components whose squares could pass
the range of a long are multiplied as Python integers, and a score beyond that
range becomes its limit; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.store import table, written

SCALE = 1024
K = 10
EVERY = 100
SHARD_ROWS = 8192
QUERY_BLOCK = 4096
LEAF = 48
PAGE = 256
#: Vectors, those with the least hash, that give every query its first bound.
SEEDS = 1024
#: Squared norms from here on are beyond int64 sums.
WIDE = 2.0**62
PAGES = "shard int, page int, parent int, pivot array<double>, radius double, to_parent double, ids array<long>, vectors binary, to_pivot array<double>"


def scaled(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def _nearest(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and distance to the nearest pivot, in blocks."""
    which, far = np.empty(len(points), dtype=int), np.empty(len(points))
    norms = (pivots**2).sum(1)
    for a in range(0, len(points), 2048):
        block = points[a : a + 2048]
        which[a : a + 2048] = (norms - 2 * block @ pivots.T).argmin(1)
        far[a : a + 2048] = np.sqrt(((block - pivots[which[a : a + 2048]]) ** 2).sum(1))
    return which, far


def build_pages(ids: np.ndarray, vectors: np.ndarray, largest: float, seed: int) -> list[tuple]:
    """Pages of one tree: (page, parent, pivot, radius, to_parent, ids, vectors, to_pivot); inner pages have no ids."""
    extra = np.sqrt(np.maximum(0.0, largest - (vectors.astype(float) ** 2).sum(1)))
    points = np.column_stack((vectors.astype(float), extra))
    rng = np.random.default_rng(seed)
    pivots = points[np.sort(rng.choice(len(points), max(1, len(points) // LEAF), replace=False))]
    leaf_of, far = _nearest(points, pivots)
    inner = pivots[np.sort(rng.choice(len(pivots), max(1, int(len(pivots) ** 0.5)), replace=False))]
    inner_of, up = _nearest(pivots, inner)
    pages, radius, number = [], np.zeros(len(inner)), len(inner)
    for leaf in range(len(pivots)):
        members = np.flatnonzero(leaf_of == leaf)
        members = members[np.lexsort((ids[members], far[members]))]
        for a in range(0, len(members), PAGE):
            own = members[a : a + PAGE]
            top = inner_of[leaf]
            reach = np.sqrt(((points[own] - inner[top]) ** 2).sum(1)).max()
            radius[top] = max(radius[top], reach)
            pages.append((number, int(top), pivots[leaf], float(far[own].max()), float(up[leaf]), ids[own], vectors[own].astype(np.int64), far[own]))
            number += 1
    return [(i, -1, p, float(radius[i]), 0.0, ids[:0], vectors[:0].astype(np.int64), far[:0]) for i, p in enumerate(inner)] + pages


class Tree:
    """Pages of one shard in memory, searched best-first."""

    def __init__(self, pages: list[tuple]):
        self.pages = {p[0]: p for p in pages}
        self.top = [p[0] for p in pages if p[1] < 0]
        self.below: dict[int, list[int]] = {}
        for p in pages:
            if p[1] >= 0:
                self.below.setdefault(p[1], []).append(p[0])
        self.pivots = {k: np.stack([self.pages[c][2] for c in v]) for k, v in self.below.items()}
        self.radius = {k: np.array([self.pages[c][3] for c in v]) for k, v in self.below.items()}
        self.up = {k: np.array([self.pages[c][4] for c in v]) for k, v in self.below.items()}
        self.roots = np.stack([self.pages[t][2] for t in self.top])
        self.root_radius = np.array([self.pages[t][3] for t in self.top])
        self.computed = 0

    def search(self, own: int, query: np.ndarray, largest: float, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best, best first; fewer if scores below ``least`` need not be found."""
        point = np.append(query.astype(float), 0.0)
        base = float((point**2).sum()) + largest
        slack = 1e-7 * (1.0 + base**0.5)
        start = max(0.0, base - 2.0 * least) ** 0.5
        ids, scores, limit = np.empty(0, np.int64), np.empty(0, np.int64), start
        d = np.sqrt(((self.roots - point) ** 2).sum(1))
        self.computed += len(d)
        queue = [(max(0.0, x - r), t, x) for t, x, r in zip(self.top, d, self.root_radius, strict=True)]
        heapq.heapify(queue)
        while queue:
            bound, number, dist = heapq.heappop(queue)
            if bound > limit + slack:
                break
            if number in self.below:
                children, up, radius = self.below[number], self.up[number], self.radius[number]
                near = np.flatnonzero(np.abs(dist - up) - radius <= limit + slack)
                d = np.sqrt(((self.pivots[number][near] - point) ** 2).sum(1))
                self.computed += len(near)
                for i, x in zip(near, d, strict=True):
                    if (low := max(0.0, x - radius[i])) <= limit + slack:
                        heapq.heappush(queue, (low, children[i], x))
            elif self.pages[number][1] >= 0:
                _, _, _, _, _, entry, vectors, to_pivot = self.pages[number]
                near = np.flatnonzero((np.abs(dist - to_pivot) <= limit + slack) & (entry != own))
                self.computed += len(near)
                ids = np.concatenate((ids, entry[near]))
                scores = np.concatenate((scores, _within_long(vectors[near] @ query)))
                if len(ids) > k:
                    best = _best(ids, scores)[:k]
                    ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    limit = min(start, max(0.0, base - 2.0 * float(scores.min())) ** 0.5)
        best = _best(ids, scores)
        return ids[best], scores[best]


def _best(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places by score, best first, then by id."""
    return np.lexsort((ids, ~scores))


def _within_long(scores: np.ndarray) -> np.ndarray:
    limits = np.iinfo(np.int64)
    return np.array([min(max(int(x), limits.min), limits.max) for x in scores], dtype=np.int64) if scores.dtype == object else scores


def _first_bounds(own: np.ndarray, queries: np.ndarray, ids: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the seeds, itself left out; -inf if there are fewer."""
    out = np.full(len(queries), -np.inf)
    for a in range(0, len(queries), 512):
        scores = queries[a : a + 512].astype(float) @ seeds.T.astype(float)
        scores[own[a : a + 512, None] == ids[None, :]] = -np.inf
        if len(ids) >= k:
            out[a : a + 512] = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
    return out - 1e-6 * (1.0 + np.abs(out, where=np.isfinite(out), out=np.zeros(len(out))))


def _padded(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def topk(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs have vec_id and ``v`` (array of long)."""
    stats = vectors.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0).cast("double"), lambda a, x: a + x.cast("double") * x)), F.max(F.size("v"))).first()
    count, largest, width = stats[0], float(stats[1] or 0.0), int(stats[2] or 1)
    width = max(width, int(queries.agg(F.max(F.size("v"))).first()[0] or 1))
    shards = max(1, -(-count // SHARD_ROWS))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["vec_id"].to_numpy(dtype=np.int64)
        pages = build_pages(ids, _padded(pdf["v"].tolist(), width), largest, int(key[0]))
        return pd.DataFrame([(key[0], p[0], p[1], p[2], p[3], p[4], p[5], p[6].tobytes(), p[7]) for p in pages], columns=["shard", "page", "parent", "pivot", "radius", "to_parent", "ids", "vectors", "to_pivot"])

    first = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEEDS).select("vec_id", "v").collect()  # at most SEEDS rows
    number = object if largest >= WIDE else np.int64
    shared = vectors.sparkSession.sparkContext.broadcast((np.array([r["vec_id"] for r in first], dtype=np.int64), _padded([r["v"] for r in first], width)))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard")
    pages = written(vectors.select(shard, "vec_id", "v").groupBy("shard").applyInPandas(build, PAGES), "mtree-pages")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def search(key: tuple, page_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(page_rows) or not len(query_rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        fields = page_rows[["page", "parent", "pivot", "radius", "to_parent", "ids", "vectors", "to_pivot"]].itertuples(index=False, name=None)
        tree = Tree([(a, b, np.asarray(c, float), d, e, np.asarray(f, np.int64), np.frombuffer(g, np.int64).reshape(-1, width).astype(number), np.asarray(h, float)) for a, b, c, d, e, f, g, h in fields])
        own, points = query_rows["vec_id"].to_numpy(dtype=np.int64), _padded(query_rows["v"].tolist(), width)
        least = _first_bounds(own, points, *shared.value, k)
        found = [(q, *tree.search(q, x, largest, k, low)) for q, x, low in zip(own, points.astype(number), least, strict=True)]
        return pd.DataFrame({"query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]), "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])}).astype("int64")

    left = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), scaled(F.col("embedding")).alias("v"))
    return topk(rows, rows.where(F.col("vec_id") % EVERY == 0))


OP9_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
