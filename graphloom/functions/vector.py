"""Vectors as arrays of doubles: similarity, pooling, hashing and interaction profiles."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAVIGATION = (0.45, 0.25, 0.30)
PATH = (0.20, 0.45, 0.35)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, whatever the uses in it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is empty or zero, or the sizes differ."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def unit_cosine(c: Column) -> Column:
    """Cosine brought to [0, 1]."""
    return (c + 1) / 2


def normalized(v: Column) -> Column:
    scaled = lambda u: let(norm(u), lambda n: F.when(n > 0, F.transform(u, lambda x: x / n)).otherwise(u))
    return let(v, scaled)


def times(v: Column, w: float) -> Column:
    return F.transform(v, lambda x: x * F.lit(w))


def weighted_pool(*pairs: tuple[Column, float]) -> Column:
    total = None
    for v, w in pairs:
        part = times(v, w)
        total = part if total is None else F.zip_with(total, part, lambda x, y: x + y)
    return normalized(total)


def navigation_update(query: Column, now: Column, doc: Column) -> Column:
    return weighted_pool((query, NAVIGATION[0]), (now, NAVIGATION[1]), (doc, NAVIGATION[2]))


def contribution(query: Column, doc: Column) -> Column:
    return F.zip_with(query, doc, lambda q, d: q * d)


def contribution_profile(query: Column, doc: Column) -> Column:
    return normalized(contribution(query, doc))


def hashed_profile(query: Column, doc: Column, width: int, buckets: int = 64) -> Column:
    """Features q, d, qd and |q - d| of every dimension, hashed into buckets with alternating signs, normalised.

    ``width`` is the vectors' size: feature numbers are hashed once, on the driver.
    """
    into = [int.from_bytes(hashlib.sha256(str(i).encode()).digest()[:4], "big") % buckets for i in range(4 * width)]
    flat = F.flatten(F.zip_with(query, doc, lambda q, d: F.array(q, -d, q * d, -F.abs(q - d))))
    named = F.zip_with(flat, F.array(*(F.lit(i) for i in into)), lambda v, b: F.struct(v.alias("v"), b.alias("b")))
    sums = let(named, lambda n: F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.aggregate(F.filter(n, lambda x: x["b"] == b), F.lit(0.0), lambda s, x: s + x["v"])))
    return normalized(sums)


def top_components(query: Column, doc: Column, k: int = 8) -> Column:
    """The k dimensions of largest |q * d|, ties to the smaller dimension."""
    parts = F.transform(contribution(query, doc), lambda v, i: F.struct((-F.abs(v)).alias("order"), i.alias("dimension"), v.alias("contribution")))
    return F.transform(F.slice(F.array_sort(parts), 1, k), lambda x: F.struct(x["dimension"], x["contribution"]))


def hashed_counts(docs: DataFrame, id_col: str, text: Column, dims: int = 256) -> DataFrame:
    """Signed counts of hashed tokens: id, dim, raw; zero entries gone.  Whole numbers, which add up over texts."""
    token = F.explode(F.filter(F.split(F.lower(text), r"[ \t\n\r\f\x0B]+"), lambda x: x != ""))
    digest = docs.select(id_col, token.alias("t")).groupBy(id_col, "t").count().withColumn("h", F.sha2("t", 256))
    dim = (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % dims).cast("int")
    sign = F.when(F.conv(F.substring("h", 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    return digest.groupBy(id_col, dim.alias("dim")).agg(F.sum(sign * F.col("count")).alias("raw")).where("raw <> 0")


def dense_counts(text: Column, dims: int = 256) -> Column:
    """``hashed_counts`` of a text as one array of ``dims`` whole numbers, counted where the text is read; null texts have none."""

    @F.pandas_udf("array<int>")
    def counted(tokens: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, int]] = {}

        def place(t: str) -> tuple[int, int]:
            if t not in known:
                h = hashlib.sha256(t.encode()).digest()
                known[t] = int.from_bytes(h[:4], "big") % dims, 1 - 2 * (h[4] % 2)
            return known[t]

        def one(words: np.ndarray) -> np.ndarray:
            if not len(words):
                return np.zeros(dims, dtype=np.int32)
            at, sign = zip(*map(place, words), strict=True)
            return np.bincount(at, sign, dims).astype(np.int32)

        return tokens.map(one)

    tokens = F.filter(F.split(F.lower(text), r"[ \t\n\r\f\x0B]+"), lambda x: x != "")
    return counted(F.coalesce(tokens, F.expr("cast(array() as array<string>)")))


def hashed_tokens(docs: DataFrame, id_col: str, text: Column, dims: int = 256) -> DataFrame:
    """Sparse signed hashing vectors: id, dim, value (L2-normalised), zero entries gone."""
    sums = hashed_counts(docs, id_col, text, dims)
    size = sums.groupBy(id_col).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("size"))
    return sums.join(size, id_col).select(id_col, "dim", (F.col("raw") / F.col("size")).alias("value"))


def dense_hashed(text: Column, dims: int = 256) -> Column:
    """The same vector laid out densely, within one row."""
    tokens = F.filter(F.split(F.lower(text), r"[ \t\n\r\f\x0B]+"), lambda x: x != "")
    named = F.transform(tokens, lambda t: F.struct((F.conv(F.substring(F.sha2(t, 256), 1, 8), 16, 10).cast("long") % dims).alias("d"), F.when(F.conv(F.substring(F.sha2(t, 256), 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0).alias("s")))
    sums = let(named, lambda n: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(F.filter(n, lambda x: x["d"] == i), F.lit(0.0), lambda s, x: s + x["s"])))
    return normalized(sums)


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, dim, mean of every component."""
    return rows.select(key, F.posexplode(vector).alias("dim", "v")).groupBy(key, "dim").agg(F.avg("v").alias("mean"))
