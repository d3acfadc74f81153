"""Importance resampling towards a target distribution, by word tries.

Features are runs of 1 to ORDER consecutive words; a feature's bucket is the
CRC-32 of its words, joined by one space, modulo BUCKETS.  Each task keeps a
trie of words: a node is a feature, holds its count and its CRC state, which a
child continues with a space and its own word, so that no feature is spelt out.
A trie of more than MOST_NODES nodes hands its bucket totals on and starts
afresh; the totals are merged by one aggregation over BUCKETS rows.

The gain of a bucket is the logarithm of its share of the target's features over
that of the corpus.  Documents are scored by walking such tries again, now with
gains attached to the nodes; a document's weight is the mean of its gains.  With
Gumbel noise, got from the hash of its id, the highest scores are a sample drawn
without replacement in proportion to exp(weight / 1000).

Ranks come from counts of each score (whole numbers whose range does not depend
on the input: at most MOST_SCORES) and numbers inside a score.

Defined results: null texts have no features; a text without features has weight
0; very long texts are walked in slices of SLICE bytes; documents of fewer words
than LEAST_WORDS are scored but never drawn; ties go to the smaller id (rows
without an id, whose noise is that of an empty id, come last); repeated rows are
counted and may be drawn each; an empty target leaves every count of it 0; empty
tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.store import table, written

ORDER = 1
BUCKETS = 10_000
LEAST_WORDS = 20
#: Percent of the documents that are long enough.
SHARE = 10
SEED = "2024"
MOST_NODES = 1 << 18
SLICE = 1 << 20
#: 1000 * ln of a ratio of 64-bit counts, and of the noise: no more whole numbers than this.
MOST_SCORES = 1 << 17
#: Neighbouring scores whose counts are summed together.
RUN = 512
_BREAK = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_PLAIN = bytes.maketrans(_BREAK + bytes(range(65, 91)), b" " * len(_BREAK) + bytes(range(97, 123)))


def word_slices(text: str) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, in runs of about SLICE bytes."""
    raw = text.encode().translate(_PLAIN)
    a = 0
    while a < len(raw):
        b = raw.find(b" ", a + SLICE) if a + SLICE < len(raw) else -1
        b = len(raw) if b < 0 else b
        yield raw[a:b].split()
        a = b


class _Children(dict):
    """A node's children by word; a missing one is made."""

    def __init__(self, trie: Trie, depth: int, state: int):
        self.trie, self.depth, self.state = trie, depth, state

    def __missing__(self, word: bytes) -> int:
        made = self[word] = self.trie.add(zlib.crc32(b" " + word, self.state) if self.depth else zlib.crc32(word), self.depth + 1)
        return made


class Trie:
    """Nodes in order of their making: the CRC state of each and, where longer features follow, its children."""

    def __init__(self, order: int, gains: list[int] | None = None):
        self.order, self.by_bucket = order, gains
        self.root = _Children(self, 0, 0)
        self.states: list[int] = []
        self.children: list[_Children | None] = []
        self.gains: list[int] = []

    def add(self, state: int, depth: int) -> int:
        self.states.append(state)
        self.children.append(_Children(self, depth, state) if depth < self.order else None)
        if self.by_bucket is not None:
            self.gains.append(self.by_bucket[state % len(self.by_bucket)])
        return len(self.states) - 1

    def walk(self, text: str) -> Iterator[list[int]]:
        """The nodes of all features of a text."""
        before: list[bytes] = []
        for new in word_slices(text):
            words, old = before + new, len(before)
            nodes = list(map(self.root.__getitem__, words))
            yield nodes[old:]
            for more in range(1, self.order):
                nodes = [self.children[at][word] for at, word in zip(nodes, islice(words, more, None), strict=False)]
                yield nodes[max(0, old - more) :]
            before = words[len(words) - self.order + 1 :] if self.order > 1 else []

    def full(self) -> bool:
        return len(self.states) > MOST_NODES


def _counted(order: int, buckets: int):
    """Bucket totals of a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, trie, counts = np.zeros(buckets, np.int64), Trie(order), np.zeros(0, np.int64)

        def merged() -> None:
            where = np.array(trie.states, np.int64) % buckets
            np.add.at(totals, where, np.pad(counts, (0, len(where) - len(counts))))

        for batch in batches:
            for text in batch["text"]:
                for nodes in trie.walk(text.as_py() or ""):
                    if nodes:
                        seen = np.bincount(nodes)
                        if len(seen) > len(counts):
                            counts = np.pad(counts, (0, max(len(seen), 2 * len(counts)) - len(counts)))
                        counts[: len(seen)] += seen
                if trie.full():
                    counts = counts[: len(trie.states)]
                    merged()
                    trie, counts = Trie(order), np.zeros(0, np.int64)
        counts = counts[: len(trie.states)]
        merged()
        held = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(totals[held])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts lie in it; empty buckets are left out."""
    return texts.select("text").mapInArrow(_counted(order, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of every bucket, from two tables of bucket, n."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    sums = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    d = lambda c, more: F.col(c).cast("double") + F.lit(float(more))
    gain = F.floor(1000 * F.log(d("t", 1) * d("all_s", buckets) / (d("s", 1) * d("all_t", buckets))))
    return both.crossJoin(F.broadcast(sums)).select("bucket", gain.cast("long").alias("gain"))  # one row of sums


def _scored(order: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(order, shared.value)
        for batch in batches:
            sums, features, words = ([0] * batch.num_rows for _ in range(3))
            for i, text in enumerate(batch["text"]):
                for k, nodes in enumerate(trie.walk(text.as_py() or "")):
                    sums[i] += sum(map(trie.gains.__getitem__, nodes))
                    features[i] += len(nodes)
                    if k % order == 0:
                        words[i] += len(nodes)
                if trie.full():
                    trie = Trie(order, shared.value)
            weight = [s // n if n else 0 for s, n in zip(sums, features, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, pa.int64()) for x in (features, words, weight))], ["doc_id", "n_features", "n_words", "weight"])

    return run


def weighted(docs: DataFrame, gains: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_features, n_words, weight of every row."""
    by_bucket = [r["gain"] for r in gains.orderBy("bucket").collect()]  # one number per bucket
    shared = docs.sparkSession.sparkContext.broadcast(by_bucket)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scored(order, shared), "doc_id long, n_features long, n_words long, weight long")


def drawn(rows: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """``rows`` of doc_id, n_words, weight with score and, for the documents drawn, rank."""
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((draw + F.lit(0.5)) / F.lit(4294967296.0))))
    rows = written(rows.withColumn("score", F.col("weight") + noise.cast("long")), "resample-scores")
    long_enough = F.col("n_words") >= least_words
    counts = written(rows.where(long_enough).groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.floor(F.col("score") / RUN)), "resample-counts")
    most = (counts.agg(F.sum("n")).first()[0] or 0) * share // 100
    runs = counts.groupBy("run").agg(F.sum("n").alias("m"))
    runs = runs.select("run", (F.sum("m").over(Window.orderBy(F.desc("run"))) - F.col("m")).alias("base"))  # at most MOST_SCORES / RUN rows
    inside = F.sum("n").over(Window.partitionBy("run").orderBy(F.desc("score"))) - F.col("n")
    starts = written(counts.join(runs, "run").select("score", (F.col("base") + inside).alias("start")).where(F.col("start") < most), "resample-starts")
    cut = starts.agg(F.min("score")).first()[0]
    high = long_enough & (F.col("score") >= cut) if cut is not None else F.lit(False)
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    top = rows.where(high).join(F.broadcast(starts), "score").withColumn("rank", F.col("start") + place).drop("start")  # at most MOST_SCORES rows
    top = top.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return top.unionByName(rows.where(~high).withColumn("rank", F.lit(None).cast("long")))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))
    return drawn(weighted(docs, gains)).select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = r"""
WITH crc AS (SELECT list(c ORDER BY i) AS k FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
f AS (SELECT rid, unnest(w) AS w FROM d),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
h AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM f UNION SELECT w FROM b)),
k AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda j: CAST('0x' || substr(x, 2 * j + 1, 2) AS BIGINT))), lambda c, y: xor(c >> 8, crc.k[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, crc),
s AS (SELECT bucket, count(*) AS s FROM f JOIN k USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (w) GROUP BY bucket),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS sn, (SELECT coalesce(sum(t), 0) FROM t) AS tn),
g AS (SELECT w, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sn + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (tn + 10000)::DOUBLE))) AS BIGINT) AS gain FROM k LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), n),
q AS (SELECT rid, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM f JOIN g USING (w) GROUP BY rid),
r AS (SELECT rid, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN q USING (rid)),
o AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM r WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM r LEFT JOIN o USING (rid)
"""
