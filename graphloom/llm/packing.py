"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class j holds pieces of at most
CAPACITY // j tokens, and each of its sequences takes exactly j of them.  As
documents may be cut, a document gives full sequences first; of what remains,
a piece just as long as some class allows is cut off until the rest fits its
class with little slack.  Each class is dealt to workers of about WORKER_ROWS
pieces, which fill their sequences independently by count; what a worker cannot
complete (less than j pieces) is packed first-fit-decreasing in small groups.

Ids are those of the JSON file's own library, which takes some 1,070 CPU seconds
a GB; they are got from the same vocabulary's rank file and added token through
a byte-pair encoder several times as fast.  Tests hold both to equal ids.

Pieces are dealt to workers by their own serial numbers, so that repeated rows
and rows without an id spread like all others.

Defined results: a null or empty text is the one closing id; the tokenizer's added
token in a text is its one id; repeated rows are packed each; a very long text
gives as many pieces as it needs; equal lengths are taken by serial number; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.store import table, written

CAPACITY = 2048
CLASSES = 128
#: A piece this much shorter than its class allows is not cut further.
SLACK = 8
END_ID = 1
WORKER_ROWS = 1024
LEFT_ROWS = 100
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Tokens that the JSON file adds to the ranks.
ADDED = {TOKENIZER: {"<|endoftext|>": 50256}}


@lru_cache(maxsize=4)
def encoder(name: str = TOKENIZER):
    """The byte-level encoder of a rank file (a name among the public tokenizers, or a path)."""
    import public_tokenizers
    import tiktoken

    path = name if "/" in name else public_tokenizers.path(name)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED.get(name, {}))


def token_ids(text: str | None, name: str = TOKENIZER) -> np.ndarray:
    """A document's ids, the closing one included."""
    return np.append(encoder(name).encode_to_numpy(text or "", allowed_special="all", disallowed_special=()), END_ID).astype("<u4")


@lru_cache(maxsize=None)
def cuts(rest: int) -> tuple[tuple[int, int], ...]:
    """(length, class) of the pieces of a rest shorter than CAPACITY."""
    out = []
    while rest:
        j = CAPACITY // rest
        if j >= CLASSES or CAPACITY // j - rest <= SLACK:
            out.append((rest, min(j, CLASSES)))
            break
        out.append((CAPACITY // (j + 1), j + 1))
        rest -= CAPACITY // (j + 1)
    return tuple(out)


def _pieces(with_ids: bool, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, kept = [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = token_ids(text, name)
                n, at = len(ids), 0
                for length, kind in ((CAPACITY, 1),) * (n // CAPACITY) + cuts(n % CAPACITY):
                    part = ids[at : at + length]
                    rows.append((doc, at, length, zlib.crc32(part), n, kind, serial))
                    serial += 1
                    if with_ids:
                        kept.append(part.astype(np.int32))
                    at += length
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            arrays = [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.int32(), pa.int64()], strict=True)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "serial"]
            if with_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def first_fit_decreasing(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length."""
    bins, offsets, load = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    for i in np.argsort(-lengths, kind="stable"):
        b = next((b for b, used in enumerate(load) if used + lengths[i] <= CAPACITY), len(load))
        if b == len(load):
            load.append(0)
        bins[i], offsets[i] = b, load[b]
        load[b] += int(lengths[i])
    return bins, offsets


def pack(docs: DataFrame, with_ids: bool = False, tokenizer: str = TOKENIZER) -> DataFrame:
    """Pieces of every row of doc_id, text with their place: sequence_id and offset."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, kind int, serial long" + (", ids array<int>" if with_ids else "")
    pieces = written(docs.select("doc_id", "text").mapInArrow(_pieces(with_ids, tokenizer), schema), "pack-pieces")
    sizes = {r["kind"]: r["count"] for r in pieces.groupBy("kind").count().collect()}  # at most CLASSES rows
    workers = {j: max(1, n // WORKER_ROWS) for j, n in sizes.items()}
    shares = F.create_map(*(F.lit(x) for j, w in (workers or {1: 1}).items() for x in (j, w)))
    dealt = pieces.withColumn("worker", F.pmod(F.xxhash64("serial"), F.element_at(shares, F.col("kind")).cast("long")))
    worker = Window.partitionBy("kind", "worker")
    dealt = dealt.withColumn("_r", F.row_number().over(worker.orderBy("serial")) - 1).withColumn("_n", F.count(F.lit(1)).over(worker))
    dealt = dealt.withColumn("_bin", F.expr("_r div kind"))
    inside = Window.partitionBy("kind", "worker", "_bin").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.col("_bin") < F.expr("_n div kind")
    names = [c for c in pieces.columns if c not in ("kind", "serial")]
    done = dealt.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")).where(whole)
    number = F.shiftleft(F.col("kind").cast("long"), 52) + F.shiftleft(F.col("worker"), 16) + F.col("_bin")
    done = done.select(*names, number.alias("sequence_id"), "offset")
    expected = sum(w * (min(j, sizes[j]) - 1) / 2 for j, w in workers.items())
    groups = max(1, round(expected / LEFT_ROWS))

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("serial").reset_index(drop=True)
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy())
        return pdf.drop(columns=["_group", "serial"]).assign(sequence_id=(int(key[0]) << 16) + bins, offset=offsets)

    left = dealt.where(~whole).select(*names, "serial", F.pmod(F.xxhash64("kind", "worker", "_r"), F.lit(groups)).cast("int").alias("_group"))
    left = left.groupBy("_group").applyInPandas(finish, schema.replace("kind int, serial long", "sequence_id long, offset long").replace(", ids array<int>", "") + (", ids array<int>" if with_ids else ""))
    return done.unionByName(left)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces."""
    return pack(docs)
