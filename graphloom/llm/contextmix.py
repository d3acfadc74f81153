"""Language-model scoring by online logistic context mixing.

A text is a stream of bytes: its word tokens, each with a space after it, and
one more space as the end.  Its score is the log10 probability of all those
bytes, bit by bit, from a bit model whose contexts cross words:

* several predictors look a hashed context (0 to 4 preceding bytes of the text,
  or the word so far) and the bits so far up in tables of bit counts over all
  training texts, each occurrence counted;
* their log-odds are combined by weights that a gate (bit position and the
  number of predictors that lean to either side) selects; weights are learnt online, step by step,
  leaving each occurrence out of its own counts, over blocks of about LEARN_ROWS
  distinct contexts in the order of their hashes, and averaged.  Blocks follow
  from the contexts alone, and sums are taken in their order: the model does not
  depend on partitions or tasks;
* an adaptive table refines the mixed probability by its size and the bits so
  far.

Counts, weights and refinement are those of the training texts and stay as they
are while texts are scored: scores do not depend on the order of rows.

A byte with four bytes or more of its word before it (a tail) depends on its
word alone, any other (a head) on the four bytes before it and its place in the
word.  So each distinct head and each distinct word's tail is learnt once, times
its occurrences, and computed once per task or table; sums over a text are those
of a run over all its bytes.  The bit tables grow with the number of distinct
contexts, in units of SLOTS to MAX_SLOTS; longer contexts, which are more, have
larger tables; words and heads are counted by hash.  Texts meet the HOT_WORDS most frequent words as a table of
bounded size and all others in a join.

Defined results: a null text is empty: one token, the end; equal texts have
equal scores; repeated rows are each scored and, in training, each counted; a
null id hashes as the empty string; a very long text is worked on in slices of
words; words of one count are all frequent or none; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.store import table, written
from graphloom.llm.wordhash import _SPACE, Words, mix, slices, words_of

HELD_OUT = 10
HOT_WORDS = 1 << 19
#: The unit of the tables' sizes: one for about eight distinct contexts, within these bounds.
SLOTS, MAX_SLOTS = 1 << 18, 1 << 20
#: Slots of the two shortest contexts, which are few, and units of the longer ones and of the word so far.
FEW, SHARES = (1 << 12, 1 << 16), (1, 2, 4, 8)
#: Distinct contexts that are learnt from in one block, and those taken together.
LEARN_ROWS, LEARN_BATCH = 1 << 17, 1 << 14
PREDICTORS = 6
LEVELS = PREDICTORS + 1
GATES = 8 * LEVELS
BUCKETS = 33
RATE = 0.02
#: Bytes of words that are scored or learnt at once, and learnt in one online step.
CHUNK, STEP = 1 << 17, 1 << 14
BLOCK = 1 << 14
PRIOR = 0.4
#: Preceding bytes that the longest context holds.
REACH = 4
#: Distinct heads that a task keeps at once.
HEADS = 1 << 19


def trains(doc_ids: list) -> np.ndarray:
    """Which rows are learnt from."""
    return np.fromiter((zlib.crc32(("" if d is None else str(d)).encode()) % HELD_OUT != 0 for d in doc_ids), dtype=bool, count=len(doc_ids))


def layout(size: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Slots of each predictor's table, and where each table starts; their sum ends the starts."""
    sizes = (*FEW, *(share * size for share in SHARES))
    return sizes, tuple(int(x) for x in np.concatenate(([0], np.cumsum(sizes))))


#: What the bits so far add to a context's hash.
SALTS = mix(np.arange(256, dtype=np.uint64) + np.uint64(11))


class Contexts:
    """The table slots of the contexts of bytes, and their bits."""

    def __init__(self, values: np.ndarray, before: list[np.ndarray], prefix: np.ndarray):
        self.bytes = values
        n = len(values)
        context = np.zeros(n, np.uint64)
        hashes = [mix(np.full(n, 1, np.uint64))]
        with np.errstate(over="ignore"):
            for order in range(1, REACH + 1):
                context = context * np.uint64(257) + before[order - 1]
                hashes.append(mix(context + np.uint64(order << 40)))
            hashes.append(mix(prefix + np.uint64(7 << 40)))
        self.hashes = hashes

    def bits(self, size: int = SLOTS) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray]]:
        """(position, bits so far with a leading 1, slots per predictor, bit)."""
        value = self.bytes.astype(np.int64)
        sizes, starts = layout(size)
        for position in range(8):
            node = (1 << position) | (value >> (8 - position))
            salt = SALTS[node]
            slots = [((h ^ salt) & np.uint64(n - 1)).view(np.int64) + start for h, n, start in zip(self.hashes, sizes, starts)]
            yield position, node, slots, ((value >> (7 - position)) & 1).astype(bool)


def _placed(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(values.astype(np.uint64) + (at.astype(np.uint64) << np.uint64(8)))


class Spelling(Contexts):
    """A batch of words, each with an end byte and with nothing before it; ``at`` is the place in the word."""

    def __init__(self, words: list[bytes]):
        lengths = np.fromiter((len(w) + 1 for w in words), dtype=np.int64, count=len(words))
        values = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
        self.word = np.repeat(np.arange(len(words)), lengths)
        starts = np.cumsum(lengths) - lengths
        self.at = np.arange(len(values)) - np.repeat(starts, lengths)
        wide, n = np.concatenate((np.zeros(REACH, np.uint64), values.astype(np.uint64))), len(values)
        before = [np.where(self.at >= k, wide[REACH - k : REACH - k + n], np.uint64(0)) for k in range(1, REACH + 1)]
        with np.errstate(over="ignore"):
            running = np.concatenate(([np.uint64(0)], np.cumsum(_placed(values, self.at))))
            prefix = running[:-1] - np.repeat(running[starts], lengths)
        super().__init__(values, before, prefix)

    def tails(self) -> Spelling:
        """Only the bytes whose contexts lie within their word."""
        keep = self.at >= REACH
        self.bytes, self.word, self.at, self.hashes = self.bytes[keep], self.word[keep], self.at[keep], [h[keep] for h in self.hashes]
        return self


class Heads(Contexts):
    """Bytes near the start of a word by key: the four bytes before, the byte, its place in the word."""

    def __init__(self, keys: np.ndarray):
        at = keys & np.uint64(255)
        before = [(keys >> np.uint64(8 + 8 * k)) & np.uint64(255) for k in range(1, REACH + 1)]
        prefix = np.zeros(len(keys), np.uint64)
        with np.errstate(over="ignore"):
            for place in range(REACH - 1):
                for k in range(1, REACH):
                    here = at == place + k
                    prefix[here] += _placed(before[k - 1][here], np.full(int(here.sum()), place))
        super().__init__(((keys >> np.uint64(8)) & np.uint64(255)).astype(np.uint8), before, prefix)


def heads_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the heads of all texts of a batch, their ends among them, and the row of each."""
    lengths, rows = words.end - words.start, words.rows
    count = np.bincount(words.row, weights=lengths + 1, minlength=rows).astype(np.int64)
    base = np.cumsum(count + REACH + 1) - count - REACH - 1
    begin = np.cumsum(lengths + 1) - lengths - 1 + (REACH + 1) * words.row + REACH
    stream = np.full(int(count.sum()) + (REACH + 1) * rows, 32, dtype=np.uint64)
    for k in range(REACH):
        stream[base + k] = 0
    stream[np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))] = words.low[~_SPACE[words.low]]
    keys, row = [], []
    ends = base + REACH + count
    for place in range(REACH):
        here = lengths >= place
        p, r = begin[here] + place, words.row[here]
        if place == 0:
            p, r = np.concatenate((p, ends)), np.concatenate((r, np.arange(rows)))
        key = stream[p] << np.uint64(8) | np.uint64(place)
        for k in range(1, REACH + 1):
            key |= stream[p - k] << np.uint64(8 + 8 * k)
        keys.append(key)
        row.append(r)
    return np.concatenate(keys), np.concatenate(row)


def _chunks(words: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of words of about CHUNK bytes; a longer word is a run of its own."""
    now, size = [], 0
    for w in words:
        now.append(w)
        size += len(w) + 1
        if size >= CHUNK:
            yield now
            now, size = [], 0
    if now:
        yield now


def _as_blocks(array: np.ndarray, kind: int, part: int) -> pa.RecordBatch:
    parts = [(i, array[a : a + BLOCK]) for i, a in enumerate(range(0, len(array), BLOCK))]
    parts = [(i, p) for i, p in parts if p.any()]
    columns = [pa.array([kind] * len(parts), pa.int32()), pa.array([i for i, _ in parts], pa.int32()), pa.array([part] * len(parts), pa.int64()), pa.array([p.astype("<f8").tobytes() for _, p in parts], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["kind", "block", "part", "sums"])


BLOCKS = "kind int, block int, part long, sums binary"
#: Parts that are summed at once.
SUM_PARTS = 64


def _add(pdf):
    pdf = pdf.sort_values("part")
    out = pdf.head(1).assign(part=pdf["part"].iloc[0] // SUM_PARTS)
    total = np.zeros(len(out["sums"].iloc[0]) // 8)
    for b in pdf["sums"]:
        total += np.frombuffer(b, dtype="<f8")
    out["sums"] = [total.astype("<f8").tobytes()]
    return out


def _summed(rows: DataFrame, sizes: dict[int, int], parts: int) -> dict[int, np.ndarray]:
    """Sums over all parts of arrays of a fixed size, given in blocks, in the order of their parts; blocks of zeros are left out."""
    got = {k: np.zeros(n) for k, n in sizes.items()}
    while parts > 1:
        rows = rows.groupBy("kind", "block", F.floor(F.col("part") / SUM_PARTS).alias("some")).applyInPandas(lambda key, pdf: _add(pdf), BLOCKS)
        parts = -(-parts // SUM_PARTS)
    for r in rows.toLocalIterator():  # rows of a bounded size, as many as blocks
        part = np.frombuffer(r["sums"], dtype="<f8")
        got[r["kind"]][r["block"] * BLOCK : r["block"] * BLOCK + len(part)] += part
    return got


def _events(batch: pa.RecordBatch) -> Iterator[tuple[Contexts, np.ndarray]]:
    """Heads and tails of rows of key or word, n; with the occurrences of each byte."""
    n = batch["n"].to_numpy().astype(float)
    head = batch["word"].is_null().to_numpy(zero_copy_only=False)
    keys = batch["key"].fill_null(0).to_numpy()[head].view(np.uint64)
    for a in range(0, len(keys), CHUNK):
        yield Heads(keys[a : a + CHUNK]), n[head][a : a + CHUNK]
    times, a = n[~head], 0
    for words in _chunks([w for w in batch["word"].to_pylist() if w is not None]):
        spelled = Spelling(words).tails()
        yield spelled, times[a + spelled.word]
        a += len(words)


def _count_bits(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * layout(size)[1][-1])
        for batch in batches:
            for event, times in _events(batch):
                for _, _, slots, bit in event.bits(size):
                    for slot in slots:
                        np.add.at(counts, slot * 2 + bit, times)
        yield _as_blocks(counts, 0, TaskContext.get().partitionId())

    return run


def _left_out(counts: np.ndarray, slots: list[np.ndarray], bit: np.ndarray) -> np.ndarray:
    """Log-odds of each predictor, one occurrence's own bit left out."""
    pairs, out = counts.reshape(-1, 2), np.empty((PREDICTORS, len(bit)))
    own = np.stack((~bit, bit), 1)
    for i, slot in enumerate(slots):
        seen = np.maximum(0.0, pairs[slot] - own) + PRIOR
        out[i] = np.log(seen[:, 1] / seen[:, 0])
    return out


def _gates(position: int, inputs: np.ndarray) -> np.ndarray:
    """The set of weights: by the bit's position and how many predictors lean to either side."""
    return position * LEVELS + (inputs != 0).sum(0)


def _refined(table_: np.ndarray, score: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of a one after refinement, and the table's cell."""
    cell = node * BUCKETS + np.clip(np.rint((score + 8.0) * 2.0), 0, BUCKETS - 1).astype(np.int64)
    plain = 1.0 / (1.0 + np.exp(-score))
    return (plain + table_[cell]) / 2.0, cell


def _learn(shared, size: int):
    """The weights and refinement hits of one block of contexts, in the order of their hashes."""

    def run(block: pa.Table) -> pa.Table:
        counts, part = shared.value, block["part"][0].as_py()
        block = block.sort_by([("order", "ascending"), ("key", "ascending"), ("word", "ascending")]).combine_chunks()
        weights, steps = np.full((GATES, PREDICTORS), 1.0 / PREDICTORS), 0
        hits = np.zeros(2 * 256 * BUCKETS)
        for batch in block.to_batches(max_chunksize=LEARN_BATCH):
            for event, times in _events(batch):
                for position, node, slots, bit in event.bits(size):
                    inputs = _left_out(counts, slots, bit)
                    gate = _gates(position, inputs)
                    for a in range(0, len(bit), STEP):
                        g, x, y, n = gate[a : a + STEP], inputs[:, a : a + STEP], bit[a : a + STEP], times[a : a + STEP]
                        share = n * (len(n) / n.sum())
                        score = np.clip((weights[g] * x.T).sum(1), -12, 12)
                        wrong = share * (y - 1.0 / (1.0 + np.exp(-score)))
                        crowd = np.maximum(1, np.bincount(g, weights=share, minlength=GATES))
                        for i in range(PREDICTORS):
                            weights[:, i] += RATE * np.bincount(g, weights=wrong * x[i], minlength=GATES) / np.sqrt(crowd)
                        cell = node[a : a + STEP] * BUCKETS + np.clip(np.rint((score + 8.0) * 2.0), 0, BUCKETS - 1).astype(np.int64)
                        hits += np.bincount(cell * 2 + y, weights=n, minlength=len(hits))
                        steps += len(y)
        return pa.Table.from_batches([_as_blocks(np.append(weights.reshape(-1) * steps, steps), 1, part), _as_blocks(hits, 2, part)])

    return run


def _logs(event: Contexts, model: dict) -> np.ndarray:
    """log10 of each byte's probability under the bit model."""
    likely = np.ones(len(event.bytes))
    inputs, weights = np.empty((PREDICTORS, len(likely))), np.ascontiguousarray(model["weights"].T)
    for position, node, slots, bit in event.bits(model["size"]):
        for i, slot in enumerate(slots):
            inputs[i] = model["odds"][slot]
        gate, score = _gates(position, inputs), np.zeros(len(likely))
        for i in range(PREDICTORS):
            score += weights[i][gate] * inputs[i]
        p, _ = _refined(model["refine"], np.clip(score, -12, 12), node)
        likely *= np.where(bit, p, 1.0 - p)
    return np.log10(likely)


def tail_logs(words: list[bytes], model: dict) -> np.ndarray:
    """log10 of the probability of each word's tail."""
    out = []
    for chunk in _chunks(words):
        spelled = Spelling(chunk).tails()
        out.append(np.bincount(spelled.word, weights=_logs(spelled, model), minlength=len(chunk)).astype(float))
    return np.concatenate(out) if out else np.empty(0)


class HeadLogs:
    """log10 of the probabilities of heads, the latest HEADS or so kept."""

    def __init__(self, model: dict):
        self.model, self.keys, self.logs = model, np.empty(0, np.uint64), np.empty(0)

    def of(self, keys: np.ndarray) -> np.ndarray:
        kinds, which = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, kinds), max(0, len(self.keys) - 1))
        new = kinds[self.keys[at] != kinds] if len(self.keys) else kinds
        if len(self.keys) + len(new) > HEADS:
            self.keys, self.logs, new = np.empty(0, np.uint64), np.empty(0), kinds
        if len(new):
            logs = [_logs(Heads(new[a : a + CHUNK]), self.model) for a in range(0, len(new), CHUNK)]
            merged = np.concatenate((self.keys, new))
            order = np.argsort(merged, kind="stable")
            self.keys, self.logs = merged[order], np.concatenate([self.logs, *logs])[order]
            at = np.searchsorted(self.keys, kinds)
        return self.logs[at][which]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each batch with their counts in training texts."""
    for batch in (part for whole in batches for part in slices(whole)):
        words, learnt = words_of(batch["text"]), trains(batch["doc_id"].to_pylist())
        kinds, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        n = np.bincount(which, weights=learnt[words.row], minlength=len(kinds)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array([words.text(i) for i in first], pa.binary()), pa.array(n)], ["hash", "word", "n"])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their counts."""
    keys, which = np.unique(np.concatenate([np.empty(0, np.uint64), *(k for k, _ in parts)]), return_inverse=True)
    return keys, np.bincount(which, weights=np.concatenate([np.empty(0), *(n for _, n in parts)]), minlength=len(keys)).astype(np.int64)


def _head_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct heads of training texts with their counts, about HEADS at once."""
    parts, held, kept = [], 0, 0
    made = lambda keys, counts: pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])
    for batch in (part for whole in batches for part in slices(whole)):
        found, row = heads_of(words_of(batch["text"]))
        parts.append(np.unique(found[trains(batch["doc_id"].to_pylist())[row]], return_counts=True))
        held += len(parts[-1][0])
        if held > HEADS + kept:
            parts = [_merged(parts)]
            held = kept = len(parts[0][0])
            if kept > HEADS:
                yield made(*parts[0])
                parts, held, kept = [], 0, 0
    yield made(*_merged(parts))


def _tails(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["hash"], batch["n"], pa.array(tail_logs(batch["word"].to_pylist(), shared.value))], ["hash", "n", "tail"])

    return run


def _doc_rows(shared, model, names: list[str]):
    """Per row a total over its heads and frequent words, and its other words one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, heads = shared.value, HeadLogs(model.value)
        for batch in (part for whole in batches for part in slices(whole)):
            words = words_of(batch["text"])
            rows = batch["row"].to_numpy()
            kinds, which = np.unique(words.hashes, return_inverse=True)
            at = np.searchsorted(hot["hash"], kinds)
            at[at == len(hot["hash"])] = 0
            found = hot["hash"][at] == kinds
            known, n = found[which], words.rows
            total = lambda x: np.bincount(words.row, weights=np.where(found, x[at], 0)[which], minlength=n)  # noqa: E731, B023
            nothing = pa.nulls(n, pa.int64())
            keys, row = heads_of(words)
            score = np.bincount(row, weights=heads.of(keys), minlength=n) + total(hot["tail"])
            sums = [pa.array(total(hot["base"]) + hot["end_base"]), pa.array(score)]
            counted = pa.array((total(hot["counted"]) + hot["end_counted"]).astype(np.int64))
            tokens = pa.array(np.bincount(words.row, minlength=n) + 1)
            size = pa.array(np.bincount(words.row, weights=words.end - words.start + 1, minlength=n).astype(np.int64) + 1)
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"].cast(pa.int64()), nothing, nothing, size, tokens, counted, *sums], names)
            pair = words.row[~known] * np.int64(max(1, len(kinds))) + which[~known]
            pair, times = np.unique(pair, return_counts=True)
            if len(times):
                void, real = pa.nulls(len(times), pa.int64()), pa.nulls(len(times), pa.float64())
                row, kind = pair // len(kinds), pair % len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(rows[row]), void, pa.array(kinds[kind].view(np.int64)), pa.array(times.astype(np.int64)), void, void, void, *[real] * len(sums)], names)

    return run


def _frequent(words: DataFrame) -> int:
    """The least count such that at most HOT_WORDS words have it or more."""
    tall = words.groupBy(F.floor(F.log2(F.greatest(F.lit(1), "n").cast("double")) * 8).alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()  # a few hundred rows
    left, least = HOT_WORDS, None
    for r in sorted(tall, key=lambda r: -r["step"]):
        left -= r["words"]
        if left < 0:
            break
        least = r["step"]
    return (1 << 62) if least is None else 0 if left >= 0 else int(np.ceil(2.0 ** (least / 8) - 1e-9))


def fit(spark: SparkSession, seen: DataFrame) -> dict:
    """The bit model of a table of heads and words (key or word, n)."""
    rows = seen.count()
    size = SLOTS
    while size < MAX_SLOTS and size * 8 < rows:
        size *= 2
    bits = _summed(seen.mapInArrow(_count_bits(size), BLOCKS), {0: 2 * layout(size)[1][-1]}, seen.rdd.getNumPartitions())[0].astype(np.float32)
    shared = spark.sparkContext.broadcast(bits)
    order = F.xxhash64("key", "word")
    parts = -(-rows // LEARN_ROWS) or 1
    blocks = seen.select("key", "word", "n", order.alias("order"), F.pmod(order, F.lit(parts)).alias("part"))
    learnt = _summed(blocks.groupBy("part").applyInArrow(_learn(shared, size), BLOCKS), {1: GATES * PREDICTORS + 1, 2: 2 * 256 * BUCKETS}, parts)
    weights = learnt[1][:-1].reshape(GATES, PREDICTORS) / learnt[1][-1] if learnt[1][-1] else np.full((GATES, PREDICTORS), 1.0 / PREDICTORS)
    bucket = 1.0 / (1.0 + np.exp(-(np.arange(BUCKETS) / 2.0 - 8.0)))
    zero, one = learnt[2][::2].reshape(256, BUCKETS), learnt[2][1::2].reshape(256, BUCKETS)
    refine = ((one + 4.0 * bucket) / (zero + one + 4.0)).reshape(-1)
    return {"size": size, "odds": np.log((bits[1::2] + np.float32(PRIOR)) / (bits[::2] + np.float32(PRIOR))), "weights": weights, "refine": refine}


def score_texts(docs: DataFrame) -> DataFrame:
    """Counts and scores of every row of doc_id, text, learning from the rows that are not held out.

    ``n_bytes`` is the length of the modelled stream, ``bits_per_byte`` its total bits over that length.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    hashed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % HELD_OUT
    texts = docs.where(hashed != 0).count()
    counts = written(docs.mapInArrow(_word_counts, "hash long, word binary, n long").groupBy("hash", "word").agg(F.sum("n").alias("n")), "lm-words")
    heads = written(docs.mapInArrow(_head_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "lm-heads")
    t = counts.agg(F.sum("n"), F.count_if(F.col("n") > 0)).first()
    tokens, distinct = (t[0] or 0) + texts, t[1] + (texts > 0)
    long_words = counts.where((F.col("n") > 0) & (F.length("word") >= REACH)).select(F.lit(None).cast("long").alias("key"), "word", "n")
    model = fit(spark, heads.select("key", F.lit(None).cast("binary").alias("word"), "n").unionByName(long_words))
    shared = spark.sparkContext.broadcast(model)
    logs = written(counts.mapInArrow(_tails(shared), "hash long, n long, tail double"), "lm-logs")
    least = _frequent(logs)
    hot = logs.where(F.col("n") >= least).toArrow()  # at most HOT_WORDS rows
    kinds = hot["hash"].to_numpy().view(np.uint64)
    order, empty = np.argsort(kinds), not len(kinds)
    n = hot["n"].to_numpy()[order]
    bottom = float(np.log10(max(1e-9, tokens + 0.1 * (distinct + 1))))
    frequent = {
        "hash": np.zeros(1, np.uint64) if empty else kinds[order],
        "counted": np.zeros(1) if empty else (n > 0).astype(float),
        "base": np.zeros(1) if empty else np.log10(n + 0.1) - bottom, "tail": np.zeros(1) if empty else hot["tail"].to_numpy()[order],
        "end_base": float(np.log10(texts + 0.1) - bottom), "end_counted": int(texts > 0),
    }
    table_ = spark.sparkContext.broadcast(frequent)
    sums = ["base", "score"]
    names = ["row", "doc_id", "hash", "times", "n_bytes", "n_tokens", "n_known", *sums]
    kind = ", ".join(f"{x} long" for x in names[:7]) + ", " + ", ".join(f"{x} double" for x in sums)
    rows = written(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_doc_rows(table_, shared, names), kind), "lm-rows")
    rare = rows.where(F.col("hash").isNotNull()).select("row", "hash", "times").join(logs.where(F.col("n") < least), "hash")
    times, void = F.col("times"), F.lit(None).cast("long")
    rare = rare.select(
        "row", void.alias("doc_id"), void.alias("n_bytes"), void.alias("n_tokens"), F.when(F.col("n") > 0, times).otherwise(0).alias("n_known"),
        (times * (F.log10(F.col("n") + 0.1) - F.lit(bottom))).alias("base"), (times * F.col("tail")).alias("score"),
    )
    whole = rows.where(F.col("hash").isNull()).select("row", "doc_id", "n_bytes", "n_tokens", "n_known", *sums).unionByName(rare)
    out = whole.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), *(F.sum(x).alias(x) for x in sums))
    return out.select("doc_id", (hashed == 0).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", "n_bytes", (F.col("score") / F.lit(-float(np.log10(2.0))) / F.col("n_bytes")).alias("bits_per_byte"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
