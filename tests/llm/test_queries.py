"""Every query against a plain computation over the same rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import catalog, chat, packing, quality, secrets, sharding
from graphloom.llm.wordhash import words_of

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def result(spark, name, folder):
    return catalog.QUERIES[name](spark, folder).collect()


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n != "op8_chat_formatting"])
def test_empty_tables(spark, empty_tables, name):
    assert result(spark, name, empty_tables) == []


def test_packing(spark, tables, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = result(spark, "op1_packing", tables)
    want = Counter()
    for doc, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want[doc, len(ids)] += len(ids)
        for r in got:
            if r["doc_id"] == doc:
                assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    assert Counter({k: sum(r["length"] for r in got if (r["doc_id"], r["doc_tokens"]) == k) for k in want}) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert all(sum(x for x, _ in packing.cuts(n)) == n and all(x <= packing.CAPACITY // j for x, j in packing.cuts(n)) for n in range(packing.CAPACITY))


def test_quality(spark, tables, rows):
    got = {r["doc_id"]: r for r in result(spark, "op2_quality_classifier", tables)}
    good = [r[0] for r in rows if r[0] < 90]
    assert sum(got[d]["kept"] for d in good) >= 0.95 * len(good)
    assert not any(got[d]["kept"] for d in (122, 123, 130, 131))
    assert got[130]["perplexity"] is None


def test_model_is_a_distribution(spark):
    docs = spark.createDataFrame([(f"abab abc bcab {i} cabba",) for i in range(20)], "text string")
    bits = quality.dense(quality.fit(docs)).reshape(-1, quality.SYMBOLS)
    assert np.allclose((2.0 ** -bits[:500]).sum(1), 1.0, atol=1e-4)


def test_media(spark, tables, rows):
    got = defaultdict(set)
    for r in result(spark, "op3_media_columns", tables):
        got[r["doc_id"]].add((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["feature"], len(r["peak_times"])))
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        full = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        (r,) = got[doc]
        assert r[:4] == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])) and r[4] == len(full) + 44
        assert r[6] == 2 * (len(full) // 288 - 2)


def brute_components(rows):
    sets = []
    for doc, text, *_ in rows:
        w = tokens_of(text)
        sets.append((doc, frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset(w)))
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and len(a & b) * 100 >= 80 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(lambda: 1 << 62)
    for i, (doc, _) in enumerate(sets):
        least[find(i)] = min(least[find(i)], doc)
    return Counter((doc, len(s), least[find(i)]) for i, (doc, s) in enumerate(sets))


def test_near_duplicates(spark, tables, rows):
    got = result(spark, "op4_minhash_dedup", tables)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_large_family(spark):
    """More near copies than a list or a block holds, none of which is the original."""
    from graphloom.llm import neardup

    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(w if (j * 31 + i * 7) % 97 > 4 else f"v{i}x{j}" for j, w in enumerate(words))) for i in range(160)]
    found = neardup.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute_components(rows)


def test_lm(spark, tables, rows):
    got = result(spark, "op5_lm_scoring", tables)
    learnt = [(zlib.crc32(str(r[0]).encode()) % 10 != 0, [*tokens_of(r[1]), "\0end"]) for r in rows]
    c = Counter(w for ok, ws in learnt if ok for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((r[0], not ok, len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for r, (ok, ws) in zip(rows, learnt, strict=True))
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)


def test_spelling_is_a_distribution():
    from graphloom.llm import contextmix as cm

    model = {"size": cm.SLOTS, "odds": np.random.default_rng(0).normal(size=cm.layout(cm.SLOTS)[1][-1]), "weights": np.full((cm.GATES, cm.PREDICTORS), 0.2), "refine": np.full(256 * cm.BUCKETS, 0.5)}
    every = [bytes([b]) for b in range(256)]
    spelled = cm.Spelling([b"ab" + e for e in every])
    total = np.zeros(len(spelled.bytes))
    for position, node, slots, bit in spelled.bits():
        score = (model["weights"][position * cm.LEVELS + cm.PREDICTORS] * model["odds"][slots].T).sum(1)
        p, _ = cm._refined(model["refine"], np.clip(score, -12, 12), node)
        total += np.log(np.where(bit, p, 1 - p))
    assert np.exp(total[2::4]).sum() == pytest.approx(1.0)


def mixture(total, exponent):
    """Entropy of a mixture as a share of the highest possible one."""
    p = np.array([t**exponent for t in total], float)
    p /= p.sum()
    return float(-(p * np.log(p)).sum() / np.log(len(p)))


def exponent_of(total, target, most=2.0):
    """By plain bisection: the exponent with the target entropy, or the end of the range that the repetition limit allows."""
    reach = np.log(most) / np.log(max(total) / min(total))
    low, high = max(0.0, 1 - reach), 1 + reach
    if mixture(total, low) <= target:
        return low
    if mixture(total, high) > target:
        return high
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if mixture(total, middle) > target else (low, middle)
    return high


def test_mixing(spark, tables, rows):
    """Shares, exponent, weights, budgets, epochs and positions, all computed again."""
    got = result(spark, "op6_source_mixing", tables)
    total, least = Counter(), Counter()
    for r in rows:
        n = max(1, len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")))
        total[r[3] or ""] += n
        least[r[0], r[3] or ""] += 1
    sizes = list(total.values())
    own = mixture(sizes, 1.0)
    a = exponent_of(sizes, own + 0.5 * (1 - own))
    assert a < 1
    times = {s: (total[s] / max(sizes)) ** (a - 1) for s in total}
    assert max(times.values()) > 1.2
    for s in total:
        mine = sorted((r for r in got if (r["source"] or "") == s), key=lambda r: (r["position"], r["tokens"]))
        at, budget = 0, times[s] * total[s]
        blocks = Counter()
        for r in mine:
            assert r["position"] == at and r["epoch"] == at // total[s] and r["mix_at"] == pytest.approx(at / budget, rel=1e-4)
            at += r["tokens"]
            blocks[r["epoch"], r["block"]] += r["tokens"]
        # the last block starts before the budget is met
        last = blocks[mine[-1]["epoch"], mine[-1]["block"]]
        assert at - last <= budget * (1 + 1e-4) and at >= budget * (1 - 1e-4)
        for epoch in range(int(times[s] * (1 - 1e-4))):
            assert Counter(r["doc_id"] for r in mine if r["epoch"] == epoch) == Counter({d: n for (d, x), n in least.items() if x == s})


@pytest.mark.parametrize(
    ("total", "target", "most", "met"),
    [((8000, 1000, 1000), 1.0, 2.0, "repetition limit"), ((8000, 1000, 1000), 0.9, 100.0, "target"), ((100, 110, 90), 0.5, 2.0, "repetition limit"), ((100, 110, 90), 0.99, 2.0, "target"), ((100, 110, 90), None, 2.0, "target"), ((8000, 7000, 10**9), 0.2, 10**9, "target"), ((5, 5), None, 2.0, "even"), ((3,), 0.5, 2.0, "even")],
)
def test_bisection(spark, total, target, most, met):
    from graphloom.llm.mixing import bisect_exponent

    a = bisect_exponent(spark.createDataFrame([(t,) for t in total], "total long"), target, most)
    assert a.met == met
    if met == "even":
        assert a.value == 1.0
        return
    assert a.value == pytest.approx(exponent_of(total, a.target, most), abs=1e-5)
    if met == "target":
        assert mixture(total, a.value) == pytest.approx(a.target, abs=1e-5)


def test_sharding(spark, tables, rows):
    got = result(spark, "op7_sharding", tables)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    groups, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        groups[r["text_crc32"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in groups.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.schedule([("a", 5), ("b", 4), ("c", 3), ("d", 3)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_chat(spark, tables):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tables}/conversations.parquet/*.parquet'")
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({chat.OP8_SQL})").fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in result(spark, "op8_chat_formatting", tables)) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|>\\[]/sINSTY end\n", max_size=40), st.text(alphabet="a%0A\n<|\\", max_size=8))
def test_chat_round_trip(text, role):
    formatted, spans = chat.render([(role, text), ("assistant", text)])
    assert chat.parse(formatted) == [(role, text), ("assistant", text)]
    assert chat.unescaped(formatted[slice(*spans[-1])]) == text and chat.unescaped(chat.escaped(text)) == text


def test_chat_events():
    events = [(0, "message", None, "user", "q"), (1, "message", None, "assistant", "he"), (2, "delta", 1, None, "llo"), (3, "message", None, "user", "more"), (4, "edit", 0, None, "Q"), (5, "regenerate", 1, None, ""), (6, "delta", 1, None, "new"), (7, "delta", 99, None, "lost")]
    assert chat.fold(events) == [("user", "Q"), ("assistant", "new")]


def test_topk(spark, tables):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()}
    v = {}
    for i, e in vectors.items():
        if e is not None and all(x is not None and math.isfinite(x) for x in e):
            v[i] = [math.floor(1024 * float(x)) for x in e] + [0] * (8 - len(e))
    want = set()
    for q in (i for i in v if i % 100 == 0):
        order = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q)[:10]
        want |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(order)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in result(spark, "op9_exact_topk", tables)} == want


def brute_spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.ASCII):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark, tables, rows):
    got = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in result(spark, "op10_secret_scans", tables))
    want = Counter()
    for r in rows:
        spans = brute_spans(r[1])
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        want[r[0], *(sum(k == i for _, k, _ in spans) for i in range(3)), hashlib.sha256(said.encode()).hexdigest()] += 1
    assert got == want


def test_ledger_scans_once(spark):
    docs = spark.createDataFrame([("p1", "token=abcdef"), ("p2", "token=abcdef"), ("p3", "nothing")], "path string, text string")
    first = secrets.scan_ledger(docs)
    assert first.count() == 2
    more = docs.union(spark.createDataFrame([("p4", "secret=zzzzzz")], "path string, text string"))
    assert secrets.scan_ledger(more, first).count() == 1
    found = secrets.findings(more, first.union(secrets.scan_ledger(more, first)))
    masked = {r["path"]: r["t"] for r in found.select("path", secrets.masked(found["text"], found["secret_spans"]).alias("t")).collect()}
    assert masked == {"p1": "[secret]", "p2": "[secret]", "p3": "nothing", "p4": "[secret]"}


def test_word_hashes():
    import pyarrow as pa

    w = words_of(pa.array(["A b\x0ba", None, "", " é\tB "]))
    assert w.row.tolist() == [0, 0, 0, 3, 3] and w.hashes[0] == w.hashes[2] != w.hashes[1] == w.hashes[4]
    assert w.text(3) == "é".encode()


def test_long_texts_hash_in_segments(monkeypatch):
    import pyarrow as pa

    from graphloom.llm import wordhash

    texts = pa.array(["ab cd " * 50 + "x" * 90, None, "y z " * 30])
    whole = words_of(texts)
    monkeypatch.setattr(wordhash, "SLICE", 16)
    cut = words_of(texts)
    assert (cut.hashes == whole.hashes).all() and (cut.row == whole.row).all() and (cut.start == whole.start).all()


def test_pipeline(spark, tables, empty_tables, rows):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == columns, name
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not {122, 123, 130, 121, 134} & set(kept) and len(kept) > 80
    assert not any("hunter2" in (t or "") for t in kept.values())
    packed = corpus_pipeline.run(spark, tables)
    assert {r["doc_id"] for r in packed.collect()} == set(kept)
    assert corpus_pipeline.run(spark, empty_tables).count() == 0


def test_nulls_everywhere(spark, tmp_path):
    """Rows of nothing but nulls crash no query and no stage."""
    import corpus_pipeline

    folder = str(tmp_path)
    docs = [(None, None, None, None, None), (None, "some words that are here", None, None, 5), (1, "some words that are here", "en", "s", None), (2, None, None, "s", 0), (3, "password: abcdefgh and more words", None, None, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(None, None, None), (1, None, None), (3, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(None, [1.0]), (100, [0.5]), (3, None), (4, [0.25])], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(None, None, None, None), (1, None, None, None), (1, 0, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    sizes = {name: len(result(spark, name, folder)) for name in catalog.QUERIES}
    assert all(sizes[n] == len(docs) for n in sizes if n not in ("op1_packing", "op6_source_mixing", "op8_chat_formatting", "op9_exact_topk"))
    assert sizes["op1_packing"] >= len(docs) and sizes["op8_chat_formatting"] == 3 and sizes["op9_exact_topk"] == 1
    kept = {(r["doc_id"], r["text"]) for r in corpus_pipeline.STAGES[1][1](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()}
    assert (1, docs[2][1]) in kept and (None, docs[1][1]) not in kept and (3, docs[4][1]) in kept
    assert corpus_pipeline.run(spark, folder).count() >= 0
