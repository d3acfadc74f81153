"""Cases where a query once did less than its whole job."""

from __future__ import annotations

from collections import defaultdict

from tests.llm.test_queries import tokens_of


def brute_kept(rows, size):
    """Least ids of the components of texts whose sets of ``size``-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = {}
    for doc, text, *_ in rows:
        w = tokens_of(text)
        sets[doc] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {d: new if r == old else r for d, r in root.items()}
    return set(root.values())


def test_stage_removes_by_five_words(spark, tmp_path):
    from graphloom.llm import neardup

    rows = []
    for family in range(6):
        words = [f"w{family}x{i}" for i in range(200)]
        rows += [(family * 10 + k, " ".join(w if (i * 37 + k * 11) % 200 >= 2 * k else f"v{k}x{i}" for i, w in enumerate(words))) for k in range(8)]
    rows += [(90, "a b c d"), (91, "A b\tC d"), (92, "a b c"), (93, "b c d a"), (94, "one"), (95, "one"), (96, "a b c d e"), (97, ""), (98, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in neardup.dedup_stage(spark, docs, str(tmp_path)).collect()}
    want = brute_kept(rows, 5)
    assert got == want and want > brute_kept(rows, 2)
    sizes = defaultdict(set)
    for r in neardup.similar_components(docs, 5).collect():
        sizes[r["n_shingles"]].add(r["doc_id"])
    assert sizes[0] == {97, 98} and sizes[1] == {90, 91, 92, 93, 94, 95, 96}


def test_scores_cover_the_byte_stream():
    """Heads and tails of a text together are its bits in a run over all its bytes, contexts crossing words."""
    import numpy as np
    import pyarrow as pa

    from graphloom.llm import contextmix as cm
    from graphloom.llm.wordhash import words_of

    rng = np.random.default_rng(1)
    model = {"size": cm.SLOTS, "odds": rng.normal(size=cm.layout(cm.SLOTS)[1][-1]) * (rng.random(cm.layout(cm.SLOTS)[1][-1]) < 0.5), "weights": np.full((cm.GATES, cm.PREDICTORS), 0.2), "refine": np.full(256 * cm.BUCKETS, 0.5)}
    texts = ["One  two\tthreefold a bc", "threefold two bc a one", "", None, "verylongword x"]
    words = words_of(pa.array(texts))
    keys, row = cm.heads_of(words)
    got = np.bincount(row, weights=cm.HeadLogs(model).of(keys), minlength=len(texts))
    for i, text in enumerate(texts):
        got[i] += cm.tail_logs([w.encode() for w in tokens_of(text)], model).sum()
        values, before, prefix = [], [[] for _ in range(cm.REACH)], []
        stream = bytes(cm.REACH)
        for word in [*tokens_of(text), ""]:
            so_far = np.uint64(0)
            for at, b in enumerate(word.encode() + b" "):
                values.append(b)
                prefix.append(so_far)
                for k in range(cm.REACH):
                    before[k].append(stream[-1 - k])
                stream += bytes([b])
                with np.errstate(over="ignore"):
                    so_far = so_far + cm._placed(np.array([b]), np.array([at]))[0]
        every = cm.Contexts(np.array(values, np.uint8), [np.array(b, np.uint64) for b in before], np.array(prefix, np.uint64))
        assert np.isclose(got[i], cm._logs(every, model).sum())


def test_word_order_counts_in_scores(spark):
    from graphloom.llm import contextmix as cm

    docs = spark.createDataFrame([(i, "the cat sat on a mat and the dog ran") for i in range(30)] + [(100, "dog mat the a the ran sat on and cat")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in cm.score_texts(docs).collect()}
    assert score[1] > score[100] + 1


def test_rows_without_id_link_others(spark):
    """A text that only rows without an id have joins two documents that are not near copies of each other."""
    from graphloom.llm import neardup

    words = [f"w{i}" for i in range(200)]
    edited = lambda n: " ".join(f"v{i}" if i % 20 == 0 and i < 20 * n else w for i, w in enumerate(words))
    rows = [(1, edited(0)), (None, edited(8)), (None, edited(8)), (2, " ".join(f"v{i}" if i % 20 == 0 or i % 20 == 10 and i < 120 else w for i, w in enumerate(words)))]
    found = {r["doc_id"]: r["component_id"] for r in neardup.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1, None: 1}
    alone = neardup.similar_components(spark.createDataFrame([rows[0], rows[3]], "doc_id long, text string")).collect()
    assert {r["component_id"] for r in alone} == {1, 2}


def test_added_token_has_its_id():
    import public_tokenizers
    from tokenizers import Tokenizer

    from graphloom.llm import packing

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>c", "<|endoftext| >", "plain", "", "é\n<|endoftext|>\n"):
        assert packing.token_ids(text).tolist() == [*t.encode(text, add_special_tokens=False).ids, 1]


def test_scores_do_not_depend_on_partitions(spark, tables):
    """Equal scores for one, four and seventeen partitions, of input and of shuffles."""
    from graphloom.llm import contextmix as cm

    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    found = []
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in (1, 4, 17):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            found.append(sorted((r["doc_id"], r["n_bytes"], r["score"]) for r in cm.score_texts(docs.repartition(parts)).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for other in found[1:]:
        assert [x[:2] for x in other] == [x[:2] for x in found[0]]
        assert max(abs(a[2] - b[2]) for a, b in zip(found[0], other, strict=True)) < 1e-6


def test_long_words_cost_by_length(spark):
    """A held-out word of random bytes costs bits for every byte; no floor under its probability."""
    import random
    import zlib

    from graphloom.llm import contextmix as cm

    rng = random.Random(3)
    held = [d for d in range(1000) if zlib.crc32(str(d).encode()) % 10 == 0][:4]
    sizes = (200, 600, 3000, 6000)
    rows = [(d, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))) for d, n in zip(held, sizes, strict=True)]
    rows += [(d, "plain words stand here") for d in range(1000, 1040)]
    got = {r["doc_id"]: r for r in cm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    scores = [got[d]["score"] for d in held]
    assert scores == sorted(scores, reverse=True) and scores[3] < 8 * scores[1] < 0
    for d, n in zip(held, sizes, strict=True):
        assert got[d]["n_bytes"] == n + 2
        assert abs(got[d]["bits_per_byte"] * (n + 2) + got[d]["score"] / 0.30102999566398) < 1e-3


def test_stages_keep_columns_of_any_name(spark, tables):
    """Columns named like the stages' own keep their values."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    names = ["_median", "_kn_bits", "_kn_bytes", "_lang", "_keep", "_low", "_hash", "_copy", "_id", "_text", "secret_spans", "_blob", "blob", "spans", "_copies", "_source", "_block", "_blocks", "_key", "_tokens", "node", "a.b", "user column 0", "found blob", "own blob"]
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    wide = docs.select("*", *(F.lit(f"v{i}").alias(n) for i, n in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, tables)
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert rows and all(r[len(docs.columns) + i] == f"v{i}" for r in rows for i in range(len(names))), name
        plain = stage(spark, docs, tables).collect()
        assert sorted(map(str, plain)) == sorted(str(type(p)(**dict(zip(docs.columns, r, strict=False)))) for p, r in zip(plain, rows, strict=True)), name


def test_ids_of_odd_texts_are_the_tokenizers():
    """Control strings, the added token and a text of 1 MB."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from graphloom.llm import packing

    rng = random.Random(4)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    parts = ["<|endoftext|>", " the", "\x00", "\r\n\n", "é", "漢字", "  ", "<s>", "[INST]", "1234567", "'s", "​", "don't", "🙂", "\x7f", "ａ"]
    long = "".join(rng.choice(parts) for _ in range(250_000))
    assert len(long.encode()) > 1_000_000
    for text in ["".join(rng.choice(parts) for _ in range(40)) for _ in range(100)] + [long]:
        assert packing.token_ids(text).tolist() == [*t.encode(text, add_special_tokens=False).ids, 1]


def test_many_matches_in_one_text(spark):
    """A text of many secrets is scanned and masked in little time, places right."""
    from graphloom.llm import secrets
    from tests.llm.test_queries import brute_spans

    text = " ".join(f"token=abc{i:06d} x{'f' * (20 + i % 8)}" for i in range(8000))
    docs = spark.createDataFrame([(1, text), (2, "token=ab"), (3, None)], "doc_id long, text string")
    ledger = {r["n"]: r for r in secrets.findings(docs, secrets.scan_ledger(docs)).selectExpr("doc_id as n", "secret_spans as s").collect()}
    assert [(s["start"], s["kind"], s["end"]) for s in ledger[1]["s"]] == brute_spans(text)
    assert ledger[2]["s"] == ledger[3]["s"] == [] and secrets.scan_ledger(docs).count() == 3
    masked = secrets.mask_stage(spark, docs.selectExpr("*", "0L as n_chars"), "").where("doc_id = 1").first()["text"]
    want, at = [], 0
    for a, _, b in brute_spans(text):
        if a >= at:
            want += [text[at:a], secrets.MASK]
        at = max(at, b)
    assert masked == "".join(want) + text[at:]


def test_wide_components(spark):
    """Inner products beyond a long's range end at its limit, where they are ties."""
    from pyspark.sql import functions as F

    from graphloom.llm import mtree

    big = 2.0**31 / 1024
    vectors = [(0, [big] * 4), (1, [big / 2] * 4), (2, [-big] * 4), (3, [1.0] * 4), (4, [big] * 4)]
    frame = spark.createDataFrame(vectors, "vec_id long, e array<double>").select("vec_id", mtree.scaled(F.col("e")).alias("v"))
    got = {r["vec_id"]: (r["rank"], r["score"]) for r in mtree.topk(frame, frame.where("vec_id = 0")).collect()}
    assert got == {1: (1, 2**63 - 1), 4: (2, 2**63 - 1), 3: (3, 2**31 * 1024 * 4), 2: (4, -(2**63))}


def test_empty_chat_table(spark, empty_tables):
    from graphloom.llm import catalog

    assert [r["conv_id"] for r in catalog.QUERIES["op8_chat_formatting"](spark, empty_tables).collect()] == [-1]


def test_no_link_is_lost_among_common_passages(spark):
    """Two thousand texts with passages that hundreds share, near copies at and around the limit, against all pairs; recall is 1."""
    import random

    from graphloom.llm import neardup
    from tests.llm.test_queries import brute_components

    rng = random.Random(9)
    passages = [" ".join(f"p{k}w{rng.randrange(60)}" for _ in range(rng.randint(20, 70))) for k in range(5)]
    rows = []
    while len(rows) < 2000:
        own = [f"x{rng.randrange(400)}" for _ in range(rng.randint(3, 90))]
        base = (rng.choice(passages).split() if rng.random() < 0.7 else []) + own
        for _ in range(rng.choice((1, 1, 2, 3, 6))):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = f"y{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + k, passages[0] + f" z{k}") for k in range(120)]
    found = neardup.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    got, want = ({(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found}, set(brute_components(rows)))
    joined = {d for d, _, c in want if d != c}
    recall = 1 - len({d for d, _, c in got if d == c} & joined) / len(joined)
    print(f"recall of linked documents {recall:.6f} of {len(joined)}")
    assert recall == 1.0 and got == want


def test_cool_values_either_way(spark):
    """Hot values joined by shuffle give the same lists as broadcast ones."""
    from graphloom.llm import neardup

    rows = [(i, 40 + i % 60, sorted({(i * 7 + j * 31) % 200 if i % 2 else i * 1000 + j if j % 3 else j for j in range(min(64, 40 + i % 60))})) for i in range(600)]
    nodes = spark.createDataFrame(rows, "node long, n long, sketch array<long>")
    both = [sorted((r["node"], tuple(r["keys"]), r["heavy"]) for r in neardup.cool_values(nodes, most).collect()) for most in (10**6, 0)]
    assert both[0] == both[1] and any(r[2] for r in both[0]) and not all(r[2] for r in both[0])
