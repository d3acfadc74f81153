"""Set joins, resampling and point-in-time features against plain loops."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import catalog, ngram_join, pointintime, resampling
from tests.llm.conftest import shop

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)] if words else [])


def linked(a, b, similar=90):
    return bool(a) and 100 * len(a & b) >= similar * len(a | b)


def classes(sets, link):
    """The least position of each component."""
    of = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if of[i] != of[j] and link(sets[i], sets[j]):
                low, high = sorted((of[i], of[j]))
                of = [low if x == high else x for x in of]
    return of


def expected_components(rows, size=3, similar=90):
    sets = [shingles(text, size) for _, text in rows]
    of = classes(sets, lambda a, b: linked(a, b, similar))
    least = {}
    for c, (doc, _) in zip(of, rows, strict=True):
        least[c] = doc if c not in least or least[c] is None else least[c] if doc is None else min(doc, least[c])
    return sorted(((doc, len(s), least[c] if s else doc) for (doc, _), s, c in zip(rows, sets, of, strict=True)), key=repr)


def as_rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id")) for r in df.collect()), key=repr)


def test_join_equals_all_pairs(spark, tables, rows):
    assert as_rows(catalog.QUERIES["op11_ngram_jaccard_join"](spark, tables)) == expected_components([r[:2] for r in rows])


def chain(n, words=60, step=1, seed=1):
    """Texts of which each differs from the last in ``step`` words, so that only neighbours are linked."""
    rng = random.Random(seed)
    now, out = [f"w{rng.randrange(10**6)}" for _ in range(words)], []
    for i in range(n):
        for k in range(step):
            now[(i * step + k) % words] = f"n{i}x{k}"
        out.append(" ".join(now))
    return out


def test_families_cut_into_tiles(spark, monkeypatch):
    """Families larger than a block, over several bands, beside texts that only share a passage."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "BIN_NODES", 4)
    passage = " ".join(f"common{i}" for i in range(40))
    texts = chain(40) + [t + " tail" * (i // 4) for i, t in enumerate(chain(30, 50, 0, 2))] + [f"{passage} own{i} x{i} y{i} z{i}" for i in range(25)] + [f"{passage} " + " ".join(f"o{i}x{j}" for j in range(30)) for i in range(20)]
    rows = list(enumerate(texts)) + [(None, texts[3]), (None, "only without id here"), (500, texts[5]), (500, texts[5])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, node string")
    assert as_rows(ngram_join.jaccard_components(df)) == expected_components(rows)


def test_nulls_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A b"), (6, "a B"), (7, long), (8, long + " more"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 5), (6, 1, 5), (7, 149_998, 7), (8, 149_999, 7), (None, 0, None)}
    assert set(as_rows(ngram_join.jaccard_components(df))) == want


@settings(deadline=None, max_examples=60)
@given(st.integers(9, 400), st.integers(0, 10**6), st.sampled_from([80, 90, 95]))
def test_linked_sets_share_a_name(n, seed, similar):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.int64)
    drop = rng.integers(0, n + 1)
    other = np.concatenate((base[: n - drop % (n // 5 + 1)], rng.integers(0, 1 << 63, int(rng.integers(0, n // 9 + 1)), dtype=np.int64)))
    a, b = np.unique(base), np.unique(other)
    names, ends, _ = ngram_join.segment_names(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), similar)
    common = len(np.intersect1d(a, b))
    if 100 * common >= similar * (len(a) + len(b) - common) and common < max(len(a), len(b)):
        assert np.intersect1d(names[: ends[1]], names[ends[1] :]).size


@settings(deadline=None, max_examples=40)
@given(st.integers(0, 10**6))
def test_tile_links_are_exact(seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    sets = [np.unique(np.concatenate((rng.choice(pool, rng.integers(15, 50), replace=False), pool[:30]))) for _ in range(24)]
    side = np.zeros(24, np.int64) if seed % 2 else rng.integers(0, 2, 24)
    found = ngram_join.tile_links(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets]))), side)
    plain = [frozenset(s.tolist()) for s in sets]
    at = {id(s): i for i, s in enumerate(plain)}
    link = lambda a, b: linked(a, b) and ((side == side[0]).all() or side[at[id(a)]] != side[at[id(b)]])
    got = classes(list(range(24)), lambda i, j: (i, j) in found or (j, i) in found)
    assert got == classes(plain, link)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_buckets(texts, order, buckets):
    count = Counter()
    for text in texts:
        w = plain_words(text)
        count.update(zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, order + 1) for i in range(len(w) - k + 1))
    return count


def test_tries_count_runs_of_words(monkeypatch):
    """Tries that start afresh and texts in slices give the counts of plain strings."""
    monkeypatch.setattr(resampling, "MOST_NODES", 40)
    monkeypatch.setattr(resampling, "SLICE", 16)
    texts = ["a b a b c", "", "É b-b B1 x" * 30, " ".join(f"w{i % 37}" for i in range(500)), "a" * 90]
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, None])], ["text"])
    for order in (1, 2, 3):
        (out,) = resampling._counted(order, 97)(iter([batch]))
        assert dict(zip(out["bucket"].to_pylist(), out["n"].to_pylist(), strict=True)) == plain_buckets(texts, order, 97)


def plain_sample(docs, target, order, buckets, least, share):
    s, t = plain_buckets([d[1] for d in docs], order, buckets), plain_buckets(target, order, buckets)
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for doc, text in docs:
        w = plain_words(text)
        found = [gain[zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets] for k in range(1, order + 1) for i in range(len(w) - k + 1)]
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(found) // len(found) if found else 0
        out.append((doc, len(found), len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    eligible = sorted((r for r in out if r[2] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = Counter((r[0], rank) for rank, r in enumerate(eligible[: len(eligible) * share // 100], 1))
    return out, drawn


def test_resampling(spark, tables, rows):
    target = [r["text"] for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    out, drawn = plain_sample([r[:2] for r in rows], target, 1, 10_000, 20, 10)
    got = catalog.QUERIES["op12_target_resampling"](spark, tables).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score")) for r in got) == Counter((a, b, d, e) for a, b, _, d, e in out)
    assert Counter((r["doc_id"], r["rank"]) for r in got if r["rank"] is not None) == drawn and sum(drawn.values()) == 10


def test_resampling_by_word_pairs(spark):
    docs = [(i, " ".join(f"w{(i * j) % 23}" for j in range(i % 40))) for i in range(120)] + [(None, "w1 w2 w3 " * 9), (5, None), (5, "w1 w2 " * 20)]
    target = ["w1 w2 w3 w4", "w2 w4 w6", None]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, weight int").repartition(5)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    gains = resampling.bucket_gains(resampling.bucket_counts(df, 2, 61), resampling.bucket_counts(t, 2, 61), 61)
    got = resampling.drawn(resampling.weighted(df, gains, 2), 30, 10).collect()
    out, drawn = plain_sample(docs, target, 2, 61, 10, 30)
    assert Counter(tuple(r[c] for c in ("doc_id", "n_features", "n_words", "weight", "score")) for r in got) == Counter(out)
    assert Counter((r["doc_id"], r["rank"]) for r in got if r["rank"] is not None) == drawn


def cents(x):
    return 0 if x is None or x != x else math.floor(100 * x + 0.5)


def plain_features(clicks, sales, lines, windows=(2, 14), days=7):
    wait, unique = timedelta(minutes=240), {repr(c): c for c in clicks}.values()
    known = lambda arrived, t: arrived is not None and arrived + wait <= t
    out = []
    for sale, client, _, _, sold, *_ in sales:
        if client is None or sold is None:
            continue
        t = sold + timedelta(seconds=zlib.crc32(("" if sale is None else str(sale)).encode()) % 259200)
        own = [s for s in sales if s[1] == client and s[4] is not None]
        label = any(t < s[4] <= t + timedelta(days=days) for s in own)
        for d in windows:
            inside = lambda at: at is not None and t - timedelta(days=d) < at <= t  # noqa: B023, E731
            c = [x for x in unique if x[3] == client and inside(x[1]) and known(x[2], t)]
            s = [x for x in own if inside(x[4]) and known(x[5], t)]
            ln = [x for y in s for x in lines if x[0] is not None and x[0] == y[0] and x[8] is not None and x[8] <= t]
            last = max(c, key=lambda x: (x[1], -1 if x[0] is None else x[0]), default=None)
            out.append((sale, d, (t - datetime(1970, 1, 1)) // timedelta(microseconds=1), label, len(c), sum(x[4] == "purchase" for x in c), sum(cents(x[5]) for x in c), last and last[0], len(s), sum(cents(x[3]) for x in s), len(ln), len({x[2] for x in ln} - {None}), sum(cents(x[5]) for x in ln)))
    return Counter(out)


FEATURES = ("sale_id", "d", "t_us", "label", "n_clicks", "n_purchases", "click_cents", "last_click_id", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")


def features_of(df):
    return Counter(tuple(r[c] for c in FEATURES) for r in df.collect())


def test_features(spark, tables):
    want = plain_features(*(shop()[t][0] for t in ("clicks", "sales", "sale_lines")))
    assert features_of(catalog.QUERIES["op13_point_in_time"](spark, tables)) == want


def test_features_in_slices_and_salts(spark, tables, monkeypatch):
    """A client cut into slices and salts gets the features of one cell."""
    monkeypatch.setattr(pointintime, "BIG", 30)
    monkeypatch.setattr(pointintime, "CELL", 64)
    monkeypatch.setattr(pointintime, "SHARED", 40)
    rows = [spark.read.parquet(f"{tables}/{t}.parquet") for t in ("clicks", "sales", "sale_lines")]
    dealt = pointintime.cells(pointintime.events(*rows), pointintime.WINDOWS, pointintime.LABEL_DAYS)
    assert dealt.where("salt > 2 AND part AND slice >= 0").count() and dealt.where("slice = -1 AND NOT part").count()
    want = plain_features(*(shop()[t][0] for t in ("clicks", "sales", "sale_lines")))
    assert features_of(pointintime.window_features(*rows)) == want
    other = plain_features(*(shop()[t][0] for t in ("clicks", "sales", "sale_lines")), windows=(1, 5, 30), days=2)
    assert features_of(pointintime.window_features(*rows, windows=(1, 5, 30), label_days=2)) == other


def test_times_do_not_depend_on_the_session(spark, tables):
    sales = spark.read.parquet(f"{tables}/sales.parquet")
    ask = lambda: sales.select(pointintime.micros(sales, "sold_at").alias("x")).where("x is not null").orderBy("x").first()["x"]
    before = ask()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert ask() == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9), st.integers(0, 9), st.integers(-5, 5), st.integers(0, 2)), max_size=40), st.integers(0, 10**6))
def test_tree_versions_and_points(found, seed):
    client, at, known, value, item = (np.array([f[i] for f in found], np.int64) for i in range(5))
    known = np.maximum(at, known)
    rng = np.random.default_rng(seed)
    who, now = rng.integers(0, 4, 20), rng.integers(0, 12, 20)
    since = now - rng.integers(1, 6, 20)
    key = lambda c, t: c << 32 | (t + 10)
    (sums, ones), latest = pointintime.Timeline(key(client, at), key(client, known), [value, np.ones(len(found), np.int64)]).window(key(who, now), key(who, since))
    a, b, c = pointintime.item_points(client, item, key(client, at), key(client, known))
    (items,), _ = pointintime.Timeline(a, b, [c]).window(key(who, now), key(who, since))
    for i in range(20):
        seen = [f for f, k in zip(found, known, strict=True) if f[0] == who[i] and since[i] < f[1] <= now[i] and k <= now[i]]
        assert (sums[i], ones[i], items[i]) == (sum(f[3] for f in seen), len(seen), len({f[4] for f in seen}))
        assert (latest[i] < 0) == (not seen) and (not seen or at[latest[i]] == max(f[1] for f in seen))
