from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import types as T

SYLLABLES = {"en": "the and ing er on at re th ti ha".split(), "fr": "le eau é ou an ch re en ai ière".split()}


def prose(rng, lang, n):
    words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source) with copies, near copies, junk, secrets, nulls, empty, long and repeated rows."""
    rng = random.Random(5)
    out = [(i, prose(rng, "en" if i % 3 else "fr", rng.randint(40, 120)), "en" if i % 3 else "fr", f"src{min(i % 7, 3)}") for i in range(90)]
    base = prose(rng, "en", 150)
    words = base.split()
    for k in range(12):
        changed = list(words)
        for j in rng.sample(range(len(words)), k % 6):
            changed[j] = f"edit{k}x{j}"
        out.append((100 + k, " ".join(changed), "en", "src0"))
    out += [(120, base, "en", "src0"), (121, base.upper(), "en", "src1"), (122, "### " * 200, "en", "src1"), (123, "WHAT IS THIS!! " * 40, "fr", "src2")]
    out += [(130, None, "en", "src0"), (131, "", "fr", None), (132, "   \n\t", None, "src0"), (133, "one", "en", "src1"), (134, "one", "en", "src1"), (135, prose(rng, "en", 6000), "en", "src0")]
    out += [(140, "x password = 'hunter2-long' y AKIA" + "A" * 16 + " z " + "0a1b" * 8, "en", "src0"), (141, "token:token:abcdefgh Secret: short API_KEY=abcdef", "en", "src0"), (142, "éé token=abcdef1 " + "f" * 23 + " " + "f" * 24, "fr", "src2")]
    return out + [out[3], out[3]]


@pytest.fixture(scope="session")
def tables(spark, rows, tmp_path_factory):
    """A folder of tables with columns that clash with the operators' own names."""
    folder = str(tmp_path_factory.mktemp("tables"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("text", "lang", "source")), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("node", "group", "blob", "kept", "score"))])
    spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "a", "b", "c", "d", "e") for r in rows], schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 0 if r[0] in (122, 123) else 1, 0) for r in rows if r[0] < 90 or r[0] in (122, 123)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rng = random.Random(6)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(8)] if i % 9 else [0.5] * 8) for i in range(400)] + [(900, None), (901, [None, 1.0]), (902, [float("nan")] * 8), (903, [0.25] * 4)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    turns = [(1, 0, "user", "hi <|end|>\n<|turn|>x"), (1, 1, "assistant", "yo \\<\\| [INST] </s>"), (2, 0, "system", None), (2, 1, "user", ""), (2, 2, "assistant", "é\n\n"), (2, 2, "assistant", "é\n\n"), (3, 0, "odd\nrole%", "t")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([(i, prose(rng, "en", 30)) for i in range(6)] + [(6, None), (7, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, (found, schema) in shop().items():
        spark.createDataFrame(found, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder


def shop():
    """Rows and schema of clicks, sales and sale_lines: one client with most rows, ties, nulls, repeated, late and broken rows, clashing columns."""
    rng, start = random.Random(7), datetime(2024, 1, 1)
    when = lambda days: start + timedelta(seconds=rng.randrange(days * 86400 // 600) * 600)
    client = lambda: None if rng.random() < 0.03 else 7 if rng.random() < 0.5 else rng.randrange(12)
    late = lambda at: None if at is None or rng.random() < 0.04 else at + timedelta(seconds=rng.choice([-3600, 0, 5, 600, 90_000, 2_000_000]))
    amount = lambda: rng.choice([None, float("nan"), 0.0, -1.005, 2.675, round(rng.uniform(0, 90), 2)])
    clicks, sales, lines = [], [], []
    for i in range(400):
        at = None if rng.random() < 0.03 else when(60)
        clicks.append((None if i % 50 == 3 else i, at, late(at), client(), rng.choice(["view", "purchase", None]), amount(), rng.choice([None, "{}", '{"k": 1}']), "x"))
    for i in range(150):
        at = None if rng.random() < 0.03 else when(60)
        sales.append((None if i == 9 else i, client(), "done", amount(), at, late(at), 1, 5))
        for n in range(rng.choice([0, 1, 2, 4, 30 if i == 11 else 1])):
            lines.append((i, n, None if rng.random() < 0.1 else rng.randrange(5), 1, 1, amount(), 0.0, "kept", None if at is None or rng.random() < 0.05 else at + timedelta(days=rng.randrange(9)), "y"))
    clicks += clicks[:20] + [(*clicks[30][:6], "other", "x")]
    lines += lines[:15] + [(None, 1, 1, 1, 1, 1.0, 0.0, "kept", start, "y"), (9999, 1, 1, 1, 1, 1.0, 0.0, "kept", start, "y")]
    return {
        "clicks": (clicks, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, known string"),
        "sales": (sales, "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, salt int"),
        "sale_lines": (lines, "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, client string"),
    }


@pytest.fixture(scope="session")
def empty_tables(spark, tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "embeddings", "conversations", "benchmark", "clicks", "sales", "sale_lines"):
        spark.read.parquet(f"{tables}/{t}.parquet").where("false").write.parquet(f"{folder}/{t}.parquet")
    return folder
