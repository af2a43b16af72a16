"""Fill-in-the-middle: ranks, cuts and outputs against plain accounts, and odd tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chimerascope.llm import infill

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, seed=42, rate=50, suffix_first=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return text, len(units), "plain", None, None
    if h[3] % 100 < suffix_first:
        return f"<S>{s}<P>{p}<M>{m}", len(units), "spm", len(p), len(m)
    return f"<P>{p}<S>{s}<M>{m}", len(units), "psm", len(p), len(m)


def texts(n, seed):
    rng = random.Random(seed)
    odd = ["", " ", "\n\t ", "one", " one", "one ", "a<P>b", "é🙂 ß  x y ", "<", "<S <P", "x" * 3000]
    return odd + ["".join(rng.choice(["a", "B", "7", " ", "\n", "é", "🙂", ".", "  ", "<"]) for _ in range(rng.randrange(1, 200))) for _ in range(n)]


def test_ranks_count_classes():
    rng = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 65, 1000):
        classes = rng.integers(0, 12, size).astype(np.uint8)
        matrix = infill.WaveletMatrix(classes)
        at = np.arange(size + 1)
        for kind in range(12):
            assert (matrix.rank(kind, at) == np.r_[0, np.cumsum(classes == kind)]).all()


@pytest.mark.parametrize("batch", [1, 100, 1 << 20])
def test_outputs_against_a_plain_account(spark, batch, monkeypatch):
    monkeypatch.setattr(infill, "BATCH_BYTES", batch)
    rows = [(i, t) for i, t in enumerate(texts(150, 1))] + [(None, "no id here"), (7, None)]
    got = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    want = sorted((str(i), *map(str, plain(i, t))) for i, t in rows)
    assert sorted(tuple(map(str, (r["doc_id"], r["text"], *r["fim"]))) for r in got.collect()) == want
    assert {"spm", "psm", "plain"} == {w[3] for w in want}
    back = got.select(F.coalesce("doc_id", F.lit(-1)).alias("i"), infill.restored(F.col("text"), F.col("fim.form")).alias("text")).collect()
    assert sorted((r["i"], r["text"]) for r in back) == sorted((-1 if i is None else i, t or "") for i, t in rows)


def test_parameters_other_columns_and_empty_tables(spark):
    rows = [(i, f"some words of text {i}", i, "x", 1.0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, fim string, `odd name.x` double")
    every = infill.fill_in_middle(docs, seed=1, rate=100, suffix_first=0)
    assert every.columns == ["doc_id", "text", "n", "fim", "odd name.x", "fim_"]
    assert {r["fim_"]["form"] for r in every.collect()} == {"psm"}
    assert [(r["text"], *r["fim_"]) for r in every.orderBy("doc_id").collect()] == [plain(i, t, 1, 100, 0) for i, t, *_ in rows]
    assert {r["fim_"]["form"] for r in infill.fill_in_middle(docs, rate=0).collect()} == {"plain"}
    assert infill.digest(docs.limit(0)).collect() == []


def test_a_very_long_text(spark):
    text = "word é next\n" * 200_000 + " "
    doc_id = next(i for i in range(100) if plain(i, "x")[2] == "psm")
    got = infill.digest(spark.createDataFrame([(doc_id, text), (doc_id, text)], "doc_id long, text string")).collect()
    out, n, form, p, m = plain(doc_id, text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [tuple(r) for r in got] == [(doc_id, n, form, p, m, sha(out), sha(text))] * 2
