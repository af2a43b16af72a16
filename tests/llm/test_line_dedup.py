"""Repeated lines: the filters lose nothing, results equal plain counts, and odd tables."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from chimerascope.llm import line_dedup

SPACES = " \t\n\x0b\x0c\r"
UPPER = {c: c + 32 for c in range(65, 91)}


def plain(rows, length=40, least=5):
    key = lambda line: line.strip(SPACES).translate(UPPER)
    rank = lambda i: (i is not None, i or 0)
    held = defaultdict(list)
    for doc_id, text in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= length:
                held[k].append(doc_id)
    keeper = {k: max(ids, key=rank) for k, ids in held.items() if len(ids) >= least}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if keeper.get(key(line), doc_id) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def result(docs):
    return sorted(map(tuple, line_dedup.digest(docs).collect()), key=str)


def made(n, seed):
    rng = random.Random(seed)
    shared = [f"This is the shared line number {i}, É, of some length é" for i in range(30)] + ["x" * 39, "y" * 40, "é" * 40, "É" * 40]
    vary = lambda s: rng.choice([s, s.upper().replace("É", "é"), f"  {s}\t", f"{s}\r", f"\x0b{s}"])
    own = lambda: f"a line of its own with the number {rng.random()} in it"
    return [(i, "\n".join(vary(rng.choice(shared)) if rng.random() < 0.3 else own() for _ in range(rng.randrange(0, 12)))) for i in range(n)]


def test_filters_hold_every_hash_met_twice():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    filters = line_dedup.TwoFilters(8192)
    none = np.zeros(1000, bool)
    for start in range(0, 5000, 1000):
        filters.add(words[start : start + 1000], none)
    inside = lambda h: (filters.twice[(h & np.uint64(8191)).astype(int)] & line_dedup._masks(h)) == line_dedup._masks(h)
    assert inside(words).mean() < 0.01
    filters.add(np.r_[words[:10], words[20:30], words[20:30]], np.zeros(30, bool))
    filters.add(rng.integers(0, 2**62, 5).astype(np.uint64), np.ones(5, bool))
    assert inside(words[:10]).all() and inside(words[20:30]).all()
    assert inside(words[100:]).mean() < 0.01


@pytest.mark.parametrize(("held", "broadcast", "part"), [(1 << 20, 1 << 20, 1 << 16), (3, 0, 4)])
def test_against_plain_counts(spark, monkeypatch, held, broadcast, part):
    monkeypatch.setattr(line_dedup, "HELD", held)
    monkeypatch.setattr(line_dedup, "BROADCAST_WORDS", broadcast)
    monkeypatch.setattr(line_dedup, "SLICE_WORDS", part)
    rows = made(120, held)
    want = plain(rows)
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == want
    assert sum(w[2] for w in want) > 50


def test_nulls_repeats_and_empty_texts(spark):
    line = "a line that is long enough to count as one, surely"
    rows = [(1, line), (1, line), (2, f"{line}\n{line.upper()} \nshort\nshort"), (3, line), (None, line), (None, None), (4, ""), (5, None), (6, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(docs) == plain(rows)
    twice = [(1, line)] * 3 + [(9, line)] * 2
    assert result(spark.createDataFrame(twice, "doc_id long, text string")) == plain(twice)
    nobody = [(None, line)] * 6
    assert [r[2] for r in result(spark.createDataFrame(nobody, "doc_id long, text string"))] == [0] * 6
    assert result(docs.limit(0)) == []


def test_lines_go_from_texts_and_other_columns_stay(spark):
    line = "a line that is long enough to count as one, surely"
    docs = spark.createDataFrame([(i, f"first {i}\n {line}\nlast", "k", 1, i) for i in range(6)], "doc_id long, text string, lines string, key int, `a.b` int")
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == ["doc_id", "text", "lines", "key", "a.b", "lines_"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[5]["text"] == f"first 5\n {line}\nlast" and rows[5]["lines_"] == (3, 0)
    assert all(rows[i]["text"] == f"first {i}\nlast" and rows[i]["lines_"] == (3, 1) and rows[i]["a.b"] == i for i in range(5))
    assert {r["lines_"]["n_dropped"] for r in line_dedup.drop_repeated_lines(docs, min_documents=7).collect()} == {0}
    assert {r["lines_"]["n_dropped"] for r in line_dedup.drop_repeated_lines(docs, min_length=60).collect()} == {0}


def test_a_text_of_many_lines(spark):
    line = "the same long line that every one of these documents has"
    text = "\n".join(f"{line} {i % 50_000}" for i in range(100_000))
    rows = [(i, text) for i in range(5)]
    assert [r[1:3] for r in result(spark.createDataFrame(rows, "doc_id long, text string"))] == [(100_000, 100_000)] * 4 + [(100_000, 0)]
