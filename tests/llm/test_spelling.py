"""Spelling variants: the index against edit distances, whole results against plain accounts, and odd tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from chimerascope.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, least=3, every=97):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= least}
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def vocabulary(size, seed, letters="abcdé"):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(size // 2)}
    for w in sorted(words):
        i = rng.randrange(len(w))
        words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :], w + "a"]))
    return sorted(w for w in words if len(w) >= 5)


def texts(words, n, seed):
    rng = random.Random(seed)
    weights = [1 / (1 + rng.randrange(len(words))) for _ in words]
    return [(i, " ".join(rng.choice([w, w.title() if w.isascii() else w]) for w in rng.choices(words, weights, k=300))) for i in range(n)]


def test_index_finds_all_words_one_error_away():
    words = vocabulary(150, 5)
    width = max(map(len, words)) + 2
    index = spelling.PositionIndex(spelling._matrix(words, width))
    queries = sorted([*words, "zzzzz", "abcdeabc"], key=len, reverse=True)
    lengths = np.array([len(q) for q in queries])
    found, noted = index.near(spelling._matrix(queries, width), lengths, np.array([len(w) for w in words]), np.full(len(queries), 2))
    bits = lambda sets: np.unpackbits(sets.view(np.uint8), axis=1, count=len(words), bitorder="little").astype(bool)
    for q, near, half in zip(queries, bits(found), bits(noted), strict=True):
        assert [w for w, x in zip(words, near, strict=True) if x] == [w for w in words if one_apart(q, w)]
        assert [w for w, x in zip(words, half, strict=True) if x] == [w for w in words if w[:2] == q[:2]]


@pytest.mark.parametrize(("block", "part", "cells"), [(512, 1 << 13, 1 << 20), (20, 3, 100)])
def test_against_a_plain_account(spark, monkeypatch, block, part, cells):
    for name, value in (("BLOCK", block), ("PART", part), ("CELLS", cells)):
        monkeypatch.setattr(spelling, name, value)
    rows = texts(vocabulary(160, block), 40, 2)
    got = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), every=7)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(rows, every=7)
    assert sorted(map(tuple, got.collect())) == want
    assert any(w[1] and w[2] != w[1] for w in want), "some chain is longer than one form"


def test_ties_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "house house hause hause houseb houseb " * 2), (1, "house house hause hause houseb houseb " * 2), (None, "mouse " * 20), (3, None), (4, ""), (5, "Ärger ärger Ärger ×÷×÷× " * 3), (6, "ab1cd_efghi-jklmn " * 4)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    assert sorted(map(tuple, spelling.spelling_variants(docs).collect())) == plain(rows)
    assert spelling.spelling_variants(docs.limit(0)).collect() == []
    assert spelling.spelling_variants(docs.filter("doc_id = 3")).collect() == []


def test_one_very_long_word(spark):
    long = "ab" * 50_000
    rows = [(i, f"{long} {long}c shorter") for i in range(4)]
    got = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == plain(rows)
