"""Neighbours with the production tables and probes where norms, table sizes or vector lengths are unusual."""

import numpy as np
import pytest

from chimerascope.llm import neighbours

SCHEMA = "vec_id long, embedding array<double>"


def table(spark, vectors):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], SCHEMA)


def unit(n, width=64, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def best(vectors, q, k=20):
    same = [i for i, v in enumerate(vectors) if len(v) == len(vectors[q]) and i != q]
    score = np.array([vectors[i] @ vectors[q] for i in same])
    return [same[j] for j in np.lexsort((same, -score))[:k]]


def found(spark, vectors):
    got = {q: [] for q in range(0, len(vectors), 20)}
    for r in neighbours.nearest(table(spark, vectors)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    return got


def recall(spark, vectors):
    got = found(spark, vectors)
    wanted = {q: best(vectors, q) for q in got}
    return sum(len(set(wanted[q]) & set(got[q])) for q in got) / sum(map(len, wanted.values()))


@pytest.fixture
def hashing(monkeypatch):
    """Holds what share of a table's vectors a query is compared with, for each length; from 1 on there is no hashing."""
    seen, measured = {}, neighbours._measured_share

    def spy(distinct, bands, k, tables, seed):
        out = neighbours.scratch(measured(distinct, bands, k, tables, seed), "shares")
        seen.update({r["n"]: r["share"] * tables for r in out.collect()})
        return out

    monkeypatch.setattr(neighbours, "_measured_share", spy)
    return seen


@pytest.mark.parametrize("name", ["outlier", "lognormal"])
def test_recall_where_norms_differ(spark, hashing, name):
    x = unit(2000)
    scale = np.ones(len(x)) if name == "outlier" else np.random.default_rng(4).lognormal(0, 0.5, len(x))
    scale[7] *= 10 if name == "outlier" else 1
    reached = recall(spark, x * scale[:, None])
    print(f"recall {name} {reached:.3f}")
    assert reached >= 0.9 and hashing[64] < 1


def clusters(n, width):
    own = np.random.default_rng(6).integers(0, n // 30, n)
    x = unit(n // 30, width)[own] + 0.03 * np.random.default_rng(7).normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize(("vectors", "most"), [(unit(500), 0.9), (unit(3000), 0.5), (unit(2000, 128), 0.9), (clusters(1500, 768), 0.5)], ids=["500x64", "3000x64", "2000x128", "1500x768"])
def test_recall_of_hashing_at_several_dimensions(spark, hashing, vectors, most):
    reached = recall(spark, vectors)
    print(f"recall {vectors.shape} {reached:.3f}, compared with {hashing}")
    assert reached >= 0.9 and 0 < hashing[vectors.shape[1]] < most


def test_random_directions_of_many_dimensions_are_compared_with_all(spark, hashing):
    x = unit(400, 768)
    assert recall(spark, x) == 1 and hashing[768] >= 1


def test_probes_reach_the_bucket_they_are_counted_for():
    signs = neighbours.rotations(2, 16, 5).reshape(2, 3, 16)
    x = unit(40, 16)
    for q, c in zip(x[:20], x[20:], strict=True):
        bucket = neighbours.best_buckets(c[None], signs, 1)[0, 0]
        order = neighbours.best_buckets(q[None], signs, 32 * 32)[0].tolist()
        assert len(set(order)) == 32 * 32 and neighbours.probes_to(q, c, signs) == order.index(bucket) + 1


def test_bands_hold_equal_norms_together(spark):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate([*unit(50), *(1e-30 * unit(2)), *(1e200 * unit(2)), *(1.2 * unit(2))])]
    got = [r["b"] for r in spark.createDataFrame(rows, SCHEMA).orderBy("vec_id").select(neighbours._band(neighbours.F.col("embedding")).alias("b")).collect()]
    assert set(got[:50]) == {0} and got[50] == got[51] < 0 < got[54] == got[55] < got[52] == got[53]


@pytest.mark.parametrize("n", [10, 21, 60])
def test_small_tables_give_every_neighbour(spark, n):
    x = unit(n)
    got = found(spark, x)
    print(f"found {n}: {[len(v) for v in got.values()]}")
    assert got == {q: best(x, q) for q in got}


def test_opposed_vectors_are_neighbours_too(spark, hashing):
    x = unit(25)
    x = np.concatenate([x, -np.tile(x[:1], (200, 1)) + 1e-3 * unit(200, seed=9)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = found(spark, x)
    print(f"opposed: {[len(v) for v in got.values()]}")
    assert all(len(v) == 20 for v in got.values()) and got[0] == best(x, 0)


def test_rows_of_other_lengths_keep_their_neighbours(spark):
    vectors = [*unit(100), *unit(1, 65), *unit(41, 33)]
    got = found(spark, vectors)
    print(f"lengths: {[len(v) for v in got.values()]}")
    assert got[100] == [] and all(len(v) == 20 for q, v in got.items() if q != 100)
    assert all(len(vectors[i]) == len(vectors[q]) for q, v in got.items() for i in v)


def test_lengths_are_hashed_apart(spark, hashing):
    vectors = [*unit(300), *unit(100, 33), 2 * unit(1, 65)[0], *unit(99, 65)]
    got = found(spark, vectors)
    assert all(len(v) == 20 for v in got.values())
    assert all(len(vectors[i]) == len(vectors[q]) for q, v in got.items() for i in v)
    for width in (33, 64, 65):
        own = [q for q in got if len(vectors[q]) == width]
        assert sum(len(set(got[q]) & set(best(vectors, q))) for q in own) >= 0.9 * 20 * len(own)
