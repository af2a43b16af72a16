"""Near-duplicate groups: odd ids, families that aren't one component, and the filters."""

import random

import numpy as np
import pytest
from test_against_brute_force import components, sets_of

import corpus_pipeline
from chimerascope.llm import near_dedup
from chimerascope.llm.shared import shingle_set


def family(seed, n, words=90, edits=14, vocabulary=3000):
    """Texts with up to so many words of one base text replaced, dropped or added."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(edits)):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice(([], [f"w{rng.randrange(60)}"], [text[at], f"w{rng.randrange(60)}"]))
        out.append(" ".join(text))
    return out


def found(spark, rows, **settings):
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2, **settings).collect()
    return {r["doc_id"]: r["component_id"] for r in got}


@pytest.mark.parametrize(("rare", "hubs", "slice_rows"), [(100, 64, 50_000), (2, 3, 7)])
def test_families_that_fall_apart(spark, monkeypatch, rare, hubs, slice_rows):
    monkeypatch.setattr(near_dedup, "RARE", rare)
    monkeypatch.setattr(near_dedup, "HUBS", hubs)
    monkeypatch.setattr(near_dedup, "SLICE_ROWS", slice_rows)
    texts = [t for seed in range(3) for t in family(seed, 60)]
    rows = list(enumerate(texts))
    want = components(sets_of(dict(rows), 2))
    assert 3 < len(set(want.values())) < len(rows)
    assert found(spark, rows) == want


def test_no_filter_rules_a_link_out():
    texts = family(5, 60)
    sets = [shingle_set(np.frombuffer(t.encode(), np.uint8), 2) for t in texts]
    bits = [near_dedup._parity(s) for s in sets]
    for i, one in enumerate(sets):
        for j in range(i):
            apart = sum(int(x).bit_count() for x in (bits[i] ^ bits[j]).view(np.uint64))
            assert apart <= len(np.setxor1d(one, sets[j]))


def test_large_and_missing_ids(spark):
    one, two = family(1, 1)[0], family(2, 1)[0]
    big = 1 << 62
    rows = [(big + 5, one), (big + 9, one), (-7, two), (None, two), (None, "nobody has this text"), (None, "nobody has this text"), (None, None), ((1 << 63) - 1, two)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r["doc_id"], r["component_id"], r["kept"]) for r in got], key=str) == sorted(
        [(big + 5, big + 5, True), (big + 9, big + 5, False), (-7, -7, True), (None, -7, False), (None, None, True), (None, None, True), (None, None, True), ((1 << 63) - 1, -7, False)],
        key=str,
    )
    left = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r["doc_id"], r["text"]) for r in left], key=str) == sorted([(big + 5, one), (-7, two), (None, "nobody has this text"), (None, None)], key=str)


def test_rows_that_share_an_id(spark):
    x, y = family(1, 1)[0], family(2, 1)[0]
    rows = [(1, x), (5, x), (5, y), (9, y + " end")]
    assert set(found(spark, rows).values()) == {1}
    table = spark.createDataFrame([(*r, "n", "d", "w") for r in rows], "doc_id long, text string, low string, digest string, kept_row string")
    left = near_dedup.drop_near_duplicates(table)
    assert left.columns == table.columns
    assert sorted(tuple(r) for r in left.collect()) == [(1, x, "n", "d", "w"), (5, y, "n", "d", "w")]


def rows_joined(spark, run):
    """What run returns, and how many rows the joins of its queries by a column b gave."""

    def given(seen):
        store, total = spark._jsparkSession.sharedState().statusStore(), 0
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        queries = store.executionsList()
        for i in range(queries.size()):
            if (query := queries.apply(i).executionId()) not in seen:
                seen.add(query)
                values, nodes = store.executionMetrics(query), store.planGraph(query).allNodes()
                for node in map(nodes.apply, range(nodes.size())):
                    if "Join [b#" in node.desc():
                        metrics = map(node.metrics().apply, range(node.metrics().size()))
                        made = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
                        total += sum(int(x.get().replace(",", "")) for x in made if x.isDefined())
        return total

    given(seen := set())
    result = run()
    return result, given(seen)


def test_components_read_each_link_about_once(spark, monkeypatch):
    """A group of near copies, and a chain in no order: rows of joins grow with the links and not with the rounds, and rounds stay few."""
    rng = random.Random(1)
    copies = [(rng.randrange(300), rng.randrange(300)) for _ in range(1500)]
    chain = rng.sample(range(1000, 1200), 200)
    links = [*copies, *zip(chain, chain[1:], strict=False), (2000, 2000), (2001, 2000), (2001, 2000)]
    written, scratch = [], near_dedup.scratch
    monkeypatch.setattr(near_dedup, "scratch", lambda df, label: written.append(label) or scratch(df, label))
    table = spark.createDataFrame(links, "a long, b long")
    got, rows = rows_joined(spark, lambda: near_dedup.components(table).collect())
    sets = {x: {x} for link in links for x in link}
    for a, b in links:
        if sets[a] is not sets[b]:
            sets[a] |= sets[b]
            for x in sets[b]:
                sets[x] = sets[a]
    assert sorted(map(tuple, got)) == sorted((x, min(s)) for x, s in sets.items())
    assert len(links) // 2 < rows < 1.3 * len(links)
    assert len(written) < 40


def test_components_without_links(spark):
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert [tuple(r) for r in near_dedup.components(spark.createDataFrame([(3, 3)], "a long, b long")).collect()] == [(3, 3)]


def test_pipeline_stage_joins_written_links_once(spark, monkeypatch):
    """The pipeline's stage on families with open buckets: joins by b give no more rows than the tables of links and pairs hold."""
    rows = list(enumerate(t for seed in range(3) for t in family(seed, 60, edits=5)))
    written, scratch = [], near_dedup.scratch

    def counted(df, label):
        table = scratch(df, label)
        if label in ("links", "pairs", "stars", "confirmed"):
            written.append(table.count())
        return table

    monkeypatch.setattr(near_dedup, "scratch", counted)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got, joined = rows_joined(spark, lambda: corpus_pipeline.drop_copies(spark, table, "").collect())
    want = components(sets_of(dict(rows), 5))
    assert 3 < len(set(want.values())) < len(rows)
    assert sorted(tuple(r) for r in got) == sorted((i, t) for i, t in rows if want[i] == i)
    assert 0 < joined <= sum(written)
