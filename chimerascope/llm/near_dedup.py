"""Near-duplicate groups by one-permutation MinHash with optimal densification.

Documents with equal shingle sets are one set from the start. Each set's hashes are split
by their top bits into bins and every bin keeps its smallest hash; an empty bin borrows
from a bin found by a fixed random probe sequence (optimal densification). Bands of bins
become bucket keys. Every bucket proposes a star: its most central set against each other
member. Proposed pairs are confirmed on the full sets, confirmed links become components.
A bucket whose members still lie in more than one component is settled by exact filters:
shingles that are rare among the bucket's family pair what shares them and bound what
doesn't, a parity bitmap bounds every pair from the other side, and further stars compare
what neither rules out, until no bucket is open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chimerascope.llm.shared import WORD, all_columns, scratch, shingle_set, unused_name, utf8_views

#: A shingle that so many sets of a family have at most is rare.
RARE = 100
#: A set's parity bitmap: so many words of 64 bits.
BIT_WORDS = 4
#: So many members of a bucket are compared with its hubs by one task.
SLICE_ROWS = 50_000
#: Hubs of an open bucket in the first round after the filters; so many times as many in each further one.
HUBS = 64
_BITS = [f"bits{i}" for i in range(BIT_WORDS)]


def _probes(bins: int) -> np.ndarray:
    """For each bin the order in which it looks for a filled bin."""
    rng = np.random.default_rng(7)
    return np.array([rng.permutation(bins) for _ in range(bins)])


def one_permutation(hashes: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """The densified sketch of a non-empty sorted hash set; one bin for each row of probes, a power of two."""
    bins = len(probes)
    place = (hashes >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    filled = np.zeros(bins, dtype=bool)
    filled[place[first]] = True
    sketch = np.zeros(bins, dtype=np.uint64)
    sketch[place[first]] = hashes[first]
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = probes[empty]
        donor = order[np.arange(len(empty)), filled[order].argmax(axis=1)]
        sketch[empty] = sketch[donor]
    return sketch


def _band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = sketch[: bands * rows].reshape(bands, rows)
    salt = np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    key = (grid * salt).sum(axis=1, dtype=np.uint64) ^ (np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def _parity(hashes: np.ndarray) -> np.ndarray:
    """For each bit of the bitmap whether an odd number of hashes fall on it. Two sets differ in at least as many hashes as their bitmaps in bits."""
    odd = np.bincount((hashes & np.uint64(64 * BIT_WORDS - 1)).astype(np.int64), minlength=64 * BIT_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def sketches(docs: DataFrame, *, shingle: int, bins: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, digest, keys, bits0, ...) of every document: set size, digest of the full set, the bucket key of each band, parity bitmap."""
    bands, probes = bins // rows, _probes(bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, keys, bits = [], [], [], []
            for raw in utf8_views(batch.column(1)):
                own = shingle_set(raw, shingle)
                sizes.append(len(own))
                digests.append(_digest(own))
                keys.append(_band_keys(one_permutation(own, probes), bands, rows) if len(own) else None)
                bits.append(_parity(own))
            words = np.array(bits).reshape(-1, BIT_WORDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), *map(pa.array, words.T)],
                names=["doc_id", "n_shingles", "digest", "keys", *_BITS],
            )

    return _id_and_text(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>, " + ", ".join(f"{b} long" for b in _BITS))


def _id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _member_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, members) for each row (node, digest, low) of wanted: its full shingle set, as bytes, from a text of a document whose id is low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(raw, shingle) for raw in utf8_views(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["digest", "members"])

    lows = wanted.select("low").distinct()
    texts = _id_and_text(docs).join(lows, F.col("doc_id").eqNullSafe(F.col("low")), "left_semi").select("text")
    found = texts.mapInArrow(run, "digest binary, members binary").join(wanted.select("node", "digest"), "digest")
    return found.groupBy("node").agg(F.first("members").alias("members"))


def _able(one: str, other: str, percent: int, *, bounded: bool = True) -> Column:
    """Whether two sets may be linked by their sizes, bitmaps and, if bounded, the shingles that each may share: columns n_shingles, bits0, ..., reach after a prefix."""
    n, m = F.col(f"{one}n_shingles"), F.col(f"{other}n_shingles")
    able = (n * 100 >= m * percent) & (m * 100 >= n * percent)
    apart = sum((F.bit_count(F.col(one + b).bitwiseXOR(F.col(other + b))) for b in _BITS), F.lit(0))
    able &= apart * (100 + percent) <= (n + m) * (100 - percent)
    if bounded:
        able &= F.least(f"{one}reach", f"{other}reach") * (100 + percent) >= (n + m) * percent
    return able


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    both = (
        pairs.join(sets.select(F.col("node").alias("b"), F.col("members").alias("set_b")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("members").alias("set_a")), "a")
        .select("a", "b", "set_a", "set_b")
    )

    def linked(one: np.ndarray, other: np.ndarray) -> bool:
        shared = len(np.intersect1d(one.view(np.uint64), other.view(np.uint64), assume_unique=True))
        return 100 * shared >= percent * ((len(one) + len(other)) // 8 - shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(x.copy(), y.copy()) for x, y in zip(utf8_views(batch.column(2)), utf8_views(batch.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _rare_shingles(sets: DataFrame, members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """What rare shingles tell of the members (bucket, node, component, n_shingles, bits) of open buckets.

    (node, rare): how many of a node's shingles at most RARE nodes of its family have; and
    pairs (a, b) of different components that share such a shingle. A family is what
    open buckets connect, so all pairs still to be judged lie within one.

    Two sets that share no rare shingle can't share more than either has of the others.
    Two linked sets that share one share one among the rarest shingles of each, as many as
    a linked set may lack and one more (prefix filtering); so only those are paired, and
    the pairs are at most RARE for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                own = [raw.view(np.int64) for raw in map(np.copy, utf8_views(part.column(1)))]
                nodes = np.repeat(part.column(0).to_numpy(), [len(x) for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.concatenate([np.empty(0, np.int64), *own]))], names=["node", "shingle"])

    first = members.groupBy("bucket").agg(F.min("node").alias("a"))
    families = components(members.join(first, "bucket").select("a", F.col("node").alias("b")).distinct()).withColumnRenamed("component", "family")
    spread = sets.join(families, "node", "left_semi").mapInArrow(run, "node long, shingle long").join(families, "node")
    counts = spread.groupBy("family", "shingle").agg(F.count("*").alias("nodes")).filter(F.col("nodes") <= RARE)
    place = F.row_number().over(Window.partitionBy("node").orderBy("nodes", "shingle"))
    rare = scratch(spread.join(counts, ["family", "shingle"]).withColumn("place", place).select("node", "family", "shingle", "nodes", "place"), "rare")
    bounds = rare.groupBy("node").agg(F.max("place").alias("rare"))
    known = members.select("node", "component", "n_shingles", *_BITS).distinct()
    prefix = rare.filter("nodes > 1").join(known, "node").filter(F.col("place") <= F.floor(F.col("n_shingles") * (100 - percent) / 100) + 1)
    prefix = scratch(prefix.drop("nodes", "place"), "rarest")
    one, other = (prefix.select("family", "shingle", *[F.col(c).alias(side + c) for c in ("node", "component", "n_shingles", *_BITS)]) for side in ("one_", "other_"))
    apart = (F.col("one_node") < F.col("other_node")) & (F.col("one_component") != F.col("other_component"))
    met = (one["family"] == other["family"]) & (one["shingle"] == other["shingle"]) & apart & _able("one_", "other_", percent, bounded=False)
    return bounds, one.join(other, met).select(F.col("one_node").alias("a"), F.col("other_node").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b): the smallest node that it reaches.

    Each round hangs every node below its smallest neighbour, if that is smaller, follows
    these parents to the roots of their trees, and goes on with the links between roots
    alone. So a round reads only what the last one left open, and in two rounds a root
    either takes in a neighbour or goes below a smaller one: the roots of a component
    that still have links at least halve. A step is a written table.
    """
    pairs = scratch(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    left, labels = pairs.filter("a < b"), None
    while not left.isEmpty():
        up = _roots(scratch(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "parents"))
        higher = left.join(up.select(F.col("node").alias("b"), F.col("parent").alias("root")), "b").filter("a != root").select("a", "root").distinct()
        ends = higher.join(up.withColumnRenamed("node", "a"), "a", "left").select(F.coalesce("parent", "a").alias("a"), F.col("root").alias("b")).filter("a != b")
        left = scratch(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        if labels is not None:
            below = labels.join(up.select(F.col("node").alias("component"), "parent"), "component", "left")
            up = scratch(up.union(below.select("node", F.coalesce("parent", "component"))), "labels")
        labels = up.withColumnRenamed("parent", "component")
    own = pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return own if labels is None else labels.union(own.join(labels, "node", "left_anti"))


def _roots(up: DataFrame) -> DataFrame:
    """up (node, parent), a forest without its roots, with each node's root for its parent: parents' parents by doubling."""
    while True:
        further = up.select(F.col("node").alias("parent"), F.col("parent").alias("further"))
        step = up.join(further, "parent", "left").select("node", F.coalesce("further", "parent").alias("parent"), F.col("further").isNotNull().alias("moved"))
        step = scratch(step, "parents")
        up = step.drop("moved")
        if step.filter("moved").isEmpty():
            return up


def _with_component(rows: DataFrame, groups: DataFrame, node: str, name: str) -> DataFrame:
    own = groups.select(F.col("node").alias(node), F.col("component").alias(name))
    return rows.join(own, node, "left").withColumn(name, F.coalesce(name, node))


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups with the components joined that new links connect; works on components, so it grows with the new links alone."""
    ends = _with_component(_with_component(links, groups, "a", "ca"), groups, "b", "cb")
    met = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("lower"))
    new = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(groups, "node", "left_anti")
    nodes = groups.union(new.select("node", F.col("node").alias("component")))
    return scratch(nodes.join(met, "component", "left").select("node", F.least("component", F.coalesce("lower", "component")).alias("component")), "groups")


def _open(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The bucket members rows, with their component, of those buckets whose members lie in several; and crowd, how many members a bucket has."""
    rows = _with_component(rows, groups, "node", "component")
    ends = (F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("crowd"))
    still = rows.groupBy("bucket").agg(*ends).filter("low < high").select("bucket", "crowd")
    return scratch(rows.join(still, "bucket"), "members")


def _reaching(rows: DataFrame, bounds: DataFrame, percent: int) -> DataFrame:
    """rows with reach, how many shingles a member may share with any that it hasn't been paired with, without those whose reach is too short even for the smallest set of their bucket."""
    reach = F.col("n_shingles") - F.coalesce("rare", F.lit(0))
    rows = rows.join(bounds, "node", "left").withColumn("reach", reach).drop("rare").filter(F.col("reach") * 100 >= F.col("n_shingles") * percent)
    rows = scratch(rows, "members")
    least = rows.groupBy("bucket").agg(F.min("n_shingles").alias("least"))
    return scratch(rows.join(least, "bucket").filter(F.col("reach") * (100 + percent) >= (F.col("n_shingles") + F.col("least")) * percent).drop("least"), "members")


def _outlying(left: DataFrame, hubs: int) -> DataFrame:
    """Up to hubs members of each bucket that lie outside its largest component, the most central first."""
    parts = left.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    largest = parts.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("near"), "node"))
    return left.join(largest, "bucket").filter("component != largest").withColumn("place", place).filter(F.col("place") <= hubs)


def _stars(members: DataFrame, hubs: DataFrame, able: Column) -> DataFrame:
    """Members with the hubs of their bucket, as able allows. A bucket's members (crowd of them) are dealt out in slices, and its hubs repeated for each."""
    slices = F.ceil(F.col("crowd") / SLICE_ROWS).cast("int")
    dealt = members.withColumn("slice", F.pmod(F.xxhash64("node"), slices).cast("int")).drop("crowd")
    repeated = hubs.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("crowd")
    return dealt.join(repeated, ["bucket", "slice"]).filter(able)


def distinct_sets(table: DataFrame) -> DataFrame:
    """One row for each digest of sketches: node (a number of its own), digest, low (the smallest doc_id that has it, null if none has one), n_shingles, keys, bits."""
    sketch = ["n_shingles", "keys", *_BITS]
    one = table.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("low"), F.first(F.struct(*sketch)).alias("s"))
    return scratch(one.select(F.monotonically_increasing_id().alias("node"), "digest", "low", "s.*"), "distinct-sets")


def link_sets(docs: DataFrame, distinct: DataFrame, groups: DataFrame, *, shingle: int, percent: int) -> DataFrame:
    """(node, component) of the sets of distinct that are linked with others, or in groups already.

    The first star of a bucket is that of its most central member, which shares the most
    buckets with others. Where a bucket stays open after the exact filters, the members
    outside its largest component become hubs, HUBS of them and then many more each
    round, against all members of other components that the filters leave; former hubs
    leave the bucket. It is closed when its members left lie in one component.
    """
    member = distinct.select("node", F.explode("keys").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("crowd")).filter("crowd > 1")
    left = scratch(member.join(shared, "bucket"), "members")
    met = left.groupBy("node").agg(F.sum("crowd").alias("near")).join(distinct.select("node", "n_shingles", *_BITS), "node")
    left = scratch(left.join(met, "node"), "members")
    sets = scratch(_member_sets(docs, distinct.join(left.select("node").distinct(), "node", "left_semi"), shingle), "sets")

    at = ["node", "n_shingles", *_BITS]
    hub = left.groupBy("bucket", "crowd").agg(F.max_by(F.struct(*at), F.struct("near", -F.col("node"))).alias("hub"))
    hub = hub.select("bucket", "crowd", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in at])
    stars = _stars(left, hub, (F.col("node") != F.col("hub_node")) & _able("", "hub_", percent, bounded=False))
    groups = _merged(groups, _judged(stars, sets, percent))
    left = _open(left.drop("crowd"), groups)
    if left.isEmpty():
        return groups

    bounds, pairs = _rare_shingles(sets, left, percent)
    groups = _merged(groups, scratch(_confirmed(scratch(pairs, "pairs"), sets, percent), "confirmed"))
    left, hubs = _open(_reaching(left.drop("component", "crowd"), bounds, percent), groups), HUBS
    while not left.isEmpty():
        hub = scratch(_outlying(left, hubs).select("bucket", "crowd", *[F.col(c).alias(f"hub_{c}") for c in (*at, "component", "reach")]), "hubs")
        stars = _stars(left, hub, (F.col("component") != F.col("hub_component")) & _able("", "hub_", percent))
        groups = _merged(groups, _judged(stars, sets, percent))
        was = hub.select("bucket", F.col("hub_node").alias("node"))
        left, hubs = _open(left.drop("component", "crowd").join(was, ["bucket", "node"], "left_anti"), groups), hubs * HUBS
    return groups


def _judged(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among stars of columns node and hub_node, each pair judged once."""
    pairs = stars.select(F.least("hub_node", "node").alias("a"), F.greatest("hub_node", "node").alias("b")).distinct()
    return scratch(_confirmed(scratch(pairs, "stars"), sets, percent), "confirmed")


def _no_groups(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame([], "node long, component long")


def _labelled(distinct: DataFrame, groups: DataFrame) -> DataFrame:
    """(digest, low, component) of every set; a set without links is a component of its own."""
    return _with_component(distinct.select("node", "digest", "low"), groups, "node", "component").drop("node")


def _tied(table: DataFrame, distinct: DataFrame) -> DataFrame:
    """(node, component) of sets that belong to one doc_id, where rows repeat an id with other texts."""
    rows = table.filter("doc_id is not null and digest is not null").select("doc_id", "digest")
    several = rows.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low < high").select("doc_id", "low")
    if (several := scratch(several, "several")).isEmpty():
        return _no_groups(table)
    node = lambda name, of: distinct.select(F.col("node").alias(name), F.col("digest").alias(of))
    ties = rows.join(several, "doc_id").select("low", "digest").distinct().join(node("a", "low"), "low").join(node("b", "digest"), "digest")
    return components(ties.select("a", "b"))


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, bins: int = 256, rows: int = 6) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Needs doc_id and text; other columns may be there and are left out. Rows that share a
    doc_id count as one document with several texts, and lie in one component; rows
    without a doc_id are documents of their own. component_id is null only where no
    document of the component has an id; kept is then true. Null, empty and blank texts
    have no shingles and are linked with nothing. Repeated rows give repeated result rows,
    and an empty table an empty result.

    With 256 bins in bands of 6, two sets of similarity 0.8 share no bucket with a
    chance of about 3 in a million.
    """
    table = scratch(sketches(docs, shingle=shingle, bins=bins, rows=rows), "sketches")
    distinct = distinct_sets(table)
    label = scratch(_labelled(distinct, link_sets(docs, distinct, _tied(table, distinct), shingle=shingle, percent=percent)), "labels")
    lowest = label.groupBy("component").agg(F.min("low").alias("component_id"))
    ids = label.join(lowest, "component").select("digest", "component_id")
    worded = table.filter("digest is not null").select("doc_id", "n_shingles", "digest").join(ids, "digest").select("doc_id", "n_shingles", "component_id")
    alone = table.filter("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return worded.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, bins: int = 256, rows: int = 6) -> DataFrame:
    """docs with one row of each group of near-duplicate texts, all columns as they are.

    Of a group the row with the smallest doc_id stays, a null id only where no other is
    there; of rows that share that id and the set of shingles, the one with the smallest
    text. Unlike texts under one id are judged each for itself. Rows without words, null
    texts too, all stay. An empty table stays empty; columns of any name are passed on.
    """
    table = scratch(sketches(docs, shingle=shingle, bins=bins, rows=rows), "sketches")
    distinct = distinct_sets(table)
    label = _labelled(distinct, link_sets(docs, distinct, _no_groups(docs), shingle=shingle, percent=percent))
    best = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "digest")).alias("w")
    of, low = unused_name(docs, "digest"), unused_name(docs, "low")
    winners = label.groupBy("component").agg(best).select(F.col("w.low").alias(low), F.col("w.digest").alias(of))

    @F.arrow_udf("binary")
    def digest_of(texts: pa.Array) -> pa.Array:
        return pa.array([_digest(shingle_set(raw, shingle)) for raw in utf8_views(texts)], pa.binary())

    text = F.col("text").cast("string")
    has_word = F.coalesce(text.rlike(WORD), F.lit(False))
    kept = docs.filter(has_word).withColumn(of, digest_of(text)).join(winners, of).filter(F.col("doc_id").cast("long").eqNullSafe(F.col(low)))
    one = kept.groupBy(of).agg(F.min_by(F.struct(*all_columns(docs)), text).alias("kept_row"))
    return one.select("kept_row.*").unionAll(docs.filter(~has_word))
