"""Approximate nearest neighbours by cross-polytope hashing.

A fast pseudo-rotation, three rounds of random signs and a Hadamard transform, turns every
vector; its hash is the signed axis nearest to the turned vector. A bucket of a table is a
sequence of such hashes, each with a rotation of its own, and the more vectors there are,
the longer it is. In every table a query probes the buckets that it comes nearest to, by the sum of what each
axis falls short of the best. All vectors in those buckets are reranked by the exact inner
product in double precision.

Buckets follow directions, so vectors are hashed apart by bands of nearly equal norm, and a
query probes the buckets of every band. How many is measured: a few queries are compared
with all vectors, and the share of the buckets is the one that reaches nearly all of their
true neighbours. If all tables together would thus compare a query with more vectors than
there are, each is compared with all vectors once instead, block by block, which is exact;
so are queries whose probes reach too few vectors.

Equal vectors are indexed once, with the few smallest ids that can matter, and large
buckets are dealt out in blocks of bounded size, so neither a common vector nor a common
direction lands in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chimerascope.llm.shared import scratch

#: The most vectors of neighbouring buckets, a zone, that one task takes on either side.
BLOCK_ROWS = 8192
#: A table has so many buckets at least, and no more than so many vectors a bucket.
LEAST_BUCKETS, BUCKET_ROWS = 2048, 128
#: Probes are measured on up to so many queries of each length, to reach this share of their true neighbours.
MEASURED, REACHED = 64, 0.96
#: Norms within this factor lie in one band.
BAND = 1.1
#: A query's probes are chosen for so many sums of axes at a time.
SUMS = 1 << 22
#: A smaller set of vectors is dealt out in up to SPREAD blocks of SPREAD_ROWS when queries are compared with all of it.
SPREAD, SPREAD_ROWS = 64, 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    half = 1
    while half < width:
        pairs = x.reshape(n, -1, 2, half)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


def rotations(tables: int, width: int, seed: int) -> np.ndarray:
    """The random signs of each table's three rounds."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), size=(tables, 3, width))


def axis_scores(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """How near each turned row is to each signed axis: the turned coordinates, then their negatives."""
    for s in signs:
        x = hadamard(x * s)
    return np.concatenate([x, -x], axis=1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, n, v, k1, k2) of the vectors that take part: their length, and a 128-bit key of equal vectors."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).filter("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))
    return rows.select("vec_id", F.size("v").alias("n"), "v", *[F.xxhash64(F.lit(k), "v").alias(f"k{k}") for k in (1, 2)])


def _band(v: Column) -> Column:
    """The band of a vector's norm; of equal norms up to rounding, the middle of one."""
    largest = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    square = lambda most: F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / most) * (x / most))
    norm = F.get(F.transform(F.array(largest), lambda most: F.log(most) + 0.5 * F.log(square(most))), F.lit(0))
    return F.floor(norm / math.log(BAND) + 0.5).cast("int")


def hash_length(count: int, axes: int) -> int:
    """How many hashes make up a bucket."""
    length = 1
    while axes**length < max(LEAST_BUCKETS, count / BUCKET_ROWS):
        length += 1
    return length


def best_buckets(x: np.ndarray, signs: np.ndarray, probes: int) -> np.ndarray:
    """The buckets nearest to each row, the nearest first: codes of one axis for each rotation of signs.

    Each hash offers its best axes, more of them the more probes there are; sums beyond the
    number of probes are left out after each hash.
    """
    axes = 2 * x.shape[1]
    probes = min(probes, axes ** len(signs))
    offered = min(axes, probes if len(signs) == 1 else 4 + int(np.ceil(2 * probes ** (1 / len(signs))))) if probes > 1 else 1
    step = max(1, SUMS // (probes * offered))
    return np.concatenate([_best_of_part(x[i : i + step], signs, probes, offered) for i in range(0, len(x), step)])


def _best_of_part(x: np.ndarray, signs: np.ndarray, probes: int, offered: int) -> np.ndarray:
    short, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for rotation in signs:
        scores = axis_scores(x, rotation)
        axes = np.argsort(-scores, axis=1, kind="stable")[:, :offered] if offered > 1 else scores.argmax(axis=1)[:, None]
        found = np.take_along_axis(scores, axes, axis=1)
        short = (short[:, :, None] + (found[:, :1] - found)[:, None, :]).reshape(len(x), -1)
        code = (code[:, :, None] * scores.shape[1] + axes[:, None, :]).reshape(len(x), -1)
        best = np.argsort(short, axis=1, kind="stable")[:, :probes]
        short, code = np.take_along_axis(short, best, axis=1), np.take_along_axis(code, best, axis=1)
    return code


def probes_to(query: np.ndarray, other: np.ndarray, signs: np.ndarray) -> int:
    """How many buckets of a table a query has to probe to reach that of another vector."""
    lacks, own = [], 0.0
    for rotation in signs:
        asked, held = axis_scores(np.stack([query, other]), rotation)
        lack = asked.max() - asked
        own += float(lack[held.argmax()])
        lacks.append(lack)
    sums = np.zeros(1)
    for lack in lacks[:-1]:
        sums = (sums[:, None] + lack[None, :]).ravel()
        sums = sums[sums <= own]
    return max(1, int(np.searchsorted(np.sort(lacks[-1]), own - sums - 1e-12).sum()) + 1)


def zones(codes: np.ndarray, count: int, axes: int) -> np.ndarray:
    """Neighbouring buckets lie in one zone, in as many zones as hold about BLOCK_ROWS vectors each."""
    buckets = axes ** hash_length(count, axes)
    return codes // max(1, -(-buckets // -(-count // BLOCK_ROWS)))


def _padded(batches: Iterator[pd.DataFrame], tables: int, seed: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, int]]:
    """The rows of each length n and band, a few at a time, as points padded with zeros to a power of two, the rotations of each table, and the number of vectors of the band."""
    for batch in batches:
        for (n, _), whole in batch.groupby(["n", "band"]):
            width, count = 1 << (int(n) - 1).bit_length(), int(whole["count"].iloc[0])
            length = hash_length(count, 2 * width)
            signs = rotations(tables * length, width, seed).reshape(tables, length, 3, width)
            for start in range(0, len(whole), 512):
                part = whole.iloc[start : start + 512]
                x = np.zeros((len(part), width))
                x[:, :n] = np.stack(part["v"].to_numpy())
                yield part, x, signs, count


def _best(scored: DataFrame, most: int) -> DataFrame:
    """The most best c of each q of (n, q, c, score), of equal ones the smallest."""
    place = F.row_number().over(Window.partitionBy("n", "q").orderBy(F.desc("score"), "c"))
    return scored.groupBy("n", "q", "c").agg(F.max("score").alias("score")).withColumn("place", place).filter(F.col("place") <= most).drop("place")


def _compared(probe: DataFrame, index: DataFrame, most: int, blocks: Column) -> DataFrame:
    """(n, q, c, score) of the rows (n, band, table, zone, buckets, rep, v) of probe with the best of index (n, band, table, zone, bucket, rep, v) in those buckets; blocks: in how many the index rows of a zone are dealt. A row of probe that has a floor gets no lower scores."""
    probe = probe if "floor" in probe.columns else probe.withColumn("floor", F.lit(None).cast("double"))
    zone = ["n", "band", "table", "zone"]
    held, asking = index.groupBy(*zone).agg(blocks.cast("int").alias("blocks")), probe.groupBy(*zone).agg(_in_blocks(BLOCK_ROWS).cast("int").alias("parts"))
    grid = held.join(asking, zone)
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = index.join(grid, zone).withColumn("block", own("blocks")).withColumn("part", each("parts"))
    probe = probe.join(grid, zone).withColumn("part", own("parts")).withColumn("block", each("blocks"))

    def rerank(key: tuple, asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if not len(asking) or not len(held):
            return pd.DataFrame({"n": np.empty(0, np.int32), "q": found[0][0], "c": found[0][1], "score": found[0][2]})
        held = held.sort_values(["bucket", "rep"])
        bucket, reps, c = held["bucket"].to_numpy(), held["rep"].to_numpy(), np.stack(held["v"].to_numpy()).astype(np.float64)
        names, q = asking["rep"].to_numpy(), np.stack(asking["v"].to_numpy()).astype(np.float64)
        floor = asking["floor"].astype(float).fillna(-np.inf).to_numpy()
        asks = np.concatenate(asking["buckets"].to_numpy())
        by = np.repeat(np.arange(len(asking)), [len(b) for b in asking["buckets"]])
        order = np.argsort(asks, kind="stable")
        asks, by = asks[order], by[order]
        for one in np.intersect1d(asks, bucket):
            (low, high), (first, last) = np.searchsorted(bucket, (one, one + 1)), np.searchsorted(asks, (one, one + 1))
            for start in range(int(first), int(last), 256):
                rows = by[start : min(start + 256, last)]
                scores = np.einsum("qd,cd->qc", q[rows], c[low:high])
                top = np.argsort(-scores, axis=1, kind="stable")[:, :most]
                scores = np.take_along_axis(scores, top, axis=1)
                enough = (scores >= floor[rows][:, None]).ravel()
                found.append((np.repeat(names[rows], top.shape[1])[enough], reps[low + top].ravel()[enough], scores.ravel()[enough]))
        asked, near, score = (np.concatenate(part) for part in zip(*found, strict=True))
        order = np.lexsort((near, -score, asked))
        asked, near, score = asked[order], near[order], score[order]
        place = np.arange(len(asked)) - np.searchsorted(asked, asked)
        best = place < most
        return pd.DataFrame({"n": np.int32(key[0]), "q": asked[best], "c": near[best], "score": score[best]})

    key = [*zone, "block", "part"]
    asking, held = probe.select(*key, "buckets", "rep", "v", "floor").groupBy(*key), index.select(*key, "bucket", "rep", "v").groupBy(*key)
    return asking.cogroup(held).applyInPandas(rerank, "n int, q long, c long, score double")


def _in_blocks(rows: int) -> Column:
    return F.ceil(F.count("*") / rows)


def _against_all(asking: DataFrame, distinct: DataFrame, most: int) -> DataFrame:
    """(n, q, c, score) of the rows (n, rep, v) of asking with the best of all vectors of their length."""
    all_of = lambda df: df.select("n", F.lit(0).alias("band"), F.lit(0).alias("table"), F.lit(0).cast("long").alias("zone"), "rep", "v")
    blocks = F.greatest(_in_blocks(BLOCK_ROWS), F.least(_in_blocks(SPREAD_ROWS), F.lit(SPREAD)))
    return _compared(all_of(asking).withColumn("buckets", F.array(F.lit(0).cast("long"))), all_of(distinct).withColumn("bucket", F.lit(0).cast("long")), most, blocks)


def _measured_share(distinct: DataFrame, bands: DataFrame, k: int, tables: int, seed: int) -> DataFrame:
    """(n, share): the share of each table's buckets that queries of a length have to probe to reach REACHED of their true neighbours, from up to MEASURED queries."""
    asks = distinct.filter("asks").select("n", "rep", "v", F.xxhash64(F.lit(seed), "rep").bitwiseAND(F.lit((1 << 53) - 1)).alias("hash"))
    few = asks.join(asks.groupBy("n").agg(F.count("*").alias("asking")), "n").filter(F.col("hash") < 4.0 * MEASURED / F.col("asking") * float(1 << 53))
    few = few.withColumn("place", F.row_number().over(Window.partitionBy("n").orderBy("hash"))).filter(F.col("place") <= MEASURED)
    few = scratch(few.select("n", "rep", "v"), "measured-queries")
    true = scratch(_best(_against_all(few, distinct, k + 1), k + 1).filter("q != c").select("n", "q", "c"), "true-neighbours")
    pairs = true.join(few.select("n", F.col("rep").alias("q"), F.col("v").alias("asking")), ["n", "q"])
    pairs = pairs.join(distinct.select("n", F.col("rep").alias("c"), "band", "v"), ["n", "c"]).join(bands, ["n", "band"]).select("n", "band", "count", "asking", "v")

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x, signs, _ in _padded(batches, tables, seed):
            queries = np.zeros_like(x)
            queries[:, : len(part["asking"].iloc[0])] = np.stack(part["asking"].to_numpy())
            buckets = (2 * x.shape[1]) ** signs.shape[1]
            yield pd.DataFrame({"n": part["n"], "share": [min(probes_to(q, c, s) for s in signs) / buckets for q, c in zip(queries, x, strict=True)]})

    share = pairs.mapInPandas(shares, "n int, share double")
    return share.groupBy("n").agg(F.expr(f"percentile_disc({REACHED}) WITHIN GROUP (ORDER BY share)").alias("share"))


def nearest(vectors: DataFrame, *, k: int = 20, every: int = 20, tables: int = 24, probes: int | None = None, seed: int = 11) -> DataFrame:
    """The k nearest of every vector whose id is divisible by every: query_id, rank, vec_id, score.

    Nearness is the largest inner product on the original vectors; ties go to the smaller
    id, and a query never finds its own id. Vectors (vec_id, embedding) that are null,
    zero, empty, or hold null or non-finite components take no part, nor do null ids; a
    query finds fewer than k only where there are fewer.
    Repeated rows are found once. An empty table gives no rows; other columns are left
    out. Vectors are compared with those of their own length only.

    probes: buckets of each table that a query looks at in each band of norms. By default
    their share is measured, and lengths for which the tables would compare a query with more
    vectors than there are answer exactly.
    """
    rows = scratch(usable(vectors), "vectors")
    if rows.isEmpty():
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    by_id = Window.partitionBy("n", "k1", "k2").orderBy("vec_id")
    ids = rows.select("n", "vec_id", "k1", "k2").distinct().withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= k + 1)
    ids = scratch(ids.select("n", "k1", "k2", "vec_id"), "vector-ids")
    queries = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "n", "k1", "k2").distinct()
    distinct = rows.groupBy("n", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.first("v").alias("v"))
    distinct = distinct.join(queries.select("n", "k1", "k2").distinct().withColumn("asks", F.lit(True)), ["n", "k1", "k2"], "left")
    distinct = scratch(distinct.select("n", _band(F.col("v")).alias("band"), "rep", "k1", "k2", "v", F.coalesce("asks", F.lit(False)).alias("asks")), "distinct-vectors")

    there = ids.select("n", "vec_id").distinct().groupBy("n").agg(F.least(F.count("*"), F.lit(k + 1)).alias("there"))
    bands = scratch(distinct.groupBy("n", "band").agg(F.count("*").alias("count")), "bands")
    share = distinct.select("n").distinct().withColumn("share", F.lit(0.0)) if probes else _measured_share(distinct, bands, k, tables, seed)
    facts = scratch(there.join(share, "n", "left").select("n", "there", F.coalesce("share", F.lit(1.0)).alias("share")), "lengths").withColumn("exact", F.col("share") * tables >= 1)
    bands = bands.join(facts.filter("not exact").select("n", "share"), "n")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x, signs, count in _padded(batches, tables, seed):
            codes = np.concatenate([best_buckets(x, s, 1) for s in signs], axis=1)
            yield pd.DataFrame({"n": part["n"], "band": part["band"], "rep": part["rep"], "v": part["v"], "zones": list(zones(codes, count, 2 * x.shape[1])), "buckets": list(codes)})

    def asked(wanted: range):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part, x, signs, count in _padded(batches, tables, seed):
                share = float(part["share"].iloc[0])
                for table in wanted:
                    s = signs[table]
                    codes = best_buckets(x, s, probes or max(1, math.ceil(share * (2 * x.shape[1]) ** len(s))))
                    rows = pd.DataFrame({"i": np.repeat(np.arange(len(part)), codes.shape[1]), "zone": zones(codes, count, 2 * x.shape[1]).ravel(), "bucket": codes.ravel()})
                    grouped = rows.groupby(["i", "zone"])["bucket"].agg(list).reset_index()
                    own = part.iloc[grouped["i"]]
                    columns = {"zone": grouped["zone"].to_numpy(np.int64), "buckets": grouped["bucket"].to_numpy()}
                    yield pd.DataFrame({"n": own["n"].to_numpy(), "band": own["band"].to_numpy(), "rep": own["rep"].to_numpy(), "v": own["v"].to_numpy(), "table": np.int32(table), **columns})

        return run

    element = "float" if dict(rows.dtypes)["v"] == "array<float>" else "double"
    hashing = distinct.join(bands, ["n", "band"]).select("n", "band", "rep", "v", "count")
    index = hashing.mapInPandas(hashed, f"n int, band int, rep long, v array<{element}>, zones array<long>, buckets array<long>")
    both = F.posexplode(F.arrays_zip(F.col("zones").alias("zone"), F.col("buckets").alias("bucket"))).alias("table", "z")
    index = scratch(index.select("n", "band", "rep", "v", both).select("n", "band", "rep", "v", "table", "z.zone", "z.bucket"), "vector-index")
    asking = distinct.filter("asks").select("n", "rep", "v").join(bands, "n").select("n", "band", "rep", "v", "count", "share")
    probe = lambda wanted: asking.mapInPandas(asked(wanted), f"n int, band int, rep long, v array<{element}>, table int, zone long, buckets array<long>")
    # What the first table finds bounds what the others have to give, whatever the number of zones.
    first = scratch(_best(_compared(probe(range(1)), index.filter("table = 0"), k + 1, _in_blocks(BLOCK_ROWS)), k + 1), "found-first")
    floor = first.groupBy("n", F.col("q").alias("rep")).agg(F.count("*").alias("held"), F.min("score").alias("floor")).filter(F.col("held") > k).drop("held")
    rest = _compared(probe(range(1, tables)).join(floor, ["n", "rep"], "left"), index.filter("table > 0"), k + 1, _in_blocks(BLOCK_ROWS))
    found = scratch(_best(first.union(rest), k + 1), "found")

    names = distinct.select("n", "rep", "k1", "k2")
    members = ids.join(names, ["n", "k1", "k2"]).select("n", F.col("rep").alias("c"), "vec_id")
    reached = found.join(members, ["n", "c"]).groupBy("n", F.col("q").alias("rep")).agg(F.size(F.collect_set("vec_id")).alias("reached"))
    open_ = distinct.filter("asks").select("n", "rep", "v").join(facts, "n").join(reached, ["n", "rep"], "left")
    open_ = scratch(open_.filter(F.col("exact") | (F.coalesce("reached", F.lit(0)) < F.col("there"))).select("n", "rep", "v"), "open-queries")
    if not open_.isEmpty():
        found = scratch(_best(found.union(_against_all(open_, distinct, k + 1)), k + 1), "found")

    expanded = found.join(members, ["n", "c"]).withColumn("place", F.row_number().over(Window.partitionBy("n", "q").orderBy(F.desc("score"), "vec_id")))
    expanded = expanded.filter(F.col("place") <= k + 1).select("n", "q", "vec_id", "score")
    asked_by = queries.join(names, ["n", "k1", "k2"]).select("query_id", "n", F.col("rep").alias("q"))
    answers = asked_by.join(expanded, ["n", "q"]).filter("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
