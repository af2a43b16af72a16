"""Running values over blocks: one key on many tasks gives what a plain pass gives; FASTA by lines equals a plain parse."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chimerascope.operators import coverage
from chimerascope.operators.scan import BLOCK, in_blocks, with_before
from chimerascope.sources import fasta


def plain_runs(rows):
    out, last = {}, {}
    for k, i, t in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        run, kind = last.get(k, (0, object()))
        last[k] = (run + (kind != t), t)
        out[k, i] = last[k][0]
    return out


@pytest.mark.parametrize("keys", [1, 3, 200])
def test_runs_of_hot_and_cold_keys(spark, keys):
    rng = random.Random(keys)
    rows = [(None if (k := rng.randrange(keys)) == 1 else k, i, rng.choice(["a", "b", None])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, i int, t string")
    got = coverage.numbered_runs(df, ["k"], ["i"], "t", blocks=7)
    assert got.columns == ["k", "i", "t", "run"]
    assert {(r["k"], r["i"]): r["run"] for r in got.collect()} == plain_runs(rows)


@pytest.mark.parametrize("keys", [1, 50])
def test_coverage_of_hot_and_cold_keys(spark, keys):
    rng = random.Random(keys)
    rows = [(rng.randrange(keys), a := rng.randrange(5000), a + rng.choice([0, 3, 900 if rng.random() < 0.02 else 5])) for _ in range(1500)] * 2
    held = {}
    for k, a, b in rows:
        held.setdefault(k, set()).update(range(a, b + 1))
    got = coverage.covered_by_key(spark.createDataFrame(rows, "k int, a int, b int"), ["k"], "a", "b", blocks=9)
    assert {r["k"]: r["covered"] for r in got.collect()} == {k: len(v) for k, v in held.items()}


def test_one_key_lies_in_all_blocks_and_few_rows_are_carried(spark):
    rows = in_blocks(spark.range(10_000).select(F.lit(1).alias("k"), "id"), ["k"], ["id"], blocks=8)
    sizes = [r["count"] for r in rows.groupBy(BLOCK).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * min(sizes)
    out = with_before(rows, ["k"], ["id"], {"s": ("sum", F.col("id")), "m": ("max", -F.col("id")), "l": ("last", F.when(F.col("id") % 1000 == 0, F.col("id")))})
    got = {r["id"]: (r["s"], r["m"], r["l"]) for r in out.collect()}
    assert all(got[i] == (i * (i - 1) // 2, 0, (i - 1) // 1000 * 1000) for i in range(1, 10_000)) and got[0] == (None, None, None)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def plain_fasta(text):
    return [(r.split("\n", 1)[0].strip(), "".join(r.split("\n", 1)[1].split()).upper()) for r in text.split(">")[1:]]


def made(seed, n=40):
    rng = random.Random(seed)
    parts = []
    for i in range(n):
        bases = "".join(rng.choice("ACGTacgtN") for _ in range(rng.choice([1, 59, 60, 61, 500, 7000])))
        width = rng.choice([10, 60, 61, 10_000])
        end = rng.choice(["\n", "\r\n", " \n", "\n\n"])
        parts.append(f">s{i}.{seed} some text {end}" + "".join(bases[j : j + width] + end for j in range(0, len(bases), width)))
    return "".join(parts)


@pytest.mark.parametrize(("size", "split"), [(1, 1 << 20), (60, 9000), (1 << 20, 6000)])
def test_chunks_and_index_equal_a_plain_parse(spark, tmp_path, size, split):
    text = made(size, n=8 if size == 1 else 40)
    (tmp_path / "a.fa").write_text(text, newline="")
    (tmp_path / "b.fa").write_text(text.replace(">s", ">t"), newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = fasta.placed_lines(spark, str(tmp_path))
        assert split > 10_000 or lines.select("file", "record").filter("record > 0").count() > 0
        chunks = fasta.read_chunks(spark, str(tmp_path), "dna", size)
        index = {r["sequence_id"]: r for r in fasta.index(chunks).collect()}
        rows = chunks.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {h.split()[0]: (h, b) for h, b in plain_fasta(text) + plain_fasta(text.replace(">s", ">t"))}
    assert {k: (r["header"], r["length"], r["sha256"]) for k, r in index.items()} == {k: (h, len(b), hashlib.sha256(b.encode()).hexdigest()) for k, (h, b) in want.items()}
    cut = {(k, i + 1): b[i : i + size] for k, (_, b) in want.items() for i in range(0, len(b), size)}
    assert {(r["sequence_id"], r["chunk_start"]): r["bases"] for r in rows} == cut and len(rows) == len(cut)


def test_packed_files_peptides_and_malformed_text(spark, tmp_path):
    with gzip.open(tmp_path / "p.fa.gz", "wt") as f:
        f.write(">P1.2 x\nMK*\nLL\n>P2.1\nAAA\n")
    chunks = fasta.read_chunks(spark, f"{tmp_path}/p.fa.gz", "pep", 4)
    assert sorted((r["sequence_id"], r["stable_id"], r["chunk_start"], r["bases"]) for r in chunks.collect()) == [("P1.2", "P1", 1, "MK*L"), ("P1.2", "P1", 5, "L"), ("P2.1", "P2", 1, "AAA")]
    assert sorted(tuple(r) for r in fasta.whole(chunks).collect()) == [("P1.2", "P1", "MK*LL"), ("P2.1", "P2", "AAA")]
    for text, problem in (("ACGT\n>x\nAC\n", "before the first"), (">\nAC\n", "without an id"), (">x\nAC\n>x\nAC\n", "one id"), (">x\n\n>y\nAC\n", "Empty"), (">x\nA-C\n", "alphabet")):
        (tmp_path / "bad.fa").write_text(text)
        with pytest.raises(Exception, match=problem):
            fasta.index(fasta.read_chunks(spark, f"{tmp_path}/bad.fa", "dna")).collect()
