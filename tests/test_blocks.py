"""Blocks of tables and the digests over them: against hashlib, and installs that copy only what differs."""

import hashlib
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from chimerascope.sources import blocks, lake as lakes
from chimerascope.sources.lake import Lake, Store, install, snapshot

from test_lake import built


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_root(rows, block_numbers):
    """Row texts with their block numbers, by hand: the digest of each block, and the root."""
    found = {}
    for block in set(block_numbers):
        mine = [sha(r) for r, b in zip(rows, block_numbers, strict=True) if b == block]
        leaves = {d[:3]: [] for d in mine}
        for digest in sorted(set(mine)):
            leaves[digest[:3]].append(f"{digest}:{mine.count(digest)}")
        found[block] = sha(",".join(f"{leaf}:{sha(','.join(lines))}" for leaf, lines in sorted(leaves.items())))
    level, width = found, blocks.MOST
    while width > 1:
        ups = {place // blocks.FAN_OUT for place in level}
        level = {up: sha(",".join(f"{p}:{d}" for p, d in sorted(level.items()) if p // blocks.FAN_OUT == up)) for up in ups}
        width = -(-width // blocks.FAN_OUT)
    return found, level.get(0, sha(""))


def test_digests_against_hashlib(spark):
    values = [(i % 700, None if i % 9 == 0 else f"t{i % 50}", (i * 7) % 200) for i in range(2000)]
    rows = spark.createDataFrame(values, f"a int, b string, {blocks.BLOCK} int")
    texts = [json.dumps({"a": a, "b": b}, separators=(",", ":")) for a, b, _ in values]
    found, root = plain_root(texts, [v[2] for v in values])
    for table in (rows, rows.repartition(7).select(blocks.BLOCK, "b", "a")):
        assert {r["block"]: r["digest"] for r in blocks.digests(table).collect()} == found and blocks.root(blocks.digests(table)) == root
    assert blocks.digests(rows).agg(F.sum("n")).first()[0] == 2000
    assert blocks.root(blocks.digests(rows.limit(0))) == sha("")


@pytest.mark.parametrize("change", [lambda r: r.withColumn("b", F.when(F.col("a") == 5, "x").otherwise(F.col("b"))), lambda r: r.filter("a != 5"), lambda r: r.union(r.filter("a = 5"))])
def test_a_change_shows_in_its_block_only(spark, change):
    rows = spark.range(300).select(F.col("id").alias("a"), F.lit("y").alias("b")).withColumn(blocks.BLOCK, F.expr("int(a % 40)"))
    expected = {r["block"]: r["digest"] for r in blocks.digests(rows).collect()}
    assert blocks.differing(rows, expected) == set() and blocks.differing(change(rows), expected) == {5}
    assert blocks.differing(change(rows), expected, [4, 5]) == {5} and blocks.differing(change(rows), expected, [4]) == set()
    assert blocks.differing(rows, {k: v for k, v in expected.items() if k != 7}) == {7}


def exported(spark, folder, monkeypatch):
    """An export of a lake whose tables have many blocks."""
    lake = built(spark, f"{folder}/lake")
    monkeypatch.setattr(blocks, "PER_BLOCK", 2)
    models = spark.range(60).select(F.concat(F.lit("ENST"), "id").alias("transcript_id"), F.lit("ready").alias("status"), F.lit("a").alias("name"))
    models.write.mode("overwrite").parquet(f"{lake.root}/models")
    lake.export(f"{folder}/export", revision=1)
    return f"{folder}/export"


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_only_damaged_blocks_are_copied_again(spark, tmp_path, monkeypatch):
    source = exported(spark, tmp_path, monkeypatch)
    there = f"{snapshot(f'{tmp_path}/put', 1)}/models"
    shutil.copytree(f"{source}/models", there)
    held = sorted(n for n in os.listdir(there) if n.startswith(blocks.BLOCK))
    assert len(held) > 15
    lost, changed = held[0], held[1]
    shutil.rmtree(f"{there}/{lost}")
    shutil.rmtree(f"{there}/{changed}")
    spark.createDataFrame([("ENST0", "error", "z")], "transcript_id string, status string, name string").write.parquet(f"{there}/{changed}")
    spark.createDataFrame([("ENSTX", "error", "z")], "transcript_id string, status string, name string").write.parquet(f"{there}/{blocks.BLOCK}=4000")
    before = {f for f in files(there) if lost not in f and changed not in f and "4000" not in f}
    put = install(spark, source, f"{tmp_path}/put")
    assert before <= files(there) and not os.path.exists(f"{there}/{blocks.BLOCK}=4000")
    assert put.models().exceptAll(Lake(spark, f"{tmp_path}/lake").models()).isEmpty() and put.models().count() == 60
    content = {r["name"]: r["content"] for r in spark.read.json(f"{source}/manifest").collect()}
    assert lakes._install_table(spark, source, "models", content["models"], there) == []


@pytest.mark.parametrize("what", ["block lost", "digests changed", "row changed"])
def test_a_damaged_export_is_refused(spark, tmp_path, monkeypatch, what):
    source = exported(spark, tmp_path, monkeypatch)
    block = next(n for n in sorted(os.listdir(f"{source}/models")) if n.startswith(blocks.BLOCK))
    if what == "digests changed":
        rows = spark.createDataFrame(spark.read.parquet(f"{source}/digests/models").collect()).withColumn("digest", F.sha2("digest", 256))
        rows.write.mode("overwrite").parquet(f"{source}/digests/models")
    else:
        shutil.rmtree(f"{source}/models/{block}")
    if what == "row changed":
        spark.createDataFrame([("ENST0", "ready", "z")], "transcript_id string, status string, name string").write.parquet(f"{source}/models/{block}")
    with pytest.raises(ValueError, match="models of .* changed"):
        install(spark, source, f"{tmp_path}/put")
    assert lakes.committed(Store(spark), f"{tmp_path}/put") == 0


def test_a_key_opens_one_block(spark, tmp_path, monkeypatch):
    put = install(spark, exported(spark, tmp_path, monkeypatch), f"{tmp_path}/put")
    for i in (0, 17, 59):
        rows = put.keyed("models", f"ENST{i}")
        assert [r["transcript_id"] for r in rows.collect()] == [f"ENST{i}"] and len(rows.inputFiles()) <= 60
        plan = rows._jdf.queryExecution().toString()
        assert "PartitionFilters: [isnotnull(content_block" in plan
    assert put.keyed("models", "ENST60").isEmpty() and put.entry("a") and blocks.BLOCK not in put.models().columns
    assert Lake(spark, f"{tmp_path}/lake").keyed("models", "ENST3").count() == 1, "a build has no blocks"


def test_an_empty_table_keeps_its_columns(spark, tmp_path):
    lake = built(spark, f"{tmp_path}/lake")
    lake.table("entries").limit(0).write.mode("overwrite").parquet(f"{tmp_path}/none")
    shutil.rmtree(f"{lake.root}/entries")
    shutil.copytree(f"{tmp_path}/none", f"{lake.root}/entries")
    lake.export(f"{tmp_path}/export", revision=1)
    for _ in range(2):
        put = install(spark, f"{tmp_path}/export", f"{tmp_path}/put", replace=True)
        assert put.table("entries").columns == ["interpro_id", "entry_type"] and put.entry("a") is None
