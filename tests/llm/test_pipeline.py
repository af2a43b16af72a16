"""The pipeline's stages on planted cases."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    good = [prose(rng.randint(60, 200)) for _ in range(80)]
    bad = [" | ".join(rng.choice(vocabulary) + "###" for _ in range(80)) for _ in range(30)]
    item = prose(30)
    extra = [good[0], good[1] + " one more end", good[2][:200] + " " + item + " " + good[2][200:], good[3] + " token = \"0123456789abcdef0123456789abcdef\""]
    texts = good[:3] + good[4:] + extra + bad
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < len(texts) - 30), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        out = f"{tmp_path}/out-{name}"
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    n = len(good) - 1
    assert set(kept["quality"]) == set(range(n + 4))
    assert set(kept["quality"]) - set(kept["near_dedup"]) == {n, n + 1}
    assert set(kept["near_dedup"]) - set(kept["decontaminate"]) == {n + 2}
    assert "[SECRET]" in kept["secrets"][n + 3] and "0123456789abcdef" not in kept["secrets"][n + 3]
    assert set(kept["mixing"]) <= set(kept["secrets"])
