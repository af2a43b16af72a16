"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set. An item's sketch is its smallest
shingle hashes, so many that one of them must be in any document that contains the wanted
share of the item; each partition has its own sketch length. Hashes rank within classes
of how many items have the shingle, rare classes first, so that a phrase which opens all
items doesn't pair every document with each of them. In effect this is a prefix filter
over MinHash-ordered items, and it loses nothing. Only the short side is sketched:
documents are probed with all their shingle hashes, whole and however long, so that a
short item is found at any place. Candidates are verified on exact shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chimerascope.llm.shared import all_columns, scratch, unused_name

#: What separates words: ASCII characters other than letters and digits.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: A table of fixed-size rows is broadcast where a count and its row size come to so many bytes at most; others are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """Lower-cased words; punctuation and symbols separate them."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def shingle_hashes(tokens: Column, width: int) -> Column:
    """64-bit hashes of all runs of width words of an array column."""
    at = F.sequence(F.lit(0), F.size(tokens) - width)
    hashed = F.transform(at, lambda i: F.xxhash64(F.lit(width), *[F.get(tokens, i + j) for j in range(width)]))
    return F.when(F.size(tokens) >= width, hashed).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(tokens: Column, width: Column) -> Column:
    """The distinct runs of width words, as text."""
    at = F.sequence(F.lit(1), F.size(tokens) - width + 1)
    return F.when((width > 0) & (F.size(tokens) >= width), F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(tokens, i, width), " ")))).otherwise(
        F.array().cast("array<string>")
    )


def _small_or_not(df: DataFrame, row_bytes: Column) -> DataFrame:
    """df, to be broadcast if the measured bytes of its rows are BROADCAST_BYTES at most."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= BROADCAST_BYTES else df


def _digest(text: Column) -> Column:
    """16 bytes that stand for a text; null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256), 1, 32))


def sketch_items(benchmark: DataFrame, *, shingle: int, percent: int) -> DataFrame:
    """(item, width, shingles, sketch) of each distinct item text with words.

    width is shingle, or the number of words of a shorter item. A partition holds sizes of
    one power of two; its sketches are one longer than the shingles that an item of the
    largest size may lack, and so never miss.
    """
    items = benchmark.select(_digest(F.col("text")).alias("item"), "text").dropDuplicates(["item"]).select("item", words(F.col("text")).alias("tokens"))
    items = items.withColumn("width", F.least(F.lit(shingle), F.size("tokens"))).filter("width > 0")
    items = items.withColumn("shingles", shingle_texts(F.col("tokens"), F.col("width")))
    largest = F.pow(F.lit(2), F.floor(F.log2(F.size("shingles").cast("double"))) + 1).cast("long") - 1
    length = (largest * (100 - percent) / 100).cast("int") + 1
    hashes = F.transform("shingles", lambda s: _hash_of_text(s, F.col("width"), shingle))
    items = scratch(items.select("item", "width", "shingles", hashes.alias("hashes"), length.alias("length")), "item-shingles")
    spread = items.select("item", "length", F.explode("hashes").alias("hash"))
    held = spread.groupBy("hash").agg(F.floor(F.log2(F.count("*").cast("double"))).cast("int").alias("class"))
    sketch = spread.join(held, "hash").groupBy("item").agg(F.slice(F.sort_array(F.collect_list(F.struct("class", "hash"))), F.lit(1), F.max("length")).alias("sketch"))
    return items.join(sketch, "item").select("item", "width", "shingles", F.transform("sketch", lambda x: x["hash"]).alias("sketch"))


def _hash_of_text(text: Column, width: Column, widest: int) -> Column:
    parts = F.split(text, " ")
    chosen = F.xxhash64(F.lit(widest), *[F.get(parts, F.lit(j)) for j in range(widest)])
    for n in range(1, widest):
        chosen = F.when(width == n, F.xxhash64(F.lit(n), *[F.get(parts, F.lit(j)) for j in range(n)])).otherwise(chosen)
    return chosen


def _leaks(docs: DataFrame, benchmark: DataFrame, *, shingle: int, percent: int) -> tuple[DataFrame, str, DataFrame]:
    """docs with a key of their text, that column's name, and (key, item, n_item, n_shared) of each distinct text that contains an item."""
    items = scratch(sketch_items(benchmark, shingle=shingle, percent=percent), "items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    key = unused_name(docs, "text_key")
    keyed = docs.withColumn(key, _digest(F.col("text")))
    tokens = keyed.select(F.col(key).alias("key"), words(F.col("text")).alias("tokens"))
    hashes = F.concat(*[shingle_hashes(F.col("tokens"), w) for w in widths]) if widths else F.array().cast("array<bigint>")
    probes = tokens.select("key", F.explode(hashes).alias("hash"))
    sketch = _small_or_not(items.select("item", F.explode("sketch").alias("hash")), F.lit(64))
    pairs = scratch(probes.join(sketch, "hash").select("key", "item").distinct(), "candidates")
    wanted = _small_or_not(pairs.select("key").distinct(), F.lit(64))
    texts = keyed.select(F.col(key).alias("key"), "text").join(wanted, "key").dropDuplicates(["key"]).select("key", words(F.col("text")).alias("tokens"))
    whole = items.select("item", "width", "shingles")
    exact = pairs.join(texts, "key").join(_small_or_not(whole, 64 + F.aggregate("shingles", F.lit(0), lambda n, s: n + 64 + F.octet_length(s))), "item")
    shared = F.size(F.array_intersect("shingles", shingle_texts(F.col("tokens"), F.col("width"))))
    counted = exact.select("key", "item", F.size("shingles").cast("long").alias("n_item"), shared.cast("long").alias("n_shared"))
    return keyed, key, scratch(counted.filter(F.col("n_shared") * 100 >= F.col("n_item") * percent), "leaks")


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Documents that contain at least percent of an item's distinct shingles: doc_id, item_id, n_item, n_shared, containment.

    An item of fewer words than a shingle counts as one shingle of its words. Texts of null
    or without words contain nothing and are contained in nothing. Items of equal text are
    all reported, and so are all ids of an equal document text, a null id as null; repeated
    rows are reported once. Empty tables give no rows; other columns are left out.
    """
    keyed, key, leaks = _leaks(docs, benchmark, shingle=shingle, percent=percent)
    names = benchmark.select("item_id", _digest(F.col("text")).alias("item"))
    rows = keyed.select("doc_id", F.col(key).alias("key")).join(leaks, "key").join(names, "item")
    return rows.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_item", "n_shared")).alias("m")).select(
        "doc_id", "item_id", "m.n_item", "m.n_shared", "m.containment"
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose text contains a benchmark item.

    All columns, of any name, null texts and repeated rows stay; an empty benchmark drops
    nothing, and an empty table stays empty.
    """
    keyed, key, leaks = _leaks(docs, benchmark, shingle=shingle, percent=percent)
    gone = leaks.select(F.col("key").alias(key)).distinct()
    return keyed.join(_small_or_not(gone, F.lit(64)), key, "left_anti").select(*all_columns(docs))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(5, len(w)) AS k FROM b WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM bi),
ks AS (SELECT DISTINCT k FROM bi),
ds AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM d, ks WHERE len(w) >= k),
t AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM ds JOIN bs USING (k, s) JOIN t USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= n_item * 80
"""
