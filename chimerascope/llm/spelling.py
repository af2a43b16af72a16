"""Grouping of spelling variants by a bit-sliced position index.

Words are near when one inserted, deleted or replaced code point makes them equal. An index
over a block of the vocabulary keeps, for each position and letter, the set of words with that
letter there, a bit a word. Reading a word letter by letter, four sets are carried along: words
equal so far, and words with one replacement, one letter less or one letter more, the last two
by the index of the neighbouring position. Each step takes a few operations on whole words
of 64 bits, for many words at a time.

So that no word meets the whole vocabulary, words are dealt into buckets first: if two words
are near and the shorter has m letters, they share their first m // 2 letters or their last
m - m // 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chimerascope.llm.shared import scratch

RUN = r"[A-Za-zÀ-ÿ]+"
MIN_LENGTH = 5
MIN_COUNT = 3
#: Small buckets share an index up to so many words; a bucket of more than PART words is cut into parts, each of which meets each.
BLOCK = 512
#: Fewer, where the words are long: a block has up to so many letters, counted by its longest word.
CELLS = 1 << 20
PART = 1 << 13
#: One of so many occurrences loses a letter, by the hash of document and run.
EVERY = 97
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = np.uint64(1)


def occurrences(docs: DataFrame, *, min_length: int = MIN_LENGTH, every: int = EVERY) -> DataFrame:
    """The words of all texts, an occurrence a row: maximal runs of letters, A-Z lower-cased, some with a letter deleted."""
    doc_id = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    runs = docs.select(doc_id.alias("doc_id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).filter(F.length("run") >= min_length)
    runs = runs.select("doc_id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    runs = runs.withColumn("hash", F.crc32(F.encode(F.concat("doc_id", F.lit(":"), "run"), "UTF-8")))
    place = (F.col("hash") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    return runs.select(F.when(F.col("hash") % every == 0, shorter).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= min_length)


def vocabulary(docs: DataFrame, *, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """word and n, the number of its occurrences, where there are min_count at least."""
    return occurrences(docs, min_length=min_length, every=every).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


class PositionIndex:
    """The words of a block by position and letter; codes: a row of code points a word, 0 behind its end."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.size = codes, len(codes)
        self.letters = np.unique(codes)
        self.rows = np.searchsorted(self.letters, codes)
        self.slot = np.arange(self.size) >> 6
        self.bit = _WORD << (np.arange(self.size, dtype=np.uint64) & np.uint64(63))
        self.words = (self.size + 63) >> 6

    def plane(self, position: int) -> np.ndarray:
        """For each letter, the set of words with it at the position; no word has any before the first."""
        out = np.zeros((len(self.letters), self.words), np.uint64)
        if 0 <= position < self.rows.shape[1]:
            np.bitwise_or.at(out, (self.rows[:, position], self.slot), self.bit)
        return out

    def of(self, chosen: np.ndarray) -> np.ndarray:
        """The set of words for which chosen holds."""
        out = np.zeros(self.words, np.uint64)
        np.bitwise_or.at(out, self.slot[chosen], self.bit[chosen])
        return out

    def near(self, queries: np.ndarray, lengths: np.ndarray, own: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) one error apart, with what they share.

        queries: rows of code points, longest first, with their lengths; own: lengths of the
        indexed words; half: after how many letters a query notes which words equal it so far.
        The sets noted come second.
        """
        alphabet = np.searchsorted(self.letters, queries)
        alphabet[alphabet == len(self.letters)] = 0
        known = self.letters[alphabet] == queries
        shape = (len(queries), self.words)
        equal = np.repeat(self.of(np.ones(self.size, bool))[None], len(queries), axis=0)
        replaced, shorter, longer = (np.zeros(shape, np.uint64) for _ in range(3))
        noted, found = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)
        behind, here, ahead = self.plane(-1), self.plane(0), self.plane(1)
        sizes = {n: self.of(own == n) for n in np.unique(own)}
        none = np.zeros(self.words, np.uint64)
        for i in range(int(lengths.max(initial=0)) + 1):
            at = half == i
            noted[at] = equal[at]
            for k in np.flatnonzero(lengths == i):
                found[k] = replaced[k] & sizes.get(i, none) | shorter[k] & sizes.get(i - 1, none) | (longer[k] | equal[k]) & sizes.get(i + 1, none)
            live = int(np.count_nonzero(lengths > i))
            if not live:
                break
            letter, seen = alphabet[:live, i], known[:live, i, None]
            match, before, after = (np.where(seen, p[letter], 0) for p in (here, behind, ahead))
            equal_, replaced_, shorter_, longer_ = (x[:live] for x in (equal, replaced, shorter, longer))
            longer[:live] = (longer_ | equal_) & after
            shorter[:live] = shorter_ & before | equal_
            replaced[:live] = replaced_ & match | equal_ & ~match
            equal[:live] = equal_ & match
            behind, here, ahead = here, ahead, self.plane(i + 2)
        return found, noted


def _matrix(words: list[str], width: int) -> np.ndarray:
    """A row of code points a word."""
    return np.array([w.ljust(width, "\0") for w in words], dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)


def _half(m: Column) -> Column:
    return F.floor(m / 2).cast("int")


def bucketed(words: DataFrame) -> DataFrame:
    """words, four times each, by what it would share with a near one: m (letters of the shorter), side, key.

    A bucket of more than PART words is cut into parts by a hash; its words come as queries
    of one part and as entries once for each, so that each pair of parts has its task.
    """
    m = F.col("m")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), _half(m)).alias("key")), F.struct(F.lit(1).alias("side"), F.expr("right(word, m - int(floor(m / 2)))").alias("key"))))
    rows = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m")).select("word", "n", "m", sides.alias("at")).select("word", "n", "m", "at.*")
    rows = scratch(rows, "spelling-buckets")
    large = scratch(rows.groupBy("m", "side", "key").agg(F.count("*").alias("size")).filter(F.col("size") > PART), "spelling-large")
    rows = rows.join(large, ["m", "side", "key"], "left").withColumn("parts", F.ceil(F.coalesce(F.col("size"), F.lit(1)) / PART).cast("int")).drop("size")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    whole = rows.filter(F.col("parts") == 1).select("*", F.lit(0).alias("index"), F.lit(0).alias("asked"), F.lit(2).alias("role"))
    split = rows.filter(F.col("parts") > 1).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    entries = split.select(*rows.columns, F.col("own").alias("index"), F.col("other").alias("asked"), F.lit(0).alias("role"))
    queries = split.select(*rows.columns, F.col("other").alias("index"), F.col("own").alias("asked"), F.lit(1).alias("role"))
    return whole.unionByName(entries).unionByName(queries).select("m", "side", "key", "index", "asked", "role", "word", "n")


def _near_of_block(rows: list[tuple]) -> tuple[list, list, list, list]:
    """Words of a block of whole buckets with a near one: word, how many, the most frequent near word and its n."""
    entries, queries = [r for r in rows if r[3] != 1], sorted((r for r in rows if r[3] != 0), key=lambda r: -len(r[4]))
    out: tuple[list, list, list, list] = ([], [], [], [])
    if not entries or not queries:
        return out
    width = max(len(r[4]) for r in rows)
    own = np.array([len(r[4]) for r in entries])
    index = PositionIndex(_matrix([r[4] for r in entries], width))
    bucket: dict[tuple, int] = {}
    place = np.array([bucket.setdefault(r[:3], len(bucket)) for r in entries])
    for start in range(0, len(queries), BLOCK):
        asked = queries[start : start + BLOCK]
        lengths = np.array([len(r[4]) for r in asked])
        m = np.array([r[0] for r in asked])
        found, noted = index.near(_matrix([r[4] for r in asked], width), lengths, own, m // 2)
        late = np.array([r[1] == 1 for r in asked])
        found[late] &= ~noted[late]
        bits = np.unpackbits(found.view(np.uint8), axis=1, count=index.size, bitorder="little")
        which, word = np.nonzero(bits)
        # A pair belongs to the bucket both lie in, with m letters in the shorter.
        home = np.array([bucket.get(r[:3], -1) for r in asked])
        true = (place[word] == home[which]) & (np.minimum(own[word], lengths[which]) == m[which])
        best: dict[int, tuple[int, int, str]] = {}
        for q, w in zip(which[true].tolist(), word[true].tolist(), strict=True):
            count, n, text = best.get(q, (0, 0, ""))
            near = entries[w]
            if near[5] > n or near[5] == n and near[4] < text:
                n, text = near[5], near[4]
            best[q] = (count + 1, n, text)
        for q, (count, n, text) in best.items():
            for column, value in zip(out, (asked[q][4], count, text, n), strict=True):
                column.append(value)
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and part; whole buckets go into a block until it is full."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        word, count, near, n = _near_of_block(rows)
        return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(count, pa.int64()), pa.array(near, pa.string()), pa.array(n, pa.int64())], names=["word", "n_near", "near", "near_n"])

    def m_of(bucket: list[tuple]) -> int:
        return bucket[0][0]

    block: list[tuple] = []
    bucket: list[tuple] = []
    current = None
    for batch in batches:
        for m, side, key, index, asked, role, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (m, side, key, index, asked) != current:
                # A bucket of one word has no pair.
                if len(bucket) > 1:
                    together = len(block) + len(bucket)
                    if block and (together > BLOCK or together * (m_of(bucket) + 1) > CELLS):
                        yield made(block)
                        block = []
                    block += bucket
                current, bucket = (m, side, key, index, asked), []
            bucket.append((m, side, f"{index}:{asked}:{key}", role, word, n))
    for last in (block, bucket):
        if len(last) > 1:
            yield made(last)


def near_words(words: DataFrame) -> DataFrame:
    """Of each word with a near one: word, n_near, near (the most frequent, ties by code point) and near_n."""
    keys = ["m", "side", "key", "index", "asked"]
    rows = bucketed(words).repartition(*keys).sortWithinPartitions(*keys)
    found = rows.mapInArrow(_run, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def roots(links: DataFrame) -> DataFrame:
    """word and root of links (word, form): forms are followed to their end by doubling, since each form's n is twice its word's at least."""
    known = links.select("word", F.col("form").alias("root"))
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        met = scratch(known.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        known = met.select("word", "root")
        if met.filter("moved").isEmpty():
            return known


def spelling_variants(docs: DataFrame, *, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, every: int = EVERY, ratio: int = 2) -> DataFrame:
    """One row per word of docs: word, form, root, n, n_near, form_n.

    Words are runs of letters of whole texts, A-Z lower-cased, of min_length code points or
    more and met min_count times or more; one occurrence in every has a letter deleted, drawn
    by document and run. form is the most frequent near word if it is ratio times as frequent
    at least, ties to the first by code point; root follows the forms to their end. A null
    doc_id draws as an empty one, null and empty texts have no words, repeated rows count
    one by one, and an empty table gives none. Columns besides doc_id and text aren't read.
    """
    words = scratch(vocabulary(docs, min_length=min_length, min_count=min_count, every=every), "vocabulary")
    formed = F.col("near_n") >= ratio * F.col("n")
    rows = words.join(near_words(words), "word", "left").select("word", F.when(formed, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("near_n")).alias("form_n"))
    rows = scratch(rows, "spelling-forms")
    return rows.join(roots(rows.filter(F.col("form").isNotNull())), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE steps AS (
  SELECT range AS i, range AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run
), coded AS (
  SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda s: CASE WHEN unicode(s) < 128 THEN [unicode(s)::BIGINT] ELSE [192 + (unicode(s)::BIGINT >> 6), 128 + (unicode(s)::BIGINT & 63)] END)) AS bytes FROM counted
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM coded, crc
), met AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM met WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), dels AS (
  SELECT word, n, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS del FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM dels a JOIN dels b ON a.i = b.i AND a.del = b.del AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM dels a JOIN words b ON a.del = b.word
  UNION SELECT b.word, a.word, a.n FROM dels a JOIN words b ON a.del = b.word
), ranked AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM pairs
), forms AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 2 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 2 * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
), chain AS (
  SELECT word, word AS root FROM forms
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
), ends AS (
  SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM forms JOIN ends USING (word)
"""
