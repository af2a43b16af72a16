"""Removal of lines that many documents repeat, by two Bloom filters.

A first pass hashes every line key into the filter of hashes seen once and, where that had
the hash already, into the filter of hashes seen twice. Both are cut into slices of words, so
that each slice is filled in a task of its own from 8-byte hashes, each hash once a task. The
second pass tests every line against the second filter. Only lines that it may hold are
suspects; their keys are counted exactly, and only those move with a digest of their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chimerascope.llm.shared import all_columns, scratch, unused_name, utf8_views

MIN_LENGTH = 40
MIN_DOCUMENTS = 5
#: Words of 64 bits in a slice of the filters.
SLICE_WORDS = 1 << 16
#: A second filter of more words that hold anything, 16 bytes each, meets the lines in a shuffled join and isn't broadcast.
BROADCAST_WORDS = 1 << 20
#: A task keeps up to so many hashes to send each of them once.
HELD = 1 << 20
_BITS = 4
_SPACES = b" \t\n\x0b\x0c\r"


def line_digest(line: bytes, min_length: int) -> bytes | None:
    """SHA-256 of a line's key: the line without whitespace around it, A-Z in lower case. None for keys under min_length code points."""
    if len(line) < min_length:
        return None
    key = line.strip(_SPACES).lower()
    if len(key) < min_length or not key.isascii() and len(key.decode("utf-8", "replace")) < min_length:
        return None
    return hashlib.sha256(key).digest()


def _keys(raw: np.ndarray | None, min_length: int) -> set[bytes]:
    """The digests of a text's distinct keys."""
    if raw is None:
        return set()
    return {d for line in raw.tobytes().split(b"\n") if (d := line_digest(line, min_length))}


def _hashes(digests: list[bytes]) -> np.ndarray:
    """The first eight bytes of each digest, as a number."""
    return np.frombuffer(b"".join(d[:8] for d in digests), np.int64)


def _mask(hashed: Column) -> Column:
    """The bits that a hash sets in its word: one for each six bits from its top."""
    out = F.lit(0).cast("long")
    for i in range(_BITS):
        place = F.shiftrightunsigned(hashed, 58 - 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return out


def _masks(hashed: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashed), np.uint64)
    for i in range(_BITS):
        out |= np.uint64(1) << (hashed >> np.uint64(58 - 6 * i) & np.uint64(63))
    return out


def _once_a_task(min_length: int):
    """Distinct hashes of the keys that a task reads, HELD at a time, and whether several documents had them."""

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        kinds, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n > 1)], names=["hash", "again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for raw in utf8_views(batch.column(0)):
                held.append(_hashes([*_keys(raw, min_length)]))
                count += len(held[-1])
                if count >= HELD:
                    yield sent(held)
                    held, count = [], 0
        if count:
            yield sent(held)

    return run


class TwoFilters:
    """A slice of both filters: hashes seen once, and hashes seen twice."""

    def __init__(self, words: int):
        self.once = np.zeros(words, np.uint64)
        self.twice = np.zeros(words, np.uint64)

    def add(self, hashed: np.ndarray, again: np.ndarray) -> None:
        """Take in hashes one after another; again: met before by the sender."""
        place, mask = (hashed & np.uint64(len(self.once) - 1)).astype(np.int64), _masks(hashed)
        order = np.argsort(hashed, kind="stable")
        repeated = np.zeros(len(hashed), bool)
        repeated[order[1:]] = hashed[order[1:]] == hashed[order[:-1]]
        seen = again | repeated | (self.once[place] & mask == mask)
        np.bitwise_or.at(self.once, place, mask)
        np.bitwise_or.at(self.twice, place[seen], mask[seen])


def seen_twice(hashes: DataFrame, words: int) -> DataFrame:
    """The words of the second filter that hold anything: word (its number) and bits. hashes: hash and again."""
    part = min(words, SLICE_WORDS)

    def fill(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = TwoFilters(part)
        for batch in batches:
            filters.add(batch.column("hash").to_numpy().view(np.uint64), batch.column("again").to_numpy(zero_copy_only=False))
        held = np.flatnonzero(filters.twice)
        yield pa.RecordBatch.from_arrays([pa.array(held + key[0].as_py() * part), pa.array(filters.twice[held].view(np.int64))], names=["word", "bits"])

    sliced = hashes.withColumn("slice", F.floor(F.col("hash").bitwiseAND(F.lit(words - 1)) / F.lit(part)))
    return sliced.groupBy("slice").applyInArrow(fill, "word long, bits long")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def _keyed(min_length: int):
    """A row for each distinct key of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, of = [], []
            for i, raw in enumerate(utf8_views(batch.column(2))):
                own = _keys(raw, min_length)
                digests += own
                of += [i] * len(own)
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(digests, pa.binary()), pa.array(_hashes(digests))], names=["doc_id", "text_hash", "key", "hash"])

    return run


def suspects(docs: DataFrame, *, min_length: int = MIN_LENGTH) -> DataFrame:
    """The keys that documents may share: doc_id, text_hash and key, a SHA-256, once for each row of docs that has one.

    Every key of two rows or more is among them, and few others: the filters have a word of
    64 bits for each key they took in.
    """
    hashes = scratch(docs.select("text").mapInArrow(_once_a_task(min_length), "hash long, again boolean"), "line-hashes")
    words = 1 << max(hashes.count() - 1, 1).bit_length()
    twice = scratch(seen_twice(hashes, words), "seen-twice")
    twice = F.broadcast(twice) if twice.count() <= BROADCAST_WORDS else twice
    keys = _documents(docs).mapInArrow(_keyed(min_length), "doc_id long, text_hash long, key binary, hash long")
    mask = _mask(F.col("hash"))
    found = keys.withColumn("word", F.col("hash").bitwiseAND(F.lit(words - 1))).join(twice, "word").filter(F.col("bits").bitwiseAND(mask) == mask)
    return scratch(found.select("doc_id", "text_hash", "key"), "line-suspects")


def lost_keys(docs: DataFrame, *, min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The keys whose lines each document loses: doc_id, text_hash and lost, an array of SHA-256 digests."""
    found = suspects(docs, min_length=min_length)
    repeated = found.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_documents)
    repeated = scratch(repeated.select("key", "keeper"), "repeated-lines")
    lost = found.join(repeated, "key").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id", "text_hash").agg(F.collect_set("key").alias("lost"))


def drop_repeated_lines(docs: DataFrame, *, min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """docs with text left without its repeated lines, and lines, a struct of n_lines and n_dropped.

    A line's key is the line stripped of whitespace, A-Z lower-cased. Keys of at least
    min_length code points that at least min_documents rows of docs hold lose all their lines
    except in the rows of the largest doc_id that holds one. Each row is a document: repeated
    rows count one by one, and stay or lose lines alike. A null doc_id is smaller than any
    other; where only such rows hold a key, all keep it. A null text is one empty line, as an
    empty text is, and comes out empty. An empty table gives none. All other columns stay;
    where docs has a column lines already, the struct's name gets underscores behind it.
    """
    name = unused_name(docs, "lines")
    rest = F.struct(*[c for c, n in zip(all_columns(docs), docs.columns, strict=True) if n != "text"])
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), F.coalesce(F.col("text"), F.lit("")).alias("text"), rest.alias("row"))
    lost = lost_keys(docs, min_length=min_length, min_documents=min_documents)
    met = own.join(lost, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left").select("row", "text", "lost")
    kind = T.StructType([met.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, dropped = [], [], []
            for raw, lost in zip(utf8_views(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                lines = raw.tobytes().split(b"\n")
                gone = set(lost or ())
                kept = [line for line in lines if line_digest(line, min_length) not in gone] if gone else lines
                texts.append(b"\n".join(kept))
                counts.append(len(lines))
                dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names=["row", "text", "n_lines", "n_dropped"])

    out = met.mapInArrow(run, kind)
    kept = [F.col("row")[n].alias(n) if n != "text" else F.col("text") for n in docs.columns]
    return out.select(*kept, F.struct("n_lines", "n_dropped").alias(name))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the hash of what is left of every document."""
    out = drop_repeated_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return out.select("doc_id", F.col("lines")["n_lines"].alias("n_lines"), F.col("lines")["n_dropped"].alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), keyed AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT doc_id, pos, line, keeper IS NULL OR keeper = doc_id AS kept FROM keyed LEFT JOIN repeated USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT kept) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE kept), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
