"""Fill-in-the-middle rewriting of documents by a wavelet matrix over character classes.

Every byte of a batch of texts has a class: what kind of character it belongs to, and
whether a token ends with it. A wavelet matrix over the classes answers how often a class
occurs before a position; the ranks of the classes that end tokens add up to the number of
boundaries, those of continuation bytes to the difference of bytes and code points. A cut
after k tokens is found by bisection on those sums, for all texts of the batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chimerascope.llm.shared import all_columns, unused_name, utf8_views

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts share a wavelet matrix up to so many bytes; a longer text has one of its own.
BATCH_BYTES = 1 << 20
#: Kinds of characters; a byte's class is twice its kind, and one more where a token ends.
SPACE, LETTER, DIGIT, SIGN, LEAD, INNER = range(6)
_LEVELS = 4

_KIND = np.full(256, SIGN, np.uint8)
_KIND[[32, *range(9, 14)]] = SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[48:58] = DIGIT
_KIND[128:192] = INNER
_KIND[192:] = LEAD


class WaveletMatrix:
    """Rank queries over a sequence of small classes: a bit plane per bit, each ordered by the planes before it."""

    def __init__(self, classes: np.ndarray, levels: int = _LEVELS):
        self.planes: list[tuple[np.ndarray, np.ndarray, int]] = []
        for level in range(levels - 1, -1, -1):
            bit = (classes >> level & 1).astype(bool)
            packed = np.packbits(np.r_[bit, np.zeros(-len(bit) % 64 + 64, bool)], bitorder="little").view(np.uint64)
            before = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=before[1:])
            self.planes.append((packed, before, len(bit) - int(before[-1])))
            classes = np.concatenate([classes[~bit], classes[bit]])
        self.levels = levels

    def rank(self, kind: int, at: np.ndarray) -> np.ndarray:
        """How often the class occurs before each position."""
        start, stop = np.zeros_like(at), at
        for level, (packed, before, zeros) in zip(range(self.levels - 1, -1, -1), self.planes, strict=True):
            ones = [before[p >> 6] + np.bitwise_count(packed[p >> 6] & ((np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1))) for p in (start, stop)]
            start, stop = (zeros + ones[0], zeros + ones[1]) if kind >> level & 1 else (start - ones[0], stop - ones[1])
        return stop - start


class Tokens:
    """The token boundaries of texts laid end to end.

    A token is a run of whitespace with the word behind it; whitespace at the end of a text is
    a token too. So one ends with every byte of a word before whitespace or the end of its
    text, and with a text's last byte.
    """

    def __init__(self, texts: list[np.ndarray]):
        self.stops = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.starts = self.stops - [len(t) for t in texts]
        raw = np.concatenate([*texts, np.empty(0, np.uint8)])
        kinds = _KIND[raw]
        last = np.zeros(len(raw), bool)
        last[self.stops[self.stops > self.starts] - 1] = True
        follows = np.r_[kinds[1:] == SPACE, True] if len(raw) else np.empty(0, bool)
        self.matrix = WaveletMatrix(2 * kinds + (last | (kinds != SPACE) & follows))
        self.ending = [2 * k + 1 for k in np.unique(kinds)]

    def boundaries(self, at: np.ndarray) -> np.ndarray:
        """Token ends before each position."""
        return sum((self.matrix.rank(k, at) for k in self.ending), np.zeros_like(at))

    def counts(self) -> np.ndarray:
        return self.boundaries(self.stops) - self.boundaries(self.starts)

    def cuts(self, units: np.ndarray) -> np.ndarray:
        """Of each text, the position behind its first so many tokens: bisection on boundary counts."""
        want = self.boundaries(self.starts) + units
        low, high = self.starts.copy(), self.stops.copy()
        while (low < high).any():
            middle = (low + high) >> 1
            short = self.boundaries(middle) < want
            low, high = np.where(short & (low < high), middle + 1, low), np.where(short, high, np.minimum(high, middle))
        return low

    def code_points(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        inner = sum(self.matrix.rank(2 * INNER + end, at) * sign for end in (0, 1) for at, sign in ((stop, 1), (start, -1)))
        return stop - start - inner


def _groups(texts: list[np.ndarray]) -> Iterator[slice]:
    """Slices of consecutive texts of BATCH_BYTES together, or of one longer text."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if i > first and held + len(text) > BATCH_BYTES:
            yield slice(first, i)
            first, held = i, 0
        held += len(text)
    if first < len(texts):
        yield slice(first, len(texts))


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four groups of eight hexadecimal digits of the hash of seed and id, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, *, seed: int = 42, rate: int = 50, suffix_first: int = 80) -> DataFrame:
    """docs with text rearranged, and fim, a struct of n, form, prefix_chars and middle_chars.

    n counts a text's tokens. Both cuts, the form and whether a text is changed at all are
    drawn from the hash of seed and doc_id: rate percent are, and suffix_first percent of them
    put the suffix first (spm), the others the prefix (psm). A text that is null (then it
    becomes empty), empty or holds one of the marks stays plain. A null doc_id draws as an
    empty one; repeated rows come out alike; an empty table gives none. All other columns
    stay; where docs has a column fim already, the struct's name gets underscores behind it.
    """
    name = unused_name(docs, "fim")
    text, doc_id = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("long")
    columns = [c for c, n in zip(all_columns(docs), docs.columns, strict=True) if n != "text"]
    draws = _draws(doc_id, seed)
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | marked | (draws[2] % 100 >= rate), "plain").when(draws[3] % 100 < suffix_first, "spm").otherwise("psm")
    own = docs.select(F.struct(*columns).alias("row"), text.alias("text"), draws[0].alias("h1"), draws[1].alias("h2"), form.alias("form"))
    kind = T.StructType([own.schema["row"], T.StructField("out", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("n", "p", "m")), own.schema["form"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(utf8_views(batch.column(1)))
            for part in _groups(texts):
                yield _rearranged(batch.slice(part.start, part.stop - part.start), texts[part])

    out = own.mapInArrow(run, kind)
    result = F.struct("n", "form", F.col("p").alias("prefix_chars"), F.col("m").alias("middle_chars")).alias(name)
    kept = [F.col("row")[n].alias(n) if n != "text" else F.col("out").alias("text") for n in docs.columns]
    return out.select(*kept, result)


def _rearranged(batch: pa.RecordBatch, texts: list[np.ndarray]) -> pa.RecordBatch:
    tokens = Tokens(texts)
    n = tokens.counts()
    h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) % (n + 1) for i in (2, 3))
    one, two = tokens.cuts(np.minimum(h1, h2)), tokens.cuts(np.maximum(h1, h2))
    prefix, middle = tokens.code_points(tokens.starts, one), tokens.code_points(one, two)
    forms, out = batch.column(4).to_pylist(), []
    for i, raw in enumerate(texts):
        first, second = int(one[i] - tokens.starts[i]), int(two[i] - tokens.starts[i])
        pieces = (raw[:first].tobytes(), raw[first:second].tobytes(), raw[second:].tobytes())
        out.append(_joined(forms[i], *pieces) if forms[i] != "plain" else raw.tobytes())
    plain = np.array([f == "plain" for f in forms])
    arrays = [batch.column(0), pa.array(out, pa.binary()).cast(pa.string()), pa.array(n), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), batch.column(4)]
    return pa.RecordBatch.from_arrays(arrays, names=["row", "out", "n", "p", "m", "form"])


def _joined(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    return s + suffix + p + prefix + m + middle if form == "spm" else p + prefix + s + suffix + m + middle


def restored(output: Column, form: Column) -> Column:
    """The text that an output of fill_in_middle was made from; no piece of a changed text holds a mark, so the marks tell the pieces apart."""
    pieces = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    one, two, last = (F.get(pieces, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, last, one)).otherwise(F.concat(one, last, two))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the hashes of output and rebuilt text of every document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    text, fim = F.col("text"), F.col("fim")
    return fill_in_middle(own).select(
        "doc_id", fim["n"].alias("n"), fim["form"].alias("form"), fim["prefix_chars"].alias("prefix_chars"), fim["middle_chars"].alias("middle_chars"),
        F.sha2(text, 256).alias("output_sha256"), F.sha2(restored(text, fim["form"]), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, sha256('42:' || doc_id) AS h
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM cut
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), pieces AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM formed
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM pieces
"""
