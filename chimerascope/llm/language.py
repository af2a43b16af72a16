"""Language identification by rank-order n-gram profiles.

A language's profile is the list of its most frequent letter n-grams (one to three
letters, word boundaries included). A document's own list is compared with each profile
by the out-of-place distance: the sum of the rank differences, with the length of the
list for an n-gram that the profile lacks. The nearest profile gives the language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chimerascope.llm.shared import remainder, scratch, utf8_views

PROFILE_LENGTH = 300
#: More languages than this are an error: the profiles, a few kB each, come to the driver and to every task.
MOST_LANGUAGES = 2_000
_PIECE = 1 << 20
_SPACE = re.compile(r"\s")
_EDGE = 0x5F


def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _pieces(text: str) -> Iterator[str]:
    """The text in parts that end before whitespace, so no word is cut however long the text."""
    start = 0
    while start < len(text):
        gap = _SPACE.search(text, start + _PIECE)
        stop = gap.start() if gap else len(text)
        yield text[start:stop]
        start = stop


def ngram_counts(text: str | None, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of one to three letters of a whole text; empty without letters."""
    codes, counts = [], []
    last = np.array([_EDGE])
    for piece in (*_pieces(text or ""), " "):
        points = np.frombuffer(piece.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        points = np.concatenate([last, np.where(letters[points], points, _EDGE)])
        points = points[np.r_[True, (points[1:] != _EDGE) | (points[:-1] != _EDGE)]]
        # The one or two points of the piece before only begin n-grams.
        new, two = points[len(last) :], points[len(last) - 1 : -1] << 21 | points[len(last) :]
        three = (points[:-2] << 21 | points[1:-1])[max(len(last) - 2, 0) :] << 21 | points[max(len(last), 2) :]
        for grams in (new[new != _EDGE], two | 1 << 62, three):
            kinds, n = np.unique(grams, return_counts=True)
            codes.append(kinds)
            counts.append(n)
        last = points[-2:]
    if not codes:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kinds, back = np.unique(np.concatenate(codes), return_inverse=True)
    return kinds, np.bincount(back, np.concatenate(counts)).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The length most frequent codes, ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:length]]


@dataclass
class Profiles:
    """codes ascend; ranks[i, l] is the rank of codes[i] in the list of languages[l], -1 where it isn't in it."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    length: int

    def predict(self, top: np.ndarray) -> tuple[str, float]:
        """Nearest language of a ranked list, and 1 minus its distance as a share of the largest distance."""
        if not len(top) or not self.languages:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        found = np.where((self.codes[at] == top)[:, None], self.ranks[at], -1)
        away = np.abs(found - np.arange(len(top))[:, None])
        distance = np.where(found < 0, self.length, away).sum(axis=0)
        best = int(distance.argmin())
        return self.languages[best], 1.0 - float(distance[best]) / (self.length * len(top))


def train(docs: DataFrame, *, per_language: int = 2_000, length: int = PROFILE_LENGTH, held_out: tuple[int, int] = (5, 0)) -> Profiles:
    """Profiles of the non-null languages of docs, learned outside the held-out fold.

    Each profile counts the whole texts of about per_language documents (all, where there
    are fewer), drawn by a hash of doc_id and text; equal ones count once. The document
    of the smallest hash is always drawn, so every language is learned. More than
    MOST_LANGUAGES values of lang are an error. An empty table, or one without languages,
    gives empty profiles.
    """
    n, fold = held_out
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").filter(F.col("lang").isNotNull() & (remainder(F.col("doc_id"), n) != fold))
    usable = usable.select("lang", "text", F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 53) - 1)).alias("hash"))
    shares = usable.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.approx_count_distinct("hash")).alias("share"), F.min("hash").alias("least"))
    shares = scratch(shares, "languages")
    if shares.count() > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    drawn = usable.join(F.broadcast(shares), "lang").filter((F.col("hash") < F.col("share") * F.lit(float(1 << 53))) | (F.col("hash") == F.col("least")))
    drawn = drawn.groupBy("lang", "hash").agg(F.min("text").alias("text"))
    letters = letter_table()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list] = {}
            for lang, raw in zip(batch.column(0).to_pylist(), utf8_views(batch.column(1)), strict=True):
                if raw is not None:
                    seen.setdefault(lang, []).append(ngram_counts(raw.tobytes().decode("utf-8", "replace"), letters))
            for lang, parts in seen.items():
                kinds, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                total = np.bincount(back, np.concatenate([m for _, m in parts]), len(kinds)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds), pa.string()), pa.array(kinds), pa.array(total)], names=["lang", "code", "n"])

    counted = scratch(drawn.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "ngrams")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code")) - 1
    rows = counted.withColumn("place", place).filter(F.col("place") < length).toPandas()
    languages = sorted(rows["lang"].unique())
    codes = np.unique(rows["code"].to_numpy(dtype=np.int64))
    ranks = np.full((len(codes), len(languages)), -1, dtype=np.int64)
    for lang, own in rows.groupby("lang"):
        ranks[np.searchsorted(codes, own["code"].to_numpy(dtype=np.int64)), languages.index(lang)] = own["place"].to_numpy()
    return Profiles(languages, codes, ranks, length)


def identify(docs: DataFrame, profiles: Profiles, *, held_out: tuple[int, int] = (5, 0)) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1).

    Whole texts count. A text that is null, empty or without any letter is "und" with
    score 0, and so is every text where no language could be learned. Equal distances go
    to the language first by code point. A null doc_id never is held out. Repeated rows
    give repeated result rows; an empty table gives none.
    """
    letters = letter_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for raw in utf8_views(batch.column(1)):
                text = None if raw is None else raw.tobytes().decode("utf-8", "replace")
                lang, score = profiles.predict(ranked(*ngram_counts(text, letters), profiles.length))
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    n, fold = held_out
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), n) == fold, F.lit(False)).alias("held_out"), "lang_pred", "score")
