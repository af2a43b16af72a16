"""Document quality by a generalised additive model with pairwise interactions.

Boosting goes round the features in turn and adds a shrunken tree of few leaves over the
bins of one feature each time, so that the model is a lookup table per feature; then it
goes on over the pairs of features with the most left to explain. Scoring looks up each
document's bins and adds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chimerascope.llm.shared import remainder, utf8_views, word_bounds, word_hashes

_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[[ord(c) for c in ".,;:'\"?!()-"]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True
FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "plain_marks", "symbols", "newlines", "non_ascii", "distinct_words",
    "top_word", "repeated_next", "symbol_end", "lone_symbol", "exclaimed", "distinct_pairs", "short_words", "long_words",
)


def features(raw: np.ndarray | None) -> np.ndarray:
    """Numbers that describe a whole text, in the order of FEATURES; zeros for null, empty and blank texts."""
    out = np.zeros(len(FEATURES))
    if raw is None or not len(raw):
        return out
    starts, ends = word_bounds(raw)
    if not len(starts):
        return out
    n, m = len(raw), len(starts)
    byte = np.bincount(raw, minlength=256)
    words, lengths = word_hashes(raw)
    kinds, counts = np.unique(words, return_counts=True)
    last = raw[ends - 1]
    pairs = words[1:] * np.uint64(0x9E3779B97F4A7C15) ^ words[:-1]
    out[:] = (
        np.log1p(n), np.log1p(m), lengths.mean(), byte[65:91].sum() / n, byte[48:58].sum() / n, byte[_PLAIN].sum() / n, byte[_SYMBOL].sum() / n,
        byte[10] / n, byte[128:].sum() / n, len(kinds) / m, counts.max() / m, (words[1:] == words[:-1]).mean() if m > 1 else 0, _SYMBOL[last].mean(),
        (_SYMBOL[last] & (lengths == 1)).mean(), (last == 33).mean(), len(np.unique(pairs)) / (m - 1) if m > 1 else 1, (lengths <= 3).mean(), (lengths >= 12).mean(),
    )
    return out


@dataclass
class AdditiveModel:
    """edges[f]: bin borders; tables[f]: a value per bin; pairs: ((f, g), grid over coarser bins)."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[tuple[int, int], np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], side="right")]
        for (f, g), grid in self.pairs:
            total += grid[np.searchsorted(self.coarse[f], x[:, f], side="right"), np.searchsorted(self.coarse[g], x[:, g], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _borders(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _newton(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return gradient / (weight + 1.0)


def _gain(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return gradient**2 / (weight + 1.0)


def _shallow_tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Values per bin of a tree of up to three leaves over ordered bins: the best cut, then the better second cut."""
    n = len(gradient)
    sums, mass = np.r_[0, np.cumsum(gradient)], np.r_[0, np.cumsum(weight)]
    cuts = [0, n]
    for _ in range(2):
        best, where = 1e-9, None
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if high - low < 2:
                continue
            at = np.arange(low + 1, high)
            gain = _gain(sums[at] - sums[low], mass[at] - mass[low]) + _gain(sums[high] - sums[at], mass[high] - mass[at]) - _gain(sums[high] - sums[low], mass[high] - mass[low])
            if gain.max() > best:
                best, where = gain.max(), int(at[gain.argmax()])
        if where is None:
            break
        cuts = sorted({*cuts, where})
    out = np.zeros(n)
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        out[low:high] = _newton(sums[high] - sums[low], mass[high] - mass[low])
    return out


def _quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values over a grid of the best pair of cuts, one on each axis."""
    g, w = np.zeros((2, *(n + 1 for n in gradient.shape)))
    g[1:, 1:], w[1:, 1:] = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    if min(gradient.shape) < 2:
        return 0.0, np.zeros(gradient.shape)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(1, gradient.shape[0]), np.arange(1, gradient.shape[1]), indexing="ij"))
    parts = lambda t: (t[i, j], t[i, -1] - t[i, j], t[-1, j] - t[i, j], t[-1, -1] - t[i, -1] - t[-1, j] + t[i, j])
    quarter, mass = parts(g), parts(w)
    gain = sum(_gain(a, b) for a, b in zip(quarter, mass, strict=True)) - _gain(g[-1, -1], w[-1, -1])
    k = int(gain.argmax())
    out, a, b = np.zeros(gradient.shape), i[k], j[k]
    out[:a, :b], out[:a, b:], out[a:, :b], out[a:, b:] = (float(_newton(q[k], m[k])) for q, m in zip(quarter, mass, strict=True))
    return float(gain[k]), out


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 32, coarse_bins: int = 8, rounds: int = 150, pair_count: int = 6, pair_rounds: int = 40, rate: float = 0.1) -> AdditiveModel:
    """Fit on rows x with labels y of 0 and 1. No rows, or one label only: a model that always gives the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    model.edges = [_borders(x[:, f], bins) for f in range(x.shape[1])]
    model.coarse = [_borders(x[:, f], coarse_bins) for f in range(x.shape[1])]
    place = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.coarse)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for f, at in enumerate(place):
            p = 1 / (1 + np.exp(-total))
            n = len(model.tables[f])
            step = rate * _shallow_tree(np.bincount(at, y - p, n), np.bincount(at, p * (1 - p), n))
            model.tables[f] += step
            total += step[at]
    sizes = [len(e) + 1 for e in model.coarse]

    def grid(f: int, g: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        at, shape = rough[f] * sizes[g] + rough[g], (sizes[f], sizes[g])
        return np.bincount(at, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(at, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((_quadrants(*grid(f, g))[0], f, g) for f in range(x.shape[1]) for g in range(f)), reverse=True)[:pair_count]
    chosen = {(f, g): np.zeros((sizes[f], sizes[g])) for _, f, g in ranked}
    for _ in range(pair_rounds):
        for (f, g), values in chosen.items():
            step = rate * _quadrants(*grid(f, g))[1]
            values += step
            total += step[rough[f], rough[g]]
    model.pairs = list(chosen.items())
    return model


def _batches(batches: Iterator[pa.RecordBatch], last) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([features(raw) for raw in utf8_views(batch.column(1))]).reshape(-1, len(FEATURES))
        yield last(batch.column(0), x)


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 10_000, held_out: tuple[int, int] = (4, 2)) -> AdditiveModel:
    """Fit on the labelled documents outside the held-out fold.

    The fit takes at most sample_rows labelled ids, those of the smallest hash of their
    id, and one text of each; only their features come to the driver. Of labels repeated
    for an id the largest counts, of texts the smallest. Labels other than 0 and 1, and
    null ids, are left out; without any label the model always gives one half.
    """
    n, fold = held_out
    usable = labels.filter(F.col("quality").isin(0, 1) & (remainder(F.col("doc_id"), n) != fold))
    one = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("double")).alias("y"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    marked = marked.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text")).select("y", "text")

    def run(batches):
        yield from _batches(batches, lambda y, x: pa.RecordBatch.from_arrays([y, pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"]))

    rows = marked.mapInArrow(run, "y double, x array<double>").toPandas()
    return fit(np.array(rows["x"].tolist(), dtype=float).reshape(-1, len(FEATURES)), rows["y"].to_numpy(dtype=float))


def score(docs: DataFrame, model: AdditiveModel, *, threshold: float = 0.7, held_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from threshold on).

    Every whole text is scored; null, empty and blank texts get the score of a text of no
    words. A null doc_id is never held out. Repeated rows give repeated result rows; other
    columns of docs are neither read nor returned. An empty table gives no rows.
    """

    def run(batches):
        yield from _batches(batches, lambda ids, x: pa.RecordBatch.from_arrays([ids, pa.array(model.score(x), pa.float64())], names=["doc_id", "score"]))

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    n, fold = held_out
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), n) == fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: AdditiveModel, *, threshold: float = 0.7) -> DataFrame:
    """Those rows of docs that the model doesn't reject, with all their columns, of any name.

    Rows are judged by their own whole text, repeated rows alike; a null, empty or blank
    text has the score of a text of no words. An empty table stays empty.
    """

    def judge(texts: pd.Series) -> pd.Series:
        x = [features(None if t is None else np.frombuffer(t.encode(), np.uint8)) for t in texts]
        return pd.Series(model.score(np.array(x).reshape(-1, len(FEATURES))))

    return docs.filter(F.pandas_udf(judge, "double")(F.col("text")) >= threshold)
