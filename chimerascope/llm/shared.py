"""Scratch tables and word hashing used by several operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITESPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_PLACE = _rng.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_PIECE = 1 << 18
_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. Where that is unset, a temporary one in local mode; on a cluster, an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and outlives any executor."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - at exit the JVM may be gone already
        pass


def all_columns(df: DataFrame) -> list[Column]:
    """The columns of df by name, whatever signs the names hold."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]


def unused_name(df: DataFrame, name: str) -> str:
    """name, with underscores behind it until no column of df has it, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string")) % n


def utf8_views(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The bytes of each string of an Arrow column, without copying; None for null."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from utf8_views(chunk)
        return
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield raw[ends[i] : ends[i + 1]] if valid[i] else None


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the whitespace-separated words of a byte array."""
    padded = np.ones(len(raw) + 2, dtype=bool)
    padded[1:-1] = _SPACE[raw]
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    return edges[0::2], edges[1::2]


def count_words(raw: np.ndarray | None) -> int:
    if raw is None or not len(raw):
        return 0
    inside = ~_SPACE[raw]
    return int(inside[0]) + int(np.count_nonzero(inside[1:] & ~inside[:-1]))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grown_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, _PIECE + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def _hash_piece(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = word_bounds(raw)
    power, inverse = _grown_powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[raw]] * power[: len(raw)], out=total[1:])
    return _mix((total[ends] - total[starts]) * inverse[starts]), ends - starts


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the byte length of each word of a text (A-Z lower-cased). Long texts go through in pieces cut at whitespace."""
    if len(raw) <= _PIECE:
        return _hash_piece(raw)
    out, start = [], 0
    while start < len(raw):
        stop = start + _PIECE
        while stop < len(raw):
            gap = np.flatnonzero(_SPACE[raw[stop : stop + _PIECE]])
            if len(gap):
                stop += int(gap[0])
                break
            stop += _PIECE
        out.append(_hash_piece(raw[start:stop]))
        start = stop
    return np.concatenate([h for h, _ in out]), np.concatenate([n for _, n in out])


def shingle_set(raw: np.ndarray | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles; one hash of the whole sequence where it has fewer words, none without words."""
    if raw is None or not len(raw):
        return np.empty(0, np.uint64)
    words, _ = word_hashes(raw)
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(k, n)
    total = np.full(n - width + 1, width, dtype=np.uint64)
    for j in range(width):
        total += words[j : n - width + 1 + j] * _PLACE[j]
    return np.unique(_mix(total))
