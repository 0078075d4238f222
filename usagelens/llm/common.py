"""Helpers shared by the text operators."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space that ends a word: blank and U+0009 to U+000D.
SPACE = r"[\\x20\\x09-\\x0D]"

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def let(value: str, name: str, body: str) -> str:
    """SQL text that evaluates `value` once and uses it in `body` under `name`."""
    return f"transform(array({value}), {name} -> {body})[0]"


def with_row_key(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `__key`, equal only for rows of the same doc_id and text: such rows are one document,
    and every decision holds for all of them."""
    return df.withColumn("__key", F.expr(f"xxhash64(doc_id, {text}, {text} IS NULL)"))


@functools.lru_cache(maxsize=8)
def _ship(app: str) -> None:
    from pyspark import SparkContext

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="package-")
    made = shutil.make_archive(os.path.join(folder, "usagelens"), "zip", root, "usagelens")
    SparkContext._active_spark_context.addPyFile(made)


def importable(spark: SparkSession) -> None:
    """Sends this package to the executors unless their PYTHONPATH has it already."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        _ship(spark.sparkContext.applicationId)


def sampled_cuts(rows: DataFrame, tasks: int, sample: int = 4_000, key: Column | str = "key") -> list[int]:
    """Keys that cut `rows` (key, weight) into `tasks` stretches of about equal weight, from a sample of at
    most twice `sample` rows; a `key` that is yet to be computed is computed for those only. They only place
    the cuts between tasks."""
    key = F.col(key) if isinstance(key, str) else key
    share = min(1.0, sample / max(1, rows.count()))
    some = rows.sample(share, seed=5).select(key.alias("key"), "weight").limit(2 * sample)
    found = sorted((r["key"], (r["weight"] or 0) + 1) for r in some.collect())
    if not found:
        return []
    ends = np.cumsum([w for _, w in found])
    at = np.searchsorted(ends, ends[-1] * np.arange(1, tasks) / tasks)
    return [found[min(int(i), len(found) - 1)][0] for i in at]


# --- words as numpy arrays, used inside Arrow tasks ---------------------------------------------

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 bits (the finisher of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Row ranges of a batch with at most about `most` bytes of text (a longer text comes alone)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, lo = np.cumsum(size), 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows in one array, and each row's bounds in it; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if column.offset:
        column = pa.concat_arrays([column])
    _, ends, data = column.buffers()
    o = np.frombuffer(ends, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def word_bounds(raw: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; a word never spans rows."""
    inside = ~_IS_SPACE[raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = o[:-1] < o[1:]
    first[o[:-1][full]] = inside[o[:-1][full]]
    last[o[1:][full] - 1] = inside[o[1:][full] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of every row, and the bounds of each row's words.

    Works through blocks of about a megabyte, so memory follows the block, not the text.
    """
    raw, o = text_bytes(column)
    s, e = word_bounds(raw, o)
    out = np.empty(len(s), np.uint64)
    ends, lo = np.cumsum(e - s), 0
    power = np.ones(1, np.uint64)
    while lo < len(s):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _BLOCK, side="right")))
        size = e[lo:hi] - s[lo:hi]
        at = np.cumsum(size) - size
        inner = np.arange(int(size.sum())) - np.repeat(at, size)
        if len(power) <= (most := int(size.max())):
            power = np.cumprod(np.full(max(64, most + 1), _BASE, np.uint64))
        part = raw[np.repeat(s[lo:hi], size) + inner]
        value = _BYTE[_LOWER[part] if lower else part] * power[inner]
        out[lo:hi] = mix(np.add.reduceat(value, at) + size.astype(np.uint64) * _BASE)
        lo = hi
    return out, np.searchsorted(s, o)


_ODD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(words: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its five-word shingles; fewer words make one shingle."""
    n = len(words)
    run = np.zeros(max(0, n - 4), np.uint64)
    for j in range(5):
        run += words[j : n - 4 + j] * _ODD[j] if n >= 5 else np.uint64(0)
    run = mix(run)
    sets = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= 5:
            sets.append(np.unique(run[lo : hi - 4]))
        elif hi > lo:
            short = (words[lo:hi] * _ODD[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            sets.append(mix(np.array([short], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
