"""Packing documents into token sequences along a space-filling curve.

A document's words are hashed into a signed vector, a fixed random projection brings it to a few
dimensions, each dimension is ranked against the normal distribution, and the Hilbert index of the cell
is the document's place on the curve: documents with common words lie close. The table is
range-sorted by this place, with ties broken by a hash so that a large group of copies spreads over many
tasks; the cuts between tasks come from a bounded sample. Every task packs its stretch of the curve: documents are cut wherever a sequence is full. The rest of a task's last sequence
becomes sequences at powers of two, so nothing is padded.

Null text is empty: such a document is its end id alone. A null doc_id sorts first and stays null; repeated
rows are packed once each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from usagelens.llm.common import importable, sampled_cuts, slices, word_hashes
from usagelens.llm.tokens import encoder, with_end

LENGTH = 1024
END = 0
#: Width of the hashed vector, dimensions of the curve and bits of each.
WIDTH, DIMENSIONS, BITS = 128, 4, 12

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates (the transpose method)."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(high, p, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t, q = np.zeros(len(x), np.int64), 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[:, i] >> b) & 1)
    return out


def curve_place(texts: pa.Array) -> np.ndarray:
    """Hilbert key of every text; a text without words lies in the middle of the cube."""
    words, bounds = word_hashes(texts)
    rows = np.repeat(np.arange(len(texts)), np.diff(bounds))
    sign = np.where(words >> np.uint64(63), 1.0, -1.0)
    flat = np.bincount(rows * WIDTH + (words % np.uint64(WIDTH)).astype(np.int64), sign, len(texts) * WIDTH)
    vector = flat.reshape(len(texts), WIDTH)
    vector /= np.maximum(np.sqrt((vector**2).sum(1, keepdims=True)), 1e-9)
    axes = np.random.default_rng(11).standard_normal((WIDTH, DIMENSIONS))
    share = (1 + np.vectorize(math.erf, otypes=[float])(vector @ axes / math.sqrt(2))) / 2 if len(texts) else np.zeros((0, DIMENSIONS))
    return hilbert(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def _places(text: pa.Array, tie: pa.Array) -> np.ndarray:
    """Order along the curve: the Hilbert key, then 15 bits of the tie, so copies spread."""
    batch = pa.record_batch([text], ["t"])
    keys = np.concatenate([np.zeros(0, np.int64), *(curve_place(x.column("t")) for x in slices(batch, "t"))])
    return (keys << 15) | (tie.to_numpy(zero_copy_only=False) & 0x7FFF)


@F.arrow_udf(T.LongType())
def _place(text: pa.Array, tie: pa.Array) -> pa.Array:
    return pa.array(_places(text, tie), pa.int64())


class _Packer:
    """Cuts a stream of documents into sequences; the last, unfinished one is kept back."""

    def __init__(self, length: int, first: int):
        self.length, self.sequence, self.filled, self.open = length, first, 0, []

    def add(self, doc: int | None, ids: np.ndarray) -> list[tuple]:
        done, at = [], 0
        while at < len(ids):
            n = min(self.length - self.filled, len(ids) - at)
            self.open.append((doc, at, ids[at : at + n], len(ids), self.sequence, self.filled))
            at, self.filled = at + n, self.filled + n
            if self.filled == self.length:
                done += self.open
                self.open, self.filled, self.sequence = [], 0, self.sequence + 1
        return done

    def rest(self) -> list[tuple]:
        """The unfinished sequence as sequences at powers of two, the largest first."""
        left, pieces, self.open = self.filled, self.open, []
        sizes = [1 << b for b in range(self.length.bit_length(), -1, -1) if left >> b & 1]
        out = []
        for size in sizes:
            room = size
            while room:
                doc, at, ids, total, _, _ = pieces.pop(0)
                if len(ids) > room:
                    pieces.insert(0, (doc, at + room, ids[room:], total, 0, 0))
                    ids = ids[:room]
                out.append((doc, at, ids, total, self.sequence, size - room))
                room -= len(ids)
            self.sequence += 1
        return out


def _rows(pieces: list[tuple], with_ids: bool) -> pa.RecordBatch:
    doc, at, ids, total, sequence, offset = zip(*pieces, strict=True)
    data = [x.astype("<u4").tobytes() for x in ids]
    columns = {
        "doc_id": pa.array(doc, pa.int64()), "start": pa.array(at, pa.int64()), "length": pa.array([len(x) for x in ids], pa.int64()),
        "ids_crc32": pa.array([zlib.crc32(x) for x in data], pa.int64()), "doc_tokens": pa.array(total, pa.int64()),
        "sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64()),
    }
    if with_ids:
        columns["ids"] = pa.array(data, pa.binary())
    return pa.RecordBatch.from_pydict(columns)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row per piece of a document: its place in the document and in its sequence, and with_ids
    the ids themselves (little-endian unsigned 32-bit)."""
    importable(docs.sparkSession)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, enc = _Packer(length, TaskContext.get().partitionId() << 40), encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = with_end(*enc.encode(pc.fill_null(part.column("text"), "").to_pylist()), end)
                done = []
                for doc, lo, hi in zip(part.column("doc_id").to_pylist(), bounds[:-1], bounds[1:], strict=True):
                    done += packer.add(doc, ids[lo:hi])
                if done:
                    yield _rows(done, with_ids)
        if rest := packer.rest():
            yield _rows(rest, with_ids)

    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("doc_id", "text"))
    cuts = np.array(sampled_cuts(placed.withColumn("weight", F.length("text")), tasks, key=_place("text", "tie")), np.int64)

    @F.arrow_udf(T.StructType([T.StructField("place", T.LongType()), T.StructField("stretch", T.IntegerType())]))
    def locate(text: pa.Array, tie: pa.Array) -> pa.Array:
        place = _places(text, tie)
        return pa.StructArray.from_arrays([pa.array(place, pa.int64()), pa.array(np.searchsorted(cuts, place), pa.int32())], ["place", "stretch"])

    at = placed.withColumn("at", locate("text", "tie")).select("doc_id", "text", "tie", "at.place", "at.stretch")
    along = at.repartitionById(tasks, "stretch").sortWithinPartitions("place", "doc_id", "tie").select("doc_id", "text")
    return along.mapInArrow(run, SCHEMA + (", ids binary" if with_ids else ""))
