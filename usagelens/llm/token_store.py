"""Token ids on disk as wavelet matrices, one per shard.

Documents are range-sorted by doc_id and cut into shards of about `SHARD` ids, always between
documents. A shard is one row of the written table: the ids as a wavelet matrix (one bit-plane per bit of
the vocabulary size, highest bit first, each plane's zeros before its ones in the next), a rank directory
with the number of ones before every 512 bits, and the bounds of the documents. Planes and directory are
compressed with zstd. From one shard come any id by position, the number of times an id occurs in a range, and
the places where it occurs; all of it without unpacking the sequence. Reading a whole shard back undoes
the planes from the last to the first.

Null text is empty: such a document is its end id alone. A null doc_id sorts first; repeated rows are
stored once each; other columns are ignored; an empty table gives no shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from usagelens.llm.common import importable, slices
from usagelens.llm.tokens import encoder, with_end
from usagelens.session import shared_dir

END = 2
#: Ids of a shard, more only to finish a document.
SHARD = 1 << 21
#: Bits between two entries of the rank directory.
STEP = 512

_SHARD_SCHEMA = "task long, shard long, n_ids long, bits int, planes binary, zeros array<long>, doc_ids array<long>, doc_ends array<long>"


class WaveletMatrix:
    """Rank, select and access over the bit-planes of one shard."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros
        # Ones before each block of STEP bits.
        self.directory = [np.concatenate([[0], np.cumsum(np.add.reduceat(np.bitwise_count(p).astype(np.int64), np.arange(0, len(p), STEP // 8)))]) if len(p) else np.zeros(1, np.int64) for p in planes]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros, now = [], [], ids.astype(np.uint16 if bits <= 16 else np.uint32)
        for b in range(bits - 1, -1, -1):
            one = (now & now.dtype.type(1 << b)).astype(bool)
            planes.append(np.packbits(one))
            if b:
                zero, more = now[~one], now[one]
                zeros.append(len(zero))
                now = np.concatenate([zero, more])
            else:
                zeros.append(len(now) - int(np.count_nonzero(one)))
        return cls(len(ids), planes, zeros)

    def to_bytes(self) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in self.planes))

    @classmethod
    def from_bytes(cls, data: bytes, n: int, zeros: list[int]) -> WaveletMatrix:
        raw, size = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, len(zeros) * ((n + 7) // 8))), np.uint8), (n + 7) // 8
        return cls(n, [raw[i * size : (i + 1) * size] for i in range(len(zeros))], zeros)

    def rank1(self, level: int, at: int) -> int:
        """Ones of a plane before position `at`."""
        plane, block = self.planes[level], at // STEP
        lo, whole, rest = block * STEP // 8, at // 8, at % 8
        inner = int(np.bitwise_count(plane[lo:whole]).sum())
        return int(self.directory[level][block]) + inner + (int(plane[whole] >> (8 - rest)).bit_count() if rest else 0)

    def access(self, at: int) -> int:
        value = 0
        for level, zeros in enumerate(self.zeros):
            one = self.planes[level][at // 8] >> (7 - at % 8) & 1
            before = self.rank1(level, at)
            at = zeros + before if one else at - before
            value = value << 1 | int(one)
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the ids of lo..hi that equal `token` lie below the last plane."""
        for level, zeros in enumerate(self.zeros):
            a, b = self.rank1(level, lo), self.rank1(level, hi)
            lo, hi = (zeros + a, zeros + b) if token >> (len(self.zeros) - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token in positions lo..hi."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, level: int, bit: int, nth: int) -> int:
        """Position of the nth (from 0) zero or one of a plane: the block by the directory, then inside it."""
        ones = self.directory[level]
        before = ones if bit else np.minimum(np.arange(len(ones)) * STEP, self.n) - ones
        block = int(np.searchsorted(before, nth, side="right")) - 1
        inside = np.unpackbits(self.planes[level][block * STEP // 8 : (block + 1) * STEP // 8])[: self.n - block * STEP]
        return block * STEP + int(np.flatnonzero(inside == bit)[nth - int(before[block])])

    def find(self, token: int) -> list[int]:
        """All positions of a token, ascending."""
        lo, hi = self._range(token, 0, self.n)
        out = []
        for at in range(lo, hi):
            for level in range(len(self.zeros) - 1, -1, -1):
                bit = token >> (len(self.zeros) - 1 - level) & 1
                at = self._select(level, bit, at - self.zeros[level] if bit else at)
            out.append(at)
        return sorted(out)

    def all(self) -> np.ndarray:
        """The whole sequence."""
        kind = np.uint16 if len(self.zeros) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(len(self.zeros) - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n).view(bool)
            bit = kind(1 << (len(self.zeros) - 1 - level))
            if level == len(self.zeros) - 1:
                now = one.astype(kind) * bit
                continue
            before = np.empty_like(now)
            before[~one] = now[: self.zeros[level]]
            before[one] = now[self.zeros[level] :] | bit
            now = before
        return now.astype(np.uint32)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end: int = END, shard: int = SHARD) -> None:
    """Encodes every text and writes the shards, in ascending doc_id order."""
    importable(docs.sparkSession)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        bits = max(1, (max(enc.size, end + 1) - 1).bit_length())
        held: list[np.ndarray] = []
        names: list = []
        sizes: list[int] = []

        def close() -> pa.RecordBatch:
            nonlocal held, names, sizes, number
            made = WaveletMatrix.build(np.concatenate(held), bits)
            row = {
                "task": pa.array([task], pa.int64()), "shard": pa.array([number], pa.int64()), "n_ids": pa.array([made.n], pa.int64()), "bits": pa.array([bits], pa.int32()),
                "planes": pa.array([made.to_bytes()], pa.binary()), "zeros": pa.array([made.zeros], pa.list_(pa.int64())),
                "doc_ids": pa.array([names], pa.list_(pa.int64())), "doc_ends": pa.array([np.cumsum(sizes).tolist()], pa.list_(pa.int64())),
            }
            held, names, sizes, number = [], [], [], number + 1
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids, bounds = with_end(*enc.encode(pc.fill_null(part.column("text"), "").to_pylist()), end)
                held.append(ids)
                names += part.column("doc_id").to_pylist()
                sizes += np.diff(bounds).tolist()
                if sum(map(len, held)) >= shard:
                    yield close()
        if names:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(tasks, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(run, _SHARD_SCHEMA).write.parquet(path)


def _shards(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for row in batch.to_pylist():
            yield row, WaveletMatrix.from_bytes(row["planes"], row["n_ids"], row["zeros"])


def _shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(task, shard, first): ids in all shards before. Only a row per task meets in one place."""
    shards = spark.read.parquet(path).select("task", "shard", "n_ids")
    total, tasks = 0, []
    for row in shards.groupBy("task").agg(F.sum("n_ids").alias("n")).orderBy("task").collect():
        tasks.append((row["task"], total))
        total += row["n"]
    bases = spark.createDataFrame(tasks, "task long, base long")
    inner = shards.selectExpr("task", "shard", "sum(n_ids) OVER (PARTITION BY task ORDER BY shard) - n_ids AS inner")
    return inner.join(F.broadcast(bases), "task").selectExpr("task", "shard", "base + inner AS first")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Every document as read back from the shards: doc_id, start, n_tokens, ids_crc32, and with_ids its ids."""
    importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, matrix in _shards(batches):
            ids, ends = matrix.all().astype("<u4"), np.array(row["doc_ends"], np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            data = [ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
            columns = {
                "doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(starts + row["first"], pa.int64()),
                "n_tokens": pa.array(ends - starts, pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in data], pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array(data, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    shards = spark.read.parquet(path).join(F.broadcast(_shard_starts(spark, path)), ["task", "shard"])
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(task, shard, n): how often a token occurs in each shard, by rank alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, matrix in _shards(batches):
            yield pa.RecordBatch.from_pydict({"task": pa.array([row["task"]], pa.int64()), "shard": pa.array([row["shard"]], pa.int64()), "n": pa.array([matrix.count(token)], pa.int64())})

    return spark.read.parquet(path).mapInArrow(run, "task long, shard long, n long")


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(doc_id, at): every occurrence of a token, as a position in its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, matrix in _shards(batches):
            at, ends = np.array(matrix.find(token), np.int64), np.array(row["doc_ends"], np.int64)
            doc = np.searchsorted(ends, at, side="right")
            names = pa.array(row["doc_ids"], pa.int64()).take(pa.array(doc))
            yield pa.RecordBatch.from_pydict({"doc_id": names, "at": pa.array(at - np.concatenate([[0], ends])[doc], pa.int64())})

    return spark.read.parquet(path).mapInArrow(run, "doc_id long, at long")


def store_and_read(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Writes the shards into the shared folder and returns what is read back from them, without the ids."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer, path, end)
    return read_tokens(spark, path, with_ids=False)
