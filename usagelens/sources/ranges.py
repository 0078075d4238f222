"""Log files by byte ranges: what a file has grown by is read, and nothing before it.

Spark's own readers take files whole, so the ranges are rows of a DataFrame and a task reads the ranges it is dealt. A line belongs to the
range in which it begins, and its number is the byte at which it begins, which orders the lines of a file and stays the same however
often the file grows and however it is cut. Files are opened by their URI, in any store that pyarrow's file systems reach.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from usagelens.session import importable

#: Bytes of a range.
RANGE = 64 << 20
#: Bytes read at once.
_BLOCK = 4 << 20
#: Bytes before the end of what is known of a file; if they changed, the file was written anew.
_MARK = 256


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path, modified_at, size of all matching files under `root`; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("modificationTime").cast("timestamp_ntz").alias("modified_at"), F.col("length").alias("size"))


def _open(uri: str):
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(urlparse(uri).path))
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _bytes(file, at: int, to: int) -> bytes:
    file.seek(at)
    return file.read(max(0, to - at))


def _mark(file, offset: int) -> str:
    return hashlib.md5(_bytes(file, max(0, offset - _MARK), offset)).hexdigest()


def _complete(file, start: int, size: int) -> int:
    """Where the last line that ends before `size` ends; `start` without any."""
    to = size
    while to > start:
        at = max(start, to - (64 << 10))
        found = _bytes(file, at, to).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        to = at
    return start


def whole_lines(path: str, size: int) -> int:
    """Where the last whole line of the first `size` bytes ends."""
    with _open(path) as file:
        return _complete(file, 0, size)


def settle(plan: DataFrame) -> DataFrame:
    """The plan (path, size, action, from_offset, mark; other columns stay) with `offset`, the end of the last whole line, and its
    `mark`. A file that grew but is not the old one in front is to be loaded whole."""
    importable(plan.sparkSession)
    schema = plan.withColumn("offset", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                with _open(r["path"]) as file:
                    if r["action"] == "append" and _mark(file, r["from_offset"]) != r["mark"]:
                        r["action"], r["from_offset"] = "reload", 0
                    r["offset"] = _complete(file, r["from_offset"], r["size"])
                    r["mark"] = _mark(file, r["offset"])
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*batch.schema, pa.field("offset", pa.int64())]))

    return plan.repartition(max(1, plan.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, schema)


def range_lines(path: str, first: int, start: int, end: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(byte, line) of the lines that begin in start..end. Reading began at `first`, where a line begins, and may go on to `stop`."""
    with _open(path) as file:
        # A range that does not begin where reading begins may be inside a line, which is another range's.
        at, rest = (start, b"") if start == first else (start - 1, None)
        line_at = at
        while at < stop:
            block = _bytes(file, at, min(stop, at + _BLOCK))
            if not block:
                break
            at += len(block)
            parts = block.split(b"\n")
            if rest is None:
                if len(parts) == 1:
                    line_at += len(block)
                    if line_at >= end:
                        return
                    continue
                line_at += len(parts[0]) + 1
                parts, rest = parts[1:], b""
            parts[0] = rest + parts[0]
            for line in parts[:-1]:
                if line_at >= end:
                    return
                yield line_at, line
                line_at += len(line) + 1
            rest = parts[-1]
            if line_at >= end:
                return
        if rest and line_at < end:
            yield line_at, rest


def read_ranges(files: DataFrame, wanted: tuple[str, ...] = (), size: int = RANGE) -> DataFrame:
    """value, source_file, line_no of the non-blank lines of `files` (path, from_offset, size), from from_offset on. With
    `wanted` only lines that hold one of these texts, which are looked for before anything is decoded."""
    importable(files.sparkSession)
    texts = [w.encode() for w in wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            return pa.RecordBatch.from_pydict({"value": pa.array(values, pa.string()), "source_file": pa.array([r["path"]] * len(values), pa.string()), "line_no": pa.array(numbers, pa.int64())})

        for batch in batches:
            for r in batch.to_pylist():
                values, numbers, held = [], [], 0
                for number, line in range_lines(r["path"], r["from_offset"], r["start"], r["end"], r["size"]):
                    if line.strip() and (not texts or any(t in line for t in texts)):
                        values.append(line.rstrip(b"\r").decode("utf-8", "replace"))
                        numbers.append(number)
                        held += len(line)
                        if held > _BLOCK:
                            yield made()
                            values, numbers, held = [], [], 0
                if values:
                    yield made()

    ranges = files.where("size > from_offset").selectExpr("path", "from_offset", "size", f"explode(sequence(from_offset, size - 1, {size}L)) AS start")
    ranges = ranges.withColumn("end", F.expr(f"least(start + {size}L, size)"))
    tasks = files.agg(F.sum(F.expr(f"greatest(size - from_offset, 0) div {size}L + 1"))).first()[0] or 1
    return ranges.repartition(int(min(tasks, 100_000))).mapInArrow(run, "value string, source_file string, line_no long")
