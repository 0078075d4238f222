"""Log folders as a stream of lines: what files have grown by since the last batch.

Spark's file source takes a file once, when it appears; logs go on growing. This source keeps, per file, how far its whole lines were
read, so a batch is the new lines of all files, by byte ranges. A task reads one range of a large file or what many small ones grew by, so
tasks (and the files a batch writes) grow with the bytes and only slowly with the number of files. The offset holds a number per file. A file that shrank is
read from its start again; that its lines repeat is left to the deduplication. Register once per session:
`spark.dataSource.register(LogTail)`, then `spark.readStream.format("log_tail").option("root", folder).load()`.
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlparse

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from usagelens.sources import ranges


#: What opening a file counts as, in bytes, when ranges are put together to tasks.
_OPENING = 256 << 10


@dataclass
class Range:
    path: str
    first: int
    start: int
    end: int
    stop: int


@dataclass
class Ranges(InputPartition):
    """The ranges of one task."""

    ranges: list[Range]


def packed(found: list[Range], size: int, tasks: int) -> list[Ranges]:
    """Ranges put together to tasks of `size` bytes at most (a longer range stays alone), or less if that gives fewer than `tasks`."""
    weights = [r.end - r.start + _OPENING for r in found]
    room = min(size, -(-sum(weights) // max(1, tasks)))
    out, held = [], 0
    for r, weight in zip(found, weights, strict=True):
        if not out or held + weight > room:
            out.append(Ranges([]))
            held = 0
        out[-1].ranges.append(r)
        held += weight
    return out


def _files(root: str, pattern: str) -> dict[str, int]:
    """URI and size of the matching files."""
    from pyarrow import fs

    where = urlparse(root)
    local = where.scheme in ("", "file")
    system, path = (fs.LocalFileSystem(), unquote(where.path)) if local else fs.FileSystem.from_uri(root)
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    head = "file://" if local else f"{where.scheme}://{where.netloc}" if not path.startswith(where.netloc + "/") else f"{where.scheme}://"
    name = (lambda p: quote(p)) if local else (lambda p: p)
    return {head + name(f.path): f.size for f in found if f.is_file and fnmatch.fnmatch(posixpath.basename(f.path), pattern)}


class LogTailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.pattern = options["root"], options.get("pattern", "*.jsonl")
        self.wanted = [w.encode() for w in options.get("wanted", "").split(",") if w]
        self.range, self.tasks = int(options.get("range", ranges.RANGE)), int(options.get("tasks", 1))
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path, size in _files(self.root, self.pattern).items():
            if self.known.get(path, (-1, 0))[0] != size:
                self.known[path] = (size, ranges.whole_lines(path, size))
        return {path: end for path, (_, end) in self.known.items()}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        out = []
        for path, stop in end.items():
            first = start.get(path, 0)
            first = first if first <= stop else 0
            out += [Range(path, first, at, min(at + self.range, stop), stop) for at in range(first, stop, self.range)]
        return packed(out, self.range, self.tasks)

    def read(self, partition: Ranges) -> Iterator[tuple]:
        for r in partition.ranges:
            for number, line in ranges.range_lines(r.path, r.first, r.start, r.end, r.stop):
                if line.strip() and (not self.wanted or any(w in line for w in self.wanted)):
                    yield line.rstrip(b"\r").decode("utf-8", "replace"), r.path, number


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "value string, source_file string, line_no long"

    def streamReader(self, schema) -> LogTailReader:
        return LogTailReader(dict(self.options))
