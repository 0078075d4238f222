"""Segmentation into vocabulary pieces by a max-plus scan, and its inverse.

Every piece of a vocabulary file has a score; the encoding of a text is the segmentation of highest total
score (a character without a piece stands for itself at a penalty and becomes byte pieces). In the max-plus
semiring the best score over a stretch of text is a matrix: entry (i, j) is the best segmentation that begins
i characters after the stretch's start and ends j characters after its end, because a piece may reach over the
cut. Such matrices multiply associatively, so a giant text is cut into chunks of `CHUNK` characters, every
chunk's matrix is made by itself, the matrices are combined in a tree of `FAN` at a time, the best states at the
cuts are handed down the tree again, and every chunk is then traced back alone between its two states. Where
a blank follows another character no piece reaches over, so a chunk that has such a place needs the full matrix only
before it. Texts of one chunk are segmented at once, word by word, with the words seen so far kept.

Ties: of segmentations with equal scores the one whose last piece is longest wins, from the end backwards,
within a chunk; between chunks the nearer state wins.

Null text is empty and has no ids; a null doc_id is passed through; repeated rows get equal results; other columns are ignored;
an empty table gives no rows. Decoding gives back the normalised text, which is the text itself for files
that keep blanks as they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from usagelens.llm.common import importable, slices
from usagelens.session import cut_lineage

#: Characters of a chunk of a giant text.
CHUNK = 16_384
#: Matrices combined at once.
FAN = 32
#: What a character without a piece costs beyond the worst piece.
UNKNOWN = 10.0
KEEP = 400_000
BLANK = "▁"
_FORCED = re.compile(f"[^{BLANK}]{BLANK}")

_open: dict = {}


class Pieces:
    """The vocabulary of a SentencePiece file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        normal = [i for i in range(size) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        self.names = [model.id_to_piece(i) for i in range(size)]
        self.ids = {self.names[i]: i for i in normal}
        self.scores = {self.names[i]: model.get_score(i) for i in normal}
        self.longest = max(map(len, self.ids))
        self.penalty = min(self.scores.values()) - UNKNOWN
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.from_byte = {i: b for b, i in self.bytes.items()}
        self.unknown = model.unk_id()
        # Whether a piece has a blank after another character: then words are not independent.
        self.by_word = not any(BLANK in name.lstrip(BLANK) for name in self.ids)
        # All beginnings of pieces, with the score of those that are pieces (the others never win): a search ends where none goes on.
        self.begins: dict[str, float] = dict.fromkeys((name[:n] for name in self.ids for n in range(1, len(name))), -np.inf)
        self.begins.update(self.scores)
        # Line ends and tabs that no longer piece holds stand alone as well.
        alone = "".join(c for c in "\n\t\r" if not any(c in name for name in self.ids if len(name) > 1))
        self.split = re.compile((f"[{alone}]|" if alone else "") + f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+").findall
        self.words: dict[str, tuple[int, ...]] = {}
        self.is_byte = np.zeros(size, bool)
        self.is_byte[list(self.from_byte)] = True
        #: How ids are kept between steps.
        self.kind = "<u2" if size <= 1 << 16 else "<u4"

    def steps(self, text: str, at: int) -> list[tuple[int, float]]:
        """Pieces that begin at a place: (length, score), shortest first."""
        found = []
        for n in range(1, min(self.longest, len(text) - at) + 1):
            s = self.begins.get(text[at : at + n])
            if s is None:
                break
            if s != -np.inf:
                found.append((n, s))
        return found if found and found[0][0] == 1 else [(1, self.penalty), *found]

    def best(self, text: str) -> list[int]:
        """Ids of the best segmentation of a short text."""
        size, get, single, penalty = len(text), self.begins.get, self.scores.get, self.penalty
        score, back = [0.0] + [-np.inf] * size, [0] * (size + 1)
        for at, sign in enumerate(text):
            here = score[at]
            s = here + single(sign, penalty)
            if s > score[at + 1]:
                score[at + 1], back[at + 1] = s, at
            for end in range(at + 2, size + 1):
                s = get(text[at:end])
                if s is None:
                    break
                if here + s > score[end]:
                    score[end], back[end] = here + s, at
        out, end, ids = [], size, self.ids.get
        while end:
            at = back[end]
            i = ids(text[at:end])
            if i is None:
                out += reversed(self.piece(text[at:end]))
            else:
                out.append(i)
            end = at
        out.reverse()
        return out

    def piece(self, name: str) -> list[int]:
        if name in self.ids:
            return [self.ids[name]]
        return [self.bytes[b] for b in name.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text that fits one chunk; `text` is normalised already."""
        if not self.by_word:
            return np.array(self.best(text), np.uint32)
        if len(self.words) > KEEP:
            self.words.clear()
        out: list[int] = []
        for word in self.split(text):
            ids = self.words.get(word)
            if ids is None:
                ids = self.words[word] = tuple(self.best(word)) if len(word) <= 256 else tuple(traced(self, word, 0, 0)[0])
            out += ids
        return np.array(out, np.uint32)

    def decode(self, ids) -> str:
        """The normalised text of some ids."""
        if not self.is_byte[ids].any():
            return "".join(map(self.names.__getitem__, ids.tolist()))
        ids, out, raw = ids.tolist(), [], bytearray()
        for i in ids:
            if i in self.from_byte:
                raw.append(self.from_byte[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "surrogatepass"))
                raw = bytearray()
            out.append(self.names[i])
        return "".join(out) + raw.decode("utf-8", "surrogatepass")


def pieces(path: str) -> Pieces:
    """One vocabulary per worker process and file."""
    if path not in _open:
        _open[path] = Pieces(path)
    return _open[path]


def normalise(text: str) -> str:
    """Blanks as BLANK, and one before the text."""
    return BLANK + text.replace(" ", BLANK) if text else ""


# --- chunks ---------------------------------------------------------------------------------------
# A state is the number of characters from a cut to the next place where a piece begins.


def _forced(p: Pieces, text: str, size: int) -> tuple[int, int] | None:
    """First and last place inside a chunk that every segmentation meets: a blank after another character."""
    if not p.by_word:
        return None
    first = next((m.start() + 1 for m in _FORCED.finditer(text, 0, size)), None)
    if first is None:
        return None
    last = size - 1
    while not (text[last] == BLANK and text[last - 1] != BLANK):
        last -= 1
    return first, last


def _paths(p: Pieces, text: str, size: int) -> np.ndarray:
    """Best score from every entry state to every place of `text`; pieces begin before `size`."""
    score = np.full((len(text) + 1, p.longest), -np.inf)
    for i in range(min(p.longest, len(text) + 1)):
        score[i, i] = 0.0
    for at in range(size):
        for n, s in p.steps(text, at):
            np.maximum(score[at + n], score[at] + s, out=score[at + n])
    return score


def matrix(p: Pieces, text: str, size: int) -> np.ndarray:
    """Best score from every entry state to every exit state of the first `size` characters of `text`, whose
    further characters are those that follow (at most the longest piece less one).

    Between the first and the last forced place all paths score the same; that constant is left out.
    """
    width, forced = p.longest, _forced(p, text, size)
    out = np.full((width, width), -np.inf)
    if forced is None:
        tail = _paths(p, text, size)[size : size + width]
        out[:, : len(tail)] = tail.T
    else:
        first, last = forced
        head = _paths(p, text[:first], first)[first]
        tail = _paths(p, text[last:], size - last)[size - last : size - last + width, 0]
        out[:, : len(tail)] = head[:, None] + tail[None, :]
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def chunk_ids(p: Pieces, text: str, entry: int, leave: int, size: int) -> np.ndarray:
    """Ids of a chunk between its two states: its ends by their states, the words between as they are."""
    forced = _forced(p, text, size)
    if forced is None:
        return np.array(traced(p, text, entry, leave, size)[0], np.uint32)
    first, last = forced
    ends = traced(p, text[:first], entry, 0)[0], traced(p, text[last:], 0, leave, size - last)[0]
    return np.concatenate([np.array(ends[0], np.uint32), p.encode(text[first:last]), np.array(ends[1], np.uint32)])


def traced(p: Pieces, text: str, entry: int, leave: int, size: int | None = None) -> tuple[list[int], float]:
    """Ids and score of the best segmentation from `entry` to `leave` characters behind the chunk's end."""
    size = len(text) if size is None else size
    end = size + leave
    score, back = np.full(end + 1, -np.inf), np.zeros(end + 1, np.int64)
    score[entry] = 0.0
    for at in range(entry, size):
        if score[at] == -np.inf:
            continue
        for n, s in p.steps(text, at):
            if at + n <= end and score[at] + s > score[at + n]:
                score[at + n], back[at + n] = score[at] + s, n
    cuts, at = [], end
    while at > entry:
        cuts.append((at - back[at], at))
        at -= int(back[at])
    return [i for a, b in reversed(cuts) for i in p.piece(text[a:b])], float(score[end])


def states_between(matrices: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """The best states at the inner cuts of some neighbouring stretches, given the outer two."""
    ahead = [matrices[0][entry]]
    for m in matrices[1:]:
        ahead.append((ahead[-1][:, None] + m).max(axis=0))
    out, state = [], leave
    for k in range(len(matrices) - 1, 0, -1):
        state = int(np.argmax(ahead[k - 1] + matrices[k][:, state]))
        out.append(state)
    return out[::-1]


_ROW = "row long, level int, number long, scores binary"


def _combine(spark_rows: DataFrame, width: int, level: int) -> DataFrame:
    """One level up the tree: FAN neighbouring matrices become one."""

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        total = None
        for data in table.column("scores"):
            m = np.frombuffer(data.as_buffer(), np.float64).reshape(width, width)
            total = m if total is None else times(total, m)
        number = table.column("number")[0].as_py() // FAN
        return pa.table({"row": table.column("row").slice(0, 1), "level": pa.array([level], pa.int32()), "number": pa.array([number], pa.int64()), "scores": pa.array([total.tobytes()], pa.binary())})

    return spark_rows.groupBy("row", (F.col("number") / FAN).cast("long")).applyInArrow(merge, _ROW)


def _hand_down(parents: DataFrame, children: DataFrame, width: int) -> DataFrame:
    """(row, number, entry, leave) of the children, from those of their parents."""
    kind = "row long, number long, entry int, leave int"
    both = children.withColumn("parent", (F.col("number") / FAN).cast("long")).join(parents.withColumnRenamed("number", "parent"), ["row", "parent"])

    def split(table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        matrices = [np.frombuffer(d.as_buffer(), np.float64).reshape(width, width) for d in table.column("scores")]
        entry, leave = table.column("entry")[0].as_py(), table.column("leave")[0].as_py()
        inner = states_between(matrices, entry, leave)
        return pa.table({"row": table.column("row"), "number": table.column("number"), "entry": pa.array([entry, *inner], pa.int32()), "leave": pa.array([*inner, leave], pa.int32())})

    return both.select("row", "parent", "number", "scores", "entry", "leave").groupBy("row", "parent").applyInArrow(split, kind)


def encode(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """Pieces of every document in order: doc_id, row, number, ids (little-endian unsigned 32-bit); a text
    of one chunk is one piece with number 0, a giant one has a piece per chunk."""
    importable(docs.sparkSession)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, rows in _short(batches, path):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(rows, pa.int64()), pa.array([0] * len(rows), pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], ["doc_id", "row", "number", "ids"]
            )

    kind = "doc_id long, row long, number long, ids binary"
    rest = _giant(docs, path, chunk).mapInArrow(lambda batches: _widened(batches, path), kind)
    return _texts(docs, chunk, False).mapInArrow(short, kind).unionByName(rest)


def _texts(docs: DataFrame, chunk: int, giant: bool) -> DataFrame:
    """Documents whose normalised text (with the blank before it) is longer than a chunk, or the others."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.where(f"{'' if giant else 'NOT '}(text IS NOT NULL AND char_length(text) >= {chunk})")


def _short(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[int]]]:
    """Texts of one chunk with their ids, and row numbers apart from those of giant texts."""
    from pyspark import TaskContext

    p, row = pieces(path), -1 - (TaskContext.get().partitionId() << 40)
    for batch in batches:
        for some in slices(batch, "text", 2 << 20):
            ids = [p.encode(normalise(raw or "")) for raw in some.column("text").to_pylist()]
            yield some, ids, [row - i for i in range(len(ids))]
            row -= len(ids)


def _widened(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    kind = pieces(path).kind
    for batch in batches:
        ids = [np.frombuffer(x, kind).astype("<u4").tobytes() for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "number")), pa.array(ids, pa.binary())], ["doc_id", "row", "number", "ids"])


def _giant(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    """The pieces of the texts of several chunks; ids in the vocabulary's own width."""
    importable(docs.sparkSession)
    width = pieces(path).longest

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks (compressed, as they are shuffled) with the characters that a piece may reach, and their matrices."""
        from pyspark import TaskContext

        p, row = pieces(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for some in slices(batch, "text", 2 << 20):
                out = []
                for doc, raw in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    text = normalise(raw)
                    for number, lo in enumerate(range(0, len(text), chunk)):
                        part, size = text[lo : lo + chunk + width - 1], min(chunk, len(text) - lo)
                        out.append((doc, row, number, zstandard.compress(part.encode("utf-8", "surrogatepass")), size, matrix(p, part, size).tobytes()))
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
    names = ["doc_id", "row", "number", "part", "size", "scores"]
    chunks = cut_lineage(_texts(docs, chunk, True).mapInArrow(first, "doc_id long, row long, number long, part binary, size long, scores binary"))
    levels = [chunks.select("row", F.lit(0).alias("level"), "number", "scores")]
    while (levels[-1].agg(F.max("number")).first()[0] or 0) > 0:
        levels.append(cut_lineage(_combine(levels[-1], width, len(levels))))
    states = levels[-1].select("row", "number", F.lit(0).alias("entry"), F.lit(0).alias("leave"))
    for below in levels[-2::-1]:
        states = _hand_down(states, below, width)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            found = [chunk_ids(p, zstandard.decompress(r["part"]).decode("utf-8", "surrogatepass"), r["entry"], r["leave"], r["size"]).astype(p.kind).tobytes() for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("number"), pa.array(found, pa.binary())], ["doc_id", "row", "number", "ids"])

    kind = "doc_id long, row long, number long, ids binary"
    giant = chunks.select("doc_id", "row", "number", "part", "size").join(states, ["row", "number"]).select("doc_id", "row", "number", "part", "size", "entry", "leave")
    return giant.mapInArrow(trace, kind)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, row, text) from the pieces of documents, each decoded by itself."""
    importable(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            # Byte pieces of one character never lie in two chunks: a chunk ends between pieces.
            text = [p.decode(np.frombuffer(x, "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "number")), pa.array(text, pa.string())], ["doc_id", "row", "number", "part"])

    parts = encoded.mapInArrow(run, "doc_id long, row long, number long, part string")
    joined = parts.groupBy("doc_id", "row").agg(F.expr("array_join(transform(array_sort(collect_list(struct(number, part))), x -> x.part), '')").alias("whole"))
    return joined.select("doc_id", "row", F.expr(f"replace(substring(whole, 2), '{BLANK}', ' ')").alias("text"))


def encode_and_decode(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """Per document: doc_id, n_pieces, n_chunks, ids_crc32 of all its ids, and decoded_sha256 of the decoded text."""
    importable(docs.sparkSession)
    kind = "doc_id long, n_pieces long, n_chunks long, ids_crc32 long, decoded_sha256 string"

    def digests(doc_ids: pa.Array, ids: list[np.ndarray], n_chunks: list[int]) -> pa.RecordBatch:
        import hashlib

        p = pieces(path)
        text = [p.decode(x)[1:].replace(BLANK, " ") for x in ids]
        columns = {
            "doc_id": doc_ids, "n_pieces": pa.array(map(len, ids), pa.int64()), "n_chunks": pa.array(n_chunks, pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
            "decoded_sha256": pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in text], pa.string()),
        }
        return pa.RecordBatch.from_pydict(columns)

    def of_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, _ in _short(batches, path):
            yield digests(part.column("doc_id"), ids, [1] * len(ids))

    def of_giant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path).kind
        for batch in batches:
            parts = batch.column("parts").to_pylist()
            yield digests(batch.column("doc_id"), [np.frombuffer(b"".join(x), own) for x in parts], [len(x) for x in parts])

    # Only giant documents have pieces to bring together; the others are digested where they are encoded.
    whole = _giant(docs, path, chunk).groupBy("doc_id", "row").agg(F.expr("transform(array_sort(collect_list(struct(number, ids))), x -> x.ids)").alias("parts"))
    return _texts(docs, chunk, False).mapInArrow(of_short, kind).unionByName(whole.select("doc_id", "parts").mapInArrow(of_giant, kind))
