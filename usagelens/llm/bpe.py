"""Byte-pair encoding in numpy merge rounds over many words at once, and its inverse.

A text is normalised and cut into words as the tokenizer file says; the words of a slice of texts that are equal are merged
once. The symbols of all different words stand in one flat array. In every round each neighbouring pair is one number, looked up by
binary search among the sorted numbers of all merges; each word's pair of lowest rank is merged at all its places from left
to right, and the words without a known pair leave the array. Only pairs next to a merge are looked up again, so a round
over a giant word costs little more than its merges. Merging all places of a rank at once equals merging one by one where no merge that
uses a new symbol ranks before the merge that makes it; that is checked when the file is read, else only the first place is
merged in a round.

Added tokens (such as <|endoftext|>) are found in the text as written, before anything else, and are one id each. Decoding joins the
ids' names as the file's decoder does: with blanks where it has none, as bytes where it is byte-level.

Null text is empty and has no ids; a null doc_id is passed through; repeated rows get equal results; other columns are ignored, whatever their
names; an empty table gives no rows. Whole texts are encoded, one slice of about `SLICE` bytes of text (or one longer text) at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from usagelens.llm.common import importable, mix, slices

#: Bytes of text encoded together.
SLICE = 2 << 20

# Character classes.
_SPACE, _LETTER, _NUMBER, _OTHER, _BREAK = range(5)
#: Code points of white space, as Unicode lists them.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: English endings that stay with their apostrophe.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: The two ways of cutting words known here, as the files write them.
_CUT_ALONE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NEVER = np.iinfo(np.int32).max

_open: dict = {}


def _every() -> list[str]:
    """All characters, in blocks."""
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    return ["".join(map(chr, points[lo : lo + 4096])) for lo in range(0, len(points), 4096)]


def _classes() -> np.ndarray:
    """The class of every code point, by the version of Unicode that the tokenizers library has."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    table = np.full(0x110000, _OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER)):
        cut = Split(Regex(pattern), "removed", invert=True)
        for block in _every():
            for found, _ in cut.pre_tokenize_str(block):
                table[list(map(ord, found))] = kind
    table[_WHITE] = _SPACE
    return table


def _nfc():
    from tokenizers.normalizers import NFC

    return NFC().normalize_str


def _lower_apart() -> dict[int, str]:
    """Characters that the library lower-cases otherwise than Python: those of a newer version of Unicode."""
    from tokenizers.normalizers import Lowercase

    by_library = Lowercase().normalize_str
    return {ord(c): by_library(c) for block in _every() if by_library(block) != block.replace("Σ", "σ").lower() for c in block if by_library(c) != c.lower()}


def _alphabet() -> list[str]:
    """The character that stands for each byte: itself where it prints, else one of those from 256 on, in order."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(hidden)) for b in range(256)]


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of `values` one after the other."""
    total = int(sizes.sum())
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    index = np.repeat((starts - (np.cumsum(sizes) - sizes)).astype(kind), sizes)
    index += np.arange(total, dtype=kind)
    return values[index]


class Words:
    """How a tokenizer file cuts texts into words."""

    def __init__(self, file: dict, path: str):
        self._read_steps(file, path)
        self.classes = _classes()
        self.nfc = _nfc()
        self.lower_apart = _lower_apart() if self.alone else {}
        self.apart = np.array(sorted(self.lower_apart), np.uint32)
        self.added = {x["content"]: x["id"] for x in file["added_tokens"]}
        #: Ids of added tokens, in the order of their entries in a split.
        self.extra = sorted(set(self.added.values()))
        # The longest of those that begin at a place counts.
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.base = np.random.default_rng(20240807).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)

    def _read_steps(self, file: dict, path: str) -> None:
        """How the file normalises, cuts and decodes; others than the ways known here are an error."""
        plain = [{k: v for k, v in x.items() if k not in ("trim_offsets", "add_prefix_space")} for x in (file["pre_tokenizer"].get("pretokenizers") or [file["pre_tokenizer"]])]
        norm = [x["type"] for x in (file["normalizer"] or {}).get("normalizers", [file["normalizer"]] if file["normalizer"] else [])]
        if plain == [{"type": "ByteLevel", "use_regex": True}] and not norm:
            self.alone = False
        elif plain == [{"type": "Split", "pattern": {"Regex": _CUT_ALONE}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "use_regex": False}] and norm == ["NFC", "Replace", "Lowercase"]:
            self.alone = True
        else:
            raise ValueError(f"{path}: a way of cutting words that is not known here")
        model, decoder = file["model"], (file["decoder"] or {}).get("type")
        if model["type"] != "BPE" or model["dropout"] or model["continuing_subword_prefix"] or model["ignore_merges"] or model["byte_fallback"] or decoder not in (None, "ByteLevel") or file["post_processor"]:
            raise ValueError(f"{path}: steps that are not known here")
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in file["added_tokens"]):
            raise ValueError(f"{path}: added tokens that are not found as written")
        self.bytes_out = decoder == "ByteLevel"

    # --- words ------------------------------------------------------------------------------

    def _normal(self, text: str) -> str:
        """NFC and lower case character by character (a final sigma is no other letter here). White space is dropped later in any case."""
        if not self.alone:
            return text
        if not text.isascii():
            # What is to be composed the library composes: its tables know fewer marks than Python's.
            text = (text if unicodedata.is_normalized("NFC", text) else self.nfc(text)).replace("Σ", "σ")
        return text.lower()

    def _starts(self, points: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where a word (or a stretch that is none) begins."""
        start = np.ones(len(kind), bool)
        start[1:] = kind[1:] != kind[:-1]
        start |= kind == _BREAK
        if self.alone:
            start |= kind == _NUMBER
        # An apostrophe by itself that begins a word takes one of the endings along. Every stretch ends in a break, so places after it exist.
        a = np.flatnonzero((points == ord("'")) & start)
        a = a[kind[a] == _OTHER]
        a = a[kind[a + 1] == _LETTER]
        if not self.alone and len(a):
            a = a[(a == 0) | (points[a - 1] != ord(" "))]
        for ending in _ENDINGS if len(a) else ():
            n = len(ending)
            at = a[a + n < len(points)]
            for i, c in enumerate(ending):
                at = at[points[at + 1 + i] == ord(c)]
            start[at + 1] = False
            start[at[kind[at + 1 + n] == _LETTER] + 1 + n] = True
        if not self.alone:
            # The last white space before a word is by itself, and a blank goes with the word.
            last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != _BREAK))
            start[last] = True
            start[last[points[last] == ord(" ")] + 1] = False
        return start

    def _different(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place of every different word, and for each word which of those it is."""
        at = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        kind = np.int32 if total < 1 << 31 else np.int64
        inner = np.arange(total, dtype=kind)
        inner -= np.repeat(at.astype(kind), sizes)
        power = np.cumprod(np.full(int(sizes.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
        flat = _gather(raw, starts, sizes)
        hashes = mix(np.add.reduceat(self.base[flat] * power[inner], at) + sizes.astype(np.uint64))
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        twin = first[which]
        if (sizes == sizes[twin]).all() and (flat == _gather(raw, starts[twin], sizes)).all():
            return first, which
        return np.arange(len(starts)), np.arange(len(starts))  # two words share a hash: all are merged by themselves

    @staticmethod
    def _points(joined: str) -> np.ndarray:
        try:
            return np.frombuffer(joined.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            return np.frombuffer(joined.encode("utf-32-le"), np.uint32)

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 bytes, place and size of every different word in them; of each word in turn which of those it is; where
        each text ends in that turn. Behind the words, the numbers of `which` stand for the ids of `extra`, then for none."""
        parts, follows, counts = [], [], []
        for text in texts:
            found = self.cut(text) if self.cut and any(x in text for x in self.added) else [text]
            parts += map(self._normal, found[::2])
            follows += [self.added[x] for x in found[1::2]] + [-1]
            counts.append(len(follows))
        joined = "\0".join([*parts, ""])
        points = self._points(joined)
        if len(self.apart) and points.dtype == np.uint32 and int(points.max()) >= self.apart[0] and np.isin(points, self.apart).any():
            parts = [x.translate(self.lower_apart) for x in parts]
            joined = "\0".join([*parts, ""])
            points = self._points(joined)
        raw = np.frombuffer(joined.encode(), np.uint8)
        kind = self.classes[points]
        breaks = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        kind[breaks] = _BREAK
        start = np.flatnonzero(self._starts(points, kind))
        end = np.append(start[1:], len(points))
        a_word = kind[start] != _BREAK
        if self.alone:
            entry = a_word & (kind[start] != _SPACE) | ~a_word
            start, end, a_word = start[entry], end[entry], a_word[entry]
        lo, to = start[a_word], end[a_word]
        if len(raw) != len(points):
            place = np.concatenate([[0], np.cumsum(1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000), dtype=np.int64)])
            lo, to = place[lo], place[to]
        size = to - lo
        which = np.empty(len(start), np.int64)
        if len(lo):
            first, which[a_word] = self._different(raw, lo, size)
            lo, size = lo[first], size[first]
        slot = {-1: len(lo) + len(self.extra)} | {x: len(lo) + i for i, x in enumerate(self.extra)}
        which[~a_word] = [slot[x] for x in follows]
        return raw, lo, size, which, np.flatnonzero(~a_word)[np.array(counts) - 1]

    def join(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray, texts_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and each text's bounds in them, from the stretches of `ids` that the different words have."""
        starts = np.concatenate([starts, len(ids) + np.arange(len(self.extra)), [0]])
        sizes = np.concatenate([sizes, np.ones(len(self.extra), np.int64), [0]])
        ids = np.concatenate([ids, np.array(self.extra, ids.dtype)]).astype(np.uint32)
        size = sizes[which]
        return _gather(ids, starts[which], size), np.concatenate([[0], np.cumsum(size)[texts_end]])


class Bpe(Words):
    """The merges, words and names of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, names = file["model"], _alphabet()
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        super().__init__(file, path)
        self.size = max([*vocab.values(), *(x["id"] for x in file["added_tokens"])]) + 1
        self.inner = np.array([vocab[x] for x in names], np.int32)
        self.last = np.array([vocab[x + suffix] for x in names], np.int32)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in xs], np.int64) for xs in (*zip(*pairs, strict=True), [a + b for a, b in pairs]))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made.astype(np.int32)
        born = np.full(self.size, -1, np.int64)
        born[made[::-1]] = np.arange(len(made))[::-1]
        self.ordered = bool((np.maximum(born[left], born[right]) < np.arange(len(made))).all())
        self.names: list[bytes] = [b""] * self.size
        self.is_name = np.zeros(self.size, bool)
        byte = {c: b for b, c in enumerate(names)}
        for x, i in [*vocab.items(), *self.added.items()]:
            self.names[i] = bytes(map(byte.__getitem__, x)) if self.bytes_out and all(c in byte for c in x) else x.encode()
            self.is_name[i] = True
        self.decimal = [str(i).encode() for i in range(self.size)]

    def _merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has."""
        word, out_word, out = np.arange(len(sizes)), [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        out_size = [np.zeros(0, np.int64)]
        ends = np.cumsum(sizes)
        rank = np.full(len(symbols), _NEVER, np.int32)
        inside = np.ones(len(symbols), bool)
        inside[ends - 1] = False
        self._look_up(symbols, rank, np.flatnonzero(inside))
        while len(word):
            starts = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(rank, starts)
            done = best == _NEVER
            if done.any():
                flat = np.repeat(done, sizes)
                out_word.append(word[done])
                out.append(symbols[flat])
                out_size.append(sizes[done])
                word, sizes, best, symbols, rank = word[~done], sizes[~done], best[~done], symbols[~flat], rank[~flat]
                if not len(word):
                    break
                starts = np.cumsum(sizes) - sizes
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            if self.ordered:
                # Of neighbouring hits (a pair of equal symbols in a row) every other one, from the left.
                new_run = np.ones(len(hit), bool)
                new_run[1:] = hit[1:] - hit[:-1] != 1
                order = np.arange(len(hit))
                hit = hit[(order - np.maximum.accumulate(np.where(new_run, order, 0))) % 2 == 0]
            else:
                hit = hit[np.searchsorted(hit, starts)]
            symbols[hit] = self.made[rank[hit]]
            stays = np.ones(len(symbols), bool)
            stays[hit + 1] = False
            was_last = rank[hit + 1] == _NEVER
            at_word = np.searchsorted(starts, hit, side="right") - 1
            # A pair without a merge also has no rank, so whether the place was a word's last is told by the bounds.
            was_last &= hit + 1 == starts[at_word] + sizes[at_word] - 1
            first = hit == starts[at_word]
            sizes = sizes - np.bincount(at_word, minlength=len(sizes))
            symbols, rank = symbols[stays], rank[stays]
            hit = hit - np.arange(len(hit))
            rank[hit] = _NEVER
            self._look_up(symbols, rank, np.concatenate([hit[~was_last], hit[~first] - 1]))
        words, sizes, ids = np.concatenate(out_word), np.concatenate(out_size), np.concatenate(out)
        order = np.argsort(words)
        return _gather(ids, (np.cumsum(sizes) - sizes)[order], sizes[order]), sizes[order]

    def _look_up(self, symbols: np.ndarray, rank: np.ndarray, at: np.ndarray) -> None:
        """Sets the rank of the pairs that begin at `at`."""
        key = symbols[at].astype(np.int64) * self.size + symbols[at + 1]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        rank[at] = np.where(self.keys[place] == key, self.ranks[place], _NEVER)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and each text's bounds in them."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        raw, lo, size, which, texts_end = self.split(texts)
        ids, sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(lo):
            symbols = self.inner[_gather(raw, lo, size)]
            symbols[np.cumsum(size) - 1] = self.last[raw[lo + size - 1]]
            ids, sizes = self._merge(symbols, size)
        return self.join(ids, np.cumsum(sizes) - sizes, sizes, which, texts_end)

    def decode(self, ids: np.ndarray) -> str:
        """The names of the ids joined; ids that the file does not have are left out."""
        if len(ids) and (int(ids.max()) >= self.size or not self.is_name[ids].all()):
            ids = ids[ids < self.size]
            ids = ids[self.is_name[ids]]
        return (b"" if self.bytes_out else b" ").join(map(self.names.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def digest(self, ids: np.ndarray) -> str:
        """SHA-256 of the decimal ids joined by one blank."""
        return hashlib.sha256(b" ".join(map(self.decimal.__getitem__, ids.tolist()))).hexdigest()


def bpe(path: str) -> Bpe:
    """One per worker process and file."""
    if path not in _open:
        _open[path] = Bpe(path)
    return _open[path]


def encode(docs: DataFrame, tokenizer: str, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 32-bit, little-endian) of every whole text, and with `digest` ids_sha256."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bpe(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, bounds = table.encode(pc.fill_null(part.column("text"), "").to_pylist())
                rows = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                columns = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(np.diff(bounds), pa.int64()), "ids": pa.array([x.astype("<u4").tobytes() for x in rows], pa.binary())}
                if digest:
                    columns["ids_sha256"] = pa.array([table.digest(x) for x in rows], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids binary" + (", ids_sha256 string" if digest else ""))


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """`encoded` with the column `decoded` in place of `ids`; null ids are no ids."""
    importable(encoded.sparkSession)
    encoded = encoded.drop("decoded")
    kept = [f for f in encoded.schema if f.name != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bpe(tokenizer)
        for batch in batches:
            texts = [table.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string())], names=[*(f.name for f in kept), "decoded"])

    schema = encoded.select(*(f.name for f in kept)).withColumn("decoded", F.lit(None).cast("string")).schema
    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Every text encoded and decoded again, as counts and digests."""
    return decode(encode(docs, tokenizer, digest=True), tokenizer).selectExpr("doc_id", "n_tokens", "ids_sha256", "sha2(decoded, 256) AS decoded_sha256")
