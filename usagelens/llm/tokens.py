"""Token ids by the tokenizers library, with one call per new word instead of one per text.

A text is normalised and cut where the tokenizer's own first step cuts it in any case (`bpe.Words`), so encoding the words and
joining the ids gives the ids of the whole text. Equal words of a slice of texts are looked up once; the words seen so far are kept with their
ids, up to `KEEP` words, then the table starts anew; that bounds memory and changes no id. As in the library, a tokenizer's
added tokens (such as <|endoftext|>) that occur in a text are found first, as written there, and are one id each.
"""

from __future__ import annotations

import itertools
import json
import os

import numpy as np

from usagelens.llm.bpe import Words

#: Words kept per Python worker.
KEEP = 1_000_000
#: Characters of texts cut at once, more only for a longer text.
TOGETHER = 1 << 22

_open: dict = {}


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers

        # One word is little work: handing it to threads costs more than it saves, and Spark has a task for each core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            self.words = Words(json.load(f), path)
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        # Words come normalised, and hold no added token as written; one that lower-casing makes is ordinary text.
        self.tokenizer.encode_special_tokens = True
        if self.words.alone:
            self.tokenizer.normalizer = normalizers.Sequence([])
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.starts, self.sizes, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64), 0

    def _learn(self, words: list[bytes]) -> None:
        found = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum()))
        at, end = len(self.known), self.used + len(ids)
        while end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while at + len(words) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.ids[self.used : end] = ids
        self.starts[at : at + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[at : at + len(words)] = sizes
        self.known.update(zip(words, range(at, at + len(words)), strict=True))
        self.used = end

    def _some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw, lo, size, which, texts_end = self.words.split(texts)
        data = raw.tobytes()
        words = [data[a:b] for a, b in zip(lo.tolist(), (lo + size).tolist(), strict=True)]
        if len(self.known) + len(words) > KEEP:
            self._clear()
        at = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(at < 0)):
            fresh = [words[i] for i in new.tolist()]
            self._learn(list(dict.fromkeys(fresh)))
            at[new] = np.fromiter(map(self.known.__getitem__, fresh), np.int64, len(fresh))
        return self.words.join(self.ids[: self.used], self.starts[at], self.sizes[at], which, texts_end)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and each text's bounds in them."""
        ids, bounds, lo = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
        while lo < len(texts):
            hi, held = lo, 0
            while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= TOGETHER):
                held += len(texts[hi])
                hi += 1
            some, ends = self._some(texts[lo:hi])
            ids.append(some)
            bounds.append(ends[1:] + bounds[-1][-1])
            lo = hi
        return np.concatenate(ids), np.concatenate(bounds)


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's ids followed by the id `end`, and the new bounds."""
    shifted = bounds + np.arange(len(bounds))
    out = np.full(int(shifted[-1]), end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[shifted[1:] - 1] = False
    out[keep] = ids
    return out, shifted
