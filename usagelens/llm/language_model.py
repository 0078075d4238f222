"""A hashed maximum-entropy language model, trained and applied in sparse numpy batches.

A word's probability is P(class | history) * P(word | class, previous class). The first factor is a softmax
over `CLASSES` classes with weights for three hashed features of the history: the previous word, the previous
two words, and the word before the previous one (a skip). The second is a softmax over the class's words, with a
weight for every word and one for every hashed pair of previous class and word. Both sum to one exactly.

Training. All training words are counted. The `HEAD` most frequent words are known to every task; classes are
clusters of them by the words around them (random projections summed over the corpus). All other words are
one class, in which a word has its smoothed count, looked up by a join, and unseen words share one place. Every
gradient update is distributed: each task adds up observed less expected feature counts of its documents
under the current weights, the sums meet block by block, and a step divides by the expected counts.

Everything a task holds has a fixed size (head, weights, gradient), whatever the corpus; the table of counts
is never sent whole. Null text is empty (its end token alone); a null doc_id is a training document with the
empty text as its name; repeated rows each count and each get a result; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from usagelens.llm.common import importable, mix, slices, word_hashes
from usagelens.session import cut_lineage

HEAD = 1 << 17
#: Words seen less often are tail words: they teach the model how likely an unseen word is.
SEEN = 3
CLASSES = 64
#: Hashed features of the previous word, the previous two, and the skipped one.
FEATURES = (4096, 8192, 4096)
PAIRS = 1 << 19
#: Width of the projections that classes come from.
WIDTH = 16
UPDATES = 2
#: Counts that every class and every pair is given in advance.
PRIOR, PAIR_PRIOR = 3.0, 4.0

_TAIL = CLASSES - 1
#: Above all real hashes in effect: the end token and the place before the first word.
END, START = np.uint64(0xE17D_0000_0000_0001), np.uint64(0x57A7_0000_0000_0001)
#: Gradient sums travel in blocks of this many numbers.
_BLOCK = 1 << 15
_LANES = 32
_ROWS = 1 << 15
#: Rows of class masses made at once, few enough to stay in a processor's cache.
_CLOSE = 1 << 11
#: Histories of a task held until equal ones are counted.
_HELD = 1 << 22


def with_split(docs: DataFrame) -> DataFrame:
    """doc_id, text, held_out: one document in five by its name is kept from training."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.crc32(name) % 5 == 1).alias("held_out"))


def _sequence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, and the bounds."""
    words, bounds = word_hashes(texts)
    out = np.insert(words, bounds[1:], END)
    return out, bounds + np.arange(len(bounds))


def _batches(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for part in slices(batch, "text"):
            yield part, *_sequence(part.column("text"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def merged() -> pa.RecordBatch:
        words, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        found, index = np.unique(words, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.bincount(index, counts).astype(np.int64))], ["word", "c"])

    for _, words, _ in _batches(batches):
        held.append(np.unique(words, return_counts=True))
        size += len(held[-1][0])
        if size > 2_000_000:
            yield merged()
            held, size = [], 0
    if held:
        yield merged()


class Head:
    """The frequent words: their places, counts and classes."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order].astype(np.float64)
        self.classes = np.zeros(len(words), np.int64)

    def find(self, words: np.ndarray) -> np.ndarray:
        """Place of every word, the number of head words for others."""
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, len(self.words))

    def class_of(self, at: np.ndarray) -> np.ndarray:
        return np.append(self.classes, _TAIL)[at]


def _history(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each and the one before that; START where there is none."""
    one, two = np.empty_like(words), np.empty_like(words)
    one[1:], two[2:] = words[:-1], words[:-2]
    first = bounds[:-1]
    one[first] = START
    two[first] = START
    second = first[first + 1 < bounds[1:]] + 1
    two[second] = START
    return one, two


def _features(one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
    a, b, c = FEATURES
    pair = mix(one * np.uint64(0x9E3779B97F4A7C15) + mix(two))
    return [(mix(one) % np.uint64(a)).astype(np.int64), a + (pair % np.uint64(b)).astype(np.int64), a + b + (mix(two + np.uint64(77)) % np.uint64(c)).astype(np.int64)]


def _histories(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The three features of every word as one number."""
    one, two, skip = _features(*_history(words, bounds))
    return (one * sum(FEATURES) + two) * sum(FEATURES) + skip


def _of_history(numbers: np.ndarray) -> list[np.ndarray]:
    """The features that `_histories` made each number of."""
    rest, skip = np.divmod(numbers, sum(FEATURES))
    return [*np.divmod(rest, sum(FEATURES)), skip]


def _pair_bucket(previous: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (mix((previous.astype(np.uint64) << np.uint64(32)) + at.astype(np.uint64)) % np.uint64(PAIRS)).astype(np.int64)


class Model:
    """Weights of both factors; `total` and `kinds` are N and V of the training words."""

    def __init__(self, head: Head, total: int, kinds: int):
        self.head, self.total, self.kinds = head, total, kinds
        self.tail_total, self.tail_kinds = total - head.counts.sum(), kinds - len(head.words)
        self.weights = np.zeros((sum(FEATURES), CLASSES), np.float32)
        self.pairs = np.zeros(PAIRS, np.float32)

    def start(self) -> None:
        """Class frequencies and word frequencies inside the classes."""
        mass = np.bincount(self.head.classes, self.head.counts, CLASSES)
        mass[_TAIL] = self.tail_total + 0.5 * (self.tail_kinds + 1)
        self.share = (mass + 1e-3) / (mass + 1e-3).sum()
        self.bias = np.log(self.share).astype(np.float32)
        self.word = np.log(self.head.counts / np.maximum(mass[self.head.classes], 1e-9)) if len(self.head.words) else np.zeros(0)
        self.normalise()

    def normalise(self) -> None:
        """log of the sum over a class's words, for every previous class."""
        every = np.arange(len(self.head.words))
        self.norm = np.zeros((CLASSES + 1, CLASSES))
        for previous in range(CLASSES + 1):
            z = np.exp(self.word + self.pairs[_pair_bucket(np.full(len(every), previous), every)])
            self.norm[previous] = np.log(np.maximum(np.bincount(self.head.classes, z, CLASSES), 1e-300))

    def class_masses(self, features: list[np.ndarray]) -> np.ndarray:
        """exp of every class's weight sum, a row per word; the weights are bounded, so it cannot overflow."""
        z = self.weights[features[0]]
        z += self.bias
        for f in features[1:]:
            z += self.weights[f]
        return np.exp(z, out=z)

    def add_expected(self, sums: np.ndarray, histories: np.ndarray, times: np.ndarray) -> None:
        """Adds to `sums`, a row per class, how often each feature is expected to come with the class; `histories`
        are different and in rising order."""
        features = _of_history(histories)
        by_class = np.empty((CLASSES, min(_ROWS, len(histories))))
        for lo in range(0, len(histories), _ROWS):
            some, often = [f[lo : lo + _ROWS] for f in features], times[lo : lo + _ROWS]
            for at in range(0, len(some[0]), _CLOSE):
                part = slice(at, at + _CLOSE)
                p = self.class_masses([f[part] for f in some])
                p *= (often[part] / p.sum(axis=1)).astype(np.float32)[:, None]
                by_class[:, at : at + len(p)] = p.T
            here = by_class[:, : len(some[0])]
            # Histories come in the order of their first feature: its sums are sums of stretches.
            starts = np.flatnonzero(np.diff(some[0], prepend=-1))
            sums[:, some[0][starts]] += np.add.reduceat(here, starts, axis=1)
            for f, first, size in zip(some[1:], np.cumsum(FEATURES[:-1]), FEATURES[1:], strict=True):
                for c in range(CLASSES):
                    sums[c, first : first + size] += np.bincount(f - first, here[c], size)

    def score(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of every word (without the word factor for tail words), and its place in the head."""
        at = self.head.find(words)
        own = self.head.class_of(at)
        one, two = _history(words, bounds)
        previous = np.empty_like(own)
        previous[1:] = own[:-1]
        previous[bounds[:-1]] = CLASSES
        features, out = _features(one, two), np.empty(len(words))
        for lo in range(0, len(words), _CLOSE):
            part = slice(lo, lo + _CLOSE)
            mass = self.class_masses([f[part] for f in features])
            out[part] = np.log(mass[np.arange(len(mass)), own[part]] / mass.sum(axis=1))
        known = at < len(self.head.words)
        a, p = at[known], previous[known]
        out[known] += self.word[a] + self.pairs[_pair_bucket(p, a)] - self.norm[p, own[known]]
        return out, at


# --- sums over the corpus -------------------------------------------------------------------------


def _summed(train: DataFrame, size: int, add, keyed=None) -> np.ndarray:
    """Adds up one array of `size` numbers over all documents: `add(sum, words, bounds)` per batch, or with
    `keyed`, which gives a whole number per word, `add(sum, distinct numbers, how often each)`.

    Tasks send blocks; blocks meet in lanes first, so no group grows with the number of tasks alone.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, any_rows, held, n_held = np.zeros(size, np.float64), False, [], 0
        for _, words, bounds in _batches(batches):
            any_rows = True
            if keyed is None:
                add(total, words, bounds)
                continue
            held.append(keyed(words, bounds))
            n_held += len(words)
            if n_held >= _HELD:
                add(total, *np.unique(np.concatenate(held), return_counts=True))
                held, n_held = [], 0
        if held:
            add(total, *np.unique(np.concatenate(held), return_counts=True))
        if any_rows:
            data, lane = total.astype(np.float32), TaskContext.get().partitionId() % _LANES
            blocks = range(0, size, _BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lane] * len(blocks), pa.int32()), pa.array([lo // _BLOCK for lo in blocks], pa.int32()), pa.array([data[lo : lo + _BLOCK].tobytes() for lo in blocks], pa.binary())], ["lane", "block", "data"]
            )

    def merge(table: pa.Table) -> pa.Table:
        total = None
        for row in table.column("data"):
            one = np.frombuffer(row.as_buffer(), np.float32).astype(np.float64)
            total = one if total is None else total + one
        return table.slice(0, 1).set_column(table.schema.get_field_index("data"), "data", pa.array([total.astype(np.float32).tobytes()], pa.binary()))

    kind = "lane int, block int, data binary"
    sums = train.select("text").mapInArrow(local, kind).groupBy("lane", "block").applyInArrow(merge, kind).groupBy("block").applyInArrow(merge, kind)
    out = np.zeros(size, np.float64)
    for row in sums.select("block", "data").collect():  # of the model's fixed size
        out[row["block"] * _BLOCK : row["block"] * _BLOCK + len(row["data"]) // 4] = np.frombuffer(row["data"], np.float32)
    return out


def _clusters(vectors: np.ndarray, weights: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means by cosine, centres drawn from the heaviest words."""
    if len(vectors) <= k:
        return np.arange(len(vectors))
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    centres = unit[np.argsort(-weights, kind="stable")[:k]]
    for _ in range(rounds):
        own = np.concatenate([(unit[lo : lo + 8192] @ centres.T).argmax(axis=1) for lo in range(0, len(unit), 8192)])
        sums = np.stack([np.bincount(own, unit[:, j] * np.sqrt(weights), k) for j in range(unit.shape[1])], axis=1)
        filled = np.abs(sums).sum(axis=1) > 0
        centres[filled] = sums[filled] / np.maximum(np.linalg.norm(sums[filled], axis=1, keepdims=True), 1e-9)
    return own


def train_model(train: DataFrame, counts: DataFrame, updates: int = UPDATES, head_size: int = HEAD) -> Model:
    """Counts (word, c) must cover all of `train`; only the head of them comes to the driver."""
    spark = train.sparkSession
    total, kinds = counts.agg(F.sum("c"), F.count("*")).first()
    top = counts.filter(F.col("c") >= SEEN).orderBy(F.desc("c"), "word").limit(head_size).collect()
    head = Head(np.array([r["word"] for r in top], np.int64).view(np.uint64), np.array([r["c"] for r in top], np.int64))
    model, n = Model(head, int(total or 0), int(kinds)), len(head.words)
    axes = np.random.default_rng(3).standard_normal((4096, WIDTH)).astype(np.float32)
    shared = spark.sparkContext.broadcast(head)

    def around(out: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> None:
        at, (one, _) = shared.value.find(words), _history(words, bounds)
        after = np.append(words[1:], START)
        after[bounds[1:] - 1] = START
        left, right = ((mix(x) % np.uint64(4096)).astype(np.int64) for x in (one, after))
        for j in range(WIDTH):
            out[j * (n + 1) : (j + 1) * (n + 1)] += np.bincount(at, axes[left, j] + axes[right, (j + 1) % WIDTH], n + 1)

    projected = _summed(train, (n + 1) * WIDTH, around).reshape(WIDTH, n + 1)[:, :n].T
    head.classes = _clusters(projected, head.counts, CLASSES - 1).astype(np.int64) if n else head.classes
    model.start()
    shared.unpersist()

    rows, pair_at = sum(FEATURES) * CLASSES, sum(FEATURES) * CLASSES
    shared = spark.sparkContext.broadcast(head)

    def observe(out: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> None:
        at = shared.value.find(words)
        own = shared.value.class_of(at)
        for f in _features(*_history(words, bounds)):
            out[:rows] += np.bincount(f * CLASSES + own, minlength=rows)
        previous = np.empty_like(own)
        previous[1:] = own[:-1]
        previous[bounds[:-1]] = CLASSES
        known = at < n
        out[pair_at : pair_at + PAIRS] += np.bincount(_pair_bucket(previous[known], at[known]), minlength=PAIRS)
        out[pair_at + PAIRS :] += np.bincount(previous * CLASSES + own, minlength=(CLASSES + 1) * CLASSES)

    seen = _summed(train, rows + PAIRS + (CLASSES + 1) * CLASSES, observe)
    shared.unpersist()
    observed, pairs, steps = seen[:rows].reshape(-1, CLASSES), seen[pair_at : pair_at + PAIRS], seen[pair_at + PAIRS :].reshape(CLASSES + 1, CLASSES)

    # The word factor: expected pair counts need no further pass.
    for _ in range(updates):
        expected, every = np.zeros(PAIRS), np.arange(n)
        for previous in range(CLASSES + 1):
            bucket = _pair_bucket(np.full(n, previous), every)
            p = np.exp(model.word + model.pairs[bucket] - model.norm[previous, head.classes]) if n else np.zeros(0)
            expected += np.bincount(bucket, p * steps[previous, head.classes], PAIRS)
        model.pairs += _step(pairs, expected, PAIR_PRIOR, 1.0).astype(np.float32)
        model.normalise()

    # The class factor: the first gradient is in closed form, each later one is a pass.
    prior = PRIOR + 8.0 * model.share
    expected = observed.sum(axis=1, keepdims=True) * model.share
    model.weights += _step(observed, expected, prior, 0.6).astype(np.float32)
    for _ in range(updates - 1):
        shared_model = spark.sparkContext.broadcast(model)

        def expect(out: np.ndarray, histories: np.ndarray, times: np.ndarray, given=shared_model) -> None:
            given.value.add_expected(out.reshape(CLASSES, -1), histories, times)

        expected = _summed(train, rows, expect, keyed=_histories).reshape(CLASSES, -1).T
        model.weights += _step(observed, expected, prior, 0.6).astype(np.float32)
        shared_model.unpersist()
    return model


def _step(observed: np.ndarray, expected: np.ndarray, prior, rate: float) -> np.ndarray:
    """The gradient (observed less expected) over its expected size, bounded; as a logarithm where it is large."""
    return rate * np.clip(np.log((observed + prior) / (expected + prior)), -3, 3)


# --- scoring --------------------------------------------------------------------------------------


def score_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    importable(spark)
    split = with_split(docs)
    train = split.filter("NOT held_out")
    counts = cut_lineage(train.select("text").mapInArrow(_counts, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")))
    model = train_model(train, counts)
    shared, size = spark.sparkContext.broadcast(model), len(model.head.words)
    base = np.log10((model.head.counts + 0.5) / (model.total + 0.5 * (model.kinds + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for part, words, bounds in _batches(batches):
            logs, at = shared.value.score(words, bounds)
            known = at < size
            of_base = np.where(known, np.append(base, 0)[at], 0)
            tail = words[~known].view(np.int64)
            ends = np.concatenate([[0], np.cumsum(~known)])[bounds]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("held_out"), pa.array(np.arange(row, row + part.num_rows)), pa.array(np.diff(bounds)),
                    pa.array(np.add.reduceat(known, bounds[:-1]).astype(np.int64)), pa.array(np.add.reduceat(of_base, bounds[:-1])),
                    pa.array(np.add.reduceat(logs, bounds[:-1]) / np.log(10)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tail)),
                ],
                ["doc_id", "held_out", "row", "n_tokens", "n_known", "base_score", "score", "tail"],
            )
            row += part.num_rows

    kind = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base_score double, score double, tail array<long>"
    scored = cut_lineage(split.mapInArrow(run, kind))
    # Tail words meet their counts in a join; unseen ones have none.
    tail = scored.select("row", F.explode("tail").alias("word")).groupBy("row", "word").agg(F.count("*").alias("k"))
    c = F.coalesce("c", F.lit(0))
    of_tail = tail.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("more_known"),
        F.sum(F.col("k") * F.log10((c + 0.5) / (model.total + 0.5 * (model.kinds + 1)))).alias("more_base"),
        F.sum(F.col("k") * F.log10((c + 0.5) / float(model.tail_total + 0.5 * (model.tail_kinds + 1)))).alias("more_score"),
    )
    full = scored.drop("tail").join(of_tail, "row", "left")
    return full.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
