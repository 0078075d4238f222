"""Quality and toxicity from weak labels.

Overlapping heuristics vote good, bad or nothing on every document. Their accuracies are unknown:
expectation-maximisation estimates, for every labeller, how often it votes what on truly good and truly bad
documents, from how the votes of all documents fall together (a table of at most 3^labellers rows). The posterior
of a document's votes is its soft label. Soft labels of a bounded sample train a hashed linear scorer, which
scores every document: quality by the share of word shapes, toxicity by the words that occur.

Null text is empty; a text without words has no features and gets the scorer's bias. A null doc_id is passed
through; repeated rows get equal results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from usagelens.llm.common import SPACE, importable, mix, slices, text_bytes, word_bounds, word_hashes
from usagelens.session import cut_lineage

#: Documents that train the scorer, at most; every document votes, is counted and is scored.
TRAIN_ROWS = 8_000
#: Width of the hashed features.
WIDTH = 1 << 16

#: Words that insult.
INSULTS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")

_T = "coalesce(text, '')"
_W = f"filter(split({_T}, '{SPACE}+'), x -> x != '')"
_HIT = "size(regexp_extract_all(lower(" + _T + r"), '(?<![a-z])(?:{words})(?![a-z])', 0))"

#: labeller -> SQL of its vote: 1 good, 0 bad, null nothing. `n` is the number of words, `w` the words.
QUALITY_VOTES = {
    "length": "CASE WHEN n < 10 THEN 0 WHEN n BETWEEN 20 AND 100000 THEN 1 END",
    "symbols": "CASE WHEN symbols > 0.1 * chars THEN 0 WHEN symbols < 0.02 * chars THEN 1 END",
    "capitals": "CASE WHEN capitals > 0.3 * chars THEN 0 WHEN capitals < 0.12 * chars THEN 1 END",
    "variety": "CASE WHEN distinct_words < 0.35 * n AND n < 2000 THEN 0 WHEN distinct_words > 0.5 * n THEN 1 END",
    "neighbours": "CASE WHEN 10 * same_next > n THEN 0 WHEN 100 * same_next < 3 * n THEN 1 END",
    "sentences": "CASE WHEN 60 * stops < n AND n > 60 THEN 0 WHEN stops BETWEEN 0.02 * n AND 0.34 * n THEN 1 END",
}
TOXIC_VOTES = {
    "first_half": "CASE WHEN hits_a > 0 THEN 0 END",
    "second_half": "CASE WHEN hits_b > 0 THEN 0 END",
    "several": "CASE WHEN hits_a + hits_b > 1 THEN 0 END",
}
_SIGNS = {
    "n": "size(__w)",
    "chars": "char_length(array_join(__w, ''))",
    "symbols": f"size(regexp_extract_all({_T}, '[#*$%&|<>!]', 0))",
    "capitals": f"size(regexp_extract_all({_T}, '\\\\p{{Lu}}', 0))",
    "distinct_words": "size(array_distinct(__w))",
    "same_next": "size(filter(__w, (x, i) -> i > 0 AND x = __w[greatest(0, i - 1)]))",
    "stops": "size(filter(__w, x -> x RLIKE '[.?!]$'))",
    "hits_a": _HIT.replace("{words}", "|".join(INSULTS[::2])),
    "hits_b": _HIT.replace("{words}", "|".join(INSULTS[1::2])),
}


def with_votes(docs: DataFrame, votes: dict[str, str], name: str) -> DataFrame:
    """`docs` and one column per labeller, packed as a string of 1, 0 and -."""
    wide = docs.withColumn("__w", F.expr(_W)).select("*", *[F.expr(sql).alias(f"__{k}") for k, sql in _SIGNS.items()])

    def over(sql: str) -> str:
        for k in sorted(_SIGNS, key=len, reverse=True):
            sql = " ".join(f"__{k}" if x.strip("()") == k else x.replace(f"({k}", f"(__{k}") for x in sql.split(" "))
        return sql

    packed = F.concat(*[F.expr(f"coalesce(CAST({over(sql)} AS STRING), '-')") for sql in votes.values()])
    return wide.select(*[F.col(f"`{c}`") for c in docs.columns], packed.alias(name))


def estimate(patterns: list[tuple[str, int]], rounds: int = 100) -> tuple[dict[str, float], np.ndarray]:
    """EM over vote patterns and their counts: posterior of `good` per pattern, and each labeller's chances
    [labeller, truth, vote]. A labeller that votes nothing says nothing."""
    if not patterns:
        return {}, np.zeros((0, 2, 2))
    votes = np.array([["01-".index(c) for c in p] for p, _ in patterns])
    weight = np.array([n for _, n in patterns], float)
    labellers = votes.shape[1]
    ones, zeros = (votes == 1).sum(axis=1), (votes == 0).sum(axis=1)
    # Begin from the votes themselves: a bad vote is rarer, so it counts for more.
    posterior = (ones + 0.8) / (ones + 3 * zeros + 1)
    chances = np.zeros((labellers, 2, 2))
    for _ in range(rounds):
        share = np.clip((posterior @ weight + 1) / (weight.sum() + 2), 1e-6, 1 - 1e-6)
        logs = np.tile(np.log([1 - share, share]), (len(votes), 1))
        for j in range(labellers):
            cast = votes[:, j] < 2
            for truth, p in ((0, 1 - posterior), (1, posterior)):
                mass = np.bincount(votes[cast, j], (p * weight)[cast], 2) + 0.5
                chances[j, truth] = mass / mass.sum()
            logs[cast] += np.log(chances[j][:, votes[cast, j]]).T
        posterior = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
    return {p: float(x) for (p, _), x in zip(patterns, posterior, strict=True)}, chances


def soft_labels(docs: DataFrame, votes: dict[str, str], labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, posterior, labelled): the chance that a document is good, from the votes of all documents.

    `labels` (doc_id, vote) are one more labeller, who votes where there is a row.
    """
    voted = with_votes(docs.select("doc_id", "text"), votes, "__votes").select("doc_id", "__votes")
    if labels is not None:
        one = labels.groupBy("doc_id").agg(F.min("vote").cast("int").cast("string").alias("__label"))
        voted = voted.join(one, "doc_id", "left").select("doc_id", F.concat("__votes", F.coalesce("__label", F.lit("-"))).alias("__votes"))
    voted = cut_lineage(voted)
    counts = [(r[0], r[1]) for r in voted.groupBy("__votes").count().collect()]  # at most 3^labellers rows
    posterior, _ = estimate(sorted(counts))
    table = docs.sparkSession.createDataFrame(sorted(posterior.items()), "__votes string, posterior double")
    return voted.join(F.broadcast(table), "__votes", "left").select("doc_id", "posterior", (~F.col("__votes").endswith("-")).alias("labelled"))


# --- the scorer -----------------------------------------------------------------------------------

_SHAPE = np.full(256, ord("a"), np.uint8)
_SHAPE[:128] = np.arange(128)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")


_LOW = np.arange(256, dtype=np.uint8)
_LOW[ord("A") : ord("Z") + 1] += 32
#: Signs inside or after a word do not make it another one.
for _c in b".,;:!?'\"()":
    _LOW[_c] = 0


def _features(texts: pa.Array, kind: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its hashed features and their values, at most WIDTH of them."""
    out = []
    raw, o = text_bytes(texts)
    s, e = word_bounds(raw, o)
    bounds = np.searchsorted(s, o)
    if kind == "words":
        # Every word, and its first four and seven bytes, so that new compounds of known beginnings count.
        packed = np.zeros(len(s), np.uint64)
        for j in range(8):
            packed |= np.where(s + j < e, _LOW[raw[np.minimum(s + j, e - 1)]], 0).astype(np.uint64) << np.uint64(8 * j)
        whole, _ = word_hashes(texts)
        keys = np.stack([whole, mix(packed & np.uint64(0xFFFFFFFF)), mix((packed & np.uint64(0xFFFFFFFFFFFFFF)) + np.uint64(1))], axis=1) % np.uint64(WIDTH)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            f = np.unique(keys[lo:hi]).astype(np.int64)
            out.append((f, np.ones(len(f), np.float32)))
        return out
    if len(s):
        # First and last three characters by shape, whether the word repeats the one before, and its length.
        last = [_SHAPE[raw[np.maximum(s, e - 1 - j)]].astype(np.int64) for j in range(3)]
        head = [_SHAPE[raw[np.minimum(s + j, e - 1)]].astype(np.int64) for j in range(2)]
        hashes, _ = word_hashes(texts)
        same = np.concatenate([[0], hashes[1:] == hashes[:-1]]).astype(np.int64)
        key = ((((last[0] * 131 + last[1]) * 131 + last[2]) * 131 + head[0]) * 131 + head[1]) * 2 + same
        keys = key % (WIDTH - 64)
        length = WIDTH - 64 + np.minimum(e - s, 31)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi == lo:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.float32)))
            continue
        f, n = np.unique(np.concatenate([keys[lo:hi], length[lo:hi]]), return_counts=True)
        size = WIDTH - 32 + min(31, int(np.log2(hi - lo) * 2))
        out.append((np.append(f, size), np.append(np.sqrt(n / (hi - lo)), 1.0).astype(np.float32)))
    return out


def telling(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, share: float = 0.6) -> np.ndarray:
    """Features that most often come with bad documents: their smoothed share of bad ones is at least `share`."""
    index = np.concatenate([np.zeros(0, np.int64), *(f for f, _ in rows)])
    row = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    bad = np.bincount(index, (1 - target)[row], WIDTH)
    return bad / (np.bincount(index, minlength=WIDTH) + 2) >= share


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = 40, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by full gradients with AdaGrad steps; both sides weigh the same."""
    weights, bias, squares = np.zeros(WIDTH), 0.0, np.full(WIDTH, 1e-6)
    if not rows:
        return weights, bias
    index, value = np.concatenate([f for f, _ in rows]), np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    balance = np.where(target > 0.5, 0.5 / max(1e-3, (target > 0.5).mean()), 0.5 / max(1e-3, (target <= 0.5).mean()))
    for _ in range(epochs):
        z = np.bincount(row, weights[index] * value, len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * balance / len(rows)
        gradient = np.bincount(index, error[row] * value, WIDTH) + decay * weights
        squares += gradient**2
        weights -= rate * gradient / np.sqrt(squares)
        bias -= rate * error.sum()
    return weights, bias


def _trained(docs: DataFrame, votes: dict[str, str], kind: str, labels: DataFrame | None) -> tuple[np.ndarray, float]:
    labelled = soft_labels(docs, votes, labels)
    if labels is not None:
        labelled = labelled.filter("labelled")
    share = min(1.0, TRAIN_ROWS / max(1, labelled.count()))
    chosen = labelled.sample(share, seed=13).limit(TRAIN_ROWS).dropDuplicates(["doc_id"])
    sample = docs.join(F.broadcast(chosen), "doc_id")  # at most TRAIN_ROWS ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = _features(part.column("text"), kind)
                yield pa.RecordBatch.from_arrays([part.column("posterior"), pa.array([f.astype(np.int32) for f, _ in rows], pa.list_(pa.int32())), pa.array([v for _, v in rows], pa.list_(pa.float32()))], ["posterior", "f", "v"])

    table = sample.select("text", "posterior").mapInArrow(run, "posterior double, f array<int>, v array<float>").toArrow()
    # Views of the Arrow buffers: as Python lists the sample would take ten times the driver's memory.
    f, v = (table.column(k).combine_chunks() for k in ("f", "v"))
    index, value, ends = f.flatten().to_numpy(), v.flatten().to_numpy(), f.offsets.to_numpy()
    ends = ends - (ends[0] if len(ends) else 0)
    rows = [(index[lo:hi], value[lo:hi]) for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
    target = table.column("posterior").to_numpy()
    if kind == "words":  # words are many and most say nothing: only the telling ones are fitted
        keep = telling(rows, target)
        rows = [(f[keep[f]], v[keep[f]]) for f, v in rows]
    return fit(rows, target)


def classify(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """`labels` (doc_id, quality, toxic) may cover some documents; they are one labeller more, and then the
    scorers are fitted on documents that have one. Per document: doc_id, p_good and p_clean by the scorers, and kept if both are above one half."""
    importable(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    good = None if labels is None else labels.selectExpr("doc_id", "quality AS vote").filter("vote IS NOT NULL")
    clean = None if labels is None else labels.selectExpr("doc_id", "1 - toxic AS vote").filter("vote IS NOT NULL")
    models = {"shapes": _trained(rows, QUALITY_VOTES, "shapes", good), "words": _trained(rows, TOXIC_VOTES, "words", clean)}
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                scores = []
                for kind, (weights, bias) in shared.value.items():
                    z = np.array([weights[f] @ v for f, v in _features(part.column("text"), kind)]) + bias
                    scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, scores), pa.array((scores[0] >= 0.5) & (scores[1] >= 0.5))], ["doc_id", "p_good", "p_clean", "kept"])

    return rows.mapInArrow(run, "doc_id long, p_good double, p_clean double, kept boolean")
