import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest

from usagelens.llm import language_model as M

SF = "/root/testdata/sf0.001"


def some_model(classes=M.CLASSES):
    rng = np.random.default_rng(4)
    words = np.unique(rng.integers(1, 2**63, 300, dtype=np.uint64))
    head = M.Head(words, rng.integers(3, 90, len(words)))
    head.classes = rng.integers(0, classes - 1, len(words))
    model = M.Model(head, int(head.counts.sum()) + 500, len(words) + 200)
    model.weights = rng.normal(0, 0.5, model.weights.shape).astype(np.float32)
    model.pairs = rng.normal(0, 0.5, M.PAIRS).astype(np.float32)
    model.start()
    return model


def some_words(n=900):
    rng = np.random.default_rng(5)
    kinds = rng.integers(1, 2**63, 40, dtype=np.uint64)
    bounds = np.array([0, 1, 4, 300, 300 + n // 3, n])
    return kinds[rng.integers(0, len(kinds), n)], bounds


def test_expected_features_equal_one_word_at_a_time(monkeypatch):
    model, (words, bounds) = some_model(), some_words()
    want = np.zeros((M.CLASSES, sum(M.FEATURES)))
    for features in zip(*M._features(*M._history(words, bounds)), strict=True):
        z = np.exp(model.bias + model.weights[list(features)].sum(axis=0)).astype(np.float64)
        for f in features:
            want[:, f] += z / z.sum()
    histories, times = np.unique(M._histories(words, bounds), return_counts=True)
    assert len(histories) < len(words)
    for rows, close in ((M._ROWS, M._CLOSE), (100, 7), (64, 64), (1, 1)):
        monkeypatch.setattr(M, "_ROWS", rows)
        monkeypatch.setattr(M, "_CLOSE", close)
        got = np.zeros_like(want)
        model.add_expected(got, histories, times)
        assert np.allclose(got, want, rtol=1e-4, atol=1e-5)


def test_histories_keep_their_features():
    words, bounds = some_words()
    found = M._of_history(M._histories(words, bounds))
    assert all((a == b).all() for a, b in zip(found, M._features(*M._history(words, bounds)), strict=True))


def test_probabilities_sum_to_one():
    model, (words, bounds) = some_model(), some_words()
    mass = model.class_masses(M._features(*M._history(words, bounds)))
    assert np.allclose((mass / mass.sum(axis=1, keepdims=True)).sum(axis=1), 1, atol=1e-5)
    every = np.arange(len(model.head.words))
    for previous in (0, 5, M.CLASSES):
        p = np.exp(model.word + model.pairs[M._pair_bucket(np.full(len(every), previous), every)] - model.norm[previous, model.head.classes])
        sums = np.bincount(model.head.classes, p, M.CLASSES)
        assert np.allclose(sums[np.unique(model.head.classes)], 1)


def base_scores(rows):
    """Plain Python: what the base columns are by definition, by row."""

    def tokens(text):
        lower = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for space in "\t\n\v\f\r":
            lower = lower.replace(space, " ")
        return [w for w in lower.split(" ") if w] + [None]

    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    seen = Counter(w for (_, text), out in zip(rows, held, strict=True) if not out for w in tokens(text))
    n, v = sum(seen.values()), len(seen)
    return [
        (i, out, len(tokens(text)), sum(w in seen for w in tokens(text)), n, sum(log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(text)))
        for (i, text), out in zip(rows, held, strict=True)
    ]


def order(row):
    return (row[0] is None, row[0] or 0, row[2], row[5])


def check(docs):
    got = M.score_documents(docs).collect()
    want = base_scores([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=order)
    assert [r[:5] for r in got] == [r[:5] for r in sorted(want, key=order)]
    assert np.allclose([r[5] for r in got], [r[5] for r in sorted(want, key=order)])
    assert all(np.isfinite(r[6]) and r[6] < 0 for r in got)
    return got


@pytest.mark.parametrize("held", [M._HELD, 50])
def test_odd_rows(spark, monkeypatch, held):
    monkeypatch.setattr(M, "_HELD", held)
    long = " ".join(f"w{i % 97} Same" for i in range(4000))
    rows = [(1, None, 1, "x"), (2, "", 2, None), (None, "a b c", 3, "x"), (3, "A b\ta", 4, "x"), (3, "A b\ta", 4, "x"), (4, long, 5, "x"), (5, "neu " * 9, 6, "x")]
    check(spark.createDataFrame(rows, "doc_id long, text string, score long, word string"))


def test_empty_table(spark):
    assert M.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_table_and_gain_on_held_out_texts(spark):
    got = check(spark.read.parquet(f"{SF}/documents.parquet"))
    out = [r for r in got if r[1]]
    assert sum(r[6] for r in out) > sum(r[5] for r in out)


def test_an_end_follows_every_text():
    texts = pa.array(["One two", None, "", "two one two"])
    words, bounds = M._sequence(texts)
    assert bounds.tolist() == [0, 3, 4, 5, 9] and words[0] == words[6] and words[1] == words[5] == words[7] and (words[bounds[1:] - 1] == M.END).all()
