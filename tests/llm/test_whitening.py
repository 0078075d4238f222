import math

import numpy as np
import pytest

from usagelens.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def brute_force(vectors, components=8):
    """Per vector (deviation, whitened up to the sign of each axis), with the share of every axis."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(r, sums, strict=True)] for r in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:components]
    return n, deviation, centred @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_query(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    n, deviation, whitened, share = brute_force([r["embedding"] for r in rows])
    got = queries.QUERIES["op11_embedding_whitening"](spark, SF).collect()
    assert len(got) == 8 * n and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    place = {r["vec_id"]: i for i, r in enumerate(rows)}
    found = np.zeros((n, 8))
    for r in got:
        i, c = place[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation[i] and abs(r["explained"] / share[c] - 1) < 1e-9
        found[i, c] = r["whitened"]
    for c in range(8):
        assert min(np.abs(found[:, c] - whitened[:, c]).max(), np.abs(found[:, c] + whitened[:, c]).max()) < 1e-6


def test_several_blocks_give_the_same(spark, monkeypatch):
    vectors = np.random.default_rng(3).normal(size=(100, 5)) * [9, 5, 3, 2, 1]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(6)
    monkeypatch.setattr(whitening, "ROWS", 16)
    done, fitted = whitening.whiten(rows)
    n, _, want, share = brute_force(vectors, 5)
    assert fitted["n"] == n and np.allclose(fitted["explained"], share) and fitted["identity_error"] < 1e-9
    for r in done.collect():
        assert np.allclose(np.abs(r["whitened"]), np.abs(want[r["key"]]), atol=1e-9)


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 2.0]), (2, [1.5, -2.0]), (2, [1.5, -2.0]), (None, [0.0, 0.5]), (3, None), (4, []), (5, [1.0, None]), (6, [nan, 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], "vec_id long, embedding array<double>, key string, x string")
    got = whitening.whitened_rows(frame).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2)]
    assert {r["n"] for r in got} == {4} and got[0]["identity_error"] < 1e-9
    assert len({r["whitened"] for r in got if r["vec_id"] == 2 and r["component"] == 1}) == 1


@pytest.mark.parametrize("vectors, components", [([[1.0, 2.0]], 0), ([[1.0, 2.0]] * 3, 0), ([[1.0, 1.0], [2.0, 2.0], [4.0, 4.0]], 1)])
def test_directions_without_variance(spark, vectors, components):
    got = whitening.whitened_rows(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")).collect()
    assert len(got) == components * len(vectors)


def test_without_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert whitening.whitened_rows(empty).count() == 0
    assert whitening.whitened_rows(empty).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_a_deviation_that_does_not_fit_is_null(spark):
    got = whitening.whitened_rows(spark.createDataFrame([(1, [1e9]), (2, [0.0])], "vec_id long, embedding array<double>")).collect()
    assert [r["deviation"] for r in got] == [None, None]
