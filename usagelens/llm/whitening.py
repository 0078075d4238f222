"""Whitening of embeddings with distributed block matrices.

Entries become whole numbers (floor of `SCALE` times the entry, plus `SHIFT`), so their sums per dimension are exact. The rows, centred by those
sums, are numbered without gaps and dealt into a BlockMatrix of `ROWS` rows a block. Its transpose times itself is the scatter
matrix, the only thing that reaches the driver (d x d for d dimensions, at most `WIDEST`); there its eigenvectors are found, and the
BlockMatrix times eigenvectors over root eigenvalues projects all rows. How far the covariance of the projected rows is from the identity is
measured on the projected rows themselves.

A row whose vector is null, empty, or holds a null or non-finite entry is left out, and so is one whose length is not that of most rows (of the longer
one at a tie). Repeated rows are rows of their own; a null key is passed through; other columns are ignored, whatever their names. Directions without variance (an
eigenvalue below `FLAT` of the largest; all of them if there is one row) are no components, since nothing can be scaled to variance one
there. Where (n*x-S)^2 does not fit 64 bits, `deviation` is null. Without a usable row there are no rows. An entry times `SCALE` beyond 64 bits is cut off there.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, functions as F

from usagelens.session import cut_lineage

SCALE, SHIFT = 1024, 100_000
#: Rows of a block.
ROWS = 4096
#: The driver holds matrices of this many dimensions squared (128 MB).
WIDEST = 4096
#: Eigenvalues below this share of the largest count as none.
FLAT = 1e-12


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and the whole numbers x of all rows that have a full vector of the common length."""
    entries = F.col(vector).cast("array<double>")
    rows = rows.select(F.col(key).cast("long").alias("key"), entries.alias("v")).where(
        "v IS NOT NULL AND size(v) > 0 AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))"
    )
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    return rows.where(F.size("v") == d).selectExpr("key", f"transform(v, c -> CAST(floor({SCALE} * c) AS BIGINT) + {SHIFT}L) AS x")


def numbered(rows: DataFrame) -> DataFrame:
    """`rows`, written once, with `index` from 0 without gaps. Only a count per written task meets in one place."""
    spark = rows.sparkSession
    placed = cut_lineage(rows.withColumn("id", F.monotonically_increasing_id())).withColumn("task", F.expr("shiftright(id, 33)"))
    base, before = [], 0
    for r in placed.groupBy("task").count().orderBy("task").collect():
        base.append((r["task"], before))
        before += r["count"]
    bases = spark.createDataFrame(base, "task long, base long")
    # Within a task the numbers have no gaps; the low 33 bits are the place in it.
    return placed.join(F.broadcast(bases), "task").selectExpr("*", "base + (id & 8589934591L) AS index").drop("task", "base", "id")


def times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """The product, with the middle dimension dealt over `splits` tasks; a tall matrix times its transpose would else meet in one."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def _axes(scatter: np.ndarray, n: int, components: int | None) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues by size, their unit vectors as columns, and the trace of the covariance."""
    covariance = (scatter + scatter.T) / 2 / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    stay = min(len(values) if components is None else components, int((values > FLAT * max(values[0], 0.0)).sum()) if values[0] > 0 else 0)
    return values[:stay], vectors[:, :stay], float(np.trace(covariance))


def whiten(rows: DataFrame, components: int | None = None, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, dict]:
    """(key, x, whitened) of every usable row, one entry of `whitened` per component by falling eigenvalue (all directions if
    `components` is None), and what was fitted: n, sums per dimension, eigenvalues, explained, identity_error."""
    spark = rows.sparkSession
    whole = numbered(usable(rows, key, vector))
    sums = {r["pos"]: (r["n"], r["s"]) for r in whole.select(F.posexplode("x").alias("pos", "c")).groupBy("pos").agg(F.count("*").alias("n"), F.sum("c").alias("s")).collect()}
    none = whole.selectExpr("key", "x", "CAST(array() AS array<double>) AS whitened").limit(0)
    if not sums:
        return none, {"n": 0, "sums": [], "eigenvalues": [], "explained": [], "identity_error": 0.0}
    d, n = len(sums), sums[0][0]
    if d > WIDEST:
        raise ValueError(f"{d} dimensions; at most {WIDEST}")
    totals = [sums[i][1] for i in range(d)]
    array = f"array({', '.join(f'{s}L' for s in totals)})"
    # x - S/n to full precision: the whole parts are taken off before anything is divided.
    centred = f"transform(zip_with(x, {array}, (a, s) -> struct(a - s div {n}L AS whole, s % {n}L AS rest)), p -> p.whole - p.rest / CAST({n} AS DOUBLE))"
    vectors = MLUtils.convertVectorColumnsFromML(whole.select("index", array_to_vector(F.expr(centred)).alias("vector")), "vector")
    matrix = IndexedRowMatrix(vectors, n, d).toBlockMatrix(ROWS, d)
    splits = max(1, min(-(-n // ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    scatter = times(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()
    values, axes, trace = _axes(scatter, n, components)
    stats = {"n": n, "sums": totals, "eigenvalues": values.tolist(), "explained": (values / trace).tolist() if len(values) else [], "identity_error": 0.0}
    if not len(values):
        return none, stats
    scaled = axes / np.sqrt(values)
    k = len(values)
    projector = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(d, k, scaled.ravel(order="F")))], 1), d, k, d, k)
    projected = times(matrix, projector, 1).blocks.flatMap(lambda b: [(int(b[0][0]) * ROWS + i, row) for i, row in enumerate(b[1].toArray().tolist())])
    projected = cut_lineage(spark.createDataFrame(projected, "index long, whitened array<double>"))
    stats["identity_error"] = _identity_error(projected, n, k)
    return whole.join(projected, "index").select("key", "x", "whitened"), stats


def _identity_error(projected: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the covariance of `whitened` (centred, divisor n) minus the identity."""
    mean = projected.agg(*(F.avg(F.col("whitened")[i]) for i in range(k))).first()
    off = projected.select(*((F.col("whitened")[i] - F.lit(mean[i])).alias(f"c{i}") for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = off.agg(*(F.sum(F.col(f"c{i}") * F.col(f"c{j}")) for i, j in pairs)).first()
    return max(abs(v / n - (i == j)) for (i, j), v in zip(pairs, found, strict=True))


def whitened_rows(rows: DataFrame, components: int = 8) -> DataFrame:
    """A row per usable vector and component."""
    done, fitted = whiten(rows, components)
    n = fitted["n"]
    array = f"array({', '.join(f'{s}L' for s in fitted['sums'])})" if fitted["sums"] else "CAST(array() AS array<bigint>)"
    deviation = f"aggregate(zip_with(x, {array}, (a, s) -> try_subtract(try_multiply({n}L, a), s)), 0L, (t, v) -> try_add(t, try_multiply(v, v)))"
    explained = f"CAST(array({', '.join(f'{v!r}D' for v in fitted['explained'])}) AS array<double>)"
    return done.selectExpr("key AS vec_id", f"{deviation} AS deviation", "posexplode(whitened) AS (at, whitened)").selectExpr(
        "vec_id", "CAST(at + 1 AS INT) AS component", f"{n}L AS n", "deviation", "whitened", f"{explained}[at] AS explained", f"{fitted['identity_error']!r}D AS identity_error"
    )
