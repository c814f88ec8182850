"""Whitening of embeddings by shifted CholeskyQR.

Entries c become integers floor(64 c) + 1000000, so sums over all rows are exact and a
row is centred as (n x - S) / n, from integers.  The centred rows A are never stored or
moved: in every pass each task solves its rows through the triangular factors found so
far and adds up the Gram matrix of the result, d x d a task.  The factor of a pass is
the Cholesky factor of that matrix, shifted by a bound of its rounding errors while it is
far from well conditioned; passes repeat until the rows are orthonormal to ACCURATE,
which takes three for well-conditioned data.  R, the product of the factors, has A's
singular values and right vectors: these are the components, to working precision,
which an eigenvalue decomposition of the covariance alone does not give for small ones.

Rows with a null vector or null or non-finite entries are dropped.  Entries beyond
+-2**62 / 64 count as that, entries missing in a vector shorter than the longest as
0.  Deviations beyond a long's range are its greatest value.  Components whose spread is
within rounding of none (singular value up to RANK of the greatest) are not returned: a
single row, or equal rows only, give no rows at all, as does an empty table.  A null id
is kept; repeated rows count each; extra columns are ignored.  Signs are chosen so
that a component's greatest entry is positive.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatum.llm.common import empty_like, materialize, table

#: What entries are multiplied by, and what is added.
SCALE, SHIFT = 64, 1_000_000
#: Components at most; passes at most; rows that one product sums.
COMPONENTS, PASSES, BLOCK = 32, 10, 10_000
#: Greatest entry of the last Gram matrix less the identity, and least singular value
#: against the greatest.
ACCURATE, RANK = 1e-12, 1e-12
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
LONG = 2**63 - 1


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): whole vectors as integers, unusable ones dropped."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    edge = float(2**62)
    whole = lambda c: F.floor(F.least(F.greatest(F.floor(c * SCALE).cast("double"), F.lit(-edge)), F.lit(edge))) + SHIFT
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & ~F.exists("v", bad))
    return rows.select("vec_id", F.transform("v", lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c * SCALE) + SHIFT).otherwise(whole(c))).alias("x"))


class Centred:
    """Batches of rows as exact (n x - S) and as doubles (x - S / n)."""

    def __init__(self, n: int, sums: list[int], most: int):
        self.n, self.sums, self.d = n, sums, len(sums)
        self.reach = n * most + max(map(abs, sums), default=0)
        self.kind = np.int64 if self.reach < 2**62 else object

    def exact(self, batch: pa.RecordBatch) -> np.ndarray:
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, self.d)
        return x.astype(self.kind) * self.n - np.array(self.sums, self.kind)

    def doubles(self, exact: np.ndarray) -> np.ndarray:
        return (exact / self.n).astype(np.float64)

    def deviations(self, exact: np.ndarray) -> list[int]:
        wide = exact if self.d * self.reach**2 < 2**62 else exact.astype(object)
        return [min(int(s), LONG) for s in (wide * wide).sum(axis=1)]


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows times the inverse of each upper triangular factor, by substitution."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(r.shape[1]):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


def summed(rows: DataFrame, of) -> np.ndarray:
    """Sum over all rows of the Gram matrices of ``of(batch)``: a matrix a task, added
    row by row of the matrix."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                q = of(b)
                total = q.T @ q if total is None else total + q.T @ q
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "g"])

    def add(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": f["i"].iloc[:1], "g": [np.stack(f["g"].to_numpy()).sum(axis=0)]})

    parts = rows.mapInArrow(run, "i int, g array<double>").groupBy("i").applyInPandas(add, "i int, g array<double>")
    return np.array([r.g for r in sorted(parts.collect(), key=lambda r: r.i)])


def column_sums(rows: DataFrame, d: int, most: int) -> list[int]:
    """Exact sums of the entries."""

    def run(batches):
        total = [0] * d
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            x = x if most < 2**40 else x.astype(object)
            total = [t + int(s) for t, s in zip(total, x.sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(list(map(Decimal, total)), pa.decimal128(38, 0))], names=["i", "s"])

    parts = rows.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    return [int(r.s) for r in sorted(parts, key=lambda r: r.i)]


def root(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper triangular factor of a shifted Gram matrix; the shift doubles where
    rounding has left it indefinite."""
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(2 * shift, np.finfo(float).tiny)


def factor(rows: DataFrame, centred: Centred) -> tuple[np.ndarray, int]:
    """(R, passes): the triangular factor of all centred rows."""
    factors, total, unit = [], np.eye(centred.d), np.finfo(float).eps / 2
    for done in range(1, PASSES + 1):
        gram = summed(rows, lambda b: solved(centred.doubles(centred.exact(b)), factors))
        values = np.linalg.eigvalsh(gram)
        if values[-1] <= 0:
            return gram, done  # all rows are equal
        noise = 11 * (BLOCK * centred.d + centred.d * (centred.d + 1)) * unit * values[-1]
        r = root(gram, noise if values[0] < 100 * noise else 0.0)
        factors, total = [*factors, r], r @ total
        if np.abs(gram - np.eye(centred.d)).max() <= ACCURATE:
            break
    return total, done


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """OUT for every row and component."""
    spark = vectors.sparkSession
    rows = integers(vectors)
    size = lambda f: f(F.size("x"))
    rows = materialize(rows, "integers")
    top = F.array_max(F.transform("x", lambda c: F.abs(c)))
    head = rows.agg(F.count(F.lit(1)).alias("n"), size(F.max).alias("d"), size(F.min).alias("short"), F.max(top).alias("most")).first()
    if not head.n or not head.d:
        return empty_like(spark, OUT)
    if head.short < head.d:
        rows = rows.select("vec_id", F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(head.d) - F.size("x"))).alias("x"))
    n, most = head.n, max(head.most, SHIFT)
    centred = Centred(n, column_sums(rows, head.d, most), most)
    r, _ = factor(rows, centred)
    _, spread, axes = np.linalg.svd(r)
    keep = min(components, int((spread > RANK * spread[0]).sum())) if spread[0] > 0 else 0
    if not keep:
        return empty_like(spark, OUT)
    axes = axes[:keep] * np.sign(axes[np.arange(keep), np.abs(axes[:keep]).argmax(axis=1)])[:, None]
    weights = axes.T * (np.sqrt(n) / spread[:keep])
    explained = spread[:keep] ** 2 / (spread**2).sum()
    # rows are centred exactly, so whitened ones have mean zero
    spoiled = np.abs(summed(rows, lambda b: centred.doubles(centred.exact(b)) @ weights) / n - np.eye(keep)).max()

    def run(batches):
        for b in batches:
            exact = centred.exact(b)
            z, at = centred.doubles(exact) @ weights, pa.array(np.repeat(np.arange(b.num_rows), keep))
            m = b.num_rows * keep
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id").take(at), pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(m, n, np.int64)), pa.array(centred.deviations(exact), pa.int64()).take(at),
                pa.array(z.ravel()), pa.array(np.tile(explained, b.num_rows)), pa.array(np.full(m, spoiled)),
            ], names=[x.split(" ")[0] for x in OUT.split(", ")])

    return rows.mapInArrow(run, OUT)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
