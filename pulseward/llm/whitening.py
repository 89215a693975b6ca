"""Whitening of embeddings: blockwise QR of the centred rows, then singular values of R by a bidiagonal qd solver.

Entries become whole numbers first, so counts, sums and centring are exact. Tasks reduce their rows to one triangular
factor each, factors merge a few at a time over rounds, and only the last one, of the size of the dimension, is solved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseward.llm.bidiagonal import right_singular
from pulseward.llm.common import staged

#: An entry c becomes floor(STEPS * c) + OFFSET.
STEPS, OFFSET = 64, 1_000_000
#: Components that are returned; factors that meet in one merge; rows that are reduced at a time.
COMPONENTS, FAN, ROWS = 16, 8, 4096
#: Components whose variance is below this share of the largest one have none that rounding can tell from zero.
LEAST_SHARE = 1e-13


@dataclass
class Whitening:
    """A fitted whitening: number and sums of the fit list, directions as columns, variances, their shares, and the error."""

    n: int
    sums: list[int]
    directions: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float


def whole_numbers(vector: Column) -> Column:
    """The vector's entries as whole numbers; null where it is null, is empty, or has a null or non-finite entry or one that no long holds."""
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < 2.0**56, F.lit(False)))  # a NaN is above all numbers
    numbers = F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS) + F.lit(OFFSET).cast("long"))
    return F.when((F.size(vector) > 0) & fine, numbers)


def prepared(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, x) of the rows that remain, and their dimension: the commonest one, of equally common ones the larger."""
    found = rows.select(F.col(id_col).alias("id"), whole_numbers(F.col(vector_col)).alias("x")).where("x is not null")
    sizes = found.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    size = sizes["size"] if sizes else 0
    return found.where(F.size("x") == size), size


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _slices(batches: Iterator[pa.RecordBatch], size: int, column: str = "x") -> Iterator[np.ndarray]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield _matrix(batch.slice(start, ROWS).column(column), size)


def exact_sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each dimension, as whole numbers."""

    def run(batches):
        for x in _slices(batches, size):
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(x)], pa.int64()), "s": pa.array([x.sum(0).tolist()], pa.list_(pa.int64()))})

    part = fit.select("x").mapInArrow(run, "n long, s array<long>")
    each = part.select("n", F.posexplode("s").alias("dimension", "s")).groupBy("dimension")
    total = each.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dimension").collect()
    return (int(total[0]["n"]), [int(r["s"]) for r in total]) if total else (0, [0] * size)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S``, exact: with longs where they hold it, else with Python's whole numbers."""
    largest = max(1, int(np.abs(x).max(initial=0)), max((abs(s) // max(1, n) for s in sums), default=0)) * max(1, n)
    if largest < 2**61:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def triangular_factor(fit: DataFrame, size: int, n: int, sums: list[int]) -> np.ndarray:
    """R of the QR factorisation of all centred rows: one factor per task, merged FAN at a time until one is left."""

    def reduce_rows(batches):
        r = None
        for x in _slices(batches, size):
            block = (centred(x, n, sums) / n).astype(np.float64)
            r = np.linalg.qr(block if r is None else np.vstack((r, block)), mode="r")
        if r is not None:
            at = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int64()), "r": pa.array([r.ravel().tolist()], pa.list_(pa.float64()))})

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        stack = np.vstack([np.asarray(r, np.float64).reshape(-1, size) for r in parts.sort_values("at")["r"]])
        return pd.DataFrame({"at": [int(key[0])], "r": [np.linalg.qr(stack, mode="r").ravel()]})

    schema = "at long, r array<double>"
    factors = staged(fit.select("x").mapInArrow(reduce_rows, schema), "factors")
    last = factors.agg(F.max("at")).first()[0]
    while last:
        group = F.floor(F.col("at") / FAN).cast("long")
        factors = staged(factors.groupBy(group).applyInPandas(merge, schema), "factors")
        last //= FAN
    row = factors.first()
    return np.asarray(row["r"], np.float64).reshape(-1, size) if row else np.zeros((0, size))


def _projected(x: np.ndarray, n: int, sums: list[int], scaled: np.ndarray) -> np.ndarray:
    return (centred(x, n, sums) / n).astype(np.float64) @ scaled


def identity_error(fit: DataFrame, size: int, n: int, sums: list[int], scaled: np.ndarray) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity.

    Rows are centred exactly before they are projected, so whitened rows have mean zero and need no centring of their own.
    """
    k = scaled.shape[1]

    def products(batches):
        total = np.zeros((k, k))
        for x in _slices(batches, size):
            z = _projected(x, n, sums, scaled)
            total += z.T @ z
        yield pa.RecordBatch.from_pydict({"g": pa.array([(total / n).ravel().tolist()], pa.list_(pa.float64()))})

    each = fit.select("x").mapInArrow(products, "g array<double>").select(F.posexplode("g").alias("at", "g"))
    cells = each.groupBy("at").agg(F.sum("g").alias("g")).collect()  # the square of the number of components
    whole = np.zeros(k * k)
    for row in cells:
        whole[row["at"]] = row["g"]
    return float(np.abs(whole.reshape(k, k) - np.eye(k)).max(initial=0.0))


def fit_whitening(found: DataFrame, size: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of the distinct vectors of ``found`` (x, all of dimension ``size``)."""
    fit = staged(found.select("x").distinct(), "fit-list")
    n, sums = exact_sums(fit, size)
    r = triangular_factor(fit, size, n, sums)
    square = np.zeros((size, size))
    square[: len(r)] = r
    values, vectors = right_singular(square)
    variances = values / max(1, n)
    trace = float((r * r).sum()) / max(1, n)
    kept = int((variances[:components] > LEAST_SHARE * variances.max(initial=0.0)).sum())
    variances, vectors = variances[:kept], vectors[:, :kept]
    scaled = vectors / np.sqrt(variances)
    error = identity_error(fit, size, n, sums, scaled) if kept else 0.0
    return Whitening(n, sums, vectors, variances, variances / trace if kept else variances, error)


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per remaining row and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Rows go whose vector is null or empty, has null or non-finite entries or entries beyond what a long holds, or has
    another length than most (of equally common lengths the larger stays). Repeated vectors count once in the fit and
    are whitened each. Components without variance are left out, all of them where only one vector is distinct; an empty
    table gives none. ``deviation`` is null where no long holds it. Other columns are ignored.
    """
    found, size = prepared(rows, id_col, vector_col)
    model = fit_whitening(found, size, components)
    scaled, k = model.directions / np.sqrt(model.variances), len(model.variances)
    n, sums, explained, error = model.n, model.sums, model.explained, model.identity_error

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                x = _matrix(part.column("x"), size)
                from_mean = centred(x, n, sums)
                # Squares of Python numbers are exact; longs are taken where a row's sum of squares fits.
                narrow = from_mean.dtype != object and int(np.abs(from_mean).max(initial=0)) ** 2 * size < 2**63
                squares = (from_mean * from_mean if narrow else from_mean.astype(object) ** 2).sum(1)
                deviation = [int(v) if v < 2**63 else None for v in squares.tolist()]
                whitened = _projected(x, n, sums, scaled)
                m = len(x)
                yield pa.RecordBatch.from_pydict(
                    {
                        id_col: part.column("id").take(pa.array(np.repeat(np.arange(m), k))),
                        "component": pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                        "n": pa.array(np.full(m * k, n), pa.int64()),
                        "deviation": pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        "whitened": pa.array(whitened.ravel(), pa.float64()),
                        "explained": pa.array(np.tile(explained, m), pa.float64()),
                        "identity_error": pa.array(np.full(m * k, error), pa.float64()),
                    }
                )

    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return found.mapInArrow(run, schema)
