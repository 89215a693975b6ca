"""Vector columns: padding, normalisation, cosine similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: width of the stored ticket vectors.
EMBEDDING_DIMENSION = 768


def dense_rows(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a batch as (row numbers, matrix) pairs, one per vector length; null rows left out."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    rows = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    if not len(rows):
        return []
    kept = vectors.drop_null()
    flat = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(kept.value_lengths().to_numpy(zero_copy_only=False))
    lengths = np.diff(ends, prepend=0)
    out = []
    for width in np.unique(lengths):
        mine = lengths == width
        at = (ends[mine] - width)[:, None] + np.arange(width)
        out.append((rows[mine], flat[at]))
    return out


def vector_normalize(vector: Column, dimension: int = EMBEDDING_DIMENSION) -> Column:
    """Cut or zero-pad to ``dimension`` and scale to length one; a zero vector stays as it is."""

    @F.arrow_udf("array<float>")
    def normalize(vectors: pa.Array) -> pa.Array:
        out = np.zeros((len(vectors), dimension), dtype=np.float64)
        for rows, matrix in dense_rows(vectors):
            width = min(matrix.shape[1], dimension)
            out[rows, :width] = matrix[:, :width]
        norms = np.sqrt((out * out).sum(axis=1))
        out /= np.where(norms > 0, norms, 1.0)[:, None]
        missing = ~vectors.is_valid().to_numpy(zero_copy_only=False)
        offsets = np.arange(0, len(vectors) + 1, dtype=np.int32) * dimension
        flat = pa.array(out.astype(np.float32).ravel())
        return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array(missing))

    return normalize(vector)


def cosine_to(vector: Column, query: list[float]) -> Column:
    """Cosine similarity to one query vector; null where it is not defined."""
    target = np.asarray(query, dtype=np.float64)
    length = float(np.sqrt((target * target).sum()))

    @F.arrow_udf("double")
    def similarity(vectors: pa.Array) -> pa.Array:
        out = np.full(len(vectors), np.nan)
        for rows, matrix in dense_rows(vectors):
            norms = np.sqrt((matrix * matrix).sum(axis=1)) * length
            if matrix.shape[1] == len(target):
                out[rows] = np.divide(matrix @ target, norms, out=np.full(len(rows), np.nan), where=norms > 0)
        return pa.array(out, from_pandas=True)

    return similarity(vector)
