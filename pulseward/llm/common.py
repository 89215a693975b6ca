"""What several operators share: staging, block-wise Arrow loops, hashing of words and shingles, row picking."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseward.session import scratch_path

#: Documents are worked on in blocks of about so many characters, whatever the size of an Arrow batch.
BLOCK_CHARS = 1 << 20
#: Words in a shingle of the near-duplicate operators.
SHINGLE_WORDS = 5

_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it again: cuts lineage and survives lost executors.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{label}")
    df.write.parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about BLOCK_CHARS characters; a longer document is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(column), 0), np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK_CHARS, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def map_blocks(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str, text: str = "text"
) -> DataFrame:
    """``mapInArrow`` over slices of bounded text; ``fn`` gives the columns of its slice's result."""

    def run(batches):
        for part in blocks(batches, text):
            out = fn(part)
            yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in [0, 1)."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * BLOCK_CHARS)
        _POWERS.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps, dtype=np.uint64))
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words (runs of anything but ASCII white space) of all texts, and words per text."""
    data = np.frombuffer(b"\n".join((t or "").lower().encode("utf-8", "surrogatepass") for t in texts) + b"\n", np.uint8)
    lengths = np.array([len((t or "").lower().encode("utf-8", "surrogatepass")) + 1 for t in texts], np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(ends) and len(starts) and ends[0] <= starts[0]:
        ends = ends[1:]
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    owner = np.searchsorted(np.cumsum(lengths), starts, "right")
    return hashes, np.bincount(owner, minlength=len(texts)).astype(np.int64)


def shingles(texts: list[str | None], words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``words`` words, the text each belongs to, and a hash of each text's whole word sequence.

    A text of fewer words is one shingle; one without any word has none.
    """
    hashes, counts = word_hashes(texts)
    first = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(hashes)) - first[owner]
    up, _ = powers(max(2, int(counts.max(initial=1)) + 2))
    whole = np.zeros(len(texts), np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[place + 1], out=sums[1:])
    whole = mix(sums[first + counts] - sums[first] + counts.astype(np.uint64))
    full = np.flatnonzero(place + words <= counts[owner])
    grams = np.zeros(len(full), np.uint64)
    for k in range(words):
        grams = mix(grams + hashes[full + k] * np.uint64(2 * k + 1))
    short = np.flatnonzero((counts > 0) & (counts < words))
    return np.concatenate((grams, whole[short])), np.concatenate((owner[full], short)), whole


def distinct(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each owner in order, their owners, and how often each occurred."""
    if not len(values):
        return values, owner, np.zeros(0, np.int64)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.flatnonzero(np.concatenate(([True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1]))))
    return values[new], owner[new], np.diff(np.concatenate((new, [len(values)])))


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def ordered(*columns: Column) -> Column:
    """A struct for ``min`` in which nulls come last."""
    return F.struct(*[c for x in columns for c in (x.isNull(), x)])


def pick_rows(docs: DataFrame, wanted: DataFrame, key: Column) -> DataFrame:
    """One row of ``docs`` for each (``doc_id``, ``key``) of ``wanted``, with the other columns of ``wanted`` added.

    Rows that repeat id and key are the same document; the window needs no shuffle beyond the join's.
    """
    columns = docs.columns
    extra = [c for c in wanted.columns if c not in ("doc_id", "key")]
    left = docs.withColumn("__key", key)
    right = wanted.select(
        F.col("doc_id").alias("__id"), F.col("key").alias("__want"), *[F.col(c).alias(f"__{c}") for c in extra]
    )
    same = (left["doc_id"].eqNullSafe(right["__id"])) & (left["__key"] == right["__want"])
    one = Window.partitionBy("__id", "__want").orderBy("__want")
    found = left.join(right, same).withColumn("__n", F.row_number().over(one)).where("__n = 1")
    return found.select(*columns, *[F.col(f"__{c}").alias(c) for c in extra])
