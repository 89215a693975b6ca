"""Text to vector: a hook for a model, and a lexical feature hash as the default."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseward.functions.vectors import EMBEDDING_DIMENSION

WORD = re.compile(r"[^\W_]+")


MAX_KNOWN_WORDS = 1 << 20

# Words that are counted together, for which a text counts as so many more.
COUNTED_WORDS, TEXT_WORDS = 1 << 22, 1 << 9


class WordBuckets(dict):
    """Bucket of every word met so far; starts over when it has grown too large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_KNOWN_WORDS:
            self.clear()
        bucket = int(hashlib.md5(word.encode("utf-8")).hexdigest()[:8], 16) % EMBEDDING_DIMENSION
        self[word] = bucket
        return bucket


BUCKETS = WordBuckets()


def hash_vectors(texts: list[str]) -> np.ndarray:
    """Word counts hashed into a fixed number of buckets, scaled to length one."""
    out = np.zeros((len(texts), EMBEDDING_DIMENSION))
    for i, text in enumerate(texts):
        words = WORD.findall(text.lower())
        buckets = np.fromiter(map(BUCKETS.__getitem__, words), dtype=np.int64, count=len(words))
        out[i] = np.bincount(buckets, minlength=EMBEDDING_DIMENSION)
    norms = np.sqrt((out * out).sum(axis=1))
    return out / np.where(norms > 0, norms, 1.0)[:, None]


def hash_embed_text(text: str) -> list[float]:
    """The vector of one query text; a blank text gives the zero vector."""
    return hash_vectors([text.strip()])[0].tolist()


def embed_with(load_model: Callable[[], Callable[[list[str]], np.ndarray]], text: Column) -> Column:
    """Embed a text column with a model that each task loads once and applies batch by batch."""

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load_model()
        for batch in batches:
            texts = ["" if t is None else t for t in batch.to_pylist()]
            matrix = np.asarray(model(texts), dtype=np.float32).reshape(len(texts), -1)
            offsets = np.arange(0, len(texts) + 1, dtype=np.int32) * matrix.shape[1]
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))

    return embed(text)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def text_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def counted_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of ``words`` in parts whose texts after the first have so many words at most."""
    part = np.cumsum(pc.list_value_length(batch["words"]).to_numpy().astype(np.int64) + TEXT_WORDS) // COUNTED_WORDS
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for start, stop in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(start, stop - start)


def bucket_weights(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The filled places of the vectors of ``sparse_embed``, scaled to length one as doubles: row, bucket and weight, by row.

    A word that comes often is hashed once.
    """
    coded = words.flatten().dictionary_encode()
    buckets = np.fromiter(map(BUCKETS.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(coded.dictionary))
    row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy())
    counts = np.bincount(row * EMBEDDING_DIMENSION + buckets[coded.indices.to_numpy()])
    filled = np.flatnonzero(counts)
    row, bucket = np.divmod(filled, EMBEDDING_DIMENSION)
    counts = counts[filled].astype(np.float64)
    # Vectors are single floats; bincount adds one by one, as a fold over the vector does.
    values = (counts / np.sqrt(np.bincount(row, counts * counts))[row]).astype(np.float32).astype(np.float64)
    return row, bucket, values / np.sqrt(np.bincount(row, values * values))[row]


def sparse_embed(text: Column) -> Column:
    """The vector of ``hash_embed`` by its filled places: ``indices``, ascending, and their ``values``. Built-in functions only."""
    words = text_words(text)
    bucket = lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % EMBEDDING_DIMENSION

    def counted(places: Column) -> Column:
        starts = F.array_compact(F.transform(places, lambda b, i: F.when((i == 0) | (F.get(places, i - 1) != b), i)))
        return _let(starts, lambda s: normed(places, s))

    def normed(places: Column, starts: Column) -> Column:
        counts = F.transform(starts, lambda at, i: (F.coalesce(F.get(starts, i + 1), F.size(places)) - at).cast("double"))
        length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
        scaled = lambda c, n: F.transform(c, lambda x: (x / n).cast("float"))
        return F.struct(
            F.transform(starts, lambda at: F.get(places, at).cast("int")).alias("indices"),
            _let(counts, lambda c: _let(length(c), lambda n: scaled(c, n))).alias("values"),
        )

    return _let(F.sort_array(F.transform(words, bucket)), counted)


def hash_embed(text: Column) -> Column:
    """Lexical vectors of whole texts, all places: they match shared words, not meaning."""
    return embed_with(lambda: hash_vectors, text)
