"""Packing token pieces into sequences by length patterns and non-negative least squares.

Only the histogram of piece lengths reaches the driver. There, patterns of up to three lengths that fill a sequence are
enumerated, repeat counts are fitted to the histogram by non-negative least squares and rounded down, and what
remains is packed best fit, largest first, on counts. The result is a short table of sequence patterns with repeats;
pieces of one length are numbered across partitions from per-partition counts and look their place up in it.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseward.llm.common import map_blocks, staged
from pulseward.llm.tokens import default_files, encoder

CAPACITY = 1024
END_ID = 2
#: Steps of the projected gradient method, each linear in the number of patterns.
FIT_STEPS = 300


@dataclass
class Layout:
    """Slots by length: the pieces ``rank_from`` and up of a length go to sequences from ``sequence`` on, at ``offset``."""

    length: np.ndarray
    rank_from: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.uint64(1 << 48)
        order = self.length.astype(np.uint64) * key + self.rank_from.astype(np.uint64)
        at = np.searchsorted(order, length.astype(np.uint64) * key + rank.astype(np.uint64), "right") - 1
        return self.sequence[at] + rank - self.rank_from[at], self.offset[at]


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All ways to fill ``capacity`` exactly by one, two or three of ``lengths``, ascending, zero-padded."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    out = [np.array([[0, 0, capacity]])] if have[capacity] else []
    a = lengths[lengths * 2 <= capacity]
    a = a[have[capacity - a]]
    out.append(np.stack((np.zeros_like(a), a, capacity - a), axis=1))
    first, second = (x.reshape(-1) for x in np.meshgrid(lengths, lengths, indexing="ij"))
    third = capacity - first - second
    fits = (first <= second) & (second <= third)
    first, second, third = first[fits], second[fits], third[fits]
    fits = have[third]
    out.append(np.stack((first[fits], second[fits], third[fits]), axis=1))
    return np.concatenate(out).astype(np.int64)


def fit_counts(parts: np.ndarray, histogram: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Repeat counts x >= 0 of patterns that minimise the squared error of the lengths used against the histogram.

    Accelerated projected gradients; a length's error is weighed by its share of a sequence, as a long piece left over
    costs more.
    """
    capacity = len(histogram) - 1
    weight = np.arange(capacity + 1) / capacity
    scale = max(1.0, float(histogram.max()))
    goal = histogram / scale
    x = np.zeros(len(parts))
    y, t = x, 1.0
    used = np.bincount(parts.reshape(-1), minlength=capacity + 1)
    lipschitz = 3.0 * float((used * weight**2)[1:].max(initial=1e-9))
    for _ in range(steps):
        made = np.zeros(capacity + 1)
        for k in range(3):
            made += np.bincount(parts[:, k], y, capacity + 1)
        error = (made - goal) * weight**2
        error[0] = 0
        new = np.maximum(y - error[parts].sum(axis=1) / lipschitz, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Sequence patterns with repeats that use up ``histogram`` (counts by length, index 0 unused) exactly."""
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    lengths = np.flatnonzero(left)
    result = []
    if len(lengths):
        parts = patterns(lengths, capacity)
        fitted = np.floor(fit_counts(parts, left.astype(np.float64))).astype(np.int64) if len(parts) else []
        order = np.argsort(-np.asarray(fitted), kind="stable")
        for i in order:
            if fitted[i] <= 0:
                break
            row = parts[i][parts[i] > 0]
            kinds, times = np.unique(row, return_counts=True)
            n = int(min(fitted[i], (left[kinds] // times).min()))
            if n > 0:
                left[kinds] -= n * times
                result.append((tuple(int(v) for v in row[::-1]), n))
    return result + best_fit(left)


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, largest first, on counts: pieces of one length enter the fullest open patterns that still hold them."""
    capacity = len(left) - 1
    by_space: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        count = int(left[length])
        # An opened sequence takes further pieces of this length only as the search goes on over its remaining space.
        space = length
        while count and space <= capacity:
            for pattern, n in list(by_space[space].items()):
                if not count:
                    break
                fill = min(space // length, -(-count // n)) or 1
                moved = min(n, count // fill) or 1
                fill = min(fill, count)
                by_space[space][pattern] -= moved
                if not by_space[space][pattern]:
                    del by_space[space][pattern]
                longer = pattern + (length,) * fill
                rest = by_space[space - fill * length]
                rest[longer] = rest.get(longer, 0) + moved
                count -= moved * fill
                if count and n > moved:
                    space -= 1  # look at the same space again
                    break
            space += 1
        if count:
            fill = capacity // length
            whole, odd = divmod(count, fill)
            for k, n in ((fill, whole), (odd, 1)):
                if k and n:
                    rest = by_space[capacity - k * length]
                    rest[(length,) * k] = rest.get((length,) * k, 0) + n
    return [(p, n) for space in by_space for p, n in space.items()]


def layout(planned: list[tuple[tuple[int, ...], int]]) -> Layout:
    slots, sequence = [], 0
    used: dict[int, int] = {}
    for pattern, n in planned:
        offset = 0
        for length in pattern:
            slots.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        sequence += n
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 4)
    return Layout(table[:, 0], table[:, 1], table[:, 2], table[:, 3], sequence)


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, files: tuple[str, str] | None = None, with_ids: bool = False
) -> DataFrame:
    """Per piece of every document: ``doc_id, piece, start, length, ids_crc32``, and ``ids`` (little-endian) if asked for.

    A null text is empty, which is one piece of the end id. A longer document is cut into pieces of ``capacity`` ids, of
    which the first may be shorter.
    """
    files = files or default_files()
    end = np.array([end_id], "<u4").tobytes()

    def cut(part: pa.RecordBatch) -> dict:
        encode = encoder(*files).encode
        ids = part.column("doc_id").to_pylist()
        owner, number, start, length, crc, data = [], [], [], [], [], []
        for doc_id, text in zip(ids, part.column("text").to_pylist()):
            tokens = encode(text or "") + end
            n = len(tokens) // 4
            at = 0
            size = n % capacity or capacity
            k = 0
            while at < n:
                piece = tokens[4 * at : 4 * (at + size)]
                owner.append(doc_id)
                number.append(k)
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(piece))
                if with_ids:
                    data.append(piece)
                at, size, k = at + size, capacity, k + 1
        out = {
            "doc_id": pa.array(owner, pa.int64()),
            "piece": pa.array(number, pa.int32()),
            "start": pa.array(start, pa.int64()),
            "length": pa.array(length, pa.int64()),
            "ids_crc32": pa.array(crc, pa.int64()),
        }
        return out | ({"ids": pa.array(data, pa.binary())} if with_ids else {})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, schema)


def pack(
    docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, files: tuple[str, str] | None = None, with_ids: bool = False
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: each sequence is filled without gaps from 0, to ``capacity`` at most.

    Repeated ids are packed as rows of their own; null ids too. An empty table gives no rows. Other columns are ignored.
    """
    raw = pieces(docs, capacity, end_id, files, with_ids)
    cut = staged(raw.withColumn("part", F.spark_partition_id()), "pieces")
    # Numbers within (part, length): groups of one task's pieces, then offsets from counts by part.
    within = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        histogram[r["length"]] = r["n"]
    places = layout(plan(histogram))
    spread = docs.sparkSession.sparkContext.broadcast(places)  # bounded by the number of patterns
    numbered = cut.withColumn("number", F.row_number().over(within)).join(offsets, ["part", "length"])
    numbered = numbered.select(*raw.columns, (F.col("before") + F.col("number") - 1).alias("rank"))

    names = raw.columns

    def assign(batches):
        for b in batches:
            where = {n: b.schema.get_field_index(n) for n in ("length", "rank")}
            sequence, offset = spread.value.place(*(b.column(where[n]).to_numpy() for n in ("length", "rank")))
            columns = [b.column(i) for i in range(b.num_columns) if i != where["rank"]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    types = ", ".join(f"`{n}` {t}" for n, t in raw.dtypes)
    return numbered.mapInArrow(assign, f"{types}, sequence_id long, offset long")
