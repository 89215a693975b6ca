"""Document fingerprints: all shingle hashes below a fixed fraction of the hash range.

Because the fraction is the same for every document, the union of two fingerprints' hashes is the fingerprint of
the texts' union, and the share of a short text's hashes found in a long one's estimates containment.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseward.llm.common import blocks, mix, powers

#: Code points in a shingle, and the share of hashes that is kept.
SHINGLE, FRACTION = 6, 1 / 4
#: Kept 64-bit hashes are below FRACTION of the range; so much to the right, 32 bits of them are left.
SHIFT = 32 + int(math.log2(FRACTION))


class Sketch:
    """A fingerprint: kept hashes (distinct, ascending, 32 bits) and a hash of the whole text, which a merged one lacks."""

    __slots__ = ("hashes", "whole")

    def __init__(self, hashes: np.ndarray, whole: int | None):
        self.hashes, self.whole = hashes, whole

    def text(self) -> str:
        """16 hex digits of the whole text's hash (none if merged), a colon, and the hashes as base64 of big-endian 32-bit numbers."""
        return ("" if self.whole is None else f"{self.whole:016x}") + ":" + base64.b64encode(self.hashes.astype(">u4").tobytes()).decode()

    @staticmethod
    def parse(text: str) -> Sketch:
        whole, data = text.split(":")
        return Sketch(np.frombuffer(base64.b64decode(data), ">u4").astype(np.uint32), int(whole, 16) if whole else None)

    def merged(self, other: Sketch) -> Sketch:
        """The fingerprint of both texts' shingles together; merging again, in any order, changes nothing."""
        return Sketch(np.union1d(self.hashes, other.hashes), None)

    def _same_text(self, other: Sketch) -> bool:
        return self.whole is not None and self.whole == other.whole

    def _shared(self, other: Sketch) -> int:
        return len(np.intersect1d(self.hashes, other.hashes, assume_unique=True))

    def likeness(self, other: Sketch) -> float:
        """Estimated Jaccard similarity; of two empty sketches 1 if the texts are equal, else 0."""
        if self._same_text(other):
            return 1.0
        shared = self._shared(other)
        return shared / max(1, len(self.hashes) + len(other.hashes) - shared)

    def containment(self, other: Sketch) -> float:
        """Estimated share of this text's shingles that the other has."""
        if self._same_text(other):
            return 1.0
        return self._shared(other) / max(1, len(self.hashes))


def sketches(texts: list[str]) -> list[Sketch]:
    """Fingerprints of texts; one shorter than a shingle is a single shingle, an empty one has none."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    up, down = powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
    whole = mix((sums[ends] - sums[ends - sizes]) * down[ends - sizes] + mix(sizes.astype(np.uint64)))
    n = max(0, len(points) - SHINGLE + 1)
    hashes = mix((sums[SHINGLE : SHINGLE + n] - sums[:n]) * down[:n])
    at = np.flatnonzero(hashes < np.uint64(int(FRACTION * 2**64)))
    owner = np.searchsorted(ends, at, "right")
    inside = at + SHINGLE <= ends[owner]
    at, owner = at[inside], owner[inside]
    values = (hashes[at] >> np.uint64(SHIFT)).astype(np.uint32)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = [Sketch(np.unique(values[a:b]), int(w)) for a, b, w in zip(cuts, cuts[1:], whole)]
    for i in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)):
        if whole[i] < np.uint64(int(FRACTION * 2**64)):
            out[i].hashes = np.array([int(whole[i]) >> SHIFT], np.uint32)
    return out


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row; null as empty."""
    from pulseward.llm.common import map_blocks

    def run(part: pa.RecordBatch) -> dict:
        found = sketches([t or "" for t in part.column("text").to_pylist()])
        return {"doc_id": part.column("doc_id"), "fingerprint": pa.array([s.text() for s in found], pa.string())}

    return map_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fingerprint string")


def with_successors(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) dealt into ranges of descending id, one per partition and sorted in it.

    Each range is followed by the first document of the next one (the last range by the first of all), marked ``extra``, so
    that every document's successor is the row after it. Null ids come last, ordered by a hash of the text. Only
    the first id of each range is collected.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nulls = F.lit(-(2**63)) + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(2**61))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("place", F.coalesce("doc_id", nulls))
    ids = keyed.select("place").repartitionByRange(parts, F.col("place").desc())
    heads = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.max("place").alias("head")).select("head").collect()
    heads = np.array(sorted((r["head"] for r in heads), reverse=True), np.int64)
    reverse = heads[::-1].copy()

    @F.pandas_udf("array<struct<part int, extra boolean>>")
    def ranges(place: pd.Series) -> pd.Series:
        values = place.to_numpy(np.int64)
        at = np.searchsorted(reverse, values, "left")
        own = len(reverse) - 1 - at
        first = reverse[at] == values
        last = len(reverse) - 1
        return pd.Series(
            [
                [{"part": int(p), "extra": False}] + ([{"part": int(p - 1 if p else last), "extra": True}] if f else [])
                for p, f in zip(own, first)
            ]
        )

    spread = keyed.withColumn("to", F.explode(ranges("place"))).select("doc_id", "text", "place", "to.part", "to.extra")
    dealt = spread.repartitionById(max(1, len(heads)), F.col("part"))
    return dealt.sortWithinPartitions("extra", F.col("place").desc(), F.xxhash64(F.coalesce("text", F.lit(""))))


def edited(text: str, following: str) -> str:
    """The last third of ``text`` (rounded down) replaced by as many first characters of ``following``, or all of them."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: fingerprints of its text and of its text edited by its successor in descending id.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Null texts are
    empty; rows that share an id follow each other in the order of a hash of their texts; a single row is its own
    successor. Other columns are ignored.
    """
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def run(batches):
        held = None  # the last row: id, text, sketch
        for part in blocks(batches):
            extras = part.column("extra").to_pylist()
            real = extras.index(True) + 1 if True in extras else len(extras)
            texts = [t or "" for t in part.column("text").to_pylist()[:real]]
            found = sketches(texts)
            rows = ([held] if held else []) + list(zip(part.column("doc_id").to_pylist(), texts, found))
            held = rows[-1]
            if len(rows) > 1:
                changed = [edited(a[1], b[1]) for a, b in zip(rows, rows[1:])]
                again = sketches(changed)
                own = rows[:-1]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([r[0] for r in own], pa.int64()),
                        "n_chars": pa.array([len(r[1]) for r in own], pa.int64()),
                        "edited_sha256": [hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed],
                        "fingerprint": [r[2].text() for r in own],
                        "edited_fingerprint": [s.text() for s in again],
                        "near_edited": [r[2].likeness(s) for r, s in zip(own, again)],
                        "near_next": [a[2].likeness(b[2]) for a, b in zip(rows, rows[1:])],
                    }
                )
            if real < len(extras) or (extras and extras[real - 1]):
                return

    return with_successors(docs).mapInArrow(run, schema)
