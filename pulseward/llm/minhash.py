"""Near-duplicates by DartMinHash signatures, banded joins, an exact check and connected components.

DartMinHash throws darts at the plane of every element's weight and a rank: a unit-rate Poisson process whose darts
are hashed from the element, so that all documents see the same darts. A document catches those that lie below an
element's weight and below a rank bound that leaves about ``k ln k + 2k`` darts in all, however many elements it has.
Each dart belongs to one of k coordinates; the one of least rank is the coordinate's sample. Two documents agree in a
coordinate with the probability of their weighted Jaccard similarity.

Texts of the same words are one node. Nodes that agree in all rows of a band share a bucket. In a bucket nodes are
compared with one pivot first, and only where a bucket still spans several components are the pairs between different
components compared; so a large bucket of near copies costs about as many comparisons as it has nodes, and no link
that joins two components is lost. Comparisons are exact on shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseward.llm.common import SHINGLE_WORDS, distinct, map_blocks, mix, pick_rows, ragged, shingles, staged, unit
from pulseward.llm.components import components

SIMILARITY = 0.8
#: 40 bands of 6 coordinates: a pair of similarity 0.8 shares no band with a chance of 5e-6, at 0.3 shares one with 3 %.
BANDS, ROWS = 40, 6
#: Rounds of comparing with one pivot a bucket before the rest is compared pair by pair.
PIVOT_ROUNDS = 2
#: 64-bit words of the bitmap that bounds an overlap before sets are compared.
BIT_WORDS = 32

_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures (n, k) of n weighted sets, given as parallel arrays of element hashes, positive weights and set numbers.

    A set without elements has zeros.
    """
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(owner, weights, minlength=n)
    bound = np.divide(k * math.log(k) + 2 * k, total, out=np.zeros(n), where=total > 0)
    todo = total > 0
    while todo.any():
        use = todo[owner]
        ids, filled = _darts(elements[use], weights[use], owner[use], bound, n, k)
        full = filled.all(axis=1) & todo
        out[full] = ids[full]
        todo &= ~full
        bound *= 2  # a coordinate without a dart: catch more
    return out


def _darts(elements, weights, owner, bound, n, k) -> tuple[np.ndarray, np.ndarray]:
    best = np.full(n * k, np.inf)
    ids = np.zeros(n * k, np.uint64)
    for level in range(int(math.floor(math.log2(weights.max() + 1))) + 1):
        # Weights [2**level - 1, 2**(level + 1) - 1) in cells of unit area, 2**-level high in rank.
        low, wide = 2.0**level - 1, 2.0**level
        here = np.flatnonzero(weights > low)
        cells = np.ceil(bound[owner[here]] * wide).astype(np.int64)
        element = np.repeat(here, cells)
        cell = np.arange(len(element)) - np.repeat(np.cumsum(cells) - cells, cells)
        seed = np.uint64((level + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1)
        drawn = mix(mix(elements[element] + seed) + cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        count = np.searchsorted(_POISSON, unit(drawn), "right")
        source = np.repeat(np.arange(len(element)), count)
        nth = np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count)
        dart = mix(drawn[source] + (nth + 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        rank = (cell[source] + unit(mix(dart ^ np.uint64(0xA0761D6478BD642F)))) / wide
        element = element[source]
        keep = rank < bound[owner[element]]
        if level or (weights[here] < 1).any():
            keep &= low + wide * unit(mix(dart ^ np.uint64(0xE7037ED1A0B428DB))) < weights[element]
        dart, rank, element = dart[keep], rank[keep], element[keep]
        slot = owner[element] * k + (mix(dart ^ np.uint64(0x8EBC6AF09C88C6E3)) % np.uint64(k)).astype(np.int64)
        np.minimum.at(best, slot, rank)
        won = rank == best[slot]
        ids[slot[won]] = dart[won]
    return ids.reshape(n, k), np.isfinite(best).reshape(n, k)


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grouped = signatures.reshape(len(signatures), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25), (len(signatures), bands))
    for r in range(rows):
        out = mix(out + grouped[:, :, r])
    return out


def sketches(docs: DataFrame, bands: int, rows: int, words: int, weighted: bool) -> DataFrame:
    """Per row of ``docs``: id, ``key`` (hash of the text as it is), ``row`` and ``content`` (hash of its words), the number
    of distinct shingles and the band hashes."""

    def sketch(part: pa.RecordBatch) -> dict:
        grams, owner, whole = shingles(part.column("text").to_pylist(), words)
        grams, owner, times = distinct(grams, owner)
        n = part.num_rows
        weights = times.astype(np.float64) if weighted else np.ones(len(grams))
        hashes = band_hashes(dart_signatures(grams, weights, owner, n, bands * rows), bands, rows)
        sizes = np.bincount(owner, minlength=n)
        hashes = hashes[sizes > 0].reshape(-1)
        return {
            "doc_id": part.column("doc_id"),
            "key": part.column("key"),
            "row": part.column("row"),
            "content": pa.array(whole.view(np.int64)),
            "size": pa.array(sizes, pa.int64()),
            "bands": ragged(hashes.view(np.int64), np.where(sizes > 0, bands, 0), pa.int64()),
        }

    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"),
        F.monotonically_increasing_id().alias("row"),
        "text",
    )
    return map_blocks(keyed, sketch, "doc_id long, key long, row long, content long, size long, bands array<long>")


def shingle_sets(texts: DataFrame, words: int, weighted: bool) -> DataFrame:
    """(node, set, bits) of (node, text): distinct shingle hashes; with multiplicities, an occurrence is an element of its own.

    ``bits`` marks which of 64 * BIT_WORDS classes the set has elements in.
    """

    def sets(part: pa.RecordBatch) -> dict:
        grams, owner, _ = shingles(part.column("text").to_pylist(), words)
        grams, owner, times = distinct(grams, owner)
        if weighted:
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            grams, owner = mix(np.repeat(grams, times) + nth.astype(np.uint64)), np.repeat(owner, times)
        sizes = np.bincount(owner, minlength=part.num_rows)
        bits = np.zeros((part.num_rows, 64 * BIT_WORDS), bool)
        bits[owner, (grams % np.uint64(64 * BIT_WORDS)).astype(np.int64)] = True
        words_ = np.packbits(bits, axis=1).view(np.int64).reshape(-1)
        return {
            "node": part.column("node"),
            "set": ragged(grams.view(np.int64), sizes, pa.int64()),
            "bits": ragged(words_, np.full(part.num_rows, BIT_WORDS), pa.int64()),
        }

    return map_blocks(texts, sets, "node long, set array<long>, bits array<long>")


def lacking(bits: Column, other: Column) -> Column:
    """Classes marked in ``bits`` and not in ``other``: so many elements at least are in no overlap."""
    both = F.zip_with(bits, other, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
    return F.aggregate(both, F.lit(0), lambda total, n: total + n)


def linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` (a, b) with ``linked``: whether their sets' Jaccard similarity reaches the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    jaccard = both / (F.size("sa") + F.size("sb") - both)
    return pairs.join(left, "a").join(right, "b").select("a", "b", (jaccard >= similarity).alias("linked"))


def near_duplicates(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    words: int = SHINGLE_WORDS,
    weighted: bool = False,
) -> DataFrame:
    """One row per input row: ``doc_id, class_id, class_size, kept, key``.

    Documents are linked when the Jaccard similarity of their sets of ``words``-word shingles (lower case, split at ASCII
    white space; ``weighted``: of their multisets) is ``similarity`` or more; a class is a connected component.
    ``class_id`` is its smallest ``doc_id`` (null only where all are), ``kept`` marks one row of each class, one with that id.
    Texts of the same words are copies; null and blank texts are copies of each other and near nothing else. A text
    of fewer words is one shingle. ``key`` hashes the raw text. Other columns are ignored.
    """
    found = staged(sketches(docs, bands, rows, words, weighted), "sketches")
    nodes = found.groupBy("content", "size").agg(
        F.min("row").alias("node"), F.min_by("bands", "row").alias("bands"), F.min_by("doc_id", "row").alias("doc_id"),
        F.min_by("key", "row").alias("key"),
    )
    nodes = staged(nodes, "nodes")
    entries = nodes.where("size > 0").select("node", "size", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    buckets = staged(entries.join(shared, "band"), "buckets")
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("doc_id", "key", "node")
    texts = pick_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted, F.xxhash64(F.coalesce("text", F.lit(""))))
    sets = staged(shingle_sets(texts, words, weighted), "sets")

    # A shingle that one node alone has is in no overlap, which bounds what a node can be similar to.
    alone = sets.select("node", F.explode("set").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    alone = alone.where("n = 1").groupBy("node").agg(F.count("*").alias("alone"))
    measured = sets.select("node", F.size("set").cast("long").alias("size")).join(alone, "node", "left").na.fill(0, ["alone"])
    buckets = staged(buckets.drop("size").join(measured, "node"), "measured")

    comps = None
    tested = None
    for round_no in range(PIVOT_ROUNDS + 1):
        if comps is None:
            placed = buckets.withColumn("comp", F.col("node"))
        else:
            placed = buckets.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        # First the node with the least of its own, the likely original of its copies; then any.
        first = F.col("alone") / F.col("size") if not round_no else F.xxhash64("node", F.lit(round_no))
        order = F.struct(first, "node", "comp", "size", "alone")
        heads = placed.groupBy("band").agg(F.min(order).alias("pivot"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
        heads = heads.where("c0 <> c1").select("band", F.col("pivot.node").alias("other"), F.col("pivot.comp").alias("other_comp"), F.col("pivot.size").alias("other_size"), F.col("pivot.alone").alias("other_alone"))
        if round_no < PIVOT_ROUNDS:
            met = placed.join(heads, "band").where("comp <> other_comp")
        else:
            open_ = placed.join(heads.select("band"), "band", "left_semi").join(sets.select("node", "bits"), "node")
            right = open_.select("band", *[F.col(c).alias(f"other{x}") for c, x in (("node", ""), ("comp", "_comp"), ("size", "_size"), ("alone", "_alone"), ("bits", "_bits"))])
            met = open_.join(right, "band").where("node < other and comp <> other_comp")
        # The overlap a similarity asks for, against the most there can be; exact, with room for rounding.
        most = F.least(F.col("size") - F.col("alone"), F.col("other_size") - F.col("other_alone"))
        if round_no == PIVOT_ROUNDS:
            most = F.least(
                most,
                F.col("size") - lacking(F.col("bits"), F.col("other_bits")),
                F.col("other_size") - lacking(F.col("other_bits"), F.col("bits")),
            )
        close = most >= F.lit(similarity / (1 + similarity)) * (F.col("size") + F.col("other_size")) - 1e-6
        pairs = met.where(close).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        results = staged(linked(pairs, sets, similarity), "pairs")
        tested = results if tested is None else tested.unionByName(results)
        if results.where("linked").isEmpty():
            continue
        comps = staged(components(tested.where("linked").select("a", "b")), "classes")
    member = nodes.select("content", "size", "node")
    if comps is not None:
        member = member.join(comps, "node", "left")
    else:
        member = member.withColumn("comp", F.lit(None).cast("long"))
    member = member.select("content", "size", F.coalesce("comp", "node").alias("comp"))
    # Counts and smallest ids go up by content first, so that a large class is never one group of rows.
    copies = found.groupBy("content", "size").agg(
        F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    )
    by_content = staged(copies.join(member, ["content", "size"]), "members")
    classes = by_content.groupBy("comp").agg(F.sum("n").alias("class_size"), F.min("first").alias("first"))
    named = by_content.select("content", "size", "comp").join(classes, "comp")
    return found.join(named, ["content", "size"]).select(
        "doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept"), "key"
    )


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` of each class, with all columns."""
    winners = near_duplicates(docs, **options).where("kept").select("doc_id", "key")
    return pick_rows(docs, winners, F.xxhash64(F.coalesce("text", F.lit(""))))
