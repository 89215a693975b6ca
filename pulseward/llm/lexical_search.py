"""Ranked lexical search by pipelined term partitioning.

The texts' postings are cut two ways: by blocks of neighbouring documents, and by term into stages, each of which owns
its terms. For each block one bundle carries all items' accumulators (document, score so far) through the stages:
a stage cogroups bundles with its postings, adds the integer contributions of its terms, and hands the bundles on. The
rarest terms come first. A document's accumulator is left out only when its score and the most that the later stages can
add in its block stay below a score that LIMIT documents have already, so the result is exact.

The terms of the items, never those of the documents, are sent to the tasks; items are taken in batches of bounded size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseward.llm.common import blocks, ragged, staged

#: Ranks of an item.
LIMIT = 10
#: Term owners, and terms of the items that are searched for in one go (in expectation).
STAGES, BATCH_TERMS = 4, 1 << 17

#: Separators as blanks, A to Z lower-cased: the terms of a UTF-8 text are then its words.
_TERMS = bytes(
    c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower()
)
POSTINGS = (
    "block long, doc_ids array<long>, sizes array<long>, terms array<int>, counts array<int>, docs array<int>, tfs array<long>, "
    "n_docs long, n_terms long"
)
INDEX = "stage int, block long, terms array<int>, counts array<int>, docs array<int>, tfs array<long>"
BUNDLE = "block long, doc_ids array<long>, lengths array<long>, bounds array<long>, items array<int>, docs array<int>, scores array<long>"


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all characters beyond ASCII, A to Z lower-cased; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


def items_with_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): distinct terms of each item, sorted. Rows that share an id, null too, are one item; those without terms go."""

    @F.pandas_udf("array<binary>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(set(terms_of(t))))

    each = items.select("item_id", F.explode(split("text")).alias("term"))
    return each.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """One row per block of documents that have a term: ids, numbers of terms, and the places of the vocabulary's terms.

    ``terms`` ascend, each with ``counts`` entries of ``docs`` (places in the block) and ``tfs``. Blocks are numbered
    by input partition, so write the result before it is used twice.
    """
    number = {term: i for i, term in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        for part in blocks(batches):
            ids, sizes, found = [], [], []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                words = terms_of(text)
                if words:
                    at = len(ids)
                    found += [(i, at, n) for w, n in Counter(words).items() if (i := number.get(w)) is not None]
                    ids.append(doc_id)
                    sizes.append(len(words))
            if not ids:
                continue
            table = np.array(found, np.int64).reshape(-1, 3)
            table = table[np.lexsort((table[:, 1], table[:, 0]))]
            terms, counts = np.unique(table[:, 0], return_counts=True)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([base + made], pa.int64()),
                    "doc_ids": pa.array([ids], pa.list_(pa.int64())),
                    "sizes": pa.array([sizes], pa.list_(pa.int64())),
                    "terms": _list(terms, pa.int32()),
                    "counts": _list(counts, pa.int32()),
                    "docs": _list(table[:, 1], pa.int32()),
                    "tfs": _list(table[:, 2], pa.int64()),
                    "n_docs": pa.array([len(ids)], pa.int64()),
                    "n_terms": pa.array([sum(sizes)], pa.int64()),
                }
            )
            made += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, POSTINGS)


def _list(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return ragged(values, np.array([len(values)]), kind)


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def owners(df: np.ndarray, stages: int = STAGES) -> np.ndarray:
    """The stage of each term: the rarest terms first, each stage with about as many postings."""
    order = np.argsort(df, kind="stable")
    before = np.concatenate(([0], np.cumsum(df[order])[:-1]))
    out = np.zeros(len(df), np.int64)
    out[order] = before * stages // max(1, int(df.sum()))
    return out


def contributions(weight: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What a term adds to a document's score, by its weight, its occurrences there, and the document's relative length."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * length))


def _rows(batches: Iterator[pa.RecordBatch], lists: list[str]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    for batch in batches:
        for i, block in enumerate(batch.column("block").to_pylist()):
            yield block, {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in lists}


def _take(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of all runs that start at ``starts``."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())


def index(found: DataFrame, owner: np.ndarray) -> DataFrame:
    """The postings by stage and block."""

    def run(batches):
        for block, row in _rows(batches, ["terms", "counts", "docs", "tfs"]):
            starts = np.concatenate(([0], np.cumsum(row["counts"])[:-1]))
            for stage in np.unique(owner[row["terms"]]):
                mine = np.flatnonzero(owner[row["terms"]] == stage)
                at = _take(starts[mine], row["counts"][mine])
                yield pa.RecordBatch.from_pydict(
                    {
                        "stage": pa.array([stage], pa.int32()),
                        "block": pa.array([block], pa.int64()),
                        "terms": _list(row["terms"][mine], pa.int32()),
                        "counts": _list(row["counts"][mine], pa.int32()),
                        "docs": _list(row["docs"][at], pa.int32()),
                        "tfs": _list(row["tfs"][at], pa.int64()),
                    }
                )

    return found.select("block", "terms", "counts", "docs", "tfs").mapInArrow(run, INDEX)


def bundles(found: DataFrame, items: list[list[np.ndarray]], weight: np.ndarray, n: int, length: int) -> DataFrame:
    """The bundles that enter the first stage: no accumulators yet, and what each stage can add to each item in the block.

    ``items`` holds each stage's terms of each item; ``bounds`` is stage after stage, item after item.
    """

    def run(batches):
        for block, row in _rows(batches, ["doc_ids", "sizes", "terms", "counts", "docs", "tfs"]):
            lengths = 10 + (90 * row["sizes"] * n) // length
            most = np.zeros(len(weight) + 1, np.int64)
            if len(row["terms"]):
                starts = np.concatenate(([0], np.cumsum(row["counts"])[:-1]))
                each = contributions(np.repeat(weight[row["terms"]], row["counts"]), row["tfs"], lengths[row["docs"]])
                most[row["terms"]] = np.maximum.reduceat(each, starts)
            bounds = [most[terms].sum() for stage in items for terms in stage]
            ids = pa.array([None if np.isnan(x) else int(x) for x in row["doc_ids"]], pa.int64()) if row["doc_ids"].dtype.kind == "f" else pa.array(row["doc_ids"])
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([block], pa.int64()),
                    "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    "lengths": _list(lengths, pa.int64()),
                    "bounds": _list(np.array(bounds, np.int64), pa.int64()),
                    **{c: _list(np.zeros(0, np.int64), t) for c, t in (("items", pa.int32()), ("docs", pa.int32()), ("scores", pa.int64()))},
                }
            )

    return found.select("block", "doc_ids", "sizes", "terms", "counts", "docs", "tfs").mapInArrow(run, BUNDLE)


def stage_step(stage: int, items: list[list[np.ndarray]], weight: np.ndarray, least: np.ndarray, limit: int):
    """The function of one stage's cogroup: a block's bundle and this owner's postings there give the bundle for the next."""
    mine = items[stage]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return left
        row = left.iloc[0]
        lengths, n = np.asarray(row["lengths"], np.int64), len(row["lengths"])
        bounds = np.asarray(row["bounds"], np.int64).reshape(len(items), len(mine))
        now, later = bounds[stage:].sum(0), bounds[stage + 1 :].sum(0)
        had, docs, scores = (np.asarray(row[c], np.int64) for c in ("items", "docs", "scores"))
        cuts = np.searchsorted(had, np.arange(len(mine) + 1))
        terms, counts, places, adds = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(right):
            terms, counts, places, tfs = (np.asarray(right.iloc[0][c], np.int64) for c in ("terms", "counts", "docs", "tfs"))
            adds = contributions(np.repeat(weight[terms], counts), tfs, lengths[places])
        starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
        out = []
        for i, wanted in enumerate(mine):
            a, b = cuts[i], cuts[i + 1]
            if a == b and now[i] < max(1, least[i]):
                continue  # no document of the block can reach the least score any more
            total = np.zeros(n, np.int64)
            total[docs[a:b]] = scores[a:b]
            at = np.searchsorted(terms, wanted)
            at = at[at < len(terms)] if not len(terms) else at[terms[np.minimum(at, len(terms) - 1)] == wanted]
            if len(at):
                spots = _take(starts[at], counts[at])
                np.add.at(total, places[spots], adds[spots])
            least_here = max(1, least[i], np.partition(total, n - limit)[n - limit] if n >= limit else 0)
            kept = np.flatnonzero((total > 0) & (total + later[i] >= least_here))
            if len(kept):
                out.append((np.full(len(kept), i), kept, total[kept]))
        had, docs, scores = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pd.DataFrame(
            {c: [row[c]] for c in ("block", "doc_ids", "lengths", "bounds")}
            | {"items": [had.astype(np.int32)], "docs": [docs.astype(np.int32)], "scores": [scores.astype(np.int64)]}
        )

    return run


def _scored(carried: DataFrame) -> DataFrame:
    """(item, doc_id, score) of all accumulators."""
    each = carried.select("doc_ids", F.explode(F.arrays_zip("items", "docs", "scores")).alias("a"))
    return each.select(F.col("a.items").alias("item"), F.element_at("doc_ids", F.col("a.docs") + 1).alias("doc_id"), F.col("a.scores").alias("score"))


def _search_batch(docs: DataFrame, batch: list, limit: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted({bytes(t) for row in batch for t in row["terms"]})
    found = staged(postings(docs, vocabulary), "postings")
    whole = found.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("length")).first()
    n, length = whole["n"] or 0, whole["length"] or 0
    df = np.zeros(len(vocabulary), np.int64)
    pairs = found.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).groupBy(F.col("p.terms").alias("term"))
    for row in pairs.agg(F.sum("p.counts").alias("df")).collect():  # at most one row per term of the batch
        df[row["term"]] = row["df"]
    weight, owner = weights(df, n), owners(df)
    number = {term: i for i, term in enumerate(vocabulary)}
    own = [np.array([number[bytes(t)] for t in row["terms"]], np.int64) for row in batch]
    by_stage = [[np.sort(t[owner[t] == s]) for t in own] for s in range(STAGES)]
    parts = staged(index(found, owner), "term-owners")
    carried = bundles(found, by_stage, weight, n, max(1, length))
    least = np.zeros(len(batch), np.int64)
    best = Window.partitionBy("item").orderBy(F.col("score").desc())
    for s in range(STAGES):
        step = stage_step(s, by_stage, weight, least, limit)
        owned = parts.where(F.col("stage") == s).select("block", "terms", "counts", "docs", "tfs")
        carried = staged(carried.groupBy("block").cogroup(owned.groupBy("block")).applyInPandas(step, BUNDLE), "bundles")
        reached = _scored(carried).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
        for row in reached.where(F.col("rank") == limit).select("item", "score").collect():  # one row per item
            least[row["item"]] = row["score"]
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = _scored(carried).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    names = spark.createDataFrame([(i, row["item_id"]) for i, row in enumerate(batch)], "item int, item_id long")
    return top.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The ``limit`` best documents of each item: ``item_id, rank, doc_id, score``.

    A term's weight is ``floor(1000 ln((2N + 2) / (2 df + 1)))``, N being the documents with a term; the rest is 64-bit integer.
    Documents that score 0 are not ranked; equal scores rank by ascending ``doc_id``, null last. Null and empty texts
    have no terms. Rows that repeat an id are documents of their own; items that repeat an id are one with the terms of all;
    an item without terms that occur has no rows. Other columns are ignored.
    """
    wanted = staged(items_with_terms(items), "items")
    total = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    if not total:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    batches = -(-total // BATCH_TERMS)
    part = F.pmod(F.xxhash64("item_id"), F.lit(batches))
    out = None
    for b in range(batches):
        batch = wanted.where(part == b).orderBy("item_id").collect()  # bounded by BATCH_TERMS in expectation
        if batch:
            found = _search_batch(docs, batch, limit)
            out = found if out is None else out.unionByName(found)
    return out
