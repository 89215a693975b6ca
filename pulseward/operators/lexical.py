"""Search by words over an inverted index with the largest weight of each block.

The lexical vectors are mostly zeros, so a ticket is a few postings (bucket, weight). Postings of a bucket lie in blocks of like
weight. A ticket that scores ``m`` against a query of ``n`` buckets has one bucket that alone brings ``m / n`` of it;
blocks whose largest weight brings less in every bucket are not read for candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseward.functions.embedding import bucket_weights, counted_parts, hash_embed_text, text_words
from pulseward.functions.matching import SIMILARITY_DIGITS
from pulseward.operators.tickets import SEARCH_LIMIT, SEARCH_MIN, ticket_text
from pulseward.session import staged

# Classes of weight, and postings of a block (in expectation), which is made of so many slices or more.
LEVELS, BLOCK_POSTINGS, BLOCK_SLICES = 32, 4096, 16


def slice_postings(ids: pa.Array, words: pa.ListArray, most: int) -> dict[str, pa.Array]:
    """The postings of some texts by bucket and class of weight, in slices of at most ``most``, with the largest weight of each."""
    row, bucket, weight = bucket_weights(words)
    group = bucket * (2 * LEVELS) + np.ceil(weight * LEVELS).astype(np.int64)
    order = np.argsort(group, kind="stable")
    group, weight = group[order], weight[order]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    rank = np.arange(len(group)) - np.repeat(first, np.diff(first, append=len(group)))
    starts = np.flatnonzero(rank % most == 0)
    bucket, level = np.divmod(group[starts], 2 * LEVELS)
    postings = pa.StructArray.from_arrays([ids.take(pa.array(row[order])), pa.array(weight)], ["ticket_id", "weight"])
    return {
        "bucket": pa.array(bucket, pa.int32()),
        "level": pa.array(level, pa.int32()),
        "top": pa.array(np.maximum.reduceat(weight, starts) if len(starts) else weight),
        "postings": pa.ListArray.from_arrays(pa.array(np.append(starts, len(weight)), pa.int32()), postings),
    }


def lexical_index(tickets: DataFrame, id_col: str = "ticket_id") -> DataFrame:
    """(bucket, level, part, top, postings): blocks of (ticket_id, weight) by bucket and class of weight, ``top`` being the largest.

    Weights are those of the unit vector. A common word's postings spread over as many parts as they need; written in its
    order, the table lets readers skip what a filter on bucket and ``top`` leaves out. A task that embeds texts slices their
    postings by bucket and level at once; the slices are stored on the way, and blocks are put together of whole slices.
    """
    most = max(1, BLOCK_POSTINGS // BLOCK_SLICES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in counted_parts(batch):
                yield pa.RecordBatch.from_pydict(slice_postings(*part.columns, most))

    texts = tickets.select(F.col(id_col).alias("ticket_id"), text_words(ticket_text(tickets)).alias("words"))
    posting = T.StructType([T.StructField("ticket_id", texts.schema["ticket_id"].dataType), T.StructField("weight", T.DoubleType())])
    schema = T.StructType.fromDDL("bucket int, level int, top double").add("postings", T.ArrayType(posting))
    # Texts are embedded once; the sizes and the blocks read the slices back.
    slices = staged(texts.mapInArrow(run, schema), "slices")
    # At most a row per bucket and level, whatever the number of tickets.
    sizes = slices.groupBy("bucket", "level").agg(F.ceil(F.sum(F.size("postings")) / BLOCK_POSTINGS).alias("parts"))
    dealt = slices.join(F.broadcast(sizes), ["bucket", "level"]).withColumn("part", F.pmod(F.xxhash64("postings"), F.col("parts")))
    blocks = dealt.groupBy("bucket", "level", "part").agg(
        F.max("top").alias("top"), F.flatten(F.collect_list("postings")).alias("postings")
    )
    return blocks.sortWithinPartitions("bucket", "level")


def query_weights(query: str) -> dict[int, float]:
    return {bucket: weight for bucket, weight in enumerate(hash_embed_text(query)) if weight}


def candidate_blocks(index: DataFrame, weights: dict[int, float], min_similarity: float) -> DataFrame:
    """The blocks in which a ticket's largest contribution can be. The bound leaves room for rounding."""
    share = max(min_similarity, 0.0) / max(1, len(weights)) - 10.0**-SIMILARITY_DIGITS
    wanted = F.lit(False)
    for bucket, weight in weights.items():
        wanted = wanted | ((F.col("bucket") == bucket) & (F.col("top") >= share / weight))
    return index.where(wanted)


def search_index(index: DataFrame, query: str, limit: int = SEARCH_LIMIT, min_similarity: float = SEARCH_MIN) -> DataFrame:
    """(ticket_id, similarity_score) of the ``limit`` most similar tickets, best first, as an exact cosine of lexical vectors.

    Scores are compared before they are rounded for display; a blank query finds nothing.
    """
    weights = query_weights(query)
    one = lambda blocks: blocks.select("bucket", F.explode("postings").alias("p"))
    candidates = one(candidate_blocks(index, weights, min_similarity)).select("p.ticket_id").distinct()
    own = F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("bucket")) if weights else F.lit(0.0)
    parts = one(index.where(F.col("bucket").isin(list(weights)))).select("p.ticket_id", (F.col("p.weight") * own).alias("part"))
    scored = parts.join(candidates, "ticket_id", "left_semi").groupBy("ticket_id").agg(
        F.round(F.sum("part"), SIMILARITY_DIGITS).alias("similarity_score")
    )
    best = scored.where(F.col("similarity_score") >= min_similarity).orderBy(F.desc("similarity_score"), "ticket_id").limit(limit)
    return best.withColumn("similarity_score", F.round("similarity_score", 6))
