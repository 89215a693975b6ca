"""Exact deduplication: sorted digest runs merged up a tree (DataFrame operations only).

Every input partition is a run: its digests, each with the smallest id and the number of rows. Runs are numbered in
base ``fan``. In round r the runs that differ in digit r only exchange their rows, so that each keeps the digests
whose bucket has its digit there, and merges what it gets in digest order. After the last round a digest is in the
one run its bucket names. A digest meets at most ``fan`` rows in any merge, however many copies it has, and no round
has one final task.

Rows merge only where SHA-256, byte length and a second hash of the normalised text all agree, at every level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseward.llm.common import ordered, pick_rows, staged

#: Runs that meet in one merge: two, as in a binomial tree.
FAN = 2
_KEYS = ["text_sha256", "n_bytes", "check64"]


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Per row: id, digest columns, ``row`` (a number unique within the table) and ``run`` (its partition)."""
    return (
        docs.select("doc_id", normalised(F.col(text_col)).alias("norm"), F.monotonically_increasing_id().alias("row"))
        .select(
            "doc_id",
            "row",
            F.shiftright("row", 33).cast("int").alias("run"),
            F.sha2("norm", 256).alias("text_sha256"),
            F.octet_length("norm").cast("long").alias("n_bytes"),
            F.xxhash64("norm").alias("check64"),
        )
    )


def _merge(runs: DataFrame) -> DataFrame:
    return runs.groupBy("run", *_KEYS).agg(F.min("first").alias("first"), F.sum("n").alias("n"))


def merge_tree(leaves: DataFrame, rounds: int, fan: int = FAN) -> DataFrame:
    """The rounds over (run, digest columns, first, n); the result has one row per digest."""
    bucket = F.pmod(F.xxhash64(*_KEYS), F.lit(fan**rounds))
    runs = leaves
    for r in range(rounds):
        digit = lambda x, r=r: F.floor(x / F.lit(fan**r)).cast("int") % fan
        run = F.col("run") + (digit(bucket) - digit(F.col("run"))) * F.lit(fan**r).cast("int")
        # Every run has a partition of its own; sorted by digest, the runs that arrive there merge in one pass.
        moved = runs.withColumn("run", run).repartitionById(fan**rounds, "run").sortWithinPartitions("run", *_KEYS)
        runs = _merge(moved)
    return runs


def dedup(docs: DataFrame, text_col: str = "text", fan: int = FAN) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal normalised texts the row with the smallest ``doc_id`` stays; null ids come last, and of rows that share
    the smallest id the first in table order stays. Null and empty texts are equal. Other columns are ignored.
    """
    rows = staged(digests(docs, text_col), "digests")
    leaves = staged(
        rows.groupBy("run", *_KEYS).agg(F.min(ordered(F.col("doc_id"), F.col("row"))).alias("first"), F.count("*").alias("n")),
        "leaves",
    )
    spark = docs.sparkSession
    last = leaves.agg(F.max("run")).first()[0] or 0
    width, rounds = max(last + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))), 1
    while fan**rounds < width:
        rounds += 1
    groups = merge_tree(leaves, rounds, fan).select(
        *_KEYS,
        F.col("first.doc_id").alias("keep_id"),
        F.col("first.row").alias("keep_row"),
        F.col("n").alias("group_size"),
    )
    # Back down: a digest has one row per run here, so that a hot digest stays spread.
    by_run = leaves.select("run", *_KEYS).join(groups, _KEYS)
    return rows.join(by_run, ["run", *_KEYS]).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "check64"
    )


def kept_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    winners = dedup(docs, text_col).where("kept").select("doc_id", F.col("check64").alias("key"))
    return pick_rows(docs, winners, F.xxhash64(normalised(F.col(text_col))))
