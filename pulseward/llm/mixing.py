"""Mixing sources to target weights by Poisson replication.

Each source gets a rate: the characters its weight asks for over those it has. A document appears N times, N being
the Poisson quantile of its source's rate at a number in [0, 1) hashed from seed and id. The copies are shuffled by
a hash, so that each partition of the result is a random part of the mix in random order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseward.llm.common import staged

#: Largest rate inverted at once; a larger one is a sum of independent draws, which keeps the tables short.
RATE_STEP = 16.0
#: Quantiles in a table: the chance of more at RATE_STEP is below the spacing of the hashed numbers.
TABLE = 96
#: A table of rates of up to so many rows goes to every task, else the join is left to the planner.
BROADCAST_ROWS = 20_000
SEED = 17


def hashed_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts' texts; 48 bits, exact as a double."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = 0.5, by: str = "source") -> DataFrame:
    """Per source: ``chars`` and the mean number of copies ``rate`` of its documents.

    ``weights`` are target shares by source (a source without one gets 0); without any, the share is in proportion to
    ``chars ** alpha``, which raises small sources. The mix has as many characters as the corpus. A source without
    characters keeps rate 1.
    """
    sizes = docs.groupBy(F.col(by).alias("source")).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("chars").cast("double"), F.lit(alpha)))
    elif weights:
        table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        weighed = sizes.withColumn("weight", F.coalesce(table[F.col("source")].cast("double"), F.lit(0.0)))
    else:
        raise ValueError("weights is empty")
    weighed = staged(weighed, "sources")
    # Sums over sources in a fixed order of decimals, so that a retry gives the same rates.
    total = weighed.agg(F.sum("chars"), F.sum(F.col("weight").cast("decimal(38,12)"))).first()
    chars, weight = float(total[0] or 0), float(total[1] or 0)
    rate = F.when((F.col("chars") == 0) | F.lit(weight == 0), 1.0).otherwise(
        F.col("weight") / F.lit(weight or 1.0) * F.lit(chars) / F.greatest(F.col("chars"), F.lit(1))
    )
    return weighed.select("source", "chars", rate.alias("rate"))


def quantile_table(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, 2, ... at ``rate``."""
    step = lambda acc, k: F.struct(
        (acc["p"] * rate / k).alias("p"),
        (acc["c"] + acc["p"] * rate / k).alias("c"),
        F.concat(acc["all"], F.array(acc["c"] + acc["p"] * rate / k)).alias("all"),
    )
    zero = F.exp(-rate)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(TABLE)),
        F.struct(zero.alias("p"), zero.alias("c"), F.array(zero).alias("all")),
        step,
        lambda acc: acc["all"],
    )


def copies(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = 0.5, seed: int = SEED) -> DataFrame:
    """``docs`` with ``copies``, how often each appears in the mix.

    The draw is hashed from seed and id, so rows that repeat an id draw alike; a null id or source is a value like
    others. Texts only count by their length, null as empty. A column ``copies`` of the input is replaced.
    """
    table = staged(
        rates(docs, weights, alpha)
        .withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(RATE_STEP))).cast("int"))
        .withColumn("cdf", quantile_table(F.col("rate") / F.col("draws")))
        .select(F.col("source").alias("__source"), F.col("draws").alias("__draws"), F.col("cdf").alias("__cdf")),
        "rates",
    )
    if table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    numbers = F.transform(F.sequence(F.lit(1), F.col("__draws")), lambda k: hashed_unit(F.lit(seed), F.col("doc_id"), k))
    drawn = F.aggregate(numbers, F.lit(0), lambda acc, u: acc + F.size(F.filter(F.col("__cdf"), lambda c: c <= u)))
    columns = [c for c in docs.columns if c != "copies"]
    return docs.join(table, docs["source"].eqNullSafe(table["__source"])).select(*columns, drawn.alias("copies"))


def mix_sources(
    docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = 0.5, seed: int = SEED
) -> DataFrame:
    """The mix: ``docs``' columns, ``copy`` (from 1) and ``shuffle_key``, spread and ordered by that key."""
    counted = copies(docs, weights, alpha, seed).where("copies > 0")
    columns = [c for c in docs.columns if c not in ("copies", "copy", "shuffle_key")]
    each = counted.select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy")))
    keyed = each.withColumn("shuffle_key", key)
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id")
