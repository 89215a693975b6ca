"""The k best tickets of every query, exactly, without making pairs into rows.

Tickets lie in cells: one combination of labels and the pivot their vector is nearest to. A cell's tickets are between two
angles from its pivot, so for unit vectors the triangle inequality bounds what any of them can score for a query
from the query's own angle to the pivot. Cells are dealt to tasks, large ones in parts; a query goes only to the tasks that
hold a cell it may match by labels and by the least score asked for. There it looks at cells in the order of their
bounds and skips those that cannot reach its k-th best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseward.functions import matching
from pulseward.functions.text import strip
from pulseward.functions.vectors import dense_rows
from pulseward.session import staged

LABELS = ["dataset_source", "region", "product_name", "customer_tier"]
TICKET_FIELDS = ["ticket_id", *LABELS, "embedding"]
QUERY_FIELDS = ["query_id", *LABELS, "query_vector"]

# Tickets of a cell that stay together, and tickets a task holds (both in expectation).
CELL_TICKETS, TASK_TICKETS = 4096, 20_000
# A task has at least so many tickets before the work is spread over further tasks.
FEWEST_TICKETS = 1000

_NO_ESCAPE = "\x01"


def sample_pivots(tickets: DataFrame) -> dict[int, np.ndarray]:
    """Pivots fitted to a bounded sample: the tickets first by hash of id."""
    first = tickets.select("embedding", F.xxhash64("ticket_id").alias("place"), "ticket_id")
    sample = first.orderBy("place", "ticket_id").limit(matching.PIVOT_SAMPLE).select("embedding").toArrow()
    return matching.fit_pivots(sample["embedding"])


def _with(df: DataFrame, *columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(*c) for c in columns]])


def placed_tickets(tickets: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Tickets with a direction, their vector's length, nearest pivot (-1 without one) and angle to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            width, pivot, angle = np.zeros(n, np.int32), np.full(n, -1, np.int32), np.zeros(n)
            for rows, matrix in dense_rows(batch.column("embedding")):
                usable, unit = matching.unit_rows(matrix)
                rows = rows[usable]
                width[rows] = matrix.shape[1]
                if matrix.shape[1] in pivots and len(rows):
                    all_angles = matching.angles(unit, pivots[matrix.shape[1]])
                    pivot[rows] = all_angles.argmin(axis=1)
                    angle[rows] = all_angles.min(axis=1)
            table = pa.Table.from_batches([batch])
            for name, values in (("width", width), ("pivot", pivot), ("angle", angle)):
                table = table.append_column(name, pa.array(values))
            yield from table.filter(pa.array(width > 0)).combine_chunks().to_batches()

    return tickets.mapInArrow(run, _with(tickets, ("width", T.IntegerType()), ("pivot", T.IntegerType()), ("angle", T.DoubleType())))


def aimed_queries(queries: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Queries with a direction, their vector's length and angles to all pivots of that length."""
    asked = queries.select(*QUERY_FIELDS[:-1], F.col("query_vector").cast("array<double>").alias("query_vector"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.zeros(batch.num_rows, np.int32)
            found: list[list[float]] = [[] for _ in range(batch.num_rows)]
            for rows, matrix in dense_rows(batch.column("query_vector")):
                usable, unit = matching.unit_rows(matrix)
                widths[rows[usable]] = matrix.shape[1]
                if matrix.shape[1] in pivots:
                    for row, values in zip(rows[usable], matching.angles(unit, pivots[matrix.shape[1]])):
                        found[row] = values.tolist()
            table = pa.Table.from_batches([batch]).append_column("width", pa.array(widths))
            table = table.append_column("angles", pa.array(found, pa.list_(pa.float64())))
            yield from table.filter(pa.array(widths > 0)).combine_chunks().to_batches()

    return asked.mapInArrow(run, _with(asked, ("width", T.IntegerType()), ("angles", T.ArrayType(T.DoubleType()))))


def _given(label: Column) -> Column:
    """Join key of a label that is asked for."""
    return F.concat(F.lit("="), label)


def _contains(label: Column, wanted: Column) -> Column:
    """Case-insensitive part of a label; ``%`` and ``_`` are wildcards, a blank wish is none."""
    pattern = F.concat(F.lit("%"), strip(wanted), F.lit("%"))
    return wanted.isNull() | (strip(wanted) == "") | F.coalesce(F.ilike(label, pattern, F.lit(_NO_ESCAPE)), F.lit(False))


def cell_visits(aimed: DataFrame, cells: DataFrame, minimum: float, strict: bool) -> DataFrame:
    """(query_id, cell, parts, bound): the cells that can hold a match, with the most a ticket of theirs can score.

    A label that a query leaves open is met by any; keys are joined as equal values.
    """
    q = {c: F.col(f"q_{c}") for c in LABELS}
    renamed = aimed.select("query_id", "width", "angles", *[F.col(c).alias(f"q_{c}") for c in LABELS])
    any_key = F.lit("*")
    asked = renamed.withColumn("dataset_key", F.coalesce(_given(q["dataset_source"]), any_key))
    open_keys = lambda c: F.explode(F.array_compact(F.array(any_key, _given(F.col(c)))))
    held = cells.withColumn("dataset_key", open_keys("dataset_source"))
    keys = ["width", "dataset_key"]
    if strict:
        region = F.when(q["region"] != "", _given(q["region"]))
        asked = asked.withColumn("region_key", F.coalesce(region, any_key))
        held = held.withColumn("region_key", open_keys("region"))
        keys.append("region_key")
    pairs = asked.join(held, keys)
    if strict:
        pairs = pairs.where(_contains(F.col("product_name"), q["product_name"]) & _contains(F.col("customer_tier"), q["customer_tier"]))
    own = F.get("angles", F.col("pivot"))
    gap = F.greatest(F.lit(0.0), own - F.col("high"), F.col("low") - own) - F.lit(matching.ANGLE_SLACK)
    bound = F.when(F.col("pivot") < 0, F.lit(1.0)).otherwise(F.cos(F.greatest(F.lit(0.0), gap)))
    return pairs.select("query_id", "cell", "parts", bound.alias("bound")).where(F.col("bound") >= F.lit(minimum) - F.lit(1e-9))


def _shard(cell: Column, part: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(cell, part), F.lit(shards)).cast("int")


def best_matches(
    aimed: DataFrame,
    placed: DataFrame,
    cells: DataFrame,
    shards: int,
    k: int,
    minimum: float,
    strict: bool,
    counts: tuple[Accumulator, Accumulator] | None = None,
) -> DataFrame:
    """(query_id, rank, ticket_id, similarity) of one pass. ``counts`` adds up tickets compared and skipped."""
    visits = cell_visits(aimed, cells, minimum, strict)
    spread = visits.select("query_id", "cell", "bound", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    sent = (
        spread.select("query_id", _shard(F.col("cell"), F.col("part"), shards).alias("shard"), F.struct("cell", "bound").alias("visit"))
        .groupBy("query_id", "shard")
        .agg(F.collect_set("visit").alias("visits"))
    )
    none = lambda kind: F.lit(None).cast(kind)
    questions = sent.join(aimed.select("query_id", "query_vector"), "query_id").select(
        "shard", F.lit(1).alias("kind"), F.col("query_id").alias("id"), none("bigint").alias("cell"), none("array<float>").alias("vector"),
        F.col("query_vector").alias("asked"), "visits",
    )
    part = F.pmod(F.xxhash64("ticket_id"), F.col("parts"))
    held = placed.select("cell", "ticket_id", "embedding").join(cells.select("cell", "parts"), "cell")
    rows = held.select(
        _shard(F.col("cell"), part.cast("int"), shards).alias("shard"), F.lit(0).alias("kind"), F.col("ticket_id").alias("id"), "cell",
        F.col("embedding").cast("array<float>").alias("vector"), none("array<double>").alias("asked"),
        none("array<struct<cell: bigint, bound: double>>").alias("visits"),
    ).unionByName(questions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, tickets = None, [], None
        for batch in batches:
            starts = np.flatnonzero(np.diff(batch.column("shard").to_numpy() * 2 + batch.column("kind").to_numpy(), prepend=-1))
            for at, stop in zip(starts, [*starts[1:], batch.num_rows]):
                piece = batch.slice(at, stop - at)
                if piece.column("shard")[0].as_py() != shard:
                    shard, parts, tickets = piece.column("shard")[0].as_py(), [], None
                if piece.column("kind")[0].as_py() == 0:
                    parts.append(piece.select(["id", "cell", "vector"]))
                    continue
                if tickets is None and parts:
                    tickets, parts = matching.TicketCells(pa.Table.from_batches(parts)), []
                if tickets is None:
                    continue
                found = []
                for query, asked, visited in zip(*[piece.column(c).to_pylist() for c in ("id", "asked", "visits")]):
                    best = matching.Best(k, minimum)
                    compared, skipped = tickets.search(asked, visited, best)
                    if counts:
                        counts[0].add(compared)
                        counts[1].add(skipped)
                    found.append((np.full(len(best.ids), query), best.ids, best.scores))
                query, ids, scores = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_pydict(
                    {"query_id": pa.array(query, pa.int64()), "ticket_id": pa.array(ids, pa.int64()), "similarity": pa.array(scores, pa.float64())}
                )

    together = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "kind")
    local = together.mapInArrow(run, "query_id bigint, ticket_id bigint, similarity double")
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "ticket_id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest_tickets(
    queries: DataFrame,
    tickets: DataFrame,
    k: int,
    strict_min: float,
    broad_min: float,
    counts: tuple[Accumulator, Accumulator] | None = None,
) -> DataFrame:
    """The k best tickets of every query within its filters, else within its dataset.

    Scores are compared before they are rounded for display. Queries and tickets without a vector, or with the zero vector,
    match nothing, nor do vectors of other lengths.
    """
    usable = tickets.where(F.col("embedding").isNotNull()).select(*TICKET_FIELDS)
    pivots = sample_pivots(usable)
    cell = F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in LABELS], "width", "pivot")
    placed = staged(placed_tickets(usable, pivots).withColumn("cell", cell), "placed")
    sized = placed.groupBy("cell", *LABELS, "width", "pivot").agg(
        F.count("*").alias("tickets"), F.min("angle").alias("low"), F.max("angle").alias("high")
    )
    cells = staged(sized.withColumn("parts", F.ceil(F.col("tickets") / CELL_TICKETS).cast("int")), "cells")
    total = cells.agg(F.sum("tickets")).first()[0] or 0
    partitions = int(tickets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-total // TASK_TICKETS), min(partitions, -(-total // FEWEST_TICKETS)))
    aimed = staged(aimed_queries(queries, pivots), "aimed")
    matched = staged(best_matches(aimed, placed, cells, shards, k, strict_min, True, counts), "matches")
    unanswered = aimed.join(matched.select("query_id"), "query_id", "left_anti")
    others = best_matches(unanswered, placed, cells, shards, k, broad_min, False, counts)
    columns = ["query_id", "rank", "is_fallback", "ticket_id", F.col("similarity").alias("similarity_score")]
    both = matched.withColumn("is_fallback", F.lit(False)).unionByName(others.withColumn("is_fallback", F.lit(True)))
    return both.select(*columns)
