"""Isolation forest per slice.

After deduplication and calendar fill a slice is one row per day, so what one
task holds at a time is bounded by the calendar; the work spreads over the
slices. Slices stream through a task in sorted order, many per Arrow batch,
which spares the cost of one exchange with Python per slice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseward.functions.isolation import forest_scores, run_forest_scores, slice_seed
from pulseward.operators.series import ZEROED_METRICS
from pulseward.schemas import SLICE_COLUMNS

# Fixed values of the detector.
FOREST_FEATURES = ["success_rate_pct", "avg_latency_ms", "chargeback_rate_pct", "daily_spend_amount"]
MIN_FEATURES = 2
MIN_ROWS = 7


def without_forest(df: DataFrame) -> DataFrame:
    return df.select("*", F.lit(0.0).alias("iso_score"), F.lit(False).alias("is_isolated"))


def isolation_forest(
    df: DataFrame,
    contamination: float = 0.03,
    slice_cols: Sequence[str] = SLICE_COLUMNS,
    date_col: str = "metric_date",
    co_located: bool = False,
) -> DataFrame:
    """Add ``iso_score`` (negative is unusual) and ``is_isolated``.

    Slices of fewer than seven days, or tables with fewer than two of the feature
    columns, get 0 and false. Rows with ``gap_days`` stand for themselves and so many
    days after them, which differ by their volume of zero. ``co_located`` says that every slice lies in one
    partition already, as it does in the output of a window over the slice; that
    saves the exchange, and the planner drops the sort.
    """
    features = [c for c in FOREST_FEATURES if c in df.columns]
    if len(features) < MIN_FEATURES:
        return without_forest(df)
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("iso_score", T.DoubleType()),
            T.StructField("is_isolated", T.BooleanType()),
        ]
    )
    names = list(slice_cols)
    runs, volumes = "gap_days" in df.columns, np.array([c in ZEROED_METRICS for c in features])

    def slice_starts(table: pa.Table) -> np.ndarray:
        changes = np.zeros(table.num_rows, dtype=bool)
        changes[0] = True
        for name in names:
            codes = table[name].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            changes[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(changes)

    def scored(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = table.num_rows
        matrix = np.column_stack([np.nan_to_num(table[c].to_numpy().astype(np.float64), nan=0.0) for c in features])
        days = table[date_col].cast(pa.int32()).to_numpy().astype(np.int64)
        labels = zip(*[table[c].take(pa.array(starts)).to_pylist() for c in names])
        gaps = table["gap_days"].to_numpy().astype(np.int64) if runs else np.zeros(n, np.int64)
        filled = np.where(volumes, 0.0, matrix)
        score, flag = np.zeros(n), np.zeros(n, dtype=bool)
        for start, end, label in zip(starts, np.append(starts[1:], n), labels):
            if end - start + gaps[start:end].sum() < MIN_ROWS:
                continue
            mine, seed = slice(start, end), slice_seed("|".join(map(str, label)))
            if gaps[mine].any():
                found = run_forest_scores(matrix[mine], filled[mine], days[mine], gaps[mine], seed, contamination)
            else:
                found = forest_scores(matrix[mine], days[mine], seed, contamination)
            score[mine], flag[mine] = found
        full = table.append_column("iso_score", pa.array(score)).append_column("is_isolated", pa.array(flag))
        yield from full.combine_chunks().to_batches()

    def score_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_slice = None  # rows of a slice whose end is not in sight yet
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if open_slice is not None:
                table = pa.concat_tables([open_slice, table])
            starts = slice_starts(table)
            last = int(starts[-1])
            if last:
                yield from scored(table.slice(0, last), starts[:-1])
            open_slice = table.slice(last)
        if open_slice is not None:
            yield from scored(open_slice, np.zeros(1, dtype=np.int64))

    together = df if co_located else df.repartition(*names)
    return together.sortWithinPartitions(*names, date_col).mapInArrow(score_slices, schema)
