"""Daily series per slice: one row per day, gaps closed, rolling baselines.

A slice is one combination of the slice columns. After ``dedupe_slices`` a slice
holds at most one row per calendar day, so the windows below work on groups
bounded by the length of the calendar, however skewed the raw rows are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseward.schemas import SLICE_COLUMNS

# Fixed values of the detector.
CARRIED_METRICS = ["success_rate_pct", "avg_latency_ms", "chargeback_rate_pct", "avg_fraud_risk_score"]
ZEROED_METRICS = ["daily_spend_amount", "transaction_count"]
BASELINE_METRICS = ["success_rate_pct", "avg_latency_ms", "chargeback_rate_pct"]
DEVIATION_FLOOR = {"success_rate_pct": 0.05, "avg_latency_ms": 5.0, "chargeback_rate_pct": 0.05}
MIN_PERIODS = 3

# A spread below this is the rounding noise of a constant window.
NOISE = 1e-9


def preference(columns: Sequence[str], schema: T.StructType) -> list[str]:
    """The order in which columns decide which row of a slice and day is kept.

    Labels before numbers, and of those the ones every caller carries first, so that all callers keep the same row.
    """
    first = [*BASELINE_METRICS, "daily_spend_amount"]

    def place(column: str) -> int:
        if column in ("id", *first):
            return -1 if column == "id" else 1 + first.index(column)
        return 9 if isinstance(schema[column].dataType, T.NumericType) else 0

    return sorted(columns, key=place)


def dedupe_slices(df: DataFrame, slice_cols: Sequence[str] = SLICE_COLUMNS, date_col: str = "metric_date") -> DataFrame:
    """Keep one row per slice and day: the smallest by ``id`` where there is one, then by labels, then by metrics.

    An aggregate rather than a ranking: it reduces on the map side, so a day with
    a third of all rows does not land in one task.
    """
    keys = [*slice_cols, date_col]
    rest = preference([c for c in df.columns if c not in keys], df.schema)
    named = df.where(" and ".join(f"`{c}` is not null" for c in keys))
    if not rest:
        return named.distinct()
    return named.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("kept")).select(*keys, "kept.*")


def calendar_fill(
    df: DataFrame,
    slice_cols: Sequence[str] = SLICE_COLUMNS,
    date_col: str = "metric_date",
    fill_gaps: bool = True,
) -> DataFrame:
    """Close the gaps between the first and last day of every slice of at least three rows.

    Rates and latencies are carried forward (and back, before the first value),
    volumes are zero on days without data. ``is_observed`` marks the real rows.
    Each row is stretched up to the day before its successor, so no spine is
    built or joined and one exchange on the slice serves all windows.
    """
    by_slice = Window.partitionBy(*slice_cols)
    ordered = by_slice.orderBy(date_col)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    carried = [c for c in CARRIED_METRICS if c in df.columns]
    zeroed = [c for c in ZEROED_METRICS if c in df.columns]
    if not fill_gaps:
        return (
            df.select(*slice_cols, date_col, *carried, *zeroed, F.count("*").over(by_slice).alias("slice_rows"))
            .where(F.col("slice_rows") >= MIN_PERIODS)
            .drop("slice_rows")
            .withColumn("is_observed", F.lit(True))
        )

    filled = [
        F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.first(c, ignorenulls=True).over(whole)).alias(c)
        for c in carried
    ]
    stretched = (
        df.select(
            *slice_cols,
            F.col(date_col).alias("observed_on"),
            *filled,
            *zeroed,
            F.count("*").over(whole).alias("slice_rows"),
            F.lead(date_col).over(ordered).alias("next_on"),
        )
        .where(F.col("slice_rows") >= MIN_PERIODS)
        .withColumn(
            date_col,
            F.explode(
                F.sequence("observed_on", F.coalesce(F.date_sub("next_on", 1), F.col("observed_on")))
            ),
        )
    )
    observed = F.col(date_col) == F.col("observed_on")
    return stretched.select(
        *slice_cols,
        date_col,
        *carried,
        *[
            F.when(observed, F.coalesce(F.col(c).cast("double"), F.lit(0.0))).otherwise(F.lit(0.0)).alias(c)
            for c in zeroed
        ],
        observed.alias("is_observed"),
    )


def day_runs(
    df: DataFrame,
    slice_cols: Sequence[str] = SLICE_COLUMNS,
    date_col: str = "metric_date",
    fill_gaps: bool = True,
) -> DataFrame:
    """The series of ``calendar_fill`` by runs: the observed rows only, each with ``gap_days``, the days without data after it.

    Rates and latencies are carried as there, so a gap repeats its row's; its volumes are zero. ``place`` numbers the days (the rows,
    without ``fill_gaps``). A gap of any length is one number here.
    """
    ordered = Window.partitionBy(*slice_cols).orderBy(date_col)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = [c for c in CARRIED_METRICS if c in df.columns]
    zeroed = [c for c in ZEROED_METRICS if c in df.columns]
    value = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.first(c, ignorenulls=True).over(whole)) if fill_gaps else F.col(c)
    volume = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if fill_gaps else F.col(c)
    gap = F.coalesce(F.datediff(F.lead(date_col).over(ordered), F.col(date_col)) - 1, F.lit(0)) if fill_gaps else F.lit(0)
    place = F.datediff(F.col(date_col), F.lit("1970-01-01").cast("date")) if fill_gaps else F.row_number().over(ordered)
    return (
        df.select(
            *slice_cols,
            date_col,
            *[value(c).alias(c) for c in carried],
            *[volume(c).alias(c) for c in zeroed],
            gap.alias("gap_days"),
            place.alias("place"),
            F.count("*").over(whole).alias("slice_rows"),
        )
        .where(F.col("slice_rows") >= MIN_PERIODS)
        .drop("slice_rows")
    )


def run_baseline(
    df: DataFrame,
    window_days: int = 14,
    slice_cols: Sequence[str] = SLICE_COLUMNS,
    date_col: str = "metric_date",
) -> DataFrame:
    """``rolling_baseline`` of the observed rows of ``day_runs``: a run counts by its days inside the window.

    A window of so many days meets at most as many runs, the one that reaches into it included.
    """
    trailing = Window.partitionBy(*slice_cols).orderBy(date_col).rowsBetween(-(window_days - 1), Window.currentRow)
    metrics = [m for m in BASELINE_METRICS if m in df.columns]
    recent = df.select("*", F.collect_list(F.struct("place", *metrics)).over(trailing).alias("__recent"))
    # A run ends where the next one starts; the current row's days are the window's last one.
    later = F.concat(F.slice(F.transform("__recent", lambda r: r["place"]), 2, window_days), F.array(F.col("place") + 1))
    days = F.zip_with("__recent", later, lambda r, after: F.greatest(F.lit(0), after - F.greatest(r["place"], F.col("place") - (window_days - 1))))
    weighed = recent.select("*", days.alias("__days"))

    def total(metric: str, term) -> Column:
        parts = F.zip_with("__recent", "__days", lambda r, n: F.when(r[metric].isNotNull(), n * term(r[metric])))
        return F.aggregate(parts, F.lit(0.0), lambda sum_, x: sum_ + F.coalesce(x, F.lit(0.0)))

    counted = weighed.select("*", *[total(m, lambda v: F.lit(1.0)).alias(f"n_{m}") for m in metrics])
    averaged = counted.select(
        "*", *[F.when(F.col(f"n_{m}") >= MIN_PERIODS, total(m, lambda v: v) / F.col(f"n_{m}")).alias(f"mean_{m}") for m in metrics]
    )
    spreads = []
    for m in metrics:
        squares = total(m, lambda v, m=m: (v - F.col(f"mean_{m}")) * (v - F.col(f"mean_{m}")))
        spread = F.sqrt(squares / (F.col(f"n_{m}") - 1))
        spreads.append(F.when((F.col(f"n_{m}") >= MIN_PERIODS) & (spread > NOISE), spread).otherwise(F.lit(DEVIATION_FLOOR[m])).alias(f"sd_{m}"))
    return averaged.select(*df.columns, *[f"mean_{m}" for m in metrics], *spreads)


def rolling_baseline(
    df: DataFrame,
    window_days: int = 14,
    slice_cols: Sequence[str] = SLICE_COLUMNS,
    date_col: str = "metric_date",
) -> DataFrame:
    """Trailing mean and spread, the current row included, as ``mean_*`` and ``sd_*``."""
    trailing = Window.partitionBy(*slice_cols).orderBy(date_col).rowsBetween(-(window_days - 1), Window.currentRow)
    metrics = [m for m in BASELINE_METRICS if m in df.columns]
    # each aggregate is taken once per frame and guarded afterwards
    framed = df.select(
        "*",
        *[F.count(m).over(trailing).alias(f"n_{m}") for m in metrics],
        *[F.avg(m).over(trailing).alias(f"mean_{m}") for m in metrics],
        *[F.stddev_samp(m).over(trailing).alias(f"sd_{m}") for m in metrics],
    )
    guarded = []
    for m in metrics:
        enough, spread = F.col(f"n_{m}") >= MIN_PERIODS, F.col(f"sd_{m}")
        guarded += [
            F.when(enough, F.col(f"mean_{m}")).alias(f"mean_{m}"),
            F.when(enough & (spread > NOISE), spread).otherwise(F.lit(DEVIATION_FLOOR[m])).alias(f"sd_{m}"),
        ]
    return framed.select(*df.columns, *guarded)


def rolling_zscore(df: DataFrame) -> DataFrame:
    """Score each row against its baseline: ``z_*`` (0 where unknown) and ``expected_*``."""
    scores = []
    for metric in [m for m in BASELINE_METRICS if f"mean_{m}" in df.columns]:
        value, mean = F.col(metric), F.col(f"mean_{metric}")
        z = (value - mean) / F.col(f"sd_{metric}")
        scores += [
            F.coalesce(z, F.lit(0.0)).alias(f"z_{metric}"),
            F.coalesce(mean, value).alias(f"expected_{metric}"),
        ]
    return df.select("*", *scores)
