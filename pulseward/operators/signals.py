"""From scored daily series to anomaly signals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseward.functions.numeric import round_stable
from pulseward.functions.rules import ALERT_RULES
from pulseward.operators.forest import isolation_forest, without_forest
from pulseward.operators.series import (
    BASELINE_METRICS,
    calendar_fill,
    day_runs,
    dedupe_slices,
    rolling_baseline,
    rolling_zscore,
    run_baseline,
)
from pulseward.schemas import SLICE_COLUMNS


@dataclass(frozen=True)
class DetectorSettings:
    window_days: int = 14
    z_threshold: float = 2.5
    contamination: float = 0.03
    use_forest: bool = True
    fill_gaps: bool = True


def extract_signals(
    scored: DataFrame, z_threshold: float = 2.5, slice_cols: Sequence[str] = SLICE_COLUMNS
) -> DataFrame:
    """One row per fired rule and observed day; filled days never alert."""
    rules = [r for r in ALERT_RULES if r.metric in scored.columns]
    isolated = F.col("is_isolated")
    return (
        (scored.where("is_observed") if "is_observed" in scored.columns else scored)
        .select(
            *slice_cols,
            "metric_date",
            round_stable(F.col("iso_score"), 4).alias("isolation_score"),
            F.explode(F.array(*[r.signal(z_threshold, isolated) for r in rules])).alias("signal"),
        )
        .where("signal.fired")
        .select(*slice_cols, "metric_date", "signal.*", "isolation_score")
        .drop("fired")
    )


def _deduped(metrics: DataFrame, slice_cols: Sequence[str]) -> DataFrame:
    """One row per slice and day, with the columns the rules and the forest look at; no others are read and carried along."""
    wanted = [*slice_cols, "metric_date", *BASELINE_METRICS, "daily_spend_amount", "merchant_category", "id"]
    return dedupe_slices(metrics.select(*[c for c in wanted if c in metrics.columns]), slice_cols)


def _scored(based: DataFrame, settings: DetectorSettings, slice_cols: Sequence[str]) -> DataFrame:
    # the exchange of the windows before is the only one on the slice; the forest works inside its partitions
    scored = rolling_zscore(based).drop(*[f"{stat}_{m}" for stat in ("mean", "sd") for m in BASELINE_METRICS])
    if settings.use_forest:
        return isolation_forest(scored, settings.contamination, slice_cols, co_located=True)
    return without_forest(scored)


def score_series(
    metrics: DataFrame, settings: DetectorSettings = DetectorSettings(), slice_cols: Sequence[str] = SLICE_COLUMNS
) -> DataFrame:
    """Dedupe, fill, baseline and forest for every day of every slice of a metrics table."""
    filled = calendar_fill(_deduped(metrics, slice_cols), slice_cols, fill_gaps=settings.fill_gaps)
    return _scored(rolling_baseline(filled, settings.window_days, slice_cols), settings, slice_cols)


def score_runs(
    metrics: DataFrame, settings: DetectorSettings = DetectorSettings(), slice_cols: Sequence[str] = SLICE_COLUMNS
) -> DataFrame:
    """``score_series`` of the observed days: gaps count by their lengths and are never made into rows."""
    runs = day_runs(_deduped(metrics, slice_cols), slice_cols, fill_gaps=settings.fill_gaps)
    return _scored(run_baseline(runs, settings.window_days, slice_cols), settings, slice_cols)


def scan_metrics(metrics: DataFrame, settings: DetectorSettings = DetectorSettings()) -> DataFrame:
    """Signals of a metrics table that may lack slice or metric columns.

    Missing slice columns read ``All``; with no slice column at all the region
    reads ``ALL``.
    """
    present = [c for c in SLICE_COLUMNS if c in metrics.columns]
    labelled = metrics
    if "metric_date" in metrics.columns:
        labelled = labelled.withColumn("metric_date", F.col("metric_date").cast("date"))
    for column in SLICE_COLUMNS:
        if column not in present:
            label = "ALL" if not present and column == "region" else "All"
            labelled = labelled.withColumn(column, F.lit(label))
    labelled = labelled.select(
        *[F.col(c).cast("string").alias(c) if c in SLICE_COLUMNS else F.col(c) for c in labelled.columns]
    )
    return extract_signals(score_runs(labelled, settings), settings.z_threshold)
