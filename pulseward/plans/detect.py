"""Scan a stored dataset and keep its events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseward.operators.events import absent_events, signals_to_events
from pulseward.operators.signals import DetectorSettings, scan_metrics
from pulseward.plans.store import PARTITION, read_stored
from pulseward.schemas import ANOMALY_EVENTS, DAILY_METRICS


def scan_dataset(
    spark: SparkSession, metrics_path: str, dataset_source: str, settings: DetectorSettings = DetectorSettings()
) -> DataFrame:
    """Events of one stored dataset, not yet compared with the stored ones."""
    metrics = read_stored(spark, metrics_path, DAILY_METRICS).where(F.col(PARTITION) == dataset_source)
    return signals_to_events(scan_metrics(metrics, settings), dataset_source)


def scan_and_persist(
    spark: SparkSession,
    metrics_path: str,
    events_path: str,
    dataset_source: str,
    settings: DetectorSettings = DetectorSettings(),
) -> DataFrame:
    """Append the events that are not stored yet and return all events of the dataset by id.

    Running it again adds nothing.
    """
    existing = read_stored(spark, events_path, ANOMALY_EVENTS).where(F.col(PARTITION) == dataset_source)
    found = scan_dataset(spark, metrics_path, dataset_source, settings)
    absent_events(found, existing).select(*existing.columns).write.mode("append").partitionBy(PARTITION).parquet(
        events_path
    )
    return read_stored(spark, events_path, ANOMALY_EVENTS).where(F.col(PARTITION) == dataset_source).orderBy("id")
