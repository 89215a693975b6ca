"""Stored anomaly events: idempotent insert, status, feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseward.functions.numeric import key_id
from pulseward.functions.rules import severity_weight
from pulseward.schemas import EVENT_KEY

# Fixed values of the feed.
DEFAULT_PAGE, MAX_PAGE = 50, 200
UNKNOWN_CONFIDENCE = 0.8

STATUS_ORDER = ["OPEN", "INVESTIGATING", "RESOLVED"]


def signals_to_events(signals: DataFrame, dataset_source: str) -> DataFrame:
    """Signals as open events, stamped at midnight UTC of their day."""
    return signals.select(
        F.lit(dataset_source).alias("dataset_source"),
        F.col("metric_date").cast("timestamp").alias("detected_at"),
        "metric_name",
        "region",
        "product_name",
        "customer_tier",
        "actual_value",
        "expected_value",
        "deviation_pct",
        "z_score",
        "severity",
        F.lit("OPEN").alias("status"),
    ).withColumn("id", key_id(*[F.col(c) for c in EVENT_KEY]))


def absent_events(events: DataFrame, existing: DataFrame) -> DataFrame:
    """The events whose key is not stored yet, each key once.

    The key holds the day, so neither the deduplication nor the anti join has a
    group larger than the signals of one slice and day.
    """
    new, old = events.dropDuplicates(EVENT_KEY).alias("new"), existing.select(*EVENT_KEY).alias("old")
    same = reduce(
        lambda a, b: a & b, [F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}")) for c in EVENT_KEY]
    )
    return new.join(old, same, "left_anti")


def insert_if_absent(events: DataFrame, existing: DataFrame) -> DataFrame:
    """All events after the insert: the stored ones and the absent ones."""
    return existing.unionByName(absent_events(events, existing).select(*existing.columns))


def current_status(events: DataFrame, transitions: DataFrame) -> DataFrame:
    """Events with the status their transition log (anomaly_id, seq, status) ends on."""
    latest = transitions.groupBy(F.col("anomaly_id").alias("id")).agg(F.max_by("status", "seq").alias("last_status"))
    return (
        events.join(latest, "id", "left")
        .withColumn("status", F.coalesce("last_status", "status"))
        .drop("last_status")
    )


def transitions_for(anomaly_ids: DataFrame) -> DataFrame:
    """The log of a finished investigation: open, investigating, resolved."""
    return anomaly_ids.select(
        F.col("id").alias("anomaly_id"), F.posexplode(F.array(*[F.lit(s) for s in STATUS_ORDER])).alias("seq", "status")
    )


def filter_events(
    events: DataFrame,
    dataset_source: str,
    status: str | None = None,
    severity: str | None = None,
    region: str | None = None,
) -> DataFrame:
    wanted = events.where(F.col("dataset_source") == dataset_source)
    for column, value in (("status", status), ("severity", severity), ("region", region)):
        if value:
            wanted = wanted.where(F.col(column) == value)
    return wanted


def anomaly_feed(events: DataFrame, limit: int = DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    """One page, latest first."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be within 1..{MAX_PAGE} and offset not negative")
    return events.orderBy(F.desc("detected_at"), F.desc("id")).offset(offset).limit(limit)


def with_report(events: DataFrame, reports: DataFrame) -> DataFrame:
    """Events with the summary of their report, where there is one."""
    summary = reports.select(
        F.col("anomaly_id").alias("id"), "root_cause_summary", "confidence_score", "mitigation_steps"
    )
    return events.join(summary, "id", "left")


def next_open(events: DataFrame) -> DataFrame:
    """The open event to look at next: worst severity, then latest."""
    return (
        events.where(F.col("status") == "OPEN")
        .orderBy(F.desc(severity_weight(F.col("severity"))), F.desc("detected_at"), F.desc("id"))
        .limit(1)
    )


def sorted_feed(events: DataFrame, mode: str) -> DataFrame:
    """Order by ``confidence``, ``severity`` or ``date``; ids break ties."""
    by: dict[str, Column] = {
        "confidence": F.desc(F.coalesce("confidence_score", F.lit(UNKNOWN_CONFIDENCE))),
        "severity": F.desc(severity_weight(F.col("severity"))),
        "date": F.desc("detected_at"),
    }
    return events.orderBy(by[mode], F.desc("id"))


def search_feed(events: DataFrame, text: str, severity: str | None = None) -> DataFrame:
    """Events that mention a text in metric, region, product or report, whatever its case."""
    found = events if severity is None else events.where(F.upper("severity") == severity)
    if not text:
        return found
    needle = F.lit(text.lower())
    hits = [
        F.contains(F.lower(F.coalesce(c, F.lit(""))), needle)
        for c in ("metric_name", "region", "product_name", "root_cause_summary")
    ]
    return found.where(reduce(lambda a, b: a | b, hits))


def severity_summary(events: DataFrame) -> DataFrame:
    critical = F.count_if(F.col("severity") == "CRITICAL")
    return events.agg(critical.alias("critical"), (F.count("*") - critical).alias("other"))


def cascade_reports(reports: DataFrame, surviving: DataFrame) -> DataFrame:
    """Reports whose event still exists."""
    return reports.join(surviving.select(F.col("id").alias("anomaly_id")), "anomaly_id", "left_semi")


def pending(events: DataFrame, reports: DataFrame) -> DataFrame:
    """Events without a report."""
    return events.join(reports.select(F.col("anomaly_id").alias("id")), "id", "left_anti")


def insert_reports(reports: DataFrame, existing: DataFrame) -> DataFrame:
    """All reports after the insert; an event that has one keeps it."""
    fresh = reports.dropDuplicates(["anomaly_id"]).join(existing.select("anomaly_id"), "anomaly_id", "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))
