"""Evidence and reports for every anomaly that has none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseward.functions.embedding import hash_embed
from pulseward.operators.events import STATUS_ORDER, pending
from pulseward.operators.evidence import sql_evidence
from pulseward.operators.nearest import nearest_tickets
from pulseward.operators.reports import build_reports, report_documents
from pulseward.operators.tickets import (
    CITATION_MIN,
    FALLBACK_MIN,
    SEARCH_LIMIT,
    anomaly_queries,
    citation_arrays,
    matched_citations,
)
from pulseward.plans.store import PARTITION, append_rows, read_stored, write_documents
from pulseward.schemas import ANOMALY_EVENTS, CITATION, DAILY_METRICS, REPORTS, STATUS_LOG, TICKETS

SEGMENT_KEYS = ["dataset_source", "region", "product_name", "customer_tier", "metric_name"]


def with_citations(
    anomalies: DataFrame,
    tickets: DataFrame,
    queries: DataFrame,
    strict_min: float = CITATION_MIN,
    broad_min: float = FALLBACK_MIN,
    k: int = SEARCH_LIMIT,
) -> DataFrame:
    """Anomalies with ``ticket_citations``; ``queries`` has one row per distinct segment and metric."""
    matches = nearest_tickets(queries, tickets, k, strict_min, broad_min)
    arrays = queries.select("query_id", *SEGMENT_KEYS).join(
        citation_arrays(matched_citations(matches, tickets)), "query_id"
    )
    keyed = arrays.select(*[F.col(c).alias(f"q_{c}") for c in SEGMENT_KEYS], "ticket_citations")
    same = F.lit(True)
    for c in SEGMENT_KEYS:
        same = same & F.col(c).eqNullSafe(F.col(f"q_{c}"))
    none = F.array().cast(f"array<{CITATION}>")
    return (
        anomalies.join(keyed, same, "left")
        .drop(*[f"q_{c}" for c in SEGMENT_KEYS])
        .withColumn("ticket_citations", F.coalesce("ticket_citations", none))
    )


def investigate(
    anomalies: DataFrame,
    metrics: DataFrame,
    tickets: DataFrame,
    reports: DataFrame | None = None,
    embed: Callable[[Column], Column] = hash_embed,
    strict_min: float = CITATION_MIN,
    broad_min: float = FALLBACK_MIN,
) -> DataFrame:
    """Reports of the anomalies that have none yet."""
    waiting = anomalies if reports is None else pending(anomalies, reports)
    cited = with_citations(waiting, tickets, anomaly_queries(waiting, embed), strict_min, broad_min)
    return build_reports(sql_evidence(cited, metrics))


def investigate_and_persist(
    spark: SparkSession,
    dataset_source: str,
    events_path: str,
    metrics_path: str,
    tickets_path: str,
    reports_path: str,
    status_path: str,
    documents_path: str | None = None,
    embed: Callable[[Column], Column] = hash_embed,
) -> DataFrame:
    """Investigate every event of a dataset that has no report and return the reports of the dataset.

    Events read as investigating while the batch runs and as resolved when their
    report is stored. Each step takes up only what an earlier run left undone, so
    a run that broke off can be repeated.
    """
    events = read_stored(spark, events_path, ANOMALY_EVENTS).where(F.col(PARTITION) == dataset_source)
    tickets = read_stored(spark, tickets_path, TICKETS)

    def stored() -> DataFrame:
        mine = events.select(F.col("id").alias("anomaly_id"))
        return read_stored(spark, reports_path, REPORTS).join(mine, "anomaly_id", "left_semi")

    def log(ids: DataFrame, status: str) -> DataFrame:
        """Transitions of the given events to a status their log does not hold yet; returns the events."""
        known = read_stored(spark, status_path, STATUS_LOG).where(F.col("status") == status).select("anomaly_id")
        fresh = ids.join(known, "anomaly_id", "left_anti")
        append_rows(
            fresh.select("anomaly_id", F.lit(STATUS_ORDER.index(status)).alias("seq"), F.lit(status).alias("status")),
            status_path,
        )
        return fresh

    waiting = pending(events, stored())
    log(waiting.select(F.col("id").alias("anomaly_id")), "INVESTIGATING")
    append_rows(investigate(waiting, read_stored(spark, metrics_path, DAILY_METRICS), tickets, embed=embed), reports_path)
    if documents_path:
        resolved = read_stored(spark, status_path, STATUS_LOG).where(F.col("status") == "RESOLVED").select("anomaly_id")
        undocumented = stored().join(resolved, "anomaly_id", "left_anti")
        write_documents(report_documents(undocumented, events), documents_path)
    log(stored().select("anomaly_id"), "RESOLVED")
    return stored()
