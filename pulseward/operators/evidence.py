"""Evidence for anomalies, gathered for all of them at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseward.functions.templates import EVIDENCE_EXPLANATION, evidence_query

# Fixed values of the evidence queries.
EVIDENCE_ROWS = 10
EVIDENCE_COLUMNS = [
    "metric_date",
    "region",
    "product_name",
    "customer_tier",
    "daily_spend_amount",
    "transaction_count",
    "success_rate_pct",
    "avg_latency_ms",
    "chargeback_rate_pct",
]
SEGMENT = ["region", "product_name"]


def latest_metrics(metrics: DataFrame, k: int = EVIDENCE_ROWS) -> DataFrame:
    """The latest k metric rows of every region and product, across datasets.

    The rank sits right below its filter, so each task keeps k rows per segment
    before anything is shuffled.
    """
    tie = [c for c in ("customer_tier", "merchant_category", "dataset_source") if c in metrics.columns]
    latest = Window.partitionBy(*SEGMENT).orderBy(F.desc("metric_date"), *tie, "daily_spend_amount")
    return metrics.withColumn("rank", F.row_number().over(latest)).where(F.col("rank") <= k)


def evidence_metrics(anomalies: DataFrame, metrics: DataFrame, k: int = EVIDENCE_ROWS) -> DataFrame:
    """Latest metric rows next to every anomaly of their segment."""
    latest = latest_metrics(metrics, k).select("rank", *EVIDENCE_COLUMNS)
    return anomalies.select(F.col("id").alias("anomaly_id"), *SEGMENT).join(latest, SEGMENT)


def metric_arrays(metrics: DataFrame, k: int = EVIDENCE_ROWS) -> DataFrame:
    """The latest rows of a segment as one array, at most k long."""
    row = F.struct(*[F.col(c).cast("double").alias(c) if c == "daily_spend_amount" else F.col(c) for c in EVIDENCE_COLUMNS])
    return (
        latest_metrics(metrics, k)
        .groupBy(*SEGMENT)
        .agg(F.sort_array(F.collect_list(F.struct("rank", row.alias("row")))).alias("ranked"))
        .select(*SEGMENT, F.transform("ranked", lambda r: r["row"]).alias("data"))
    )


def sql_evidence(anomalies: DataFrame, metrics: DataFrame) -> DataFrame:
    """Anomalies with ``sql_history``: the record of their one evidence query."""
    joined = anomalies.join(metric_arrays(metrics), SEGMENT, "left")
    rows = F.coalesce(F.size("data"), F.lit(0))
    record = F.struct(
        evidence_query().alias("query"),
        F.greatest(rows, F.lit(0)).cast("bigint").alias("row_count"),
        F.coalesce(F.col("data"), F.filter(F.array(F.lit(None).cast(joined.schema["data"].dataType.elementType)), lambda x: F.lit(False))).alias("data"),
        F.lit(None).cast("string").alias("error"),
        F.lit(EVIDENCE_EXPLANATION).alias("explanation"),
    )
    return joined.withColumn("sql_history", F.array(record)).drop("data")


def gateway_degraded(logs: DataFrame, region: str | None = None, product: str | None = None) -> DataFrame:
    """Gateway days that were not fully operational."""
    bad = (F.col("gateway_status") != "OPERATIONAL") | (F.col("timeout_504_count") > 0) | (F.col("failed_requests") > 0)
    for column, value in (("region", region), ("product_name", product)):
        if value:
            logs = logs.where(F.col(column) == value)
    return logs.where(bad)


def evidence_gateway(anomalies: DataFrame, logs: DataFrame, cap: int | None = None) -> DataFrame:
    """All degraded gateway days of the segment of every anomaly, or its latest ``cap`` with their ``rank``."""
    days = gateway_degraded(logs)
    if cap is not None:
        latest = Window.partitionBy(*SEGMENT).orderBy(F.desc("log_date"), F.desc("failed_requests"), "partner_bank")
        days = days.withColumn("rank", F.row_number().over(latest)).where(F.col("rank") <= cap)
    return anomalies.select(F.col("id").alias("anomaly_id"), *SEGMENT).join(days, SEGMENT)


def gateway_by_segment(anomalies: DataFrame, logs: DataFrame) -> DataFrame:
    """All degraded gateway days of segments with anomalies, each once, with how many anomalies it bears on and the smallest id."""
    counted = anomalies.groupBy(*SEGMENT).agg(F.count("*").alias("anomalies"), F.min("id").alias("first_anomaly_id"))
    return gateway_degraded(logs).join(counted, SEGMENT)


def append_evidence(df: DataFrame, column: str, more: str) -> DataFrame:
    """Append one array column to another, as successive findings of one investigation."""
    return df.withColumn(column, F.concat(F.col(column), F.col(more))).drop(more)


def evidence_gaps(counted: DataFrame) -> DataFrame:
    """Which evidence an anomaly still lacks, from ``metric_rows`` and ``citations``: metrics, tickets, both or none."""
    no_metrics, no_tickets = F.col("metric_rows") == 0, F.col("citations") == 0
    lacking = (
        F.when(no_metrics & no_tickets, "both").when(no_metrics, "metrics").when(no_tickets, "tickets").otherwise("none")
    )
    return counted.withColumn("lacking", lacking)
