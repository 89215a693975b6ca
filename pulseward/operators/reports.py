"""Reports of investigated anomalies and their event feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseward.functions import templates as t
from pulseward.functions.text import text_or_default


def build_reports(evidence: DataFrame) -> DataFrame:
    """Report rows for anomalies that carry ``sql_history`` and ``ticket_citations``."""
    texts = F.transform("ticket_citations", lambda c: c["complaint_text"])
    summary = t.summary_text(texts, F.size("sql_history"), F.size("ticket_citations"))
    return evidence.select(
        F.col("id").alias("anomaly_id"),
        text_or_default(summary, t.DEFAULT_SUMMARY).alias("root_cause_summary"),
        F.lit(t.CONFIDENCE).alias("confidence_score"),
        F.struct("sql_history", "ticket_citations").alias("evidence_data"),
        text_or_default(t.mitigation_text(), t.DEFAULT_MITIGATION).alias("mitigation_steps"),
    )


def report_documents(reports: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One Markdown document per report."""
    joined = reports.join(anomalies.withColumnRenamed("id", "anomaly_id"), "anomaly_id")
    return joined.select("anomaly_id", t.report_document().alias("document"))


def report_counts(reports: DataFrame) -> DataFrame:
    """Pieces of evidence behind every report."""
    return reports.select(
        "anomaly_id",
        F.size("evidence_data.sql_history").alias("sql_queries"),
        F.aggregate("evidence_data.sql_history", F.lit(0).cast("bigint"), lambda n, q: n + q["row_count"]).alias("metric_rows"),
        F.size("evidence_data.ticket_citations").alias("citations"),
        "confidence_score",
    )


def investigation_events(reports: DataFrame, anomalies: DataFrame) -> DataFrame:
    """The ordered feed of every investigation, payloads as JSON.

    All events of one report are built from its own row, so the feed needs one
    join and no sort.
    """
    joined = reports.join(anomalies.withColumnRenamed("id", "anomaly_id"), "anomaly_id")

    def event(kind: str, payload: Column) -> Column:
        return F.struct(F.lit(kind).alias("event"), payload.alias("data"))

    info = event(
        "anomaly_info",
        F.to_json(
            F.struct(
                F.col("anomaly_id").alias("id"),
                F.col("metric_name").alias("metric"),
                "region",
                F.col("product_name").alias("product"),
                "severity",
                F.col("actual_value").alias("actual"),
                F.col("expected_value").alias("expected"),
            )
        ),
    )
    metrics = F.transform("evidence_data.sql_history", lambda q: event("sql_evidence", F.to_json(q)))
    cited = F.transform("evidence_data.ticket_citations", lambda c: event("ticket_evidence", F.to_json(c)))
    verdict = event("rca_report", F.to_json(F.struct("root_cause_summary", "confidence_score", "mitigation_steps")))
    complete = event("complete", F.to_json(F.struct(F.lit("DONE").alias("status"), "anomaly_id")))
    return joined.select(
        "anomaly_id", F.posexplode(F.concat(F.array(info), metrics, cited, F.array(verdict, complete))).alias("seq", "e")
    ).select("anomaly_id", "seq", "e.event", "e.data")
