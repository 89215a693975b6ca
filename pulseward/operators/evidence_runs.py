"""Evidence queries that are run: one batch a template for all anomalies, each with its rows or its error."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseward.functions.guard import UnsafeQuery
from pulseward.functions.numeric import round_stable
from pulseward.operators.evidence import EVIDENCE_ROWS
from pulseward.operators.sandbox import checked_sql
from pulseward.session import staged

# Confidence without any evidence and with all of it: fixed values, the upper one that of a complete report.
LEAST_CONFIDENCE, FULL_CONFIDENCE = 0.50, 0.94

RUNS = "anomaly_id bigint, template string, row_count bigint, rows array<string>, error string"


@dataclass(frozen=True)
class Template:
    """A read-only query over ``anomalies`` and the given tables, whose rows say by ``anomaly_id`` what they are evidence for."""

    name: str
    sql: str


TEMPLATES = [
    Template(
        "week_before",
        "SELECT a.id AS anomaly_id, m.metric_date, m.transaction_count FROM anomalies a JOIN daily_spend_metrics m "
        "ON m.region = a.region AND m.product_name = a.product_name AND m.customer_tier = a.customer_tier "
        "WHERE m.metric_date <= CAST(a.detected_at AS DATE) AND m.metric_date > CAST(a.detected_at AS DATE) - INTERVAL 7 DAYS",
    ),
    Template(
        "disputes_of_the_day",
        "SELECT a.id AS anomaly_id, t.ticket_id, t.issue_category FROM anomalies a JOIN dispute_support_tickets t "
        "ON t.region = a.region AND t.product_name = a.product_name AND CAST(t.ticket_created_at AS DATE) = CAST(a.detected_at AS DATE) "
        "WHERE t.priority = 'CRITICAL'",
    ),
]


def _run(anomalies: DataFrame, tables: Mapping[str, DataFrame], template: Template) -> DataFrame:
    """(anomaly_id, row_count, rows): how many rows the template has for an anomaly, and the first of them as JSON."""
    found = checked_sql(anomalies.sparkSession, {**tables, "anomalies": anomalies}, template.sql)
    if "anomaly_id" not in found.columns:
        raise UnsafeQuery(f"template {template.name} has no anomaly_id")
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in found.columns if c != "anomaly_id"]))
    first = Window.partitionBy("anomaly_id").orderBy("row")
    rows = found.select("anomaly_id", row.alias("row"))
    heads = rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= EVIDENCE_ROWS)
    shown = heads.groupBy("anomaly_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    counted = rows.groupBy("anomaly_id").agg(F.count("*").alias("row_count")).join(shown, "anomaly_id")
    return staged(counted, "evidence")  # written here, so that what fails while it runs fails now


def evidence_runs(anomalies: DataFrame, tables: Mapping[str, DataFrame], templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """One row per anomaly and template: ``row_count`` and up to EVIDENCE_ROWS ``rows`` as JSON, or the ``error`` it ended with.

    A template that is refused, does not fit the tables, or fails while it runs leaves its error with every anomaly; the
    others go on.
    """
    spark = anomalies.sparkSession
    asked = anomalies.select(F.col("id").alias("anomaly_id"))
    out = spark.createDataFrame([], RUNS)
    for template in templates:
        error = None
        try:
            found = asked.join(_run(anomalies, tables, template), "anomaly_id", "left")
        except (UnsafeQuery, PySparkException) as failed:
            error = str(failed).split("\n")[0]
            found = asked.select("anomaly_id", F.lit(None).cast("bigint").alias("row_count"), F.lit(None).cast("array<string>").alias("rows"))
        out = out.unionByName(
            found.select(
                "anomaly_id",
                F.lit(template.name).alias("template"),
                F.coalesce("row_count", F.lit(0)).alias("row_count"),
                F.coalesce("rows", F.array().cast("array<string>")).alias("rows"),
                F.lit(error).cast("string").alias("error"),
            )
        )
    return out


def run_scores(runs: DataFrame) -> DataFrame:
    """Per anomaly: queries, whether all ran, rows found, and a confidence that follows from the share of queries with rows."""
    share = F.count_if(F.col("row_count") > 0) / F.count("*")
    return runs.groupBy("anomaly_id").agg(
        F.count("*").alias("sql_queries"),
        F.every(F.col("error").isNull()).alias("sql_pass"),
        F.sum("row_count").alias("rows_found"),
        round_stable(F.lit(LEAST_CONFIDENCE) + F.lit(FULL_CONFIDENCE - LEAST_CONFIDENCE) * share, 4).alias("confidence"),
    )
