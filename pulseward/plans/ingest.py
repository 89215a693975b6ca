"""From a file to stored metrics and tickets."""

from __future__ import annotations

from datetime import date, datetime
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseward.functions.numeric import key_id
from pulseward.functions.text import dataset_slug
from pulseward.operators.complaints import ComplaintExport, complaint_daily
from pulseward.operators.inference import TableRoles, infer_roles
from pulseward.operators.ingestion import ingest_head, ingest_metrics, ingest_summary, ingest_tickets
from pulseward.operators.tickets import embed_tickets
from pulseward.plans.store import append_metrics, append_once, append_tickets, upload_key
from pulseward.session import staged
from pulseward.sources.files import read_complaints, read_profiled


def slug_of(spark: SparkSession, path: str) -> str:
    return spark.range(1).select(dataset_slug(F.lit(PurePosixPath(path).name))).first()[0]


def infer_file(spark: SparkSession, path: str, sample: int = 5) -> TableRoles:
    """Roles of the columns of a file; an empty file is an error."""
    table, columns = read_profiled(spark, path)
    return infer_roles(table, slug_of(spark, path), sample, columns)


def ingest_file(
    spark: SparkSession,
    path: str,
    metrics_path: str,
    tickets_path: str,
    run_date: date,
    mapping: TableRoles | None = None,
    order_by: str | None = None,
    max_records: int | None = None,
    manifest_path: str | None = None,
) -> dict:
    """Ingest a file and return its summary; an empty file gives zeros.

    The parsed rows are written to the shared folder once, as columns, so that
    the profile, metrics and tickets each read only what they need; types and roles come from that one profile.
    ``order_by`` names the column whose order stands for the order of the input. With ``manifest_path`` the same rows
    with the same roles and ``run_date`` are stored once however often they are ingested; readers then use ``read_committed``.
    """
    table, columns = read_profiled(spark, path)
    if not columns or not columns[0]["rows"]:
        name = mapping.source if mapping else "empty_dataset"
        return {"dataset_name": name, "total_records": 0, "metrics_inserted": 0, "tickets_embedded": 0}
    if max_records:  # the roles are those of the rows taken
        table, columns = staged(ingest_head(table, max_records, order_by or table.columns[0]), "ingest"), None
    if mapping is None:
        mapping = infer_roles(table, slug_of(spark, path), sample=0, columns=columns)
    metrics, embedded = ingest_metrics(table, mapping, run_date), None
    if mapping.narrative in table.columns:
        created = datetime(run_date.year, run_date.month, run_date.day)
        embedded = embed_tickets(with_ticket_ids(ingest_tickets(table, mapping, created, order_by or mapping.time)))
    if manifest_path:
        tables = {metrics_path: metrics} | ({tickets_path: embedded} if embedded is not None else {})
        append_once(tables, manifest_path, upload_key(table, f"{mapping} {run_date}"))
    else:
        append_metrics(metrics, metrics_path)
        if embedded is not None:
            append_tickets(embedded, tickets_path)
    return ingest_summary(table, mapping, run_date).first().asDict()


def with_ticket_ids(tickets: DataFrame) -> DataFrame:
    """A reproducible ``ticket_id`` from source, customer, time and message; equal tickets are numbered.

    The customer is the whole ``entity_id`` where there is one.
    """
    who = F.concat(F.lit("CUST-"), F.col("entity_id")) if "entity_id" in tickets.columns else F.col("customer_id")
    key = [F.col("dataset_source"), who, F.col("ticket_created_at"), F.col("message")]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("issue_category", "subject"))
    numbered = tickets.withColumn("nth", nth)
    return numbered.withColumn("ticket_id", key_id(*key[:3], F.md5("message"), F.col("nth"))).drop("nth")


def ingest_complaints(
    spark: SparkSession,
    path: str,
    mapping: ComplaintExport,
    metrics_path: str,
    tickets_path: str,
    dataset_source: str,
    max_records: int | None = None,
    by_ranges: bool = False,
) -> DataFrame:
    """Store the complaints of an export as tickets and as daily KPIs; returns the counts of both as one row."""
    normal = read_complaints(spark, path, mapping, max_records, by_ranges=by_ranges).withColumn("dataset_source", F.lit(dataset_source))
    tickets = staged(normal, "complaints")
    append_tickets(embed_tickets(with_ticket_ids(tickets)), tickets_path)
    daily = complaint_daily(tickets, dataset_source)
    append_metrics(daily, metrics_path)
    counts = tickets.select(F.lit(1).alias("ticket")).unionByName(
        daily.select(F.lit(1).alias("daily")), allowMissingColumns=True
    )
    return counts.agg(
        F.count("ticket").alias("total_parsed"),
        F.count("ticket").alias("tickets_inserted"),
        F.count("daily").alias("daily_metrics_inserted"),
    ).select(F.lit(PurePosixPath(path).name).alias("source_file"), "*")
