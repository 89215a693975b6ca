"""KPIs of one dataset: overview, time series, partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseward.functions.numeric import round_stable, safe_ratio

# Exposure per ticket where a dataset has tickets only, the
# partition named when nothing is stored, and the KPI baselines and units.
EXPOSURE_PER_TICKET = 250.0
FALLBACK_DATASET = "KAGGLE_CFPB"
KPI_BASELINE = {"complaints": 95.0, "payments": 98.8}
KPI_UNIT = {"complaints": 1000.0, "payments": 1000000.0}


def overview(metrics: DataFrame, tickets: DataFrame, events: DataFrame, dataset_source: str) -> DataFrame:
    """One row of totals; datasets without transactions are summed up from their tickets.

    The three tables go through a single aggregate as one union, so every counter
    is combined on the map side and one row per task is shuffled.
    """

    def mine(df: DataFrame) -> DataFrame:
        return df.where(F.col("dataset_source") == dataset_source)

    facts = (
        mine(metrics)
        .select(
            F.lit("metric").alias("kind"),
            F.col("daily_spend_amount").alias("spend"),
            F.col("transaction_count").cast("bigint").alias("tx"),
            F.col("success_rate_pct").alias("success"),
        )
        .unionByName(
            mine(tickets).select(F.lit("ticket").alias("kind"), "priority"), allowMissingColumns=True
        )
        .unionByName(
            mine(events).select(F.lit("event").alias("kind"), "status", "severity"), allowMissingColumns=True
        )
    )
    kind = F.col("kind")
    totals = facts.agg(
        F.sum("spend").alias("spend"),
        F.sum("tx").alias("tx"),
        F.avg("success").alias("success"),
        F.count_if(kind == "ticket").alias("tickets"),
        F.count_if((kind == "ticket") & (F.col("priority") == "CRITICAL")).alias("disputed"),
        F.count_if(kind == "event").alias("total"),
        F.count_if((kind == "event") & (F.col("status") == "OPEN")).alias("open"),
        F.count_if((kind == "event") & (F.col("severity") == "CRITICAL")).alias("critical"),
    )
    from_tickets = F.coalesce("tx", F.lit(0)) == 0
    dispute_rate = F.coalesce(safe_ratio(F.col("disputed"), F.col("tickets")) * 100.0, F.lit(0.0))
    spend = F.when(from_tickets, F.col("tickets") * EXPOSURE_PER_TICKET).otherwise(F.col("spend"))
    success = F.when(from_tickets, F.greatest(F.lit(100.0) - dispute_rate, F.lit(0.0))).otherwise(F.col("success"))
    return totals.select(
        round_stable(F.coalesce(spend, F.lit(0.0)), 2).alias("total_spend"),
        F.coalesce(F.when(from_tickets, F.col("tickets")).otherwise(F.col("tx")), F.lit(0)).alias("total_transactions"),
        round_stable(F.coalesce(success, F.lit(0.0)), 2).alias("avg_success_rate_pct"),
        F.col("total").alias("total_anomalies_detected"),
        F.col("open").alias("open_anomalies_count"),
        F.col("critical").alias("critical_anomalies_count"),
    )


def timeseries(metrics: DataFrame, dataset_source: str) -> DataFrame:
    """Daily totals of a dataset in date order."""

    def shown(column, digits=2):
        return round_stable(F.coalesce(column, F.lit(0.0)), digits)

    return (
        metrics.where(F.col("dataset_source") == dataset_source)
        .groupBy("metric_date")
        .agg(
            shown(F.sum("daily_spend_amount")).alias("spend"),
            shown(F.avg("success_rate_pct")).alias("success_rate"),
            F.coalesce(F.sum("transaction_count"), F.lit(0)).cast("bigint").alias("transactions"),
            shown(F.avg("chargeback_rate_pct")).alias("dispute_rate"),
        )
        .orderBy("metric_date")
        .select(F.date_format("metric_date", "yyyy-MM-dd").alias("date"), "spend", "success_rate", "transactions", "dispute_rate")
    )


def list_datasets(metrics: DataFrame, tickets: DataFrame) -> DataFrame:
    """Names of the datasets with metrics or tickets; one default name when there is none."""
    return or_default(metrics.select("dataset_source").union(tickets.select("dataset_source")).distinct())


def or_default(names: DataFrame) -> DataFrame:
    """The names in order, or the default one where there is none."""
    default = names.sparkSession.createDataFrame([(1, FALLBACK_DATASET)], "place int, dataset_source string")
    both = names.select(F.lit(0).alias("place"), "dataset_source").union(default)
    # The first place that has a name; one row joins by value.
    return both.join(both.agg(F.min("place").alias("place")), "place").select("dataset_source").orderBy("dataset_source")


def kpi_delta(overview_row: DataFrame, kind: str) -> DataFrame:
    """Distance of the success rate to its baseline, spend in display units, and the alert count shown."""
    return overview_row.select(
        round_stable(F.col("total_spend") / KPI_UNIT[kind], 2).alias("spend_in_units"),
        round_stable(F.lit(KPI_BASELINE[kind]) - F.col("avg_success_rate_pct"), 1).alias("below_baseline"),
        F.least(F.lit(100.0), F.col("avg_success_rate_pct")).alias("progress_pct"),
        F.when(F.col("critical_anomalies_count") > 0, F.col("critical_anomalies_count"))
        .otherwise(F.col("open_anomalies_count"))
        .alias("alerts_shown"),
    )
