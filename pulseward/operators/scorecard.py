"""Scorecard of investigations against expected keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseward.functions.numeric import round_stable, safe_ratio

# Fixed values of the scorecard.
MIN_CONFIDENCE, MIN_SUMMARY_LENGTH, PRECISION_WITHOUT_CITATIONS = 0.70, 100, 0.50

# The golden scenarios. Anomaly id, title, region, product, tier, metric, actual, expected, deviation,
# z-score, severity, dataset, and the keywords its citations should hold.
GOLDEN_SCENARIOS = [
    (
        101,
        "CFPB Mortgage Disclosure & Escrow Grievance Surge",
        "West",
        "Mortgage",
        "Retail",
        "chargeback_dispute_spike",
        7.8,
        0.4,
        1850.0,
        4.1,
        "CRITICAL",
        "KAGGLE_CFPB",
        ["mortgage", "loan", "escrow", "closing", "dispute", "interest"],
    ),
    (
        102,
        "Credit Card Billing Dispute & Unauthorized Surcharge Spike",
        "South",
        "Credit Card",
        "Enterprise",
        "chargeback_dispute_spike",
        6.2,
        0.8,
        675.0,
        3.8,
        "CRITICAL",
        "KAGGLE_CFPB",
        ["card", "fee", "unauthorized", "charge", "dispute", "billing"],
    ),
    (
        103,
        "Bank Account Overdraft & Processing Latency Friction",
        "East",
        "Bank account or service",
        "Retail",
        "avg_latency_surge",
        1850.0,
        140.0,
        1221.0,
        4.8,
        "CRITICAL",
        "KAGGLE_CFPB",
        ["account", "deposit", "overdraft", "transfer", "fee", "delay"],
    ),
]
GOLDEN_SCHEMA = (
    "anomaly_id bigint, title string, region string, product_name string, customer_tier string, metric_name string, "
    "actual_value double, expected_value double, deviation_pct double, z_score double, severity string, "
    "dataset_source string, keywords array<string>"
)


def golden_scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GOLDEN_SCENARIOS, GOLDEN_SCHEMA)


def retrieval_precision(texts: Column, keywords: Column) -> Column:
    """Share of the keywords that occur in the citation texts."""
    joined = F.lower(F.array_join(texts, " "))
    hits = F.size(F.filter(keywords, lambda k: F.contains(joined, k)))
    return F.when(F.size(texts) > 0, F.coalesce(round_stable(safe_ratio(hits, F.size(keywords)), 2), F.lit(0.0))).otherwise(
        F.lit(PRECISION_WITHOUT_CITATIONS)
    )


def scorecard(scenarios: DataFrame, reports: DataFrame) -> DataFrame:
    """One row per scenario (``anomaly_id``, ``keywords``); a scenario without a report fails."""
    joined = scenarios.join(reports, "anomaly_id", "left")
    missing = F.col("evidence_data").isNull()
    history = F.col("evidence_data.sql_history")
    texts = F.transform("evidence_data.ticket_citations", lambda c: c["complaint_text"])
    sql_pass = (F.size(history) > 0) & F.forall(history, lambda q: q["error"].isNull())
    synthesis_pass = (F.col("confidence_score") >= MIN_CONFIDENCE) & (
        F.length("root_cause_summary") > MIN_SUMMARY_LENGTH
    )

    def unless_missing(value: Column, otherwise) -> Column:
        return F.when(missing, F.lit(otherwise)).otherwise(value)

    return joined.select(
        "anomaly_id",
        unless_missing(F.size(history), 0).alias("sql_queries"),
        unless_missing(sql_pass, False).alias("sql_pass"),
        unless_missing(F.size(texts), 0).alias("citations"),
        unless_missing(retrieval_precision(texts, F.col("keywords")), 0.0).alias("retrieval_precision"),
        unless_missing(F.col("confidence_score"), 0.0).alias("confidence"),
        unless_missing(synthesis_pass, False).alias("synthesis_pass"),
        F.when(missing, "FAIL").when(sql_pass & synthesis_pass, "PASS").otherwise("WARN").alias("overall_status"),
    )


def scorecard_summary(card: DataFrame) -> DataFrame:
    """Totals of a scorecard; PASS and WARN count as passed. ``elapsed_sec`` is averaged where it is given."""
    passed = F.count_if(F.col("overall_status").isin("PASS", "WARN"))
    extra = [round_stable(F.avg("elapsed_sec"), 2).alias("avg_latency")] if "elapsed_sec" in card.columns else []
    return card.agg(
        F.count("*").alias("scenarios"),
        passed.alias("passed"),
        F.coalesce(round_stable(safe_ratio(passed, F.count("*")) * 100.0, 1), F.lit(0.0)).alias("pass_rate"),
        F.coalesce(round_stable(F.avg("confidence"), 2), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(round_stable(F.avg("retrieval_precision"), 4), F.lit(0.0)).alias("avg_precision"),
        *extra,
    )
