"""Report texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseward.functions.text import metric_title, signed_percent

# Wording of the report an investigation writes without a model.
SUMMARY_HEAD = "### Executive Incident Assessment: %s\n\n"
SUMMARY_TELEMETRY = (
    "**Telemetry Anomaly**: In the **%s** region for **%s**, anomalous %s reached **%s** "
    "(Baseline: **%s**, Deviation: **%s**).\n\n"
)
SUMMARY_EVIDENCE = (
    "**Corroborated Telemetry & Qualitative Evidence**:\n"
    "- SQL telemetry verified multi-metric deviation across %d queries.\n"
    "- Qualitative analysis of %d customer support citations corroborates operational friction:\n"
)
SUMMARY_CAUSE = "**Root Cause**: Operational degradation and transaction volume friction in **%s** for **%s**."
CITATION_LINE = '- Citation: "%s"'
NO_CITATION_LINE = "- No direct dispute complaints filed."
MITIGATION = (
    "1. Isolate degraded infrastructure routing channels in %s.\n"
    "2. Audit backend transaction queue thresholds for %s.\n"
    "3. Proactively communicate resolution updates to affected customer tiers."
)
CONFIDENCE = 0.94
DEFAULT_SUMMARY, DEFAULT_MITIGATION = "Detailed RCA established.", "1. Audit telemetry alerts."
EVIDENCE_QUERY = (
    "SELECT metric_date, region, product_name, customer_tier, daily_spend_amount, transaction_count, "
    "success_rate_pct, avg_latency_ms, chargeback_rate_pct FROM daily_spend_metrics "
    "WHERE region = '%s' AND product_name = '%s' ORDER BY metric_date DESC LIMIT 10;"
)
EVIDENCE_EXPLANATION = "Inspect historical daily metrics and telemetry trend."


def number_text(value: Column) -> Column:
    """A double in plain notation, with at least one decimal."""
    value = value.cast("double")
    size = F.abs(value)
    plain = F.regexp_replace(value.try_cast("decimal(38,9)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when((size != 0) & ((size >= 1e7) | (size < 1e-3)), plain).otherwise(value.cast("string"))


def summary_text(citation_texts: Column, queries: Column, found: Column) -> Column:
    """Root-cause summary of the anomaly of the row and its evidence."""
    region, product = F.col("region"), F.col("product_name")
    quoted = F.array_join(
        F.transform(citation_texts, lambda t: F.format_string(CITATION_LINE, t)),
        "\n",
    )
    return F.concat(
        F.format_string(SUMMARY_HEAD, metric_title(F.col("metric_name"))),
        F.format_string(
            SUMMARY_TELEMETRY,
            region,
            product,
            F.col("metric_name"),
            number_text(F.col("actual_value")),
            number_text(F.col("expected_value")),
            signed_percent(F.col("deviation_pct")),
        ),
        F.format_string(SUMMARY_EVIDENCE, queries, found),
        F.when(quoted != "", quoted).otherwise(F.lit(NO_CITATION_LINE)),
        F.lit("\n\n"),
        F.format_string(SUMMARY_CAUSE, region, product),
    )


def mitigation_text() -> Column:
    return F.format_string(MITIGATION, F.col("region"), F.col("product_name"))


def evidence_query() -> Column:
    """The default evidence query of an anomaly as text, its labels quoted for SQL."""
    quoted = [F.replace(F.col(c), F.lit("'"), F.lit("''")) for c in ("region", "product_name")]
    return F.format_string(EVIDENCE_QUERY, *quoted)


def report_document() -> Column:
    """A report row joined to its anomaly as one Markdown document."""
    amount = lambda c: F.format_string("%.2f", F.col(c))
    metrics = F.transform(
        "evidence_data.sql_history",
        lambda q: F.format_string("%s %d rows.\n\n    %s\n\n", q["explanation"], q["row_count"], q["query"]),
    )
    tickets = F.transform(
        "evidence_data.ticket_citations",
        lambda c: F.format_string("%d. (%.2f) %s\n", c["ticket_id"], c["similarity_score"], c["complaint_text"]),
    )
    return F.concat(
        F.format_string("# Incident %d: %s\n\n", F.col("anomaly_id"), F.col("metric_name")),
        F.lit("| Region | Product | Tier | Actual | Expected | Deviation | Severity | Confidence |\n"),
        F.lit("|---|---|---|---|---|---|---|---|\n"),
        F.format_string(
            "| %s | %s | %s | %s | %s | %s%% | %s | %s |\n\n",
            F.col("region"),
            F.col("product_name"),
            F.col("customer_tier"),
            amount("actual_value"),
            amount("expected_value"),
            amount("deviation_pct"),
            F.col("severity"),
            amount("confidence_score"),
        ),
        F.col("root_cause_summary"),
        F.lit("\n\n## Next steps\n\n"),
        F.col("mitigation_steps"),
        F.lit("\n\n## Metric rows\n\n"),
        F.array_join(metrics, ""),
        F.lit("## Tickets\n\n"),
        F.array_join(tickets, ""),
    )
