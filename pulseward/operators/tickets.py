"""Ticket store: defaults, vectors, filtered similarity search, citations."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseward.functions.embedding import hash_embed, hash_embed_text
from pulseward.functions.matching import SIMILARITY_DIGITS
from pulseward.functions.numeric import key_id, round_stable
from pulseward.functions.text import strip
from pulseward.functions.vectors import cosine_to, vector_normalize

# What a ticket without a field gets, and the search thresholds.
TICKET_DEFAULTS = {
    "region": "West",
    "product_name": "General",
    "customer_tier": "Retail",
    "customer_id": "CUST-UNKNOWN",
    "issue_category": "General",
    "priority": "NORMAL",
    "dispute_amount": 0.0,
    "sentiment_score": 0.0,
    "subject": "",
    "message": "",
}
SEARCH_LIMIT = 5
SEARCH_MIN, CITATION_MIN, FALLBACK_MIN = 0.50, 0.40, 0.35

# Results known to have no more rows than this are broadcast to the table they are joined to.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """Mark narrow rows for broadcast where their number is bounded; leave the join to the planner otherwise."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def ticket_defaults(df: DataFrame, dataset_source: str, created_at: datetime) -> DataFrame:
    """Every ticket column filled, whether its column is missing or its value is null."""

    def filled(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)).alias(name) if name in df.columns else F.lit(default).alias(name)

    rest = [c for c in df.columns if c not in {*TICKET_DEFAULTS, "dataset_source", "ticket_created_at"}]
    return df.select(
        *rest,
        filled("dataset_source", dataset_source),
        filled("ticket_created_at", created_at),
        *[filled(name, default) for name, default in TICKET_DEFAULTS.items()],
    )


def ticket_text(tickets: DataFrame) -> Column:
    """What of a ticket is searched: its message, or its subject where the message is missing or blank."""
    texts = [strip(F.col(c)) for c in ("message", "subject") if c in tickets.columns]
    return F.coalesce(*[F.when(t != "", t) for t in texts], F.lit(""))


def embed_tickets(df: DataFrame, embed: Callable[[Column], Column] = hash_embed) -> DataFrame:
    """Give every ticket the normalised vector of its text."""
    return df.withColumn("embedding", vector_normalize(embed(ticket_text(df))))


def filter_tickets(
    df: DataFrame,
    dataset_source: str | None = None,
    region: str | None = None,
    product_name: str | None = None,
    customer_tier: str | None = None,
    issue_category: str | None = None,
    start_date: date | None = None,
    end_date: date | None = None,
) -> DataFrame:
    """Equality on dataset and region, case-insensitive parts of the other labels.

    Both dates mean midnight, so tickets later on the end day are not included.
    """
    for column, value in (("dataset_source", dataset_source), ("region", region)):
        if value:
            df = df.where(F.col(column) == value)
    parts = (("product_name", product_name), ("customer_tier", customer_tier), ("issue_category", issue_category))
    for column, value in parts:
        if value:
            df = df.where(F.ilike(F.col(column), F.lit(f"%{value.strip()}%")))
    if start_date:
        df = df.where(F.col("ticket_created_at") >= F.lit(start_date).cast("timestamp"))
    if end_date:
        df = df.where(F.col("ticket_created_at") <= F.lit(end_date).cast("timestamp"))
    return df


def ticket_topk(
    df: DataFrame, query_vector: list[float], limit: int = SEARCH_LIMIT, min_similarity: float = SEARCH_MIN
) -> DataFrame:
    """The most similar tickets, as a distributed top-k: each task sends at most ``limit`` rows.

    Only ids and vectors are scored; the other columns are fetched for the
    ``limit`` winners. Scores are compared before they are rounded for display.
    """
    scored = (
        df.where(F.col("embedding").isNotNull())
        .select("ticket_id", F.round(cosine_to(F.col("embedding"), query_vector), SIMILARITY_DIGITS).alias("similarity_score"))
        .where(F.col("similarity_score") >= min_similarity)
        .orderBy(F.desc("similarity_score"), "ticket_id")
        .limit(limit)
    )
    shown = scored.withColumn("similarity_score", F.round("similarity_score", 6))
    return df.drop("embedding").join(small(shown, limit), "ticket_id")


def search_tickets(df: DataFrame, query: str, limit: int = SEARCH_LIMIT, min_similarity: float = SEARCH_MIN) -> DataFrame:
    """Search by text with the lexical vectors; a blank query finds nothing."""
    if not query.strip():
        return df.drop("embedding").withColumn("similarity_score", F.lit(0.0)).limit(0)
    return ticket_topk(df, hash_embed_text(query), limit, min_similarity)


def citation_fields() -> list[Column]:
    return [
        F.col("ticket_id"),
        F.col("customer_id"),
        F.col("issue_category"),
        F.concat(F.col("subject"), F.lit(": "), F.col("message")).alias("complaint_text"),
        round_stable(F.col("similarity_score"), 4).alias("similarity_score"),
    ]


def citations(matches: DataFrame) -> DataFrame:
    return matches.select(*citation_fields())


def matched_citations(matches: DataFrame, tickets: DataFrame) -> DataFrame:
    """Matches with the citation fields of their tickets."""
    fields = tickets.select("ticket_id", "customer_id", "issue_category", "subject", "message")
    return fields.join(matches, "ticket_id").select("query_id", "rank", "is_fallback", *citation_fields())


def query_text(product: Column, region: Column, metric: Column) -> Column:
    return F.concat_ws(" ", product, region, metric)


def anomaly_queries(anomalies: DataFrame, embed: Callable[[Column], Column] = hash_embed) -> DataFrame:
    """One query per distinct segment and metric, so equal anomalies share one search."""
    keys = ["dataset_source", "region", "product_name", "customer_tier", "metric_name"]
    text = query_text(F.col("product_name"), F.col("region"), F.col("metric_name"))
    return (
        anomalies.select(*keys)
        .distinct()
        .select(*keys, key_id(*[F.col(c) for c in keys]).alias("query_id"), embed(text).alias("query_vector"))
    )


def citation_arrays(cited: DataFrame) -> DataFrame:
    """Citations of each query as one array in rank order; at most k entries per query."""
    entry = F.struct("rank", F.struct(*[c for c in cited.columns if c not in ("query_id", "rank", "is_fallback")]).alias("c"))
    return cited.groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["c"]).alias("ticket_citations")
    )
