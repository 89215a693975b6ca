"""Views that give the TPC-H-like driver tables the shapes the engine works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share(predicate: Column) -> Column:
    """Fraction of the rows of a group for which the predicate holds."""
    return F.avg(F.when(predicate, F.lit(1.0)).otherwise(F.lit(0.0)))


def metrics_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense daily series: ten slices of the event stream."""
    user = F.col("user_id")
    is_error = F.col("event_type") == "error"
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.to_date("ts").alias("metric_date"),
            F.concat(F.lit("R"), (user % 5).cast("string")).alias("region"),
            F.when(user % 10 >= 5, "P1").otherwise("P0").alias("product_name"),
        )
        .agg(
            F.sum("value").alias("daily_spend_amount"),
            F.count("*").alias("transaction_count"),
            F.avg("value").alias("avg_ticket_size"),
            (F.lit(100.0) - F.lit(45.0) * share(is_error)).alias("success_rate_pct"),
            (F.lit(20.0) * F.avg("value")).alias("avg_latency_ms"),
            (F.lit(7.0) * share(is_error)).alias("chargeback_rate_pct"),
            (F.lit(100.0) * share(is_error)).alias("avg_fraud_risk_score"),
        )
        .select(
            F.lit("EVENTS_30D").alias("dataset_source"),
            "metric_date",
            "region",
            "product_name",
            F.lit("Retail").alias("customer_tier"),
            F.lit("General").alias("merchant_category"),
            "daily_spend_amount",
            "transaction_count",
            "avg_ticket_size",
            "success_rate_pct",
            "avg_latency_ms",
            "chargeback_rate_pct",
            "avg_fraud_risk_score",
        )
    )


def _orders_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.count("*").alias("n_lines"),
            F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
        )
    )
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    )


def _orders_metrics(
    joined: DataFrame, merchant: Column, source: str, region: str = "r_name", product: str = "c_mktsegment"
) -> DataFrame:
    lines = F.sum("n_lines")
    return (
        joined.groupBy(
            F.to_date("o_orderdate").alias("metric_date"),
            F.col(region).alias("region"),
            F.col(product).alias("product_name"),
            merchant.alias("merchant_category"),
        )
        .agg(
            F.sum("o_totalprice").alias("daily_spend_amount"),
            F.count("*").alias("transaction_count"),
            F.avg("o_totalprice").alias("avg_ticket_size"),
            (F.lit(100.0) - F.lit(10.0) * share(F.col("o_orderstatus") == "P")).alias("success_rate_pct"),
            (F.lit(100.0) + F.lit(30.0) * F.sum("sum_qty") / lines).alias("avg_latency_ms"),
            (F.lit(3.0) * F.sum("n_returned") / lines).alias("chargeback_rate_pct"),
            (F.lit(100.0) * share(F.col("o_orderpriority") == "1-URGENT")).alias("avg_fraud_risk_score"),
        )
        .select(
            F.lit(source).alias("dataset_source"),
            "metric_date",
            "region",
            "product_name",
            F.lit("Retail").alias("customer_tier"),
            "merchant_category",
            "daily_spend_amount",
            "transaction_count",
            "avg_ticket_size",
            "success_rate_pct",
            "avg_latency_ms",
            "chargeback_rate_pct",
            "avg_fraud_risk_score",
        )
    )


def metrics_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse daily series over six years: 25 slices."""
    return _orders_metrics(_orders_joined(spark, sf_dir), F.lit("General"), "ORDERS")


def metrics_orders_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders in five slices by priority, each of six years of days."""
    joined = _orders_joined(spark, sf_dir).withColumn("everything", F.lit("All"))
    return _orders_metrics(joined, F.lit("General"), "ORDERS", "o_orderpriority", "everything")


def metrics_orders_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``metrics_orders`` with several rows per slice and day."""
    return _orders_metrics(_orders_joined(spark, sf_dir), F.col("o_orderpriority"), "ORDERS_FINE")


def tickets(spark: SparkSession, sf_dir: str, with_vectors: bool = True, with_text: bool = True) -> DataFrame:
    """Documents as tickets; queries that need no vectors leave their join out.

    Without text a message only tells whether there is one, so that counting messages moves none through the join.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    disputed = F.col("toxic") == 1
    documents = table(spark, sf_dir, "documents")
    if not with_text:
        documents = documents.withColumn("text", F.when(F.col("text").isNotNull(), ""))
    documents = documents.join(labels, "doc_id", "left")
    if with_vectors:
        vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
        documents = documents.join(vectors, "doc_id", "left")
    return (
        documents.select(
            F.col("doc_id").alias("ticket_id"),
            F.lit("DOCUMENTS").alias("dataset_source"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
            .cast("timestamp")
            .alias("ticket_created_at"),
            F.col("lang").alias("region"),
            F.col("source").alias("product_name"),
            F.lit("Retail").alias("customer_tier"),
            F.concat(F.lit("CUST-"), F.col("doc_id").cast("string")).alias("customer_id"),
            F.concat(F.col("source"), F.lit("/"), F.col("lang")).alias("issue_category"),
            F.when(disputed, "CRITICAL").otherwise("NORMAL").alias("priority"),
            F.when(disputed, F.lit(250.0)).otherwise(F.lit(0.0)).alias("dispute_amount"),
            F.when(disputed, F.lit(-0.7)).otherwise(F.lit(-0.3)).alias("sentiment_score"),
            F.concat(F.lit("["), F.col("source"), F.lit("] "), F.col("lang")).alias("subject"),
            F.col("text").alias("message"),
            *(["embedding"] if with_vectors else []),
        )
    )


def raw_complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complaint export as text columns only."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    doc = F.col("doc_id")
    return (
        table(spark, sf_dir, "documents")
        .join(labels, "doc_id", "left")
        .select(
            F.date_format(
                F.date_add(F.lit("2024-01-01").cast("date"), (doc % 30).cast("int")), "MM/dd/yyyy"
            ).alias("date_received"),
            F.col("source").alias("product"),
            F.col("lang").alias("issue"),
            F.col("text").alias("consumer_complaint_narrative"),
            doc.cast("string").alias("complaint_id"),
            F.when(doc % 17 != 0, F.col("lang")).alias("state"),
            F.when(F.col("toxic") == 1, "Yes").otherwise("No").alias("consumer_disputed?"),
        )
    )


def gateway_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.count_if(F.col("l_returnflag") == "R")
    total = F.count("*")
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(
            F.to_date("l_shipdate").alias("log_date"),
            F.col("r_name").alias("region"),
            F.col("s_name").alias("partner_bank"),
            F.element_at(F.array(*[F.lit(s) for s in SEGMENTS]), (F.col("s_suppkey") % 5).cast("int") + 1).alias(
                "product_name"
            ),
        )
        .agg(
            total.alias("total_requests"),
            (total - failed).alias("successful_requests"),
            failed.alias("failed_requests"),
            (F.lit(20.0) * F.avg("l_quantity")).alias("avg_response_time_ms"),
        )
        .select(
            "log_date",
            "region",
            "partner_bank",
            "product_name",
            F.lit("DIRECT_API").alias("gateway_channel"),
            "total_requests",
            "successful_requests",
            "failed_requests",
            F.lit(0).cast("bigint").alias("timeout_504_count"),
            F.lit(0).cast("bigint").alias("server_error_500_count"),
            "avg_response_time_ms",
            F.when(F.col("failed_requests") == F.col("total_requests"), "OUTAGE")
            .when(F.col("failed_requests") > 0, "DEGRADED")
            .otherwise("OPERATIONAL")
            .alias("gateway_status"),
        )
    )
