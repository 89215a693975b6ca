"""Schemas of the stored tables, as DDL text."""

from __future__ import annotations

SLICE_COLUMNS = ["region", "product_name", "customer_tier"]

METRIC_COLUMNS = [
    "daily_spend_amount",
    "transaction_count",
    "avg_ticket_size",
    "success_rate_pct",
    "avg_latency_ms",
    "chargeback_rate_pct",
    "avg_fraud_risk_score",
]

EVENT_KEY = ["dataset_source", "detected_at", "region", "product_name", "customer_tier", "metric_name"]


DAILY_METRICS = (
    "dataset_source string not null, metric_date date not null, region string not null, "
    "product_name string not null, customer_tier string not null, merchant_category string not null, "
    "daily_spend_amount double, transaction_count bigint, avg_ticket_size double, success_rate_pct double, "
    "avg_latency_ms double, chargeback_rate_pct double, avg_fraud_risk_score double"
)

GATEWAY_LOGS = (
    "log_date date, region string, partner_bank string, product_name string, gateway_channel string, "
    "total_requests bigint, successful_requests bigint, failed_requests bigint, timeout_504_count bigint, "
    "server_error_500_count bigint, avg_response_time_ms double, gateway_status string"
)

TICKETS = (
    "ticket_id bigint, dataset_source string, ticket_created_at timestamp, region string, product_name string, "
    "customer_tier string, customer_id string, issue_category string, priority string, dispute_amount double, "
    "sentiment_score double, subject string, message string, embedding array<float>"
)

ANOMALY_EVENTS = (
    "id bigint, dataset_source string, detected_at timestamp, metric_name string, region string, "
    "product_name string, customer_tier string, actual_value double, expected_value double, "
    "deviation_pct double, z_score double, severity string, status string"
)

SQL_EVIDENCE = (
    "struct<query:string,row_count:bigint,data:array<struct<metric_date:date,region:string,product_name:string,"
    "customer_tier:string,daily_spend_amount:double,transaction_count:bigint,success_rate_pct:double,"
    "avg_latency_ms:double,chargeback_rate_pct:double>>,error:string,explanation:string>"
)

CITATION = (
    "struct<ticket_id:bigint,customer_id:string,issue_category:string,complaint_text:string,similarity_score:double>"
)

REPORTS = (
    "anomaly_id bigint, root_cause_summary string, confidence_score double, "
    f"evidence_data struct<sql_history:array<{SQL_EVIDENCE}>,ticket_citations:array<{CITATION}>>, "
    "mitigation_steps string"
)

STATUS_LOG = "anomaly_id bigint, seq int, status string"
