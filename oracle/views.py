"""DuckDB text of the views over the driver tables, as lists of CTEs."""

METRICS_EVENTS = """
metrics_events AS (
  SELECT 'EVENTS_30D' AS dataset_source, CAST(ts AS DATE) AS metric_date,
    'R' || CAST(user_id % 5 AS VARCHAR) AS region,
    CASE WHEN user_id % 10 >= 5 THEN 'P1' ELSE 'P0' END AS product_name,
    'Retail' AS customer_tier, 'General' AS merchant_category,
    sum(value) AS daily_spend_amount, count(*) AS transaction_count, avg(value) AS avg_ticket_size,
    100.0::DOUBLE - 45.0::DOUBLE * avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS success_rate_pct,
    20.0::DOUBLE * avg(value) AS avg_latency_ms,
    7.0::DOUBLE * avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS chargeback_rate_pct,
    100.0::DOUBLE * avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS avg_fraud_risk_score
  FROM events GROUP BY ALL)"""


def orders_view(name: str, source: str, merchant: str, region: str = "r_name", product: str = "c_mktsegment") -> str:
    return f"""
{name} AS (
  SELECT '{source}' AS dataset_source, CAST(o_orderdate AS DATE) AS metric_date,
    {region} AS region, {product} AS product_name, 'Retail' AS customer_tier, {merchant} AS merchant_category,
    sum(o_totalprice) AS daily_spend_amount, count(*) AS transaction_count, avg(o_totalprice) AS avg_ticket_size,
    100.0::DOUBLE - 10.0::DOUBLE * avg(CASE WHEN o_orderstatus = 'P' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS success_rate_pct,
    100.0::DOUBLE + 30.0::DOUBLE * sum(sum_qty) / sum(n_lines) AS avg_latency_ms,
    3.0::DOUBLE * sum(n_returned) / sum(n_lines) AS chargeback_rate_pct,
    100.0::DOUBLE * avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS avg_fraud_risk_score
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (
    SELECT l_orderkey, sum(l_quantity) AS sum_qty, count(*) AS n_lines,
      count(*) FILTER (l_returnflag = 'R') AS n_returned
    FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
  GROUP BY ALL)"""


METRICS_ORDERS = orders_view("metrics_orders", "ORDERS", "'General'")
METRICS_ORDERS_PRIORITY = orders_view("metrics_orders_priority", "ORDERS", "'General'", "o_orderpriority", "'All'")
METRICS_ORDERS_FINE = orders_view("metrics_orders_fine", "ORDERS_FINE", "o_orderpriority")

TICKETS = """
tickets AS (
  SELECT d.doc_id AS ticket_id, 'DOCUMENTS' AS dataset_source,
    CAST(DATE '2024-01-01' + CAST(d.doc_id % 30 AS INTEGER) AS TIMESTAMP) AS ticket_created_at,
    lang AS region, source AS product_name, 'Retail' AS customer_tier,
    'CUST-' || CAST(d.doc_id AS VARCHAR) AS customer_id, source || '/' || lang AS issue_category,
    CASE WHEN toxic = 1 THEN 'CRITICAL' ELSE 'NORMAL' END AS priority,
    CASE WHEN toxic = 1 THEN 250.0::DOUBLE ELSE 0.0::DOUBLE END AS dispute_amount,
    CASE WHEN toxic = 1 THEN -0.7::DOUBLE ELSE -0.3::DOUBLE END AS sentiment_score,
    '[' || source || '] ' || lang AS subject, text AS message, embedding
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""

RAW_COMPLAINTS = """
raw_complaints AS (
  SELECT strftime(DATE '2024-01-01' + CAST(d.doc_id % 30 AS INTEGER), '%m/%d/%Y') AS date_received,
    source AS product, lang AS issue, text AS consumer_complaint_narrative,
    CAST(d.doc_id AS VARCHAR) AS complaint_id,
    CASE WHEN d.doc_id % 17 <> 0 THEN lang END AS state,
    CASE WHEN toxic = 1 THEN 'Yes' ELSE 'No' END AS disputed
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

GATEWAY_LOGS = """
gateway_logs AS (
  SELECT log_date, region, partner_bank, product_name, total_requests, total_requests - failed_requests AS successful_requests,
    failed_requests, 0::BIGINT AS timeout_504_count, avg_response_time_ms,
    CASE WHEN failed_requests = total_requests THEN 'OUTAGE' WHEN failed_requests > 0 THEN 'DEGRADED' ELSE 'OPERATIONAL' END AS gateway_status
  FROM (
    SELECT CAST(l_shipdate AS DATE) AS log_date, r_name AS region, s_name AS partner_bank,
      (['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])[s_suppkey % 5 + 1] AS product_name,
      count(*) AS total_requests, count(*) FILTER (l_returnflag = 'R') AS failed_requests,
      20.0::DOUBLE * avg(l_quantity) AS avg_response_time_ms
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY ALL))"""


def rnd(expr: str, digits: int) -> str:
    """The counterpart of ``round_stable``, by way of decimals so that ties round half up."""
    return f"CAST(round(CAST(({expr}) AS DECIMAL(38, 8)), {digits}) AS DOUBLE)"


def iso(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def query(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select
