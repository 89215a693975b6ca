"""DuckDB text shared by the queries about events, tickets and reports."""

from oracle import scan as s
from oracle import views as v
from oracle.views import rnd

BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
MD5_ID = "('0x' || substr(md5({text}), 1, 15))::BIGINT"
SEGMENT = "dataset_source, region, product_name, customer_tier, metric_name"


def key_id(*parts: str) -> str:
    return MD5_ID.format(text=" || '|' || ".join(parts))


def ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def events(source: str, name: str = "found", signals: str = "signals") -> str:
    ident = key_id(f"'{source}'", "strftime(metric_date, '%Y-%m-%d') || ' 00:00:00'", "region", "product_name", "customer_tier", "metric_name")
    return f"""{name} AS (
  SELECT {ident} AS id, '{source}' AS dataset_source, CAST(metric_date AS TIMESTAMP) AS detected_at, metric_name, region,
    product_name, customer_tier, actual_value, expected_value, deviation_pct, z_score, severity, 'OPEN' AS status FROM {signals})"""


EVENT_SELECT = (
    f"id, dataset_source, {ts('detected_at')} AS detected_at, metric_name, region, product_name, customer_tier, "
    f"{rnd('actual_value', 6)} AS actual_value, expected_value, deviation_pct, z_score, severity, status"
)

DAILY_COLUMNS = """transaction_count * 250.0::DOUBLE AS daily_spend_amount, transaction_count, 250.0::DOUBLE AS avg_ticket_size,
    greatest(100.0::DOUBLE - disputes / transaction_count * 100.0::DOUBLE, 5.0::DOUBLE) AS success_rate_pct,
    180.0::DOUBLE + disputes * 40.0::DOUBLE AS avg_latency_ms, disputes / transaction_count * 100.0::DOUBLE AS chargeback_rate_pct,
    least(disputes * 20.0::DOUBLE, 95.0::DOUBLE) AS avg_fraud_risk_score"""


def daily(tickets: str, source: str, name: str = "ticket_daily") -> str:
    return f"""{name} AS (
  SELECT '{source}' AS dataset_source, metric_date, region, product_name, customer_tier, 'CFPB Grievances' AS merchant_category, {DAILY_COLUMNS}
  FROM (SELECT CAST(ticket_created_at AS DATE) AS metric_date, region, product_name, customer_tier,
      count(message) AS transaction_count, count(*) FILTER (priority = 'CRITICAL') AS disputes FROM {tickets} GROUP BY ALL))"""


def ticket_events() -> list[str]:
    """CTEs up to ``found``: the events of the daily ticket KPIs."""
    return [v.TICKETS, *s.scan(daily("tickets", "DOCUMENTS"), "ticket_daily"), events("DOCUMENTS")]


def event_events() -> list[str]:
    return [*s.scan(v.METRICS_EVENTS, "metrics_events"), events("EVENTS_30D")]


STATUSED = "statused AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN 'RESOLVED' ELSE status END AS status) FROM found)"

ANCHORED = [
    "anchors AS (SELECT label, arg_min(embedding, vec_id) AS query_vector FROM embeddings GROUP BY label)",
    f"""asked AS (
  SELECT *, {key_id(*[c.strip() for c in SEGMENT.split(',')])} AS query_id FROM (SELECT DISTINCT {SEGMENT} FROM found))""",
    "anchored AS (SELECT asked.*, query_vector FROM asked JOIN anchors ON query_id % 10 = label)",
    """pairs AS (
  SELECT q.query_id, t.ticket_id, q.region AS q_region, q.product_name AS q_product, q.customer_tier AS q_tier,
    t.region, t.product_name, t.customer_tier,
    round(list_cosine_similarity(t.embedding::DOUBLE[], q.query_vector::DOUBLE[]), 12) AS similarity
  FROM anchored q JOIN tickets t ON q.dataset_source = t.dataset_source WHERE t.embedding IS NOT NULL)""",
]


def chosen(strict_min: float, broad_min: float, k: int = 5) -> str:
    return f"""ranked AS (
  SELECT query_id, 0 AS pass, ticket_id, similarity FROM pairs WHERE similarity >= {strict_min} AND region = q_region
    AND product_name ILIKE '%' || q_product || '%' AND customer_tier ILIKE '%' || q_tier || '%'
  UNION ALL SELECT query_id, 1, ticket_id, similarity FROM pairs WHERE similarity >= {broad_min}),
best AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, pass ORDER BY similarity DESC, ticket_id) AS rank FROM ranked
  QUALIFY row_number() OVER (PARTITION BY query_id, pass ORDER BY similarity DESC, ticket_id) <= {k}),
chosen AS (SELECT * FROM best QUALIFY pass = min(pass) OVER (PARTITION BY query_id)),
cited AS (
  SELECT query_id, rank, pass = 1 AS is_fallback, c.ticket_id, customer_id, issue_category,
    subject || ': ' || message AS complaint_text, {rnd('similarity', 4)} AS similarity_score
  FROM chosen c JOIN tickets USING (ticket_id))"""


CITED = [*ANCHORED, chosen(0.20, 0.15)]


def evidence(cited: bool) -> list[str]:
    """CTEs up to ``reported``: the report of every event of ``found``."""
    lists = (
        f"""arrays AS (
  SELECT {SEGMENT}, list(struct_pack(ticket_id := ticket_id, complaint_text := complaint_text, similarity_score := similarity_score) ORDER BY rank) AS cites
  FROM cited JOIN asked USING (query_id) GROUP BY ALL)"""
        if cited
        else f"arrays AS (SELECT {SEGMENT}, NULL::STRUCT(ticket_id BIGINT, complaint_text VARCHAR, similarity_score DOUBLE)[] AS cites FROM found WHERE FALSE)"
    )
    title = (
        "CASE metric_name WHEN 'success_rate_plunge' THEN 'Success Rate Plunge' WHEN 'avg_latency_surge' THEN 'Avg Latency Surge'"
        " ELSE 'Chargeback Dispute Spike' END"
    )
    signed = f"printf('%+.1f%%', {rnd('deviation_pct', 1)})"
    quotes = "array_to_string(list_transform(cites, lambda c: '- Citation: \"' || c.complaint_text || '\"'), chr(10))"
    nl = "chr(10)"
    return [
        lists,
        """latest AS (
  SELECT region, product_name, count(*) AS n_rows FROM (
    SELECT region, product_name FROM ticket_daily
    QUALIFY row_number() OVER (PARTITION BY region, product_name ORDER BY metric_date DESC) <= 10) GROUP BY ALL)""",
        f"""joined AS (
  SELECT f.*, coalesce(cites, []) AS cites, coalesce(n_rows, 0) AS n_rows FROM found f
  LEFT JOIN arrays USING ({SEGMENT}) LEFT JOIN latest USING (region, product_name))""",
        f"""reported AS (
  SELECT *, id AS anomaly_id, 0.94::DOUBLE AS confidence_score, 1 AS sql_queries, len(cites) AS citations,
    '### Executive Incident Assessment: ' || {title} || {nl} || {nl} ||
    '**Telemetry Anomaly**: In the **' || region || '** region for **' || product_name || '**, anomalous ' || metric_name ||
    ' reached **' || CAST(actual_value AS VARCHAR) || '** (Baseline: **' || CAST(expected_value AS VARCHAR) || '**, Deviation: **' || {signed} || '**).' || {nl} || {nl} ||
    '**Corroborated Telemetry & Qualitative Evidence**:' || {nl} || '- SQL telemetry verified multi-metric deviation across 1 queries.' || {nl} ||
    '- Qualitative analysis of ' || len(cites) || ' customer support citations corroborates operational friction:' || {nl} ||
    CASE WHEN len(cites) > 0 THEN {quotes} ELSE '- No direct dispute complaints filed.' END || {nl} || {nl} ||
    '**Root Cause**: Operational degradation and transaction volume friction in **' || region || '** for **' || product_name || '**.' AS root_cause_summary,
    '1. Isolate degraded infrastructure routing channels in ' || region || '.' || {nl} ||
    '2. Audit backend transaction queue thresholds for ' || product_name || '.' || {nl} ||
    '3. Proactively communicate resolution updates to affected customer tiers.' AS mitigation_steps,
    'SELECT metric_date, region, product_name, customer_tier, daily_spend_amount, transaction_count, success_rate_pct, avg_latency_ms, chargeback_rate_pct FROM daily_spend_metrics WHERE region = '''
      || replace(region, '''', '''''') || ''' AND product_name = ''' || replace(product_name, '''', '''''') || ''' ORDER BY metric_date DESC LIMIT 10;' AS evidence_query
  FROM joined)""",
    ]
