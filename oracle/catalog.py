"""DuckDB text for the registered queries."""

from __future__ import annotations

from oracle import parts as p
from oracle import scan as s
from oracle import views as v
from oracle.views import iso, query, rnd

SLICE = s.SLICE


def _series(prefixes: list[str]) -> str:
    return ", ".join(f"{rnd(f'{p}_{m}', 6)} AS {p}_{m}" for m in s.BASELINES for p in prefixes)


def _scan_queries() -> dict[str, str]:
    fine = [v.METRICS_ORDERS_FINE, s.deduped("metrics_orders_fine")]
    sparse = [v.METRICS_ORDERS, s.deduped("metrics_orders"), s.filled()]
    measures = [c for c in s.CARRIED] + ["daily_spend_amount"]
    key = f"{SLICE}, {iso('metric_date')} AS metric_date"
    forest_select = f"SELECT {key}, {rnd('iso_score', 6)} AS iso_score, is_isolated FROM isolated"
    return {
        "slice_dedupe": query(
            *fine,
            select=f"SELECT dataset_source, {key}, merchant_category, transaction_count, "
            + ", ".join(f"{rnd(c, 6)} AS {c}" for c in measures)
            + " FROM deduped",
        ),
        "calendar_fill": query(
            *sparse,
            select=f"SELECT {key}, is_observed, {rnd('transaction_count', 6)} AS transaction_count, "
            + ", ".join(f"{rnd(c, 6)} AS {c}" for c in measures)
            + " FROM filled",
        ),
        "rolling_baseline": query(*sparse, s.baselined(14), select=f"SELECT {key}, {_series(['mean', 'sd'])} FROM baselined"),
        "rolling_zscore": query(
            *sparse, s.baselined(14), s.scored(), select=f"SELECT {key}, {_series(['z', 'expected'])} FROM scored"
        ),
        "anomaly_signals": s.scan_query(v.METRICS_EVENTS, "metrics_events"),
        "anomaly_signals_sparse": s.scan_query(v.METRICS_ORDERS, "metrics_orders"),
        "iforest_scores": query(
            *s.scan(v.METRICS_EVENTS, "metrics_events", use_forest=True, max_depth=5), select=forest_select
        ),
        "iforest_scores_sparse": query(
            *s.scan(v.METRICS_ORDERS_PRIORITY, "metrics_orders_priority", use_forest=True), select=forest_select
        ),
        "anomaly_signals_fine": s.scan_query(v.METRICS_ORDERS_FINE, "metrics_orders_fine"),
        "anomaly_signals_full": s.scan_query(v.METRICS_EVENTS, "metrics_events", use_forest=True, max_depth=5),
    }


def _event_queries() -> dict[str, str]:
    found = p.ticket_events()
    statused = [*found, p.STATUSED]
    reported = [*found, *p.evidence(cited=False)]
    early_view = v.METRICS_EVENTS
    weight = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
    early = s.scan("early_metrics AS (SELECT * FROM metrics_events WHERE metric_date < DATE '2024-01-16')", "early_metrics")
    early_forest = s.scan(
        "early_metrics AS (SELECT * FROM metrics_events WHERE metric_date < DATE '2024-01-16')", "early_metrics", use_forest=True, max_depth=5
    )
    renamed = [
        c.replace("deduped", "e_deduped").replace("filled", "e_filled").replace("spine", "e_spine")
        .replace("baselined", "e_baselined").replace("scored", "e_scored").replace("isolated", "e_isolated")
        .replace("signals AS", "e_signals AS")
        for c in early
    ]
    renamed = [c.replace("is_e_isolated", "is_isolated") for c in renamed]
    summary = "CASE WHEN id % 3 = 0 THEN root_cause_summary END AS root_cause_summary"
    fake = p.key_id("'DOCUMENTS'", "'2024-01-06 00:00:00'", "'en'", "'src5'", "'Retail'", "'chargeback_dispute_spike'")
    scored_feed = "CASE WHEN id % 3 = 0 THEN 0.94 ELSE 0.8 END"
    top = "(SELECT '{m}' AS mode, id, severity FROM reported ORDER BY {o}, id DESC)"
    return {
        "scan_partition": query(
            v.METRICS_EVENTS,
            select=f"SELECT dataset_source, {iso('metric_date')} AS metric_date, {SLICE}, merchant_category, transaction_count, "
            + ", ".join(
                f"{rnd(c, 6)} AS {c}" for c in [*s.CARRIED, "daily_spend_amount", "avg_ticket_size"]
            )
            + " FROM metrics_events",
        ),
        "events_insert_if_absent": query(
            *p.event_events(),
            *renamed,
            p.events("EVENTS_30D", "stored", "e_signals"),
            select=f"SELECT {p.EVENT_SELECT} FROM (SELECT * FROM stored UNION ALL SELECT * FROM found f WHERE NOT EXISTS "
            "(SELECT 1 FROM stored s WHERE s.id = f.id))",
        ),
        "incremental_scan": query(
            *s.scan(early_view, "metrics_events", use_forest=True, max_depth=5),
            p.events("EVENTS_30D"),
            # a WITH of its own keeps the names of the earlier scan apart
            "stored AS (WITH " + ", ".join([*early_forest, p.events("EVENTS_30D")]) + " SELECT * FROM found)",
            select=f"SELECT {p.EVENT_SELECT} FROM (SELECT * FROM stored UNION ALL SELECT * FROM found f WHERE NOT EXISTS "
            "(SELECT 1 FROM stored s WHERE s.id = f.id))",
        ),
        "anomaly_feed": query(
            *statused,
            select=f"SELECT {p.EVENT_SELECT} FROM (SELECT * FROM statused WHERE dataset_source = 'DOCUMENTS' AND status = 'OPEN' "
            "AND severity = 'CRITICAL' ORDER BY detected_at DESC, id DESC LIMIT 50 OFFSET 5)",
        ),
        "anomaly_feed_total": query(
            *statused, select="SELECT count(*) AS total FROM statused WHERE status = 'OPEN' AND region = 'en'"
        ),
        "anomaly_by_id": query(*found, select=f"SELECT {p.EVENT_SELECT} FROM found WHERE id = {fake}"),
        "anomaly_with_report": query(
            *reported,
            select=f"SELECT id, metric_name, severity, {summary}, CASE WHEN id % 3 = 0 THEN confidence_score END AS confidence_score, "
            "CASE WHEN id % 3 = 0 THEN mitigation_steps END AS mitigation_steps FROM reported",
        ),
        "anomalies_pending": query(*found, select=f"SELECT {p.EVENT_SELECT} FROM found WHERE id % 3 <> 0"),
        "anomaly_current_status": query(*statused, select="SELECT id, metric_name, status FROM statused"),
        "next_open_anomaly": query(
            *statused,
            select=f"SELECT {p.EVENT_SELECT} FROM (SELECT * FROM statused WHERE status = 'OPEN' ORDER BY {weight} DESC, "
            "detected_at DESC, id DESC LIMIT 1)",
        ),
        "feed_sorted": query(
            *reported,
            select=" UNION ALL ".join(
                "SELECT * FROM " + top.format(m=m, o=o)
                for m, o in (
                    ("confidence", f"{scored_feed} DESC"),
                    ("severity", f"{weight} DESC"),
                    ("date", "detected_at DESC"),
                )
            ),
        ),
        "feed_search": query(
            *reported,
            select="SELECT id, region, product_name, metric_name FROM reported WHERE severity = 'CRITICAL' AND (contains(lower(metric_name), 'src1') "
            "OR contains(lower(region), 'src1') OR contains(lower(product_name), 'src1') OR (id % 3 = 0 AND contains(lower(root_cause_summary), 'src1')))",
        ),
        "severity_summary": query(
            *found,
            select="SELECT count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity <> 'CRITICAL') AS other FROM found",
        ),
        "reports_cascade": query(
            *found, select="SELECT id AS anomaly_id, 0.94::DOUBLE AS confidence_score FROM found WHERE id % 3 = 0 AND severity = 'CRITICAL'"
        ),
        "reports_idempotent": query(
            *found,
            select="SELECT id AS anomaly_id, CASE WHEN id % 3 = 0 THEN 0.5::DOUBLE ELSE 0.94::DOUBLE END AS confidence_score FROM found",
        ),
    }


OVERVIEW = f"""SELECT {rnd("coalesce(CASE WHEN tx = 0 THEN n_tickets * 250.0::DOUBLE ELSE spend END, 0.0)", 2)} AS total_spend,
  CASE WHEN tx = 0 THEN n_tickets ELSE tx END AS total_transactions,
  {rnd("coalesce(CASE WHEN tx = 0 THEN greatest(100.0::DOUBLE - coalesce(100.0::DOUBLE * disputed / nullif(n_tickets, 0), 0.0), 0.0) ELSE success END, 0.0)", 2)} AS avg_success_rate_pct,
  total AS total_anomalies_detected, open AS open_anomalies_count, critical AS critical_anomalies_count
FROM (SELECT sum(daily_spend_amount) AS spend, CAST(coalesce(sum(transaction_count), 0) AS BIGINT) AS tx, avg(success_rate_pct) AS success
      FROM metrics_events WHERE dataset_source = '{{ds}}') m,
  (SELECT count(*) AS n_tickets, count(*) FILTER (priority = 'CRITICAL') AS disputed FROM tickets WHERE dataset_source = '{{ds}}') t,
  (SELECT count(*) AS total, count(*) FILTER (status = 'OPEN') AS open, count(*) FILTER (severity = 'CRITICAL') AS critical FROM found) e"""


def _telemetry_queries() -> dict[str, str]:
    on_events = [v.TICKETS, *p.event_events()]
    over = OVERVIEW.replace("{ds}", "EVENTS_30D")
    types = (
        "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
        "WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE 'string' END"
    )
    verdicts = " ".join(
        f"WHEN regexp_matches(q, '(?i)\\b{w}\\b') THEN '{w.upper()}'"
        for w in (
            "INSERT UPDATE DELETE DROP ALTER TRUNCATE GRANT REVOKE CREATE EXEC EXECUTE CALL MERGE reflect try_reflect java_method"
        ).split()
    )
    return {
        "overview": query(*on_events, select=over),
        "overview_fallback": query(
            v.METRICS_EVENTS, *p.ticket_events(), select=OVERVIEW.replace("{ds}", "DOCUMENTS")
        ),
        "timeseries": query(
            v.METRICS_ORDERS,
            select=f"""SELECT {iso('metric_date')} AS date, {rnd('sum(daily_spend_amount)', 2)} AS spend, {rnd('avg(success_rate_pct)', 2)} AS success_rate,
  CAST(sum(transaction_count) AS BIGINT) AS transactions, {rnd('coalesce(avg(chargeback_rate_pct), 0.0)', 2)} AS dispute_rate
FROM metrics_orders GROUP BY metric_date ORDER BY metric_date""",
        ),
        "list_datasets": query(
            v.METRICS_EVENTS,
            v.METRICS_ORDERS,
            v.TICKETS,
            select="SELECT dataset_source FROM metrics_events UNION SELECT dataset_source FROM metrics_orders UNION SELECT dataset_source FROM tickets",
        ),
        "list_stored_datasets": query(
            v.METRICS_EVENTS, v.TICKETS, select="SELECT dataset_source FROM metrics_events UNION SELECT dataset_source FROM tickets"
        ),
        "kpi_delta": query(
            *on_events,
            f"over_view AS ({over})",
            select=f"""SELECT {rnd('total_spend / 1000000.0', 2)} AS spend_in_units, {rnd('98.8::DOUBLE - avg_success_rate_pct', 1)} AS below_baseline,
  least(100.0::DOUBLE, avg_success_rate_pct) AS progress_pct,
  CASE WHEN critical_anomalies_count > 0 THEN critical_anomalies_count ELSE open_anomalies_count END AS alerts_shown FROM over_view""",
        ),
        "schema_summary": f"""SELECT 'ACTIVE DATABASE SCHEMAS:' || chr(10) || string_agg(line, chr(10) ORDER BY table_name) AS summary FROM (
  SELECT table_name, '- ' || table_name || ' (' || string_agg(column_name || ' ' || {types}, ', ' ORDER BY ordinal_position) || ')' AS line
  FROM information_schema.columns WHERE table_name IN ('documents', 'events', 'lineitem', 'orders') GROUP BY table_name)""",
        "guarded_sql": query(
            v.METRICS_ORDERS,
            select=f"""SELECT region, product_name, {iso('max(metric_date)')} AS last_day, count(*)::DOUBLE AS days, {rnd('sum(daily_spend_amount)', 2)} AS spend
FROM metrics_orders GROUP BY region, product_name ORDER BY region, product_name""",
        ),
        "sql_guard_audit": f"""WITH forms AS (
  SELECT text FROM conversations UNION ALL
  SELECT CASE p_partkey % 9 WHEN 0 THEN 'SELECT * FROM part WHERE p_partkey = ' || p_partkey || ';'
    WHEN 1 THEN 'select p_name from part where p_name = ''' || p_name || ''' LIMIT 5'
    WHEN 2 THEN 'DROP TABLE part' || p_partkey || ';' WHEN 3 THEN 'SELECT 1; DELETE FROM part WHERE p_partkey = ' || p_partkey
    WHEN 4 THEN '  WITH t AS (SELECT ' || p_partkey || ' AS k) SELECT k FROM t' WHEN 5 THEN 'UPDATE part SET p_size = ' || p_partkey
    WHEN 6 THEN 'SELECT updated_at, created_by FROM part' || p_partkey WHEN 7 THEN 'EXPLAIN SELECT ' || p_partkey
    ELSE 'SELECT reflect(''java.lang.System'', ''exit'', ' || p_partkey || ')' END FROM part),
trimmed AS (SELECT trim(text, {p.BLANKS}) AS t FROM forms),
cleaned AS (SELECT CASE WHEN t LIKE '%;' THEN trim(left(t, length(t) - 1), {p.BLANKS}) ELSE t END AS q FROM trimmed)
SELECT CASE WHEN contains(q, ';') THEN 'MULTIPLE' {verdicts} WHEN regexp_matches(q, '(?i)^(SELECT|WITH)\\b') THEN 'OK' ELSE 'NOT_SELECT' END AS verdict,
  count(*) AS texts, CAST(sum(length(q)) AS BIGINT) AS characters FROM cleaned GROUP BY 1""",
    }


NORMALIZED = f"""normalized AS (
  SELECT strptime(date_received, '%m/%d/%Y') AS ticket_created_at, substr(coalesce(state, 'West'), 1, 50) AS region,
    substr(product, 1, 100) AS product_name, CASE WHEN contains(product, 'Corporate') OR contains(product, 'Commercial') THEN 'Enterprise' ELSE 'Retail' END AS customer_tier,
    'CUST-' || right(complaint_id, 6) AS customer_id, substr(issue, 1, 50) AS issue_category,
    CASE WHEN disputed = 'Yes' THEN 'CRITICAL' ELSE 'NORMAL' END AS priority,
    CASE WHEN disputed = 'Yes' THEN 250.0::DOUBLE ELSE 0.0::DOUBLE END AS dispute_amount,
    CASE WHEN disputed = 'Yes' THEN -0.7::DOUBLE ELSE -0.3::DOUBLE END AS sentiment_score,
    '[' || product || '] ' || issue AS subject, trim(consumer_complaint_narrative, {p.BLANKS}) AS message,
    'Financial Institution' AS company, complaint_id
  FROM raw_complaints WHERE trim(consumer_complaint_narrative, {p.BLANKS}) <> '' AND lower(consumer_complaint_narrative) <> 'nan')"""
NORMAL_SELECT = (
    f"SELECT {p.ts('ticket_created_at')} AS ticket_created_at, region, product_name, customer_tier, customer_id, issue_category, priority, "
    "dispute_amount, sentiment_score, subject, md5(message) AS message, company FROM normalized"
)
DAILY_SELECT = (
    f"SELECT dataset_source, {iso('metric_date')} AS metric_date, {SLICE}, merchant_category, daily_spend_amount, transaction_count, avg_ticket_size, "
    + ", ".join(f"{rnd(c, 6)} AS {c}" for c in s.CARRIED)
)

UPLOAD = """upload AS (
  SELECT event_id, CASE WHEN event_id % 50 NOT IN (7, 8) THEN CAST(ts AS DATE) ELSE DATE '2024-02-01' END AS day,
    CASE WHEN event_id % 50 = 7 THEN 'not a time' WHEN event_id % 50 <> 8 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts, user_id,
    CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type, 'b' || (user_id % 4) AS bucket,
    CASE WHEN event_id % 13 <> 0 THEN value END AS value,
    CASE WHEN event_id % 7 = 0 THEN 'None' WHEN event_id % 7 = 1 THEN '  ' ELSE props END AS props FROM events)"""


def _roles() -> str:
    tables = {
        "documents": ("doc_id", ["doc_id", "text", "lang", "source", "n_chars"], ["doc_id", "n_chars"]),
        "events": (None, ["event_id", "ts", "user_id", "event_type", "value", "props"], ["event_id", "user_id", "value"]),
        "lineitem": (
            None,
            "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split(),
            "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split(),
        ),
        "orders": (
            None,
            "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split(),
            "o_orderkey o_custkey o_totalprice".split(),
        ),
    }
    rows = []
    for t, (_, columns, numeric) in tables.items():
        for i, c in enumerate(columns):
            length = "NULL::DOUBLE" if c in numeric else f"(SELECT avg(length(CAST({c} AS VARCHAR))) FROM {t})"
            rows.append(f"SELECT '{t}' AS table_name, {i}::BIGINT AS ordinal, '{c}' AS column_name, {c in numeric} AS is_numeric, {length} AS avg_length")
    words = lambda ws: " OR ".join(f"contains(lower(column_name), '{w}')" for w in ws)
    times = ["timestamp", "time", "date", "created_at", "received", "event_time", "datetime", "logged_at"]
    first_time = ", ".join(f"min(ordinal) FILTER (contains(lower(column_name), '{w}'))" for w in times)
    return f"""WITH profile AS ({' UNION ALL '.join(rows)}),
named AS (SELECT table_name, coalesce({first_time}) AS by_name FROM profile GROUP BY table_name),
parsed AS (
  SELECT 'documents' AS table_name, CASE WHEN (SELECT count(*) FROM (SELECT lang FROM documents LIMIT 10) WHERE try_cast(lang AS TIMESTAMP) IS NULL) = 0 THEN 2 ELSE 0 END AS by_value
  UNION ALL SELECT 'events', (SELECT CASE WHEN count(*) = 0 THEN 3 WHEN FALSE THEN 5 ELSE 0 END FROM (SELECT event_type FROM events LIMIT 10) WHERE try_cast(event_type AS TIMESTAMP) IS NULL)),
timed AS (
  SELECT p.*, p.ordinal = coalesce(by_name, by_value, 0) AS is_time FROM profile p JOIN named USING (table_name) LEFT JOIN parsed USING (table_name)),
tagged AS (
  SELECT *, NOT is_time AND is_numeric AS is_metric,
    NOT is_time AND NOT is_numeric AND ({words("narrative reason comment message text description log complaint feedback".split())} OR avg_length > 25) AS tells,
    NOT is_time AND is_numeric AND ({words("latency spend amount rate count value percent cpu time".split())}) AS preferred FROM timed),
firsts AS (
  SELECT table_name, min(ordinal) FILTER (tells) AS narrative_at,
    coalesce(min(ordinal) FILTER (preferred), min(ordinal) FILTER (is_metric)) AS primary_at FROM tagged GROUP BY table_name)
SELECT table_name, ordinal, column_name, CASE WHEN is_time THEN 'timestamp' WHEN is_metric THEN 'metric' WHEN ordinal = narrative_at THEN 'narrative' ELSE 'dimension' END AS role,
  coalesce(ordinal = primary_at, FALSE) AS is_primary FROM tagged JOIN firsts USING (table_name)"""


def _ingest_queries() -> dict[str, str]:
    raw = [v.RAW_COMPLAINTS, NORMALIZED]
    docs = {"doc_id": True, "text": False, "lang": False, "source": False, "n_chars": True}
    profile = " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS ordinal, '{c}' AS column_name, {num} AS is_numeric, count(*) AS row_count, count({c}) AS non_null, "
        + ("NULL::DOUBLE" if num else rnd(f"avg(length({c}))", 6))
        + " AS avg_length FROM documents"
        for i, (c, num) in enumerate(docs.items())
    )
    generic = "'Standard' AS customer_tier, 'General' AS merchant_category"
    tail = "100.0::DOUBLE AS avg_latency_ms, 0.5::DOUBLE AS chargeback_rate_pct, 1.0::DOUBLE AS avg_fraud_risk_score"
    usable = f"props IS NOT NULL AND trim(props, {p.BLANKS}) <> '' AND lower(props) <> 'none'"
    part = "p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice"
    customer = "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer"
    event_metrics = query(
        UPLOAD,
        select=f"""SELECT 'event_stream' AS dataset_source, {iso('day')} AS metric_date, event_type AS region, bucket AS product_name, {generic},
  {rnd('avg(value) * count(*)', 6)} AS daily_spend_amount, count(*) AS transaction_count, {rnd('avg(value)', 6)} AS avg_ticket_size, 95.0::DOUBLE AS success_rate_pct, {tail}
FROM upload WHERE event_type IS NOT NULL GROUP BY day, event_type, bucket""",
    )
    exported = NORMALIZED.replace("coalesce(state, 'West')", "coalesce(state, 'None')")
    written = {"user_id": "user_id::VARCHAR", "value": "value::DECIMAL(18,3)::VARCHAR"}
    facts = " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS ordinal, '{c}' AS column_name, count(*) AS rows, count({c}) AS present, "
        + ("NULL::BIGINT AS characters, NULL::BIGINT AS longest, 'bigint' AS type" if c == "event_id" else
           f"sum(length({written.get(c, c)}))::BIGINT AS characters, max(length({written.get(c, c)}))::BIGINT AS longest, "
           f"CASE WHEN bool_and(regexp_full_match({written.get(c, c)}, '[+-]?\\d{{1,18}}')) THEN 'bigint' "
           f"WHEN bool_and(regexp_full_match({written.get(c, c)}, '[+-]?\\d+\\.?\\d*')) THEN 'double' ELSE 'string' END AS type")
        + " FROM upload"
        for i, c in enumerate(["event_id", "ts", "user_id", "event_type", "bucket", "value", "props"])
    )
    return {
        "profile_merged": query(UPLOAD, select=facts),
        "adapter_mixed_dates": query(*raw, select=NORMAL_SELECT),
        "ingest_metrics_us_dates": event_metrics,
        "src_csv_wide_ids": "SELECT event_id + 4611686018427387904 AS event_id, CAST(event_id::HUGEINT + 10000000000000000000 AS VARCHAR) AS trace_id FROM events",
        "src_json_lines": customer,
        "src_sqlite_narrative_all": query(
            v.RAW_COMPLAINTS,
            exported.replace("FROM raw_complaints WHERE", "FROM raw_complaints WHERE length(consumer_complaint_narrative) > 10 AND"),
            select=NORMAL_SELECT,
        ),
        "adapter_normalize": query(*raw, select=NORMAL_SELECT),
        "adapter_csv_scan": query(*raw, select=NORMAL_SELECT),
        "adapter_csv_by_ranges": query(*raw, select=NORMAL_SELECT),
        "adapter_without_ids": query(
            *raw,
            f"keyed AS (SELECT *, 'TKT-' || {p.key_id('md5(message)', p.ts('ticket_created_at'), 'product_name')} AS entity_id FROM normalized)",
            select=f"SELECT entity_id, 'CUST-' || right(entity_id, 6) AS customer_id, product_name, {p.ts('ticket_created_at')} AS ticket_created_at, md5(message) AS message FROM keyed",
        ),
        "src_sqlite_narrative": query(
            v.RAW_COMPLAINTS,
            NORMALIZED.replace("coalesce(state, 'West')", "coalesce(state, 'None')").replace(
                "FROM raw_complaints WHERE",
                "FROM (SELECT * FROM raw_complaints WHERE length(consumer_complaint_narrative) > 10 ORDER BY complaint_id LIMIT 300) WHERE",
            ),
            select=NORMAL_SELECT,
        ),
        "complaint_daily": query(*raw, p.daily("normalized", "COMPLAINTS"), select=DAILY_SELECT + " FROM ticket_daily"),
        "dataset_slug": """SELECT DISTINCT name, CASE WHEN slug = '' THEN 'custom_dataset' ELSE slug END AS slug FROM (
  SELECT name, lower(trim(regexp_replace(trim(regexp_replace(name, '\\.[^.]+$', '')), '[^a-zA-Z0-9_]+', '_', 'g'), '_')) AS slug
  FROM (SELECT url AS name FROM pages UNION ALL SELECT p_name || ' #' || p_brand || '.tar.csv' FROM part))""",
        "schema_profile": profile,
        "schema_roles": _roles(),
        "ingest_metrics": event_metrics,
        "ingest_metrics_errors": query(
            UPLOAD,
            select=f"""SELECT 'error_stream' AS dataset_source, {iso('day')} AS metric_date, 'Default' AS region, 'Standard' AS product_name, {generic},
  {rnd('avg(value) * count(*)', 6)} AS daily_spend_amount, count(*) AS transaction_count, {rnd('avg(value)', 6)} AS avg_ticket_size,
  {rnd('greatest(10.0::DOUBLE, 100.0::DOUBLE - avg(value))', 6)} AS success_rate_pct, {tail} FROM upload GROUP BY day""",
        ),
        "ingest_tickets": query(
            UPLOAD,
            select=f"""SELECT 'event_stream' AS dataset_source, '2024-02-01 00:00:00' AS ticket_created_at, 'Default' AS region, 'Standard' AS product_name,
  'Standard' AS customer_tier, printf('CUST-%04d', row_number() OVER (ORDER BY event_id)) AS customer_id,
  'Uploaded Narrative' AS issue_category, 'HIGH' AS priority, 100.0::DOUBLE AS dispute_amount, -0.5::DOUBLE AS sentiment_score,
  substr(props, 1, 80) AS subject, props AS message FROM (SELECT * FROM upload WHERE {usable})""",
        ),
        "ingest_summary": query(
            UPLOAD,
            select=f"""SELECT 'event_stream' AS dataset_name, count(*) AS total_records,
  (SELECT count(*) FROM (SELECT DISTINCT day, event_type, bucket FROM upload WHERE event_type IS NOT NULL)) AS metrics_inserted,
  count(*) FILTER ({usable}) AS tickets_embedded, {iso('min(day)')} AS start_date, {iso('max(day)')} AS end_date FROM upload""",
        ),
        "ingest_head": query(
            UPLOAD,
            select="SELECT event_id, ts, user_id, event_type, bucket, value, props FROM upload ORDER BY event_id LIMIT 100",
        ),
        "src_csv": f"SELECT event_id, {p.ts('ts')} AS ts, user_id, event_type, value, props FROM events",
        "src_csv_quoted_breaks": "SELECT doc_id, md5(nullif(text, '')) AS text, lang, source, n_chars FROM documents",
        "src_json": customer,
        "src_sqlite": customer,
        "src_preferred": f"SELECT {part} FROM part",
        "sink_replace": query(
            v.METRICS_EVENTS,
            v.TICKETS,
            p.daily("tickets", "DOCUMENTS"),
            select="""SELECT 'replaced' AS store, dataset_source, count(*) AS stored_rows FROM (
  SELECT dataset_source FROM metrics_events WHERE region = 'R0' UNION ALL SELECT dataset_source FROM ticket_daily) GROUP BY dataset_source""",
        ),
        "src_parquet": f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, {p.ts('o_orderdate')} AS o_orderdate, o_orderpriority FROM orders",
        "src_fallback": f"SELECT {part} FROM part UNION ALL SELECT {part} FROM part",
        "sink_metrics": query(
            v.TICKETS,
            v.METRICS_EVENTS,
            p.daily("tickets", "DOCUMENTS"),
            select="""SELECT dataset_source, count(*) AS stored_rows, CAST(sum(transaction_count) AS BIGINT) AS transactions FROM (
  SELECT dataset_source, transaction_count FROM metrics_events UNION ALL SELECT dataset_source, transaction_count FROM ticket_daily
  UNION ALL SELECT dataset_source, transaction_count FROM ticket_daily) GROUP BY dataset_source""",
        ),
        "sink_idempotent": "SELECT doc_id AS ticket_id, source AS dataset_source, lang AS region, md5(text) AS message FROM documents",
        "scan_generic": s.scan_query(
            """slim AS (SELECT CAST(ts AS DATE) AS metric_date, event_type AS region, 'All' AS product_name, 'All' AS customer_tier,
  NULL AS merchant_category, NULL::DOUBLE AS daily_spend_amount, NULL::BIGINT AS transaction_count, NULL::DOUBLE AS avg_ticket_size,
  NULL::DOUBLE AS success_rate_pct, 20.0::DOUBLE * avg(value) AS avg_latency_ms,
  100.0::DOUBLE * avg(CASE WHEN value > 30 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS chargeback_rate_pct, NULL::DOUBLE AS avg_fraud_risk_score
  FROM events GROUP BY ALL)""",
            "slim",
        ),
    }


WORDS = "regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+')"
BUCKETS = "(('0x' || substr(md5(w), 1, 8))::BIGINT % 768)"


def _ticket_queries() -> dict[str, str]:
    shown = (
        f"dataset_source, {p.ts('ticket_created_at')} AS ticket_created_at, region, product_name, customer_tier, customer_id, issue_category, "
        "priority, dispute_amount, sentiment_score, subject"
    )
    full = f"SELECT ticket_id, {shown}, md5(message) AS message"
    anchor = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"
    similar = f"scored_tickets AS (SELECT *, round(list_cosine_similarity(embedding::DOUBLE[], {anchor}::DOUBLE[]), 12) AS similarity FROM tickets WHERE embedding IS NOT NULL)"

    def top(where: str, k: int) -> str:
        return f"topped AS (SELECT * FROM scored_tickets WHERE {where} ORDER BY similarity DESC, ticket_id LIMIT {k})"

    best = top("similarity >= 0.15", 20)
    words = WORDS.format(t="text")
    counted = f"""counted AS (
  SELECT doc_id, b, count(*)::DOUBLE AS n FROM (SELECT doc_id, {BUCKETS} AS b FROM (SELECT doc_id, unnest({words}) AS w FROM documents)) GROUP BY doc_id, b)"""
    normed = "normed AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM counted GROUP BY doc_id)"
    norms = "CAST(c.n / m.norm AS FLOAT)::DOUBLE"
    passage = WORDS.format(t="(SELECT text FROM benchmark ORDER BY item_id LIMIT 1)")
    asked_words = WORDS.format(t="product_name || ' ' || region || ' ' || metric_name")
    cut = lambda n: f"sqrt(list_sum(list_transform(embedding[1:{n}], lambda x: x::DOUBLE * x::DOUBLE)))"
    return {
        "vector_normalize": f"""SELECT vec_id, 48::BIGINT AS cut_size, 80::BIGINT AS padded_size, position,
  CASE WHEN position < 48 THEN {rnd(f'CAST(embedding[position + 1]::DOUBLE / {cut(48)} AS FLOAT)::DOUBLE', 5)} END AS cut_value,
  {rnd(f'CASE WHEN position < 64 THEN CAST(embedding[position + 1]::DOUBLE / {cut(64)} AS FLOAT)::DOUBLE ELSE 0.0 END', 5)} AS padded_value
FROM embeddings, (SELECT unnest(range(0, 80)) AS position)""",
        "ticket_topk": query(v.TICKETS, similar, best, select=f"{full}, {rnd('similarity', 6)} AS similarity_score FROM topped"),
        "ticket_filtered_topk": query(
            v.TICKETS,
            similar,
            top("similarity >= 0.05 AND dataset_source = 'DOCUMENTS' AND region = 'en' AND product_name ILIKE '%SRC_%' AND customer_tier ILIKE '%ret%'", 10),
            select=f"{full}, {rnd('similarity', 6)} AS similarity_score FROM topped",
        ),
        "ticket_date_filter": query(
            v.TICKETS,
            select=full
            + " FROM tickets WHERE ticket_created_at >= TIMESTAMP '2024-01-10' AND ticket_created_at <= TIMESTAMP '2024-01-12' AND issue_category ILIKE '%/DE%'",
        ),
        "ticket_defaults": query(
            v.TICKETS,
            select="""SELECT ticket_id, 'DOCUMENTS' AS dataset_source, '2024-02-01 00:00:00' AS ticket_created_at,
  CASE WHEN ticket_id % 3 <> 0 THEN region ELSE 'West' END AS region, 'General' AS product_name, 'Retail' AS customer_tier, 'CUST-UNKNOWN' AS customer_id,
  'General' AS issue_category, 'NORMAL' AS priority, CASE WHEN ticket_id % 4 <> 0 THEN dispute_amount ELSE 0.0::DOUBLE END AS dispute_amount,
  0.0::DOUBLE AS sentiment_score, '' AS subject, md5(message) AS message FROM tickets""",
        ),
        "citations": query(
            v.TICKETS,
            similar,
            best,
            select=f"SELECT ticket_id, customer_id, issue_category, subject || ': ' || message AS complaint_text, {rnd('similarity', 4)} AS similarity_score FROM topped",
        ),
        "hash_embed": query(
            counted,
            normed,
            select=f"""SELECT d.doc_id, {rnd(f'coalesce(sum({norms} * (c.b + 1)), 0.0)', 3)} AS checksum, count(c.b) AS filled
FROM documents d LEFT JOIN counted c ON d.doc_id = c.doc_id LEFT JOIN normed m ON d.doc_id = m.doc_id GROUP BY d.doc_id""",
        ),
        "postings_by_level": query(
            counted,
            normed,
            f"weights AS (SELECT doc_id, c.b, {norms} AS w32 FROM counted c JOIN normed m USING (doc_id))",
            "lengths AS (SELECT doc_id, sqrt(sum(w32 * w32)) AS len32 FROM weights GROUP BY doc_id)",
            select=f"""SELECT b AS bucket, level, {rnd('max(w)', 6)} AS top, count(*) AS postings, CAST(sum(doc_id) AS BIGINT) AS ids
FROM (SELECT doc_id, b, w32 / len32 AS w, CAST(ceil(w32 / len32 * 32) AS BIGINT) AS level FROM weights JOIN lengths USING (doc_id)) GROUP BY b, level""",
        ),
        "ticket_search_text": query(
            counted,
            normed,
            f"asked AS (SELECT b, count(*)::DOUBLE AS n FROM (SELECT {BUCKETS} AS b FROM (SELECT unnest({passage}) AS w)) GROUP BY b)",
            f"""sims AS (
  SELECT doc_id, round(sum({norms} * a.n) / sqrt((SELECT sum(n * n) FROM asked)) / any_value(len32), 12) AS similarity
  FROM counted c JOIN normed m USING (doc_id) JOIN asked a USING (b)
  JOIN (SELECT doc_id, sqrt(sum({norms} * {norms})) AS len32 FROM counted c JOIN normed m USING (doc_id) GROUP BY doc_id) l USING (doc_id) GROUP BY doc_id)""",
            select=f"""SELECT doc_id AS ticket_id, lang AS region, {rnd('similarity', 6)} AS similarity_score FROM (
  SELECT * FROM sims WHERE similarity >= 0.10 ORDER BY similarity DESC, doc_id LIMIT 10) JOIN documents USING (doc_id)""",
        ),
        "citations_with_fallback": query(
            *p.ticket_events(), *p.CITED, select="SELECT query_id, rank, is_fallback, ticket_id, customer_id, issue_category, complaint_text, similarity_score FROM cited"
        ),
        "ingest_to_citations": query(
            v.RAW_COMPLAINTS,
            NORMALIZED,
            *s.scan(p.daily("normalized", "COMPLAINTS"), "ticket_daily"),
            p.events("COMPLAINTS"),
            p.ANCHORED[1],
            counted,
            normed,
            f"q_counted AS (SELECT query_id, b, count(*)::DOUBLE AS n FROM (SELECT query_id, {BUCKETS} AS b FROM (SELECT query_id, unnest({asked_words}) AS w FROM asked)) GROUP BY ALL)",
            "q_normed AS (SELECT query_id, sqrt(sum(n * n)) AS norm FROM q_counted GROUP BY query_id)",
            """sims AS (
  SELECT query_id, doc_id, sum(q.n * c.n) / any_value(qm.norm) / any_value(m.norm) AS similarity
  FROM q_counted q JOIN counted c USING (b) JOIN q_normed qm USING (query_id) JOIN normed m USING (doc_id) GROUP BY query_id, doc_id)""",
            """pairs AS (
  SELECT a.query_id, CAST(complaint_id AS BIGINT) AS ticket_id, a.region AS q_region, a.product_name AS q_product, a.customer_tier AS q_tier, t.region, t.product_name,
    t.customer_tier, round(similarity, 12) AS similarity FROM sims JOIN asked a USING (query_id) JOIN normalized t ON t.complaint_id = CAST(doc_id AS VARCHAR))""",
            p.chosen(0.02, 0.01).split(",\ncited AS")[0],
            select=f"""SELECT dataset_source, region, product_name, customer_tier, metric_name, is_fallback, found, best, least FROM asked LEFT JOIN (
  SELECT query_id, pass = 1 AS is_fallback, count(*) AS found, {rnd('max(similarity)', 4)} AS best, {rnd('min(similarity)', 4)} AS least
  FROM chosen GROUP BY query_id, pass) USING (query_id)""",
        ),
        "citations_by_text": query(
            *p.ticket_events(),
            p.ANCHORED[1],
            counted,
            normed,
            f"q_counted AS (SELECT query_id, b, count(*)::DOUBLE AS n FROM (SELECT query_id, {BUCKETS} AS b FROM (SELECT query_id, unnest({asked_words}) AS w FROM asked)) GROUP BY ALL)",
            "q_normed AS (SELECT query_id, sqrt(sum(n * n)) AS norm FROM q_counted GROUP BY query_id)",
            """sims AS (
  SELECT query_id, doc_id, sum(q.n * c.n) / any_value(qm.norm) / any_value(m.norm) AS similarity
  FROM q_counted q JOIN counted c USING (b) JOIN q_normed qm USING (query_id) JOIN normed m USING (doc_id) GROUP BY query_id, doc_id)""",
            """pairs AS (
  SELECT a.query_id, t.ticket_id, a.region AS q_region, a.product_name AS q_product, a.customer_tier AS q_tier, t.region, t.product_name, t.customer_tier,
    round(similarity, 12) AS similarity FROM sims JOIN asked a USING (query_id) JOIN tickets t ON t.ticket_id = doc_id)""",
            p.chosen(0.02, 0.01),
            select=f"SELECT query_id, rank, pass = 1 AS is_fallback, ticket_id, {rnd('similarity', 4)} AS similarity_score FROM chosen",
        ),
    }


RUNS = """runs AS (
  SELECT f.id AS anomaly_id, 'week_before' AS template, count(m.metric_date) AS row_count, FALSE AS failed FROM found f LEFT JOIN ticket_daily m
    ON m.region = f.region AND m.product_name = f.product_name AND m.customer_tier = f.customer_tier
    AND m.metric_date <= CAST(f.detected_at AS DATE) AND m.metric_date > CAST(f.detected_at AS DATE) - 7 GROUP BY f.id
  UNION ALL SELECT f.id, 'disputes_of_the_day', count(t.ticket_id), FALSE FROM found f LEFT JOIN tickets t
    ON t.region = f.region AND t.product_name = f.product_name AND CAST(t.ticket_created_at AS DATE) = CAST(f.detected_at AS DATE) AND t.priority = 'CRITICAL'
    GROUP BY f.id
  UNION ALL SELECT id, 'broken', 0, TRUE FROM found)"""
RUN_SCORES = f"""SELECT '{{name}}' AS templates, anomaly_id, count(*) AS sql_queries, bool_and(NOT failed) AS sql_pass, CAST(sum(row_count) AS BIGINT) AS rows_found,
  {rnd('0.5::DOUBLE + 0.44::DOUBLE * count(*) FILTER (row_count > 0) / count(*)', 4)} AS confidence FROM runs WHERE {{where}} GROUP BY anomaly_id"""


def _report_queries() -> dict[str, str]:
    reported = [*p.ticket_events(), *p.CITED, *p.evidence(cited=True)]
    nl = "chr(10)"
    keywords = "[lower(region), lower(product_name), 'the', 'der', 'que', 'zzz']"
    said = "lower(array_to_string(list_transform(cites, lambda c: c.complaint_text), ' '))"
    precision = (
        f"CASE WHEN len(cites) > 0 THEN {rnd(f'len(list_filter({keywords}, lambda k: contains({said}, k))) / 6.0', 2)} ELSE 0.5::DOUBLE END"
    )
    card = f"""card AS (
  SELECT anomaly_id, CASE WHEN missing THEN 0 ELSE 1 END AS sql_queries, NOT missing AS sql_pass, CASE WHEN missing THEN 0 ELSE len(cites) END AS citations,
    CASE WHEN missing THEN 0.0::DOUBLE ELSE {precision} END AS retrieval_precision, CASE WHEN missing THEN 0.0::DOUBLE ELSE confidence_score END AS confidence,
    NOT missing AS synthesis_pass, CASE WHEN missing THEN 'FAIL' ELSE 'PASS' END AS overall_status
  FROM (SELECT *, anomaly_id % 7 = 0 AS missing FROM reported))"""
    fixed = lambda c: f"printf('%.2f', {rnd(c, 2)})"
    document = f"""'# Incident ' || anomaly_id || ': ' || metric_name || {nl} || {nl} ||
  '| Region | Product | Tier | Actual | Expected | Deviation | Severity | Confidence |' || {nl} || '|---|---|---|---|---|---|---|---|' || {nl} ||
  '| ' || region || ' | ' || product_name || ' | ' || customer_tier || ' | ' || {fixed('actual_value')} || ' | ' || {fixed('expected_value')} || ' | ' ||
  {fixed('deviation_pct')} || '% | ' || severity || ' | 0.94 |' || {nl} || {nl} || root_cause_summary ||
  {nl} || {nl} || '## Next steps' || {nl} || {nl} || mitigation_steps || {nl} || {nl} || '## Metric rows' || {nl} || {nl} ||
  'Inspect historical daily metrics and telemetry trend. ' || n_rows || ' rows.' || {nl} || {nl} || '    ' || evidence_query || {nl} || {nl} ||
  '## Tickets' || {nl} || {nl} ||
  array_to_string(list_transform(cites, lambda c: c.ticket_id || '. (' || printf('%.2f', {rnd('c.similarity_score', 2)}) || ') ' || c.complaint_text || {nl}), '')"""
    feed = """SELECT anomaly_id, row_number() OVER (PARTITION BY anomaly_id ORDER BY major, minor) - 1 AS seq, event, detail FROM (
  SELECT anomaly_id, 0 AS major, 0 AS minor, 'anomaly_info' AS event, metric_name AS detail FROM reported
  UNION ALL SELECT anomaly_id, 1, 0, 'sql_evidence', CAST(n_rows AS VARCHAR) FROM reported
  UNION ALL SELECT anomaly_id, 2, i, 'ticket_evidence', CAST(cites[i].ticket_id AS VARCHAR) FROM (SELECT *, unnest(range(1, len(cites) + 1)) AS i FROM reported)
  UNION ALL SELECT anomaly_id, 3, 0, 'rca_report', '0.94' FROM reported
  UNION ALL SELECT anomaly_id, 4, 0, 'complete', 'DONE' FROM reported)"""
    metric = f"{iso('metric_date')} AS metric_date, customer_tier, {rnd('daily_spend_amount', 6)} AS daily_spend_amount, transaction_count, " + ", ".join(
        f"{rnd(c, 6)} AS {c}" for c in ("success_rate_pct", "avg_latency_ms", "chargeback_rate_pct")
    )
    degraded = "gateway_status <> 'OPERATIONAL' OR timeout_504_count > 0 OR failed_requests > 0"
    gateway = (
        f"{iso('log_date')} AS log_date, region, partner_bank, product_name, 'DIRECT_API' AS gateway_channel, total_requests, successful_requests, failed_requests, "
        f"timeout_504_count, 0::BIGINT AS server_error_500_count, {rnd('avg_response_time_ms', 6)} AS avg_response_time_ms, gateway_status"
    )
    return {
        "evidence_queries": query(
            *p.ticket_events(), RUNS, select="SELECT anomaly_id, template, row_count, least(row_count, 10) AS shown, failed FROM runs"
        ),
        "evidence_scores": query(
            *p.ticket_events(),
            RUNS,
            select=RUN_SCORES.format(name="all", where="TRUE") + " UNION ALL " + RUN_SCORES.format(name="sound", where="template <> 'broken'"),
        ),
        "evidence_metrics": query(
            v.METRICS_EVENTS,
            *p.ticket_events(),
            """both_metrics AS (SELECT * FROM metrics_events UNION ALL BY NAME SELECT * FROM ticket_daily)""",
            """newest AS (
  SELECT *, row_number() OVER (PARTITION BY region, product_name ORDER BY metric_date DESC, customer_tier, merchant_category, dataset_source, daily_spend_amount) AS rank
  FROM both_metrics QUALIFY rank <= 10)""",
            select=f"SELECT f.id AS anomaly_id, region, product_name, rank, {metric.replace('customer_tier', 'n.customer_tier')} FROM found f JOIN newest n USING (region, product_name)",
        ),
        "gateway_degraded": query(
            v.GATEWAY_LOGS, select=f"SELECT {gateway} FROM gateway_logs WHERE region = 'ASIA' AND product_name = 'BUILDING' AND ({degraded})"
        ),
        "evidence_gateway": query(
            *s.scan(v.METRICS_ORDERS, "metrics_orders"),
            p.events("ORDERS"),
            v.GATEWAY_LOGS,
            f"""bad_days AS (SELECT * FROM gateway_logs WHERE {degraded})""",
            select=f"""SELECT anomalies, first_anomaly_id, {gateway}
FROM (SELECT region, product_name, count(*) AS anomalies, min(id) AS first_anomaly_id FROM found GROUP BY ALL) f
JOIN bad_days USING (region, product_name)""",
        ),
        "evidence_gateway_latest": query(
            *s.scan(v.METRICS_ORDERS, "metrics_orders"),
            p.events("ORDERS"),
            v.GATEWAY_LOGS,
            f"""latest_days AS (
  SELECT *, row_number() OVER (PARTITION BY region, product_name ORDER BY log_date DESC, failed_requests DESC, partner_bank) AS rank
  FROM gateway_logs WHERE {degraded} QUALIFY rank <= 5)""",
            select=f"""SELECT f.id AS anomaly_id, rank, region, product_name, {iso('log_date')} AS log_date, partner_bank, failed_requests
FROM found f JOIN latest_days USING (region, product_name)""",
        ),
        "evidence_arrays": "SELECT conv_id, turn, role || '#1,' || role || '#2' AS findings FROM conversations",
        "evidence_gaps": query(
            *reported,
            select="""SELECT anomaly_id, CAST(n_rows AS BIGINT) AS metric_rows, len(cites) AS citations,
  CASE WHEN n_rows = 0 AND len(cites) = 0 THEN 'both' WHEN n_rows = 0 THEN 'metrics' WHEN len(cites) = 0 THEN 'tickets' ELSE 'none' END AS lacking FROM reported""",
        ),
        "report_summary": query(
            *reported,
            select="SELECT anomaly_id, root_cause_summary, confidence_score, mitigation_steps, sql_queries::BIGINT AS sql_queries, citations FROM reported",
        ),
        "report_markdown": query(*reported, select=f"SELECT anomaly_id, {document} AS document FROM reported"),
        "sink_documents": query(*reported, select=f"SELECT anomaly_id, {document} AS document FROM reported"),
        "investigation_events": query(*reported, select=feed),
        "text_block": """SELECT doc_id, md5(coalesce(nullif(array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10)), ''), 'empty')) AS lines,
  'lang: ' || lang || '; source: ' || source || chr(10) || 'n: ' || n_chars AS facts,
  CASE WHEN doc_id % 5 <> 0 THEN source ELSE 'none given' END AS fallback FROM documents""",
        "json_extract": """SELECT event_id, CASE WHEN event_id % 5 <> 3 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 5 <> 3 AS is_json FROM events""",
        "retrieval_precision": query(*reported, select=f"SELECT anomaly_id, {precision} AS precision FROM reported"),
        "scorecard": query(*reported, card, select="SELECT * REPLACE (sql_queries::BIGINT AS sql_queries) FROM card"),
        "scorecard_summary": query(
            *reported,
            card,
            select=f"""SELECT count(*) AS scenarios, count(*) FILTER (overall_status IN ('PASS', 'WARN')) AS passed,
  {rnd("100.0::DOUBLE * count(*) FILTER (overall_status IN ('PASS', 'WARN')) / count(*)", 1)} AS pass_rate, {rnd('avg(confidence)', 2)} AS avg_confidence,
  {rnd('avg(retrieval_precision)', 4)} AS avg_precision FROM card""",
        ),
    }


def oracle_sql() -> dict[str, str]:
    return {
        **_scan_queries(),
        **_event_queries(),
        **_telemetry_queries(),
        **_ingest_queries(),
        **_ticket_queries(),
        **_report_queries(),
    }
