"""The registered queries: every operator over views of the driver tables.

Dates and timestamps are rendered as ISO text and doubles rounded, so results
compare exactly across engines.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseward.functions import embedding, guard, text, vectors
from pulseward.functions.numeric import key_id, round_stable
from pulseward.operators import (
    complaints,
    events,
    evidence,
    evidence_runs,
    inference,
    ingestion,
    lexical,
    nearest,
    profiles,
    reports,
    sandbox,
    scorecard,
    series,
    telemetry,
    tickets,
)
from pulseward.operators.signals import DetectorSettings, scan_metrics, score_series
from pulseward.plans import detect, documents, ingest, investigate, store, uploads, views
from pulseward.schemas import ANOMALY_EVENTS, CITATION, DAILY_METRICS, TICKETS
from pulseward.session import scratch_path, staged
from pulseward.sources import files
from pulseward.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}

NO_FOREST = DetectorSettings(use_forest=False)
EVENT_COLUMNS = [part.strip().split(" ")[0] for part in ANOMALY_EVENTS.split(",")]


def register(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable rendering of a result."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = round_stable(column.cast("double"), digits)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            column = column.cast("bigint")
        out.append(column.alias(field.name))
    return df.select(*out)


# Scan -----------------------------------------------------------------------


@register
def slice_dedupe(spark, sf_dir):
    return present(series.dedupe_slices(views.metrics_orders_fine(spark, sf_dir).drop("avg_ticket_size")))


@register
def calendar_fill(spark, sf_dir):
    deduped = series.dedupe_slices(views.metrics_orders(spark, sf_dir).drop("avg_ticket_size"))
    return present(series.calendar_fill(deduped))


@register
def rolling_baseline(spark, sf_dir):
    deduped = series.dedupe_slices(views.metrics_orders(spark, sf_dir).drop("avg_ticket_size"))
    based = series.rolling_baseline(series.calendar_fill(deduped))
    stats = [c for c in based.columns if c.startswith(("mean_", "sd_"))]
    return present(based.select(*series.SLICE_COLUMNS, "metric_date", *stats))


@register
def rolling_zscore(spark, sf_dir):
    scored = score_series(views.metrics_orders(spark, sf_dir), NO_FOREST)
    stats = [c for c in scored.columns if c.startswith(("z_", "expected_"))]
    return present(scored.select(*series.SLICE_COLUMNS, "metric_date", *stats))


@register
def anomaly_signals(spark, sf_dir):
    return present(scan_metrics(views.metrics_events(spark, sf_dir), NO_FOREST))


@register
def anomaly_signals_sparse(spark, sf_dir):
    return present(scan_metrics(views.metrics_orders(spark, sf_dir), NO_FOREST))


@register
def iforest_scores(spark, sf_dir):
    scored = score_series(views.metrics_events(spark, sf_dir))
    return present(scored.select(*series.SLICE_COLUMNS, "metric_date", "iso_score", "is_isolated"))


@register
def iforest_scores_sparse(spark, sf_dir):
    """Slices of more days than a tree samples."""
    scored = score_series(views.metrics_orders_priority(spark, sf_dir))
    return present(scored.select(*series.SLICE_COLUMNS, "metric_date", "iso_score", "is_isolated"))


@register
def anomaly_signals_fine(spark, sf_dir):
    """Several rows per slice and day: the scan keeps the row that ``slice_dedupe`` keeps."""
    return present(scan_metrics(views.metrics_orders_fine(spark, sf_dir), NO_FOREST))


@register
def anomaly_signals_full(spark, sf_dir):
    return present(scan_metrics(views.metrics_events(spark, sf_dir)))


@register
def scan_partition(spark, sf_dir):
    both = views.metrics_events(spark, sf_dir).unionByName(views.metrics_orders(spark, sf_dir))
    return present(store.scan_partition(both, "EVENTS_30D"))


@register
def scan_generic(spark, sf_dir):
    """A table with a date and two measures only, next to one slice column."""
    slim = (
        views.table(spark, sf_dir, "events")
        .groupBy(F.to_date("ts").alias("metric_date"), F.col("event_type").alias("region"))
        .agg(
            (F.lit(20.0) * F.avg("value")).alias("avg_latency_ms"),
            (F.lit(100.0) * views.share(F.col("value") > 30)).alias("chargeback_rate_pct"),
        )
    )
    return present(scan_metrics(slim, NO_FOREST))


# Stored events --------------------------------------------------------------


def event_events(spark, sf_dir) -> DataFrame:
    return events.signals_to_events(scan_metrics(views.metrics_events(spark, sf_dir), NO_FOREST), "EVENTS_30D")


def early_events(spark, sf_dir) -> DataFrame:
    """Events a scan over the first half of the month had stored."""
    early = views.metrics_events(spark, sf_dir).where(F.col("metric_date") < F.lit("2024-01-16").cast("date"))
    return events.signals_to_events(scan_metrics(early, NO_FOREST), "EVENTS_30D")


def ticket_daily(spark, sf_dir) -> DataFrame:
    return complaints.complaint_daily(views.tickets(spark, sf_dir, False, False), "DOCUMENTS")


def ticket_events(spark, sf_dir) -> DataFrame:
    return events.signals_to_events(scan_metrics(ticket_daily(spark, sf_dir), NO_FOREST), "DOCUMENTS")


def some(events_df: DataFrame) -> DataFrame:
    """The events investigated so far in the queries about reports."""
    return events_df.where(F.col("id") % 3 == 0)


def plain_reports(spark, sf_dir) -> DataFrame:
    """Reports of some events, without citations."""
    investigated = some(ticket_events(spark, sf_dir))
    bare = investigated.withColumn("ticket_citations", F.array().cast(f"array<{CITATION}>"))
    return reports.build_reports(evidence.sql_evidence(bare, ticket_daily(spark, sf_dir)))


def statused_events(spark, sf_dir) -> DataFrame:
    found = ticket_events(spark, sf_dir)
    return events.current_status(found, events.transitions_for(some(found)))


@register
def events_insert_if_absent(spark, sf_dir):
    after = events.insert_if_absent(event_events(spark, sf_dir), early_events(spark, sf_dir))
    return present(after.orderBy("id"))


@register
def anomaly_feed(spark, sf_dir):
    wanted = events.filter_events(statused_events(spark, sf_dir), "DOCUMENTS", status="OPEN", severity="CRITICAL")
    return present(events.anomaly_feed(wanted, limit=50, offset=5))


@register
def anomaly_feed_total(spark, sf_dir):
    wanted = events.filter_events(statused_events(spark, sf_dir), "DOCUMENTS", status="OPEN", region="en")
    return wanted.agg(F.count("*").alias("total"))


@register
def anomaly_by_id(spark, sf_dir):
    found = ticket_events(spark, sf_dir)
    return present(found.where(F.col("id") == key_id(*[F.lit(v) for v in ("DOCUMENTS", "2024-01-06 00:00:00", "en", "src5", "Retail", "chargeback_dispute_spike")])))


@register
def anomaly_with_report(spark, sf_dir):
    joined = events.with_report(ticket_events(spark, sf_dir), plain_reports(spark, sf_dir))
    return present(joined.select("id", "metric_name", "severity", "root_cause_summary", "confidence_score", "mitigation_steps"))


@register
def anomalies_pending(spark, sf_dir):
    return present(events.pending(ticket_events(spark, sf_dir), plain_reports(spark, sf_dir)))


@register
def anomaly_current_status(spark, sf_dir):
    return statused_events(spark, sf_dir).select("id", "metric_name", "status")


@register
def next_open_anomaly(spark, sf_dir):
    return present(events.next_open(statused_events(spark, sf_dir)))


@register
def feed_sorted(spark, sf_dir):
    """The whole feed in each order, as all of its rows; the joined feed is written once."""
    joined = staged(events.with_report(ticket_events(spark, sf_dir), plain_reports(spark, sf_dir)), "feed")
    ranked = [
        events.sorted_feed(joined, mode).select(F.lit(mode).alias("mode"), "id", "severity")
        for mode in ("confidence", "severity", "date")
    ]
    return ranked[0].unionByName(ranked[1]).unionByName(ranked[2])


@register
def feed_search(spark, sf_dir):
    joined = events.with_report(ticket_events(spark, sf_dir), plain_reports(spark, sf_dir))
    return present(events.search_feed(joined, "SRC1", "CRITICAL").select("id", "region", "product_name", "metric_name"))


@register
def severity_summary(spark, sf_dir):
    return events.severity_summary(ticket_events(spark, sf_dir))


@register
def reports_cascade(spark, sf_dir):
    surviving = ticket_events(spark, sf_dir).where(F.col("severity") == "CRITICAL")
    kept = events.cascade_reports(plain_reports(spark, sf_dir), surviving)
    return kept.select("anomaly_id", "confidence_score")


@register
def reports_idempotent(spark, sf_dir):
    """A second run offers a report for every event; the stored ones stay."""
    stored = plain_reports(spark, sf_dir).withColumn("confidence_score", F.lit(0.5))
    found = ticket_events(spark, sf_dir).withColumn("ticket_citations", F.array().cast(f"array<{CITATION}>"))
    offered = reports.build_reports(evidence.sql_evidence(found, ticket_daily(spark, sf_dir)))
    return events.insert_reports(offered, stored).select("anomaly_id", "confidence_score")


# Telemetry ------------------------------------------------------------------


@register
def overview(spark, sf_dir):
    return telemetry.overview(
        views.metrics_events(spark, sf_dir), views.tickets(spark, sf_dir, False), event_events(spark, sf_dir), "EVENTS_30D"
    )


@register
def overview_fallback(spark, sf_dir):
    return telemetry.overview(
        views.metrics_events(spark, sf_dir), views.tickets(spark, sf_dir, False), ticket_events(spark, sf_dir), "DOCUMENTS"
    )


@register
def timeseries(spark, sf_dir):
    return telemetry.timeseries(views.metrics_orders(spark, sf_dir), "ORDERS")


@register
def list_datasets(spark, sf_dir):
    both = views.metrics_events(spark, sf_dir).unionByName(views.metrics_orders(spark, sf_dir))
    return telemetry.list_datasets(both, views.tickets(spark, sf_dir, False))


@register
def list_stored_datasets(spark, sf_dir):
    """Two datasets as their folders name them, after metrics and tickets were stored."""
    metrics, stored = scratch_path(spark, "metrics"), scratch_path(spark, "tickets")
    store.append_metrics(views.metrics_events(spark, sf_dir), metrics)
    store.append_tickets(views.tickets(spark, sf_dir, False), stored)
    return store.stored_datasets(spark, metrics, stored)


@register
def kpi_delta(spark, sf_dir):
    return telemetry.kpi_delta(overview(spark, sf_dir), "payments")


@register
def schema_summary(spark, sf_dir):
    names = ["documents", "events", "lineitem", "orders"]
    for name in names:
        views.table(spark, sf_dir, name).createOrReplaceTempView(name)
    return sandbox.schema_summary(spark, names)


@register
def guarded_sql(spark, sf_dir):
    tables = {"daily_spend_metrics": views.metrics_orders(spark, sf_dir)}
    sql = (
        "SELECT region, product_name, max(metric_date) AS last_day, count(*) AS days, "
        "round(sum(daily_spend_amount), 2) AS spend "
        "FROM daily_spend_metrics GROUP BY region, product_name ORDER BY region, product_name;"
    )
    return present(sandbox.guarded_sql(spark, tables, sql))


@register
def sql_guard_audit(spark, sf_dir):
    """Texts that are no queries, and queries written from the part table."""
    spoken = views.table(spark, sf_dir, "conversations").select("text")
    part = views.table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    forms = [
        F.concat(F.lit("SELECT * FROM part WHERE p_partkey = "), key, F.lit(";")),
        F.concat(F.lit("select p_name from part where p_name = '"), F.col("p_name"), F.lit("' LIMIT 5")),
        F.concat(F.lit("DROP TABLE part"), key, F.lit(";")),
        F.concat(F.lit("SELECT 1; DELETE FROM part WHERE p_partkey = "), key),
        F.concat(F.lit("  WITH t AS (SELECT "), key, F.lit(" AS k) SELECT k FROM t")),
        F.concat(F.lit("UPDATE part SET p_size = "), key),
        F.concat(F.lit("SELECT updated_at, created_by FROM part"), key),
        F.concat(F.lit("EXPLAIN SELECT "), key),
        F.concat(F.lit("SELECT reflect('java.lang.System', 'exit', "), key, F.lit(")")),
    ]
    written = part.select(F.element_at(F.array(*forms), (F.col("p_partkey") % len(forms) + 1).cast("int")).alias("text"))
    return spoken.unionByName(written).groupBy(guard.query_verdict(F.col("text")).alias("verdict")).agg(
        F.count("*").alias("texts"), F.sum(F.length(guard.cleaned_query(F.col("text")))).alias("characters")
    )


# Complaints, inference, ingestion -------------------------------------------


def raw(spark, sf_dir) -> DataFrame:
    return views.raw_complaints(spark, sf_dir)


def shown_tickets(df: DataFrame) -> DataFrame:
    """Tickets with the whole message condensed to a checksum and the id in its display form only."""
    return present(df.drop("entity_id").withColumn("message", F.md5("message")))


@register
def adapter_normalize(spark, sf_dir):
    return shown_tickets(complaints.normalize_complaints(raw(spark, sf_dir), complaints.CONSUMER_COMPLAINTS))


@register
def adapter_mixed_dates(spark, sf_dir):
    """The export with its dates written in four forms."""
    day = F.to_date("date_received", "MM/dd/yyyy")
    forms = [F.date_format(day, p) for p in ("M/d/yyyy", "d-MMM-yyyy", "MMM d, yyyy", "yyyy-MM-dd")]
    which = (F.col("complaint_id").cast("bigint") % len(forms) + 1).cast("int")
    mixed = raw(spark, sf_dir).withColumn("date_received", F.element_at(F.array(*forms), which))
    return shown_tickets(complaints.normalize_complaints(mixed, complaints.CONSUMER_COMPLAINTS))


@register
def adapter_without_ids(spark, sf_dir):
    """An export without an id column: ids made from message, time and product."""
    normal = complaints.normalize_complaints(raw(spark, sf_dir).drop("complaint_id"), complaints.CONSUMER_COMPLAINTS)
    return present(normal.select("entity_id", "customer_id", "product_name", "ticket_created_at", F.md5("message").alias("message")))


@register
def adapter_csv_by_ranges(spark, sf_dir):
    """The export as large files of quoted fields, its whole narratives with line breaks, each read by many tasks."""
    path = uploads.to_quoted_csv(raw(spark, sf_dir))
    return shown_tickets(files.read_complaints(spark, path, complaints.CONSUMER_COMPLAINTS, by_ranges=True))


@register
def ingest_to_citations(spark, sf_dir):
    """From an exported file to stored tickets, daily KPIs, events, and the tickets found for every segment with an event."""
    paths = {k: scratch_path(spark, k) for k in ("metrics", "tickets", "events")}
    path = uploads.to_quoted_csv(raw(spark, sf_dir))
    ingest.ingest_complaints(spark, path, complaints.CONSUMER_COMPLAINTS, paths["metrics"], paths["tickets"], "COMPLAINTS", by_ranges=True)
    found = detect.scan_and_persist(spark, paths["metrics"], paths["events"], "COMPLAINTS", NO_FOREST)
    asked = staged(tickets.anomaly_queries(found), "asked")
    stored = store.read_stored(spark, paths["tickets"], TICKETS)
    matched = nearest.nearest_tickets(asked, stored, 5, 0.02, 0.01).groupBy("query_id", "is_fallback").agg(
        F.count("*").alias("found"), F.max("similarity_score").alias("best"), F.min("similarity_score").alias("least")
    )
    return present(asked.select("query_id", *investigate.SEGMENT_KEYS).join(matched, "query_id", "left").drop("query_id"), 4)


@register
def adapter_csv_scan(spark, sf_dir):
    path = uploads.to_csv(raw(spark, sf_dir).withColumn("unmapped", F.lit("x")))
    return shown_tickets(files.read_complaints(spark, path, complaints.CONSUMER_COMPLAINTS))


@register
def complaint_daily(spark, sf_dir):
    normal = complaints.normalize_complaints(raw(spark, sf_dir), complaints.CONSUMER_COMPLAINTS)
    return present(complaints.complaint_daily(normal, "COMPLAINTS"))


@register
def dataset_slug(spark, sf_dir):
    names = views.table(spark, sf_dir, "pages").select(F.col("url").alias("name")).unionByName(
        views.table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" #"), "p_brand", F.lit(".tar.csv")).alias("name"))
    )
    return names.select("name", text.dataset_slug(F.col("name")).alias("slug")).distinct()


@register
def schema_profile(spark, sf_dir):
    return present(inference.schema_profile(views.table(spark, sf_dir, "documents")).drop("data_type"))


@register
def schema_roles(spark, sf_dir):
    tables = ["documents", "events", "lineitem", "orders"]
    roles = [
        inference.schema_roles(views.table(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), "*") for t in tables
    ]
    out = roles[0]
    for more in roles[1:]:
        out = out.unionByName(more)
    return present(out)


@register
def profile_merged(spark, sf_dir):
    """The upload profiled in four parts, and the parts merged: types, lengths and forms of all its columns."""
    text = upload(spark, sf_dir).withColumns({"user_id": F.col("user_id").cast("string"), "value": F.col("value").cast("decimal(18,3)").cast("string")})
    parts = [profiles.column_profiles(text.where(F.col("event_id") % 4 == i), True, ["ts"], True) for i in range(4)]
    merged = profiles.merge_profiles(reduce(DataFrame.unionByName, parts))
    kind = profiles.narrowest_type(F.col("kinds"), F.col("data_type"))
    return present(merged.select("ordinal", "column_name", "rows", "present", "characters", "longest", kind.alias("type")))


EVENT_MAPPING = inference.TableRoles(
    source="event_stream",
    time="ts",
    measure="value",
    measures=["event_id", "user_id", "value"],
    labels=["event_type", "bucket"],
    narrative="props",
)
RUN_DATE = date(2024, 2, 1)


def upload(spark, sf_dir) -> DataFrame:
    """The event stream as a text upload: some times do not parse, some labels and texts are missing."""
    n = F.col("event_id")
    return views.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(n % 50 == 7, "not a time").when(n % 50 == 8, None).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ts"),
        "user_id",
        F.when(n % 11 != 0, F.col("event_type")).alias("event_type"),
        F.concat(F.lit("b"), (F.col("user_id") % 4).cast("string")).alias("bucket"),
        F.when(n % 13 != 0, F.col("value")).alias("value"),
        F.when(n % 7 == 0, "None").when(n % 7 == 1, "  ").otherwise(F.col("props")).alias("props"),
    )


@register
def ingest_metrics(spark, sf_dir):
    return present(ingestion.ingest_metrics(upload(spark, sf_dir), EVENT_MAPPING, RUN_DATE))


@register
def ingest_metrics_us_dates(spark, sf_dir):
    """The upload with its times written month first, with and without a time of day."""
    time = F.try_to_timestamp("ts")
    forms = [F.date_format(time, p) for p in ("MM/dd/yyyy", "M/d/yyyy H:mm:ss", "M/d/yyyy hh:mm a")]
    written = F.element_at(F.array(*forms), (F.col("event_id") % len(forms) + 1).cast("int"))
    rewritten = upload(spark, sf_dir).withColumn("ts", F.coalesce(written, "ts"))
    return present(ingestion.ingest_metrics(rewritten, EVENT_MAPPING, RUN_DATE))


@register
def ingest_metrics_errors(spark, sf_dir):
    """Primary metric named after failures and no dimensions: the success rate is derived from it."""
    renamed = upload(spark, sf_dir).withColumnRenamed("value", "error_count")
    mapping = inference.TableRoles("error_stream", "ts", "error_count", ["error_count"])
    return present(ingestion.ingest_metrics(renamed, mapping, RUN_DATE))


@register
def ingest_tickets(spark, sf_dir):
    created = datetime(2024, 2, 1)
    return present(ingestion.ingest_tickets(upload(spark, sf_dir), EVENT_MAPPING, created, "event_id"))


@register
def ingest_summary(spark, sf_dir):
    return present(ingestion.ingest_summary(upload(spark, sf_dir), EVENT_MAPPING, RUN_DATE))


@register
def ingest_head(spark, sf_dir):
    return present(ingestion.ingest_head(upload(spark, sf_dir), 100, "event_id"))


@register
def src_csv(spark, sf_dir):
    return present(files.read_table(spark, uploads.to_csv(views.table(spark, sf_dir, "events"))))


@register
def src_csv_quoted_breaks(spark, sf_dir):
    """Whole documents, line breaks and quotes included, from large CSV files that many tasks read each."""
    read = files.read_csv_ranges(spark, uploads.to_quoted_csv(views.table(spark, sf_dir, "documents")))
    return present(read.withColumn("text", F.md5("text")))


@register
def src_csv_wide_ids(spark, sf_dir):
    """Ids of 19 digits, and of 20 beyond a bigint, which stay apart."""
    wide = views.table(spark, sf_dir, "events").select(
        (F.col("event_id") + F.lit(1 << 62)).alias("event_id"),
        (F.col("event_id").cast("decimal(38,0)") + F.lit(str(10**19)).cast("decimal(38,0)")).cast("string").alias("trace_id"),
    )
    read = files.read_table(spark, uploads.to_csv(wide))
    return present(read.withColumn("trace_id", F.col("trace_id").cast("decimal(38,0)").cast("string")))


@register
def src_json_lines(spark, sf_dir):
    return present(files.read_table(spark, uploads.to_json_lines(views.table(spark, sf_dir, "customer"))))


@register
def src_json(spark, sf_dir):
    path = uploads.to_json_arrays(views.table(spark, sf_dir, "customer"), "c_custkey")
    return present(files.read_table(spark, path).drop("part"))


@register
def src_parquet(spark, sf_dir):
    return present(files.read_table(spark, f"{sf_dir}/orders.parquet"))


@register
def src_fallback(spark, sf_dir):
    as_csv = files.read_table(spark, uploads.to_csv(views.table(spark, sf_dir, "part"), "upload"))
    as_json = files.read_table(spark, uploads.to_json_arrays(views.table(spark, sf_dir, "part"), "p_partkey", "upload"))
    return present(as_csv.unionByName(as_json.drop("part")))


@register
def src_sqlite(spark, sf_dir):
    return present(files.read_table(spark, uploads.to_sqlite(views.table(spark, sf_dir, "customer"), "customer")))


@register
def src_sqlite_narrative_all(spark, sf_dir):
    path = uploads.to_sqlite(raw(spark, sf_dir), "consumer_complaints")
    return shown_tickets(files.read_complaints(spark, path, complaints.CONSUMER_COMPLAINTS))


@register
def src_sqlite_narrative(spark, sf_dir):
    path = uploads.to_sqlite(raw(spark, sf_dir), "consumer_complaints")
    return shown_tickets(files.read_complaints(spark, path, complaints.CONSUMER_COMPLAINTS, max_records=300))


@register
def sink_metrics(spark, sf_dir):
    """Two datasets appended, one of them twice, then read back per dataset."""
    path = scratch_path(spark, "metrics")
    store.append_metrics(views.metrics_events(spark, sf_dir), path)
    store.append_metrics(ticket_daily(spark, sf_dir), path)
    store.append_metrics(ticket_daily(spark, sf_dir), path)
    stored = store.read_stored(spark, path, DAILY_METRICS)
    return present(
        stored.groupBy("dataset_source").agg(
            F.count("*").alias("stored_rows"), F.sum("transaction_count").alias("transactions")
        )
    )


@register
def sink_idempotent(spark, sf_dir):
    """All documents as tickets in two uploads with a manifest, one twice, and an attempt that broke off before the manifest had it."""
    path, manifest = scratch_path(spark, "tickets"), scratch_path(spark, "manifest")
    rows = views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ticket_id"), F.col("source").alias("dataset_source"), F.col("lang").alias("region"), F.col("text").alias("message")
    )
    halves = [rows.where(F.pmod("ticket_id", F.lit(2)) == i) for i in (0, 1)]
    broken = halves[1].select("ticket_id", "dataset_source", F.lit("broken").alias("attempt"))
    broken.write.mode("append").partitionBy(store.PARTITION).parquet(path)
    for half in (halves[0], halves[1], halves[0]):
        store.append_once({path: half}, manifest, store.upload_key(half, "documents"))
    stored = store.read_committed(spark, path, manifest, TICKETS)
    return present(stored.select("ticket_id", "dataset_source", "region", F.md5("message").alias("message")))


@register
def sink_replace(spark, sf_dir):
    """Two stored datasets, one of them overwritten by a part of itself, then a table that was cleared."""
    path, cleared = scratch_path(spark, "metrics"), scratch_path(spark, "cleared")
    metrics = views.metrics_events(spark, sf_dir)
    for table in (metrics, ticket_daily(spark, sf_dir)):
        store.append_metrics(table, path)
        store.append_metrics(table, cleared)
    store.replace_dataset(metrics.where(F.col("region") == "R0"), path)
    store.clear_table(spark, cleared, DAILY_METRICS)
    counts = [
        store.read_stored(spark, p, DAILY_METRICS).groupBy("dataset_source").agg(F.count("*").alias("stored_rows")).select(F.lit(k).alias("store"), "*")
        for k, p in (("replaced", path), ("cleared", cleared))
    ]
    return present(counts[0].unionByName(counts[1]))


@register
def src_preferred(spark, sf_dir):
    """The first of several candidate files that exists."""
    there = uploads.to_csv(views.table(spark, sf_dir, "part"))
    missing = scratch_path(spark, "missing") + ".csv"
    return present(files.read_table(spark, files.preferred_source(spark, [missing, there, f"{sf_dir}/orders.parquet"])))


# Tickets --------------------------------------------------------------------


def anchor(spark, sf_dir) -> list[float]:
    """The query vector of the search queries: the stored vector with the smallest id."""
    return views.table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).first()["embedding"]


@register
def vector_normalize(spark, sf_dir):
    """Every position of each vector, cut to 48 and padded to 80."""
    vectors_df = views.table(spark, sf_dir, "embeddings")
    cut = vectors.vector_normalize(F.col("embedding"), 48)
    padded = vectors.vector_normalize(F.col("embedding"), 80)
    return present(
        vectors_df.select("vec_id", cut.alias("cut"), padded.alias("padded"))
        .select(
            "vec_id",
            F.size("cut").alias("cut_size"),
            F.size("padded").alias("padded_size"),
            F.posexplode("padded").alias("position", "padded_value"),
            "cut",
        )
        .select(
            "vec_id",
            "cut_size",
            "padded_size",
            "position",
            F.get("cut", F.col("position")).alias("cut_value"),
            "padded_value",
        ),
        5,
    )


@register
def ticket_topk(spark, sf_dir):
    found = tickets.ticket_topk(views.tickets(spark, sf_dir), anchor(spark, sf_dir), limit=20, min_similarity=0.15)
    return shown_tickets(found)


@register
def ticket_filtered_topk(spark, sf_dir):
    wanted = tickets.filter_tickets(
        views.tickets(spark, sf_dir), dataset_source="DOCUMENTS", region="en", product_name=" SRC_ ", customer_tier="ret"
    )
    return shown_tickets(tickets.ticket_topk(wanted, anchor(spark, sf_dir), limit=10, min_similarity=0.05))


@register
def ticket_date_filter(spark, sf_dir):
    wanted = tickets.filter_tickets(
        views.tickets(spark, sf_dir, False), start_date=date(2024, 1, 10), end_date=date(2024, 1, 12), issue_category="/DE"
    )
    return shown_tickets(wanted)


@register
def ticket_defaults(spark, sf_dir):
    sparse = views.tickets(spark, sf_dir, False).select(
        "ticket_id",
        "message",
        F.when(F.col("ticket_id") % 3 != 0, F.col("region")).alias("region"),
        F.when(F.col("ticket_id") % 4 != 0, F.col("dispute_amount")).alias("dispute_amount"),
    )
    return shown_tickets(tickets.ticket_defaults(sparse, "DOCUMENTS", datetime(2024, 2, 1)))


@register
def citations(spark, sf_dir):
    found = tickets.ticket_topk(views.tickets(spark, sf_dir), anchor(spark, sf_dir), limit=20, min_similarity=0.15)
    return present(tickets.citations(found))


@register
def hash_embed(spark, sf_dir):
    """Position-weighted checksum of the lexical vector of every document."""
    embedded = views.table(spark, sf_dir, "documents").select("doc_id", embedding.sparse_embed(F.col("text")).alias("v"))
    weighted = F.aggregate(
        F.zip_with("v.values", "v.indices", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x
    )
    return present(embedded.select("doc_id", weighted.alias("checksum"), F.size("v.indices").alias("filled")), 3)


@register
def ticket_search_text(spark, sf_dir):
    """The tickets that share most words with the first benchmark passage, by posting blocks."""
    passage = views.table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1).first()["text"]
    stored = views.tickets(spark, sf_dir, False)
    index = staged(lexical.lexical_index(stored), "postings")
    found = lexical.search_index(index, passage, limit=10, min_similarity=0.10)
    return present(found.join(stored.select("ticket_id", "region"), "ticket_id").select("ticket_id", "region", "similarity_score"))


@register
def postings_by_level(spark, sf_dir):
    """The index of all documents by bucket and class of weight: its blocks' largest weights and their postings."""
    index = lexical.lexical_index(views.tickets(spark, sf_dir, False))
    return present(
        index.groupBy("bucket", "level").agg(
            F.max("top").alias("top"), F.sum(F.size("postings")).alias("postings"),
            F.sum(F.aggregate("postings", F.lit(0).cast("bigint"), lambda a, p: a + p["ticket_id"])).alias("ids"),
        )
    )


def stored_ticket_events(spark, sf_dir) -> DataFrame:
    """The ticket events as a scan leaves them: a written table that investigations read."""
    path = scratch_path(spark, "events")
    ticket_events(spark, sf_dir).select(*EVENT_COLUMNS).write.parquet(path)
    return spark.read.parquet(path)


def anchored_queries(spark, sf_dir, found: DataFrame) -> DataFrame:
    """One query per segment and metric of the events, with a stored vector as its text's vector."""
    anchors = views.table(spark, sf_dir, "embeddings").groupBy("label").agg(
        F.min_by("embedding", "vec_id").alias("query_vector")
    )
    keys = investigate.SEGMENT_KEYS
    segments = found.select(*keys).distinct()
    queries_df = segments.withColumn("query_id", key_id(*[F.col(c) for c in keys]))
    return queries_df.join(anchors, F.col("query_id") % 10 == F.col("label")).drop("label")


@register
def citations_with_fallback(spark, sf_dir):
    asked = anchored_queries(spark, sf_dir, stored_ticket_events(spark, sf_dir))
    found = nearest.nearest_tickets(asked, views.tickets(spark, sf_dir), 5, 0.20, 0.15)
    return present(tickets.matched_citations(found, views.tickets(spark, sf_dir, False)))


@register
def citations_by_text(spark, sf_dir):
    """Lexical vectors on both sides: the words of segment and metric against whole messages."""
    stored = tickets.embed_tickets(views.tickets(spark, sf_dir, False))
    found = nearest.nearest_tickets(tickets.anomaly_queries(ticket_events(spark, sf_dir)), stored, 5, 0.02, 0.01)
    return present(found.select("query_id", "rank", "is_fallback", "ticket_id", "similarity_score"), 4)


# Evidence, reports, scorecard -----------------------------------------------


def cited_reports(spark, sf_dir, found: DataFrame | None = None) -> DataFrame:
    found = stored_ticket_events(spark, sf_dir) if found is None else found
    asked = anchored_queries(spark, sf_dir, found)
    cited = investigate.with_citations(found, views.tickets(spark, sf_dir), asked, 0.20, 0.15)
    return reports.build_reports(evidence.sql_evidence(cited, ticket_daily(spark, sf_dir)))


@register
def evidence_metrics(spark, sf_dir):
    both = views.metrics_events(spark, sf_dir).unionByName(ticket_daily(spark, sf_dir))
    return present(evidence.evidence_metrics(ticket_events(spark, sf_dir), both))


def all_runs(spark, sf_dir) -> DataFrame:
    """The evidence templates and one that names a column no table has."""
    tables = {"daily_spend_metrics": ticket_daily(spark, sf_dir), "dispute_support_tickets": views.tickets(spark, sf_dir, False)}
    broken = evidence_runs.Template("broken", "SELECT a.id AS anomaly_id, m.no_such_column FROM anomalies a, daily_spend_metrics m")
    return evidence_runs.evidence_runs(stored_ticket_events(spark, sf_dir), tables, [*evidence_runs.TEMPLATES, broken])


@register
def evidence_queries(spark, sf_dir):
    """Every evidence query of every event: its rows, or that it failed."""
    runs = all_runs(spark, sf_dir)
    return present(runs.select("anomaly_id", "template", "row_count", F.size("rows").alias("shown"), F.col("error").isNotNull().alias("failed")))


@register
def evidence_scores(spark, sf_dir):
    """What the evidence queries say of each event, with and without the one that fails."""
    runs = staged(all_runs(spark, sf_dir), "runs")
    whole = evidence_runs.run_scores(runs).select(F.lit("all").alias("templates"), "*")
    sound = evidence_runs.run_scores(runs.where("template <> 'broken'")).select(F.lit("sound").alias("templates"), "*")
    return present(whole.unionByName(sound))


@register
def gateway_degraded(spark, sf_dir):
    return present(evidence.gateway_degraded(views.gateway_logs(spark, sf_dir), region="ASIA", product="BUILDING"))


@register
def evidence_gateway(spark, sf_dir):
    found = events.signals_to_events(scan_metrics(views.metrics_orders(spark, sf_dir), NO_FOREST), "ORDERS")
    return present(evidence.gateway_by_segment(found, views.gateway_logs(spark, sf_dir)))


@register
def evidence_gateway_latest(spark, sf_dir):
    """The five latest degraded gateway days next to every event of their segment."""
    found = events.signals_to_events(scan_metrics(views.metrics_orders(spark, sf_dir), NO_FOREST), "ORDERS")
    latest = evidence.evidence_gateway(found, views.gateway_logs(spark, sf_dir), cap=5)
    return present(latest.select("anomaly_id", "rank", "region", "product_name", "log_date", "partner_bank", "failed_requests"))


@register
def evidence_arrays(spark, sf_dir):
    """Findings of two passes appended in order."""
    passes = views.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array(F.concat("role", F.lit("#1"))).alias("findings"), F.array(F.concat("role", F.lit("#2"))).alias("more")
    )
    appended = evidence.append_evidence(passes, "findings", "more")
    return appended.select("conv_id", "turn", F.array_join("findings", ",").alias("findings"))


@register
def evidence_gaps(spark, sf_dir):
    counted = reports.report_counts(cited_reports(spark, sf_dir)).select("anomaly_id", "metric_rows", "citations")
    return present(evidence.evidence_gaps(counted))


@register
def report_summary(spark, sf_dir):
    found = cited_reports(spark, sf_dir)
    counts = [
        F.size("evidence_data.sql_history").alias("sql_queries"),
        F.size("evidence_data.ticket_citations").alias("citations"),
    ]
    return present(found.select("anomaly_id", "root_cause_summary", "confidence_score", "mitigation_steps", *counts))


@register
def report_markdown(spark, sf_dir):
    found = stored_ticket_events(spark, sf_dir)
    return reports.report_documents(cited_reports(spark, sf_dir, found), found)


@register
def sink_documents(spark, sf_dir):
    """The Markdown reports in two batches, one of them written twice, read back from their files by the index."""
    path = scratch_path(spark, "documents")
    found = stored_ticket_events(spark, sf_dir)
    written = staged(reports.report_documents(cited_reports(spark, sf_dir, found), found), "reports")
    for batch in (0, 1, 0):
        documents.write_document_batch(written.where(F.pmod("anomaly_id", F.lit(2)) == batch), path, f"batch-{batch}")
    return documents.read_documents(spark, path)


@register
def investigation_events(spark, sf_dir):
    found = stored_ticket_events(spark, sf_dir)
    feed = reports.investigation_events(cited_reports(spark, sf_dir, found), found)
    paths = {
        "anomaly_info": "$.metric",
        "sql_evidence": "$.row_count",
        "ticket_evidence": "$.ticket_id",
        "rca_report": "$.confidence_score",
        "complete": "$.status",
    }
    detail = F.lit(None).cast("string")
    for kind, path in paths.items():
        detail = F.when(F.col("event") == kind, F.get_json_object("data", path)).otherwise(detail)
    return present(feed.select("anomaly_id", "seq", "event", detail.alias("detail")))


@register
def text_block(spark, sf_dir):
    """Documents as lists of lines, and their labels as lists of maps."""
    doc = views.table(spark, sf_dir, "documents")
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    facts = F.array(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")), F.create_map(F.lit("n"), F.col("n_chars").cast("string")))
    return doc.select(
        "doc_id",
        F.md5(text.text_lines(lines, "empty")).alias("lines"),
        text.text_pairs(facts).alias("facts"),
        text.text_or_default(F.when(F.col("doc_id") % 5 != 0, F.col("source")), "none given").alias("fallback"),
    )


@register
def json_extract(spark, sf_dir):
    """Event properties wrapped the ways a model wraps its JSON, and some that are no JSON."""
    n = F.col("event_id")
    raw_text = (
        F.when(n % 5 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(n % 5 == 1, F.concat(F.lit("```\n"), "props", F.lit("```  ")))
        .when(n % 5 == 2, F.concat(F.lit("Here it is: "), "props", F.lit(" - done.")))
        .when(n % 5 == 3, F.col("event_type"))
        .otherwise(F.col("props"))
    )
    wrapped = views.table(spark, sf_dir, "events").select("event_id", raw_text.alias("raw"))
    parsed = wrapped.select("event_id", text.parsed_json(F.col("raw")).alias("j"))
    return parsed.select(
        "event_id", F.try_variant_get("j", "$.k", "bigint").alias("k"), F.col("j").isNotNull().alias("is_json")
    )


def scenarios(found: DataFrame) -> DataFrame:
    """Keywords expected for an anomaly: its segment and frequent words of the languages."""
    words = F.array(F.lower("region"), F.lower("product_name"), F.lit("the"), F.lit("der"), F.lit("que"), F.lit("zzz"))
    return found.select(F.col("id").alias("anomaly_id"), words.alias("keywords"))


def card(spark, sf_dir) -> DataFrame:
    found = stored_ticket_events(spark, sf_dir)
    done = cited_reports(spark, sf_dir, found).where(F.col("anomaly_id") % 7 != 0)
    return scorecard.scorecard(scenarios(found), done)


@register
def retrieval_precision(spark, sf_dir):
    found = stored_ticket_events(spark, sf_dir)
    joined = scenarios(found).join(cited_reports(spark, sf_dir, found), "anomaly_id")
    texts = F.transform("evidence_data.ticket_citations", lambda c: c["complaint_text"])
    return present(joined.select("anomaly_id", scorecard.retrieval_precision(texts, F.col("keywords")).alias("precision")))


def scorecard_rows(spark, sf_dir):
    return present(card(spark, sf_dir))


_REGISTRY["scorecard"] = scorecard_rows


@register
def scorecard_summary(spark, sf_dir):
    return present(scorecard.scorecard_summary(card(spark, sf_dir)))


@register
def incremental_scan(spark, sf_dir):
    """Two weeks of metrics arrive, then the rest; the events are those a scan after each arrival adds."""
    base = scratch_path(spark, "incremental")
    arrivals, late = f"{base}/arrivals", F.col("metric_date") >= F.lit("2024-01-16").cast("date")
    metrics = views.metrics_events(spark, sf_dir)
    for part in (metrics.where(~late), metrics.where(late)):
        part.write.mode("append").parquet(arrivals)
        incremental.incremental_scan(
            spark, arrivals, f"{base}/metrics", f"{base}/events", f"{base}/state", "EVENTS_30D"
        ).awaitTermination()
    return present(store.read_stored(spark, f"{base}/events", ANOMALY_EVENTS))
