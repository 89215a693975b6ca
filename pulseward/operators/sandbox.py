"""Read-only SQL over registered tables, and a description of them."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseward.functions.guard import UnsafeQuery, check_query

# Fixed values of the sandbox.
TIMEOUT_SECONDS = 5.0
DESCRIBED_TABLES = ["anomaly_events", "daily_spend_metrics", "dispute_support_tickets", "payment_gateway_logs"]
SUMMARY_TITLE = "ACTIVE DATABASE SCHEMAS:"
SUMMARY_WITHOUT_TABLES = (
    "TABLES:\n"
    "- daily_spend_metrics (dataset_source, metric_date, region, product_name, customer_tier, daily_spend_amount, "
    "transaction_count, success_rate_pct, avg_latency_ms, chargeback_rate_pct)\n"
    "- dispute_support_tickets (dataset_source, ticket_created_at, region, product_name, customer_tier, "
    "issue_category, priority, subject, message)\n"
    "- anomaly_events (dataset_source, detected_at, region, product_name, customer_tier, metric_name, actual_value, "
    "expected_value, severity, status)"
)


def serialized(column: Column, kind: T.DataType) -> Column:
    """Result values as JSON carries them: times as ISO text, numbers as doubles, other scalars as text."""
    if isinstance(kind, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        zone = "'+00:00'" if isinstance(kind, T.TimestampType) else ""
        whole = F.date_trunc("second", column) == column
        return F.when(whole, F.date_format(column, f"yyyy-MM-dd'T'HH:mm:ss{zone}")).otherwise(
            F.date_format(column, f"yyyy-MM-dd'T'HH:mm:ss.SSSSSS{zone}")
        )
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return column.cast("double")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.NullType)):
        return column
    return column.cast("string")


#: Kinds of nodes a read-only query over given relations is made of; whatever else the analyser lets through is refused.
ALLOWED_NODES = {
    "Aggregate",
    "CTERelationDef",
    "CTERelationRef",
    "Deduplicate",
    "Distinct",
    "Except",
    "Expand",
    "Filter",
    "Generate",
    "GlobalLimit",
    "Intersect",
    "Join",
    "LateralJoin",
    "LocalLimit",
    "LocalRelation",
    "Offset",
    "OneRowRelation",
    "Pivot",
    "Project",
    "Range",
    "ResolvedHint",
    "Sample",
    "Sort",
    "SubqueryAlias",
    "Tail",
    "Union",
    "Unpivot",
    "View",
    "Window",
    "WithCTE",
}


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def check_plan(plan, views: set[str]) -> None:
    """Walk an analysed plan from the top; below a given view anything goes, outside of one only ALLOWED_NODES.

    Subqueries inside expressions are walked like the rest. A relation that is none of the given views is refused, by whichever
    way a query names it: a table of the catalog, a view of another session, a file, a table function.
    """
    kind = plan.nodeName()
    if kind == "SubqueryAlias":
        child = plan.child()
        if child.nodeName() == "View" and child.isTempView() and plan.identifier().name() in views:
            return
    if kind == "View" or kind not in ALLOWED_NODES:
        raise UnsafeQuery(f"a read-only query may not use {kind}: {plan.simpleString(5)[:80]}")
    for below in [*_items(plan.children()), *_items(plan.subqueries())]:
        check_plan(below, views)


def checked_sql(spark: SparkSession, tables: Mapping[str, DataFrame], sql: str) -> DataFrame:
    """The result of a read-only query over the given tables and no others.

    The text is checked before anything is parsed, the analysed plan before anything runs. The query is analysed in a
    session of its own, so neither views nor settings of the caller's session are seen or changed, and
    several callers do not meet.
    """
    text = check_query(sql)
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    shared = {name.lower(): f"guarded_{uuid.uuid4().hex}" for name in tables}
    try:
        for name, table in tables.items():  # frames pass from session to session as global views, for as long as it takes
            table.createOrReplaceGlobalTempView(shared[name.lower()])
            own.table(f"global_temp.{shared[name.lower()]}").createOrReplaceTempView(name.lower())
        result = own.sql(text)
    finally:
        for view in shared.values():
            spark.catalog.dropGlobalTempView(view)
    check_plan(result._jdf.queryExecution().analyzed(), set(shared))
    return result


def guarded_sql(spark: SparkSession, tables: Mapping[str, DataFrame], sql: str, max_rows: int | None = None) -> DataFrame:
    """The rows of a read-only query over the given tables, as JSON carries them, or its first ``max_rows``."""
    result = checked_sql(spark, tables, sql)
    if max_rows is not None:
        result = result.limit(max_rows)
    return result.select(
        *[serialized(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in result.schema.fields]
    )


def run_guarded(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    sql: str,
    max_rows: int | None = None,
    timeout_seconds: float = TIMEOUT_SECONDS,
) -> list[dict]:
    """Run a guarded query and return its rows; its jobs are cancelled after the timeout."""
    result = guarded_sql(spark, tables, sql, max_rows)
    own = result.sparkSession
    tag = f"guarded-{uuid.uuid4().hex}"
    timer = threading.Timer(timeout_seconds, lambda: own.interruptTag(tag))
    own.addTag(tag)
    timer.start()
    try:
        return [row.asDict(recursive=True) for row in result.collect()]
    finally:
        timer.cancel()
        own.removeTag(tag)


def schema_summary(spark: SparkSession, names: list[str] = DESCRIBED_TABLES) -> DataFrame:
    """One row of text: the known tables of the catalog with their columns and types."""
    lines = []
    for name in sorted(names):
        if spark.catalog.tableExists(name):
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.table(name).schema.fields)
            lines.append(f"- {name} ({columns})")
    text = "\n".join([SUMMARY_TITLE, *lines]) if lines else SUMMARY_WITHOUT_TABLES
    return spark.range(1).select(F.lit(text).alias("summary"))
