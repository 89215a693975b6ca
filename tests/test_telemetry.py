from datetime import datetime

import pytest

from pulseward.functions.guard import UnsafeQuery, check_query, query_verdict
from pulseward.operators import sandbox, telemetry
from pulseward.schemas import ANOMALY_EVENTS, DAILY_METRICS
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

TICKETS = "dataset_source string, priority string"


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def test_overview_sums_metrics_and_counts_events(spark, seed_metrics):
    events = spark.createDataFrame(
        [
            (1, "FINTECH_90D", datetime(2026, 1, 30), "success_rate_plunge", "South", "P", "T", 74.0, 98.5, -24.9, -20.4, "CRITICAL", "OPEN"),
            (2, "KAGGLE_CFPB", datetime(2026, 1, 30), "dispute_rate_spike", "N", "P", None, 15.0, 2.0, 650.0, 8.5, "HIGH", "OPEN"),
        ],
        ANOMALY_EVENTS,
    )
    row = telemetry.overview(seed_metrics, empty(spark, TICKETS), events, "FINTECH_90D").first()
    assert tuple(row) == (14750000.0, 30000, 98.17, 1, 1, 1)


def test_overview_falls_back_to_tickets(spark, seed_metrics):
    tickets = spark.createDataFrame([("X", "CRITICAL"), ("X", "NORMAL"), ("X", "NORMAL")], TICKETS)
    row = telemetry.overview(seed_metrics, tickets, empty(spark, ANOMALY_EVENTS), "X").first()
    assert tuple(row) == (750.0, 3, 66.67, 0, 0, 0)
    nothing = telemetry.overview(seed_metrics, tickets, empty(spark, ANOMALY_EVENTS), "Y").first()
    assert tuple(nothing) == (0.0, 0, 100.0, 0, 0, 0)


def test_timeseries_is_daily_and_ordered(spark, seed_metrics):
    rows = telemetry.timeseries(seed_metrics, "FINTECH_90D").collect()
    assert len(rows) == 30 and rows[0].date == "2026-01-01"
    assert tuple(rows[-1]) == ("2026-01-30", 250000.0, 74.0, 1000, 3.5)


def test_datasets_have_a_default(spark, seed_metrics):
    tickets = spark.createDataFrame([("UPLOAD", "HIGH")], TICKETS)
    names = [r[0] for r in telemetry.list_datasets(seed_metrics, tickets).collect()]
    assert names == ["FINTECH_90D", "KAGGLE_CFPB", "UPLOAD"]
    assert [r[0] for r in telemetry.list_datasets(empty(spark, DAILY_METRICS), empty(spark, TICKETS)).collect()] == ["KAGGLE_CFPB"]


REJECTED = [
    "DROP TABLE daily_spend_metrics;",
    "DELETE FROM dispute_support_tickets",
    "UPDATE daily_spend_metrics SET transaction_count = 0",
    "SELECT 1; DROP TABLE x",
    "WITH t AS (SELECT 1) INSERT INTO x SELECT * FROM t",
    "SELECT 'please drop it'",
    "SHOW TABLES",
    "SELECT reflect('java.lang.System', 'exit', 1)",
]


@pytest.mark.parametrize("sql", REJECTED)
def test_guard_refuses(spark, sql):
    with pytest.raises(UnsafeQuery):
        check_query(sql)
    verdict = spark.createDataFrame([(sql,)], "q string").select(query_verdict(F.col("q"))).first()[0]
    assert verdict != "OK"


def test_guard_accepts_and_caps(spark, seed_metrics):
    assert check_query("  SELECT count(*) AS n FROM t ; ") == "SELECT count(*) AS n FROM t"
    tables = {"daily_spend_metrics": seed_metrics}
    rows = sandbox.run_guarded(spark, tables, "SELECT metric_date, transaction_count FROM daily_spend_metrics LIMIT 1000", max_rows=7, timeout_seconds=60)
    assert len(rows) == 7 and isinstance(rows[0]["metric_date"], str) and isinstance(rows[0]["transaction_count"], float)


def test_guard_refuses_files_and_scripts(spark, seed_metrics, tmp_path):
    path = str(tmp_path / "secret")
    spark.range(3).write.parquet(path)
    with pytest.raises(Exception, match="(?i)not.found|not allowed|unsupported"):
        sandbox.guarded_sql(spark, {}, f"SELECT * FROM parquet.`{path}`").collect()
    with pytest.raises(Exception, match="(?i)script|hive|not allowed"):
        sandbox.guarded_sql(spark, {"t": seed_metrics}, "SELECT TRANSFORM(region) USING 'cat' AS (r string) FROM t").collect()
    assert spark.sql(f"SELECT count(*) FROM parquet.`{path}`").first()[0] == 3


def test_values_serialise_like_json(spark):
    df = spark.sql("SELECT DATE '2026-01-02' AS d, TIMESTAMP '2026-01-02 03:04:05' AS t, true AS b, 'x' AS s, array(1) AS a, CAST(1.5 AS DECIMAL(5,2)) AS n")
    row = df.select(*[sandbox.serialized(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]).first()
    assert tuple(row) == ("2026-01-02", "2026-01-02T03:04:05+00:00", 1.0, "x", [1], 1.5)


def test_schema_summary_names_tables_or_falls_back(spark, seed_metrics):
    assert sandbox.schema_summary(spark, ["no_such_table"]).first()[0].startswith("TABLES:")
    seed_metrics.createOrReplaceTempView("daily_spend_metrics")
    text = sandbox.schema_summary(spark).first()[0]
    assert "- daily_spend_metrics (dataset_source string, metric_date date" in text


def test_guarded_sql_reads_the_given_relations_only(spark, seed_metrics):
    spark.range(3).createOrReplaceTempView("foreign_view")
    spark.range(3).createOrReplaceGlobalTempView("foreign_global")
    tables = {"T": seed_metrics}
    before = spark.conf.get("spark.sql.runSQLOnFiles", "true")
    for sql in (
        "SELECT count(*) FROM foreign_view",
        "SELECT count(*) FROM global_temp.foreign_global",
        "SELECT * FROM t WHERE region IN (SELECT CAST(id AS STRING) FROM global_temp.foreign_global)",
        "WITH x AS (SELECT * FROM global_temp.foreign_global) SELECT count(*) FROM x, t",
    ):
        with pytest.raises((AnalysisException, sandbox.UnsafeQuery)):
            sandbox.guarded_sql(spark, tables, sql)
    fine = (
        "WITH days AS (SELECT region, metric_date, count(*) AS n FROM t GROUP BY region, metric_date HAVING count(*) > 0) "
        "SELECT d.region, row_number() OVER (ORDER BY d.metric_date) AS k, (SELECT max(n) FROM days) AS top FROM days d "
        "LEFT JOIN t u ON d.metric_date = u.metric_date LATERAL VIEW explode(array(1, 2)) e AS two "
        "WHERE EXISTS (SELECT 1 FROM T v WHERE v.region = d.region) UNION ALL SELECT 'x', 0, 0 ORDER BY 1 LIMIT 5"
    )
    assert len(sandbox.run_guarded(spark, tables, fine, timeout_seconds=60)) == 5
    assert spark.conf.get("spark.sql.runSQLOnFiles", "true") == before
    assert spark.catalog.tableExists("foreign_view") and not spark.catalog.tableExists("t")
    left = [r.name for r in spark.catalog.listTables("global_temp") if r.name.startswith("guarded_")]
    assert left == []


def test_two_callers_of_guarded_sql_do_not_meet(spark):
    from concurrent.futures import ThreadPoolExecutor

    def ask(n):
        rows = sandbox.run_guarded(spark, {"t": spark.range(n)}, "SELECT count(*) AS n FROM t", timeout_seconds=60)
        return rows[0]["n"]

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(ask, range(1, 13))) == [float(n) for n in range(1, 13)]


def test_datasets_come_from_the_folders_of_the_store(spark, seed_metrics, tmp_path):
    from pulseward.plans import store

    path, none = str(tmp_path / "m"), str(tmp_path / "none")
    odd = seed_metrics.limit(1).withColumn("dataset_source", F.lit("a/b = ü%"))
    store.append_metrics(seed_metrics.unionByName(odd), path)
    names = store.stored_datasets(spark, path, none)
    plan = names._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "NestedLoop" not in plan
    assert [r[0] for r in names.collect()] == ["FINTECH_90D", "KAGGLE_CFPB", "a/b = ü%"]
    assert [r[0] for r in store.stored_datasets(spark, none).collect()] == ["KAGGLE_CFPB"]
