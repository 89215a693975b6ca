import json
import sqlite3
from datetime import date, datetime, timedelta
from functools import reduce

import pytest
from pyspark.sql import functions as F

from pulseward.functions.dates import parsed_time, writes_day_first
from pulseward.functions.text import dataset_slug
from pulseward.operators.complaints import CONSUMER_COMPLAINTS, ComplaintExport, complaint_daily, normalize_complaints
from pulseward.operators.inference import TableRoles, infer_roles, schema_roles
from pulseward.operators.ingestion import ingest_metrics, ingest_summary, ingest_tickets
from pulseward.operators.profiles import column_profiles, merge_profiles, narrowest_type
from pulseward.operators.signals import DetectorSettings, scan_metrics
from pulseward.operators.telemetry import overview
from pulseward.operators.tickets import search_tickets
from pulseward.plans.ingest import infer_file, ingest_complaints, ingest_file, with_ticket_ids
from pulseward.plans.store import read_stored
from pulseward.schemas import ANOMALY_EVENTS, DAILY_METRICS, TICKETS
from pulseward.sources.files import preferred_source, read_complaints, read_csv, read_profiled, read_table
from pulseward.sources.sqlite import read_sqlite

RUN = date(2026, 3, 1)


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


PAYMENTS = (
    "txn_timestamp,merchant_id,amount,fee,currency,status,failure_reason\n"
    "2026-02-01 10:00:00,M1,100.5,1.5,USD,OK,None\n"
    "2026-02-01 11:00:00,M2,200.0,2.0,USD,FAILED,Gateway timeout while charging the card\n"
    "2026-02-02 12:00:00,M1,50.0,0.5,EUR,OK,NA\n"
)


def test_payment_log_roles(spark, tmp_path):
    roles = infer_file(spark, write(tmp_path / "Payment Logs (v2).csv", PAYMENTS))
    assert roles.source == "payment_logs_v2"
    assert roles.time == "txn_timestamp"
    assert roles.measures == ["amount", "fee"] and roles.measure == "amount"
    assert roles.narrative == "failure_reason"
    assert roles.labels == ["merchant_id", "currency", "status"]
    assert roles.rows == 3 and len(roles.preview) == 3


def test_server_json_roles(spark, tmp_path):
    records = [
        {"timestamp": "2026-02-01T10:00:00Z", "server_id": f"s{i}", "region": "us", "cpu_percent": 40.5 + i, "latency_ms": 120 + i}
        for i in range(2)
    ]
    df = read_table(spark, write(tmp_path / "servers.json", json.dumps(records)))
    roles = infer_roles(df, "servers")
    assert roles.time == "timestamp" and set(roles.measures) == {"cpu_percent", "latency_ms"}
    assert "server_id" in roles.labels and roles.narrative is None


def test_timestamp_by_value_and_by_position(spark):
    by_value = spark.createDataFrame([("x", "2026-01-01")], "a string, b string")
    assert infer_roles(by_value, "t").time == "b"
    by_position = spark.createDataFrame([("x", "y")], "a string, b string")
    assert infer_roles(by_position, "t").time == "a"
    assert infer_roles(by_position, "t").measure == "event_count"


def test_long_texts_become_the_narrative_once(spark):
    long = "x" * 30
    df = spark.createDataFrame([("2026-01-01", long, long, True, "n")], "day_date string, a string, message string, flag boolean, d string")
    roles = infer_roles(df, "t")
    assert (roles.narrative, roles.labels, roles.measures) == ("a", ["message", "d"], ["flag"])
    table = {r.column_name: (r.role, r.is_primary) for r in schema_roles(df).collect()}
    assert table == {
        "day_date": ("timestamp", False),
        "a": ("narrative", False),
        "message": ("dimension", False),
        "flag": ("metric", True),
        "d": ("dimension", False),
    }


def test_slugs(spark):
    names = [("My File (1).csv",), ("___.csv",), ("a.b.json",), ("plain",)]
    got = [r[0] for r in spark.createDataFrame(names, "n string").select(dataset_slug(F.col("n"))).collect()]
    assert got == ["my_file_1", "custom_dataset", "a_b", "plain"]


CUSTOM = (
    "event_time,region,product,amount,customer_notes\n"
    "2026-02-01,East,Gadget,120.0,Checkout failed with OTP timeout at payment\n"
    "2026-02-01,East,Gadget,250.0,Refund still pending after two weeks\n"
    "2026-02-02,West,Widget,500.0,Card was charged twice for one order\n"
)


def test_custom_csv_end_to_end(spark, tmp_path):
    path = write(tmp_path / "custom.csv", CUSTOM)
    metrics, tickets = str(tmp_path / "m"), str(tmp_path / "t")
    summary = ingest_file(spark, path, metrics, tickets, RUN)
    assert summary == {
        "dataset_name": "custom",
        "total_records": 3,
        "metrics_inserted": 2,
        "tickets_embedded": 3,
        "start_date": date(2026, 2, 1),
        "end_date": date(2026, 2, 2),
    }
    stored = read_stored(spark, metrics, DAILY_METRICS)
    row = overview(stored, spark.createDataFrame([], "dataset_source string, priority string"), spark.createDataFrame([], ANOMALY_EVENTS), "custom").first()
    assert row.total_spend == 870.0 and row.total_transactions == 3
    held = spark.read.parquet(tickets)
    hit = search_tickets(held, "OTP timeout during payment", limit=1, min_similarity=0.1).first()
    assert "OTP" in hit.message
    assert sorted(r.customer_id for r in held.collect()) == ["CUST-0001", "CUST-0002", "CUST-0003"]


def test_error_counts_raise_an_alert(spark, tmp_path):
    lines = ["date,region,service,error_count,incident_log"]
    for i in range(15):
        day = date(2026, 1, 1) + timedelta(days=i)
        lines.append(f"{day},us,api,{180 if i == 14 else 5},{'Outage of the main database' if i == 14 else 'ok'}")
    path = write(tmp_path / "errors.csv", "\n".join(lines) + "\n")
    metrics = str(tmp_path / "m")
    ingest_file(spark, path, metrics, str(tmp_path / "t"), RUN)
    stored = read_stored(spark, metrics, DAILY_METRICS).orderBy("metric_date")
    assert [r.success_rate_pct for r in stored.collect()] == [95.0] * 14 + [10.0]
    found = scan_metrics(stored, DetectorSettings(7, 2.0)).collect()
    assert [(s.metric_name, s.metric_date) for s in found] == [("success_rate_plunge", date(2026, 1, 15))]


def test_unparsed_dates_count_as_the_run_date_and_null_labels_drop(spark):
    df = spark.createDataFrame(
        [("bad", "a", 1.0), (None, "a", 3.0), ("2026-01-01", None, 5.0)], "when_time string, dim string, latency double"
    )
    mapping = TableRoles("d", "when_time", "latency", ["latency"], ["dim"])
    rows = ingest_metrics(df, mapping, RUN).collect()
    assert [(r.metric_date, r.region, r.product_name, r.transaction_count, r.avg_latency_ms) for r in rows] == [(RUN, "a", "Standard", 2, 2.0)]
    summary = ingest_summary(df, mapping, RUN).first()
    assert (summary.total_records, summary.metrics_inserted, summary.start_date) == (3, 1, date(2026, 1, 1))


def test_dates_in_other_forms(spark):
    texts = ["03/12/2014", "3/12/2014 16:05", "3/12/2014 4:05:06 PM", "12-Mar-2014", "12 March 2014", "Mar 12, 2014", "2014/3/12", " 2014-03-12T01:02:03 "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {str(r[0]) for r in df.select(parsed_time(F.col("t")).cast("date")).collect()} == {"2014-03-12"}
    assert [r[0] for r in spark.createDataFrame([("13/12/2014",), ("soon",), ("",), (None,)], "t string").select(parsed_time(F.col("t"))).collect()] == [None] * 4
    days = spark.createDataFrame([("13/12/2014",), ("01/02/2014",), (None,)], "t string")
    assert writes_day_first(days, "t") and not writes_day_first(df, "t")
    assert {str(r[0]) for r in days.select(parsed_time(F.col("t"), True).cast("date")).collect()} == {"2014-12-13", "2014-02-01", "None"}


def test_a_late_value_decides_the_time_column(spark):
    rows = [(f"2026-01-{1 + i % 28:02d}" if i < 99 else "late", "1 Jan 2026") for i in range(100)]
    assert infer_roles(spark.createDataFrame(rows, "a string, b string"), "t").time == "b"


def test_day_first_uploads(spark, tmp_path):
    path = write(tmp_path / "eu.csv", "event_date,amount\n13/02/2026,1.0\n01/02/2026,2.0\n")
    summary = ingest_file(spark, path, str(tmp_path / "m"), str(tmp_path / "t"), RUN)
    assert (summary["start_date"], summary["end_date"]) == (date(2026, 2, 1), date(2026, 2, 13))


def test_json_lines_and_unreadable_json(spark, tmp_path):
    lines = "\n".join(json.dumps({"x": i}) for i in range(100))
    assert read_table(spark, write(tmp_path / "a.json", lines)).count() == 100
    assert read_table(spark, write(tmp_path / "a.dat", "\n" + lines)).count() == 100
    assert read_table(spark, write(tmp_path / "b.json", json.dumps([{"x": 1}, {"x": 2}], indent=1))).count() == 2
    with pytest.raises(Exception):
        read_table(spark, write(tmp_path / "c.json", lines + "\n{broken")).collect()
    (tmp_path / "d.json").mkdir()
    write(tmp_path / "d.json" / "1.json", lines)
    write(tmp_path / "d.json" / "2.json", '[{"x": 1}]')
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "d.json"))


def test_long_integers_stay_apart(spark, tmp_path):
    text = "a,b,c\n9007199254740993000,18446744073709551615,9223372036854775807\n9007199254740993001,18446744073709551614,1.5\n"
    df = read_table(spark, write(tmp_path / "ids.csv", text), multi_line=False)
    assert dict(df.dtypes) == {"a": "bigint", "b": "decimal(38,0)", "c": "double"}
    assert df.select("a").distinct().count() == df.select("b").distinct().count() == 2


def test_sqlite_values_that_do_not_fit(spark, tmp_path):
    rows = [("1", b"01/02/2026", b"\xff", "Fee", "t", "CA", "Yes", "x", 1.5), ("2", "d", "p", "Fee", "t", "CA", "Yes", 2, 2.0)]
    got = read_sqlite(spark, sqlite_file(tmp_path / "v.sqlite", rows)).orderBy("complaint_id").collect()
    assert [(r.date_received, r["product"], r.amount, r.n) for r in got] == [("01/02/2026", None, None, None), ("d", "p", 2.0, 2)]


def test_narratives_are_capped_in_order(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["x", "None", " ", None, "y", "z"])], "n int, note string")
    mapping = TableRoles("d", "n", "event_count", narrative="note")
    rows = ingest_tickets(df, mapping, datetime(2026, 1, 1), "n", cap=2).orderBy("customer_id").collect()
    assert [(r.customer_id, r.message) for r in rows] == [("CUST-0001", "x"), ("CUST-0002", "y")]


def test_empty_and_missing_files(spark, tmp_path):
    empty = write(tmp_path / "empty.csv", "a,b\n")
    with pytest.raises(ValueError):
        infer_file(spark, empty)
    assert ingest_file(spark, empty, str(tmp_path / "m"), str(tmp_path / "t"), RUN)["total_records"] == 0
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path / "nothing.csv"))
    with pytest.raises(ValueError):
        read_complaints(spark, write(tmp_path / "x.xlsx", "x"), CONSUMER_COMPLAINTS)
    assert preferred_source(spark, [str(tmp_path / "nothing.sqlite"), empty]) == empty


def test_csv_types_and_missing_texts(spark, tmp_path):
    path = write(tmp_path / "t.csv", 'i,d,b,s,n\n1,1.5,true,"a ""q"", b\nnext",NA\nNA,2,False,null,\n3,,true,None,n/a\n')
    df = read_csv(spark, path)
    assert dict(df.dtypes) == {"i": "bigint", "d": "double", "b": "boolean", "s": "string", "n": "double"}
    assert [tuple(r) for r in df.collect()] == [(1, 1.5, True, 'a "q", b\nnext', None), (None, 2.0, False, None, None), (3, None, True, None, None)]


def test_unknown_suffix_tries_csv_then_json(spark, tmp_path):
    assert read_table(spark, write(tmp_path / "a.dat", "x,y\n1,2\n")).columns == ["x", "y"]
    assert read_table(spark, write(tmp_path / "b.dat", '[{"x": 1}, {"x": 2}]')).count() == 2


def sqlite_file(path, rows):
    with sqlite3.connect(path) as con:
        con.execute('CREATE TABLE complaints (complaint_id TEXT, date_received TEXT, product TEXT, issue TEXT, consumer_complaint_narrative TEXT, state TEXT, "consumer_disputed?" TEXT, amount REAL, n INTEGER)')
        con.executemany("INSERT INTO complaints VALUES (?,?,?,?,?,?,?,?,?)", rows)
    con.close()
    return str(path)


def test_sqlite_reads_in_ranges(spark, tmp_path):
    rows = [(f"{i:07d}", "01/02/2026", "Card", "Fee", "long enough text" if i % 2 else None, "CA", "Yes", i / 2, i) for i in range(25)]
    path = sqlite_file(tmp_path / "c.sqlite", rows)
    df = read_sqlite(spark, path, rows_per_partition=10)
    assert df.rdd.getNumPartitions() == 3 and df.count() == 25
    assert df.where(F.col("consumer_complaint_narrative").isNotNull()).count() == 12
    assert df.where("n = 7").first().amount == 3.5
    assert read_table(spark, path).agg(F.sum("n")).first()[0] == 300


def test_sqlite_ranges_follow_the_pages(spark, tmp_path):
    ids = [-5, *range(1, 3000), *range(10**12, 10**12 + 3000), 2**62]
    with sqlite3.connect(tmp_path / "wide.sqlite") as con:
        con.execute("PRAGMA page_size = 512")
        con.execute("CREATE TABLE t (k INTEGER PRIMARY KEY, body TEXT)")
        con.executemany("INSERT INTO t VALUES (?, ?)", [(i, f"text {i} " * (i % 40)) for i in ids])
        con.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, n INTEGER) WITHOUT ROWID")
        con.executemany("INSERT INTO keyed VALUES (?, ?)", [(str(i), i) for i in range(2000)])
        con.execute("CREATE TABLE small (n INTEGER)")
        con.execute("INSERT INTO small VALUES (1)")
    con.close()
    path = str(tmp_path / "wide.sqlite")
    df = read_sqlite(spark, path, "t", bytes_per_partition=20_000)
    rows = df.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert 20 < len(rows) < 200 and sum(rows) == len(ids) and max(rows) < len(ids) / 10
    assert {tuple(r) for r in df.collect()} == {(i, f"text {i} " * (i % 40)) for i in ids}
    assert read_sqlite(spark, path, "keyed", bytes_per_partition=20_000).agg(F.sum("n")).first()[0] == 1999000
    assert read_sqlite(spark, path, "small", bytes_per_partition=20_000).collect()[0].n == 1


def test_sqlite_takes_columns_lengths_and_limits(spark, tmp_path):
    with sqlite3.connect(tmp_path / "m.sqlite") as con:
        con.execute("CREATE TABLE t (rank INTEGER, label TEXT COLLATE NOCASE, body TEXT, rest TEXT)")
        ranks = [5, "12", None, "x", 3.0, 2.5, 9, 1, -4, b"2", 2**60]
        con.executemany("INSERT INTO t VALUES (?, ?, ?, 'r')", [(r, "bA"[i % 2] + str(i), "\u00e9" * i) for i, r in enumerate(ranks)])
    con.close()
    path = str(tmp_path / "m.sqlite")
    whole = read_sqlite(spark, path)
    for order in ("rank", "label"):
        for limit in range(12):
            got = read_sqlite(spark, path, columns=["body", "absent"], limit=limit, order_by=order, rows_per_partition=4)
            assert got.columns == sorted(["body", order], key=whole.columns.index)
            assert [r[order] for r in got.collect()] == [r[order] for r in whole.orderBy(order).limit(limit).collect()]
    long = read_sqlite(spark, path, columns=["rank"], longer_than={"body": 4})
    assert long.columns == ["rank", "body"] and long.count() == 6
    for wrong in ({"longer_than": {"absent": 1}}, {"limit": 1}, {"limit": 1, "order_by": "absent"}):
        with pytest.raises(Exception):
            read_sqlite(spark, path, **wrong).collect()


def test_sqlite_complaints_filter_then_limit(spark, tmp_path):
    rows = [
        ("0000001", "01/02/2026", "Card", "Fee", "short", "CA", "Yes", 1.0, 1),
        ("0000002", "01/02/2026", None, "Fee", "a long complaint text", None, "no", 1.0, 1),
        ("0000003", "01/03/2026", "Commercial loan", "Fee", "another long complaint", "TX", "YES ", 1.0, 1),
        ("0000004", "not a date", "Card", "Fee", "third long complaint", "TX", None, 1.0, 1),
    ]
    path = sqlite_file(tmp_path / "c.db", rows)
    got = read_complaints(spark, path, CONSUMER_COMPLAINTS, max_records=2).orderBy("customer_id").collect()
    assert [(r.customer_id, r.product_name, r.region, r.priority, r.customer_tier) for r in got] == [
        ("CUST-000002", "None", "None", "NORMAL", "Retail"),
        ("CUST-000003", "Commercial loan", "TX", "CRITICAL", "Enterprise"),
    ]
    assert read_complaints(spark, path, CONSUMER_COMPLAINTS).count() == 2


def test_csv_complaints(spark, tmp_path):
    text = (
        "date_received,product,issue,consumer_complaint_narrative,complaint_id,company,state,consumer_disputed?,extra\n"
        "08/15/2026,Credit card,Billing disputes,They billed me twice,12345678,Bank,CA,Yes,x\n"
        "8/16/2026, Corporate card ,Fees,  wrong fee  ,99,Bank,,No,x\n"
        "08/17/2026,Card,Fees,,1,Bank,CA,No,x\n"
        "08/17/2026,Card,Fees,nan,2,Bank,CA,No,x\n"
        ",Card,Fees,no date here,3,Bank,CA,No,x\n"
        "2026-08-18,,Fees,generic date,4,Bank,TX,true,x\n"
    )
    path = write(tmp_path / "c.csv", text)
    rows = read_complaints(spark, path, CONSUMER_COMPLAINTS).orderBy("ticket_created_at").collect()
    assert [(str(r.ticket_created_at.date()), r.customer_id, r.region, r.product_name, r.customer_tier, r.priority) for r in rows] == [
        ("2026-08-15", "CUST-345678", "CA", "Credit card", "Retail", "CRITICAL"),
        ("2026-08-16", "CUST-99", "West", "Corporate card", "Enterprise", "NORMAL"),
        ("2026-08-18", "CUST-4", "TX", "nan", "Retail", "CRITICAL"),
    ]
    assert rows[1].message == "wrong fee" and rows[0].subject == "[Credit card] Billing disputes"
    assert (rows[0].dispute_amount, rows[0].sentiment_score) == (250.0, -0.7)
    assert read_complaints(spark, path, CONSUMER_COMPLAINTS, max_records=1).count() == 1


def test_missing_columns_take_defaults(spark):
    df = spark.createDataFrame([("2026-01-01", "text one")], "day string, body string")
    mapping = ComplaintExport({"received": "day", "product": "p", "issue": "i", "narrative": "body", "entity": "e", "region": "r"})
    row = normalize_complaints(df, mapping).first()
    assert (row.region, row.product_name, row.issue_category) == ("West", "Credit Card", "Account Dispute")
    assert row.customer_id.startswith("CUST-")


def test_daily_complaint_kpis(spark):
    two = [(datetime(2026, 8, 15), "West", "Credit card", "Retail", "CRITICAL", m) for m in ("a", "b")]
    df = spark.createDataFrame(two, "ticket_created_at timestamp, region string, product_name string, customer_tier string, priority string, message string")
    row = complaint_daily(df, "C").first()
    assert (row.transaction_count, row.daily_spend_amount, row.chargeback_rate_pct, row.success_rate_pct, row.avg_latency_ms, row.avg_fraud_risk_score) == (
        2, 500.0, 100.0, 5.0, 260.0, 40.0,
    )


def test_long_labels_and_ids_stay_apart(spark):
    long = "x" * 100
    rows = [("01/02/2026", f"{long} {i}", f"{long} {i}", "same text", f"{i}00123456", f"{long} {i}") for i in (1, 2)]
    df = spark.createDataFrame(rows, "date_received string, product string, issue string, consumer_complaint_narrative string, complaint_id string, state string")
    tickets = normalize_complaints(df, CONSUMER_COMPLAINTS)
    for column in ("region", "product_name", "issue_category"):
        assert {r[0] for r in tickets.select(column).collect()} == {f"{long} 1", f"{long} 2"}
    assert {(r.customer_id, r.entity_id) for r in tickets.collect()} == {("CUST-123456", "100123456"), ("CUST-123456", "200123456")}
    for kept in ("region", "product_name"):
        other = "product_name" if kept == "region" else "region"
        daily = complaint_daily(tickets.withColumn(other, F.lit("same")), "C")
        assert sorted((r[kept], r.transaction_count) for r in daily.collect()) == [(f"{long} 1", 1), (f"{long} 2", 1)]
    ids = {r.entity_id: r.ticket_id for r in with_ticket_ids(tickets.withColumn("dataset_source", F.lit("C"))).collect()}
    alone = with_ticket_ids(tickets.where("entity_id like '2%'").withColumn("dataset_source", F.lit("C"))).first()
    assert len(set(ids.values())) == 2 and alone.ticket_id == ids["200123456"]


def test_complaints_are_stored_as_tickets_and_kpis(spark, tmp_path):
    text = "date_received,product,issue,consumer_complaint_narrative,complaint_id,state,consumer_disputed?\n" + "".join(
        f"01/0{1 + i % 3}/2026,Card,Fee,complaint number {i} about a fee,{i},CA,{'Yes' if i % 2 else 'No'}\n" for i in range(6)
    )
    path = write(tmp_path / "c.csv", text)
    counts = ingest_complaints(spark, path, CONSUMER_COMPLAINTS, str(tmp_path / "m"), str(tmp_path / "t"), "COMPLAINTS").first()
    assert tuple(counts) == ("c.csv", 6, 6, 3)
    assert read_stored(spark, str(tmp_path / "m"), DAILY_METRICS).count() == 3
    assert read_stored(spark, str(tmp_path / "t"), TICKETS).where(F.size("embedding") == 768).count() == 6


def test_profiles_of_parts_merge_into_the_profile_of_the_whole(spark):
    values = ["1", " -2 ", "9223372036854775808", "1.5", "1e3", "TRUE", "false", "2026-01-02", "13/01/2026", "01/02/2026", "x", "", None, "y" * 60]
    columns = [values[:2], values[:3], values[:5], values[5:7], values[7:8], values[8:10], values, [None]]
    kinds = ["bigint", "decimal(38,0)", "double", "boolean", "string", "string", "string", "double"]
    rows = [tuple(c[i % len(c)] for c in columns) + (i % 5, date(2026, 1, 1)) for i in range(len(values) * 2)]
    names = [f"c{i}" for i in range(len(columns))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", n int, d date")

    def profile(part):
        return column_profiles(part, types=True, times=names, distinct=True)

    parts = [profile(df.where(F.col("n") == i)) for i in range(5)] + [profile(df.where("false"))]
    merged = merge_profiles(reduce(lambda a, b: a.unionByName(b), parts))
    facts = ["ordinal", "data_type", "rows", "present", "characters", "longest", "kinds", "first_number", "second_number"]
    shown = facts + [F.hll_sketch_estimate("distinct_sketch").alias("distinct"), narrowest_type(F.col("kinds"), F.col("data_type")).alias("type")]
    whole = profile(df).select(*shown).orderBy("ordinal").collect()
    assert merged.select(*shown).orderBy("ordinal").collect() == whole
    assert [r["type"] for r in whole] == [*kinds, "int", "date"]
    assert [r["distinct"] for r in whole] == [len({v for v in c if v is not None}) for c in columns] + [5, 1]
    assert [bool((r["kinds"] or 0) & 16) for r in whole[4:7]] == [True, True, False]
    assert (whole[5]["first_number"], whole[5]["second_number"], whole[6]["longest"]) == (13, 2, 60)
    assert whole[7]["kinds"] is None and whole[8]["characters"] is None and whole[9]["longest"] == 10
    assert column_profiles(spark.createDataFrame([], "struct<>")).count() == 0


def test_an_upload_is_profiled_once(spark, tmp_path):
    path = write(tmp_path / "eu.csv", "event_date,amount,comment\n13/02/2026,1.0,NA\n01/02/2026,2,a text\n")
    table, columns = read_profiled(spark, path)
    assert table.dtypes == [("event_date", "string"), ("amount", "double"), ("comment", "string")]
    assert table.collect() == read_table(spark, path).collect()
    roles = infer_roles(table, "eu", 0, columns)
    assert (roles.time, roles.measure, roles.narrative, roles.day_first, roles.rows) == ("event_date", "amount", "comment", True, 2)
    records = '[{"received": "2026-01-02T03:04:05", "date_text": "soon", "n": 1}, {"received": null, "date_text": "2026-01-01", "n": 2}]'
    path = write(tmp_path / "r.json", records)
    table, columns = read_profiled(spark, path)
    assert table.collect() == read_table(spark, path).collect()
    assert [(c["column_name"], c["type"]) for c in columns] == [("date_text", "string"), ("n", "bigint"), ("received", "timestamp")]
