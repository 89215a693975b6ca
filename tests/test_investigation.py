from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SOUTH, metric_row
from pulseward.functions.templates import evidence_query, number_text
from pulseward.functions.text import parsed_json, signed_percent, text_lines, text_object, text_or_default, text_pairs
from pulseward.operators import evidence, evidence_runs, reports, scorecard
from pulseward.operators.signals import scan_metrics
from pulseward.operators.tickets import embed_tickets
from pulseward.operators.events import current_status, signals_to_events
from pulseward.plans.investigate import investigate, investigate_and_persist
from pulseward.plans.documents import read_document, read_documents, write_document_batch
from pulseward.plans.ingest import ingest_file
from pulseward.plans.store import (
    MANIFEST,
    append_metrics,
    append_tickets,
    clear_table,
    read_committed,
    read_stored,
    replace_dataset,
    upload_key,
    write_documents,
)
from pulseward.schemas import ANOMALY_EVENTS, CITATION, DAILY_METRICS, REPORTS, STATUS_LOG, TICKETS
from pulseward.streaming.incremental import incremental_scan


@pytest.fixture(scope="module")
def anomalies(spark):
    rows = [
        (7, "FINTECH_90D", datetime(2026, 1, 30), "success_rate_plunge", *SOUTH, 74.0, 98.5, -24.87, -20.4, "CRITICAL", "OPEN"),
        (8, "FINTECH_90D", datetime(2026, 1, 30), "avg_latency_surge", "Mars", "Nothing", None, 1800.0, 250.0, 620.0, 9.0, "HIGH", "OPEN"),
    ]
    return spark.createDataFrame(rows, ANOMALY_EVENTS)


@pytest.fixture(scope="module")
def tickets(spark):
    rows = [
        (1, "FINTECH_90D", "South", "Corporate Credit Card", "Enterprise", "CUST-1", "3DS", "OTP", "corporate credit card south success rate plunge " + "x" * 200),
        (2, "FINTECH_90D", "North", "Loan", "Retail", "CUST-2", "FX", "Fee", "entirely different words"),
    ]
    df = spark.createDataFrame(
        rows,
        "ticket_id bigint, dataset_source string, region string, product_name string, customer_tier string, customer_id string, "
        "issue_category string, subject string, message string",
    )
    return embed_tickets(df)


@pytest.fixture(scope="module")
def written(spark, anomalies, seed_metrics, tickets):
    return {r.anomaly_id: r for r in investigate(anomalies, seed_metrics, tickets).collect()}


def test_report_gathers_both_kinds_of_evidence(written):
    report = written[7]
    history = report.evidence_data.sql_history
    assert len(history) == 1 and history[0].row_count == 10 and history[0].error is None
    assert [d.metric_date for d in history[0].data][:2] == [date(2026, 1, 30), date(2026, 1, 29)]
    assert [c.ticket_id for c in report.evidence_data.ticket_citations] == [1]
    assert report.confidence_score >= 0.70 and len(report.root_cause_summary) > 100
    assert "reached **74.0** (Baseline: **98.5**, Deviation: **-24.9%**)" in report.root_cause_summary
    assert '- Citation: "OTP: corporate credit card' in report.root_cause_summary


def test_report_without_evidence(written):
    report = written[8]
    assert report.evidence_data.sql_history[0].row_count == 0 and report.evidence_data.sql_history[0].data == []
    assert report.evidence_data.ticket_citations == []
    assert "- No direct dispute complaints filed." in report.root_cause_summary
    assert report.mitigation_steps.startswith("1. Isolate degraded infrastructure routing channels in Mars.")


def test_investigation_skips_reported_anomalies(spark, anomalies, seed_metrics, tickets):
    done = investigate(anomalies.where("id = 7"), seed_metrics, tickets)
    assert [r.anomaly_id for r in investigate(anomalies, seed_metrics, tickets, done).collect()] == [8]


def test_feed_and_documents(spark, anomalies, seed_metrics, tickets, tmp_path):
    done = investigate(anomalies, seed_metrics, tickets)
    feed = [r.event for r in reports.investigation_events(done, anomalies).where("anomaly_id = 7").orderBy("seq").collect()]
    assert feed == ["anomaly_info", "sql_evidence", "ticket_evidence", "rca_report", "complete"]
    write_documents(reports.report_documents(done, anomalies), str(tmp_path / "docs"))
    text = next((tmp_path / "docs" / "anomaly_id=7").glob("part-*")).read_text(encoding="utf-8")
    assert text.startswith("# Incident 7: success_rate_plunge") and "| 74.00 | 98.50 | -24.87% |" in text and "\n1. (" in text


def test_gateway_predicate(spark):
    rows = [("OPERATIONAL", 0, 0), ("DEGRADED", 0, 0), ("OPERATIONAL", 3, 0), ("OPERATIONAL", 0, 2)]
    df = spark.createDataFrame(rows, "gateway_status string, timeout_504_count int, failed_requests int")
    assert evidence.gateway_degraded(df).count() == 3


def test_gaps_in_the_evidence(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (3, 0), (3, 1)], "metric_rows int, citations int")
    got = [r.lacking for r in evidence.evidence_gaps(df).orderBy("metric_rows", "citations").collect()]
    assert got == ["both", "metrics", "tickets", "none"]


def test_evidence_query_quotes_labels(spark):
    df = spark.createDataFrame([("O'Hare", "P")], "region string, product_name string")
    assert "region = 'O''Hare'" in df.select(evidence_query()).first()[0]


def test_scorecard(spark):
    golden = [
        (1, "card", ["card", "fee", "zzz", "billing"]),
        (2, "none", ["a"]),
        (3, "missing", ["a"]),
    ]
    scenarios = spark.createDataFrame([(i, k) for i, _, k in golden], "anomaly_id bigint, keywords array<string>")
    none = F.array().cast(f"array<{CITATION}>")
    cite = F.array(F.struct(F.lit(1).cast("bigint").alias("ticket_id"), F.lit("c").alias("customer_id"), F.lit("i").alias("issue_category"), F.lit("CARD fee and Billing").alias("complaint_text"), F.lit(0.5).alias("similarity_score")))
    history = F.array(F.struct(F.lit("q").alias("query"), F.lit(None).cast("string").alias("error")))
    base = spark.range(1, 3).select(
        F.col("id").alias("anomaly_id"),
        F.repeat(F.lit("x"), F.when(F.col("id") == 1, 101).otherwise(100).cast("int")).alias("root_cause_summary"),
        F.lit(0.94).alias("confidence_score"),
        F.struct(history.alias("sql_history"), F.when(F.col("id") == 1, cite).otherwise(none).alias("ticket_citations")).alias("evidence_data"),
    )
    card = scorecard.scorecard(scenarios, base)
    rows = {r.anomaly_id: r for r in card.collect()}
    assert (rows[1].retrieval_precision, rows[1].overall_status) == (0.75, "PASS")
    assert (rows[2].retrieval_precision, rows[2].overall_status) == (0.5, "WARN")
    assert (rows[3].retrieval_precision, rows[3].overall_status, rows[3].sql_pass) == (0.0, "FAIL", False)
    total = scorecard.scorecard_summary(card.withColumn("elapsed_sec", F.lit(2.0))).first()
    assert (total.scenarios, total.passed, total.pass_rate, total.avg_latency) == (3, 2, 66.7, 2.0)


def test_golden_scenarios_pass(spark, seed_metrics, tickets):
    golden = scorecard.golden_scenarios(spark)
    anomalies = golden.select(F.col("anomaly_id").alias("id"), "*", F.lit("OPEN").alias("status")).drop("keywords", "title")
    complaints = spark.createDataFrame(
        [
            (11, "KAGGLE_CFPB", "West", "Mortgage", "Retail", "C", "Escrow", "Escrow", "mortgage west chargeback dispute spike loan escrow closing interest"),
            (12, "KAGGLE_CFPB", "North", "Other", "Retail", "C", "Other", "Other", "credit card south spike"),
        ],
        "ticket_id bigint, dataset_source string, region string, product_name string, customer_tier string, customer_id string, "
        "issue_category string, subject string, message string",
    )
    found = investigate(anomalies, seed_metrics, embed_tickets(complaints))
    rows = {r.anomaly_id: r for r in scorecard.scorecard(golden, found).collect()}
    assert {r.overall_status for r in rows.values()} == {"PASS"} and len(rows) == 3
    assert (rows[101].citations, rows[101].retrieval_precision) == (1, 1.0)  # within its filters
    assert (rows[102].citations, rows[102].retrieval_precision) == (2, 0.5)  # found by the broad search only
    assert (rows[103].citations, rows[103].retrieval_precision) == (0, 0.5)


def test_investigations_are_stored_once(spark, anomalies, seed_metrics, tickets, tmp_path):
    where = {k: str(tmp_path / k) for k in ("events", "metrics", "tickets", "reports", "status", "docs")}
    anomalies.write.partitionBy("dataset_source").parquet(where["events"])
    append_metrics(seed_metrics, where["metrics"])
    append_tickets(tickets, where["tickets"])

    def run():
        done = investigate_and_persist(
            spark, "FINTECH_90D", where["events"], where["metrics"], where["tickets"], where["reports"], where["status"], where["docs"]
        )
        return sorted(r.anomaly_id for r in done.collect())

    assert run() == [7, 8] and run() == [7, 8]
    assert read_stored(spark, where["reports"], REPORTS).count() == 2
    log = read_stored(spark, where["status"], STATUS_LOG)
    assert log.count() == 4
    assert {r.status for r in current_status(anomalies, log).collect()} == {"RESOLVED"}
    assert len(list((tmp_path / "docs").glob("anomaly_id=*/part-*"))) == 2
    clear_table(spark, where["reports"], REPORTS)
    assert read_stored(spark, where["reports"], REPORTS).count() == 0


def test_json_in_prose(spark):
    texts = ['```json\n{"a": 1}\n```', '```\n{"a": 2}```', 'Sure: {"a": 3} done', '{"a": 4}', "no json", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(F.try_variant_get(parsed_json(F.col("t")), "$.a", "int")).collect()]
    assert got == [1, 2, 3, 4, None, None]


def test_text_helpers(spark):
    assert spark.sql("SELECT map('a', 1) m").select(text_object(F.col("m"))).first()[0] == '{"a":1}'
    df = spark.sql("SELECT array('a','b') l, CAST(array() AS array<string>) e, array(map('k','v','x','y')) m, '' s, 1.25D p, -0.04D n, 12345678.5D big, 0.0001D small, 74.0D plain")
    row = df.select(
        text_lines(F.col("l")), text_lines(F.col("e"), "none"), text_pairs(F.col("m")), text_or_default(F.col("s"), "d"),
        signed_percent(F.col("p")), number_text(F.col("big")), number_text(F.col("small")), number_text(F.col("plain")),
    ).first()
    assert tuple(row) == ("a\nb", "none", "k: v; x: y", "d", "+1.3%", "12345678.5", "0.0001", "74.0")


def test_replacing_one_dataset_keeps_the_others(spark, seed_metrics, tmp_path):
    path = str(tmp_path / "m")
    append_metrics(seed_metrics, path)
    replace_dataset(seed_metrics.where("dataset_source = 'KAGGLE_CFPB'").limit(4), path)
    counts = dict(map(tuple, read_stored(spark, path, DAILY_METRICS).groupBy("dataset_source").count().collect()))
    assert counts == {"FINTECH_90D": 30, "KAGGLE_CFPB": 4}


def test_incremental_scan_equals_scans_of_all_metrics_after_each_arrival(spark, tmp_path):
    rng = np.random.default_rng(2)

    def row(i, segment, noise):
        bad = i in (5, 19)
        return metric_row("D", date(2026, 1, 1) + timedelta(days=i), segment, 100.0 + noise, 10, 60.0 if bad else 99.0 - noise, 700.0 + 300 * noise, 0.9 + noise)

    def rows(days, segments):
        return [row(i, s, float(rng.random())) for i in days for s in segments]

    a, b = ("R", "P", "T"), ("R2", "P", "T")
    # late days, a day that comes again with other values, a slice that starts later, another dataset
    other = [metric_row("X", date(2026, 1, 1), a, 1.0, 1, 1.0, 9000.0, 9.0)] * 5
    arrivals = [rows(range(0, 10), [a]), rows(range(14, 30), [a, b]) + other, rows([*range(10, 14), 3, 20], [a]), rows(range(5, 8), [b])]
    where = {k: str(tmp_path / k) for k in ("in", "m", "e", "state")}
    seen, want = [], {}
    for part in arrivals:
        frame = spark.createDataFrame(part, DAILY_METRICS)
        frame.coalesce(2).write.mode("append").parquet(where["in"])
        incremental_scan(spark, where["in"], where["m"], where["e"], where["state"], "D").awaitTermination()
        seen += [r for r in part if r[0] == "D"]
        everything = spark.createDataFrame(seen, DAILY_METRICS)
        for event in signals_to_events(scan_metrics(everything), "D").collect():
            want.setdefault(event.id, event.asDict())
        got = {e.id: e.asDict() for e in read_stored(spark, where["e"], ANOMALY_EVENTS).collect()}
        assert got == want and want
    assert read_stored(spark, where["m"], DAILY_METRICS).count() == len(seen)
    incremental_scan(spark, where["in"], where["m"], where["e"], where["state"], "D").awaitTermination()
    assert read_stored(spark, where["e"], ANOMALY_EVENTS).count() == len(want)


def test_evidence_queries_run_and_a_broken_one_fails_alone(spark, anomalies, seed_metrics):
    tables = {"daily_spend_metrics": seed_metrics, "dispute_support_tickets": spark.createDataFrame([], TICKETS)}
    more = [
        evidence_runs.Template("missing", "SELECT id AS anomaly_id, nothing FROM anomalies"),
        evidence_runs.Template("fails_while_running", "SELECT id AS anomaly_id, CAST(concat(region, 'x') AS INT) AS n FROM anomalies"),
        evidence_runs.Template("refused", "DELETE FROM anomalies"),
        evidence_runs.Template("foreign", "SELECT id AS anomaly_id FROM anomalies, stranger"),
        evidence_runs.Template("without_id", "SELECT region FROM anomalies"),
    ]
    spark.range(1).createOrReplaceTempView("stranger")
    runs = evidence_runs.evidence_runs(anomalies, tables, [*evidence_runs.TEMPLATES, *more]).collect()
    by_name = {(r.anomaly_id, r.template): r for r in runs}
    week = by_name[7, "week_before"]
    assert week.row_count == 7 == len(week.rows) and week.error is None and '"metric_date":"2026-01-30"' in week.rows[-1]
    assert by_name[8, "week_before"].row_count == 0 and by_name[8, "week_before"].rows == []
    assert all(by_name[i, t.name].error and by_name[i, t.name].row_count == 0 for i in (7, 8) for t in more)
    sound = spark.createDataFrame([r for r in runs if r.error is None], evidence_runs.RUNS)
    scores = {r.anomaly_id: (r.sql_queries, r.sql_pass, r.rows_found, r.confidence) for r in evidence_runs.run_scores(sound).collect()}
    assert scores == {7: (2, True, 7, 0.72), 8: (2, True, 0, 0.5)}
    assert not any(r.sql_pass for r in evidence_runs.run_scores(spark.createDataFrame(runs, evidence_runs.RUNS)).collect())


def test_documents_in_batches_are_found_by_their_place(spark, tmp_path):
    path = str(tmp_path / "docs")
    assert read_documents(spark, path).collect() == [] and read_document(spark, path, 1) is None
    texts = {i: f"# Incident {i}\n\n" + "\u00e9\U0001f600\n\n" * (i % 7) for i in range(200)} | {200: "", 201: None}
    df = spark.createDataFrame(list(texts.items()), "anomaly_id bigint, document string")
    for batch, part in (("a", df.where("anomaly_id < 90")), ("b", df.where("anomaly_id >= 90")), ("empty", df.where("false"))):
        write_document_batch(part, path, batch)
    write_document_batch(df.where("anomaly_id < 100"), path, "a")  # a batch takes the place of an earlier one of its name
    write_document_batch(df.where("anomaly_id >= 100"), path, "b")
    want = {i: t or "" for i, t in texts.items()}
    got = read_documents(spark, path).collect()
    assert len(got) == len(want) and dict(map(tuple, got)) == want
    assert [read_document(spark, path, i) for i in (0, 13, 199, 200, 999)] == [want[0], want[13], want[199], "", None]
    # text without an index entry is what a broken run leaves
    (tmp_path / "docs" / "text" / "batch=c" / "part=0").mkdir(parents=True)
    (tmp_path / "docs" / "text" / "batch=c" / "part=0" / "part-0.txt").write_text("broken", encoding="utf-8")
    assert read_documents(spark, path).count() == len(want)
    with pytest.raises(ValueError):
        write_document_batch(df, path, "a/b")


def test_an_upload_is_stored_once(spark, tmp_path, monkeypatch):
    where = {k: str(tmp_path / k) for k in ("metrics", "tickets", "manifest")}
    text = "event_date,region,amount,comment\n" + "".join(f"2026-01-0{1 + i % 3},r{i % 2},{i}.5,comment number {i}\n" for i in range(9))
    (tmp_path / "u.csv").write_text(text)
    (tmp_path / "v.csv").write_text(text + "2026-01-04,r0,1.5,one more\n")

    def ingest(name):
        ingest_file(spark, str(tmp_path / name), where["metrics"], where["tickets"], date(2026, 3, 1), manifest_path=where["manifest"])
        return tuple(read_committed(spark, where[t], where["manifest"], s).count() for t, s in (("metrics", DAILY_METRICS), ("tickets", TICKETS)))

    assert ingest("u.csv") == (6, 9) and ingest("u.csv") == (6, 9)
    with monkeypatch.context() as broken:
        broken.setattr("pulseward.plans.store.append_rows", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest("v.csv")
    assert ingest("u.csv") == (6, 9) and ingest("v.csv") == (13, 19)
    # of two attempts that were committed at once the first by name counts; rows appended plainly always do
    spark.createDataFrame([(r.upload, "zzz") for r in read_stored(spark, where["manifest"], MANIFEST).collect()], MANIFEST).write.mode("append").parquet(where["manifest"])
    append_metrics(read_committed(spark, where["metrics"], where["manifest"], DAILY_METRICS).limit(1), where["metrics"])
    assert ingest("v.csv") == (14, 19)


def test_upload_keys_follow_the_rows(spark):
    rows = [(1, "a"), (2, None), (2, None)]
    key = lambda r: upload_key(spark.createDataFrame(r, "n int, t string"), "x")
    assert key(rows) == key(rows[::-1])
    assert len({key(rows), key(rows[:2]), key([(1, None), (2, "a"), (2, None)]), key([]), key([(1, "a"), (2, ""), (2, None)])}) == 5
