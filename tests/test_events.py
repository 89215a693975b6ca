from datetime import datetime

import pytest

from pulseward.operators import events
from pulseward.operators.signals import scan_metrics
from pulseward.plans.detect import scan_and_persist
from pulseward.plans.store import append_metrics, read_stored, scan_partition
from pulseward.schemas import ANOMALY_EVENTS, DAILY_METRICS


def event(i, severity="HIGH", status="OPEN", region="South", day=1, source="D", tier="Retail"):
    return (i, source, datetime(2026, 1, day), "success_rate_plunge", region, "Card", tier, 74.0, 98.5, -24.87, -20.4, severity, status)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), ANOMALY_EVENTS)


def test_second_scan_adds_nothing(spark, seed_metrics, tmp_path):
    metrics, stored = str(tmp_path / "metrics"), str(tmp_path / "events")
    append_metrics(seed_metrics, metrics)
    first = scan_and_persist(spark, metrics, stored, "FINTECH_90D").collect()
    second = scan_and_persist(spark, metrics, stored, "FINTECH_90D").collect()
    assert len(first) >= 3 and first == second
    assert {r.detected_at for r in first} == {datetime(2026, 1, 30)}
    assert scan_and_persist(spark, metrics, stored, "KAGGLE_CFPB").count() == 0
    assert read_stored(spark, stored, ANOMALY_EVENTS).count() == len(first)
    days = [r.metric_date for r in scan_partition(read_stored(spark, metrics, DAILY_METRICS), "KAGGLE_CFPB").collect()]
    assert len(days) == 10 and days == sorted(days)


def test_insert_compares_null_tiers(spark):
    old = table(spark, event(1, tier=None))
    new = table(spark, event(2, tier=None), event(3, tier="Retail"), event(4, tier="Retail"))
    assert events.insert_if_absent(new, old).count() == 2


def test_ids_are_reproducible_and_distinct(spark, seed_metrics):
    found = events.signals_to_events(scan_metrics(seed_metrics.where("dataset_source = 'FINTECH_90D'")), "FINTECH_90D")
    a = {r.id for r in found.collect()}
    b = {r.id for r in found.repartition(5).collect()}
    assert a == b and len(a) == found.count()


def test_feed_pages_and_filters(spark):
    rows = table(spark, *[event(i, day=1 + i % 3, severity="CRITICAL" if i % 2 else "HIGH") for i in range(1, 11)])
    mine = events.filter_events(rows, "D", status="OPEN", severity="CRITICAL", region="South")
    page = events.anomaly_feed(mine, limit=2, offset=1).collect()
    want = sorted([(r.detected_at, r.id) for r in mine.collect()], reverse=True)[1:3]
    assert [(r.detected_at, r.id) for r in page] == want
    with pytest.raises(ValueError):
        events.anomaly_feed(mine, limit=201)


def test_next_open_takes_the_worst(spark):
    rows = table(spark, event(1, "MEDIUM", day=9), event(2, "CRITICAL"), event(3, "CRITICAL", "RESOLVED", day=9), event(4, "HIGH"))
    assert events.next_open(rows).first().id == 2


def test_status_follows_its_log(spark):
    rows = table(spark, event(1), event(2))
    log = events.transitions_for(rows.where("id = 2"))
    assert {r.id: r.status for r in events.current_status(rows, log).collect()} == {1: "OPEN", 2: "RESOLVED"}


def test_reports_stay_unique_and_follow_their_event(spark):
    schema = "anomaly_id bigint, note string"
    stored = spark.createDataFrame([(1, "first")], schema)
    offered = spark.createDataFrame([(1, "again"), (2, "new"), (2, "new")], schema)
    after = events.insert_reports(offered, stored)
    assert sorted(map(tuple, after.collect())) == [(1, "first"), (2, "new")]
    assert events.cascade_reports(after, table(spark, event(2))).count() == 1
    assert [r.id for r in events.pending(table(spark, event(1), event(3)), after).collect()] == [3]


def test_sorts_and_search(spark):
    rows = table(spark, event(1, "HIGH", region="North"), event(2, "CRITICAL", day=2), event(3, "LOW", day=3))
    reports = spark.createDataFrame(
        [(1, "Gateway FAILED", 0.95, "fix")], "anomaly_id bigint, root_cause_summary string, confidence_score double, mitigation_steps string"
    )
    joined = events.with_report(rows, reports)
    order = lambda mode: [r.id for r in events.sorted_feed(joined, mode).collect()]
    assert order("severity") == [2, 1, 3] and order("date") == [3, 2, 1] and order("confidence") == [1, 3, 2]
    assert [r.id for r in events.search_feed(joined, "gateway failed").collect()] == [1]
    assert events.search_feed(joined, "SOUTH").count() == 2
    assert events.search_feed(joined, "", "LOW").count() == 1
    assert tuple(events.severity_summary(rows).first()) == (1, 2)


def test_insert_is_an_anti_join(spark):
    plan = events.absent_events(table(spark, event(1)), table(spark, event(2)))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan
