import time
from datetime import date, timedelta

import numpy as np
import pytest

from pulseward.functions import isolation
from pulseward.functions.isolation import MODULUS, PICK_FEATURE, PICK_THRESHOLD, TREES, average_path, forest_scores, mix
from pulseward.operators.forest import isolation_forest
from pulseward.operators.signals import DetectorSettings, extract_signals, scan_metrics, score_runs, score_series

COLUMNS = (
    "metric_date date, region string, product_name string, customer_tier string, daily_spend_amount double, "
    "success_rate_pct double, avg_latency_ms double, chargeback_rate_pct double"
)


def test_planted_plunge_is_found(spark):
    rows = [
        (date(2026, 1, 1) + timedelta(days=i), "South", "Card", "Enterprise")
        + ((250000.0, 75.0, 1800.0, 0.1) if i == 25 else (500000.0, 99.0, 250.0, 0.1))
        for i in range(30)
    ]
    found = scan_metrics(spark.createDataFrame(rows, COLUMNS), DetectorSettings(7, 2.0)).collect()
    plunge = [s for s in found if s.metric_name == "success_rate_plunge"]
    assert [s.metric_date for s in plunge] == [date(2026, 1, 26)]
    assert plunge[0].actual_value == 75.0 and plunge[0].z_score < -2 and plunge[0].severity in ("HIGH", "CRITICAL")


def test_gap_is_bridged_and_never_alerts(spark):
    offsets = [0, 1, 2, 10, 11, 12, 13, 14, 15]
    rows = [
        (date(2026, 2, 1) + timedelta(days=o), "West", "Remittance", "Retail", 1000.0)
        + ((60.0, 2500.0, 8.5) if o == 15 else (98.0, 200.0, 0.1))
        for o in offsets
    ]
    found = scan_metrics(spark.createDataFrame(rows, COLUMNS)).orderBy("metric_date").collect()
    assert {s.metric_date for s in found} == {date(2026, 2, 16)}
    assert len(found) == 3 and all(s.severity == "CRITICAL" for s in found)


def test_missing_slice_columns_read_all(spark):
    rows = [(date(2026, 1, 1) + timedelta(days=i), 3000.0 if i == 4 else 100.0) for i in range(5)]
    found = scan_metrics(spark.createDataFrame(rows, "metric_date date, avg_latency_ms double")).collect()
    assert [(s.region, s.product_name, s.customer_tier, s.metric_name) for s in found] == [
        ("ALL", "All", "All", "avg_latency_surge")
    ]
    named = spark.createDataFrame([(d, "x", v) for d, v in rows], "metric_date date, product_name string, avg_latency_ms double")
    assert [(s.region, s.product_name) for s in scan_metrics(named).collect()] == [("All", "x")]


def test_without_fill_windows_count_rows(spark):
    rows = [(date(2026, 1, 1) + timedelta(days=3 * i), 95.5 if i < 9 else 90.0) for i in range(10)]
    df = spark.createDataFrame(rows, "metric_date date, success_rate_pct double")
    found = scan_metrics(df, DetectorSettings(14, 2.5, fill_gaps=False)).collect()
    assert [s.metric_date for s in found] == [rows[-1][0]]


def naive_scores(features, days, seed):
    """The same forest grown node by node."""
    n, width = features.shape
    depth_max = int(np.ceil(np.log2(max(n, 2))))
    total = np.zeros(n)

    def grow(t, node, members, everyone, depth):
        choices = [f for f in range(width) if np.ptp(features[members, f]) > 0]
        if depth == depth_max or not choices:
            total[everyone] += depth + float(average_path(len(members)))
            return
        f = choices[int(mix(seed, t, node, PICK_FEATURE)) * len(choices) // MODULUS]
        lo, hi = features[members, f].min(), features[members, f].max()
        cut = lo + mix(seed, t, node, PICK_THRESHOLD) / MODULUS * (hi - lo)
        cut = lo if cut >= hi else cut
        for side, child in ((features[:, f] <= cut, 2 * node), (features[:, f] > cut, 2 * node + 1)):
            grow(t, child, [m for m in members if side[m]], [e for e in everyone if side[e]], depth + 1)

    for t in range(TREES):
        grow(t, 1, list(range(n)), list(range(n)), 0)
    scores = -np.round(np.power(2.0, -(total / TREES) / float(average_path(n))), 8)
    return np.round(scores - np.percentile(scores, 3.0), 8)


def test_forest_agrees_with_node_by_node_growth():
    rng = np.random.default_rng(7)
    features = np.round(rng.normal(size=(60, 4)), 2)
    features[:, 3] = 1.0
    days = np.arange(60, dtype=np.int64) + 20000
    decision, _ = forest_scores(features, days, 12345, 0.03)
    np.testing.assert_allclose(decision, naive_scores(features, days, 12345), atol=2e-8)


def test_forest_isolates_the_odd_row_in_long_series():
    rng = np.random.default_rng(3)
    features = rng.normal(size=(900, 3))
    features[450] = [12.0, -11.0, 13.0]
    decision, flag = forest_scores(features, np.arange(900, dtype=np.int64), 99, 0.03)
    assert flag[450] and decision.argmin() == 450 and 0 < flag.sum() <= 27


def test_mixer_spreads_evenly():
    draws = mix(np.int64(4711), np.arange(50)[:, None], np.arange(1, 511)[None, :], 1) / MODULUS
    assert abs(draws.mean() - 0.5) < 0.01
    counts = np.histogram(draws, bins=20, range=(0, 1))[0]
    assert counts.min() > 0.85 * draws.size / 20


def test_forest_needs_no_exchange_of_its_own(spark):
    rows = [(date(2026, 1, 1), "S", "C", "E", 1.0, 99.0, 250.0, 0.1)]
    scored = score_series(spark.createDataFrame(rows, COLUMNS))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    # one for the deduplication, one for the windows
    assert plan.count("Exchange") == 2 and "MapInArrow" in plan


def test_forest_scores_slices_that_span_batches(spark):
    rows = [
        (date(2026, 1, 1) + timedelta(days=i), f"R{s}", "C", "E", float(i % 5), 90.0 + (i * s) % 7, 250.0 + i, 0.1)
        for s in range(1, 6)
        for i in range(40)
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    whole = sorted(map(tuple, score_series(df).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, score_series(df).collect())) == whole
        direct = isolation_forest(df.repartition(3)).select("region", "metric_date", "iso_score")
        ours = score_series(df).select("region", "metric_date", "iso_score")
        assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, ours.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_short_slices_are_not_scored(spark):
    rows = [(date(2026, 1, 1) + timedelta(days=i), "R", "P", "T", 1.0, 90.0 if i else 99.0, 900.0, 1.6) for i in range(5)]
    found = scan_metrics(spark.createDataFrame(rows, COLUMNS)).collect()
    assert all(s.isolation_score == 0.0 for s in found)


RUNS = (
    "region string, product_name string, customer_tier string, metric_date date, daily_spend_amount double, success_rate_pct double, "
    "avg_latency_ms double, chargeback_rate_pct double"
)


def sparse_rows(seed, slices, span, share):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(slices):
        for day in range(span):
            if rng.random() < share:
                value = lambda lo, hi: None if rng.random() < 0.1 else float(np.round(rng.uniform(lo, hi), 2))
                rows.append((f"R{i}", "P", "T", date(2020, 1, 1) + timedelta(days=day), value(0, 900), value(70, 100), value(100, 2500), value(0, 6)))
    return rows


@pytest.mark.parametrize("span, share, window, fill", [(60, 0.4, 14, True), (900, 0.15, 14, True), (200, 0.7, 5, True), (120, 0.5, 14, False)])
def test_runs_score_observed_days_as_the_filled_calendar_does(spark, span, share, window, fill):
    df = spark.createDataFrame(sparse_rows(span, 4, span, share) + [("E", "P", "T", date(2020, 1, d), None, None, 5.0, None) for d in (1, 9, 30)], RUNS)
    chosen = DetectorSettings(window_days=window, fill_gaps=fill)
    by_day = score_series(df, chosen).where("is_observed").drop("is_observed")
    by_run = score_runs(df, chosen).select(*by_day.columns)
    key = ["region", "metric_date"]
    a, b = (x.orderBy(*key).toPandas() for x in (by_day, by_run))
    assert len(a) == len(b) > 50 and a[key].equals(b[key]) and a["is_isolated"].equals(b["is_isolated"])
    for c in a.columns.drop(key + ["product_name", "customer_tier", "is_isolated"]):
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), atol=1e-6, err_msg=c)
    signals = lambda scored: {tuple(r) for r in extract_signals(scored).drop("z_score", "isolation_score").collect()}
    assert signals(by_day) == signals(by_run)


def test_a_gap_of_thousands_of_years_is_one_run(spark):
    rows = [("R", "P", "T", d, 10.0, v, 100.0, 0.1) for d, v in ((date(1, 1, 1), 99.0), (date(2024, 1, 1), 98.0), (date(2024, 1, 2), 60.0), (date(9999, 12, 31), 99.0))]
    start = time.perf_counter()
    (plunge,) = scan_metrics(spark.createDataFrame(rows, RUNS)).collect()
    assert plunge.metric_date == date(2024, 1, 2) and time.perf_counter() - start < 60
    plan = scan_metrics(spark.createDataFrame(rows, RUNS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Generate explode(sequence" not in plan


def test_weighted_percentile_and_samples_equal_the_expanded_ones():
    rng = np.random.default_rng(4)
    for n in (5, 40, 300):
        days = np.cumsum(rng.integers(1, 9, n))
        gaps = np.append(np.diff(days) - 1, 0)
        observed = rng.normal(size=(n, 4)).round(1)
        filled = np.where([False, False, False, True], 0.0, observed)
        every = np.arange(days[0], days[-1] + 1)
        run = np.searchsorted(days, every, "right") - 1
        full = np.where((days[run] == every)[:, None], observed[run], filled[run])
        want = isolation.forest_scores(full, every, 77, 0.03)
        got = isolation.run_forest_scores(observed, filled, days, gaps, 77, 0.03)
        seen = days[run] == every
        np.testing.assert_allclose(got[0], want[0][seen], atol=2e-8)
        assert (got[1] == want[1][seen]).all()
