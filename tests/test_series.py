from datetime import date, timedelta

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pulseward.operators.series import calendar_fill, dedupe_slices, rolling_baseline, rolling_zscore

SCHEMA = (
    "region string, product_name string, customer_tier string, metric_date date, merchant_category string, "
    "daily_spend_amount double, transaction_count bigint, success_rate_pct double, avg_latency_ms double, "
    "chargeback_rate_pct double, avg_fraud_risk_score double"
)


def frame(spark, days):
    """(offset, category, success) triples of one slice."""
    rows = [
        ("R", "P", "T", date(2026, 1, 1) + timedelta(days=o), cat, 10.0, 2, success, 100.0, 0.1, 5.0)
        for o, cat, success in days
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_dedupe_keeps_one_row_per_day_and_drops_null_keys(spark):
    rows = [
        ("R", "P", "T", date(2026, 1, 1), "b", 1.0, 1, 1.0, 1.0, 1.0, 1.0),
        ("R", "P", "T", date(2026, 1, 1), "a", 2.0, 1, 2.0, 1.0, 1.0, 1.0),
        (None, "P", "T", date(2026, 1, 1), "a", 3.0, 1, 2.0, 1.0, 1.0, 1.0),
    ]
    kept = dedupe_slices(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.merchant_category, r.daily_spend_amount) for r in kept] == [("a", 2.0)]


def test_dedupe_prefers_the_smallest_id(spark):
    df = spark.createDataFrame(
        [("R", "P", "T", date(2026, 1, 1), 9, "a"), ("R", "P", "T", date(2026, 1, 1), 3, "z")],
        "region string, product_name string, customer_tier string, metric_date date, id bigint, merchant_category string",
    )
    assert [r.id for r in dedupe_slices(df).collect()] == [3]


def test_fill_carries_rates_and_zeroes_volumes(spark):
    filled = calendar_fill(dedupe_slices(frame(spark, [(0, "a", None), (1, "a", 90.0), (4, "a", 80.0)])))
    rows = [tuple(r) for r in filled.orderBy("metric_date").select("success_rate_pct", "transaction_count", "is_observed").collect()]
    assert rows == [(90.0, 2.0, True), (90.0, 2.0, True), (90.0, 0.0, False), (90.0, 0.0, False), (80.0, 2.0, True)]


def test_short_slices_are_left_out(spark):
    assert calendar_fill(dedupe_slices(frame(spark, [(0, "a", 1.0), (5, "a", 2.0)]))).isEmpty()


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.integers(0, 40), st.one_of(st.none(), st.floats(0, 100).map(lambda v: round(v, 3)))),
        min_size=3,
        max_size=25,
        unique_by=lambda t: t[0],
    ),
    st.integers(3, 14),
)
def test_zscores_agree_with_pandas(spark, days, window):
    got = (
        rolling_zscore(rolling_baseline(calendar_fill(dedupe_slices(frame(spark, [(o, "a", s) for o, s in days]))), window))
        .orderBy("metric_date")
        .toPandas()
    )
    series = pd.Series({date(2026, 1, 1) + timedelta(days=o): s for o, s in days}, dtype=float).sort_index()
    calendar = pd.date_range(series.index.min(), series.index.max(), freq="D").date
    series = series.reindex(calendar).ffill().bfill()
    width = min(window, len(series))
    mean = series.rolling(width, min_periods=min(3, len(series))).mean()
    sd = series.rolling(width, min_periods=min(3, len(series))).std()
    sd = sd.where(sd > 1e-6, 0.05)
    z = ((series - mean) / sd).fillna(0)
    assert list(got.metric_date) == list(calendar)
    np.testing.assert_allclose(got.z_success_rate_pct.astype(float).fillna(0), z, atol=1e-5)


def test_result_does_not_depend_on_row_order_or_partitions(spark):
    days = [(o, c, float(50 + (o * 7) % 13)) for o in (0, 1, 2, 5, 9, 14) for c in ("a", "b")]
    one = frame(spark, days).coalesce(1)
    other = frame(spark, list(reversed(days))).repartition(7)
    results = [
        sorted(map(tuple, rolling_zscore(rolling_baseline(calendar_fill(dedupe_slices(df)), 7)).collect())) for df in (one, other)
    ]
    assert results[0] == results[1]


def test_one_exchange_serves_all_windows(spark):
    plan = rolling_zscore(rolling_baseline(calendar_fill(frame(spark, [(0, "a", 1.0)]))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
