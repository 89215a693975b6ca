from __future__ import annotations

import os
import sys
from datetime import date, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pulseward.schemas import DAILY_METRICS  # noqa: E402
from pulseward.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


def metric_row(source, day, segment, spend, tx, success, latency, chargeback, fraud=5.0):
    region, product, tier = segment
    return (source, day, region, product, tier, "General", float(spend), tx, spend / tx, success, latency, chargeback, fraud)


SOUTH = ("South", "Corporate Credit Card", "Enterprise")


@pytest.fixture(scope="session")
def seed_metrics(spark):
    """Thirty days that end in an outage, and ten flat days of another dataset."""
    rows = []
    for i in range(30):
        bad = i == 29
        rows.append(
            metric_row(
                "FINTECH_90D",
                date(2026, 1, 1) + timedelta(days=i),
                SOUTH,
                250000.0 if bad else 500000.0,
                1000,
                74.0 if bad else 99.0,
                1800.0 if bad else 250.0,
                3.5 if bad else 0.1,
            )
        )
    for i in range(10):
        rows.append(
            metric_row(
                "KAGGLE_CFPB",
                date(2015, 3, 1) + timedelta(days=i),
                ("National", "Credit card or prepaid card", "General"),
                100000.0,
                50,
                90.0,
                100.0,
                1.0,
                10.0,
            )
        )
    return spark.createDataFrame(rows, DAILY_METRICS).cache()
