"""Alert rules of the detector as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseward.functions.numeric import round_stable

CRITICAL, HIGH, MEDIUM, LOW = "CRITICAL", "HIGH", "MEDIUM", "LOW"
SEVERITY_WEIGHT = {CRITICAL: 4, HIGH: 3, MEDIUM: 2, LOW: 1}


@dataclass(frozen=True)
class AlertRule:
    """When one metric of one day counts as an anomaly.

    ``hard`` fires alone, ``scored`` needs the z threshold too, ``isolated``
    needs the isolation forest to agree. ``rising`` tells which side is bad.
    """

    name: str
    metric: str
    rising: bool
    hard: float
    scored: float
    isolated: float
    critical: float
    critical_z: float | None
    flat_deviation: float
    drop_from_expected: float | None = None

    def _beyond(self, column: Column, limit: float) -> Column:
        return column >= limit if self.rising else column <= limit

    def fires(self, z_threshold: float, isolated: Column) -> Column:
        value, z = F.col(self.metric), F.col(f"z_{self.metric}")
        far_off = self._beyond(value, self.scored)
        if self.drop_from_expected is not None:
            far_off = far_off | (value <= F.col(f"expected_{self.metric}") - self.drop_from_expected)
        return (
            self._beyond(value, self.hard)
            | (self._beyond(z, z_threshold if self.rising else -z_threshold) & far_off)
            | (isolated & self._beyond(value, self.isolated))
        )

    def severity(self) -> Column:
        worst = self._beyond(F.col(self.metric), self.critical)
        if self.critical_z is not None:
            worst = worst | self._beyond(F.col(f"z_{self.metric}"), self.critical_z)
        return F.when(worst, CRITICAL).otherwise(HIGH)

    def signal(self, z_threshold: float, isolated: Column) -> Column:
        value, expected = F.col(self.metric), F.col(f"expected_{self.metric}")
        deviation = F.when(expected > 0, F.try_divide(value - expected, expected) * 100.0).otherwise(
            F.lit(self.flat_deviation)
        )
        return F.struct(
            F.coalesce(self.fires(z_threshold, isolated), F.lit(False)).alias("fired"),
            F.lit(self.name).alias("metric_name"),
            value.alias("actual_value"),
            round_stable(expected, 2).alias("expected_value"),
            round_stable(deviation, 2).alias("deviation_pct"),
            round_stable(F.col(f"z_{self.metric}"), 2).alias("z_score"),
            self.severity().alias("severity"),
        )


# Fixed values of the detector: metric, limits and severities of the three rules.
ALERT_RULES = [
    AlertRule(
        name="success_rate_plunge",
        metric="success_rate_pct",
        rising=False,
        hard=85.0,
        scored=95.0,
        isolated=92.0,
        critical=80.0,
        critical_z=-3.5,
        flat_deviation=-50.0,
        drop_from_expected=2.0,
    ),
    AlertRule(
        name="avg_latency_surge",
        metric="avg_latency_ms",
        rising=True,
        hard=1500.0,
        scored=500.0,
        isolated=800.0,
        critical=2000.0,
        critical_z=4.0,
        flat_deviation=100.0,
    ),
    AlertRule(
        name="chargeback_dispute_spike",
        metric="chargeback_rate_pct",
        rising=True,
        hard=2.0,
        scored=1.0,
        isolated=1.5,
        critical=5.0,
        critical_z=None,
        flat_deviation=200.0,
    ),
]


def severity_weight(severity: Column) -> Column:
    weight = F.lit(0)
    for name, value in SEVERITY_WEIGHT.items():
        weight = F.when(severity == name, F.lit(value)).otherwise(weight)
    return weight
