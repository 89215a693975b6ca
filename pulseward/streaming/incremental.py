"""Metric files as they arrive: a stateful stream keeps every slice's days, scans the slices a batch touches, and adds new events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from pulseward.operators.events import absent_events, signals_to_events
from pulseward.operators.series import preference
from pulseward.operators.signals import DetectorSettings, scan_metrics
from pulseward.plans.store import PARTITION, read_stored
from pulseward.schemas import ANOMALY_EVENTS, DAILY_METRICS, SLICE_COLUMNS
from pulseward.session import staged

def history_keeper(schema: StructType):
    """The function of the stateful step for rows of ``schema``."""
    order = preference([c for c in schema.names if c not in (*SLICE_COLUMNS, "metric_date")], schema)
    arrow = to_arrow_schema(schema)

    def packed(days: pd.DataFrame) -> bytes:
        table = pa.Table.from_pandas(days, schema=arrow, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        return sink.getvalue().to_pybytes()

    def one_per_day(rows: pd.DataFrame) -> pd.DataFrame:
        """The row of each day that ``dedupe_slices`` keeps."""
        dated = rows[rows["metric_date"].notna()]
        return dated.sort_values(["metric_date", *order], na_position="first", kind="stable").drop_duplicates("metric_date")

    def remember(key: tuple, arrived: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """One slice of a batch: passes on what arrived, marked ``fresh``, and the days known before it; the state keeps one row a day.

        A day that arrives late takes its place in the history like any other.
        """
        before = pa.ipc.open_stream(state.get[0]).read_all().to_pandas() if state.exists else None
        known = before
        for part in arrived:
            yield part.assign(fresh=True)
            known = one_per_day(part if known is None else pd.concat([known, part], ignore_index=True))
        if before is not None:
            yield before.assign(fresh=False)
        state.update((packed(known),))

    return remember


def touched_slices(arriving: DataFrame) -> DataFrame:
    """The slices a batch touches with all their days, from the batch and the state only."""
    keep = history_keeper(arriving.schema)
    return arriving.groupBy(*SLICE_COLUMNS).applyInPandasWithState(
        keep, f"{DAILY_METRICS}, fresh boolean", "days binary", "append", GroupStateTimeout.NoTimeout
    )


def incremental_scan(
    spark: SparkSession,
    arrivals_path: str,
    metrics_path: str,
    events_path: str,
    checkpoint_path: str,
    dataset_source: str,
    settings: DetectorSettings = DetectorSettings(),
) -> StreamingQuery:
    """Start the stream over the files there are and stop when all are processed.

    The events are those that scans of all metrics after each arrival would add, forest included. The history of a slice comes from
    the stream's state, at most one row per calendar day; stored metrics are written and not read. A batch overwrites
    the folder named by its number and events are inserted by key, so a batch that is run again changes nothing.
    """

    def process(batch: DataFrame, number: int) -> None:
        rows = staged(batch, "arrived")  # the state is read once
        rows.where("fresh").drop("fresh").write.mode("overwrite").parquet(f"{metrics_path}/batch={number}")
        events = signals_to_events(scan_metrics(rows.drop("fresh"), settings), dataset_source)
        existing = read_stored(spark, events_path, ANOMALY_EVENTS).where(F.col(PARTITION) == dataset_source)
        absent_events(events, existing).select(*existing.columns).write.mode("append").partitionBy(PARTITION).parquet(events_path)

    arriving = spark.readStream.schema(DAILY_METRICS).parquet(arrivals_path).where(F.col(PARTITION) == dataset_source)
    return (
        touched_slices(arriving)
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
