"""Driver tables written out in the formats users upload, for the reader queries."""

from __future__ import annotations

import os
import sqlite3
import uuid
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseward.session import scratch_path

ROWS_PER_FILE = 10_000

# Text that a file of quoted fields holds (in expectation): more than the byte range that a task reads by default.
FILE_BYTES = 256 << 20


def as_text(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            (F.date_format(c, "yyyy-MM-dd HH:mm:ss") if t.startswith("timestamp") else F.col(f"`{c}`")).alias(c)
            for c, t in df.dtypes
        ]
    )


def to_csv(df: DataFrame, suffix: str = "csv") -> str:
    path = f"{scratch_path(df.sparkSession, 'upload')}.{suffix}"
    as_text(df).write.option("header", True).option("escape", '"').csv(path)
    return path


def to_quoted_csv(df: DataFrame) -> str:
    """All fields in quotes, whatever they hold, in one file for every ``FILE_BYTES`` of text; each is written by a task."""
    path = f"{scratch_path(df.sparkSession, 'upload')}.csv"
    text = as_text(df)
    width = reduce(add, [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in text.columns])
    files = max(1, -(-(text.agg(F.sum(width)).first()[0] or 0) // FILE_BYTES))
    writer = text.coalesce(files).write.option("header", True).option("escape", '"').option("quoteAll", True)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def to_json_arrays(df: DataFrame, key: str, suffix: str = "json") -> str:
    """Files of one JSON array each, of a bounded number of records."""
    path = f"{scratch_path(df.sparkSession, 'upload')}.{suffix}"
    files = max(1, -(-df.count() // ROWS_PER_FILE))
    part = F.pmod(F.xxhash64(key), F.lit(files)).alias("part")
    record = F.struct(*as_text(df).columns)
    arrays = as_text(df).groupBy(part).agg(F.to_json(F.collect_list(record)).alias("value"))
    arrays.write.partitionBy("part").text(path)
    return path


def to_json_lines(df: DataFrame) -> str:
    path = f"{scratch_path(df.sparkSession, 'upload')}.json"
    as_text(df).write.json(path)
    return path


def to_sqlite(df: DataFrame, table: str) -> str:
    """A folder of SQLite files, one per partition; needs a folder mounted on every executor."""
    folder = f"{scratch_path(df.sparkSession, 'upload').removeprefix('file://').removeprefix('file:')}.sqlite"
    os.makedirs(folder)
    kinds = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.DoubleType: "REAL"}
    text = as_text(df)
    names = [f'"{c}"' for c in text.columns]
    declared = ", ".join(f"{n} {kinds.get(type(f.dataType), 'TEXT')}" for n, f in zip(names, text.schema.fields))
    insert = f"INSERT INTO {table} VALUES ({', '.join('?' * len(names))})"

    def write(batches):
        import pyarrow as pa

        target = os.path.join(folder, f"{uuid.uuid4().hex}")
        rows = 0
        with sqlite3.connect(target) as con:
            con.execute(f"CREATE TABLE {table} ({declared})")
            for batch in batches:
                con.executemany(insert, zip(*[c.to_pylist() for c in batch.columns]))
                rows += batch.num_rows
        con.close()
        yield pa.RecordBatch.from_pydict({"file": [target], "rows": pa.array([rows], pa.int64())})

    # only the files of finished tasks are named, so a task that ran twice counts once
    for written in text.mapInArrow(write, "file string, rows bigint").collect():
        os.replace(written["file"], f"{written['file']}.sqlite")
    return folder
