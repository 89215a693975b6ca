"""Records of large text files whose separators may stand inside quotes, read in byte ranges.

Spark's text source cuts a file into byte ranges and each of them at a separator, in order. Whether a piece starts inside a
quoted field or a nested value is known only from all that comes before it, so there are two passes. The first follows every
range from both possible beginnings, outside and inside quotes, and keeps the two outcomes; composed along the file, they give
the state in which each range really begins. The second then cuts every range into records on its own. A record that
runs over the end of a range comes in fragments, which are few and are put together by a grouping.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseward.session import scratch_path

# Records a task hands over at a time.
BATCH_RECORDS = 4096


@dataclass(frozen=True)
class State:
    """Whether a place is inside quotes, and how deep it is nested."""

    quoted: bool = False
    depth: int = 0

    @property
    def ends_record(self) -> bool:
        return not self.quoted and self.depth <= 1


class CsvLines:
    """Lines of CSV. A quote opens a field only at its start and stands for itself when doubled."""

    separator, closing = "\n", ""
    _close = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')

    def __init__(self, delimiter: str = ","):
        self.delimiter, self.opening = delimiter, f'{delimiter}"'

    def after(self, state: State, piece: str) -> State:
        at, inside = 0, state.quoted
        while True:
            if not inside and not piece.startswith('"', at):
                at = piece.find(self.opening, at) + 1
                if not at:
                    return State()
            close = self._close.match(piece, at if inside else at + 1)
            if not close:
                return State(True)
            # What follows a closing quote up to the delimiter is part of the field.
            at, inside = piece.find(self.delimiter, close.end()) + 1, False
            if not at:
                return State()


class JsonBraces:
    """Pieces of JSON up to a closing brace; a record of a top-level array ends with the brace that leads back into the array."""

    separator, closing = "}", "}"
    _marks = re.compile(r'[{\[\]]|"(?:[^"\\]|\\.)*"?', re.S)
    _close = re.compile(r'(?:[^"\\]|\\.)*"', re.S)

    def after(self, state: State, piece: str) -> State:
        at, depth = 0, state.depth
        if state.quoted:
            close = self._close.match(piece)
            if not close:
                return state
            at = close.end()
        for mark in self._marks.finditer(piece, at):
            if mark[0] in "{[":
                depth += 1
            elif mark[0] == "]":
                depth -= 1
            elif not self._close.fullmatch(mark[0], 1):
                return State(True, depth)
        return State(False, depth - 1)  # the brace that ends the piece


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """The pieces of all files in their order, with their file and the start of their range."""
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), "value"
    )


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        for file, start, value in zip(*[c.to_pylist() for c in batch.columns]):
            yield (file, start), value


def range_starts(pieces: DataFrame, rules: CsvLines | JsonBraces) -> dict[tuple[str, int], tuple[State, int]]:
    """The state in which each range begins, and the range in which the record that is open there began.

    One entry per byte range is held, never a record.
    """
    outcome = "file string, range long, quoted array<boolean>, depth array<long>, lowest array<long>"

    def follow(batches):
        key, states, lowest = None, [], []

        def summary():
            return pa.RecordBatch.from_pydict(
                {
                    "file": [key[0]], "range": pa.array([key[1]], pa.int64()), "quoted": [[s.quoted for s in states]],
                    "depth": [[s.depth for s in states]], "lowest": pa.array([lowest], pa.list_(pa.int64())),
                }
            )

        for where, value in _located(batches):
            if where != key:
                if key is not None:
                    yield summary()
                key, states, lowest = where, [State(), State(True)], [None, None]
            for i, state in enumerate(states):
                states[i] = state = rules.after(state, value)
                if not state.quoted:
                    lowest[i] = state.depth if lowest[i] is None else min(lowest[i], state.depth)
        if key is not None:
            yield summary()

    starts, file = {}, None
    for row in pieces.mapInArrow(follow, outcome).orderBy("file", "range").toLocalIterator():
        if row["file"] != file:
            file, state, origin = row["file"], State(), row["range"]
        elif state.ends_record:
            origin = row["range"]
        starts[file, row["range"]] = state, origin
        i = int(state.quoted)
        if row["lowest"][i] is not None and state.depth + row["lowest"][i] <= 1:
            origin = row["range"]  # a record ended here, so the one left open began here
        state = State(row["quoted"][i], state.depth + row["depth"][i])
    return starts


def records(spark: SparkSession, path: str, rules: CsvLines | JsonBraces) -> DataFrame:
    """(file, first, record): every record of the files below ``path``; ``first`` marks the one a file begins with."""
    pieces = _pieces(spark, path, rules.separator)
    starts = spark.sparkContext.broadcast(range_starts(pieces, rules))
    schema = "file string, range long, origin long, whole boolean, first boolean, record string"

    def cut(batches):
        key, state, held, begun, origin, rows = None, State(), [], True, 0, []

        def fragment(ended: bool):
            """What is held: a whole record, or a part of the one that began in range ``origin``."""
            text = rules.separator.join(held) + (rules.closing if ended else "")
            rows.append((key[0], key[1], origin, ended and begun, key[1] == 0 and begun and first, text))

        def handed_over():
            names = ["file", "range", "origin", "whole", "first", "record"]
            return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))))

        first = True
        for where, value in _located(batches):
            if where != key:
                if held:
                    fragment(False)
                key, held = where, []
                state, origin = starts.value[key]
                begun, first = state.ends_record or key[1] == 0, True
            held.append(value)
            state = rules.after(state, value)
            if state.ends_record:
                fragment(True)
                held, begun, first, origin = [], True, False, key[1]
            if len(rows) >= BATCH_RECORDS:
                yield handed_over()
                rows.clear()
        if held:
            fragment(False)
        if rows:
            yield handed_over()

    found = pieces.mapInArrow(cut, schema)
    parts = found.where("not whole").groupBy("file", "origin").agg(
        F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("range", "record"))).alias("parts")
    )
    text = F.array_join(F.transform("parts", lambda p: p["record"]), rules.separator)
    return found.where("whole").select("file", "first", "record").unionByName(parts.select("file", "first", text.alias("record")))


def csv_records(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A CSV's columns as text. Quoted fields may hold line breaks, and a file of any size is read by many tasks.

    Every file begins with the same header. Blank lines between records are left out, as Spark's own reader does.
    """
    found = records(spark, path, CsvLines(delimiter)).withColumn("record", F.regexp_replace("record", "\r$", ""))
    heads = found.where("first").select("file", "record").orderBy("file").limit(1).collect()
    if not heads:
        return spark.createDataFrame([], "value string").limit(0)
    names = next(csv.reader([heads[0]["record"].removeprefix("\ufeff")], delimiter=delimiter))
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    options = {"escape": '"', "sep": delimiter, "maxCharsPerColumn": "-1"}
    rows = found.where("not first and record <> ''").select(F.from_csv("record", F.lit(fields), options).alias("r"))
    return rows.select(*[F.col(f"r.c{i}").alias(name) for i, name in enumerate(names)])


def json_lines(spark: SparkSession, path: str) -> str:
    """The records of JSON arrays, one a line, in a folder of the shared directory; an array of any size is read by many tasks."""
    found = records(spark, path, JsonBraces())
    # Between elements stand commas and blanks, before the first the bracket; breaks inside one are blanks, as text holds none.
    element = F.regexp_replace(F.regexp_replace("record", r"^[\s,]*(\[[\s]*)?", ""), r"[\r\n]+", " ")
    lines = found.select(element.alias("value")).where("value <> '' and not value rlike '^\\\\]'")
    target = scratch_path(spark, "json-lines")
    strange = F.raise_error(F.concat(F.lit("not a record of a JSON array: "), F.substring("value", 1, 40)))
    lines.select(F.when(F.startswith("value", F.lit("{")), F.col("value")).otherwise(strange).alias("value")).write.text(target)
    return target
