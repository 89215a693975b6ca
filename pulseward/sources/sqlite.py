"""SQLite files as a Spark data source, in ranges of pages; columns, conditions and limits are planned into the file."""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SQLITE_SUFFIXES = (".sqlite", ".db", ".sqlite3")
BYTES_PER_PARTITION = 32 << 20
BATCH_ROWS = 10_000
MAX_PARTITIONS = 10_000

# Fixed values of the file format: page kinds, and where their fields stand.
INTERIOR, LEAF = 5, 13
FILE_HEADER, PAGE_HEADER = 100, 12


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _spark_type(declared: str | None) -> T.DataType:
    kind = (declared or "").upper()
    if "INT" in kind:
        return T.LongType()
    if any(w in kind for w in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return T.DoubleType()
    return T.StringType()


#: By Spark type: the conversion of one value, the Arrow type, the Python type it takes as it is, and SQLite's names of that.
_KINDS = {
    T.LongType: (int, pa.int64(), int, ("integer",)),
    T.DoubleType: (float, pa.float64(), float, ("real", "integer")),
    T.StringType: (str, pa.string(), bytes, ("text",)),
}


def _converted(value, cast):
    """SQLite keeps any value in any column; what does not fit the declared type reads as null."""
    try:
        if value is None or cast is int and isinstance(value, float) and not value.is_integer():
            return None
        cast_value = cast(value.decode("utf-8") if isinstance(value, bytes) else value)
    except (TypeError, ValueError):
        return None
    return None if cast is int and not -(2**63) <= cast_value < 2**63 else cast_value


def _column(values: tuple, kind: T.DataType) -> pa.Array:
    """A column goes to Arrow as a whole where all its values have the declared type; else value by value."""
    cast, arrow, expected, _ = _KINDS[type(kind)]
    if set(map(type, values)) <= {expected, type(None)}:
        try:
            return pa.array(values, arrow)
        except pa.ArrowInvalid:  # text that is not UTF-8
            pass
    return pa.array([_converted(v, cast) for v in values], arrow)


def _files(path: str) -> list[str]:
    """The file, or all SQLite files of a folder, which then hold parts of one table."""
    if not os.path.isdir(path):
        return [path]
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.lower().endswith(SQLITE_SUFFIXES))


def _varint(page: bytes, at: int) -> int:
    value = 0
    for i in range(9):
        byte = page[at + i]
        if i == 8:
            value = value << 8 | byte
        else:
            value = value << 7 | byte & 127
            if byte < 128:
                break
    return value - (1 << 64) if value >= 1 << 63 else value


def page_bounds(path: str, root: int, wanted: int) -> list[int] | None:
    """About ``wanted`` row ids that part a table into runs of pages, the last id of each run; None if it has no row ids.

    The upper levels of the table's tree are read, down to the first that is wide enough or to the pages of rows. Bounds
    only cut: were they out of date, their ranges would still hold each row once.
    """
    with open(path, "rb") as file:
        page_size = int.from_bytes(file.read(FILE_HEADER)[16:18], "big")
        page_size = 65536 if page_size == 1 else page_size
        level, bounds = [root], []  # pages from left to right, and the last row ids of all but the last
        while len(bounds) < wanted - 1:
            below, keys = [], []
            for i, number in enumerate(level):
                file.seek((number - 1) * page_size)
                page, start = file.read(page_size), FILE_HEADER if number == 1 else 0
                if len(page) == page_size and page[start] == LEAF:
                    return bounds
                if len(page) < page_size or page[start] != INTERIOR:
                    return None
                for slot in range(int.from_bytes(page[start + 3 : start + 5], "big")):
                    at = start + PAGE_HEADER + 2 * slot
                    cell = int.from_bytes(page[at : at + 2], "big")
                    below.append(int.from_bytes(page[cell : cell + 4], "big"))
                    keys.append(_varint(page, cell + 4))
                below.append(int.from_bytes(page[start + 8 : start + 12], "big"))
                keys += bounds[i : i + 1]
            level, bounds = below, keys
    every = max(1, (len(bounds) + 1) // wanted)
    return bounds[every - 1 :: every]


class RowRange(InputPartition):
    """Rows of a file with ``low`` <= row id < ``high``; None is open."""

    def __init__(self, path: str, low: int | None, high: int | None):
        super().__init__((path, low, high))
        self.path, self.low, self.high = path, low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, table: str, options: dict[str, str]):
        self.schema, self.table, self.path = schema, table, options["path"]
        self.rows = int(options["rows_per_partition"]) if "rows_per_partition" in options else None
        self.bytes = int(options.get("bytes_per_partition", BYTES_PER_PARTITION))
        self.longer_than = json.loads(options.get("longer_than", "{}"))
        self.limit = int(options["limit"]) if "limit" in options else None
        self.order_by = options.get("order_by")
        asked = {*self.longer_than, *([self.order_by] if self.order_by else [])}
        if missing := asked - set(schema.names):
            raise ValueError(f"{self.table} has no columns {sorted(missing)}")

    def partitions(self) -> list[InputPartition]:
        return [r for path in _files(self.path) for r in self._ranges(path)] or [RowRange(self.path, 0, 0)]

    def _ranges(self, path: str) -> list[RowRange]:
        name = _quoted(self.table)
        with closing(_connect(path)) as con:
            root = con.execute("SELECT rootpage FROM sqlite_master WHERE name = ?", [self.table]).fetchone()
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {name}").fetchone()
            except sqlite3.OperationalError:  # a table without row ids is read in one piece
                return [RowRange(path, None, None)]
        if low is None:
            return []
        if self.rows:
            step = max(self.rows, -(-(high - low + 1) // MAX_PARTITIONS))
            cuts = list(range(low + step, high + 1, step))
        else:
            wanted = min(MAX_PARTITIONS, -(-os.path.getsize(path) // self.bytes))
            cuts = [bound + 1 for bound in page_bounds(path, root[0], wanted) or []] if root and root[0] and wanted > 1 else []
        return [RowRange(path, a, b) for a, b in zip([None, *cuts], [*cuts, None])]

    def _statement(self, partition: RowRange) -> tuple[str, list]:
        """Rows of a range that meet the conditions; with a limit, no more of them than may be among the first of all.

        Values of another type than declared have no place in SQLite's order that Spark would give them, so all of these come.
        """
        where, values = [], []
        for column, length in self.longer_than.items():
            where.append(f"length(CAST({_quoted(column)} AS TEXT)) > ?")
            values.append(length)
        for bound, sign in ((partition.low, ">="), (partition.high, "<")):
            if bound is not None:
                where.append(f"rowid {sign} ?")
                values.append(bound)
        names = ", ".join(_quoted(f.name) for f in self.schema.fields)
        rows = f"SELECT {names} FROM {_quoted(self.table)} WHERE {' AND '.join(where) or 'true'}"
        if self.limit is None or not self.order_by:
            return rows, values
        key, plain = _quoted(self.order_by), _KINDS[type(self.schema[self.order_by].dataType)][3]
        regular = f"typeof({key}) IN ({', '.join(repr(k) for k in ('null', *plain))})"
        ordered = f"{rows} AND {regular} ORDER BY {key} COLLATE BINARY LIMIT ?"
        return f"SELECT * FROM ({ordered}) UNION ALL {rows} AND NOT {regular}", [*values, self.limit, *values]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        sql, values = self._statement(partition)
        with closing(_connect(partition.path)) as con:
            con.text_factory = bytes  # Arrow decodes whole columns
            cursor = con.execute(sql, values)
            while rows := cursor.fetchmany(BATCH_ROWS):
                columns = [_column(values, f.dataType) for values, f in zip(zip(*rows), self.schema.fields)]
                yield pa.RecordBatch.from_arrays(columns, names=self.schema.names)


class SqliteSource(DataSource):
    """Rows of a table of SQLite files.

    Options: ``path`` of a file, or folder of files, every executor sees; ``table`` (default: first of the file); ``columns``
    as a JSON list, of which those the table has are read; ``longer_than``, a JSON object of columns and the length that their
    text must exceed, counted as SQLite does; ``limit`` with ``order_by``, by which each range hands over only rows that can be
    among the first; ``bytes_per_partition``, or ``rows_per_partition`` for ranges of row ids.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def _table(self) -> str:
        if "table" in self.options:
            return self.options["table"]
        with closing(_connect(_files(self.options["path"])[0])) as con:
            row = con.execute("SELECT name FROM sqlite_master WHERE type = 'table' LIMIT 1").fetchone()
        if row is None:
            raise ValueError(f"no tables in {self.options['path']}")
        return row[0]

    def schema(self) -> T.StructType:
        with closing(_connect(_files(self.options["path"])[0])) as con:
            columns = con.execute(f"PRAGMA table_info({_quoted(self._table())})").fetchall()
        fields = [T.StructField(c[1], _spark_type(c[2])) for c in columns]
        wanted = json.loads(self.options.get("columns", "null"))
        return T.StructType([f for f in fields if wanted is None or f.name in wanted])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(schema, self._table(), dict(self.options))


def read_sqlite(
    spark: SparkSession,
    path: str,
    table: str | None = None,
    columns: list[str] | None = None,
    longer_than: dict[str, int] | None = None,
    limit: int | None = None,
    order_by: str | None = None,
    **options: int,
) -> DataFrame:
    """A table of SQLite files; only the ``columns`` that it has and rows with texts ``longer_than`` given lengths leave the files.

    With ``limit`` the first rows in the order of a column; ``options`` are those of the source.
    """
    if limit is not None and not order_by:
        raise ValueError("a limit needs the column whose order it follows")
    spark.dataSource.register(SqliteSource)
    planned = {
        "table": table,
        "columns": columns if columns is None else json.dumps([*columns, *([order_by] if order_by else []), *(longer_than or {})]),
        "longer_than": longer_than and json.dumps(longer_than),
        "limit": limit,
        "order_by": order_by,
        **options,
    }
    reader = spark.read.format("sqlite_file").options(**{k: str(v) for k, v in planned.items() if v is not None})
    rows = reader.load(path.removeprefix("file://").removeprefix("file:"))
    return rows if limit is None else rows.orderBy(f"`{order_by}`").limit(limit)
