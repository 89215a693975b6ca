"""Readers for uploaded tables: CSV, JSON, Parquet, SQLite, or by suffix."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, DataFrameReader, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseward.operators.complaints import ComplaintExport, mapped_columns, normalize_complaints
from pulseward.operators.inference import iso_times, known_columns, time_by_name
from pulseward.operators.profiles import column_profiles, narrowest_type
from pulseward.session import staged
from pulseward.sources.splits import csv_records, json_lines
from pulseward.sources.sqlite import SQLITE_SUFFIXES, read_sqlite

# Texts a CSV reader takes for a missing value.
MISSING_TEXTS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# Fixed value: shortest narrative the SQLite complaint scan keeps, exclusive.
MIN_NARRATIVE = 10


def missing_to_null(df: DataFrame) -> DataFrame:
    """Null for the missing-value texts and for NaN."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(~c.isin(MISSING_TEXTS), c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def csv_reader(spark: SparkSession, multi_line: bool = True) -> DataFrameReader:
    """Quoted fields may hold line breaks; without ``multi_line`` they may not, and one large file is split over tasks."""
    return spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')


def read_csv(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, multi_line: bool = True
) -> DataFrame:
    """CSV with a header; types are inferred unless a schema is given, which saves a pass over the data.

    A column of numbers and missing-value texts comes out as numbers with nulls.
    """
    reader = csv_reader(spark, multi_line)
    if schema is not None:
        return missing_to_null(reader.schema(schema).csv(path))
    return typed_text(reader.csv(path))


def read_csv_ranges(spark: SparkSession, path: str) -> DataFrame:
    """``read_csv`` of large files: quoted fields may hold line breaks, and a file is still read by many tasks."""
    return typed_text(csv_records(spark, path))


def typed_text(raw: DataFrame) -> DataFrame:
    """Columns of text in the narrowest type that all their values have. Runs one aggregate."""
    text = missing_to_null(raw)
    kinds = column_profiles(text, types=True).orderBy("ordinal").select(narrowest_type(F.col("kinds"), F.col("data_type")))
    return as_types(text, [kind for (kind,) in kinds.collect()])


def as_types(df: DataFrame, kinds: list[str]) -> DataFrame:
    """Each column in the type at its place."""
    kept = [kind == now for kind, (_, now) in zip(kinds, df.dtypes)]
    columns = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*[(c if keep else c.try_cast(kind)).alias(n) for c, keep, kind, n in zip(columns, kept, kinds, df.columns)])


def json_starts(spark: SparkSession, path: str) -> set[str]:
    """The distinct first characters of the files below ``path``, ``[`` for an array; files of blanks only have none.

    Each file is opened for its first characters and not read any further.
    """
    conf = spark._jsc.hadoopConfiguration()
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def start(file: str) -> str | None:
        where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
        codec, stream = codecs.getCodec(where), where.getFileSystem(conf).open(where)
        if codec is not None:
            stream = codec.createInputStream(stream)
        try:
            byte = stream.read()
            while byte in b" \t\r\n\xef\xbb\xbf" if byte >= 0 else False:
                byte = stream.read()
        finally:
            stream.close()
        return None if byte < 0 else chr(byte) if byte in b"[{" else "other"

    with ThreadPoolExecutor(16) as pool:
        return set(pool.map(start, spark.read.text(path).inputFiles())) - {None}


def parsed_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """The values of JSON arrays of records, or of one record a line, in JSON's own types."""
    starts = json_starts(spark, path)
    if len(starts) > 1:
        raise ValueError(f"{path} mixes JSON arrays with records or other text; read them apart")
    # The elements of an array become lines first, so that both kinds split over tasks.
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).json(path if starts == {"{"} else json_lines(spark, path))


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """JSON arrays of records, or one record a line; what is neither is an error. Both are read by many tasks.

    Folder names like ``part=1`` become columns with records a line only.
    Text columns named like a time come out as timestamps where all of them parse.
    """
    df = parsed_json(spark, path, schema)
    return df if schema is not None or not time_by_name(df.columns) else with_times(df, iso_times(known_columns(df)))


def with_times(df: DataFrame, names: list[str]) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.try_to_timestamp(F.col(f"`{name}`")))
    return df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whichever file system it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def kind_of_file(spark: SparkSession, path: str) -> str:
    """``sqlite``, ``csv``, ``json`` or ``parquet`` by suffix; under another one JSON if every file opens a JSON value, else CSV."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no dataset at {path}")
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix in SQLITE_SUFFIXES:
        return "sqlite"
    known = {".csv": "csv", ".txt": "csv", ".json": "json", ".parquet": "parquet"}
    if suffix in known:
        return known[suffix]
    starts = json_starts(spark, path)
    return "json" if starts and "other" not in starts else "csv"


def read_table(spark: SparkSession, path: str, multi_line: bool = True, by_ranges: bool = False) -> DataFrame:
    """Read by suffix; an unknown suffix is read as JSON where all files open a JSON value, else as CSV.

    ``multi_line=False`` says that no quoted CSV field holds a line break, and splits large CSV files over tasks; ``by_ranges``
    splits them whatever their fields hold, at the price of a pass over their quotes.
    """
    kind = kind_of_file(spark, path)
    if kind == "csv":
        return read_csv_ranges(spark, path) if by_ranges else read_csv(spark, path, multi_line=multi_line)
    return {"sqlite": read_sqlite, "json": read_json, "parquet": read_parquet}[kind](spark, path)


def read_profiled(spark: SparkSession, path: str, multi_line: bool = True, by_ranges: bool = False) -> tuple[DataFrame, list[Row]]:
    """``read_table`` together with the profile that roles are inferred from.

    The values are written to the shared folder once, and one aggregate over them serves types, times and roles.
    """
    kind = kind_of_file(spark, path)
    if kind == "csv":
        table = missing_to_null(csv_records(spark, path) if by_ranges else csv_reader(spark, multi_line).csv(path))
    else:
        table = {"sqlite": read_sqlite, "json": parsed_json, "parquet": read_parquet}[kind](spark, path)
    if not table.columns:
        return table, []
    table = staged(table, "upload")
    columns = known_columns(table, types=kind == "csv")
    if kind == "csv":
        table = as_types(table, [c["type"] for c in columns])
    if kind == "json":
        table = with_times(table, iso_times(columns))
    return table, [Row(**c.asDict() | {"type": now}) for c, (_, now) in zip(columns, table.dtypes)]


def read_complaints(
    spark: SparkSession,
    path: str,
    mapping: ComplaintExport,
    max_records: int | None = None,
    order_by: str | None = None,
    filter_has_narrative: bool = True,
    multi_line: bool = True,
    by_ranges: bool = False,
) -> DataFrame:
    """Complaints of a CSV or SQLite export as tickets; ``by_ranges`` reads a large CSV by many tasks.

    The CSV scan reads the mapped columns as text and counts ``max_records``
    after normalisation; the SQLite scan filters on the narrative and counts
    before it.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no dataset at {path}")
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    order_by = order_by or mapping["entity"]
    if suffix == ".csv":
        exported = csv_records(spark, path) if by_ranges else csv_reader(spark, multi_line).csv(path)
        raw = mapped_columns(exported, mapping)
        raw = raw.select(*[F.when(~F.col(f"`{c}`").isin(MISSING_TEXTS), F.col(f"`{c}`")).alias(c) for c in raw.columns])
        tickets = normalize_complaints(raw, mapping, filter_has_narrative)
        if max_records is None:
            return tickets
        return tickets.orderBy("ticket_created_at", "customer_id", "message", "entity_id").limit(max_records)
    if suffix in SQLITE_SUFFIXES:
        narratives = sqlite_narratives(spark, path, mapping, max_records, order_by, filter_has_narrative)
        return normalize_complaints(narratives, mapping, filter_has_narrative=False, null_text="None")
    raise ValueError(f"unsupported file format {suffix}; expected .csv or .sqlite")


def sqlite_narratives(
    spark: SparkSession,
    path: str,
    mapping: ComplaintExport,
    max_records: int | None = None,
    order_by: str | None = None,
    filter_has_narrative: bool = True,
) -> DataFrame:
    """Rows with a narrative longer than ten characters, the first ``max_records`` of them, in the mapped columns.

    Columns, length and limit are applied inside SQLite.
    """
    longer = {mapping["narrative"]: MIN_NARRATIVE} if filter_has_narrative else None
    first = order_by or mapping["entity"] if max_records is not None else None
    columns = list(mapping.roles.values())
    return mapped_columns(
        read_sqlite(spark, path, columns=columns, longer_than=longer, limit=max_records, order_by=first), mapping
    )


def preferred_source(spark: SparkSession, paths: list[str]) -> str:
    """The first of the candidate files that exists."""
    for path in paths:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {paths} exists")
