"""Stored tables as Parquet folders, partitioned by dataset."""

from __future__ import annotations

from hashlib import md5
from urllib.parse import unquote
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseward.operators.telemetry import or_default
from pulseward.sources.files import path_exists

PARTITION = "dataset_source"
MANIFEST = "upload string, attempt string"


def read_stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, empty while nothing has been written."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def scan_partition(table: DataFrame, dataset_source: str, order_by: str = "metric_date") -> DataFrame:
    """The rows of one dataset by date; on a stored table only its folder is read."""
    return table.where(F.col(PARTITION) == dataset_source).orderBy(order_by)


def stored_datasets(spark: SparkSession, *paths: str) -> DataFrame:
    """Names of the datasets with rows in any of the stored tables, by their folders: no row and no file is read."""
    names = set()
    for path in paths:
        pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{PARTITION}=*")
        found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        names |= {unquote(f.getPath().getName().split("=", 1)[1]) for f in found}
    names.discard("__HIVE_DEFAULT_PARTITION__")
    return or_default(spark.createDataFrame([(name,) for name in sorted(names)], f"{PARTITION} string"))


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append daily metrics. Rows are laid out by date so that readers skip files; a hot dataset spreads over tasks."""
    keys = [PARTITION, "metric_date", "region", "product_name"]
    metrics.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("append").partitionBy(PARTITION).parquet(path)


def append_tickets(tickets: DataFrame, path: str) -> None:
    tickets.write.mode("append").partitionBy(PARTITION).parquet(path)


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def upload_key(rows: DataFrame, name: str) -> str:
    """A key of a name and of all rows, whatever their order; repeated rows count. Runs one aggregate."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})
    halves = [F.sum(F.xxhash64(F.lit(salt), row).cast("decimal(38,0)")).cast("string") for salt in (1, 2)]
    facts = rows.agg(F.count("*").cast("string"), *halves).first()
    return md5("|".join([name, *rows.columns, *map(str, facts)]).encode()).hexdigest()


def committed_uploads(spark: SparkSession, manifest: str) -> DataFrame:
    """The attempt that counts of every upload: the smallest of those that were committed."""
    return read_stored(spark, manifest, MANIFEST).groupBy("upload").agg(F.min("attempt").alias("attempt"))


def append_once(tables: dict[str, DataFrame], manifest: str, upload: str) -> bool:
    """Append rows, by the path of their table, unless the manifest has the upload; tells whether they were.

    Rows carry the name of the attempt that wrote them and are seen by ``read_committed`` once the manifest has it, which
    is written last. What a broken attempt left is never seen, and of two attempts at once only one counts.
    """
    spark = next(iter(tables.values())).sparkSession
    if not committed_uploads(spark, manifest).where(F.col("upload") == upload).isEmpty():
        return False
    attempt = uuid4().hex
    for path, rows in tables.items():
        rows.withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy(PARTITION).parquet(path)
    append_rows(spark.createDataFrame([(upload, attempt)], MANIFEST).coalesce(1), manifest)
    return True


def read_committed(spark: SparkSession, path: str, manifest: str, schema: str) -> DataFrame:
    """The rows of a stored table that were appended plainly or by an attempt that counts."""
    stored = read_stored(spark, path, f"{schema}, attempt string")
    counts = committed_uploads(spark, manifest).select("attempt")
    plain = stored.where(F.col("attempt").isNull())
    return plain.unionByName(stored.join(counts, "attempt", "left_semi")).drop("attempt")


def replace_dataset(table: DataFrame, path: str) -> None:
    """Overwrite the folders of the datasets in the table, and only those."""
    (
        table.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(PARTITION)
        .parquet(path)
    )


def clear_table(spark: SparkSession, path: str, schema: str) -> None:
    """Empty a stored table of all its datasets."""
    empty = spark.createDataFrame([], schema)
    empty.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """One Markdown file per report, in a folder named by its anomaly."""
    documents.write.mode("append").partitionBy("anomaly_id").text(path)
