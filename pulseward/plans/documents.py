"""Reports as Markdown in few files: each holds the documents of a range of anomalies, and an index says where one stands.

A batch is written in three steps: its documents, dealt and ordered, to the shared folder; from there their text; last
its index. A document counts as written once the index has it, so what a broken run left is never seen, and the same batch
written again takes its place.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseward.session import staged
from pulseward.sources.files import path_exists

INDEX = "anomaly_id bigint, place bigint, bytes bigint, batch string, part int"
#: What stands between documents, and after the last of a file.
SEPARATOR = "\n\n"


def write_document_batch(documents: DataFrame, path: str, batch: str) -> None:
    """Write ``anomaly_id`` and ``document`` as the batch of a name; ids do not repeat in it. A null document is an empty one."""
    if not re.fullmatch(r"[\w-]+", batch, re.ASCII):
        raise ValueError(f"{batch!r} names no batch; letters, digits, _ and - do")
    dealt = staged(
        documents.select("anomaly_id", F.coalesce("document", F.lit("")).alias("document"))
        .repartitionByRange("anomaly_id")
        .sortWithinPartitions("anomaly_id")
        .withColumn("part", F.spark_partition_id()),
        "documents",
    )
    length = F.octet_length("document").cast("bigint")
    # The files of a part must come from one task in this order, which the range of ids alone would not promise.
    ordered = dealt.repartition("part").sortWithinPartitions("part", "anomaly_id")
    (
        ordered.select("part", "document")
        .write.mode("overwrite")
        .option("lineSep", SEPARATOR)
        .option("partitionOverwriteMode", "static")
        .partitionBy("part")
        .text(f"{path}/text/batch={batch}")
    )
    before = Window.partitionBy("part").orderBy("anomaly_id").rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce(F.sum(length + len(SEPARATOR)).over(before), F.lit(0))
    index = dealt.select("anomaly_id", place.alias("place"), length.alias("bytes"), "part")
    (
        index.write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .parquet(f"{path}/index/batch={batch}")
    )


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """Where every document stands: batch, part, first byte and number of bytes."""
    if not path_exists(spark, f"{path}/index"):
        return spark.createDataFrame([], INDEX)
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """All documents of the index, cut out of their files by place; a file is read once for all of its documents."""
    places = document_index(spark, path).groupBy("batch", "part").agg(F.collect_list(F.struct("anomaly_id", "place", "bytes")).alias("places"))
    if not path_exists(spark, f"{path}/text"):
        return spark.createDataFrame([], "anomaly_id bigint, document string")
    where = r"/batch=([^/]+)/part=(\d+)/[^/]*$"
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(f"{path}/text")
        .select(F.regexp_extract("path", where, 1).alias("batch"), F.regexp_extract("path", where, 2).cast("int").alias("part"), "content")
    )

    def cut(p):
        text = F.substr("content", (p["place"] + 1).cast("int"), p["bytes"].cast("int"))
        return F.struct(p["anomaly_id"].alias("anomaly_id"), F.decode(text, "UTF-8").alias("document"))

    return files.join(places, ["batch", "part"]).select(F.explode(F.transform("places", cut)).alias("d")).select("d.*")


def read_document(spark: SparkSession, path: str, anomaly_id: int) -> str | None:
    """One document by the index: of its file only its own bytes are read."""
    found = document_index(spark, path).where(F.col("anomaly_id") == anomaly_id).orderBy("batch").first()
    if found is None:
        return None
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/text/batch={found.batch}/part={found.part}/part-*")
    system = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = system.open(system.globStatus(pattern)[0].getPath())
    try:
        stream.seek(found.place)
        return bytes(stream.readNBytes(found.bytes)).decode("utf-8")
    finally:
        stream.close()
