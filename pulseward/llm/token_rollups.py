"""Token counts kept up by signed deltas.

A batch of changes inserts, revises or deletes documents. Its texts are counted once; against the ledger of what was
counted before, each change becomes signed amounts, which are summed by source, language and tokenizer version and
stored as that commit's deltas. Totals are the sums of all deltas. A commit is a batch under a tokenizer version. It is done with
its delta folder's success marker, written last: a failed one leaves no trace in the totals and can be run again, a
done one is not applied twice.

Each version has totals of its own: an insert or a revision counts under the version it is committed with, and leaves the
others as they are; a delete takes the document out of every version's totals. From time to time the ledger is summed up
in a snapshot, so that a commit reads one row per document and version and the changes since.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseward.llm.common import map_blocks
from pulseward.llm.tokens import default_files, encoder

#: Name of the tokenizer's version in the totals.
VERSION = "byte_bpe_50k"
_GROUP = ["source", "lang", "tokenizer"]
_AMOUNTS = ["documents", "chars", "tokens"]
LEDGER = "doc_id long, source string, lang string, tokenizer string, documents long, chars long, tokens long, place long"
#: Commits from one snapshot of the ledger to the next.
SNAPSHOT_EVERY = 8
DELTAS = "source string, lang string, tokenizer string, documents long, chars long, tokens long"


def count_tokens(docs: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """``doc_id, source, lang, chars, tokens`` of whole texts; null texts have none."""
    files = files or default_files()

    def run(part: pa.RecordBatch) -> dict:
        count = encoder(*files).count
        texts = [t or "" for t in part.column("text").to_pylist()]
        return {
            **{c: part.column(c) for c in ("doc_id", "source", "lang")},
            "chars": pa.array([len(t) for t in texts], pa.int64()),
            "tokens": pa.array([count(t) for t in texts], pa.int64()),
        }

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text")
    return map_blocks(ids, run, "doc_id long, source string, lang string, chars long, tokens long")


class Rollup:
    """The ledger and the deltas below a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, version: str = VERSION, files: tuple[str, str] | None = None):
        self.spark, self.path, self.version, self.files = spark, path.rstrip("/"), version, files

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _done(self, kind: str) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/*/_SUCCESS")
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where) or []
        return sorted(f.getPath().getParent().getName() for f in found)

    def _committed(self) -> list[tuple[int, int, str]]:
        """(place, batch, version) of the commits that are done, in their order."""
        names = [name.split("_", 2) for name in self._done("deltas")]
        return sorted((int(place), int(batch), bytes.fromhex(version).decode()) for place, batch, version in names)

    @staticmethod
    def _name(place: int, batch: int, version: str) -> str:
        return f"{place:08d}_{batch}_{version.encode().hex()}"

    def _read(self, kind: str, schema: str, names: list[str]) -> DataFrame:
        paths = [f"{self.path}/{kind}/{name}" for name in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def current(self) -> DataFrame:
        """Each document and version as last counted by the commits that are done; deleted ones with zero amounts."""
        done = self._committed()
        snapshots = [int(name) for name in self._done("snapshots") if int(name) <= len(done)]
        since = max(snapshots, default=0)
        rows = self._read("ledger", LEDGER, [self._name(*d) for d in done[since:]])
        if since:
            rows = rows.unionByName(self._read("snapshots", LEDGER, [f"{since:08d}"]))
        return rows.groupBy("doc_id", "tokenizer").agg(
            *[F.max_by(c, "place").alias(c) for c in ("source", "lang", *_AMOUNTS)], F.max("place").alias("place")
        )

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply ``changes`` (op, doc_id, source, lang, text) as batch number ``batch`` under this version; False if that is done.

        ``op`` is ``upsert`` (insert or revise) or ``delete``. Batches are numbered in the order of their changes, over all versions;
        of several changes to a document in one batch a delete wins, else the one with the largest text. Deleting an unknown
        document, or revising to the same counts, changes nothing. Changes without an id or with another ``op`` are ignored, null
        and empty texts count as a document without tokens; repeated rows count once; other columns are ignored.
        """
        done = self._committed()
        if any((b, v) == (batch, self.version) for _, b, v in done):
            return False
        if done and batch < max(b for _, b, _ in done):
            raise ValueError(f"batch {batch} comes after {max(b for _, b, _ in done)}, which is committed")
        name = self._name(len(done), batch, self.version)
        known = changes.where(F.col("doc_id").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("long"))
        counted = count_tokens(known.where("op = 'upsert'"), self.files)
        deleted = known.where("op = 'delete'").select("doc_id").distinct()
        pick = F.struct("chars", "tokens", "source", "lang")
        upserts = counted.groupBy("doc_id").agg(F.max(pick).alias("v")).join(deleted, "doc_id", "left_anti")
        before = self.current()
        held = before.where("documents <> 0").select("doc_id", "tokenizer").join(deleted, "doc_id", "left_semi")
        none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
        new = upserts.select(
            "doc_id", "v.source", "v.lang", F.lit(self.version).alias("tokenizer"), F.lit(1).cast("long").alias("documents"), "v.chars", "v.tokens"
        ).union(held.select("doc_id", none, none, "tokenizer", zero, zero, zero))
        new.withColumn("place", F.lit(len(done)).cast("long")).select(*[c.split()[0] for c in LEDGER.split(", ")]).write.mode(
            "overwrite"
        ).parquet(f"{self.path}/ledger/{name}")
        new = self._read("ledger", LEDGER, [name])
        old = before.join(new.select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_semi")
        signed = new.select(*_GROUP, *_AMOUNTS).unionByName(old.select(*_GROUP, *[(-F.col(c)).alias(c) for c in _AMOUNTS]))
        deltas = signed.groupBy(*_GROUP).agg(*[F.sum(c).alias(c) for c in _AMOUNTS])
        some = " or ".join(f"{c} <> 0" for c in _AMOUNTS)
        deltas.where(some).write.mode("overwrite").parquet(f"{self.path}/deltas/{name}")
        if (len(done) + 1) % SNAPSHOT_EVERY == 0:
            self.snapshot()
        return True

    def snapshot(self) -> None:
        """Sum up the ledger of all commits that are done; documents that are deleted go."""
        columns = [c.split()[0] for c in LEDGER.split(", ")]
        path = f"{self.path}/snapshots/{len(self._committed()):08d}"
        self.current().where("documents <> 0").select(*columns).write.mode("overwrite").parquet(path)

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, documents, chars, tokens``; groups without documents are left out."""
        deltas = self._read("deltas", DELTAS, [self._name(*d) for d in self._committed()])
        return deltas.groupBy(*_GROUP).agg(*[F.sum(c).alias(c) for c in _AMOUNTS]).where("documents <> 0")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """Documents that repeat a line, as they read with the first of each only."""
    lines = F.split("text", "\n")
    once = docs.withColumn("__lines", lines).withColumn("__once", F.array_distinct("__lines"))
    return once.where(F.size("__once") < F.size("__lines")).withColumn("text", F.array_join("__once", "\n")).drop("__lines", "__once")
