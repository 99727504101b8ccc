"""Exact dedup by a persistent digest index, bucketed and sorted by hash.

``DigestIndex`` is a Parquet table, clustered into buckets by digest and sorted within them. A batch is reduced to one
row per digest (with map-side partial sums, so a digest held by a third of the rows costs one row per task), joined
against the index by a sort-merge anti-join that reads the buckets in place, and what is new is appended. The index
outlives the session: ``DigestIndex.open`` registers an existing folder again.

Each row of the index names the batch that brought it. A batch keeps a row if the index names this batch for its digest;
so the same documents under another batch's name keep nothing, and a batch that is tried again under its own name, after
a failure or out of caution, appends nothing twice and reports the same. One batch at a time may append: it holds a lock
file, which the same batch may take over and ``unlock`` removes after a writer that is gone for good. The number of
buckets is settled with the first batch, by ``rows`` or by its size (BUCKET_ROWS digests each), and kept beside the
table. ``compact`` makes one sorted file of each bucket.

Defined cases: a null text counts as the empty text; all empty texts are equal. A null doc_id sorts after all others.
Of rows that repeat both doc_id and text exactly one is kept; of rows with one doc_id and different texts each stands for
its own text. Texts of any length are taken whole. An empty batch gives an empty report. Extra columns, whatever their
names, are ignored (``keep_first`` hands them on). Across batches, the row of the earliest batch stays.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import discard, identity, keep, lookup, materialize, shared_dir

#: Runs of these become one space before texts are compared.
BLANKS = r"[\x20\x09-\x0D]+"
#: Digests of a bucket, about 100 MB of Parquet, when their number is settled; and the least and greatest number.
BUCKET_ROWS, BUCKETS = 2_000_000, (16, 65_536)


def text_digest(text: str | Column) -> Column:
    """SHA-256, in lowercase hex, of the text with each run of blanks replaced by one space."""
    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " "), 256)


class DigestIndex:
    """One row per digest ever seen: digest (32 bytes), keep_id and batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.name = spark, path.rstrip("/"), None
        make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._at = lambda name: make(f"{self.path}/{name}")
        self.fs = make(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self.fs.exists(self._at("index.json")):
            self._register(json.loads(self._read("index.json"))["buckets"])

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> DigestIndex:
        """The index in folder ``path``, which is made with the first batch if it isn't there."""
        return cls(spark, path)

    def _read(self, name: str) -> str:
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]

    def _write(self, name: str, text: str, replace: bool) -> None:
        out = self.fs.create(self._at(name), replace)  # fails if it is there and not to be replaced
        out.write(bytearray(text.encode()))
        out.close()

    def _register(self, buckets: int) -> None:
        self.buckets, self.name = buckets, f"digest_index_{uuid.uuid4().hex[:12]}"
        self.spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}/digests'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        """Take the table out of the session's catalog; the folder stays."""
        if self.name:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            self.name = None

    def lock(self, batch: str) -> None:
        name = "lock.json"
        try:
            self._write(name, json.dumps({"batch": batch}), False)
        except Exception as e:
            if not self.fs.exists(self._at(name)) or json.loads(self._read(name) or "{}").get("batch") != batch:
                raise RuntimeError(f"another batch is being written to {self.path}; unlock() it if its writer is gone") from e

    def unlock(self) -> None:
        self.fs.delete(self._at("lock.json"), False)

    def ingest(self, docs: DataFrame, batch: str | None = None, rows: int | None = None) -> DataFrame:
        """Append the digests of ``docs`` that are new; one row per row of ``docs``.

        Returns doc_id, keep_id, group_size (rows of this batch with the text), kept and text_sha256. ``batch`` names the
        batch, by default anew; ``rows`` is how many digests the index is expected to hold in the end.
        """
        return self._ingest(docs, batch or uuid.uuid4().hex, rows).drop("identity")

    def _ingest(self, docs: DataFrame, batch: str, rows: int | None = None) -> DataFrame:
        # Written first: texts are read once, and row numbers stay as they are.
        digests = materialize(docs.select(identity().alias("identity"), F.unhex(text_digest("text")).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
        first = F.min(F.struct("identity.none", "identity.id", "row"))
        groups = digests.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
        mine = F.when(~F.col("first.none"), F.col("first.id"))
        groups = materialize(groups.select("digest", mine.alias("first_id"), F.col("first.row").alias("first_row"), "group_size"), "digest-groups")
        self.lock(batch)
        if self.name is None:
            n = min(max(-(-(rows or groups.count()) // BUCKET_ROWS), BUCKETS[0]), BUCKETS[1])
            self._write("index.json", json.dumps({"buckets": n}), True)
            self._register(n)
        fresh = groups.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")
        fresh = fresh.select("digest", F.col("first_id").alias("keep_id"), F.lit(batch).alias("batch"))
        fresh.repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        # Digests that other batches brought keep nothing of this one.
        kept_row = F.when(F.col("batch") == batch, F.col("first_row")).alias("keep_row")
        keepers = materialize(groups.hint("merge").join(self.rows(), "digest").select("digest", "keep_id", "group_size", kept_row), "digest-keepers")
        self.unlock()
        discard(groups)
        out = lookup(digests, keepers, "digest", "group_size", "row")
        doc_id = F.when(~F.col("identity.none"), F.col("identity.id")).alias("doc_id")
        kept = F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept")
        return out.select("identity", doc_id, "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"))

    def compact(self) -> None:
        """One sorted file for each bucket, written beside the table and then put in its place."""
        batch = f"compact-{uuid.uuid4().hex}"
        self.lock(batch)
        buckets, old = self.buckets, self.name
        name = f"digest_index_{uuid.uuid4().hex[:12]}"
        self.rows().repartition(buckets, "digest").write.bucketBy(buckets, "digest").sortBy("digest").option("path", f"{self.path}/compacted").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        self.spark.sql(f"DROP TABLE {old}")
        self.fs.rename(self._at("digests"), self._at("replaced"))
        self.fs.rename(self._at("compacted"), self._at("digests"))
        self.fs.delete(self._at("replaced"), True)
        self._register(buckets)
        self.unlock()


def _report(docs: DataFrame) -> DataFrame:
    """The report for an index of its own, which is deleted again."""
    index = DigestIndex.open(docs.sparkSession, shared_dir(docs.sparkSession, "digest-index"))
    out = index._ingest(docs, uuid.uuid4().hex)
    index.close()
    index.fs.delete(index._at("."), True)
    return out


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The report of ``DigestIndex.ingest`` for ``docs``, by default with an index that is empty before."""
    return index.ingest(docs) if index else _report(docs).drop("identity")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns."""
    return keep(docs, _report(docs).select("identity", "kept"))
