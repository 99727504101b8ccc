"""What the training-data operators share: tables in the shared folder, lookups that stand hot keys, and keeping rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators.shared import BROADCAST_ROWS, HOT_SHARE, discard, fresh, lookup, materialize, shared_dir

__all__ = ["BROADCAST_ROWS", "HOT_SHARE", "discard", "fresh", "identity", "keep", "lookup", "materialize", "released", "shared_dir", "sliced", "spread", "table"]

#: Rows that a pass over texts holds as Python objects at once.
SLICE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in ``sf_dir``; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` dealt out to all cores where they come from a single file; passes over texts are bound by the processor.

    Tables of more files are left as they are.
    """
    return docs.repartition(docs.sparkSession.sparkContext.defaultParallelism) if len(docs._jdf.inputFiles()) == 1 else docs


def identity(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What tells a document apart, never null: its id, and 128 bits of its text. Rows that repeat both are alike."""
    return F.struct(
        F.col(doc_id).isNull().alias("none"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"),
    )


def keep(docs: DataFrame, report: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``report`` keeps.

    ``report`` has a row for each row of ``docs``: ``identity`` and ``kept``. Of rows that repeat id and text one stays if
    some of them are kept, all if all are. Only what goes is looked up, by a broadcast of BROADCAST_ROWS narrow rows at
    most, else by a shuffled join that stands hot keys.
    """
    each = report.groupBy("identity").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("long")).alias("stay"))
    marks = materialize(each.where("stay < n"), "marks")
    key, n, stay = fresh(docs, "_identity", "_n", "_stay")
    rows = docs.withColumn(key, identity())
    marks = marks.select(F.col("identity").alias(key), F.col("n").alias(n), F.col("stay").alias(stay))
    if marks.count() <= BROADCAST_ROWS:
        found = rows.join(F.broadcast(marks), key, "left")
    else:
        found = lookup(rows, marks, key, n, F.monotonically_increasing_id())
    out = found.where(F.col(stay).isNull()).select(*docs.columns)
    if marks.where(F.col(stay) > 0).isEmpty():
        return out
    return out.unionByName(found.where(F.col(stay) > 0).dropDuplicates([key]).select(*docs.columns))


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` of ``mapInArrow``, whose worker gives what it no longer uses back to the system when the task ends: workers
    serve the next steps too, and each would go on holding the most that any step took."""

    def task(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return task


def sliced(batches: Iterator, rows: int = SLICE) -> Iterator:
    """The same rows in batches of ``rows`` at most, without a copy."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
