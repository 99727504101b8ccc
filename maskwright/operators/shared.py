"""Tables in the folder that driver and executors share, numbering of rows, and lookups that stand hot and missing keys."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: A key is hot when it has at least this share of the rows; so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 0.001
#: Narrow rows, counted before, that are broadcast at most; more go through a shuffled join.
BROADCAST_ROWS = 400_000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Where it is unset and everything runs in one
    process, as in tests, a temporary folder serves; on a cluster that is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="maskwright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage where a result is used more than once; a lost executor loses no part of it.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.shared_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[Column | str], name: str, start: int = 0) -> DataFrame:
    """``df`` with a gapless number in that order, from ``start``.

    A range sort, then a count for each of its parts; only those counts are summed up in one place.
    """
    part = materialize(
        df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered"
    )
    counts = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))  # a row for each part of the sort
    out = part.join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_row") + start).drop("_part", "_row", "_before")


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened by underscores until no column of ``docs`` is called so."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lookup(left: DataFrame, right: DataFrame, key: str, count: str, spread: Column | str, how: str = "left") -> DataFrame:
    """``left`` joined with ``right`` on ``key`` (not null on the left), standing keys that hold a third of the rows.

    ``right`` is unique on ``key``; its column ``count`` says how many rows of ``left`` have the key. Keys with at
    least HOT_SHARE of all those rows, of which there can only be 1 / HOT_SHARE, are broadcast; every other key goes
    through an ordinary shuffled join, in which the rows of hot keys are dealt out by ``spread`` and match nothing.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    names = [c for c in right.columns if c != key]
    hk, hot_, k, cold_ = fresh(left, "_hk", "_hot", "_k", "_cold")
    least = max(2, math.ceil(total * HOT_SHARE))  # so at most 1 / HOT_SHARE keys have as many
    hot = right.where(F.col(count) >= least).select(F.col(key).alias(hk), F.struct(*names).alias(hot_))
    cold = right.where(F.col(count) < least).select(
        F.struct(F.col(key).alias("k"), F.lit(0).alias("s")).alias(k), F.struct(*names).alias(cold_)
    )
    out = left.join(F.broadcast(hot), left[key] == F.col(hk), "left") if total >= 2 else left.withColumn(hot_, F.lit(None).cast(hot.schema[hot_].dataType)).withColumn(hk, F.lit(None))
    salt = F.when(F.col(hot_).isNotNull(), F.pmod(F.xxhash64(spread), F.lit(1_000_000)).cast("int") + 1).otherwise(0)
    out = out.withColumn(k, F.struct(F.col(key).alias("k"), salt.alias("s"))).join(cold, k, "left")
    found = F.coalesce(hot_, cold_)
    if how == "inner":
        out = out.where(found.isNotNull())
    return out.select(*left.columns, *(found[c].alias(c) for c in names))


def row_identity(key: list[str], text: str) -> Column:
    """What names a row by its key and its text, never null: a missing key is one like others, and rows that share a key
    are told apart by 128 bits of their text. Rows that repeat both are alike."""
    parts = [x for i, c in enumerate(key) for x in (F.col(c).isNull().alias(f"none{i}"), F.col(c).alias(f"key{i}"))]
    return F.struct(*parts, F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def few(found: DataFrame) -> bool:
    """Whether a written table is small enough to be broadcast: at most BROADCAST_ROWS rows, each element of an array
    counting as four."""
    rows = F.lit(1)
    for f in found.schema:
        if isinstance(f.dataType, ArrayType):
            rows = rows + 4 * F.greatest(F.size(f.name), F.lit(0))
    return (found.agg(F.sum(rows)).first()[0] or 0) <= BROADCAST_ROWS


def joined_by(docs: DataFrame, found: DataFrame, key: list[str], text: str, id: str) -> DataFrame:
    """``docs`` with the columns of ``found``, which is unique by ``id`` (a ``row_identity``); null where it has none.

    Texts move only if ``found``, a written table, isn't ``few``.
    """
    mine, theirs = fresh(docs, "_identity", "_found")
    rest = [c for c in found.columns if c != id]
    narrow = found.select(F.col(id).alias(mine), F.struct(*rest).alias(theirs))
    if few(found):
        narrow = F.broadcast(narrow)
    out = docs.withColumn(mine, row_identity(key, text)).join(narrow, mine, "left")
    return out.select(*docs.columns, *[F.col(theirs)[c].alias(c) for c in rest])
