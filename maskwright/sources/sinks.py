"""Sinks: ordered lines, a file for each record, JSON lines in their envelopes, vaults, reports."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: Fixed values of a stored vault: its format and version.
MAGIC, VERSION = "maskwright-vault", 1


def write_lines(rows: DataFrame, path: str, order: str, line: str) -> None:
    """One line for each row, in order; parts of the sort become files whose names sort alike."""
    rows.orderBy(order).select(line).write.text(path)


def write_tree(rows: DataFrame, folder: str) -> DataFrame:
    """A file for each record (id, text) under ``folder``, through a temporary name; id and bytes of those written."""

    def run(batches: Iterator) -> Iterator:
        import os

        import pyarrow as pa
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            sizes = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = os.path.normpath(f"{root}/{name}")
                if not target.startswith(root.rstrip("/") + "/"):
                    raise ValueError(f"{name} lies outside of the folder")
                data = (text or "").encode()
                where.create_dir(os.path.dirname(target), recursive=True)
                temporary = f"{target}.{uuid.uuid4().hex}.tmp"
                with where.open_output_stream(temporary, compression=None) as out:
                    out.write(data)
                where.move(temporary, target)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["id", "bytes"])

    return rows.select("id", "text").mapInArrow(run, "id string, bytes long")


def scan_line(id: Column | str = "id", spans: Column | str = "spans") -> Column:
    """The JSON line of a scan: id and spans."""
    return F.to_json(F.struct(F.col(id).alias("id") if isinstance(id, str) else id.alias("id"), F.col(spans).alias("spans") if isinstance(spans, str) else spans.alias("spans")))


def reframe(docs: DataFrame, raw: str = "raw", text: str = "text", field: str = "text", out: str = "line") -> DataFrame:
    """``docs`` with the JSON object in ``raw`` whose ``field`` is replaced by ``text`` and all else as it was, keys sorted;
    an object of its own where there was none. JSON types survive only outside of Spark's own types, so this is an
    Arrow-batched pass."""

    def one(r: str | None, t: str | None) -> str:
        value = json.loads(r) if r is not None else None
        value = value if isinstance(value, dict) else {}
        value[field] = t
        return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lines = [one(r, t) for r, t in zip(batch.column(raw).to_pylist(), batch.column(text).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines, pa.string())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema]).add(out, StringType()))


def vault_lines(vault: DataFrame) -> DataFrame:
    """ord and line: the vault as an indented JSON array in order, an entry to a row."""
    last = vault.agg(F.max("seq")).first()[0]
    inner = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    entry = F.concat(
        F.lit('  {\n    "category": '), inner("category"), F.lit(',\n    "real": '), inner("real"), F.lit(',\n    "fake": '), inner("fake"),
        F.when(F.col("seq") == last, "\n  }").otherwise("\n  },"),
    )
    edges = vault.sparkSession.createDataFrame([(-1, "["), (2**62, "]")], "ord long, line string")
    return vault.select(F.col("seq").alias("ord"), entry.alias("line")).unionByName(edges)


def combined(anonymized: Column | str = "anonymized", subs: Column | str = "entries") -> Column:
    """The JSON of one anonymized text with its vault."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.to_json(F.struct(col(anonymized).alias("anonymized"), col(subs).alias("vault")))


def report_lines(spans: Column | str = "spans") -> Column:
    """A line for each span, for reading; one that says so if there is none."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    line = lambda s: F.format_string("%s [%d..%d] score=%.3f %s", s["category"], s["start"], s["end"], s["score"].cast("double"), s["text"])
    return F.when(F.size(spans) == 0, F.lit("no PII detected")).otherwise(F.array_join(F.transform(spans, line), "\n"))


def summary(docs: DataFrame, vault: DataFrame) -> DataFrame:
    """documents and entries of a run."""
    counts = docs.select(F.lit(1).alias("d"), F.lit(0).alias("e")).unionByName(vault.select(F.lit(0).alias("d"), F.lit(1).alias("e")))
    return counts.agg(F.sum("d").alias("documents"), F.sum("e").alias("entries"))


def save_vault(vault: DataFrame, path: str) -> None:
    """Store a vault: a new table under another name, then a manifest with the next number, renamed into place.

    Nothing that is there is touched, so whoever reads meanwhile, or after a crash, gets the vault before or this one.
    """
    spark = vault.sparkSession
    part = f"part-{uuid.uuid4().hex[:12]}"
    vault.write.parquet(f"{path}/{part}")
    fs, jpath = _fs(spark, path)
    data = json.dumps({"format": MAGIC, "version": VERSION, "data": part}).encode()
    temporary = jpath(f"{path}/.manifest-{uuid.uuid4().hex[:12]}.tmp")
    out = fs.create(temporary)
    out.write(bytearray(data))
    out.close()
    for number in range(max(_manifests(fs, jpath, path), default=0) + 1, 2**31):
        target = jpath(f"{path}/manifest-{number:09}.json")
        if not fs.exists(target) and fs.rename(temporary, target):
            return


def _manifests(fs, jpath, path: str) -> list[int]:
    if not fs.exists(jpath(path)):
        return []
    names = [str(f.getPath().getName()) for f in fs.listStatus(jpath(path))]
    return [int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)\.json", n))]


def load_vault(spark: SparkSession, path: str) -> DataFrame | None:
    """The vault stored last; none if there isn't one. One whose manifest isn't a vault's is set aside, as ``.corrupt``,
    and refused; a store that can't be read now is an error that changes nothing."""
    fs, jpath = _fs(spark, path)
    held = _manifests(fs, jpath, path)
    if not held:
        return None
    text = spark.read.text(f"{path}/manifest-{max(held):09}.json", wholetext=True).first()
    try:
        manifest = json.loads(text[0] if text else "")
        if manifest.get("format") != MAGIC or manifest.get("version") != VERSION:
            raise ValueError("the vault's format or version is not known")
        part = manifest["data"]
    except (ValueError, KeyError, AttributeError) as e:
        aside = f"{path}.corrupt-{uuid.uuid4().hex[:8]}"
        fs.rename(jpath(path), jpath(aside))
        raise ValueError(f"the vault can't be read and is now in {aside}") from e
    return spark.read.parquet(f"{path}/{part}")


def _fs(spark: SparkSession, path: str):
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make
