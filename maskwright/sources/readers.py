"""Sources of records (id, text, raw): lines, JSON lines, tab-separated columns, trees of files, custom delimiters; and
labelled corpora and vaults.

Ids are line numbers from 0, as strings. Lines are read in splits; each split's lines are counted first, and a line's
number is its place in its split plus the lines of the splits before, so numbering moves no text. A line that isn't UTF-8
is left out before lines are numbered; ``skipped`` counts what a reading leaves out.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.functions.patterns import CATEGORIES
from maskwright.operators.shared import BROADCAST_ROWS, materialize

RECORD = "id string, text string, raw string"
BOM = "﻿"


def resolve_format(path: str | None, explicit: str | None = None, is_dir: bool = False) -> str:
    """lines, jsonl, tsv or files: what was asked for, else by the path's kind and ending."""
    if explicit:
        return explicit
    if is_dir:
        return "files"
    ending = os.path.splitext(path or "")[1].lower()
    return {".jsonl": "jsonl", ".ndjson": "jsonl", ".tsv": "tsv"}.get(ending, "lines")


def _split_lines(spark: SparkSession, path: str, sep: str = "\n") -> DataFrame:
    """value, the split it was read in (path and start), and m, which counts the rows of a task."""
    rows = spark.read.option("lineSep", sep).text(path).where(F.is_valid_utf8("value"))
    return rows.select("value", F.col("_metadata.file_path").alias("p0"), F.col("_metadata.file_block_start").alias("p1"), F.monotonically_increasing_id().alias("m"))


def _numbered_lines(spark: SparkSession, path: str, sep: str = "\n") -> DataFrame:
    """n and value of each line; a mark of byte order is taken off the first."""
    rows = _split_lines(spark, path, sep)
    # A row for each split, so one task may sum them up. A task reads a split's lines one after the other.
    splits = rows.groupBy("p0", "p1").agg(F.count(F.lit(1)).alias("lines"), F.min("m").alias("first"))
    before = F.coalesce(F.sum("lines").over(Window.orderBy("p0", "p1").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = materialize(splits.select("p0", "p1", (before - F.col("first")).alias("shift")), "splits")
    known = F.broadcast(splits) if splits.count() <= BROADCAST_ROWS else splits
    rows = rows.join(known, ["p0", "p1"]).select((F.col("m") + F.col("shift")).alias("n"), "value")
    return rows.withColumn("value", F.when(F.col("n") == 0, F.regexp_replace("value", "^\\ufeff", "")).otherwise(F.col("value")))


def skipped(spark: SparkSession, path: str, kind: str | None = None, is_dir: bool = False) -> DataFrame:
    """reason and n of the records that ``read`` leaves out: not_utf8, and of JSON lines blank and not_json."""
    kind = resolve_format(path, kind, is_dir)
    if kind == "files":
        raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    else:
        raw = spark.read.text(path)
    valid, value = F.is_valid_utf8("value"), _bare()
    reason = F.when(~valid, "not_utf8")
    if kind == "jsonl":
        reason = reason.when(F.trim(value) == "", "blank").when(F.try_parse_json(value).isNull(), "not_json")
    return raw.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _record(rows: DataFrame, text: Column, raw: Column | None = None) -> DataFrame:
    return rows.select(F.col("n").cast("string").alias("id"), text.alias("text"), (raw if raw is not None else F.lit(None).cast("string")).alias("raw"))


def _bare(value: str = "value") -> Column:
    return F.regexp_replace(value, r"[\r\n]+$", "")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """A record for each line, empty ones too."""
    return _record(_numbered_lines(spark, path), _bare())


def json_text(value: Column | str, field: str) -> Column:
    """A field's string; empty if the object has none or it isn't a string. Null for what isn't JSON."""
    v = F.try_parse_json(F.col(value) if isinstance(value, str) else value)
    at = "$['" + field.replace("\\", "\\\\").replace("'", "\\'") + "']"
    is_string = F.schema_of_variant(F.try_variant_get(v, at, "variant")) == "STRING"
    return F.when(v.isNotNull(), F.when(F.coalesce(is_string, F.lit(False)), F.try_variant_get(v, at, "string")).otherwise(""))


def jsonl(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    """A record for each line that is JSON, with the whole line as raw; others, and blank lines, only take a number."""
    rows = _numbered_lines(spark, path).withColumn("value", _bare())
    out = _record(rows.where(F.trim("value") != ""), json_text("value", field), F.col("value"))
    return out.where("text IS NOT NULL")


def tsv(spark: SparkSession, path: str, column: int = 0) -> DataFrame:
    """The column's text, from 0; empty where a line has fewer."""
    return _record(_numbered_lines(spark, path), F.coalesce(F.get(F.split(_bare(), "\t", -1), F.lit(column)), F.lit("")))


def files(spark: SparkSession, path: str) -> DataFrame:
    """A record for each file of a tree, its path within it as id."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).where(F.is_valid_utf8("value"))
    root = path.partition("://")[2] if "://" in path else os.path.abspath(path)
    inside = F.element_at(F.split(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"\Q" + root.rstrip("/") + r"/\E", 2), -1)
    return rows.select(inside.alias("id"), F.regexp_replace("value", "^\\ufeff", "").alias("text"), F.lit(None).cast("string").alias("raw"))


def delimited(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """A record for each stretch between delimiters, the last one too if it is empty."""
    rows = _numbered_lines(spark, path, delimiter)
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    size, want = fs.getFileStatus(p).getLen(), delimiter.encode()
    tail = b""
    if size >= len(want):
        stream = fs.open(p)
        stream.seek(size - len(want))
        tail = bytes(stream.read() & 0xFF for _ in want)
        stream.close()
    if size == 0 or tail == want:
        n = rows.count()
        rows = rows.unionByName(spark.createDataFrame([(n, "")], "n long, value string"))
    return _record(rows, F.col("value"))


def records(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Records of any frame or stream."""
    return docs.select(F.col(id).cast("string").alias("id"), F.col(text).cast("string").alias("text"), F.lit(None).cast("string").alias("raw"))


def read(spark: SparkSession, path: str, kind: str | None = None, field: str = "text", column: int = 0, delimiter: str | None = None, is_dir: bool = False) -> DataFrame:
    """Records of any of these kinds; a delimiter wins over all but trees of files."""
    kind = resolve_format(path, kind, is_dir)
    if kind == "files":
        return files(spark, path)
    if delimiter:
        return delimited(spark, path, delimiter)
    return {"lines": lambda: lines(spark, path), "jsonl": lambda: jsonl(spark, path, field), "tsv": lambda: tsv(spark, path, column)}[kind]()


def unescape(text: Column | str) -> Column:
    r"""``\n``, ``\r``, ``\t`` and ``\\`` as what they stand for, from left to right; other escapes stay."""
    text = F.col(text) if isinstance(text, str) else text
    one = lambda s: F.replace(F.replace(F.replace(s, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")), F.lit("\\t"), F.lit("\t"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), one), "\\")


def escape(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    for plain, mark in (("\\", "\\\\"), ("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")):
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def parse_labels(column: Column | str) -> Column:
    """``start:end:category|...`` as an array of labels; an unknown category is null, none is wanted there."""
    column = F.col(column) if isinstance(column, str) else column
    known = F.array(*map(F.lit, CATEGORIES))
    part = lambda p: F.split(p, ":", 3)
    label = lambda p: F.struct(
        F.when(F.array_contains(known, F.get(part(p), F.lit(2))), F.get(part(p), F.lit(2))).alias("category"),
        F.get(part(p), F.lit(0)).cast("int").alias("start"), F.get(part(p), F.lit(1)).cast("int").alias("end"),
    )
    return F.when(F.coalesce(column, F.lit("")) == "", F.array().cast("array<struct<category:string,start:int,end:int>>")).otherwise(F.transform(F.split(column, r"\|"), label))


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """example_id, text and labels of an escaped corpus; a malformed label is an error."""
    rows = _numbered_lines(spark, path).withColumn("value", _bare()).where("value <> ''")
    parts = F.split("value", "\t", 2)
    return rows.select(F.col("n").alias("example_id"), unescape(F.get(parts, F.lit(0))).alias("text"), parse_labels(F.get(parts, F.lit(1))).alias("labels"))


def char_to_byte(text: Column | str, offset: Column | str) -> Column:
    """The byte offset of a place counted in characters."""
    text, offset = (F.col(c) if isinstance(c, str) else c for c in (text, offset))
    return F.octet_length(F.substr(text, F.lit(1), offset))


def vault_json(spark: SparkSession, path: str) -> DataFrame:
    """A vault (seq, category, real, fake) from a JSON array of entries."""
    entries = F.from_json("value", "array<struct<category:string,real:string,fake:string>>")
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(entries).alias("seq", "e"))
    return rows.select(F.col("seq").cast("long").alias("seq"), "e.*")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path and content of each office document or PDF of a tree."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.where(F.lower("path").rlike(r"\.(docx|pptx|xlsx|pdf)$")).select("path", "content")


def base64_text(column: Column | str) -> Column:
    """The text in base64, with U+FFFD for what isn't UTF-8; null for what isn't base64."""
    column = F.col(column) if isinstance(column, str) else column
    return F.make_valid_utf8(F.try_to_binary(column, F.lit("base64")).cast("string"))


def entity_spans(raw: DataFrame, categories: dict[str, str]) -> DataFrame:
    """text and labels (byte offsets) of rows of annotated texts: full_text, and spans with start_position, end_position,
    entity_value and entity_type, counted in characters. A type that ``categories`` lacks is a label without a category;
    a span whose value isn't what the text has there is left out."""
    known = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv]) if categories else F.create_map().cast("map<string,string>")
    right = F.filter("spans", lambda s: F.substr(F.col("full_text"), s["start_position"] + 1, s["end_position"] - s["start_position"]) == s["entity_value"])
    at = lambda n: char_to_byte(F.col("full_text"), n).cast("int")
    labels = F.transform(right, lambda s: F.struct(F.try_element_at(known, s["entity_type"]).alias("category"), at(s["start_position"]).alias("start"), at(s["end_position"]).alias("end")))
    return raw.select(F.col("full_text").alias("text"), labels.alias("labels"))
