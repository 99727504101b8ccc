"""The registered queries: each applies an operator to whole tables and returns flat columns.

Categories that the shipped texts lack come from strings made of keys and hashes, by expressions that read the same in
Spark and in DuckDB (``SYNTHETIC``).
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import predicates
from maskwright.functions import spans as S
from maskwright.operators import decode, documents, evaluate, jsonpaths, restore, vault
from maskwright.operators.detect import spread
from maskwright.operators.shared import materialize, shared_dir
from maskwright.sources import readers, sinks
from maskwright.streaming import vault_stream

#: table, key and text of synthetic inputs, as SQL that both engines read.
SYNTHETIC = {
    "cards": ("customer", "c_custkey", "'pay ' || translate(substr(md5(CAST(c_custkey AS STRING)), 1, 16), 'abcdef', '012345') || ' or ' || translate(substr(md5(c_name), 1, 4), 'abcdef', '678901') || ' 0000 0000 0000 by ' || substr(md5(c_name), 1, 8)"),
    "secrets": (
        "orders", "o_orderkey",
        """'key ' || CASE o_orderkey % 13
            WHEN 0 THEN '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || md5(CAST(o_orderkey AS STRING)) || chr(10) || '-----END RSA PRIVATE KEY-----'
            WHEN 1 THEN 'https://hooks.slack.com/services/T' || upper(substr(md5(CAST(o_orderkey AS STRING)), 1, 8)) || '/B' || upper(substr(md5(CAST(o_orderkey AS STRING)), 9, 8)) || '/' || md5(CAST(o_custkey AS STRING))
            WHEN 2 THEN 'eyJ' || substr(md5(CAST(o_orderkey AS STRING)), 1, 12) || '.' || substr(md5(CAST(o_custkey AS STRING)), 1, 7 + CAST(o_orderkey % 3 AS INT)) || '.' || md5(CAST(o_orderkey AS STRING))
            WHEN 3 THEN 'AKIA' || upper(substr(md5(CAST(o_orderkey AS STRING)), 1, 15 + CAST(o_orderkey % 2 AS INT)))
            WHEN 4 THEN 'github_pat_' || substr(md5(CAST(o_orderkey AS STRING)), 1, 22) || '_' || md5(CAST(o_orderkey AS STRING)) || substr(md5(CAST(o_custkey AS STRING)), 1, 27)
            WHEN 5 THEN 'ghp_' || md5(CAST(o_orderkey AS STRING)) || 'abcd'
            WHEN 6 THEN 'AIza' || md5(CAST(o_orderkey AS STRING)) || 'A_-'
            WHEN 7 THEN 'GOCSPX-' || substr(md5(CAST(o_orderkey AS STRING)), 1, 18 + CAST(o_orderkey % 6 AS INT))
            WHEN 8 THEN 'xoxb-' || substr(md5(CAST(o_orderkey AS STRING)), 1, 12)
            WHEN 9 THEN 'sk_test_' || substr(md5(CAST(o_orderkey AS STRING)), 1, 14 + CAST(o_orderkey % 4 AS INT))
            WHEN 10 THEN 'sk-' || md5(CAST(o_orderkey AS STRING))
            WHEN 11 THEN 'pypi-' || substr(md5(CAST(o_orderkey AS STRING)), 1, 20)
            ELSE 'Bearer ' || md5(CAST(o_orderkey AS STRING)) || '==' END || ' end'""",
    ),
    "accounts": ("customer", "c_custkey", "'acct DE' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') || ' ' || upper(substr(md5(c_name), 1, 4)) || ' ' || upper(substr(md5(c_name), 5, 4)) || ' ' || upper(substr(md5(c_name), 9, 4)) || ' 12, é ' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '-' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') || '-' || lpad(CAST(c_custkey AS STRING), 4, '0') || CASE WHEN c_custkey % 5 = 0 THEN '7' ELSE '.' END"),
    "contacts": (
        "orders", "o_orderkey",
        """'On ' || CASE o_orderkey % 4 WHEN 0 THEN substr(CAST(o_orderdate AS STRING), 1, 10) WHEN 1 THEN CAST(1 + o_orderkey % 28 AS STRING) || '/' || CAST(1 + o_orderkey % 12 AS STRING) || '/2021'
            WHEN 2 THEN 'Sept. ' || CAST(1 + o_orderkey % 28 AS STRING) || 'th, 2020' ELSE CAST(1 + o_orderkey % 28 AS STRING) || ' october 1999' END
        || ' call ' || CASE o_orderkey % 3 WHEN 0 THEN '+44 20 7946 ' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') WHEN 1 THEN '(212) 555-' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')
            ELSE '415-555-' || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') END
        || ' or write u' || CAST(o_custkey AS STRING) || '@shop.example.com, see www.shop.example/' || CAST(o_orderkey AS STRING) || ' or http://x.example/?q=' || CAST(o_custkey AS STRING)""",
    ),
}
MAIL = "text || ' write to u' || CAST(conv_id % 7 AS STRING) || '@mail.example.com or v' || CAST(turn AS STRING) || '@mail.example.com'"
LONG = "long"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def synthetic(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, key, text = SYNTHETIC[name]
    return table(spark, sf_dir, source).selectExpr(f"CAST({key} AS BIGINT) AS id", f"{text} AS text")


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text and the spans of the pattern pass, of all documents."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.withColumn("spans", F.coalesce(S.regex_spans("text"), S.no_spans()))


def span_rows(docs: DataFrame, key: str = "id", spans: str = "spans") -> DataFrame:
    # The outer form and a filter after it: for the inner one, Spark would run the scan again to see if there is a span.
    each = docs.select(key, F.posexplode_outer(spans).alias("n", "s")).where("s IS NOT NULL")
    return each.select(key, F.col("n").cast(LONG), F.col("s.category").alias("category"), F.col("s.start").cast(LONG).alias("s"), F.col("s.end").cast(LONG).alias("e"), F.col("s.text").alias("text"))


def _found(docs: DataFrame, key: str = "id") -> DataFrame:
    return span_rows(docs.withColumn("spans", S.regex_spans("text")), key)


def pii_scan(spark, sf_dir):
    return span_rows(scanned(spark, sf_dir), "doc_id")


def pii_counts_by_category(spark, sf_dir):
    rows = pii_scan(spark, sf_dir)
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n_spans"), F.countDistinct("doc_id").alias("n_docs"), F.sum(F.col("e") - F.col("s")).alias("n_bytes"))


def pii_pages_scan(spark, sf_dir):
    return _found(spread(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))))


def _synthetic_scan(name):
    return lambda spark, sf_dir: _found(synthetic(spark, sf_dir, name))


def _redacted(style):
    return lambda spark, sf_dir: scanned(spark, sf_dir).select("doc_id", S.redact("text", "spans", style).alias("redacted"))


def mask_reduction(spark, sf_dir):
    docs = scanned(spark, sf_dir).select("text", S.mask("text", "spans")["text"].alias("masked"))
    return evaluate.masked_share(docs)


def masked(spark, sf_dir):
    return scanned(spark, sf_dir).withColumn("m", S.mask("text", "spans")).withColumn("segments", F.col("m.segments")).withColumn("masked", F.col("m.text")).drop("m")


def mask_remap(spark, sf_dir):
    """Where 40 evenly spaced offsets of each masked text lie in the original."""
    docs = masked(spark, sf_dir).select("doc_id", "masked", "segments", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k"))
    pos = F.floor(F.octet_length("masked") * F.col("k") / 39).cast("int")
    docs = docs.withColumn("pos", pos)
    return docs.select("doc_id", F.col("k").cast(LONG).alias("k"), F.col("pos").cast(LONG).alias("pos"), S.remap(F.col("pos"), F.col("segments")).cast(LONG).alias("at_start"), S.remap(F.col("pos"), F.col("segments"), True).cast(LONG).alias("at_end"))


def _order_spans(spark, sf_dir):
    """Spans of each order, from its lines; all texts are the same 60 letters."""
    lines = table(spark, sf_dir, "lineitem")
    one = F.struct(
        F.when(F.col("l_suppkey") % 3 == 0, "secret").otherwise("private_person").alias("category"), (F.col("l_partkey") % 40).cast("int").alias("start"),
        (F.col("l_partkey") % 40 + 1 + F.col("l_suppkey") % 12).cast("int").alias("end"), F.lit("").alias("text"), (F.col("l_quantity") / 64).cast("float").alias("score"),
    )
    rows = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(one)).alias("spans"))
    text = F.repeat(F.lit("abcdefghij"), 6)
    return rows.select("id", text.alias("text"), F.transform("spans", lambda s: F.struct(s["category"], s["start"], s["end"], F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text"), s["score"])).alias("spans"))


def merge_overlapping(spark, sf_dir):
    docs = _order_spans(spark, sf_dir).withColumn("spans", S.merge_overlapping("spans", "text"))
    scores = docs.select("id", F.posexplode("spans").alias("n", "s"))
    return scores.select("id", F.col("n").cast(LONG), F.col("s.category").alias("category"), F.col("s.start").cast(LONG).alias("s"), F.col("s.end").cast(LONG).alias("e"), F.col("s.text").alias("text"), F.col("s.score").cast("double").alias("score"))


def combine_anti(spark, sf_dir):
    """Documents' patterns combined with spans laid every 200 bytes over the masked text, of three lengths."""
    docs = materialize(masked(spark, sf_dir), "masked")
    places = F.sequence(F.lit(0), F.greatest(F.octet_length("masked") - 1, F.lit(0)), F.lit(200))
    model = F.transform(places, lambda p: F.struct(F.lit("private_person").alias("category"), p.alias("start"), (p + 5 + (p / 200).cast("int") % 3 * 20).alias("end"), F.lit("").alias("text"), F.lit(0.5).cast("float").alias("score")))
    docs = docs.withColumn("model", F.filter(model, lambda m: m["end"] <= F.octet_length("masked")))
    return span_rows(docs.withColumn("both", S.combine("text", "spans", "model", "segments")), "doc_id", "both").drop("text")


def vault_first_seen(spark, sf_dir):
    return vault.build(vault.values(vault.placed(scanned(spark, sf_dir), ["doc_id"]), ["doc_id"])).select("seq", "category", "real")


def anonymize_documents(spark, sf_dir):
    out, _ = vault.anonymize_corpus(scanned(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", "anonymized", F.size("placements").cast(LONG).alias("n_placements"))


def anonymize_subs(spark, sf_dir):
    out, _ = vault.anonymize_corpus(scanned(spark, sf_dir), ["doc_id"])
    return out.where("size(subs) > 0").select("doc_id", F.posexplode("subs").alias("n", "x")).select("doc_id", F.col("n").cast(LONG), F.col("x.real").alias("real"), F.col("x.fake").alias("fake"))


def deanonymize_roundtrip(spark, sf_dir):
    out, entries = vault.anonymize_corpus(scanned(spark, sf_dir), ["doc_id"])
    back = restore.restore(out, entries, ["doc_id"])
    return back.select("doc_id", F.md5(F.col("restored").cast("binary")).alias("restored_md5"))


def restore_plan(spark, sf_dir):
    """How many surrogates each anonymized document holds; none is left in those that are restored."""
    out, entries = vault.anonymize_corpus(scanned(spark, sf_dir), ["doc_id"])
    return restore.restore_plan(out, entries, ["doc_id"]).withColumn("n_entries", F.col("n_entries").cast(LONG))


def restore_longest_prefix(spark, sf_dir):
    entries = spark.range(1, 1501).select(F.col("id").alias("seq"), F.lit("secret").alias("category"), F.concat(F.lit("R"), "id", F.lit("!")).alias("real"), F.concat(F.lit("fk"), "id").alias("fake"))
    docs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("fk"), "l_partkey", F.lit("é fkfk"), "l_suppkey"))), " ").alias("anonymized"))
    return restore.restore(docs, entries, ["l_orderkey"]).select("l_orderkey", "restored")


def vault_cap(spark, sf_dir):
    entries = materialize(vault.build(vault.values(vault.placed(scanned(spark, sf_dir), ["doc_id"]), ["doc_id"])), "vault")
    kept, gone = vault.cap(entries, 10)
    mark = lambda df, name: df.select("seq", "category", "real", F.lit(name).alias("state"))
    return mark(kept, "kept").unionByName(mark(gone, "gone"))


def vault_resume(spark, sf_dir):
    """The vault of all pages, and after it what documents add."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))).withColumn("spans", S.regex_spans("text"))
    first = materialize(vault.build(vault.values(vault.placed(pages, ["page_id"]), ["page_id"])), "vault")
    both = vault.build(vault.values(vault.placed(scanned(spark, sf_dir), ["doc_id"]), ["doc_id"]), existing=first)
    return both.select("seq", "category", "real")


def vault_export(spark, sf_dir):
    """The vault as lines of JSON, in order."""
    entries = materialize(vault.build(vault.values(vault.placed(scanned(spark, sf_dir), ["doc_id"]), ["doc_id"])), "vault")
    return sinks.vault_lines(entries).select(F.col("ord").cast(LONG).alias("ord"), "line")


def _labelled(spark, sf_dir):
    """Documents with spans, and labels made of them: moved for odd documents, of no category for each fourth."""
    move = (F.col("doc_id") % 2) * 6
    labels = F.transform("spans", lambda s, i: F.struct(F.when((F.col("doc_id") + i) % 4 != 0, s["category"]).alias("category"), (s["start"] + move).cast("int").alias("start"), (s["start"] + move + 5).cast("int").alias("end")))
    extra = F.array(F.struct(F.lit("private_person").alias("category"), F.lit(0).alias("start"), F.lit(4).alias("end")))
    return scanned(spark, sf_dir).withColumn("labels", F.concat(labels, extra))


def eval_counts(spark, sf_dir):
    scores = evaluate.report(_labelled(spark, sf_dir))
    number = lambda c: F.when(F.isnan(c), None).otherwise(F.round(c, 9)).alias(c)
    return scores.select("category", "gold", "matched", "good", "fp", *[number(c) for c in ("precision", "recall", "f1")])


def eval_table(spark, sf_dir):
    return evaluate.table_lines(evaluate.report(_labelled(spark, sf_dir))).select(F.col("ord").cast(LONG).alias("ord"), "line")


def token_windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", r"\s+")).alias("n"))
    rows = docs.select("doc_id", F.explode(decode.windows("n")).alias("w"))
    size = F.col("w.tok_end") - F.col("w.tok_start")
    return rows.select("doc_id", *[F.col(f"w.{c}").cast(LONG).alias(c) for c in ("win", "tok_start", "tok_end")], decode.rows_per_batch(size).cast(LONG).alias("batch_rows"), decode.padded_length(size).cast(LONG).alias("padded"))


def _scored_tokens(spark, sf_dir):
    """A token of three bytes for each line of an order, with four scores; every fifth supplier's token has no bytes."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("q"), F.max("l_quantity").cast(LONG).alias("r"))
    scores = F.transform(F.array(F.col("p") % 4, F.col("q") % 4, F.col("r") % 4, (F.col("p") + F.col("r")) % 3), lambda x: x.cast("double"))
    rows = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("tok_idx"), F.when(F.col("q") % 5 == 0, 0).otherwise(3).alias("n_bytes"), scores.alias("logits"))
    tokens = decode.token_offsets(rows)
    docs = tokens.groupBy("doc_id").agg(F.expr("repeat(' ab', cast(max(b1) / 3 as int))").alias("text"))
    return tokens, docs


def decode_spans(spark, sf_dir, min_score=0.0):
    tokens, docs = _scored_tokens(spark, sf_dir)
    found = decode.decode(tokens, docs, [None, "secret", "private_person", "private_person"], min_score)
    rows = found.select("doc_id", F.posexplode("spans").alias("n", "s"))
    return rows.select("doc_id", F.col("n").cast(LONG), F.col("s.category").alias("category"), F.col("s.start").cast(LONG).alias("s"), F.col("s.end").cast(LONG).alias("e"), F.col("s.text").alias("text"), F.round(F.col("s.score").cast("double"), 4).alias("score"))


def min_score_filter(spark, sf_dir):
    return decode_spans(spark, sf_dir, 0.4321)


ESCAPED = r"'a' || chr(92) || CASE o_orderkey % 5 WHEN 0 THEN 'n' WHEN 1 THEN 't' WHEN 2 THEN chr(92) WHEN 3 THEN 'q' ELSE 'r' END || o_orderpriority || chr(92) || chr(92) || 'n' || chr(92)"


def tsv_unescape(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{ESCAPED} AS t")
    return rows.select("o_orderkey", F.md5(readers.unescape("t").cast("binary")).alias("plain_md5"), F.md5(readers.escape("t").cast("binary")).alias("escaped_md5"))


def char_to_byte(spark, sf_dir):
    """The byte offsets of every hundredth character of each document, to its end."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    places = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text"), F.lit(100))).alias("at"))
    return places.select("doc_id", F.col("at").cast(LONG).alias("at"), readers.char_to_byte("text", F.col("at")).cast(LONG).alias("byte"))


def json_string_leaves(spark, sf_dir):
    """String leaves of events wrapped with their type, with what the path predicate says."""
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"messages":[{"kind":"'), "event_type", F.lit('","props":'), "props", F.lit('}],"id":"e'), "event_id", F.lit('"}')).alias("j"))
    out = jsonpaths.leaves(rows, "event_id", "j")
    return out.select("event_id", F.array_join("path", "/").alias("path"), "value", predicates.is_content_path("path").alias("content"))


def json_write_back(spark, sf_dir):
    """The same JSON with upper-case types put back at their paths; numbers stay numbers."""
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"messages":[{"kind":"'), "event_type", F.lit('","value":'), F.col("value").cast("int"), F.lit("}]}")).alias("j"))
    changed = jsonpaths.leaves(rows, "event_id", "j").select("event_id", "path", F.upper("value").alias("value"))
    return jsonpaths.write_back(rows, changed, "event_id", "j")


def prose_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", predicates.looks_like_prose("text").alias("prose"), predicates.is_blank("text").alias("blank"))
    return docs


def scan_report(spark, sf_dir):
    return scanned(spark, sf_dir).select("doc_id", sinks.report_lines().alias("report"))


def jsonl_reframe(spark, sf_dir):
    """Each document's whole redacted text in the envelope that it came in."""
    docs = scanned(spark, sf_dir).select("doc_id", F.concat(F.lit('{"z":1.5,"text":"old","doc":'), "doc_id", F.lit("}")).alias("raw"), S.redact("text", "spans").alias("new"))
    return sinks.reframe(docs, "raw", "new").select("doc_id", "line")


def source_lines(spark, sf_dir):
    """Documents written as escaped lines and read again, by number."""
    path = shared_dir(spark, "lines")
    sinks.write_lines(table(spark, sf_dir, "documents").select("doc_id", readers.escape("text").alias("line")), path, "doc_id", "line")
    return readers.read(spark, path).select(F.col("id").cast(LONG).alias("id"), F.md5(readers.unescape("text").cast("binary")).alias("text_md5"))


def source_jsonl(spark, sf_dir):
    path = shared_dir(spark, "jsonl")
    sinks.write_lines(table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", "text")).alias("line")), path, "doc_id", "line")
    out = readers.read(spark, path, "jsonl")
    return out.select(F.col("id").cast(LONG).alias("id"), F.md5(F.col("text").cast("binary")).alias("text_md5"), F.get_json_object("raw", "$.doc_id").cast(LONG).alias("doc_id"))


def source_tsv(spark, sf_dir):
    path = shared_dir(spark, "tsv")
    sinks.write_lines(table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("\t", "c_custkey", "c_name", "c_mktsegment").alias("line")), path, "c_custkey", "line")
    return readers.read(spark, path, "tsv", column=1).select(F.col("id").cast(LONG).alias("id"), "text")


def source_delimited(spark, sf_dir):
    """Customers' names in one file with a delimiter of two characters."""
    path = shared_dir(spark, "delimited")
    table(spark, sf_dir, "customer").orderBy("c_custkey").select("c_name").coalesce(1).write.option("lineSep", "|#").text(path)
    part = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").first()[0]
    return readers.read(spark, part, delimiter="|#").select(F.col("id").cast(LONG).alias("id"), "text")


def source_files(spark, sf_dir):
    """A file for each nation in a tree by region, written and read again."""
    path = shared_dir(spark, "tree")
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey", F.lit("/"), "n_name", F.lit(".txt")).alias("id"), F.concat("n_name", F.lit("\nline é")).alias("text"))
    materialize(sinks.write_tree(rows, path), "written")
    return readers.read(spark, path, is_dir=True).select("id", "text")


def labelled_corpus(spark, sf_dir):
    """Documents and their spans written as a labelled corpus, read again and scored against the pattern pass."""
    path = shared_dir(spark, "labelled")
    mark = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"], s["category"])), "|")
    sinks.write_lines(scanned(spark, sf_dir).select("doc_id", F.concat_ws("\t", readers.escape("text"), mark).alias("line")), path, "doc_id", "line")
    examples = readers.labelled(spark, path).withColumn("spans", F.coalesce(S.regex_spans("text"), S.no_spans()))
    return evaluate.report(examples).select("category", "gold", "matched", "good", "fp")


def _conversations(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{MAIL} AS text")
    return rows.withColumn("spans", S.regex_spans("text"))


def conversation_anonymize(spark, sf_dir):
    """Each conversation with a vault of its own."""
    out, _ = vault.anonymize_corpus(_conversations(spark, sf_dir), ["conv_id", "turn"], ["conv_id"])
    return out.select("conv_id", "turn", "anonymized")


def _docx(text: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        a, b = text[: len(text) // 2], text[len(text) // 2 :]
        z.writestr("word/document.xml", f"<w:document><w:p><w:r><w:t>{a}</w:t></w:r><w:r><w:t>{b}</w:t></w:r></w:p></w:document>")
        z.writestr("docProps/core.xml", "<p><dc:creator>someone</dc:creator></p>")
    return out.getvalue()


def _made(spark, sf_dir, kind):
    """A document for each supplier, with an address and a date in it."""

    def run(batches):
        import pyarrow as pa

        make = _docx if kind == "docx" else documents.make_pdf
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([make(t) for t in batch.column(1).to_pylist()], pa.binary())], names=["path", "content"])

    rows = table(spark, sf_dir, "supplier").selectExpr(f"concat('s', s_suppkey, '.{kind}') AS path", "concat('Write to s', s_suppkey, '@shop.example.com on 2020-01-', lpad(CAST(1 + s_suppkey % 28 AS STRING), 2, '0'), '.') AS text")
    return materialize(rows.mapInArrow(run, "path string, content binary"), "made")


def _rewritten(kind):
    def query(spark, sf_dir):
        out, _ = documents.anonymize_documents(_made(spark, sf_dir, kind))
        out = materialize(out, "rewritten")
        return documents.extract(out).join(out.select("path", "n_placements"), "path").select("path", F.trim(F.regexp_replace("text", "\n$", "")).alias("text"), F.col("n_placements").cast(LONG).alias("n_placements"))

    return query


def _streamed(spark, name: str, stream: DataFrame) -> DataFrame:
    path, at = shared_dir(spark, name), shared_dir(spark, f"{name}-checkpoint")
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def stream_vault(spark, sf_dir):
    """Every turn of every conversation as a command to its conversation's vault."""
    rows = _conversations(spark, sf_dir).select(
        F.col("conv_id").cast("string").alias("vault_id"), F.col("turn").cast("string").alias("req_id"), F.lit("anonymize").alias("op"), "text", F.col("turn").cast("double").alias("at"), "spans"
    )
    path = shared_dir(spark, "commands")
    rows.write.parquet(path)
    answers = _streamed(spark, "answers", vault_stream.vault_commands(spark.readStream.schema(rows.schema).parquet(path)))
    return answers.select(F.col("vault_id").cast(LONG).alias("conv_id"), F.col("req_id").cast(LONG).alias("turn"), F.col("text").alias("anonymized"), "outcome")


PAIRS = [(f"sk-fake-{i}", f"KEY{i}") for i in range(200)]


def stream_restore(spark, sf_dir):
    """Texts with surrogates, cut into pieces of nine characters, restored piece by piece and joined again."""
    rows = table(spark, sf_dir, "orders").selectExpr("CAST(o_custkey AS STRING) AS stream_id", "o_orderkey AS k", "concat('pay sk-fake-', o_orderkey % 250, ' now; ') AS text")
    whole = rows.groupBy("stream_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(k, text))), x -> x.text), '')").alias("text"))
    cut = whole.select("stream_id", F.posexplode(F.expr("transform(sequence(0, cast((length(text) - 1) / 9 as int)), i -> struct(substr(text, 9 * i + 1, 9) AS text, i = cast((length(text) - 1) / 9 as int) AS last))")).alias("seq", "p"))
    cut = cut.select("stream_id", F.col("seq").cast(LONG).alias("seq"), "p.text", "p.last")
    path = shared_dir(spark, "pieces")
    cut.write.parquet(path)
    out = _streamed(spark, "restored", vault_stream.restore_stream(spark.readStream.schema(cut.schema).parquet(path), PAIRS))
    return out.groupBy("stream_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(seq, text))), x -> x.text), '')").alias("restored"))


def stream_outcomes(spark, sf_dir):
    return vault_stream.outcome_counts(stream_vault(spark, sf_dir).withColumn("op", F.lit("anonymize")))


QUERIES = {
    "pii_scan": pii_scan, "pii_counts_by_category": pii_counts_by_category, "pii_pages_scan": pii_pages_scan,
    "luhn_cards": _synthetic_scan("cards"), "secret_patterns": _synthetic_scan("secrets"), "iban_ssn": _synthetic_scan("accounts"),
    "date_phone_variants": _synthetic_scan("contacts"), "redact_label": _redacted("label"), "redact_block": _redacted("block"), "redact_char": _redacted("char"),
    "mask_reduction": mask_reduction, "mask_remap": mask_remap, "merge_overlapping": merge_overlapping, "combine_anti": combine_anti,
    "vault_first_seen": vault_first_seen, "anonymize_documents": anonymize_documents, "anonymize_subs": anonymize_subs, "deanonymize_roundtrip": deanonymize_roundtrip,
    "restore_plan": restore_plan, "restore_longest_prefix": restore_longest_prefix, "vault_cap": vault_cap, "vault_resume": vault_resume, "vault_export": vault_export,
    "eval_counts": eval_counts, "eval_table": eval_table, "token_windows": token_windows, "decode_spans": decode_spans, "min_score_filter": min_score_filter,
    "tsv_unescape": tsv_unescape, "char_to_byte": char_to_byte, "json_string_leaves": json_string_leaves, "json_write_back": json_write_back,
    "prose_filter": prose_filter, "scan_report": scan_report, "jsonl_reframe": jsonl_reframe, "source_lines": source_lines, "source_jsonl": source_jsonl,
    "source_tsv": source_tsv, "source_delimited": source_delimited, "source_files": source_files, "labelled_corpus": labelled_corpus,
    "conversation_anonymize": conversation_anonymize, "ooxml_rewrite": _rewritten("docx"), "pdf_rewrite": _rewritten("pdf"),
    "stream_vault": stream_vault, "stream_restore": stream_restore, "stream_outcomes": stream_outcomes,
}
