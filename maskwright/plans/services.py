"""Registered queries for detectors, vault services, documents' parts, requests and stores."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import predicates
from maskwright.functions import spans as S
from maskwright.functions.surrogates import surrogate
from maskwright.operators import decode, detect, documents, evaluate, jsonpaths, restore, vault
from maskwright.operators.shared import materialize, shared_dir
from maskwright.plans import queries as Q
from maskwright.sources import readers, sinks
from maskwright.streaming import vault_stream

LONG = "long"


def _long(c: str):
    return F.col(c).cast(LONG).alias(c)


# ---- detectors


def _fours():
    """Tokens of four bytes, without meaning."""
    return lambda text: [(0, min(4, len(text.encode()) - i)) for i in range(0, len(text.encode()), 4)]


def _every_third():
    """A made model: of each three tokens the second is a person's name, with a chance of e / (1 + e)."""

    def run(ids, mask):
        import numpy as np

        out = np.zeros((*ids.shape, 2))
        out[:, :, 0], out[:, 1::3, 0], out[:, 1::3, 1] = 1, 0, 1
        return out

    return run


PERSON = [None, "private_person"]


def _contacts(spark, sf_dir) -> DataFrame:
    return Q.synthetic(spark, sf_dir, "contacts").withColumnRenamed("id", "doc_id")


def _rows(found: DataFrame) -> DataFrame:
    # The outer form and a filter after it: for the inner one, Spark would make the spans again to see if there is one.
    rows = found.select("doc_id", F.posexplode_outer("spans").alias("n", "s")).where("s IS NOT NULL")
    return rows.select("doc_id", _long("n"), F.col("s.category").alias("category"), F.col("s.start").cast(LONG).alias("s"), F.col("s.end").cast(LONG).alias("e"), F.col("s.text").alias("text"), F.round(F.col("s.score").cast("double"), 4).alias("score"))


def hybrid_detection(spark, sf_dir):
    """Patterns first, a made token model on the masked texts, both combined: the reference's default path."""
    return _rows(detect.with_spans(_contacts(spark, sf_dir), detect.hybrid_detector(detect.model_detector(_fours, _every_third, PERSON))).select("doc_id", "spans"))


def hybrid_detection_sure(spark, sf_dir):
    """The same with a threshold that the model's spans miss: only patterns are left."""
    return _rows(detect.hybrid_detector(detect.model_detector(_fours, _every_third, PERSON), 0.9)(_contacts(spark, sf_dir)))


def serving_threshold(spark, sf_dir):
    """A request's threshold over all spans, the server's where it names none."""
    found = materialize(detect.hybrid_detector(detect.model_detector(_fours, _every_third, PERSON))(_contacts(spark, sf_dir)), "hybrid")
    strict = detect.above(found.where("doc_id % 2 = 0"), 0.9, 0.0)
    return _rows(strict.unionByName(detect.above(found.where("doc_id % 2 = 1"), None, 0.5)))


def model_detection(spark, sf_dir):
    """The model alone, on texts that are no masks."""
    return _rows(detect.model_detector(_fours, _every_third, PERSON)(_contacts(spark, sf_dir)))


def _by_place():
    """A made model on tokens whose id is their place in the text: runs of 25 in 50, of either category by turns."""

    def run(ids, mask):
        import numpy as np

        out = np.zeros((*ids.shape, 3))
        kind = np.where(ids % 50 < 25, np.where(ids % 100 < 50, 1, 2), 0)
        np.put_along_axis(out, kind[:, :, None], 1.0 + (ids % 7)[:, :, None] / 8, axis=2)
        return out

    return run


def _placed():
    return lambda text: [(i, 1) for i in range(len(text))]


def window_merging(spark, sf_dir):
    """Texts of 3,000 letters and more in overlapping windows: spans that a window's end cuts are one again."""
    docs = Q.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr("repeat('abcde', cast(600 + c_custkey % 300 as int))").alias("text"))
    return _rows(detect.model_detector(_placed, _by_place, [None, "secret", "private_person"])(docs)).drop("score")


def evaluated_detector(spark, sf_dir):
    """A detector scored against labels: here each text's e-mail address and a label that counts neither way."""
    docs = _contacts(spark, sf_dir)
    at = F.octet_length(F.substring_index("text", " or write ", 1)) + 10
    label = F.struct(F.lit("private_email").alias("category"), at.cast("int").alias("start"), (at + 5).cast("int").alias("end"))
    spare = F.struct(F.lit(None).cast("string").alias("category"), F.lit(0).alias("start"), F.lit(12).alias("end"))
    scores = evaluate.evaluate(docs.withColumn("labels", F.array(label, spare)), detect.regex_detector())
    return scores.select("category", "gold", "matched", "good", "fp")


def label_ids(spark, sf_dir):
    """Label ids of a model's config.json and their categories."""
    config = json.dumps({"id2label": {"0": "O", "1": "B-secret", "2": "I-secret", "3": "B-private_person", "4": "E-private_url"}})
    return spark.createDataFrame(list(enumerate(detect.labels_of(config))), "id long, category string")


# ---- vaults


def surrogate_kinds(spark, sf_dir):
    """A surrogate of each category for each customer's name."""
    kinds = F.explode(F.array(*map(F.lit, ("account_number", "private_address", "private_date", "private_email", "private_person", "private_phone", "private_url", "secret"))))
    rows = Q.table(spark, sf_dir, "customer").select("c_custkey", "c_name", kinds.alias("category"))
    return rows.select("c_custkey", "category", surrogate(F.col("category"), F.col("c_name"), F.lit(0)).alias("fake"))


def vault_collisions(spark, sf_dir):
    """More dates than there are first choices for them: all surrogates differ, and most are dates still."""
    rows = Q.table(spark, sf_dir, "orders").select(F.lit("private_date").alias("category"), F.concat(F.lit("d"), "o_orderkey").alias("real"), F.struct("o_orderkey").alias("first"))
    out = vault.build(rows)
    return out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fake").alias("n_fakes"), F.sum(F.col("fake").rlike(r"^(19|20)\d\d-(0\d|1[0-2])-[0-2]\d$").cast(LONG)).alias("n_dates"), F.max("seq").alias("last"))


def anonymize_missing_keys(spark, sf_dir):
    """Documents of which two thirds lack an id or share it: none keeps a value that was found in it."""
    docs = Q.scanned(spark, sf_dir).withColumn("key", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, 1).otherwise(F.col("doc_id")))
    out, _ = vault.anonymize_corpus(docs, ["key"])
    return out.select("doc_id", F.md5(F.col("anonymized").cast("binary")).alias("anonymized_md5"))


def vault_json(spark, sf_dir):
    """The vault as a JSON array, written and read again."""
    entries = materialize(vault.build(vault.values(vault.placed(Q.scanned(spark, sf_dir), ["doc_id"]), ["doc_id"])), "vault")
    path = shared_dir(spark, "vault-json")
    sinks.vault_lines(entries).orderBy("ord").select("line").coalesce(1).write.text(path)  # one file, as the array is
    return readers.vault_json(spark, path).select("seq", "category", "real")


def stored_vault(spark, sf_dir):
    """A vault stored twice; the later one is loaded."""
    entries = materialize(vault.build(vault.values(vault.placed(Q.scanned(spark, sf_dir), ["doc_id"]), ["doc_id"])), "vault")
    path = shared_dir(spark, "stored-vault")
    sinks.save_vault(entries.where("seq < 3"), path)
    sinks.save_vault(entries, path)
    return sinks.load_vault(spark, path).select("seq", "category", "real")


def anonymized_before(spark, sf_dir):
    """Documents and their anonymized copies: those without a surrogate in them are left for anonymizing."""
    docs = Q.scanned(spark, sf_dir)
    out, entries = vault.anonymize_corpus(docs, ["doc_id"])
    both = out.select(F.concat(F.lit("a"), "doc_id").alias("id"), F.col("anonymized").alias("text")).unionByName(docs.select(F.concat(F.lit("d"), "doc_id").alias("id"), "text"))
    return restore.without_surrogates(both, entries, ["id"]).select("id")


def run_summary(spark, sf_dir):
    out, entries = vault.anonymize_corpus(Q.scanned(spark, sf_dir), ["doc_id"])
    return sinks.summary(out, entries)


def combined_json(spark, sf_dir):
    """Each conversation's turn with its substitutions as one JSON object."""
    out, _ = vault.anonymize_corpus(Q._conversations(spark, sf_dir), ["conv_id", "turn"], ["conv_id"])
    one = F.transform("subs", lambda s: F.struct(s["real"].alias("real"), s["fake"].alias("fake")))
    return out.select("conv_id", "turn", F.md5(sinks.combined(F.lit("x"), one).cast("binary")).alias("json_md5"))


def vault_service(spark, sf_dir):
    """Every kind of command, to a vault of each conversation: anonymize, restore, undo, undo again, anonymize, a late undo,
    a refused one, snapshot, clear and snapshot."""
    rows = Q._conversations(spark, sf_dir).where("turn = 0")
    anonymized = vault.anonymize_corpus(rows, ["conv_id"], ["conv_id"])[0].select("conv_id", "text", "anonymized", "spans")
    anonymized = materialize(anonymized, "first-turns")
    none = S.no_spans()
    steps = [
        ("anonymize", "text", 0, F.col("spans")), ("restore", "anonymized", 1, none), ("undo", "text", 2, none), ("undo", "text", 3, none), ("anonymize", "text", 10, F.col("spans")),
        ("undo", "text", 11, none), ("undo", "anonymized", 311, none), ("restore", "text", 320, none), ("snapshot", "text", 330, none), ("clear", "text", 340, none), ("snapshot", "text", 350, none), ("turn", "text", 360, none),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(op).alias("op"), F.col(text).alias("said"), F.lit(float(at)).alias("at"), spans.alias("found")) for i, (op, text, at, spans) in enumerate(steps)]))
    commands = anonymized.select("conv_id", each.alias("c")).select(F.col("conv_id").cast("string").alias("vault_id"), F.lpad(F.col("c.i").cast("string"), 2, "0").alias("req_id"), F.col("c.op").alias("op"), F.col("c.said").alias("text"), F.col("c.at").alias("at"), F.col("c.found").alias("spans"))
    path = shared_dir(spark, "commands")
    commands.write.parquet(path)
    answers = Q._streamed(spark, "answers", vault_stream.vault_commands(spark.readStream.schema(commands.schema).parquet(path)))
    return answers.select(F.col("vault_id").cast(LONG).alias("conv_id"), F.col("req_id").cast(LONG).alias("step"), "op", "outcome", F.md5(F.col("text").cast("binary")).alias("text_md5"), _long("count"), _long("removed"))


def vault_replica(spark, sf_dir):
    """Copies of vaults from snapshots, deltas and clearings, as clients keep them."""
    rows = Q.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("q"))
    kind = F.when(F.col("l_linenumber") == 1, "snapshot").when(F.col("p") % 7 == 0, "clear").when(F.col("p") % 5 == 0, "snapshot").otherwise("delta")
    pair = lambda f, r: F.struct(F.concat(F.lit("f"), f % 9).alias("fake"), F.concat(F.lit("r"), r).alias("real"))
    pairs = F.when(F.col("q") % 3 == 0, F.array().cast("array<struct<fake:string,real:string>>")).otherwise(F.array(pair(F.col("p"), F.col("q"))))
    out = vault_stream.replica(rows.select(F.col("l_orderkey").alias("vault_id"), F.col("l_linenumber").alias("seq"), kind.alias("kind"), pairs.alias("pairs")))
    entries = F.array_sort(F.transform(F.map_entries("pairs"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return out.select("vault_id", F.array_join(entries, " ").alias("held"))


# ---- documents

_TAGS = {"pptx": ("a:t", "a:p"), "xlsx": ("t", "si"), "docx": ("w:t", "w:p")}


def _part(kind: str, text: str) -> str:
    t, p = _TAGS[kind]
    return f"<x><{p}><r><{t}>{text}</{t}></r></{p}></x>"


def _office(kind: str, text: str) -> bytes:
    """An address in each of the parts that can hold text, and an author."""
    names = {
        "pptx": ["ppt/slides/slide10.xml", "ppt/slides/slide2.xml", "ppt/notesSlides/notesSlide1.xml"], "xlsx": ["xl/sharedStrings.xml"],
        "docx": ["word/document.xml", "word/header1.xml", "word/footer1.xml", "word/comments.xml", "word/footnotes.xml", "word/endnotes.xml"],
    }[kind]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, name in enumerate(names):
            z.writestr(name, _part(kind, f"p{i} {text}"))
        z.writestr("ppt/media/image1.png" if kind == "pptx" else "xl/media/image1.png", b"\x89PNG\x00\xff")
        z.writestr(f"{kind}/charts/chart1.xml", f"<c><v>chart {text}</v></c>")
        z.writestr(f"{kind}/diagrams/data1.xml", f'<d><e descr="alt {text}"/></d>')
        z.writestr("docProps/core.xml", "<p><dc:creator>someone</dc:creator><cp:lastModifiedBy>else</cp:lastModifiedBy></p>")
        z.writestr("docProps/app.xml", b"<p><Manager>m\xe9</Manager><Company>c</Company></p>")
    return out.getvalue()


def _parts(kind: str):
    """Each text of the rewritten documents' parts in order, and whether authors are gone and other entries the same."""

    def query(spark, sf_dir):
        def make(batches):
            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_office(kind, t) for t in batch.column(1).to_pylist()], pa.binary())], names=["path", "content"])

        def clean(batches):
            import pyarrow as pa

            for batch in batches:
                out = []
                for content in batch.column(1).to_pylist():
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        meta = z.read("docProps/core.xml") + z.read("docProps/app.xml")
                        image = next(z.read(n) for n in z.namelist() if n.endswith(".png"))
                    out.append(meta == b"<p><dc:creator></dc:creator><cp:lastModifiedBy></cp:lastModifiedBy></p><p><Manager></Manager><Company></Company></p>" and image == b"\x89PNG\x00\xff")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["path", "clean"])

        rows = Q.table(spark, sf_dir, "supplier").selectExpr(f"concat('s', s_suppkey, '.{kind}') AS path", "concat('to s', s_suppkey, '@shop.example.com') AS text")
        made = materialize(rows.mapInArrow(make, "path string, content binary"), "made")
        out = materialize(documents.anonymize_documents(made)[0], "rewritten")
        texts = documents.extract(out).select("path", F.posexplode(F.filter(F.split("text", "\n"), lambda t: t != "")).alias("n", "text"))
        checked = out.select("path", "content").mapInArrow(clean, "path string, clean boolean")
        return texts.join(checked, "path").select("path", _long("n"), "text", "clean")

    return query


# ---- requests


def upload_routes(spark, sf_dir):
    names = Q.table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        "concat('f', p_partkey, element_at(array('.DOCX', '.pdf', '.tex', '.py', '.ini', '.png', '', '.Markdown', '.scss', '.exe'), cast(1 + p_partkey % 10 as int))) AS name",
        "element_at(array('text/plain', 'application/json', 'application/octet-stream', 'image/png', 'application/X-YAML', null, 'application/toml'), cast(1 + p_partkey % 7 as int)) AS mime",
    )
    return names.select("p_partkey", predicates.upload_kind("name", "mime").alias("kind"))


ROUTES = [("english", "GET", r"\.example\.com/en/"), ("net", "GET", r"\.example\.net/"), ("posted", "POST", "")]


def url_routes(spark, sf_dir):
    """The route, the parameter page and the same URL with another of each page."""
    url = F.col("url")
    return Q.table(spark, sf_dir, "pages").select(
        "page_id", predicates.url_route(url, ROUTES, F.when(F.col("page_id") % 5 == 0, "post").otherwise("get")).alias("route"), predicates.query_param(url, "page").alias("page"),
        predicates.with_query_param(url, "page", F.lit("a b&$1")).alias("changed"),
    )


def request_origins(spark, sf_dir):
    rows = Q.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "element_at(array('https://chat.example.com', 'http://localhost:3000', 'https://chat.example.com.evil', null, 'ext://abc'), cast(1 + c_custkey % 5 as int)) AS origin",
        "translate(md5(cast(c_custkey AS string)), '0123456789', if(c_custkey % 3 = 0, 'ghijklmnop', 'ghijklmno9')) AS id",
    )
    return rows.select("c_custkey", predicates.origin_allowed("origin", ["http://localhost:", "ext://"], ["https://chat.example.com"]).alias("allowed"), predicates.extension_id("id").alias("extension"))


def request_bodies(spark, sf_dir):
    """The prose of each request under a name for texts: of five such strings the last four; and whether it is long enough."""
    rows = Q.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        """concat('{"id":"x y z x y z", "messages":[', array_join(transform(sequence(1, cast(o_orderkey % 7 as int) + 1), i -> concat('{"text":"message ', i, ' of order ', o_orderkey, '"}')), ','), ']}') AS j""",
    )
    out = jsonpaths.content_leaves(rows.where(predicates.worth_reading("j")), "o_orderkey", "j")
    return out.select("o_orderkey", F.array_join("path", "/").alias("path"), "value")


def nested_json(spark, sf_dir):
    """A message within JSON within JSON, taken out and put back in upper case."""
    rows = Q.table(spark, sf_dir, "orders").selectExpr("o_orderkey", """if(o_orderkey % 10 = 0, '[null,3]', concat('[null,"[[', chr(92), '"order ', o_orderkey, chr(92), '"],1]",2]')) AS j""")
    rows = rows.withColumn("m", F.upper(jsonpaths.nested_string("j", 1, 0, 0)))
    return rows.select("o_orderkey", "m", jsonpaths.put_nested("j", "m", 1, 0, 0).alias("j"))


# ---- sources and sinks


def scan_lines(spark, sf_dir):
    """The JSON line of each scanned text."""
    docs = Q.synthetic(spark, sf_dir, "contacts").withColumn("spans", S.regex_spans("text"))
    return docs.select("id", sinks.scan_line().alias("line"))


def skipped_records(spark, sf_dir):
    """JSON lines of which some are blank and some broken: what is read, and what is left out and why."""
    path = shared_dir(spark, "jsonl")
    line = F.when(F.col("o_orderkey") % 10 == 0, "").when(F.col("o_orderkey") % 10 == 1, "{bad").otherwise(F.to_json(F.struct(F.col("o_orderpriority").alias("text"))))
    sinks.write_lines(Q.table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line")), path, "o_orderkey", "line")
    out = readers.skipped(spark, path, "jsonl")
    return out.unionByName(readers.read(spark, path, "jsonl").agg(F.lit("read").alias("reason"), F.count(F.lit(1)).alias("n")))


def byte_order_mark(spark, sf_dir):
    """A file that begins with a mark of byte order: its first line has none, in any format."""
    path = shared_dir(spark, "marked")
    rows = Q.table(spark, sf_dir, "customer")
    line = F.concat(F.when(F.col("c_custkey") == rows.agg(F.min("c_custkey")).first()[0], "\ufeff").otherwise(""), "c_name")
    rows.select("c_custkey", line.alias("line")).orderBy("c_custkey").select("line").coalesce(1).write.text(path)
    return readers.read(spark, path).select(F.col("id").cast(LONG).alias("id"), "text")


def source_formats(spark, sf_dir):
    """What a path is read as."""
    cases = [("a.jsonl", None, False), ("a.NDJSON", None, False), ("a.tsv", None, False), ("a.txt", None, False), ("folder", None, True), ("a.tsv", "lines", False), (None, None, False)]
    return spark.createDataFrame([(i, readers.resolve_format(*c)) for i, c in enumerate(cases)], "id long, kind string")


def any_frame(spark, sf_dir):
    """Records of a table as it is."""
    return readers.records(Q.table(spark, sf_dir, "nation"), "n_nationkey", "n_name").select("id", "text")


def base64_texts(spark, sf_dir):
    """Texts in base64, of which some are no base64."""
    docs = Q.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    data = F.when(F.col("doc_id") % 5 == 0, F.lit("*")).otherwise(F.base64(F.col("text").cast("binary")))
    return docs.select("doc_id", F.md5(readers.base64_text(data).cast("binary")).alias("text_md5"))


def entity_labels(spark, sf_dir):
    """Annotated texts with offsets in characters, as labels with offsets in bytes."""
    rows = Q.table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey", "concat('é from ', n_name, ' ü ', n_nationkey) AS full_text",
        "array(named_struct('start_position', 7, 'end_position', cast(7 + length(n_name) as int), 'entity_value', n_name, 'entity_type', if(n_nationkey % 2 = 0, 'GPE', 'PERSON')),"
        " named_struct('start_position', 0, 'end_position', 2, 'entity_value', 'wrong', 'entity_type', 'PERSON')) AS spans",
    )
    out = readers.entity_spans(rows, {"PERSON": "private_person"})
    each = out.select("text", F.explode("labels").alias("l"))
    return each.select("text", F.col("l.category").alias("category"), F.col("l.start").cast(LONG).alias("s"), F.col("l.end").cast(LONG).alias("e"))


QUERIES = {
    "hybrid_detection": hybrid_detection, "hybrid_detection_sure": hybrid_detection_sure, "serving_threshold": serving_threshold, "model_detection": model_detection,
    "window_merging": window_merging, "evaluated_detector": evaluated_detector, "label_ids": label_ids, "surrogate_kinds": surrogate_kinds, "vault_collisions": vault_collisions,
    "anonymize_missing_keys": anonymize_missing_keys, "vault_json": vault_json, "stored_vault": stored_vault, "anonymized_before": anonymized_before, "run_summary": run_summary,
    "combined_json": combined_json, "vault_service": vault_service, "vault_replica": vault_replica, "docx_parts": _parts("docx"), "pptx_parts": _parts("pptx"), "xlsx_parts": _parts("xlsx"),
    "upload_routes": upload_routes, "url_routes": url_routes, "request_origins": request_origins, "request_bodies": request_bodies, "nested_json": nested_json,
    "scan_lines": scan_lines, "skipped_records": skipped_records, "byte_order_mark": byte_order_mark, "source_formats": source_formats, "any_frame": any_frame,
    "base64_texts": base64_texts, "entity_labels": entity_labels,
}
