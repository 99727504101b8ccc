import json

import pytest
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.sources import readers as R
from maskwright.sources import sinks as K


def got(df):
    return sorted(((r.id, r.text) for r in df.collect()), key=lambda x: (len(x[0]), x[0]))


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿alpha\r\n\nbéta\r\r\n".encode() + b"\xff\xfe\n" + b"last")
    assert got(R.read(spark, str(tmp_path / "a.txt"))) == [("0", "alpha"), ("1", ""), ("2", "béta"), ("3", "last")]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = got(R.lines(spark, str(tmp_path / "a.txt")))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [int(i) for i, _ in rows] == list(range(5000)) and all(t == f"line {i}" for i, t in rows)


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text":"one","k":7}\n\n{"text":5}\nnot json\n{"other":1}\n[1]\n')
    rows = R.read(spark, str(tmp_path / "a.jsonl"))
    assert got(rows) == [("0", "one"), ("2", ""), ("4", ""), ("5", "")]
    back = K.reframe(rows.where("id in ('0', '5')").withColumn("new", F.lit("neu é")), "raw", "new").orderBy("id").select("line").collect()
    assert [r[0] for r in back] == ['{"k":7,"text":"neu é"}', '{"text":"neu é"}']


def test_tsv_delimited_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("a\tb\tc\nd\n")
    assert got(R.read(spark, str(tmp_path / "a.tsv"), column=1)) == [("0", "b"), ("1", "")]
    for text in ("x||y||", "x||y", "||", "x"):
        (tmp_path / "d.txt").write_text(text)
        assert [t for _, t in got(R.read(spark, str(tmp_path / "d.txt"), delimiter="||"))] == text.split("||")
    (tmp_path / "tree/sub dir").mkdir(parents=True)
    (tmp_path / "tree/b+é.txt").write_text("B\nb")
    (tmp_path / "tree/sub dir/a.txt").write_text("A")
    assert got(R.read(spark, str(tmp_path / "tree"), is_dir=True)) == [("b+é.txt", "B\nb"), ("sub dir/a.txt", "A")]


def test_resolve_format():
    assert [R.resolve_format(*a) for a in ((None,), ("x.ndjson",), ("x.TSV",), ("x", None, True), ("x.tsv", "lines"), ("x.txt",))] == ["lines", "jsonl", "tsv", "files", "lines", "lines"]


def plain_unescape(text):
    out, i = "", 0
    while i < len(text):
        pair = text[i : i + 2]
        if pair in ("\\n", "\\r", "\\t", "\\\\"):
            out += {"n": "\n", "r": "\r", "t": "\t", "\\": "\\"}[pair[1]]
            i += 2
        else:
            out += text[i]
            i += 1
    return out


def test_unescape_and_labels(spark, tmp_path):
    cases = [r"a\nb", r"a\\nb", r"\\\n", "x\\", r"\q\\", r"\\\\", r"\t\r", "", "\\\\\\"]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", R.unescape("t").alias("u"), R.unescape(R.escape("t")).alias("same")).orderBy("i").collect()
    assert [r.u for r in rows] == [plain_unescape(c) for c in cases] and [r.same for r in rows] == cases
    (tmp_path / "l.tsv").write_text("a\\tb\t0:1:private_email|2:3:other\nplain\t\n")
    rows = R.labelled(spark, str(tmp_path / "l.tsv")).orderBy("example_id").collect()
    assert rows[0].text == "a\tb" and [tuple(x) for x in rows[0].labels] == [("private_email", 0, 1), (None, 2, 3)] and rows[1].labels == []
    (tmp_path / "l.tsv").write_text("a\tx:1:private_email\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        R.labelled(spark, str(tmp_path / "l.tsv")).collect()
    assert spark.range(1).select(R.char_to_byte(F.lit("éaé"), F.lit(2))).first()[0] == 3


def test_sinks(spark, tmp_path):
    vault = spark.createDataFrame([(0, "secret", 'a"b', "f\\1"), (1, "private_url", "é", "g")], "seq long, category string, real string, fake string")
    K.write_lines(K.vault_lines(vault).coalesce(1), str(tmp_path / "v"), "ord", "line")
    text = "".join(p.read_text() for p in sorted((tmp_path / "v").glob("part-*")))
    assert json.loads(text) == [{"category": "secret", "real": 'a"b', "fake": "f\\1"}, {"category": "private_url", "real": "é", "fake": "g"}]
    (tmp_path / "v.json").write_text(text)
    assert R.vault_json(spark, str(tmp_path / "v.json")).orderBy("seq").collect() == vault.orderBy("seq").collect()
    done = K.write_tree(spark.createDataFrame([("a/b.txt", "x"), ("c.txt", None)], "id string, text string"), f"file://{tmp_path}/out").collect()
    assert {r.id: r.bytes for r in done} == {"a/b.txt": 1, "c.txt": 0} and (tmp_path / "out/a/b.txt").read_text() == "x"
    with pytest.raises(Exception, match="outside"):
        K.write_tree(spark.createDataFrame([("../x", "x")], "id string, text string"), f"file://{tmp_path}/out").collect()
    docs = spark.createDataFrame([("1", "a@b.de é"), ("2", "none")], "id string, text string").withColumn("spans", S.regex_spans("text"))
    rows = docs.orderBy("id").select(K.report_lines().alias("r"), K.scan_line().alias("j"), K.combined("text", "spans").alias("c")).collect()
    assert rows[0].r == "private_email [0..6] score=1.000 a@b.de" and rows[1].r == "no PII detected"
    assert json.loads(rows[0].j)["spans"][0]["end"] == 6 and json.loads(rows[1].c) == {"anonymized": "none", "vault": []}
    assert tuple(K.summary(docs, vault).first()) == (2, 2)


def test_stored_vault(spark, tmp_path):
    path = f"{tmp_path}/store"
    assert K.load_vault(spark, path) is None
    vault = spark.createDataFrame([(0, "secret", "a", "b")], "seq long, category string, real string, fake string")
    K.save_vault(vault, path)
    K.save_vault(vault.union(vault), path)
    assert K.load_vault(spark, path).count() == 2
    assert sorted(x.name for x in (tmp_path / "store").glob("manifest*")) == ["manifest-000000001.json", "manifest-000000002.json"]
    # A writer that died before its manifest leaves the vault as it was.
    vault.write.parquet(f"{path}/part-unfinished")
    assert K.load_vault(spark, path).count() == 2
    (tmp_path / "store/manifest-000000003.json").write_text('{"format": "other"}')
    with pytest.raises(ValueError, match="corrupt"):
        K.load_vault(spark, path)
    assert K.load_vault(spark, path) is None


def test_base64_and_lossy_text(spark):
    rows = spark.createDataFrame([("aGVsbG8=",), ("w6k=",), ("ww==",), ("*",), (None,)], "b string")
    assert [r[0] for r in rows.select(R.base64_text("b")).collect()] == ["hello", "é", "\ufffd", None, None]


def test_lines_of_many_splits_are_numbered_in_order(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.txt").write_text("\ufeff" * (k == 0) + "".join(f"{k}-{i}\n" for i in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        rows = [(int(r.id), r.text) for r in R.read(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(rows) == [(500 * k + i, f"{k}-{i}") for k in range(3) for i in range(500)]
