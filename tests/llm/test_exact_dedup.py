import hashlib
import re

import pytest

from maskwright.llm import exact_dedup as exact
from maskwright.llm.common import shared_dir
from maskwright.llm.exact_dedup import DigestIndex, exact_dedup, keep_first

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (5, "a  b", "en", "x", 1), (2, "a b", None, "x", 1), (3, "a\tb", "en", None, None), (4, None, None, None, None),
    (6, "", "en", "x", 0), (7, "a b", "en", "x", 1), (8, "z" * 300_000, "en", "x", 1), (9, " a b", "en", "x", 1),
    (10, "twice", "en", "x", 1), (10, "twice", "en", "x", 1), (None, "zz", "en", "x", 1), (11, "zz", "en", "x", 1),
]


def test_report_against_brute_force(spark):
    got = exact_dedup(spark.createDataFrame(ROWS, SCHEMA)).collect()
    same = {}
    for doc_id, text, *_ in ROWS:
        same.setdefault(re.sub("[\x20\x09-\x0d]+", " ", text or ""), []).append(doc_id)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in same.items()}
    assert len(got) == len(ROWS)
    for r in got:
        ids = by_digest[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min(i for i in ids if i is not None)
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(same)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, text string")


def kept(report):
    return sorted(r.doc_id for r in report.collect() if r.kept)


def test_second_batch_loses_to_the_first(spark):
    path = shared_dir(spark, "index")
    index = DigestIndex.open(spark, path)
    index.ingest(frame(spark, (9, "old"), (8, "older")))
    again = DigestIndex.open(spark, path)
    got = {r.doc_id: r for r in again.ingest(frame(spark, (1, "old"), (2, "new"), (3, "new"))).collect()}
    assert [got[i].kept for i in (1, 2, 3)] == [False, True, False]
    assert [got[i].keep_id for i in (1, 2, 3)] == [9, 2, 2]
    again.compact()
    assert sorted(r.keep_id for r in again.rows().collect()) == [2, 8, 9]
    assert kept(DigestIndex.open(spark, path).ingest(frame(spark, (5, "older"), (6, "newer")))) == [6]


def test_the_same_documents_twice_keep_nothing_and_a_retry_the_same(spark):
    index = DigestIndex.open(spark, shared_dir(spark, "index"))
    docs = frame(spark, (1, "a"), (2, "b"), (3, "a"))
    assert kept(index.ingest(docs, "monday")) == [1, 2]
    assert kept(index.ingest(docs, "tuesday")) == []
    assert kept(index.ingest(docs, "monday")) == [1, 2]
    assert kept(index.ingest(frame(spark, (1, "a"), (2, "b"), (3, "a")).repartition(3), "monday")) == [1, 2]
    assert index.rows().count() == 2


def test_one_batch_at_a_time(spark):
    path = shared_dir(spark, "index")
    index = DigestIndex.open(spark, path)
    assert kept(index.ingest(frame(spark, (1, "a")))) == [1]
    index.lock("other")
    with pytest.raises(RuntimeError):
        DigestIndex.open(spark, path).ingest(frame(spark, (2, "b")), "mine")
    assert kept(index.ingest(frame(spark, (2, "b")), "other")) == [2]
    assert kept(index.ingest(frame(spark, (3, "c")), "mine")) == [3]


def test_anti_join_reads_the_buckets_in_place(spark, monkeypatch):
    monkeypatch.setattr(exact, "BUCKET_ROWS", 1)
    index = DigestIndex.open(spark, shared_dir(spark, "index"))
    index.ingest(frame(spark, *((i, str(i)) for i in range(40))))
    assert index.buckets == 40
    plan = index.rows().select("digest").groupBy("digest").count()._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan
    name = index.name
    index.close()
    assert not spark.catalog.tableExists(name)


def test_empty_table_and_filter(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = keep_first(spark.createDataFrame(ROWS, SCHEMA))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [2, 4, 7, 8, 9, 10, 11]


def test_clashing_columns(spark):
    rows = [(1, "x", "s", 3, True), (2, "x", "t", 4, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_sha256 string, group_size int, kept boolean")
    assert {r.doc_id: r.kept for r in exact_dedup(docs).collect()} == {1: True, 2: False}


def test_filter_with_clashing_and_repeated_rows(spark):
    rows = [(1, "x", 1, "s"), (1, "x", 2, "t"), (1, "y", 1, "s"), (None, "x", 1, "s"), (None, "z", 1, "s"), (None, "z", 1, "s"), (None, None, 1, "s"), (4, "", 1, "s")]
    names = ["doc_id", "text", "_id", "_sha", "_identity", "identity", "_n", "stay", "digest"]
    docs = spark.createDataFrame([(*r, *["q"] * 5) for r in rows], "doc_id long, text string, _id long, _sha string, " + ", ".join(f"`{c}` string" for c in names[4:]))
    out = keep_first(docs)
    assert out.columns == names
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "x"), (1, "y"), (None, "z"), (4, "")], key=str)
