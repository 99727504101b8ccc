import re

import pytest
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.functions.surrogates import surrogate
from maskwright.operators import restore as R
from maskwright.operators import vault as V

SHAPES = {
    "private_person": r"[A-Z][a-z]+ [A-Z][a-z]+", "private_email": r"[a-z]+\.[a-z]+\d\d@[a-z.]+", "private_phone": r"\([2-9]\d\d\) [2-9]\d\d-\d{4}",
    "private_address": r"\d{1,4} [A-Z][a-z]+ [A-Z][a-z]+", "private_date": r"(19\d|20[0-4])\d-(0\d|1[0-2])-[0-2]\d", "private_url": r"https://[a-z.]+/[a-z]+-[a-z]+-\d{5}",
    "account_number": r"\d{10}", "secret": r"sk-fake-[a-z0-9]{16}",
}


def test_shapes(spark):
    rows = [(c, f"v{i}") for c in SHAPES for i in range(50)]
    df = spark.createDataFrame(rows, "category string, real string").withColumn("fake", surrogate(F.col("category"), F.col("real"), F.lit(0)))
    for r in df.collect():
        assert re.fullmatch(SHAPES[r.category], r.fake), r


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["mail a@b.de, c@d.ee and a@b.de on 2020-01-02", "no data", "c@d.ee 2020-01-02 é 555-555-5555", None, "", "A@b.de"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.coalesce(S.regex_spans("text"), S.no_spans()))


def test_one_surrogate_for_each_value_in_order(spark, docs):
    out, vault = V.anonymize_corpus(docs, ["doc_id"])
    rows = vault.orderBy("seq").collect()
    assert [(r.seq, r.real) for r in rows] == [(0, "a@b.de"), (1, "c@d.ee"), (2, "2020-01-02"), (3, "555-555-5555"), (4, "A@b.de")]
    fake = {r.real: r.fake for r in rows}
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].anonymized == f"mail {fake['a@b.de']}, {fake['c@d.ee']} and {fake['a@b.de']} on {fake['2020-01-02']}"
    assert [(s.real, s.fake) for s in got[0].subs][0] == ("a@b.de", fake["a@b.de"]) and len(got[0].placements) == 4
    assert got[1].anonymized == "no data" and got[4].anonymized == "" and got[3].anonymized is None
    back = R.restore(out, vault, ["doc_id"])
    assert all(r.restored == r.text for r in back.collect())
    assert {r.doc_id: r.n_entries for r in R.restore_plan(out, vault, ["doc_id"]).collect()}[0] == 3
    assert {r.doc_id for r in R.without_surrogates(out, vault, ["doc_id"], "anonymized").collect()} == {1, 3, 4}


def test_scoped_vaults(spark, docs):
    out, vault = V.anonymize_corpus(docs, ["doc_id"], ["doc_id"])
    assert vault.groupBy("doc_id").count().orderBy("doc_id").collect()[0]["count"] == 3
    assert vault.where("doc_id = 2").agg(F.min("seq")).first()[0] == 0
    assert out.count() == docs.count()


def test_surrogates_are_unique_even_when_few_are_left(spark, monkeypatch):
    monkeypatch.setattr(V, "ATTEMPTS", 6)
    found = spark.range(60_000).select(F.lit("private_date").alias("category"), F.col("id").cast("string").alias("real"), F.struct("id").alias("first"))
    vault = V.build(found)
    assert vault.count() == 60_000 and vault.select("fake").distinct().count() == 60_000
    more = spark.range(59_990, 60_010).select(F.lit("private_date").alias("category"), F.col("id").cast("string").alias("real"), F.struct("id").alias("first"))
    again = V.build(more, existing=vault)
    assert again.count() == 60_010 and again.select("fake").distinct().count() == 60_010
    assert again.agg(F.max("seq")).first()[0] == 60_009


def test_cap(spark, docs):
    _, vault = V.anonymize_corpus(docs, ["doc_id"])
    kept, gone = V.cap(vault, 2)
    assert sorted(r.seq for r in kept.collect()) == [3, 4] and sorted(r.seq for r in gone.collect()) == [0, 1, 2]
    assert V.cap(vault, 0)[0].count() == 5 and V.cap(vault, 99)[0].count() == 5


RESTORE = [("ab", "1"), ("abc", "2"), ("b$1\\", "3"), ("é(x)", "4"), ("", "5"), ("abc", "dup")]
TEXTS = ["abcab", "xabx", "b$1\\b$1", "é(x)é(", "abcé(x)ab", "", None, "aabc"]


def plain(text):
    best = {}
    for f, r in RESTORE:
        if f:
            best.setdefault(f, r)
    out, i = "", 0
    while i < len(text):
        hit = max((f for f in best if text.startswith(f, i)), key=len, default=None)
        out += best[hit] if hit else text[i]
        i += len(hit) if hit else 1
    return out


@pytest.mark.parametrize("small", [1000, 0])
def test_restore_longest_first(spark, monkeypatch, small):
    monkeypatch.setattr(R, "SMALL", small)
    vault = spark.createDataFrame([(i, "secret", r, f) for i, (f, r) in enumerate(RESTORE)], "seq long, category string, real string, fake string")
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, anonymized string")
    got = {r.doc_id: r.restored for r in R.restore(docs, vault, ["doc_id"]).collect()}
    assert [got[i] for i in range(len(TEXTS))] == [t if t is None else plain(t) for t in TEXTS]


def test_restore_in_blocks(spark):
    vault = spark.createDataFrame([(i, "secret", f"real{i}", f"f{i}x") for i in range(50)], "seq long, category string, real string, fake string")
    docs = spark.createDataFrame([(0, "f1x f11x é f49x ff3x")], "doc_id long, anonymized string")
    found = R.matches(docs, vault, ["doc_id"], "anonymized", block=7).first()._found
    assert [m.real for m in found] == ["real1", "real11", "real49", "real3"]


def test_missing_and_repeated_keys_leak_nothing(spark):
    rows = [(None, "write bob@corp.com", "a"), (None, "write bob@corp.com", "a"), (1, "a longer prefix mail zed@corp.com", "a"), (1, "mail zed@corp.com", None), (1, "none", "a"), (2, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, who string").withColumn("spans", S.regex_spans("text"))
    for scope in (None, ["who"]):
        out, vault = V.anonymize_corpus(docs, ["doc_id"], scope)
        got = out.collect()
        assert len(got) == len(rows) and not any("corp.com" in (r.anonymized or "") for r in got)
        fake = {(r.real, r.who if scope else 0): r.fake for r in vault.collect()}
        where = lambda r: r.who if scope else 0
        for r in got:
            want = r.text
            for real in ("bob@corp.com", "zed@corp.com"):
                want = want and want.replace(real, fake.get((real, where(r)), "?"))
            assert r.anonymized == want
        if not scope:
            for small in (64, 0):
                R.SMALL, before = small, R.SMALL
                assert sorted((r.restored or "" for r in R.restore(out, vault, ["doc_id"]).collect())) == sorted(t or "" for _, t, _ in rows)
                R.SMALL = before
            assert sorted((r.n_entries for r in R.restore_plan(out, vault, ["doc_id"]).collect())) == [0, 0, 1, 1, 1, 1]
            assert sorted((r.text or "") for r in R.without_surrogates(out, vault, ["doc_id"], "anonymized").collect()) == ["", "none"]


def test_a_value_that_the_vault_lacks_is_taken_out(spark):
    docs = spark.createDataFrame([(1, "mail bob@corp.com and amy@corp.com")], "doc_id long, text string").withColumn("spans", S.regex_spans("text"))
    some = V.placed(docs, ["doc_id"])
    vault = V.build(V.values(some, ["doc_id"])).where("seq = 1")
    out = V.anonymize(docs, some, vault, ["doc_id"]).first()
    assert out.anonymized == f"mail [PRIVATE_EMAIL] and {vault.first().fake}"


def test_resuming_a_vault_of_one_entry(spark):
    value = lambda *names: spark.createDataFrame([("secret", n, (i,)) for i, n in enumerate(names)], "category string, real string, first struct<id:int>")
    one = V.build(value("a"))
    both = V.build(value("a", "b"), existing=one)
    assert sorted((r.seq, r.real) for r in both.collect()) == [(0, "a"), (1, "b")]


def test_another_way_to_invent_surrogates(spark, docs):
    make = lambda category, real, attempt, seed: F.concat(F.lit("<"), category, F.lit(":"), F.length(real).cast("string"), F.lit("."), attempt.cast("string"), F.lit(">"))
    out, vault = V.anonymize_corpus(docs, ["doc_id"], make=make)
    fakes = {r.real: r.fake for r in vault.collect()}
    assert fakes["a@b.de"] == "<private_email:6.0>" and fakes["c@d.ee"] == "<private_email:6.1>" and fakes["A@b.de"] == "<private_email:6.2>"
    assert all("@" not in (r.anonymized or "") for r in out.collect())


@pytest.mark.parametrize("scope", [None, ["grp"]])
def test_no_surrogate_stands_in_a_text_as_it_came(spark, scope):
    one = spark.createDataFrame([("private_date", "2020-01-02")], "category string, real string")
    tried = [one.select(surrogate(F.col("category"), F.col("real"), F.lit(i))).first()[0] for i in range(3)]
    # Between letters no date is found, so the first two surrogates stay in texts; the third one is free.
    texts = ["on 2020-01-02", f"serial x{tried[0]}y", f"z{tried[1]}z and 2020-01-02", None]
    rows = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id long, grp long, text string").withColumn("spans", F.coalesce(S.regex_spans("text"), S.no_spans()))
    out, vault = V.anonymize_corpus(rows, ["doc_id"], scope)
    assert [(r.real, r.fake) for r in vault.collect()] == [("2020-01-02", tried[2])]
    assert all(r.restored == r.text for r in R.restore(out, vault, ["doc_id"]).collect())
    assert {r.doc_id: r.n_entries for r in R.restore_plan(out, vault, ["doc_id"]).collect()} == {0: 1, 1: 0, 2: 1, 3: 0}
    assert R.without_surrogates(rows, vault, ["doc_id"]).count() == 4
