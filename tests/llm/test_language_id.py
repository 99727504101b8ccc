import pytest

from maskwright.llm import language_id as L

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = L.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id")
    right, n = out.where("held_out").selectExpr("sum(int(lang = lang_pred))", "count(*)").first()
    assert n > 150 and right / n > 0.97


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(i, t, x, 1.0) for i, (t, x) in enumerate([("the cat sat on the mat", "en"), ("le chat est sur la table", "fr")] * 12)]
    rows += [(100, None, "en", 0.0), (101, "sans langue", None, 0.0), (None, "the hat", "en", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")


def test_words_then_shorter_grams():
    m = L.Model(["a", "b"], [0, 0], {"known": (-1.0, -9.0)}, {"<new>": (-5.0, -1.0), "ne": (-1.0, -4.0), "x": (-2.0, -3.0)})
    assert m.word("known") == (-1.0, -9.0)
    assert m.word("new") == (-5.0, -1.0)  # the longest known grams only
    assert m.word("nex") == (-1.0, -4.0)
    assert m.word("x") == (-2.0, -3.0)
    assert m.word("öö") is None


def test_defined_cases(spark, toy):
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (4, "the cat"), (4, "the cat"), (5, "le chat " * 50_000), (None, "table"), (6, "日本"), (7, "THE,MAT")]
    docs = spark.createDataFrame([(*r, "zz", "held") for r in rows], "doc_id long, text string, lang string, held_out string")
    model = L.fit(toy)
    got = [(r.doc_id, r.lang_pred) for r in L.predict(docs, model).collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "fr"), (None, "fr"), (6, "en"), (7, "en")]
    assert all(0 <= r.score <= 1 for r in L.predict(docs, model).collect())
    assert L.predict(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in L.predict(docs, L.fit(toy.limit(0))).collect()} == {"und"}


def test_fold_2_is_never_learned(spark):
    rows = [(i, f"word{i % 2} alpha", "aa" if i % 2 else "bb") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    changed = docs.selectExpr("doc_id", "text", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2, 'zz', lang) as lang")
    a, b = (sorted(map(tuple, L.language_id(d).collect())) for d in (docs, changed))
    assert a == b and any(r[1] for r in a) and not any(r[2] == "zz" for r in a)


def test_words_of_tokens_are_those_of_texts():
    for token in ("plain", "Ends,", "(two-part)", "it's", "3rd", "İstanbul", "x²", "½", "a_b", "_", "", "日本。", "ǅ!", "Ⅳ", "naïve…"):
        assert L.token_words(token) == L.words(token), token
