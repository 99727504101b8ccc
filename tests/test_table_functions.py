from maskwright.functions import spans as S
from maskwright.functions import table_functions


def test_rows_are_those_of_the_expression(spark):
    table_functions.register(spark)
    texts = ["é a@b.de on 2020-01-02, 4111 1111 1111 1111 or 4111 1111 1111 1112", "nothing", "", None, "DE89 3704 0044 0532 0130 00 ü 123-45-6789"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    docs.createOrReplaceTempView("docs_with_pii")
    got = spark.sql("SELECT d.id, s.category, s.start, s.end, s.text FROM docs_with_pii d, LATERAL pii_spans(d.text) s").collect()
    want = docs.where("text IS NOT NULL").select("id", S.regex_spans("text").alias("s")).collect()
    assert sorted(map(tuple, got)) == sorted((r.id, s.category, s.start, s.end, s.text) for r in want for s in r.s) and len(got) == 5
