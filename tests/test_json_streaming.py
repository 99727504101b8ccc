import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.functions import predicates as P
from maskwright.functions import spans as S
from maskwright.functions.surrogates import surrogate
from maskwright.operators import jsonpaths as J
from maskwright.streaming import vault_stream as V


def test_predicates(spark):
    texts = ["short one", "a longer piece of text", "identifier_without-space", "deadbeef-0123456789ab", "123456 7890ab cd"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(P.looks_like_prose("t")).collect()
    assert [r[0] for r in rows] == [False, True, False, False, True]
    paths = [["a", "Text"], ["messages", "0", "x"], ["a", "b"], [], ["text", "b"]]
    rows = spark.createDataFrame([(p,) for p in paths], "p array<string>").select(P.is_content_path("p"), F.size(P.last_candidates("p", 1))).collect()
    assert [r[0] for r in rows] == [True, True, False, False, False] and [r[1] for r in rows] == [1, 1, 1, 0, 1]
    one = spark.range(1).select(
        P.is_blank(F.lit("  \n")), P.upload_kind(F.lit("A.DOCX")), P.extension_id(F.lit("abcdefghijklmnop" * 2)), P.origin_allowed(F.lit("app://x"), ["app://"], ["y"]),
        P.query_param(F.lit("https://h/p?a=1&q=x%20y"), "q"), P.with_query_param(F.lit("https://h/p?a=1&q=x#f"), "q", F.lit("$ y&")),
        P.url_route(F.lit("https://chat.example/api/send?x=1"), [("a", "GET", "."), ("b", "POST", r"^chat\.example/api/")], F.lit("post")),
    ).first()
    assert tuple(one) == (True, "document", True, True, "x y", "https://h/p?a=1&q=%24+y%26#f", "b")


def test_json_leaves_and_write_back(spark):
    docs = [(1, '{"messages":[{"role":"user","content":"please write to a@b.de"},7,null],"n":1.50,"deep":{"text":"too short"}}'), (2, "no json"), (3, None), (4, '"just a string with prose"')]
    frame = spark.createDataFrame(docs, "id long, props string")
    got = {(r.id, tuple(r.path)): r.value for r in J.leaves(frame, "id", "props").collect()}
    assert got == {(1, ("messages", "0", "role")): "user", (1, ("messages", "0", "content")): "please write to a@b.de", (1, ("deep", "text")): "too short", (4, ()): "just a string with prose"}
    some = J.content_leaves(frame, "id", "props")
    changed = some.select("id", "path", S.redact("value", S.regex_spans("value")).alias("value"))
    out = {r.id: r.props for r in J.write_back(frame, changed, "id", "props").collect()}
    assert json.loads(out[1]) == json.loads(docs[0][1].replace("a@b.de", "[PRIVATE_EMAIL]")) and '"n":1.5' in out[1]
    assert out[2] == "no json" and out[3] is None and out[4] == '"just a string with prose"'
    nested = json.dumps([0, json.dumps([["inner"]])])
    assert spark.createDataFrame([(nested,)], "x string").select(J.nested_string("x", 1, 0, 0)).first()[0] == "inner"


def test_worker_and_expression_mint_alike(spark):
    rows = [(c, f"v{i}", a) for c in ("private_person", "private_email", "private_phone", "private_address", "private_date", "private_url", "account_number", "secret") for i in range(5) for a in (0, 1)]
    df = spark.createDataFrame(rows, "category string, real string, attempt int").withColumn("fake", surrogate(F.col("category"), F.col("real"), F.col("attempt"), 3))
    assert all(r.fake == V.mint(r.category, r.real, r.attempt, 3) for r in df.collect())


def run_commands(spark, tmp_path, batches, **options):
    source = tmp_path / "in"
    source.mkdir(exist_ok=True)
    answers = []
    for i, rows in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("vault_id", "req_id", "op", "text", "at"), r, strict=True))) for r in rows))
        stream = spark.readStream.schema("vault_id string, req_id string, op string, text string, at double").json(str(source))
        stream = stream.withColumn("spans", F.coalesce(S.regex_spans("text"), S.no_spans()))
        V.start(V.vault_commands(stream, **options), lambda df, _: answers.extend(df.collect()), str(tmp_path / "cp")).awaitTermination()
    return {r.req_id: r for r in answers}


def test_commands_over_restarts(spark, tmp_path):
    first = [("v", "1", "anonymize", "mail a@b.de", 0.0), ("v", "2", "undo", None, 1.0), ("w", "3", "anonymize", "  ", 0.0), ("w", "4", "restore", "x", 1.0), ("w", "5", "undo", "x", 2.0)]
    got = run_commands(spark, tmp_path, [first])
    fake = V.mint("private_email", "a@b.de", 0)
    assert got["1"].text == f"mail {fake}" and got["1"].outcome == "anonymized" and json.loads(got["1"].subs) == [[fake, "a@b.de"]]
    assert [got[i].outcome for i in ("2", "3", "4", "5")] == ["undo_refused", "empty", "nothing_to_restore", "no_undo"]
    second = [("v", "6", "restore", f"to {fake}!", 10.0), ("v", "7", "undo", "to a@b.de!", 11.0), ("v", "8", "anonymize", "on 2020-01-02", 12.0), ("v", "9", "undo", "?", 999.0), ("v", "a", "undo", "?", 1000.0), ("v", "b", "anonymize", "plain", 1001.0), ("v", "c", "snapshot", None, 1002.0), ("v", "d", "clear", None, 1003.0), ("v", "e", "dance", None, 1004.0)]
    got = run_commands(spark, tmp_path, [first, second])
    assert [got[i].outcome for i in "6789abcde"] == ["restored", "undone", "anonymized", "undo_expired", "no_undo", "no_pii", "snapshot", "cleared", "unknown"]
    assert got["6"].text == "to a@b.de!" and got["7"].text == f"to {fake}!" and got["c"]["count"] == 2 and got["d"].removed == 2


def test_cap_and_counts(spark, tmp_path):
    got = run_commands(spark, tmp_path, [[("v", "1", "anonymize", "a@b.de c@d.ee e@f.gg", 0.0), ("v", "2", "snapshot", None, 1.0)]], cap=2)
    assert got["1"].removed == 1 and got["1"]["count"] == 3 and [r for _, r in json.loads(got["2"].subs)] == ["c@d.ee", "e@f.gg"]
    counts = V.outcome_counts(spark.createDataFrame(list(got.values()), V.ANSWERS)).collect()
    assert sorted(tuple(r) for r in counts) == [("anonymize", "anonymized", 1), ("snapshot", "snapshot", 1)]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=24), st.lists(st.integers(0, 24), max_size=5))
def test_pieces_restore_as_the_whole_does(text, cuts):
    pairs = [("ab", "1"), ("abc", "2"), ("ca", "3"), ("bcb", "4")]
    fakes = [f for f, _ in pairs]
    cuts = sorted({0, len(text), *(min(c, len(text)) for c in cuts)})
    held, out = "", ""
    for a, b in zip(cuts, cuts[1:], strict=False):
        held += text[a:b]
        cut = V.safe_cut(held, fakes)
        out += V.longest_first(held[:cut], pairs)[0]
        held = held[cut:]
    assert out + V.longest_first(held, pairs)[0] == V.longest_first(text, pairs)[0]


def test_restore_stream_and_replica(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"stream_id":"s","seq":0,"text":"to sk-fa","last":false}\n{"stream_id":"s","seq":1,"text":"ke-1 and sk","last":false}\n{"stream_id":"s","seq":2,"text":"","last":true}')
    stream = spark.readStream.schema("stream_id string, seq long, text string, last boolean").json(str(tmp_path / "in"))
    got = []
    V.start(V.restore_stream(stream, [("sk-fake-1", "KEY")]), lambda df, _: got.extend(df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert [r.text for r in sorted(got, key=lambda r: r.seq)] == ["to ", "KEY and ", "sk"]
    events = [("v", 0, "snapshot", [("f", "r")]), ("v", 1, "snapshot", []), ("v", 2, "delta", [("g", "s"), ("f", "t")]), ("w", 0, "delta", [("x", "y")]), ("w", 1, "clear", [])]
    frame = spark.createDataFrame(events, "vault_id string, seq long, kind string, pairs array<struct<fake:string,real:string>>")
    assert {r.vault_id: r.pairs for r in V.replica(frame).collect()} == {"v": {"f": "t", "g": "s"}, "w": {}}


@pytest.mark.parametrize("text, want", [("ab", 0), ("xab", 1), ("xabd", 4), ("", 0)])
def test_safe_cut(text, want):
    assert V.safe_cut(text, ["abc"]) == want


def test_streams_share_the_state_of_a_bucket(spark, tmp_path):
    from pyspark.sql import functions as F

    pairs = [(f"sk-fake-{i}", f"KEY{i}") for i in range(30)]
    whole = spark.range(300).selectExpr("cast(id AS string) AS stream_id", "concat('é sk-fake-', id % 40, ' or sk-fake-', id % 30) AS text")
    cut = whole.select("stream_id", F.posexplode(F.expr("transform(sequence(0, 5), i -> substr(text, 5 * i + 1, 5))")).alias("seq", "text"))
    cut = cut.selectExpr("stream_id", "cast(seq AS long) AS seq", "text", "seq = 5 AS last")
    for name, part in (("a", "seq < 3"), ("b", "seq >= 3")):
        cut.where(part).write.parquet(str(tmp_path / "in" / name))
    stream = spark.readStream.schema(cut.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = []
    query = V.start(V.restore_stream(stream, pairs, buckets=4), lambda df, _: got.extend(df.collect()), str(tmp_path / "cp"))
    query.awaitTermination()
    texts = {}
    for r in sorted(got, key=lambda r: r.seq):
        texts[r.stream_id] = texts.get(r.stream_id, "") + r.text
    want = {r.stream_id: V.longest_first(r.text[:30], pairs)[0] for r in whole.collect()}
    assert texts == want and query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
