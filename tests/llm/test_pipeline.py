import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from maskwright.llm import cotraining  # noqa: E402
from maskwright.llm.common import table  # noqa: E402

DATA = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_against_brute_force(spark):
    from tokenizers import Tokenizer

    from maskwright.llm.queries import tokenizer_path
    from tests.llm.test_jaccard_join import brute as near

    docs = table(spark, DATA, "documents")
    good = corpus_pipeline.quality(spark, docs, DATA)
    assert good.columns == COLUMNS
    scores = cotraining.quality(docs, table(spark, DATA, "labels"))
    rows = good.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in scores.where("accepted").collect()}

    out = corpus_pipeline.exact(spark, good, DATA)
    assert out.columns == COLUMNS
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r.text or ""), r.doc_id)
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(first.values())

    out = corpus_pipeline.near(spark, out, DATA)
    assert out.columns == COLUMNS
    kept = {c[1] for c in near(rows)}
    rows = out.collect()
    assert {r.doc_id for r in rows} == kept

    out = corpus_pipeline.clean(spark, out, DATA)
    assert out.columns == COLUMNS
    items = [tuple(r) for r in table(spark, DATA, "benchmark").select("item_id", "text").collect()]
    windows = {w for _, t in items for w in _windows(_words(t))}
    kept = {r.doc_id for r in rows if not windows & _windows(_words(r.text), False)}
    rows = out.collect()
    assert {r.doc_id for r in rows} == kept

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    sizes = {}
    for r in corpus_pipeline.pack(spark, out, DATA).collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in rows}


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _windows(w, item=True, size=10):
    if len(w) < size:
        return {tuple(w)} if item and w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]


LABELS = "doc_id long, quality int, toxic int"


def tables(spark, folder, docs, columns):
    spark.createDataFrame(docs, columns).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], LABELS).limit(0).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "a benchmark question of ten words and one or two more")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_odd_rows_pass_through_every_stage(spark, tmp_path):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, "clean text of its own"), (2, near), (3, near + " more"), (None, near), (None, None), (None, None), (4, ""), (5, None), (6, "a  b"), (6, "a b"), (6, "other"), (7, "twice"), (7, "twice"),
        (8, "long " * 50_000), (None, "A benchmark question, of ten words and one or two more!"), (9, "x a benchmark question of ten words and one or two more"),
    ]
    names = ["doc_id", "text", "lang", "source", "n_chars", "_id", "_sha", "identity", "_n", "kept", "row", "hash"]
    columns = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names[5:])
    folder = tables(spark, tmp_path, [(i, t, None, "s", None, *["x"] * 7) for i, t in rows], columns)
    docs, seen = table(spark, folder, "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == names, name
        docs = spark.createDataFrame(docs.collect(), columns)
        seen.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=str))
    everything, exact, near_, clean = seen
    assert everything == sorted(rows, key=str)  # without labels all are accepted
    assert exact == sorted([(1, rows[0][1]), (2, near), (3, near + " more"), (4, ""), (6, "a  b"), (6, "other"), (7, "twice"), (8, "long " * 50_000), *rows[-2:]], key=str) or exact == sorted([(1, rows[0][1]), (2, near), (3, near + " more"), (4, ""), (6, "a b"), (6, "other"), (7, "twice"), (8, "long " * 50_000), *rows[-2:]], key=str)
    assert (2, near) in near_ and (3, near + " more") not in near_
    assert {i for i, _ in clean} == {1, 2, 4, 6, 7, 8}
    packed = corpus_pipeline.pack(spark, docs, folder)
    assert {r.doc_id for r in packed.collect()} == {1, 2, 4, 6, 7, 8}


def test_three_rows_and_none(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(60))
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    folder = tables(spark, tmp_path / "three", [(0, text, "en", "s", 1), (1, text + " more", "en", "s", 1), (2, "something else", "en", "s", 1)], columns)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == [0, 2]
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "none", [], columns)).count() == 0
