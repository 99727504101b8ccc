import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import cotraining as C

DATA = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, score double"


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = C.fit(C.features(docs), labels.where("doc_id % 4 <> 1"))
    out = C.score(docs, model).join(labels.where("doc_id % 4 = 1"), "doc_id")
    kept, n, toxic, toxic_n, low, low_n = out.selectExpr(
        "sum(int(accepted AND quality = 1 AND toxic = 0))", "sum(int(quality = 1 AND toxic = 0))",
        "sum(int(NOT accepted AND toxic = 1))", "sum(toxic)", "sum(int(NOT accepted AND quality = 0))", "sum(int(quality = 0))",
    ).first()
    assert kept / n > 0.99 and toxic / toxic_n > 0.9 and low / low_n > 0.95


def rows(n=1200):
    rng = random.Random(3)
    out, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.4
        text = " ".join(rng.choices(["rain", "sun", "wind", "hill"], k=20) + (["spamword"] if bad else ["calm"]))
        out.append((i, text, "bad.site" if bad and rng.random() < 0.9 else "good.site", "en", len(text), 0.5))
        if i < n // 2:
            labels.append((i, int(not bad), 0))
    return out, labels


def features(docs):
    tokens = C.Tokens()
    return [C.text_features(d[1], tokens) for d in docs], [C.meta_features(*d[2:5]) for d in docs]


def test_views_hand_each_other_labels():
    docs, labels = rows()
    known, rest = features(docs[:600]), features(docs[600:])

    def pool(turn, views, limits):
        raws = [view.raw(x) for view, x in zip(views, rest, strict=True)]
        return [[(i, rest[0][i], rest[1][i], float(raw[i] >= high)) for i in range(600) if not low < raw[i] < high] for raw, (low, high) in zip(raws, limits, strict=True)]

    model = C.co_train(*known, [y for _, y, _ in labels], pool)
    assert model.handed and model.handed[0][0] > 0 and model.handed[0][1] > 0
    s = model.scores(model.text.raw(rest[0]), model.meta.raw(rest[1]))
    bad = np.array(["spamword" in d[1] for d in docs[600:]])
    assert ((s[:, 2] < 0.5) == bad).mean() > 0.98
    # Calibrated: documents scored near a chance are good about that often.
    assert abs(s[:, 1].mean() - (~bad).mean()) < 0.15


def test_the_whole_corpus_is_asked_each_round(spark):
    docs, labels = rows(1200)
    x = C.features(spark.createDataFrame(docs, SCHEMA))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = C.fit(x, marks, handed=100)
    assert model.handed[0][0] > 100 and model.handed[0][1] > 100
    # What the views may take grows with the corpus; what is fitted doesn't.
    assert all(n <= 200 for turn in model.handed for n in turn)
    alone = C.fit(x, marks, handed=0)
    assert alone.handed == []


def test_few_labels_are_fitted_too(spark):
    docs, labels = rows(60)
    d = spark.createDataFrame(docs, SCHEMA)
    marks = spark.createDataFrame([x for x in labels if x[0] < 14], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in C.quality(d, marks).collect()}
    bad = [i for i, t, *_ in docs if "spamword" in t]
    good = [i for i, t, *_ in docs if "calm" in t]
    assert sum(got[i] for i in bad) / len(bad) < 0.4 < 0.6 < sum(got[i] for i in good) / len(good)


def test_defined_cases(spark):
    docs, labels = rows()
    odd = [(1000, None, None, None, None, 0.0), (1001, "", "s", "en", -5, 0.0), (1002, "sun " * 200_000 + "spamword", "bad.site", "en", 1, 0.0), (None, "sun calm", "good.site", "en", 8, 0.0), (5, docs[5][1], *docs[5][2:])]
    d = spark.createDataFrame(docs + odd, SCHEMA).withColumn("identity", F.lit("x")).withColumn("row", F.lit(1)).withColumn("_n", F.lit(2))
    marks = spark.createDataFrame([*labels, (1, None, None), (None, 0, 1), (3, 1, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = C.quality(d, marks).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    kept = C.keep_good(d, marks)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.accepted)
    assert C.quality(d.limit(0), marks).count() == 0
    assert {r.score for r in C.quality(d, marks.limit(0)).collect()} == {1.0}


@pytest.mark.parametrize("token, want", [("THE!!", "A!"), ("ab12cd", "a0a"), ("|", "|"), ("Ab", "Aa")])
def test_shape(token, want):
    assert C.shape(token) == want


def test_tokens_of_a_task_stay_within_their_memory():
    import tracemalloc

    from maskwright.llm.cotraining import Tokens

    tokens = Tokens()
    tracemalloc.start()
    for i in range(250_000):
        tokens[f"token{i}!"]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50_000_000
    assert tokens["token7!"] == Tokens()["token7!"]
