import math
import random

import pytest
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.operators import decode as D
from maskwright.operators import detect, evaluate


def test_labels():
    assert D.parse_labels({"0": "O", "1": "B-secret", "2": "I-secret", "3": "S-private_person"}) == [None, "secret", "secret", "private_person"]
    for bad in ({"0": "O", "2": "B-secret"}, {"0": "B-nothing"}):
        with pytest.raises(ValueError):
            D.parse_labels(bad)


@pytest.mark.parametrize("n, want", [(0, None), (10, [(0, 10)]), (1024, [(0, 1024)]), (1025, [(0, 1024), (896, 1025)]), (2248, [(0, 1024), (896, 1920), (1792, 2248)]), (1920, [(0, 1024), (896, 1920)])])
def test_windows(spark, n, want):
    got = spark.range(1).select(D.windows(F.lit(n)).alias("w")).first().w
    assert (got and [(w.tok_start, w.tok_end) for w in got]) == want


def test_batches_and_buckets(spark):
    row = spark.range(1).select(*[D.rows_per_batch(F.lit(n)).alias(f"r{n}") for n in (1, 300, 5000)], *[D.padded_length(F.lit(n)).alias(f"p{n}") for n in (1, 64, 65, 1025)], D.rows_per_batch(F.lit(5), override=0).alias("o")).first()
    assert (row.r1, row.r300, row.r5000, row.p1, row.p64, row.p65, row.p1025, row.o) == (16, 13, 1, 64, 64, 128, 1025, 1)


def test_decode_against_model(spark):
    rng = random.Random(5)
    labels = [None, "secret", "secret", "private_person"]
    docs, tokens, want = [], [], {}
    for d in range(25):
        sizes = [rng.choice([0, 1, 2, 3]) for _ in range(rng.randrange(1, 14))]
        text = "".join(rng.choice("ab c") for _ in range(sum(sizes)))
        docs.append((d, text))
        at, current, out = 0, None, []

        def flush(current=None, text=text, out=out):
            if current:
                c, a, b, ps = current
                piece = text[a:b]
                a += len(piece) - len(piece.lstrip())
                if piece.strip():
                    out.append((c, a, a + len(piece.strip()), piece.strip(), sum(ps) / len(ps)))

        for i, n in enumerate(sizes):
            logits = [float(rng.randrange(4)) for _ in labels]
            tokens.append((d, i, at, at + n, logits))
            c = labels[logits.index(max(logits))]
            p = 1 / sum(math.exp(x - max(logits)) for x in logits)
            if c is None or not n:
                flush(current)
                current = None
            elif current and current[0] == c:
                current = (c, current[1], at + n, [*current[3], p])
            else:
                flush(current)
                current = (c, at, at + n, [p])
            at += n
        flush(current)
        want[d] = out
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = D.decode(spark.createDataFrame(tokens, "doc_id long, tok_idx int, b0 int, b1 int, logits array<double>"), frame, labels)
    for r in got.collect():
        assert [tuple(s)[:4] for s in r.spans] == [w[:4] for w in want[r.doc_id]]
        assert all(abs(s.score - w[4]) < 1e-6 for s, w in zip(r.spans, want[r.doc_id], strict=True))


def names_model():
    import numpy as np

    return lambda ids, mask: np.stack([1.0 * (ids < 100), 5.0 * (ids >= 100)], axis=-1)


def words_encoder():
    def encode(text):
        out, word = [], ""
        for c in text:
            word += c
            if c == " ":
                out.append(word)
                word = ""
        return [(100 if w[0].isupper() else 1, len(w.encode())) for w in [*out, word] if w]

    return encode


def test_hybrid_detector(spark):
    docs = spark.createDataFrame([(0, "Ann Lee wrote to a@b.de on 2020-01-02 é Bob"), (1, "x " * 1500 + "Cy"), (2, None)], "doc_id long, text string")
    model = detect.model_detector(words_encoder, names_model, [None, "private_person"])
    got = {r.doc_id: [(s.category, s.start, s.text) for s in r.spans] for r in detect.hybrid_detector(model)(docs).collect()}
    assert got[0] == [("private_person", 0, "Ann Lee"), ("private_email", 17, "a@b.de"), ("private_date", 27, "2020-01-02"), ("private_person", 41, "Bob")]
    assert got[1] == [("private_person", 3000, "Cy")] and got[2] == []
    assert detect.with_spans(docs, detect.regex_detector()).count() == 3
    tokens = detect.tokenize(docs, words_encoder).where("doc_id = 0").orderBy("tok_idx").collect()
    assert [(t.b0, t.b1) for t in tokens][:2] == [(0, 4), (4, 8)]


def test_evaluate_against_model(spark):
    rng = random.Random(9)
    cats = ["secret", "private_date"]
    rows, want = [], {c: [0, 0, 0, 0] for c in cats}
    for i in range(60):
        pred = [(rng.choice(cats), a, a + rng.randrange(1, 5)) for a in rng.sample(range(30), rng.randrange(5))]
        gold = [(rng.choice([*cats, None]), a, a + rng.randrange(1, 5)) for a in rng.sample(range(30), rng.randrange(5))]
        rows.append((i, pred, gold))
        hit = lambda a, b: a[1] < b[2] and b[1] < a[2]
        for g in gold:
            if g[0]:
                want[g[0]][0] += 1
                want[g[0]][1] += any(p[0] == g[0] and hit(p, g) for p in pred)
        for p in pred:
            good = any(p[0] == g[0] and hit(p, g) for g in gold)
            want[p[0]][2] += good
            want[p[0]][3] += not good and not any(g[0] is None and hit(p, g) for g in gold)
    span = "array<struct<category:string,start:int,end:int>>"
    scores = evaluate.report(spark.createDataFrame(rows, f"i int, spans {span}, labels {span}"))
    got = {r.category: r for r in scores.collect()}
    for c in cats:
        assert [got[c].gold, got[c].matched, got[c].good, got[c].fp] == want[c]
    assert got["OVERALL"].gold == sum(w[0] for w in want.values()) and 0 < got["OVERALL"].f1 < 1
    lines = [r.line for r in evaluate.table_lines(scores).orderBy("ord").collect()]
    assert [x.split()[0] for x in lines] == ["private_date", "secret", "OVERALL"] and lines[0].endswith("%")
    none = evaluate.report(spark.createDataFrame([(0, [], [("secret", 0, 1)])], f"i int, spans {span}, labels {span}")).first()
    assert math.isnan(none.precision) and none.recall == 0


def test_min_score(spark):
    df = spark.createDataFrame([([("secret", 0, 1, "a", 0.4), ("secret", 2, 3, "b", 0.6)],)], f"spans {S.SPANS}")
    assert [len(df.select(S.at_least("spans", t).alias("x")).first().x) for t in (0, 0.5, 0.9)] == [2, 1, 0]


def test_model_detector_scores_and_decodes_without_rows_of_tokens(spark):
    rows = [(1, "Ann " * 1100 + "x Bob"), (1, "x Cy"), (None, "Di x"), (2, None), (3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    labels = [None, "private_person"]
    out = detect.model_detector(words_encoder, names_model, labels)(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "Aggregate" not in plan
    got = [(r.doc_id, [(s.start, s.end) for s in r.spans]) for r in out.collect()]
    want = [(1, [(0, 4399), (4402, 4405)]), (1, [(2, 4)]), (None, [(0, 2)]), (2, []), (3, [])]  # rows of one id have their own
    assert sorted(got, key=str) == sorted(want, key=str)
    two = docs.where("doc_id > 1 OR length(text) > 9")
    tokens = D.decode(detect.score_windows(two, words_encoder, names_model), two, labels)
    assert sorted(map(tuple, tokens.collect()), key=str) == sorted(map(tuple, detect.model_detector(words_encoder, names_model, labels)(two).collect()), key=str)


def test_texts_are_scored_in_parts_and_by_many_tasks(spark, tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["a" * detect.PART_BYTES, None, "b", "c" * detect.PART_BYTES, "d"])], names=["doc_id", "text"])
    assert [p.column(0).to_pylist() for p in detect._parts([batch])] == [[0, 1], [2], [3], [4]]
    spark.range(40).selectExpr("id AS doc_id", "'x Ann' AS text").coalesce(1).write.parquet(str(tmp_path / "one"))
    docs = spark.read.parquet(str(tmp_path / "one"))  # a file of one row group
    out = detect.model_detector(words_encoder, names_model, [None, "private_person"])(docs)
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and out.count() == 40
