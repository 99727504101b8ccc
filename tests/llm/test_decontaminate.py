import hashlib
import random
import re

from maskwright.llm import decontaminate as D

DOCS = "doc_id long, text string, row int, items string"


def brute(docs, bench, size):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for doc_id, text, *_ in docs:
        w, hit, items = low(text), set(), set()
        for item_id, t in bench:
            i = low(t)
            for k in range(max(1, len(i) - size + 1)) if i else ():
                g = i[k : k + size]
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit |= set(range(p, p + len(g)))
                        items.add(item_id)
        ids = ",".join(sorted(str(i) for i in items - {None}))
        out.append((doc_id, len(w), len(hit), len(items - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def case():
    rng = random.Random(3)
    vocab = ["a", "B", "ç", "dd", "e9", "F", " g"]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bench = [(i, line(rng.choice([1, 2, 3, 5, 7, 12]))) for i in range(8)] + [(20, None), (21, "..."), (3, line(6)), (None, line(4))]
    docs = [(i, line(rng.choice([0, 1, 4, 30])).replace(" ", rng.choice([" ", ", ", "\n"])), 1, "x") for i in range(40)]
    docs += [(40, bench[5][1], 1, "x"), (40, None, 1, "x"), (None, bench[4][1].upper(), 1, "x"), (41, "", 1, "x"), (42, line(20_000), 1, "x")]
    return docs, bench


def test_against_brute_force(spark):
    docs, bench = case()
    frames = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(bench, "item_id long, text string")
    want = brute(docs, bench, 4)
    assert sorted(map(tuple, D.report(D.find(*frames, size=4)).collect()), key=str) == want
    # A benchmark beyond the bound goes block by block, to the same rows.
    assert sorted(map(tuple, D.report(D.find(*frames, size=4, block_bytes=120)).collect()), key=str) == want


def test_filter_and_empty_tables(spark):
    docs, bench = case()
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id long, text string")
    bad = {(r[0], r[1], r[2]) for r in docs if brute([r], bench, 4)[0][5]}
    kept = D.decontaminate(d, b, 4)
    assert kept.columns == ["doc_id", "text", "row", "items"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted((r[:2] for r in docs if r[:3] not in bad), key=str)
    assert D.report(D.find(d.limit(0), b)).count() == 0
    assert not any(r.contaminated for r in D.report(D.find(d, b.limit(0))).collect())


def test_filter_keeps_all_columns(spark):
    rows = [(None, "one two three four five"), (None, "clean"), (7, "clean"), (7, "x one two three four"), (8, None), (8, None)]
    docs = spark.createDataFrame([(*r, 1, "a", "b") for r in rows], "doc_id long, text string, _id long, identity string, _n string")
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    out = D.decontaminate(docs, bench, 4)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(None, "clean"), (7, "clean"), (8, None), (8, None)], key=str)
