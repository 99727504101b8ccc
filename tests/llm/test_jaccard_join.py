import math
import random
import re
from collections import Counter

import pytest

from maskwright.llm import jaccard_join as J
from maskwright.llm.components import components

SCHEMA = "doc_id long, text string, digest string, first int, rep string"


def case(n=120, seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        base = rng.choices(vocab, k=rng.choice([8, 40, 120]))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(rng.choice([" ", ", ", "\n"]).join(w).title())
    texts += [None, "", " .", "one two", "One, two!", "x " * 30_000, "same " * 9]
    rng.shuffle(texts)
    rows = [(i, t, "d", 1, "r") for i, t in enumerate(texts)]
    return [*rows, (3, rows[3][1], "d", 1, "r"), (None, rows[4][1], "d", 1, "r")]


def brute(rows, threshold=0.8, size=5):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    kinds = list(set(sets))
    links = {k: {o for o in kinds if o != k and k and o and len(k & o) >= threshold * len(k | o) - 1e-9} for k in kinds}
    root = {}
    for k in kinds:
        if k not in root:
            todo, seen = [k], {k}
            while todo:
                for o in links[todo.pop()] - seen:
                    seen.add(o)
                    todo.append(o)
            ids = [r[0] for r, s in zip(rows, sets, strict=True) if s in seen and r[0] is not None]
            root |= dict.fromkeys(seen, min(ids, default=None))
    return [(r[0], root[s], len(links[s]), sets.count(s)) for r, s in zip(rows, sets, strict=True)]


def test_against_brute_force(spark):
    rows = case()
    got = [tuple(r)[:4] for r in J.jaccard_join(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    want = brute(rows)
    assert sum(w[2] > 0 for w in want) > 40
    assert sorted(got, key=str) == sorted(want, key=str)


def test_hot_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", 7)
    rng = random.Random(1)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            w[rng.randrange(150)] = f"v{i}"
        rows.append((i, " ".join(w), "", 0, ""))
    got = [tuple(r)[:4] for r in J.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_one_of_each_class_stays(spark):
    rows = case(40, 6)
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = J.keep_first(docs)
    assert kept.columns == docs.columns
    want = {w[1] for w in brute(rows)}
    assert {r.doc_id for r in kept.collect()} == want
    assert J.keep_first(docs.limit(0)).count() == 0


def test_prefix_is_shortened_to_the_recall():
    assert J.depth_for(0.8, 20, 6, 0.9999) == 4
    assert J.depth_for(0.8, 16, 6, 0.5) == 6
    assert J.depth_for(0.2, 4, 6, 0.999) == 1


@pytest.mark.parametrize("sizes", [[2, 2, 2], [900, 500, 2], [2, 1, 1]])
def test_only_as_many_prefixes_are_shortened_as_the_recall_needs(sizes):
    nodes = [(t, sizes if t % 2 else [5000, 5000, 4000]) for t in range(20)]
    length = J.shorten(nodes, 4, 6, 20, 0.8, 0.9999)
    miss = lambda d: 1 - 0.8**d
    missed = math.prod(miss(d) for d in length.values())
    assert set(length) == set(range(20)) and missed <= 1e-4
    # The last step was needed, and the dear nodes stay deep.
    assert missed * miss(5) / miss(4) > 1e-4 or missed * miss(6) / miss(5) > 1e-4
    assert sum(length.values()) > 4 * 20
    alone = J.shorten([], 4, 6, 20, 0.8, 0.9999)
    assert alone == {}


def test_one_pair(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(0, text, "", 0, ""), (1, text + " more", "", 0, ""), (2, "something else", "", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = [(0, 0, 1, 1), (1, 0, 1, 1), (2, 2, 0, 1)]
    assert sorted(tuple(r)[:4] for r in J.jaccard_join(docs).collect()) == want
    assert sorted(r.doc_id for r in J.keep_first(docs).collect()) == [0, 2]


def test_blocks_over_batches_and_partitions(spark):
    rows = case(30, 9)
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = [tuple(r)[:4] for r in J.jaccard_join(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_runs():
    import pyarrow as pa

    batch = lambda k, v: pa.RecordBatch.from_arrays([pa.array(k), pa.array(v)], names=["k", "v"])
    got = [(g["k"].tolist(), g["v"].tolist()) for g in J.runs(iter([batch([1, 1], [1, 2]), batch([1], [3]), batch([], []), batch([2, 3, 3], [4, 5, 6]), batch([4], [7])]), 1, ["k", "v"])]
    assert got == [([1, 1, 1], [1, 2, 3]), ([2], [4]), ([3, 3], [5, 6]), ([4], [7])]
    assert list(J.runs(iter([]), 1, ["k", "v"])) == []


def test_missing_and_repeated_ids_and_odd_columns(spark):
    rows = [(None if i % 3 == 0 else i // 2, t) for i, (_, t, *_) in enumerate(case(40, 11))]
    names = ["doc_id", "text", "_id", "_sha", "identity", "_n", "_stay", "rep", "text_sha256", "hash", "first", "key"]
    docs = spark.createDataFrame([(*r, *["x"] * 10) for r in rows], ", ".join(["doc_id long", "text string", *(f"`{c}` string" for c in names[2:])])).repartition(3)
    got = sorted((tuple(r)[:4] for r in J.jaccard_join(docs).collect()), key=str)
    assert got == sorted(brute([(*r, "", 0, "") for r in rows]), key=str)
    kept = J.keep_first(docs)
    assert kept.columns == names
    groups = {}
    for r, (_, class_id, links, _) in zip(rows, brute([(*r, "", 0, "") for r in rows]), strict=True):
        groups.setdefault((class_id, links > 0, r[1] if class_id is None else None), []).append(r)
    assert 0 < kept.count() < len(rows) and kept.select("text").distinct().count() == kept.count()


def test_recall_on_every_twentieth_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sets, holders = {}, {}
    for i, t in docs.select("doc_id", "text").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(hash(tuple(w[k : k + 5])) for k in range(max(1, len(w) - 4))) if w else frozenset()
        for x in sets[i]:
            holders.setdefault(x, []).append(i)
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.jaccard_join(docs).collect()}
    want = found = 0
    for i in (i for i in sets if i % 20 == 0):
        common = Counter(j for x in sets[i] for j in holders[x])
        near = [j for j, n in common.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9]
        links = len({sets[j] for j in near} - {sets[i]})
        want, found = want + links, found + got[i][1]
        assert got[i][1] <= links and (got[i][1] < links or all(got[j][0] == got[i][0] for j in near))
    assert want > 5 and found >= 0.99 * want


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60) if i % 13] + [(500, i) for i in range(200, 260)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {x: find(x) for x in parent if find(x) != x}
