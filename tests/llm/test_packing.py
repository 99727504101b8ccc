import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import packing
from maskwright.llm.common import materialize

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def same(text):
    encode = packing.encoder(PATH)
    ids = np.frombuffer(encode.text(text), "<u4").tolist()
    return ids == [*encode.tokenizer.encode(text, add_special_tokens=False).ids, 0]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \u00c9's\u0301t<|endoftext>\n\t\u00df\u0130\u03a31\u096d\u2003\x1c\U0001f600\u200d\u00aa\u00b5\u00b2"), max_size=60))
def test_odd_texts_have_the_tokenizers_ids(text):
    assert same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcdefghilmnoprstu\u00e9\u00e8\u00fc\u00df\u00e7\u00d1\u0141'!.,_-$ 120\u201c\u2014\n"), max_size=200))
def test_plain_texts_have_the_tokenizers_ids(text):
    assert packing.encoder(PATH).words is not None and same(text)


def test_shipped_documents_have_the_tokenizers_ids():
    import pyarrow.parquet as pq

    encode = packing.encoder(PATH)
    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist():
        assert same(text) and not encode.ODD.search(text)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=25))
def test_plan_is_gapless_and_complete(counts):
    fill = {}
    ranks = {n: 0 for n in counts}
    for n, r0, r1, first, at, times in packing.plan(counts, 40):
        assert ranks[n] == r0
        ranks[n] = r1
        for r in range(r0, r1):
            b, k = divmod(r - r0, times)
            fill.setdefault(first + b, []).append((at + k * n, n))
    assert ranks == counts
    for parts in fill.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 40


def test_plan_needs_few_bins_and_few_rows():
    random.seed(1)
    counts = {n: random.randint(1, 50_000) for n in random.sample(range(1, 2049), 1500)}
    rows = packing.plan(counts, 2048)
    bins = max(first + -(-(r1 - r0) // times) for _, r0, r1, first, _, times in rows)
    assert len(rows) < 40_000
    large = sum(c for n, c in counts.items() if 2 * n > 2048)
    assert bins <= 1.01 * max(large, sum(n * c for n, c in counts.items()) / 2048) + 1


def test_against_brute_force(spark, plain):
    rng = random.Random(7)
    words = ["alpha", "Beta,", "γάμμα", "d-e-l", "42"]
    texts = [None, "", " ", "one"] + [" ".join(rng.choices(words, k=rng.choice([3, 40, 300, 900, 3000]))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)] + [(3, "one", "x", 0)], "doc_id long, text string, part string, length int")
    rows = packing.best_fit_packing(docs.repartition(5), PATH, 256).collect()
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    fill = {}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 256 * r.piece and len(piece) == r.length
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, ids.values())) + len(ids[3])
    for parts in fill.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 256
    assert packing.best_fit_packing(docs.limit(0), PATH, 256).count() == 0


def test_sequences_hold_the_ids(spark, plain):
    texts = ["some words here", "more", None, "the last of them " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    placed = materialize(packing.best_fit_packing(docs, PATH, 64), "placed")
    whole = {r.sequence_id: r.ids for r in packing.sequences(docs, placed, PATH).collect()}
    for r in placed.collect():
        ids = [*plain.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == ids[r.start : r.start + r.length]


def test_a_task_leaves_no_cached_words_to_its_worker(spark):
    import pyarrow as pa

    def held(batches):
        for batch in batches:
            has = packing.encoder.cache_info().currsize > 0
            n = sum(len(c) + len(c.older) for c in (packing.encoder(PATH).stretches, packing.encoder(PATH).words)) if has else -1
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows, pa.int64())], names=["n"])

    docs = spark.range(400).selectExpr("id AS doc_id", "concat('word', id, ' and \u4e2d', id) AS text").repartition(4)
    assert packing.pieces(docs, PATH).count() == 400
    left = [r.n for r in spark.range(0, 8, 1, 8).mapInArrow(held, "n long").collect()]
    assert max(left) == 0  # some of these workers were the same, and none holds a word
