"""Substring dedup by sliding sentence spans.

A span is a run of at least MIN_SENTENCES consecutive sentences with at least MIN_WORDS words. All sentences that any but
the first of equal spans covers are removed, over the whole corpus, in order of doc_id and place. Of the spans only the
shortest from each sentence on and the shortest up to each sentence are hashed, to 128 bits: whatever sentence a longer
repeated span covers is in one of those within it, so the same sentences are removed as if every run were hashed.

A task first compares the spans it holds itself, so of a span that a third of the corpus repeats each task passes on
one; those meet by hash in one shuffle, and the places of repeated spans go back to their documents by another. Where at
most BROADCAST_ROWS documents have any, a broadcast of their ids first keeps all other texts where they are.

Defined cases: a character of a script that is written without spaces counts as a word. Sentences end after ``.``, ``!``
or ``?`` (and closing quotes or brackets) before white space, after their full-width forms, and at a line's end; white
space within them doesn't count. A null text stays null, with no sentences; an empty one stays empty. A passage of one
sentence, or of fewer words, is no span, so it stays. Texts of any length are read whole. Rows that repeat both doc_id
and text are one document and get the same result each; rows that repeat an id with another text are ordered by a hash of
it. Rows without a doc_id come after all others. An empty table gives no rows. Extra columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import BROADCAST_ROWS, materialize

#: Half of 50, as the first and last sentences of a passage of 50 words may run on into other text.
MIN_SENTENCES, MIN_WORDS = 2, 25
#: Spans that a task compares at once.
HELD = 400_000
END = re.compile(r"(?:[.!?…]+[\"')\]»”’]*(?=\s)|[。！？]+|\n)\s*")
#: Scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana and the Han characters.
SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
SPANS = "h1 long, h2 long, did long, tid long, pos int, size int, again boolean"
CLEAN = "doc_id long, n_sentences long, n_removed long, spans array<struct<start:int,end:int>>, text string"


def sentences(text: str) -> list[tuple[int, int]]:
    """Where sentences begin and end, with the white space that follows them."""
    cuts = [0, *(m.end() for m in END.finditer(text)), len(text)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b and not text[a:b].isspace()]


def _sizes(text: str) -> tuple[list[int], list[bytes]]:
    """The number of words and the digest of each sentence."""
    from xxhash import xxh3_128_digest

    n, digests = [], []
    for a, b in sentences(text):
        w = text[a:b].split()
        plain = " ".join(w)
        n.append(len(w) if plain.isascii() else len(SPACELESS.sub(" x ", plain).split()))
        digests.append(xxh3_128_digest(plain))
    return n, digests


def spans(text: str, least: int = MIN_SENTENCES, words: int = MIN_WORDS) -> list[tuple[int, int, bytes]]:
    """(first sentence, number of sentences, digest) of the shortest span from each sentence on, and up to each."""
    from xxhash import xxh3_128_digest

    n, digests = _sizes(text)
    upto = [0]
    for k in n:
        upto.append(upto[-1] + k)
    enough = lambda i, j: j - i >= least and upto[j] - upto[i] >= words
    places, j = set(), 0
    for i in range(len(n)):
        while j < len(n) and not enough(i, j):
            j += 1
        if not enough(i, j):
            break
        places.add((i, j))
    i = 0
    for j in range(1, len(n) + 1):
        while enough(i + 1, j):
            i += 1
        if enough(i, j):
            places.add((i, j))
    return [(i, j - i, xxh3_128_digest(b"".join(digests[i:j]))) for i, j in sorted(places)]


def _spans(docs: DataFrame, least: int, words: int) -> DataFrame:
    """A row per span; ``again`` where the task has seen an earlier equal one."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def flush(keys: list[bytes], places: list[tuple]):
            h = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            did, tid, pos, size = (np.array(c, dtype=np.int64) for c in zip(*places, strict=True))
            order = np.lexsort((pos, tid, did, h[:, 1], h[:, 0]))
            h, did, tid, pos, size = h[order], did[order], tid[order], pos[order], size[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]).any(axis=1)
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            again = (did != did[first]) | (tid != tid[first]) | (pos != pos[first])
            h1 = np.where(again, tid ^ pos * 0x9E3779B1, h[:, 0])  # these need not meet anything
            # Of the first and the rows that repeat it, one goes on.
            some = new | again
            columns = (h1, np.where(again, -1, h[:, 1]), did, tid, pos, size, again)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c[some], t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in SPANS.split(", ")])

        keys: list[bytes] = []
        places: list[tuple] = []
        for batch in batches:
            for did, tid, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, n, digest in spans(text or "", least, words):
                    keys.append(digest)
                    places.append((did, tid, i, n))
            if len(keys) >= HELD:
                yield flush(keys, places)
                keys, places = [], []
        if keys:
            yield flush(keys, places)

    return docs.mapInArrow(run, SPANS)


def substring_dedup(docs: DataFrame, least: int = MIN_SENTENCES, words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_sentences, n_removed, the removed stretches of the text, and the text without them."""
    # An id for sorting and joining that is never null, and what tells rows with one id apart.
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    keyed = docs.select(did.alias("did"), F.xxhash64("text").alias("tid"), "text")
    found = _spans(keyed, least, words)
    rank = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("did", "tid", "pos"))
    repeated = found.withColumn("rank", rank).where("again OR rank > 1")
    marks = materialize(repeated.groupBy("did", "tid").agg(F.collect_set(F.struct("pos", "size")).alias("marks")), "span-marks")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), did.alias("did"), F.xxhash64("text").alias("tid"), "text")
    if marks.count() <= BROADCAST_ROWS:
        # Only ids are broadcast, two numbers each; the texts that they name move to their marks, the others stay.
        ids = F.broadcast(marks.select("did", "tid"))
        untouched = rows.join(ids, ["did", "tid"], "left_anti").withColumn("marks", F.lit(None).cast(marks.schema["marks"].dataType))
        rows = rows.join(ids, ["did", "tid"], "left_semi").join(marks.hint("merge"), ["did", "tid"]).unionByName(untouched)
    else:
        rows = rows.join(marks, ["did", "tid"], "left")
    rows = rows.select("doc_id", "text", "marks")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n, removed, cut, texts = [], [], [], []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                places = sentences(text or "")
                gone = sorted({i for m in marks or () for i in range(m["pos"], m["pos"] + m["size"])})
                stretches: list[list[int]] = []
                for a, b in (places[i] for i in gone):
                    if stretches and stretches[-1][1] == a:
                        stretches[-1][1] = b
                    else:
                        stretches.append([a, b])
                if stretches:
                    ends = [0, *(x for s in stretches for x in s), len(text)]
                    text = "".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                n.append(len(places))
                removed.append(len(gone))
                cut.append([{"start": a, "end": b} for a, b in stretches])
                texts.append(text)
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(cut, span), pa.array(texts, pa.string())],
                names=[c.split()[0] for c in ("doc_id long", "n_sentences long", "n_removed long", "spans a", "text string")],
            )

    return rows.mapInArrow(run, CLEAN)
