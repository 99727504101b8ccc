"""Best-fit packing with large-item matching.

Tokenising is one pass of Arrow batches. What packing needs of a piece is only its length, so the plan is made on the
histogram of lengths: at most ``capacity`` rows, whatever the corpus. Pieces above one third of the capacity, of which
no three fit, are paired by greedy matching, each with the longest that still fits; then the shorter ones, longest
first, fill the smallest gap that takes them. Both work on runs of equal bins, so the plan's size and time depend on
the capacity alone. Pieces find their place by their rank among the pieces of equal length: each task numbers its own,
and sums over (task, length) do the rest, so a length that a third of the pieces share meets in no single task.

Defined cases: a null or empty text is the end id alone. Repeated rows, and rows without a doc_id, are packed each. Only
documents longer than the capacity are cut, however long; no id is lost. Pieces of equal length are placed in any order. An
empty table gives no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import materialize, released, sliced, spread

#: Entries of each half of a task's cache of tokenised words; when one is full it replaces the other.
CACHE = 60_000
BLANK = re.compile(r"[ \t\n\r\x0b\x0c]+")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


class Pieces(dict):
    """The ids of a word, which the model splits on its own, as little-endian unsigned 32-bit bytes."""

    def __init__(self, ids: Callable[[str], list[int]]):
        super().__init__()
        self.ids, self.older = ids, {}

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            ids = self.ids(word)
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 40:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out

    def forget(self) -> None:
        self.older = {}
        self.clear()


class Encoder:
    """A text's ids as little-endian unsigned 32-bit bytes, the same as the tokenizer's.

    The tokenizer drops white space and looks at nothing across it, so a text's ids are those of its stretches. Where a
    text is of plain letters, digits and punctuation, whose normal form is themselves, and the tokenizer is of the kind
    known here, its words are split off by the same pattern and merged by the same ranks in tiktoken, which is quicker:
    the last byte of a word and the mark of its end are one symbol, which in ranks is their first merge. Every worker
    first holds this against the tokenizer on its own vocabulary's words, and leaves it where one differs.
    """

    #: Fixed values of this kind of tokenizer: its pattern, the same for plain text in lower case, and its suffix.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017e]+|[0-9]|[^\sa-z0-9\u00df-\u00f6\u00f8-\u017e]+"
    SUFFIX = "</w>"
    #: Plain text holds none of these.
    ODD = re.compile(r"[^\t\n\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u017e\u2013\u2014\u2018-\u201e\u2026]|<\|")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.stretches = Pieces(lambda w: self.tokenizer.encode(w, add_special_tokens=False).ids)
        self.split = re.compile(self.PLAIN_PATTERN).findall
        self.words = self._ranked()

    def _ranked(self) -> Pieces | None:
        import json

        import tiktoken

        spec = json.loads(self.tokenizer.to_str())
        split = [x for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        model = spec["model"]
        if kinds != ["NFC", "Replace", "Lowercase"] or [x["pattern"].get("Regex") for x in split] != [self.PATTERN] or model.get("end_of_word_suffix") != self.SUFFIX or model["dropout"]:
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from 256 on
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = {x["content"] for x in spec["added_tokens"]}
        end = b"\xff"  # in no UTF-8
        plain = {t: i for t, i in model["vocab"].items() if t not in special}
        ranks = {bytes(byte[c] for c in t.removesuffix(self.SUFFIX)) + end * t.endswith(self.SUFFIX): i for t, i in plain.items()}
        core = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        words = Pieces(lambda w: core.encode_single_piece(w.encode() + end))
        whole = [t.removesuffix(self.SUFFIX) for t in list(plain)[512::9]]
        text = " ".join(w for w in (bytes(byte[c] for c in t).decode("utf-8", "ignore") for t in whole) if w and not self.ODD.search(w))
        same = b"".join(map(words.__getitem__, self.split(text.lower()))) == struct.pack(f"<{len(i := self.tokenizer.encode(text, add_special_tokens=False).ids)}I", *i)
        return words if same else None

    def text(self, text: str | None, end_id: int = 0) -> bytes:
        text = text or ""
        if self.words is not None and not self.ODD.search(text):
            ids = b"".join(map(self.words.__getitem__, self.split(text.lower())))
        else:
            ids = b"".join(map(self.stretches.__getitem__, BLANK.split(text)))
        return ids + struct.pack("<I", end_id)

    def forget(self) -> None:
        """Empty the caches, which a worker would hold through the steps that follow."""
        for cache in (self.stretches, self.words):
            if cache is not None:
                cache.forget()


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each worker; its caches serve a task."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """A row per piece: where it starts in its document's ids, its length and checksum, its task and number there."""

    @released
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encode, part, seen, step = encoder(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1), 4 * capacity
        for batch in sliced(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode.text(text, end_id)
                for k, at in enumerate(range(0, len(ids), step)):
                    piece = ids[at : at + step]
                    n = len(piece) // 4
                    rows.append((doc_id, k, at // 4, n, zlib.crc32(piece), part, seen[n]))
                    seen[n] += 1
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])
        encode.forget()

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, from rank, to rank, first sequence, offset, pieces per sequence).

    There are at most about 6 x capacity runs of equal bins, with at most sqrt(2 x capacity) lengths in each: the plan
    has fewer than 400,000 rows for a capacity of 2048, and a few thousand in practice.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of bins (how many, the first's number)
    order: list[int] = []  # the gaps, ascending
    bins = 0

    def add(gap: int, run: tuple[int, int]) -> None:
        if gap and run[0]:
            if gap not in gaps:
                gaps[gap] = []
                order.insert(bisect_left(order, gap), gap)
            gaps[gap].append(run)

    def put(n: int, many: int, first: int, offset: int, times: int) -> None:
        out.append((n, rank[n], rank[n] + many, first, offset, times))
        rank[n] += many
        left[n] -= many

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= n and n + m <= capacity and left[m] > (m == n)), None)
            many = left[n] if mate is None else left[n] // 2 if mate == n else min(left[n], left[mate])
            put(n, many, bins, 0, 1)
            if mate is not None:
                put(mate, many, bins, n, 1)
            add(capacity - n - (mate or 0), (many, bins))
            bins += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(order, n)
            if at == len(order):
                new = -(-left[n] // (capacity // n))
                add(capacity, (new, bins))
                bins += new
                continue
            gap = order[at]
            many, first = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            times = gap // n
            full = min(many, left[n] // times)
            if not full:
                full, times = 1, left[n]
            put(n, full * times, first, capacity - gap, times)
            add(gap, (many - full, first + full))
            add(gap - n * times, (full, first))
    return out


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (written in the shared folder, as ``part`` and ``nth`` must stay) with sequence_id and offset."""
    spark = pieces.sparkSession
    by_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    places = spark.createDataFrame(plan(counts, capacity), "len long, r0 long, r1 long, first long, at long, times long")
    placed = pieces.join(base, ["part", "length"]).withColumn("r", F.col("base") + F.col("nth"))
    here = (F.col("length") == F.col("len")) & (F.col("r") >= F.col("r0")) & (F.col("r") < F.col("r1"))
    placed = placed.join(F.broadcast(places), here)  # the bound is in plan()
    k = F.col("r") - F.col("r0")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.expr("(r - r0) div times")).alias("sequence_id"),
        (F.col("at") + (k % F.col("times")) * F.col("length")).alias("offset"),
    )


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The placement of every piece of every document."""
    return pack(materialize(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """The packed sequences: sequence_id and its ids, each piece at its place. Needs ids that occur once in ``docs``."""

    @released
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encode = encoder(tokenizer)
        for batch in batches:
            rows = batch.to_pylist()
            ids = [np.frombuffer(encode.text(r["text"], end_id), "<u4")[r["start"] : r["start"] + r["length"]].tolist() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], pa.int64()) for c in ("sequence_id", "offset")] + [pa.array(ids, pa.list_(pa.int32()))],
                names=["sequence_id", "offset", "ids"],
            )
        encode.forget()

    joined = placed.join(docs.select("doc_id", "text"), "doc_id")
    parts = joined.select("sequence_id", "offset", "start", "length", "text").mapInArrow(run, "sequence_id long, offset long, ids array<int>")
    in_order = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(in_order, lambda x: x["ids"])).alias("ids"))
