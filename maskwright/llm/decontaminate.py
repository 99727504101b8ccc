"""Benchmark decontamination by a prefix-filtered join on word windows.

An item's windows of ``size`` consecutive words are ordered by rarity: every word of the benchmark is counted over all
documents, and the rarest word of a window is its prefix. A document can only hold a window if it holds that word, so
only occurrences of prefix words are looked at; where the window would not fit between the document's ends it is ruled
out by position and length, and else the words themselves are compared.

The benchmark's size is measured first. Up to BLOCK_BYTES of it go to the executors at once; a larger one is dealt into
blocks by item, each of which passes over all documents, and the blocks' hits are merged by document.

Defined cases: a null text has no words. An item without words has no window; one with fewer than ``size`` is a single
window. Items that repeat an item_id count once. An item without an id marks words but is not listed. Documents that
repeat a doc_id, or have none, are reported each, and each goes or stays by its own text. Texts of any length are taken
whole; an empty table gives no rows. Extra columns, whatever their names, are ignored (``decontaminate`` hands them on).
An empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import identity, keep, materialize, released

#: Bytes of benchmark text that are broadcast at once.
BLOCK_BYTES = 16_000_000
#: ASCII capitals to lower case, ASCII that is neither letter nor digit to a space; other bytes of UTF-8 stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
IDENTITY = "struct<none:boolean,id:long,h1:long,h2:long>"
FOUND = f"row long, identity {IDENTITY}, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def words(text: bytes | None) -> list[bytes]:
    """The words of UTF-8 text: maximal runs of a-z, 0-9 and all that is not ASCII, ASCII in lower case."""
    return text.translate(FOLD).split() if text else []


def windows(item: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    return {tuple(item[i : i + size]) for i in range(max(1, len(item) - size + 1))} if item else set()


def _counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each word of ``vocabulary``, which is bounded by the block, occurs in all documents."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(vocabulary)

    @released
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    n.update(filter(known.value.__contains__, words(text.as_buffer().to_pybytes())))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    seen = docs.select(F.col("text").cast("binary")).mapInArrow(run, "word binary, n long")
    return {bytes(r[0]): r[1] for r in seen.groupBy("word").agg(F.sum("n")).collect()}


def _index(items: list[tuple[str | None, bytes | None]], n: dict[bytes, int], size: int) -> dict:
    """Prefix word: {(its place in the window, the window's length): {window: ids of its items}}."""
    index: dict = {}
    for item_id, text in items:
        for w in windows(words(text), size):
            at = min(range(len(w)), key=lambda i: (n.get(w[i], 0), w[i], i))
            index.setdefault(w[at], {}).setdefault((at, len(w)), {}).setdefault(w, set()).add(item_id)
    return index


def search(doc: list[bytes], index: dict) -> tuple[list[tuple[int, int]], set]:
    """The merged spans of words inside any occurrence of a window, and the ids of the items with one."""
    spans: list[tuple[int, int]] = []
    items: set = set()
    for pos, word in [(i, w) for i, w in enumerate(doc) if w in index]:
        for (at, size), held in index[word].items():
            start = pos - at
            if start >= 0 and start + size <= len(doc) and (ids := held.get(tuple(doc[start : start + size]))):
                spans.append((start, start + size))
                items |= ids
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out, items - {None}


def find(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document: doc_id, n_words, spans of hit words, and items (sorted ids, as strings) with windows in it."""
    found = _find(docs, benchmark, size, block_bytes)
    return found.select(F.when(~F.col("identity.none"), F.col("identity.id")).alias("doc_id"), "n_words", "spans", "items")


def _find(docs: DataFrame, benchmark: DataFrame, size: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """identity, n_words, spans and items of each document."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("binary").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 if total <= block_bytes else 2 * -(-total // block_bytes)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), identity().alias("identity"), F.col("text").cast("binary").alias("text"))
    if blocks > 1:  # passes over a table that was written once, so that rows have the same numbers in each
        rows = materialize(rows, "numbered-texts")
        docs = rows
    parts = []
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        held = [(r["id"], bytes(r["text"]) if r["text"] is not None else None) for r in mine.collect()]  # block_bytes on average
        counts = _counts(docs, {w for _, text in held for w in words(text)})
        index = spark.sparkContext.broadcast(_index(held, counts, size))

        @released
        def run(batches: Iterator, index=index) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                n, spans, found = [], [], []
                for text in batch.column(2):
                    doc = words(text.as_buffer().to_pybytes()) if text.is_valid else []
                    hit, ids = search(doc, index.value)
                    n.append(len(doc))
                    spans.append([{"start": a, "end": b} for a, b in hit])
                    found.append(sorted(ids))
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(found, pa.list_(pa.string()))],
                    names=["row", "identity", "n_words", "spans", "items"],
                )

        parts.append(rows.mapInArrow(run, FOUND))
    if blocks == 1:
        return parts[0].drop("row")
    return _merged([materialize(p, "window-hits") for p in parts])


def _merged(parts: list[DataFrame]) -> DataFrame:
    """One row per document from those of each block."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.groupBy("row").agg(
        F.first("identity").alias("identity"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    merged = F.expr("""aggregate(spans, cast(array() as array<struct<start:int,end:int>>), (a, x) ->
        if(size(a) > 0 and x.start <= element_at(a, -1).end,
           concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(x.end, element_at(a, -1).end)))),
           concat(a, array(x))))""")
    return out.select("identity", "n_words", merged.alias("spans"), "items")


def report(found: DataFrame) -> DataFrame:
    """``find``'s rows with the spans as a number of words and the items as a digest."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no window of the benchmark."""
    return keep(docs, _find(docs, benchmark, size).select("identity", (F.size("spans") == 0).alias("kept")))
