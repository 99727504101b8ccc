"""Detection: the pattern pass, and a token model on what it leaves, behind one interface.

A detector is a function of a frame (doc_id, text) to a frame (doc_id, spans). ``regex_detector`` needs no Python.
``hybrid_detector`` masks what patterns find, so that a model sees less, and combines both. Where a detector's result is
joined to texts, these are first written with a number for each row, so missing or repeated ids lose nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructType

from maskwright.functions import spans as S
from maskwright.operators.decode import BATCH_ROWS, BATCH_TOKENS, BUCKETS, OVERLAP, WINDOW, parse_labels, settled
from maskwright.operators.shared import fresh, materialize

Detector = Callable[[DataFrame], DataFrame]
#: Bytes of the texts whose tokens a worker holds at once.
PART_BYTES = 1 << 18


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` dealt out anew where there are few files: a file of one row group is one task else, and the pattern pass
    is bound by the processor."""
    return docs.repartition(docs.sparkSession.sparkContext.defaultParallelism) if len(docs._jdf.inputFiles()) < 2 else docs  # counted in the JVM


def regex_detector(min_score: float = 0.0) -> Detector:
    """Spans of the pattern pass; all of them score 1, and ``min_score`` applies to them as to any."""
    return lambda docs: docs.select("doc_id", S.at_least(F.coalesce(S.regex_spans("text"), S.no_spans()), min_score).alias("spans"))


def hybrid_detector(model: Detector, min_score: float = 0.0) -> Detector:
    """Pattern pass, then ``model`` on the masked texts, both combined; ``min_score`` holds for the model's spans only."""

    def detect(docs: DataFrame) -> DataFrame:
        row = F.monotonically_increasing_id()
        first = docs.select("doc_id", "text", row.alias("row"), F.coalesce(S.regex_spans("text"), S.no_spans()).alias("regex"))
        first = materialize(first.withColumn("masked", S.mask("text", "regex")), "masked")
        found = model(first.select(F.col("row").alias("doc_id"), F.col("masked.text").alias("text"))).select(F.col("doc_id").alias("row"), F.col("spans").alias("model"))
        both = first.join(found, "row", "left")
        theirs = S.at_least(F.coalesce("model", S.no_spans()), min_score)
        return both.select("doc_id", F.coalesce(S.combine("text", "regex", theirs, "masked.segments"), S.no_spans()).alias("spans"))

    return detect


def with_spans(docs: DataFrame, detector: Detector) -> DataFrame:
    """``docs`` and their spans, each row with its own."""
    row, found = fresh(docs, "_row", "_spans")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-texts")
    spans = detector(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), F.col("spans").alias(found))
    return rows.join(spans, row, "left").select(*docs.columns, F.coalesce(found, S.no_spans()).alias("spans"))


def above(spans: DataFrame, min_score: float | None, serving: float) -> DataFrame:
    """A request's spans: those with the score that it asks for, or else the server's, patterns' and model's alike."""
    return spans.withColumn("spans", S.at_least("spans", serving if min_score is None else min_score))


def tokenize(docs: DataFrame, encode: Callable[[], Callable[[str], list[tuple[int, int]]]]) -> DataFrame:
    """doc_id, tok_idx, tok_id, b0 and b1. ``encode`` makes, on a worker, a function of a text to (id, bytes) pairs."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tokens = encode()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = 0
                for i, (token, size) in enumerate(tokens(text) if text else ()):
                    rows.append((doc_id, i, token, at, at + size))
                    at += size
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.int32()] * 4), strict=True)], names=["doc_id", "tok_idx", "tok_id", "b0", "b1"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, tok_idx int, tok_id int, b0 int, b1 int")


def tiktoken_encoder(path: str, pattern: str) -> Callable[[], Callable[[str], list[tuple[int, int]]]]:
    """An ``encode`` for ``tokenize`` from a file of ranks."""

    def make():
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda text: [(t, len(encoding.decode_single_token_bytes(t))) for t in encoding.encode_ordinary(text)]

    return make


def _scored(texts: list[str | None], tokens: Callable, model: Callable) -> Iterator:
    """For each batch of windows: the windows (row, win, first token, ids, ends in bytes), their mask and their logits.

    Windows are sorted by length, so little is padded.
    """
    import numpy as np

    todo = []
    for row, text in enumerate(texts):
        pairs = tokens(text) if text else []
        flat = np.fromiter(chain.from_iterable(pairs), np.int64, 2 * len(pairs)).reshape(-1, 2)
        ids, ends = flat[:, 0], np.concatenate(([0], np.cumsum(flat[:, 1])))
        at, win = 0, 0
        while at < len(ids):
            end = min(at + WINDOW, len(ids))
            todo.append((row, win, at, ids[at:end], ends[at : end + 1]))
            if end == len(ids):
                break
            at, win = at + WINDOW - OVERLAP, win + 1
    todo.sort(key=lambda w: -len(w[3]))
    at = 0
    while at < len(todo):
        size = next((n for n in BUCKETS if len(todo[at][3]) <= n), len(todo[at][3]))  # few shapes, so a model is planned seldom
        now = todo[at : at + max(1, min(BATCH_ROWS, BATCH_TOKENS // size))]
        at += len(now)
        ids = np.zeros((len(now), size), np.int64)
        mask = np.zeros_like(ids)
        for i, w in enumerate(now):
            ids[i, : len(w[3])], mask[i, : len(w[3])] = w[3], 1
        yield now, mask, np.asarray(model(ids, mask), np.float64)


def _parts(batches: Iterator) -> Iterator:
    """Rows of ``batches``, whose last column is the text, in parts of few bytes; a longer text is a part of its own."""
    import pyarrow.compute as pc

    for batch in batches:
        at, held = 0, 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist()):
            if held and held + size > PART_BYTES:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += size
        yield batch.slice(at)


def score_windows(docs: DataFrame, encode: Callable, run_model: Callable[[], Callable]) -> DataFrame:
    """doc_id, win, tok_idx, b0, b1 and logits of each token of each window.

    ``run_model`` makes, on a worker, a function of token ids and mask (two arrays, padded to one length) to logits.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tokens, model = encode(), run_model()
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()))
        for part in _parts(batches):
            ids = part.column(0).to_pylist()
            for now, _, logits in _scored(part.column(1).to_pylist(), tokens, model):
                rows = [(ids[w[0]], w[1], w[2] + k, int(w[4][k]), int(w[4][k + 1]), logits[i, k].tolist()) for i, w in enumerate(now) for k in range(len(w[3]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "win", "tok_idx", "b0", "b1", "logits"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, win int, tok_idx int, b0 int, b1 int, logits array<double>")


def window_pieces(docs: DataFrame, encode: Callable, run_model: Callable[[], Callable], labels: list[str | None]) -> DataFrame:
    """``docs`` (doc_id, text) with pieces and many, as ``decode.settled`` reads them.

    What ``decode`` does to the tokens of ``score_windows``, where they are scored: tokens become no rows and aren't
    shuffled, and each row has its own pieces, whatever its doc_id.
    """
    names = sorted({x for x in labels if x is not None})

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        tokens, model = encode(), run_model()
        for part in _parts(batches):
            many = np.zeros(part.num_rows, bool)
            found = [np.empty((0, 5), np.int64)]
            scores = [np.empty(0)]
            for now, mask, logits in _scored(part.column(1).to_pylist(), tokens, model):
                size, kinds = mask.shape[1], logits.shape[2]
                code_of = np.array([names.index(x) if x is not None else -1 for x in [*labels, *[None] * kinds][:kinds]])
                ends = np.zeros((len(now), size + 1), np.int64)
                for i, w in enumerate(now):
                    ends[i, : len(w[4])] = w[4]
                    many[w[0]] |= w[1] > 0
                top = logits.max(axis=2)
                total = np.zeros(top.shape)
                for k in range(kinds):
                    total += np.exp(logits[:, :, k] - top)
                code = np.where((mask > 0) & (ends[:, 1:] != ends[:, :-1]), code_of[logits.argmax(axis=2)], -1)
                edge = np.full((len(now), 1), -1)
                first = (code >= 0) & (code != np.hstack((edge, code[:, :-1])))
                last = (code >= 0) & (code != np.hstack((code[:, 1:], edge)))
                row, a = np.nonzero(first)
                b = np.nonzero(last)[1]
                if not len(row):
                    continue
                bounds = np.stack((row * size + a, row * size + b + 1), axis=1).ravel()
                sums = np.add.reduceat(np.append((1 / total).ravel(), 0.0), bounds)[::2]
                where = np.array([w[:2] for w in now])[row]
                found.append(np.column_stack((where, ends[row, a], ends[row, b + 1], code[row, a])))
                scores.append(sums / (b + 1 - a))
            all_, score = np.concatenate(found), np.concatenate(scores)
            order = np.lexsort((all_[:, 2], all_[:, 1], all_[:, 0]))  # by row, window and place
            all_, score = all_[order], score[order]
            upto = np.concatenate(([0], np.cumsum(np.bincount(all_[:, 0], minlength=part.num_rows))))
            category = pa.array(names, pa.string()).take(pa.array(all_[:, 4]))
            pieces = pa.StructArray.from_arrays([pa.array(all_[:, 2], pa.int32()), pa.array(all_[:, 3], pa.int32()), category, pa.array(score)], names=["start", "end", "category", "score"])
            lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pieces)
            yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(many)], names=["doc_id", "text", "pieces", "many"])

    rows = spread(docs.select("doc_id", "text"))
    piece = StructType().add("start", IntegerType()).add("end", IntegerType()).add("category", StringType()).add("score", DoubleType())
    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("pieces", ArrayType(piece)).add("many", BooleanType()))


def onnx_model(path: str, threads: int = 2) -> Callable[[], Callable]:
    """A ``run_model`` for ``score_windows`` from an ONNX graph with input_ids, attention_mask and one output."""

    def make():
        import onnxruntime  # the graph is read once a worker

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = threads
        session = onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])
        return lambda ids, mask: session.run(None, {"input_ids": ids, "attention_mask": mask})[0]

    return make


def model_detector(encode: Callable, run_model: Callable, labels: list[str | None], min_score: float = 0.0) -> Detector:
    """Spans of a token model alone."""
    return lambda docs: settled(window_pieces(docs, encode, run_model, labels), min_score)


def labels_of(config: str) -> list[str | None]:
    """The categories of a model's label ids, from the text of its config.json."""
    import json

    return parse_labels(json.loads(config)["id2label"])
