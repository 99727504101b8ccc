"""From a token model's scores to spans, on rows of tokens: doc_id, tok_idx, b0, b1 (byte offsets) and logits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.functions.patterns import CATEGORIES

#: Tokens of a window, and how many two windows share; tokens of a batch, and rows of one at most.
WINDOW, OVERLAP, BATCH_TOKENS, BATCH_ROWS = 1024, 128, 4096, 16
BUCKETS = (64, 128, 256, 512, 1024)


def parse_labels(id2label: dict[str, str]) -> list[str | None]:
    """The category of each label id: none for ``O``, else what follows the first dash; ids must be 0, 1, 2 and so on."""
    ids = sorted(int(k) for k in id2label)
    if ids != list(range(len(ids))):
        raise ValueError("label ids must begin at 0 without gaps")
    out: list[str | None] = []
    for i in ids:
        label = id2label[str(i)]
        name = None if label == "O" else label.partition("-")[2] or label
        if name is not None and name not in CATEGORIES:
            raise ValueError(f"unknown label {label!r}")
        out.append(name)
    return out


def windows(n_tokens: Column | str, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """array<struct<win, tok_start, tok_end>>: one window if all tokens fit, else overlapping ones, the last cut short."""
    n = F.col(n_tokens) if isinstance(n_tokens, str) else n_tokens
    step = size - overlap
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda w: F.struct(w.alias("win"), (w * step).alias("tok_start"), F.least(w * step + size, n).cast("int").alias("tok_end"))))


def rows_per_batch(size: Column | str, most: int = BATCH_ROWS, override: int | None = None) -> Column:
    """How many windows of that length make a batch."""
    n = F.col(size) if isinstance(size, str) else size
    return F.lit(max(1, override)) if override is not None else F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(BATCH_TOKENS) / n).cast("int")))


def padded_length(size: Column | str) -> Column:
    """The least bucket that holds a window, or its own length beyond them."""
    n = F.col(size) if isinstance(size, str) else size
    return F.coalesce(*[F.when(n <= b, F.lit(b)) for b in BUCKETS], n)


def token_offsets(tokens: DataFrame, size: str = "n_bytes") -> DataFrame:
    """b0 and b1 of each token from the tokens' byte lengths, in order."""
    upto = F.sum(size).over(Window.partitionBy("doc_id").orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return tokens.withColumn("b1", upto).withColumn("b0", F.col("b1") - F.col(size))


def best_label(logits: Column | str) -> Column:
    """struct<label, prob>: the first of the highest scores, and its softmax."""
    x = F.col(logits) if isinstance(logits, str) else logits
    top = F.array_max(x)
    return F.struct((F.array_position(x, top) - 1).cast("int").alias("label"), (1 / F.aggregate(x, F.lit(0.0).cast("double"), lambda a, v: a + F.exp(v - top))).alias("prob"))


def decode(tokens: DataFrame, docs: DataFrame, labels: list[str | None], min_score: float = 0.0) -> DataFrame:
    """doc_id and spans.

    ``tokens`` may have ``win``, the window they were scored in. Neighbouring tokens of one category make a span, with
    their mean probability; B and I are not told apart, and a token without bytes ends a span. Spans of texts with more
    than one window are merged. Documents without spans get an empty array.
    """
    t = tokens if "win" in tokens.columns else tokens.withColumn("win", F.lit(0))
    names = F.array(*[F.lit(x).cast("string") for x in labels])
    t = t.withColumn("best", best_label("logits")).select("doc_id", "win", "tok_idx", "b0", "b1", F.col("best.prob").alias("prob"), F.when(F.col("b0") != F.col("b1"), F.get(names, F.col("best.label"))).alias("category"))
    order = Window.partitionBy("doc_id", "win").orderBy("tok_idx")
    new = F.col("category").isNull() | ~F.col("category").eqNullSafe(F.lag("category").over(order))
    island = t.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = island.where("category IS NOT NULL").groupBy("doc_id", "win", "island", "category").agg(F.min("b0").alias("start"), F.max("b1").alias("end"), F.avg("prob").alias("score"))
    found = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("win", "start", "end", "category", "score"))).alias("pieces"))
    wide = t.groupBy("doc_id").agg((F.max("win") > 0).alias("many"))
    out = docs.select("doc_id", "text").join(found, "doc_id", "left").join(wide, "doc_id", "left")
    return settled(out, min_score)


def settled(found: DataFrame, min_score: float = 0.0) -> DataFrame:
    """doc_id and spans of rows with text, pieces (by window and place) and whether there are ``many`` windows."""

    def trim(known: Column) -> Column:
        return F.filter(F.transform(known["pieces"], lambda p: S.trimmed(p["category"], p["start"], p["end"], p["score"], known["data"])), lambda s: s.isNotNull())

    spans = S.bind(F.struct(F.col("text").cast("binary").alias("data"), F.col("pieces").alias("pieces")), trim)
    out = found.withColumn("spans", F.coalesce(spans.cast(S.SPANS), S.no_spans()))
    merged = F.when(F.coalesce("many", F.lit(False)), S.merge_overlapping("spans", "text")).otherwise(F.col("spans"))
    return out.select("doc_id", S.at_least(merged, min_score).alias("spans"))
