"""Scores of predicted spans against labels, by category and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.patterns import CATEGORIES


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def flags(docs: DataFrame, predicted: str = "spans", labels: str = "labels") -> DataFrame:
    """A row for each label and each prediction: category, gold, matched, good and fp.

    A label is matched by any prediction of its category that shares a byte; a prediction is good likewise. One that
    only meets a label without category counts neither way. Spans of a text stay in its row, so nothing is joined.
    """
    same = lambda a, b: a["category"].eqNullSafe(b["category"]) & overlaps(a, b)
    none = F.array().cast("array<struct<category:string,start:int,end:int>>")
    bare = lambda c: F.coalesce(F.transform(c, lambda s: F.struct(s["category"], s["start"], s["end"])), none)
    docs = docs.select(bare(F.col(predicted)).alias("p"), bare(F.col(labels)).alias("g"))
    one = lambda cond: cond.cast("long")
    gold = F.transform(
        F.filter("g", lambda x: x["category"].isNotNull()),
        lambda x: F.struct(x["category"].alias("category"), F.lit(1).cast("long").alias("gold"), one(F.exists("p", lambda y: same(x, y))).alias("matched"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("fp")),
    )

    def judged(y: Column) -> Column:
        good = F.exists("g", lambda x: same(x, y))
        spared = F.exists("g", lambda x: x["category"].isNull() & overlaps(x, y))
        return F.struct(y["category"].alias("category"), F.lit(0).cast("long").alias("gold"), F.lit(0).cast("long").alias("matched"), one(good).alias("good"), one(~good & ~spared).alias("fp"))

    return docs.select(F.explode(F.concat(gold, F.transform("p", judged))).alias("f")).select("f.*")


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, not a number if there is nothing to divide by."""
    return F.when(b > 0, a / b).otherwise(F.lit(float("nan")))


def report(docs: DataFrame, predicted: str = "spans", labels: str = "labels") -> DataFrame:
    """category (OVERALL for all), gold, matched, good, fp, precision, recall and f1, by one rollup.

    Precision counts predictions and recall counts labels, so their numerators differ.
    """
    sums = [F.sum(c).alias(c) for c in ("gold", "matched", "good", "fp")]
    out = flags(docs, predicted, labels).rollup("category").agg(F.grouping("category").alias("_all"), *sums)
    precision, recall = ratio(F.col("good"), F.col("good") + F.col("fp")), ratio(F.col("matched"), F.col("gold"))
    total = precision + recall
    f1 = F.when(F.isnan(total) | (total <= 0), F.lit(float("nan"))).otherwise(2 * precision * recall / total)
    return out.select(F.when(F.col("_all") == 1, F.lit("OVERALL")).otherwise(F.col("category")).alias("category"), "gold", "matched", "good", "fp", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def evaluate(docs: DataFrame, detector, labels: str = "labels") -> DataFrame:
    """The report over the spans that ``detector`` finds in ``docs`` (text and labels)."""
    from maskwright.operators.detect import with_spans

    return report(with_spans(docs, detector), "spans", labels)


def percent(value: Column) -> Column:
    return F.when(F.isnan(value), F.lit("  -  ")).otherwise(F.format_string("%.1f%%", value * 100))


def table_lines(scores: DataFrame) -> DataFrame:
    """ord and line of a report for reading: categories in their fixed order without empty ones, then all."""
    order = {c: i for i, c in enumerate([*CATEGORIES, "OVERALL"])}
    ord_ = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("category"))
    line = F.concat(
        F.rpad("category", 16, " "), *[F.concat(F.lit(" "), F.lpad(c, n, " ")) for c, n in ((F.col("gold").cast("string"), 6), (F.col("matched").cast("string"), 7), (F.col("fp").cast("string"), 4), (percent(F.col("precision")), 9), (percent(F.col("recall")), 7), (percent(F.col("f1")), 6))]
    )
    some = (F.col("gold") + F.col("good") + F.col("fp") > 0) | (F.col("category") == "OVERALL")
    return scores.where(some).select(ord_.alias("ord"), line.alias("line"))


def masked_share(docs: DataFrame) -> DataFrame:
    """bytes_full, bytes_masked and percent saved: how much less a model reads after the pattern pass."""
    sums = docs.agg(F.sum(F.octet_length("text")).alias("bytes_full"), F.sum(F.octet_length("masked")).alias("bytes_masked"))
    return sums.withColumn("saved_percent", F.round((1 - F.col("bytes_masked") / F.col("bytes_full")) * 100, 4))
