"""Preference formatting, in DataFrame expressions only.

A pair holds two conversations, chosen and rejected, as arrays of turns. The longest prefix of turns that both share is
found turn by turn and rendered once, as the prompt; what is left of each is rendered as its completion, with the
stretches to be trained on: the replies of the assistant and the mark that ends them. Each pair is one row and needs no
shuffle.

``collect_conversations`` makes such arrays of a table of turns, in one shuffle by conversation. ``pairs`` makes pairs
of conversations: those that begin with the same turns up to the first reply are answers to one question, and are paired
two by two in order of their ids, the one with more text in its replies being chosen; one that is left over is paired
with itself with its first reply in place of the last. Conversations of a group are told off by a global sort of narrow
rows, so a question that a third of them begin with is no burden, and each is in one pair only.

Defined cases: rows without conv_id or turn belong to no conversation. A null role is ``unknown``, a null text empty.
Rows that repeat all four columns count once; different rows with one turn number are ordered by role and text. A
conversation counts up to its last reply; one without a reply makes no pair, and one that begins with a reply shares its
question with none. Of equally long replies the lesser conv_id is chosen. The marks of the format, where a text holds
them itself, are broken up, so a text can't begin a turn. Equal conversations have an empty completion each; a null array
is an empty one. A conversation of any length is one row; an empty table gives none. Extra columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import lookup, materialize
from maskwright.operators.shared import numbered

#: Fixed values of the format.
BEGIN, END, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"
TURNS = "array<struct<role:string,text:string>>"
SPANS = "array<struct<start:int,end:int>>"


def _turns(column: str) -> Column:
    return F.transform(
        F.coalesce(F.col(column), F.array().cast(TURNS)),
        lambda t: F.struct(F.coalesce(t["role"], F.lit("unknown")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")),
    )


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def render(turns: Column) -> Column:
    """The turns' text, one after the other."""
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(BEGIN), _safe(t["role"]), F.lit("\n"), _safe(t["text"]), F.lit(END + "\n"))), ""
    )


def trained(turns: Column) -> Column:
    """Where the rendered text is to be trained on, in characters: replies with the mark that ends them."""
    head = lambda t: F.lit(len(BEGIN) + 1) + F.length(_safe(t["role"]))
    body = lambda t: F.length(_safe(t["text"])) + len(END)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    span = lambda a, t: F.struct((a["at"] + head(t)).alias("start"), (a["at"] + head(t) + body(t)).alias("end"))
    step = lambda a, t: F.struct(
        (a["at"] + head(t) + body(t) + 1).alias("at"),
        F.when(t["role"] == TRAINED, F.concat(a["spans"], F.array(span(a, t)))).otherwise(a["spans"]).alias("spans"),
    )
    return F.aggregate(turns, start, step, lambda a: a["spans"])


def format_preferences(pairs: DataFrame, *keys: str) -> DataFrame:
    """``keys``, n_common, prompt, chosen, rejected, and where chosen and rejected are trained on.

    ``pairs`` has the arrays chosen and rejected, each of turns with role and text.
    """
    both = pairs.select(*keys, _turns("chosen").alias("c"), _turns("rejected").alias("r"))
    least = F.least(F.size("c"), F.size("r"))
    # The first place where they differ; turns are numbered from 1.
    differ = F.filter(F.sequence(F.lit(1), least), lambda i: F.element_at("c", i) != F.element_at("r", i))
    first = F.when(least == 0, 0).otherwise(F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, least))
    both = both.withColumn("n_common", first)
    rest = lambda x: F.slice(F.col(x), F.col("n_common") + 1, F.size(x))
    both = both.select(*keys, "n_common", F.slice("c", F.lit(1), F.col("n_common")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return both.select(
        *keys, "n_common", render(F.col("p")).alias("prompt"), render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"),
        trained(F.col("c")).alias("chosen_spans"), trained(F.col("r")).alias("rejected_spans"),
    )


def collect_conversations(turns: DataFrame) -> DataFrame:
    """conv_id and all its turns in order.

    Turns are gathered before the shuffle, so a task gets a row of a conversation from each task before it, not one a turn.
    """
    rows = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    said = F.transform(F.array_sort(F.collect_set("t")), lambda t: F.struct(t["role"], t["text"]))
    return rows.groupBy("conv_id").agg(said.cast(TURNS).alias("turns"))


def _replies(turns: Column | str) -> Column:
    return F.filter(turns, lambda t: t["role"] == TRAINED)


def with_weaker_reply(conversations: DataFrame) -> DataFrame:
    """Each of ``conversations`` (conv_id, turns up to the last reply) against itself with the first reply in place of the
    last, or an empty one if there is only one."""
    replies, before = _replies("turns"), F.slice("turns", F.lit(1), F.size("turns") - 1)
    weaker = F.when(F.size(replies) > 1, F.get(replies, F.lit(0))["text"]).otherwise("")
    rejected = F.concat(before, F.array(F.struct(F.lit(TRAINED).alias("role"), weaker.alias("text")))).cast(TURNS)
    return conversations.select("conv_id", F.lit(None).cast("long").alias("other_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))


def mates(conversations: DataFrame) -> DataFrame:
    """conv_id and mate: conversations that begin with the same question, two by two; a row for each of them."""
    first = F.array_position(F.transform("turns", lambda t: t["role"] == TRAINED), True)
    question = F.slice("turns", F.lit(1), first.cast("int") - 1)
    size = F.aggregate(_replies("turns"), F.lit(0).cast("long"), lambda a, t: a + F.length(t["text"]))
    rows = conversations.where(first > 1).select("conv_id", F.struct(F.xxhash64(question).alias("a"), F.xxhash64(F.lit(1), question).alias("b")).alias("question"), size.alias("size"))
    rows = materialize(rows, "questions")
    shared = materialize(rows.groupBy("question").agg(F.count(F.lit(1)).alias("of")).where("of > 1"), "shared-questions")
    rows = numbered(lookup(rows, shared, "question", "of", "conv_id", how="inner"), ["question", "conv_id"], "n")
    rows = materialize(rows, "numbered-questions")
    starts = materialize(rows.groupBy("question").agg(F.min("n").alias("start"), F.first("of").alias("total")), "question-starts")
    rows = lookup(rows, starts, "question", "total", "conv_id").withColumn("k", F.col("n") - F.col("start"))
    pair = rows.select("conv_id", "size", F.struct("question", F.expr("k div 2")).alias("pair"))
    # Two rows to each pair, so the join grows with the rows.
    other = pair.select("pair", F.col("conv_id").alias("mate"), F.col("size").alias("mate_size"))
    both = pair.join(other, "pair").where("conv_id <> mate")
    chosen = (F.col("size") > F.col("mate_size")) | (F.col("size") == F.col("mate_size")) & (F.col("conv_id") < F.col("mate"))
    return materialize(both.select("conv_id", "mate", chosen.alias("is_chosen")), "mates")


def pairs(conversations: DataFrame) -> DataFrame:
    """conv_id, other_id (null where a conversation is paired with itself), chosen and rejected."""
    places = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == TRAINED)
    some = conversations.where(F.size("turns") > 0).withColumn("at", places).where("size(at) > 0")
    some = materialize(some.select(F.col("conv_id").cast("long").alias("conv_id"), F.slice("turns", F.lit(1), F.element_at("at", -1)).alias("turns")), "conversations")
    found = mates(some)
    alone = with_weaker_reply(some.join(found.select("conv_id"), "conv_id", "left_anti"))
    best = found.where("is_chosen").select("conv_id", F.col("mate").alias("other_id"))
    two = best.join(some.select("conv_id", F.col("turns").alias("chosen")), "conv_id").join(some.select(F.col("conv_id").alias("other_id"), F.col("turns").alias("rejected")), "other_id")
    return alone.unionByName(two.select(*alone.columns))


def preferences(turns: DataFrame) -> DataFrame:
    """Formatted pairs of a table of conversations."""
    return format_preferences(pairs(collect_conversations(turns)), "conv_id", "other_id")


def spans_text(column: str) -> Column:
    """Stretches as ``start:end`` joined by spaces."""
    return F.array_join(F.transform(column, lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), " ")
