"""Column expressions on texts and their spans.

A span is (category, start, end, text, score); offsets count bytes of UTF-8 and a text's spans are an array in one row,
so nothing here shuffles. Everything runs in the JVM: the pattern pass is one scan per text, the rest folds over the
spans of a text. Offsets are bytes because texts are cut as binary columns, in which a slice costs no more than its
length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.patterns import COMBINED, GROUPS, LUHN_GROUP, TRIGGERS

SPAN = "struct<category:string,start:int,end:int,text:string,score:float>"
SPANS = f"array<{SPAN}>"
SEGMENT = "struct<masked_start:int,len:int,orig_start:int,orig_end:int,sentinel:boolean>"
#: Private-use characters that part matches and groups while a text is taken apart.
SEP, FS = "\ue000", "\ue001"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_spans() -> Column:
    return F.array().cast(SPANS)


def luhn_valid(value: Column | str) -> Column:
    """13 to 19 digits, separators aside, that pass the Luhn check."""
    digits = F.regexp_replace(_col(value), "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it, within its own lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Items of the list that a fold appends to; full ones are set aside, so appending n items doesn't copy n squared.
FULL = 64


def _empty(kind: str, done: str = "done", last: str = "last") -> list[Column]:
    return [F.array().cast(f"array<array<{kind}>>").alias(done), F.array().cast(f"array<{kind}>").alias(last)]


def _push(a: Column, item: Column, if_: Column | None = None, done: str = "done", last: str = "last") -> list[Column]:
    """The two lists of a fold's state ``a`` with ``item`` appended, where ``if_`` holds."""
    full = F.size(a[last]) >= FULL
    wanted = F.lit(True) if if_ is None else if_
    return [
        F.when(full & wanted, F.concat(a[done], F.array(a[last]))).otherwise(a[done]).alias(done),
        F.when(~wanted, a[last]).when(full, F.array(item)).otherwise(F.concat(a[last], F.array(item))).alias(last),
    ]


def _all(a: Column, done: str = "done", last: str = "last") -> Column:
    return F.flatten(F.concat(a[done], F.array(a[last])))


def _pieces(text: Column) -> Column:
    """array<struct<group, text>>: the text cut where the pattern pass matches; pieces that match no group have 0."""
    marked = F.regexp_replace(text, COMBINED, SEP + FS.join(f"${i}" for i in range(1, len(GROUPS) + 1)) + SEP)
    # Of a match's groups one has text, and before it a mark for each group that has none.
    which = lambda p: F.length(p) - F.length(F.ltrim(p, F.lit(FS))) + 1
    quick = F.transform(F.split(marked, SEP, -1), lambda p, i: F.struct(F.when(i % 2 == 1, which(p)).otherwise(0).cast("int").alias("group"), F.replace(p, F.lit(FS), F.lit("")).alias("text")))
    # A text that holds the marks itself is scanned once for each group instead.
    whole = F.regexp_extract_all(text, F.lit(COMBINED), F.lit(0))
    groups = [F.regexp_extract_all(text, F.lit(COMBINED), F.lit(i)) for i in range(1, len(GROUPS) + 1)]
    zipped = F.arrays_zip(F.split(text, COMBINED, -1).alias("gap"), whole.alias("whole"), *[g.alias(f"g{n}") for n, g in enumerate(groups, 1)])
    found = lambda z: F.coalesce(*[F.when(z[f"g{n}"] != "", F.lit(n)) for n in range(1, len(GROUPS) + 1)], F.lit(0))
    two = lambda z: F.array(F.struct(F.lit(0).alias("group"), z["gap"].alias("text")), F.struct(found(z).cast("int").alias("group"), F.coalesce(z["whole"], F.lit("")).alias("text")))
    return F.when(text.rlike(f"[{SEP}{FS}]"), F.flatten(F.transform(zipped, two))).otherwise(quick)


def regex_spans(text: Column | str) -> Column:
    """The spans that the pattern pass finds, each with score 1; one pass, in time that grows with the text.

    Digits that fail the Luhn check are dropped after the scan, so nothing else is found within them.
    """
    text = _col(text)
    category = F.array(*[F.lit(c) for c, _ in GROUPS])
    start = F.struct(F.lit(0).alias("at"), *_empty(SPAN))

    def step(a: Column, m: Column) -> Column:
        end = a["at"] + F.octet_length(m["text"])
        span = F.struct(F.get(category, m["group"] - 1).alias("category"), a["at"].alias("start"), end.alias("end"), m["text"].alias("text"), F.lit(1.0).cast("float").alias("score"))
        good = (m["group"] > 0) & ((m["group"] != LUHN_GROUP) | luhn_valid(m["text"]))
        return F.struct(end.alias("at"), *_push(a, span, good))

    found = F.aggregate(_pieces(text), start, step, lambda a: _all(a))
    return F.when(may_match(text), found).otherwise(no_spans())


def may_match(text: Column) -> Column:
    """Whether the pattern pass could find anything; a cheap test that lets every match through."""
    out = text.rlike("[0-9]")
    for t in TRIGGERS:
        out = out | F.contains(text, F.lit(t))
    return out | text.rlike("(?i)bearer")


def _slice(data: Column, start: Column, end: Column) -> Column:
    """Bytes ``start`` to ``end`` of binary ``data``, as a string."""
    return F.substring(data, start + 1, end - start).cast("string")


def by_start(spans: Column) -> Column:
    """Spans by start; those with one start keep their order."""
    numbered = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(numbered), lambda x: x["s"])


def by_start_and_size(spans: Column) -> Column:
    """Spans by start, the longest first; else they keep their order."""
    numbered = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), (-s["end"]).alias("e"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(numbered), lambda x: x["s"])


def placeable(spans: Column | str, text: Column | str | None, empty: bool = True, ordered: bool = False, size: Column | None = None) -> Column:
    """Spans in order of start without those that begin before the last kept one ends or lie outside of the text, of
    which its ``size`` in bytes is enough."""
    spans, size = _col(spans), F.octet_length(_col(text)) if size is None else size

    def fold(known: Column) -> Column:
        fits = lambda a, s: (s["start"] >= a["at"]) & (s["end"] <= known["size"]) & ((s["start"] <= s["end"]) if empty else (s["start"] < s["end"]))
        step = lambda a, s: F.struct(F.when(fits(a, s), s["end"]).otherwise(a["at"]).alias("at"), *_push(a, s, fits(a, s)))
        return F.aggregate(known["spans"], F.struct(F.lit(0).alias("at"), *_empty(SPAN)), step, lambda a: _all(a))

    return bind(F.struct(size.alias("size"), (spans if ordered else by_start(spans)).alias("spans")), fold)


def splice(text: Column | str, kept: Column, replacement) -> Column:
    """The text with each of the ``kept`` spans, which are in order and apart, replaced by ``replacement(span)``."""
    text = _col(text)

    def put(known: Column) -> Column:
        data, spans = known["data"], known["spans"]
        ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
        # Each piece before a span with what stands for the span, and the rest of the text.
        parts = F.transform(F.arrays_zip(spans.alias("s"), ends.alias("at")), lambda z: F.concat(_slice(data, z["at"], F.coalesce(z["s"]["start"], F.octet_length(data))), F.coalesce(replacement(z["s"]), F.lit(""))))
        return F.array_join(parts, "")

    return bind(F.struct(text.cast("binary").alias("data"), kept.alias("spans")), lambda known: F.when(known["data"].isNotNull() & known["spans"].isNotNull(), put(known)))


def redact(text: Column | str, spans: Column | str, style: str = "label") -> Column:
    """The text with its spans replaced by ``[CATEGORY]``, or by a block or a star for each character."""
    styles = {
        "label": lambda s: F.concat(F.lit("["), F.upper(s["category"]), F.lit("]")),
        "block": lambda s: F.repeat(F.lit("█"), F.length(s["text"])),
        "char": lambda s: F.repeat(F.lit("*"), F.length(s["text"])),
    }
    return splice(text, placeable(spans, text), styles[style])


def mask(text: Column | str, spans: Column | str) -> Column:
    """struct<text, segments>: each span made one space, and where the pieces came from. Spans are taken as they come."""
    text = _col(text)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("out"), *_empty("string", "texts", "text"), *_empty(SEGMENT))

    def segment(out: Column, n: Column, a: Column, b: Column, sentinel: bool) -> Column:
        return F.struct(out.alias("masked_start"), n.alias("len"), a.alias("orig_start"), b.alias("orig_end"), F.lit(sentinel).alias("sentinel"))

    def fold(known: Column) -> Column:
        data, size = known["data"], F.octet_length(known["data"])

        def step(a: Column, s: Column) -> Column:
            gap = s["start"] - a["at"]
            before = F.struct(*_push(a, segment(a["out"], gap, a["at"], a["at"], False), gap > 0))
            return F.struct(
                s["end"].alias("at"), (a["out"] + gap + 1).alias("out"), *_push(a, F.concat(_slice(data, a["at"], s["start"]), F.lit(" ")), None, "texts", "text"),
                *_push(before, segment(a["out"] + gap, F.lit(1), s["start"], s["end"], True)),
            )

        def finish(a: Column) -> Column:
            rest = size - a["at"]
            tail = F.struct(*_push(a, segment(a["out"], rest, a["at"], a["at"], False), rest > 0))
            return F.struct(F.concat(F.array_join(_all(a, "texts", "text"), ""), _slice(data, a["at"], size)).alias("text"), _all(tail).alias("segments"))

        return F.aggregate(known["spans"], start, step, finish)

    return bind(F.struct(text.cast("binary").alias("data"), placeable(spans, text, empty=False, ordered=True).alias("spans")), fold)


def remap(pos: Column, segments: Column, end: bool = False) -> Column:
    """Where an offset of a masked text lies in the original; inside a masked span, at its start or its end."""
    return bind(F.try_element_at(F.filter(segments, lambda s: s["masked_start"] <= pos), F.lit(-1)), lambda last: _remapped(pos, segments, end, last))


def _remapped(pos: Column, segments: Column, end: bool, last: Column) -> Column:
    within = last["orig_start"] + F.least(pos - last["masked_start"], last["len"])
    return F.when(F.size(segments) == 0, pos).when(last.isNull(), F.get(segments, F.lit(0))["orig_start"]).when(last["sentinel"], last["orig_end"] if end else last["orig_start"]).otherwise(within)


def merge_overlapping(spans: Column | str, text: Column | str) -> Column:
    """Spans in order, each joined with the one kept before it if they share a category and a byte.

    Only the span kept last is looked at, so two of a category with another between them stay apart. The score is that
    of the longer piece.
    """
    spans, text = _col(spans), _col(text)

    def fold(known: Column) -> Column:
        data = known["data"]

        def step(a: Column, s: Column) -> Column:
            last = a["now"]
            longer = (s["end"] - s["start"]) > (last["end"] - last["start"])
            end = F.greatest(last["end"], s["end"])
            joined = F.struct(
                last["category"].alias("category"), last["start"].alias("start"), end.alias("end"),
                F.when(s["end"] > last["end"], _slice(data, last["start"], end)).otherwise(last["text"]).alias("text"),
                F.when(longer, s["score"]).otherwise(last["score"]).alias("score"),
            )
            meets = last.isNotNull() & (s["category"] == last["category"]) & (s["start"] < last["end"])
            return F.struct(F.when(meets, joined).otherwise(s).cast(SPAN).alias("now"), *_push(a, last, last.isNotNull() & ~meets))

        start = F.struct(F.lit(None).cast(SPAN).alias("now"), *_empty(SPAN))
        return F.aggregate(known["spans"], start, step, lambda a: F.concat(_all(a), F.filter(F.array(a["now"]), lambda s: s.isNotNull())))

    merged = bind(F.struct(text.cast("binary").alias("data"), by_start_and_size(spans).alias("spans")), fold)
    return F.when(F.size(spans) < 2, spans).otherwise(merged)


def on_boundary(data: Column, pos: Column) -> Column:
    """Whether a byte offset of binary UTF-8 lies between characters: the byte there doesn't continue one."""
    byte = F.conv(F.hex(F.substring(data, pos + 1, F.lit(1))), 16, 10).cast("int")
    return (pos == F.octet_length(data)) | ~byte.between(128, 191)


def combine(text: Column | str, regex: Column | str, model: Column | str, segments: Column | str) -> Column:
    """Spans of both passes: the model's, found on the masked text, are moved to the original and dropped where they
    overlap a pattern's, cut a character or lie outside; then all are merged."""
    text, regex, model, segments = map(_col, (text, regex, model, segments))

    def moved(known: Column) -> Column:
        data, pieces, first = known["data"], known["segments"], known["regex"]
        at = F.transform(known["model"], lambda m: F.struct(m["category"], remap(m["start"], pieces).alias("start"), remap(m["end"], pieces, True).alias("end"), m["score"]))
        clear = lambda m: ~F.exists(first, lambda r: (r["start"] < m["end"]) & (m["start"] < r["end"]))
        good = F.filter(at, lambda m: (m["start"] < m["end"]) & (m["end"] <= F.octet_length(data)) & clear(m) & on_boundary(data, m["start"]) & on_boundary(data, m["end"]))
        return F.transform(good, lambda m: F.struct(m["category"], m["start"], m["end"], _slice(data, m["start"], m["end"]).alias("text"), m["score"]).cast(SPAN))

    theirs = bind(F.struct(text.cast("binary").alias("data"), segments.alias("segments"), regex.alias("regex"), model.alias("model")), moved)
    return merge_overlapping(F.concat(regex, theirs), text)


def at_least(spans: Column | str, score: float) -> Column:
    """Spans with that score at least; all of them for 0."""
    return F.filter(_col(spans), lambda s: s["score"] >= F.lit(score).cast("float")) if score > 0 else _col(spans)


def trimmed(category: Column, start: Column, end: Column, score: Column, text: Column) -> Column:
    """A span without white space at its edges; null if nothing else is in it or an edge cuts a character."""
    data = text.cast("binary")
    piece = _slice(data, start, end)
    left = F.octet_length(piece) - F.octet_length(F.regexp_replace(piece, r"(?U)^\s+", ""))
    body = F.regexp_replace(F.regexp_replace(piece, r"(?U)^\s+", ""), r"(?U)\s+$", "")
    a = start + left
    whole = on_boundary(data, start) & on_boundary(data, end) & (body != "")
    return F.when(whole, F.struct(category.alias("category"), a.alias("start"), (a + F.octet_length(body)).alias("end"), body.alias("text"), score.cast("float").alias("score")))
