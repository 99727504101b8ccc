"""Language identification by words first, then ever shorter character n-grams.

A known word scores its log frequency in each language. A word that was never seen falls back to its character
n-grams, longest first: the first length of which the model knows any scores their mean. A document scores the sum over
its words, whole text, and the language with the highest posterior is predicted.

The model is fitted on at most about SAMPLE labelled documents of each language, chosen by a hash of doc_id (all of
them where there are fewer), and keeps at most WORDS words and GRAMS n-grams of each language, the most frequent; so
its size is bounded and it is broadcast. Prediction covers every document.

Defined cases: a null text, or one without letters, is ``und`` with score 0. Equal posteriors go to the first
language in alphabetical order; where nothing in a text is known, the most frequent language of the sample is
predicted. Without any labelled document all are ``und``. Rows without a doc_id are predicted and never learned from.
Repeated rows are predicted each. Numbers in whatever form are no letters. Texts of any length are read whole, an empty
table gives no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import spread

SAMPLE, WORDS, GRAMS = 3000, 40_000, 60_000
#: The lengths of n-grams, in the order in which they are tried.
LENGTHS = (5, 4, 3, 2, 1)
#: Characters that Python's pattern takes for those of words though they are no letters: fractions, superscripts, circled
#: and Roman numbers and the like.
NUMERALS = "".join(re.escape(c) for c in map(chr, range(128, 0x20000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
LETTERS = re.compile(rf"[^\W\d_{NUMERALS}]+")
#: Characters that are no letters and often stand around a word.
EDGES = string.punctuation + string.digits
UNKNOWN = "und"
CACHE = 300_000


def words(text: str) -> list[str]:
    """Maximal runs of letters, in lower case."""
    return LETTERS.findall(text.lower())


def token_words(token: str) -> list[str]:
    """``words`` of what stands between white space, without the pattern where that is one word within ``EDGES``."""
    inner = token.lower().strip(EDGES)
    return [inner] if inner.isalpha() else words(token)


def grams(word: str, n: int) -> list[str]:
    """The n-grams of the word between its edges; single letters without them."""
    word = word if n == 1 else f"<{word}>"
    return [word[i : i + n] for i in range(len(word) - n + 1)]


@dataclass
class Model:
    """Log frequencies by language: of words, and of n-grams by length; and of the languages themselves."""

    langs: list[str]
    prior: list[float]
    words: dict[str, tuple[float, ...]]
    grams: dict[str, tuple[float, ...]]

    def word(self, word: str) -> tuple[float, ...] | None:
        if word in self.words:
            return self.words[word]
        get, edged = self.grams.get, f"<{word}>"
        for n in LENGTHS:
            within = word if n == 1 else edged  # as in ``grams``, which would make a list for each length
            if known := [s for i in range(len(within) - n + 1) if (s := get(within[i : i + n])) is not None]:
                k = len(known)
                return known[0] if k == 1 else tuple([sum(x) / k for x in zip(*known, strict=True)])
        return None


def _logs(rows: list[tuple[str, str, int]], langs: list[str], group=lambda key: 0) -> dict[str, tuple[float, ...]]:
    """Smoothed log frequency of each key in each language, among the keys of its group."""
    at, counts, totals, kinds = {x: i for i, x in enumerate(langs)}, {}, {}, Counter()
    for lang, key, n in rows:
        if key not in counts:
            counts[key] = [0] * len(langs)
            kinds[group(key)] += 1
        counts[key][at[lang]] += n
        totals.setdefault(group(key), [0] * len(langs))[at[lang]] += n
    return {
        key: tuple(math.log((c + 0.1) / (t + 0.1 * kinds[group(key)])) for c, t in zip(n, totals[group(key)], strict=True))
        for key, n in counts.items()
    }


def _top(counts: DataFrame, most: int, *by: str) -> list[tuple[str, str, int]]:
    """The most frequent keys by ``by``; at most ``most`` of each."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "key"))
    return [tuple(r) for r in counts.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "key", "n").collect()]


def fit(labelled: DataFrame, sample: int = SAMPLE, most_words: int = WORDS, most_grams: int = GRAMS) -> Model:
    """The model of the rows of ``labelled`` (doc_id, text, lang)."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(n)
    if not langs:
        return Model([], [], {}, {})
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, int(min(1.0, sample / n[lang]) * 1e9))])
    rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(10**9)) < share[F.col("lang")])

    def count_words(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
                seen.update((lang, w) for w in words(text))
        langs, keys = zip(*seen, strict=True) if seen else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "key", "n"])

    def count_grams(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: Counter = Counter()
        for batch in batches:
            for row in batch.to_pylist():
                for length in LENGTHS:
                    for g in grams(row["key"], length):
                        seen[row["lang"], length, g] += row["n"]
        langs, lengths, keys = zip(*seen, strict=True) if seen else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(lengths, pa.int32()), pa.array(keys, pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "length", "key", "n"])

    seen = rows.select("text", "lang").mapInArrow(count_words, "lang string, key string, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    seen = seen.persist()
    try:
        top_words = _top(seen.where("n > 1"), most_words, "lang")
        parts = seen.mapInArrow(count_grams, "lang string, length int, key string, n long").groupBy("lang", "length", "key").agg(F.sum("n").alias("n"))
        top_grams = _top(parts, most_grams // len(LENGTHS), "lang", "length")
    finally:
        seen.unpersist()
    total = sum(n.values())
    return Model(langs, [math.log(n[x] / total) for x in langs], _logs(top_words, langs), _logs(top_grams, langs, len))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (the posterior of that language) for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model = shared.value
        zero = np.zeros(len(model.langs) + 1)

        class Tokens(dict):
            """What stands between white space: the sum of its words' scores, and whether it has letters."""

            def __missing__(self, token: str):
                found = token_words(token)
                out = zero
                if len(found) == 1:
                    out = np.array((*(model.word(found[0]) or zero[:-1]), 1.0))
                elif found:
                    out = zero.copy()
                    out[-1] = len(found)
                    for w in found:
                        if (s := model.word(w)) is not None:
                            out[:-1] += s
                if len(token) <= 60:
                    if len(self) >= CACHE:
                        self.clear()
                    self[token] = out
                return out

        tokens, prior = Tokens(), np.array(model.prior)
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1).to_pylist():
                seen = Counter(text.split()) if text and model.langs else {}
                total = np.array(list(seen.values()), float) @ np.array([tokens[t] for t in seen]) if seen else zero
                if not total[-1]:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = total[:-1] + prior
                p = np.exp(p - p.max())
                best = int(p.argmax())
                langs.append(model.langs[best])
                scores.append(float(p[best] / p.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; null without an id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from the documents whose fold isn't 2, predict all; held_out says which are of fold 2."""
    model = fit(docs.where(fold() != 2))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
