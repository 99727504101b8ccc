"""Restoring: surrogates in a text are replaced by the values they stand for, in one pass from left to right.

At each place the longest surrogate wins, of equal ones the one that came first; what is put in is not looked at again.
Rows are told apart by key and text, so a missing or repeated key is no fault.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from maskwright.functions.spans import _all, _empty, _push, splice
from maskwright.operators.shared import joined_by, materialize, row_identity

#: A vault of up to so many entries becomes one expression; a larger one goes to workers in blocks of BLOCK entries.
SMALL, BLOCK = 64, 500_000


def _entries(vault: DataFrame, most: int) -> list[tuple[str, str]]:
    """(fake, real), the longest surrogates first, of a vault that has ``most`` at most; empty ones are left out."""
    rows = vault.where("fake <> ''").select("seq", "fake", "real").limit(most).collect()
    first: dict[str, tuple[int, str]] = {}
    for seq, fake, real in rows:
        if fake not in first or seq < first[fake][0]:
            first[fake] = (seq, real)
    return sorted(((f, r) for f, (_, r) in first.items()), key=lambda x: -len(x[0]))


def pattern(fakes: list[str]) -> str:
    """Any of ``fakes``, which come the longest first, literally."""
    return "|".join(re.sub(r"([^A-Za-z0-9])", r"\\\1", f) if f.isascii() else rf"\Q{f}\E" for f in fakes)


def restored(text: Column, entries: list[tuple[str, str]]) -> Column:
    """The restored text as one expression: parts between matches, and a map for those in them."""
    if not entries:
        return text
    any_of = pattern([f for f, _ in entries])
    real = F.create_map(*[F.lit(x) for e in entries for x in e])
    pieces = F.arrays_zip(F.split(text, any_of, -1).alias("gap"), F.regexp_extract_all(text, F.lit(any_of), F.lit(0)).alias("fake"))
    whole = F.transform(pieces, lambda p: F.concat(p["gap"], F.coalesce(F.try_element_at(real, p["fake"]), F.lit(""))))
    return F.when(text.rlike(any_of), F.array_join(whole, "")).otherwise(text)


def restore(docs: DataFrame, vault: DataFrame, key: list[str], text: str = "anonymized", out: str = "restored") -> DataFrame:
    """``docs`` with the restored text. The vault's size decides how: an expression, or automata in the workers."""
    if vault.limit(SMALL + 1).count() <= SMALL:
        return docs.withColumn(out, restored(F.col(text), _entries(vault, SMALL + 1)))
    found = matches(docs.select(row_identity(key, text).alias("_identity"), F.col(text).alias("_text")), vault, ["_identity"], "_text")
    out_ = joined_by(docs, materialize(found, "restore-found"), key, text, "_identity")
    none = F.array().cast("array<struct<start:int,end:int,real:string>>")
    return out_.withColumn(out, splice(text, F.coalesce("_found", none), lambda m: m["real"])).drop("_found")


def occurrences(docs: DataFrame, vault: DataFrame, key: list[str], text: str, block: int = BLOCK) -> DataFrame:
    """``key``, start, end (in bytes), fake and real: wherever a surrogate of the vault, of any size, occurs.

    Each block of the vault passes over the texts with an automaton.
    """
    rows = vault.where("fake <> ''").groupBy("fake").agg(F.min(F.struct("seq", "real")).alias("f")).select("fake", "f.real")
    blocks = max(1, -(-rows.count() // block))
    spark = docs.sparkSession
    schema = docs.select(*key).schema.add("start", IntegerType()).add("end", IntegerType()).add("fake", StringType()).add("real", StringType())
    found = None
    for i in range(blocks):
        held = rows.where(F.pmod(F.xxhash64("fake"), F.lit(blocks)) == i).collect()  # about ``block``
        shared = spark.sparkContext.broadcast([(r["fake"], r["real"]) for r in held])

        def run(batches: Iterator, shared=shared) -> Iterator:
            import ahocorasick
            import pyarrow as pa

            automaton = ahocorasick.Automaton()
            for fake, real in shared.value:
                automaton.add_word(fake, (len(fake), fake, real))
            automaton.make_automaton()
            for batch in batches:
                at, starts, ends, fakes, reals = [], [], [], [], []
                for n, value in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    last = (0, 0)  # characters and bytes so far
                    hits = sorted((end + 1 - size, size, fake, real) for end, (size, fake, real) in automaton.iter(value)) if value and shared.value else ()
                    for start, _, fake, real in hits:
                        last = (start, last[1] + len(value[last[0] : start].encode()))
                        at.append(n)
                        starts.append(last[1])
                        ends.append(last[1] + len(fake.encode()))
                        fakes.append(fake)
                        reals.append(real)
                columns = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(fakes, pa.string()), pa.array(reals, pa.string())], names=[*key, "start", "end", "fake", "real"])

        part = docs.select(*key, text).mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return materialize(found, "restore-matches")


def matches(docs: DataFrame, vault: DataFrame, key: list[str], text: str, block: int = BLOCK) -> DataFrame:
    """``key`` and _found: the surrogates to be replaced, chosen from left to right among all that occur."""
    found = occurrences(docs, vault, key, text, block)
    longest = F.transform(F.array_sort(F.collect_set(F.struct("start", (-F.col("end")).alias("e"), "real"))), lambda m: F.struct(m["start"].alias("start"), (-m["e"]).alias("end"), m["real"].alias("real")))
    every = found.groupBy(*key).agg(longest.alias("_all"))
    start = F.struct(F.lit(0).alias("at"), *_empty("struct<start:int,end:int,real:string>"))
    step = lambda a, m: F.struct(F.when(m["start"] >= a["at"], m["end"]).otherwise(a["at"]).alias("at"), *_push(a, m, m["start"] >= a["at"]))
    return every.select(*key, F.aggregate("_all", start, step, lambda a: _all(a)).alias("_found"))


def restore_plan(docs: DataFrame, vault: DataFrame, key: list[str], text: str = "anonymized") -> DataFrame:
    """``key``, n_entries: how many of the vault's surrogates occur in the text, for each row."""
    rows = docs.select(row_identity(key, text).alias("_identity"), F.col(text).alias("_text"))
    found = occurrences(rows, vault, ["_identity"], "_text").groupBy("_identity").agg(F.countDistinct("fake").cast("int").alias("_n"))
    out = joined_by(docs, materialize(found, "restore-counts"), key, text, "_identity")
    return out.select(*key, F.coalesce("_n", F.lit(0)).alias("n_entries"))


def without_surrogates(docs: DataFrame, vault: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """The rows whose text holds no surrogate of the vault; others have been anonymized already."""
    rows = docs.select(row_identity(key, text).alias("_identity"), F.col(text).alias("_text"))
    found = occurrences(rows, vault, ["_identity"], "_text").select("_identity", F.lit(True).alias("_some")).distinct()
    return joined_by(docs, materialize(found, "anonymized-before"), key, text, "_identity").where("_some IS NULL").drop("_some")
