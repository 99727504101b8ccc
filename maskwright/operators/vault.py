"""The vault: one surrogate for each category and value, in a scope or in the whole corpus.

A vault is a table (scope columns, seq, category, real, fake), unique by category and value and unique by surrogate,
numbered in the order in which values first appear. Values are compared as they are.

No text comes out with a value that was found in it: rows are told apart by key and text, so a missing or repeated key is
no fault; a missing scope is a scope of its own; a category that isn't known gets a surrogate like a secret's.

No surrogate of ``anonymize_corpus`` stands in a text as it came, or restoring would change what was never replaced. Two
kinds aren't held to that: those of an existing vault, and those with a number at the end, after all attempts.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.functions.surrogates import surrogate
from maskwright.operators.restore import occurrences
from maskwright.operators.shared import few, fresh, materialize, numbered, row_identity

#: Makes a surrogate of category, value, attempt and seed.
Make = Callable[[Column, Column, Column, int], Column]
#: Surrogates tried for a value before its number is appended to one.
ATTEMPTS = 64


def placed(docs: DataFrame, key: list[str], scope: list[str] | None = None, text: str = "text", spans: str = "spans") -> DataFrame:
    """``key``, scope, _identity and kept: the spans that are replaced, of texts that have any, from a narrow table in
    the shared folder; so texts are scanned once, however often it is read."""
    names = list(dict.fromkeys([*key, *(scope or [])]))
    # Written as they are found: a filter or a fold on spans in the same step would find them again for each use.
    spans_ = F.coalesce(F.col(spans), S.no_spans()).cast(S.SPANS)
    found = materialize(docs.select(*names, row_identity(key, text).alias("_identity"), spans_.alias("_spans"), F.octet_length(text).alias("_size")), "spans")
    return found.where("size(_spans) > 0").select(*names, "_identity", S.placeable("_spans", None, size=F.col("_size")).alias("kept"))


def values(placed: DataFrame, order: list[str], scope: list[str] | None = None) -> DataFrame:
    """Each category and value that is replaced, and the place where it first appears: a row for each, summed up before
    the shuffle, so a value that a third of the corpus mentions is no burden."""
    scope = scope or []
    each = placed.select(*scope, *[F.col(c).alias(f"_{c}") for c in order], F.explode("kept").alias("s"))
    place = F.struct(*[f"_{c}" for c in order], F.col("s.start"))
    return each.groupBy(*scope, F.col("s.category").alias("category"), F.col("s.text").alias("real")).agg(F.min(place).alias("first"))


def build(found: DataFrame, scope: list[str] | None = None, existing: DataFrame | None = None, seed: int = 0, make: Make = surrogate, avoid: DataFrame | None = None) -> DataFrame:
    """The vault of the ``values`` found; after those of an ``existing`` vault, which keep their surrogates.

    ``make`` is what invents a surrogate of a category, a value and an attempt, with a seed. ``avoid`` (scope columns, fake)
    has surrogates that no attempt may give.
    """
    scope = scope or []
    keys = [*scope, "category", "real"]
    new, start = found, 0
    if existing is not None:
        known = existing.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)])
        new = found.join(known, _same(keys, [f"_k{i}" for i in range(len(keys))]), "left_anti")
        last = None if scope else existing.agg(F.max("seq")).first()[0]
        start = 0 if last is None else last + 1
    if scope:
        at = F.row_number().over(Window.partitionBy(*scope).orderBy("first", "category", "real")) - 1
        if existing is not None:
            last = existing.groupBy(*scope).agg((F.max("seq") + 1).alias("_next"))
            last = last.select("_next", *[F.col(c).alias(f"_s{i}") for i, c in enumerate(scope)])
            new = new.join(last, _same(scope, [f"_s{i}" for i in range(len(scope))]), "left").withColumn("seq", at + F.coalesce("_next", F.lit(0)))
        else:
            new = new.withColumn("seq", at)
        new = new.withColumn("seq", F.col("seq").cast("long"))
    else:
        new = numbered(new, ["first", "category", "real"], "seq", start).withColumn("seq", F.col("seq").cast("long"))
    columns = [*scope, "seq", "category", "real", "fake"]
    minted = _mint(new.select(*scope, "seq", "category", "real"), existing, scope, seed, make, avoid).select(*columns)
    return minted if existing is None else existing.select(*columns).unionByName(minted)


def _same(left: list[str], right: list[str]) -> Column:
    """Equal columns, none being equal to none."""
    return functools.reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)])


def _mint(new: DataFrame, existing: DataFrame | None, scope: list[str], seed: int, make: Make, avoid: DataFrame | None = None) -> DataFrame:
    """``new`` with surrogates that no two share: the first to come keeps one, the others try again."""
    names = [*scope, "fake"]
    taken = existing.select(*names) if existing is not None else None
    if avoid is not None:
        taken = (avoid if taken is None else taken.unionByName(avoid.select(*names))).select(*names).distinct()
    left, done = new, None
    for attempt in range(ATTEMPTS):
        tried = left.withColumn("fake", make(F.col("category"), F.col("real"), F.lit(attempt), seed))
        if taken is not None:
            theirs = [f"_t{i}" for i in range(len(names))]
            used = taken.select(F.lit(True).alias("_taken"), *[F.col(c).alias(t) for c, t in zip(names, theirs, strict=True)])
            tried = tried.join(used, _same(names, theirs), "left").drop(*theirs)
        else:
            tried = tried.withColumn("_taken", F.lit(None).cast("boolean"))
        first = F.row_number().over(Window.partitionBy(*names).orderBy("seq"))
        tried = materialize(tried.withColumn("_ok", F.col("_taken").isNull() & (first == 1)).drop("_taken"), "minted")
        good = tried.where("_ok").drop("_ok")
        done = good if done is None else done.unionByName(good)
        taken = good.select(*names) if taken is None else taken.unionByName(good.select(*names))
        left = tried.where("NOT _ok").drop("_ok", "fake")
        if left.isEmpty():
            return done
    last = make(F.col("category"), F.col("real"), F.lit(0), seed)
    return done.unionByName(left.withColumn("fake", F.concat(last, F.lit("-"), F.col("seq").cast("string"))).select(*done.columns))


def cap(vault: DataFrame, most: int, scope: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The newest ``most`` entries, and those that had to go; 0 is no limit."""
    if most <= 0:
        return vault, vault.limit(0)
    if scope:
        ranked = vault.withColumn("_r", F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("seq"))))
        return ranked.where(F.col("_r") <= most).drop("_r"), ranked.where(F.col("_r") > most).drop("_r")
    least = vault.select("seq").orderBy(F.desc("seq")).limit(most).agg(F.min("seq")).first()[0]
    least = -1 if least is None else least
    return vault.where(F.col("seq") >= least), vault.where(F.col("seq") < least)


def anonymize(docs: DataFrame, placed: DataFrame, vault: DataFrame, key: list[str], scope: list[str] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with anonymized (the text), placements, and subs: (real, fake) of each replaced span.

    Spans are joined with the vault without their texts; Spark picks the join by the vault's size and splits a value that
    many share. Texts move only where spans are not ``few``.
    """
    scope = scope or []
    # Rows that repeat key and text are one here, with the spans of all of them.
    one = placed.groupBy(*scope, "_identity").agg(F.array_distinct(F.flatten(F.collect_set("kept"))).alias("kept"))
    each = one.select(*scope, "_identity", F.explode(S.placeable("kept", None, size=F.lit(2**31 - 1))).alias("s"))
    names = [*scope, "category", "real"]
    entries = vault.select("fake", *[F.col(c).alias(f"_v{i}") for i, c in enumerate(names)])
    each = each.select(*scope, "_identity", "s", F.col("s.category").alias("category"), F.col("s.text").alias("real"))
    each = each.join(entries, _same(names, [f"_v{i}" for i in range(len(names))]), "left")
    # A value that the vault lacks, as after a cap, is taken out all the same.
    place = F.struct("s.start", "s.end", F.coalesce("fake", F.concat(F.lit("["), F.upper("category"), F.lit("]")), F.lit("[]")).alias("surrogate"), "real")
    scoped = [F.col(c).alias(f"_p{i}") for i, c in enumerate(scope)]
    found = each.groupBy(*scope, "_identity").agg(F.array_sort(F.collect_list(place)).alias("_placed"))
    found = materialize(found.select(F.struct("_identity", *scoped).alias("_row"), "_placed"), "placements")
    identity = fresh(docs, "_row")[0]
    out = docs.withColumn(identity, F.struct(row_identity(key, text).alias("_identity"), *[F.col(c).alias(f"_p{i}") for i, c in enumerate(scope)]))
    narrow = found.select(F.col("_row").alias(identity), "_placed")
    out = out.join(F.broadcast(narrow) if few(found) else narrow, identity, "left").drop(identity)
    put = F.coalesce("_placed", F.array().cast("array<struct<start:int,end:int,surrogate:string,real:string>>"))
    return out.select(
        *docs.columns, S.splice(text, put, lambda p: p["surrogate"]).alias("anonymized"),
        F.transform(put, lambda p: F.struct(p["start"], p["end"], p["surrogate"])).alias("placements"),
        F.transform(put, lambda p: F.struct(p["real"].alias("real"), p["surrogate"].alias("fake"))).alias("subs"),
    )


def anonymize_corpus(docs: DataFrame, key: list[str], scope: list[str] | None = None, existing: DataFrame | None = None, seed: int = 0, make: Make = surrogate) -> tuple[DataFrame, DataFrame]:
    """Anonymized documents and the vault that they share; with ``scope``, one for each value of those columns."""
    some = placed(docs, key, scope)
    vault = materialize(build(values(some, key, scope), scope, existing, seed, make), "vault")
    names = [*(scope or []), "fake"]
    theirs = [f"_a{i}" for i in range(len(names))]
    known, avoid = [existing.select(*names)] if existing is not None else [], None
    while True:
        new = vault
        for before in known:  # these keep their surrogates, or were looked for already
            new = new.join(before.toDF(*theirs), _same(names, theirs), "left_anti")
        hits = occurrences(docs, materialize(new, "new-surrogates"), scope or [], "text").select(*names).distinct()
        hits = materialize(new.join(hits.toDF(*theirs), _same(names, theirs), "left_semi").select(*names).distinct(), "surrogates-in-texts")
        if hits.isEmpty():
            return anonymize(docs, some, vault, key, scope), vault
        known.append(vault.select(*names))
        avoid = hits if avoid is None else avoid.unionByName(hits)
        vault = materialize(build(values(some, key, scope), scope, existing, seed, make, avoid), "vault")
