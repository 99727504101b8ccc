"""Secret scan: candidates by pattern, false positives removed by a random forest. DataFrame expressions and MLlib only.

A candidate is a run of 16 or more characters of keys with a digit among them, what has a provider's or a standard format
(web tokens and private keys with their dots and lines too), or a value of any make-up and length after a name such as
password and = or : (in quotes, what is between them on one line; else up to white space, quotes, brackets or one of
& , ; |) or after the word bearer, unless such a run covers it; runs within a formatted one are parts of it. What tells a
key from another such run: its length and make-up, how likely its character transitions are in the corpus's own words and
numbers, how much of it dictionary words cover, the path it was found in, and the words beside it. Transitions and dictionary come from the words of all
documents. The forest is fitted on labelled findings, at most about SAMPLE of them; without any, ``label_findings``
marks those whose provider's format or context is beyond doubt, and the forest decides the rest.

What depends on the value alone is computed once for each distinct value and looked up by its findings, so a value that
a third of the findings share is no burden. Texts are read once for words and once for candidates; neither is joined.

Defined cases: a null or empty text has no candidates. A null path is the empty path. Rows that repeat a doc_id are
scanned each, and so are texts of any length, whole. Findings without a label are not learned from; if all labels are the
same, or there are none, no forest is fitted and every finding scores that label, or 1. A score of one half is a secret.
An empty table gives no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.patterns import SECRET
from maskwright.llm.common import lookup, materialize

SAMPLE, TREES, DEPTH, SEED = 20_000, 30, 8, 7
#: A word is in the dictionary if the corpus has it this often.
COMMON = 5
#: Characters beside a candidate that are looked at.
NEAR = 48
#: A ``=`` before a run assigns it, and belongs to it only as padding at its end.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
#: Formats that providers give their keys.
PROVIDER = "|".join((
    r"^(?:AKIA|ASIA)[A-Z0-9]{16}$", r"^gh[oprsu]_[A-Za-z0-9]{36}$", r"^github_pat_[A-Za-z0-9_]{40,}$", r"^AIza[A-Za-z0-9_-]{35}$",
    r"^xox[baprs]-[A-Za-z0-9-]{10,}$", r"^[sr]k_(?:live|test)_[A-Za-z0-9]{16,}$", r"^glpat-[A-Za-z0-9_-]{20}$", r"^npm_[A-Za-z0-9]{36}$",
))
#: The library's own formats of secrets, but that of a bearer, which is found by its name.
FORMATS = "|".join(f for f in SECRET if "bearer" not in f)
NAMED = r"(?i)(?:secret|token|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|credential)[A-Za-z_]*[\"']?\s*[=:]\s*[\"']?$"
#: Keys that CANDIDATE passes over for want of a digit or of length: a value and the name (HEAD, as in NAMED) it is given to,
#: or a provider's format. Names reach no further than NEAR.
HEAD = NAMED.replace("*", "{0,40}+").replace("|auth|", r"|auth(?!ors?\b)|").removesuffix("$")
BEARER = r"(?i:\bbearer\s{1,9}+)"
HEAD = f"{HEAD}(?:{BEARER})?+"
HEADS = f"(?:{HEAD}|{BEARER})"
FURTHER = (
    r"(?<![A-Za-z0-9+/_-])(?-i:" + FORMATS + ")(?![A-Za-z0-9+/_-])" + f"|{BEARER}[A-Za-z0-9._~+/-]{{16,}}+={{0,2}}" + "|" + HEAD
    + r"(?:(?<=\")[^\"\r\n]++(?=\")|(?<=')[^'\r\n]++(?=')|[^\s\"'&,;<>(){}\[\]|]*[^\s\"'&,;<>(){}\[\]|.:!?])"
    + r"|(?<![A-Za-z0-9+/_-])(?-i:" + PROVIDER.replace("^", "").replace("$", "") + r")(?![A-Za-z0-9+/_-])"
)
DIGEST = r"(?i)(?:commit|sha-?\d*|md5|hash|checksum|digest|etag|uuid|guid|revision)\W{0,4}$"
PLACEHOLDER = r"(?i)example|dummy|change.?me|placeholder|your.?(?:key|token)|x{6,}|0{8,}"
SLUG = r"^(?:[A-Za-z]?[a-z]{2,}[-_/]){2,}(?:[a-z]+|[0-9]{1,6})?$"
HINTS = r"(?i)secret|token|passw|pwd|key|auth|credential|private|bearer"
DOUBTS = r"(?i)commit|sha|md5|hash|uuid|version|card|phone|order|invoice|isbn|http|www"
TESTS = r"(?i)test|example|sample|mock|fixture|spec|doc"
FEATURES = (
    "size", "digits", "capitals", "others", "distinct", "switches", "transitions", "coverage", "longest",
    "path_test", "path_depth", "hint", "doubt", "assigned", "quoted", "plain_neighbours",
)


def corpus_words(docs: DataFrame) -> DataFrame:
    """Every word of all texts, in lower case and with 0 for each digit, and how often it occurs."""
    word = F.explode(F.split(F.regexp_replace(F.lower("text"), "[0-9]", "0"), r"[^\p{L}0]+")).alias("word")
    return docs.where("text IS NOT NULL").select(word).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _classes(value: Column) -> Column:
    """The value with digits as 0, what is neither digit nor letter as -, in lower case, between its edges."""
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.lower(value), "[0-9]", "0"), "[^a-z0]", "-"), F.lit("$"))


def _pairs(column: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(column) - 1), lambda i: F.substr(F.col(column), i, F.lit(2)))


def transitions(words: DataFrame) -> Column:
    """A map of two characters to the log of how often the second follows the first; at most 30 x 30 entries."""
    plain = words.where(r"word RLIKE '^[a-z0]+$'").select(F.concat(F.lit("^"), "word", F.lit("$")).alias("w"), "n")
    pairs = plain.select(F.explode(_pairs("w")).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    rows = pairs.withColumn("all", F.expr("sum(n) over (partition by substr(pair, 1, 1))")).select("pair", F.log(F.col("n") / F.col("all")).alias("p")).collect()
    return F.create_map(*[F.lit(x) for r in rows for x in (r["pair"], float(r["p"]))]) if rows else F.create_map().cast("map<string,double>")


def _each(found: str, gaps: str, head: str | None = None) -> Column:
    """start, value, before and after of each match; ``head`` is what a match may have before its value."""
    first = lambda m: F.regexp_extract(m, "^" + head, 0) if head else F.lit("")
    sizes = F.transform(found, lambda m, i: F.struct((F.length(F.get(gaps, i)) + F.length(first(m))).alias("gap"), (F.length(m) - F.length(first(m))).alias("size")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(
        sizes, begin, lambda a, s: F.struct((a["at"] + s["gap"] + s["size"]).alias("at"), F.concat(a["starts"], F.array(a["at"] + s["gap"])).alias("starts")),
        lambda a: a["starts"],
    )
    # A run that is assigned to, as API2_ACCESS_TOKEN=, is the name of the next.
    name = lambda i: F.when((i > 0) & F.get(gaps, i).rlike(r"^[\"']?\s*[=:]\s*[\"']?$"), F.get(found, i - 1)).otherwise("")
    return F.transform(
        F.arrays_zip(F.col(found).alias("all"), starts.alias("start")),
        lambda z, i: F.struct(
            z["start"].alias("start"), F.substr(z["all"], F.length(first(z["all"])) + 1).alias("value"), (F.length(first(z["all"])) > 0).alias("named"),
            F.right(F.concat(name(i), F.get(gaps, i), first(z["all"])), F.lit(NEAR)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(NEAR)).alias("after"),
        ),
    )


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, path, start (in characters), value, and what stands before and after it."""
    rows = docs.select("doc_id", F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), "text").where(F.col("text").rlike(CANDIDATE) | F.col("text").rlike(FURTHER))
    cut = [c for n, p in (("runs", CANDIDATE), ("more", FURTHER)) for c in (F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(n), F.split("text", p, -1).alias(f"{n}_gaps"))]
    rows = rows.select("doc_id", "path", *cut).select("doc_id", "path", _each("runs", "runs_gaps").alias("runs"), _each("more", "more_gaps", HEADS).alias("more"))
    within = lambda m, r: (r["start"] <= m["start"]) & (r["start"] + F.length(r["value"]) >= m["start"] + F.length(m["value"]))
    rows = rows.withColumn("more", F.filter("more", lambda m: ~F.exists("runs", lambda r: within(m, r))))
    runs = F.filter("runs", lambda r: ~F.exists("more", lambda m: ~m["named"] & within(r, m)))
    return rows.select("doc_id", "path", F.explode(F.concat(runs, "more")).alias("c")).select("doc_id", "path", "c.*").drop("named")


def label_findings(found: DataFrame) -> DataFrame:
    """``found`` with label 1 where format or context prove a secret, 0 where they rule it out, else null."""
    value, before = F.col("value"), F.col("before")
    number = value.rlike("^[0-9/+_=-]+$")
    no = number | before.rlike(DIGEST) | value.rlike(PLACEHOLDER) | value.rlike("^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$") | value.rlike(SLUG)
    known = value.rlike(PROVIDER) | value.rlike(f"^(?:{FORMATS})$")
    yes = before.rlike(NAMED) & (F.length(value) >= 20) & value.rlike("[A-Za-z]") & value.rlike(f"^(?:{CANDIDATE})$")
    return found.withColumn("label", F.when(known, 1.0).when(no, 0.0).when(yes, 1.0))


def _value_features(values: DataFrame, words: DataFrame, follows: Column) -> DataFrame:
    """Features of each distinct value (with n, its findings); dictionary words are joined to its runs of letters."""
    share = lambda pattern: F.length(F.regexp_replace("value", pattern, "")) / F.length("value")
    v = values.withColumn("classes", _classes(F.col("value")))
    v = v.withColumn("steps", F.transform(_pairs("classes"), lambda p: F.coalesce(F.element_at(follows, p), F.lit(-8.0))))
    runs = F.array_distinct(F.filter(F.split(F.lower("value"), "[^a-z]+"), lambda r: F.length(r) >= 3))
    v = v.select(
        "value", "n", F.length("value").cast("double").alias("size"), share("[^0-9]").alias("digits"), share("[^A-Z]").alias("capitals"),
        share("[A-Za-z0-9]").alias("others"), (F.size(F.array_distinct(F.split("value", ""))) / F.length("value")).alias("distinct"),
        (F.regexp_count("value", F.lit(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])")) / F.length("value")).alias("switches"),
        (F.aggregate("steps", F.lit(0.0), lambda a, x: a + x) / F.size("steps")).alias("transitions"),
        F.coalesce(F.array_max(F.transform(F.split("value", "[^A-Za-z]+"), lambda r: F.length(r))), F.lit(0)).cast("double").alias("longest"), runs.alias("runs"),
    )
    v = materialize(v, "secret-values")
    known = v.select("value", F.explode("runs").alias("word")).join(words.where(F.col("n") >= COMMON).select("word"), "word")
    covered = known.groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    v = v.join(covered, "value", "left")
    return v.select(*v.columns[:-2], F.least(F.lit(1.0), F.coalesce("covered", F.lit(0)) / F.col("size")).alias("coverage"))


def _features(found: DataFrame, values: DataFrame) -> DataFrame:
    """``found`` with the columns FEATURES, all double."""
    out = lookup(found, values, "value", "n", F.concat("doc_id", "start"))
    mark = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    beside = F.filter(F.split(F.concat_ws(" ", "before", "after"), r"\s+"), lambda w: w != "")
    plain = F.size(F.filter(beside, lambda w: w.rlike(r"^\p{L}+[.,;:!?]?$"))) / F.greatest(F.size(beside), F.lit(1))
    return out.select(
        *found.columns, *FEATURES[:9], mark(F.col("path").rlike(TESTS)).alias("path_test"), F.size(F.split("path", r"[/\\]")).cast("double").alias("path_depth"),
        mark(F.col("before").rlike(HINTS)).alias("hint"), mark(F.col("before").rlike(DOUBTS)).alias("doubt"), mark(F.col("before").rlike(r"[=:]\s*[\"']?$")).alias("assigned"),
        mark(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).alias("quoted"), plain.cast("double").alias("plain_neighbours"),
    )


def _forest(rows: DataFrame, sample: int):
    """A forest fitted on the labelled rows, or their only label, or 1 if there are none."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    labelled = rows.where("label IS NOT NULL")
    n = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return next(iter(n), 1.0)
    # About sample / 2 of each label, by a hash; one partition in a fixed order, so the forest is the same each time.
    share = F.create_map(*[F.lit(x) for k, c in n.items() for x in (float(k), int(min(1.0, sample / 2 / c) * 1e9))])
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", "start", "value"), F.lit(10**9)) < share[F.col("label")])
    chosen = materialize(chosen.select("value", "doc_id", "start", "label", *FEATURES), "secret-sample").coalesce(1).sortWithinPartitions("value", "doc_id", "start")
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(chosen)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(ready)


def secret_scan(docs: DataFrame, findings: DataFrame | None = None, path: str = "source", sample: int = SAMPLE) -> DataFrame:
    """doc_id, path, start, value, score and secret for each candidate in ``docs`` (doc_id, text and the path's column).

    ``findings`` are labelled candidates (doc_id, path, start, value, before, after, label) to learn from; by default
    the candidates themselves as ``label_findings`` marks them.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    words = materialize(corpus_words(docs), "corpus-words")
    found = materialize(label_findings(candidates(docs, path)).withColumn("mine", F.lit(True)), "candidates")
    if findings is not None:
        theirs = findings.select("doc_id", "path", "start", "value", "before", "after", F.col("label").cast("double").alias("label"), F.lit(False).alias("mine"))
        found = materialize(found.withColumn("label", F.lit(None).cast("double")).unionByName(theirs.select(*found.columns)), "findings")
    values = found.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    values = materialize(_value_features(values, words, transitions(words)), "secret-features")
    rows = materialize(_features(found, values), "findings-features")
    forest = _forest(rows, sample)
    mine = rows.where("mine")
    if isinstance(forest, float):
        scored = mine.withColumn("score", F.lit(forest))
    else:
        ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(mine)
        scored = forest.transform(ready).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "path", "start", "value", "score", (F.col("score") >= 0.5).alias("secret"))
