"""Quality classification by co-training a content view and a metadata view.

Two logistic classifiers see different sides of a document: its text (hashed words and shapes of words) and its
metadata (source, language, length). Each is fitted on the labelled documents; over ROUNDS each then hands the other
unlabelled documents that it is sure of, once that sureness has been right on labelled documents kept apart, and
both are fitted again. Views are calibrated on the documents kept apart, where a combination of the two is fitted too.

Every document's features are written once, as positions of 32 bits. In each round both views pass over the features
of the whole corpus, and all documents of which they are sure are candidates; of those, HANDED of each kind, by a hash, are
fitted. Only features of documents that are fitted reach the driver, never texts: LABELLED labelled ones, chosen by a hash of
doc_id, and 4 x HANDED a round. Scoring covers every document.

A document is good if its label says quality 1 and not toxic.

Defined cases: a null or empty text has no words and a shape of its own; texts of any length are read whole. A null in the
metadata is a value of its own. Labels without quality are left out; toxic null counts as 0; of several labels for a
doc_id the worst holds. Without labels of both kinds no document can be told apart: all get the share of good ones (1
without labels). A score that equals the threshold is accepted. Rows without a doc_id are scored. Repeated rows are scored
each, also where they repeat an id with another text. An empty table gives no rows. Extra columns, whatever their names,
are ignored (``keep_good`` hands them on).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import discard, identity, keep, materialize, released, sliced, spread

LABELLED, HANDED, ROUNDS = 8000, 800, 3
#: Positions of the hashed features: of words, of the text view, whose shapes follow the words, and of the metadata view.
WORD_BITS, TEXT_BITS, META_BITS = 18, 19, 14
#: How often a view must have been right, on documents kept apart, where it is as sure as when it hands on a label.
SURE = 0.97
#: Documents with a lower chance of being good are rejected; below a half, as a clean document lost costs more.
THRESHOLD = 0.4
#: Tokens whose features a task keeps, in about 20 MB.
CACHE = 60_000
#: Features of fewer documents are not fitted.
FEW = 4
#: Lengths of the beginnings of words that count as features too, for inflected forms.
STEMS = (4,)
#: Shares of a text's tokens; a shape is a feature with each that it reaches.
SHARES = (0.0, 0.01, 0.03, 0.1, 0.3, 0.6)
#: Tokens of no shape that each text is taken to have besides, so that a few words prove little.
PRIOR = 20
WORD = re.compile(r"[^\W\d_]+")
FIELDS = ("source", "lang", "n_chars")
FEATURES = "row long, identity struct<none:boolean,id:long,h1:long,h2:long>, text array<int>, meta array<int>"


def _at(feature: str, bits: int) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) & ((1 << bits) - 1)


def shape(token: str) -> str:
    """Runs of capitals, small letters and digits become A, a and 0; other characters stay, once for each run."""
    out: list[str] = []
    for c in token:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


class Tokens(dict):
    """The features of what stands between white space: its words and their beginnings; and its shape."""

    def __missing__(self, token: str) -> tuple[tuple[int, ...], int]:
        words = set(WORD.findall(token.lower()))
        stems = {w[:n] for w in words for n in STEMS if len(w) > n}
        marks = {_at(f"w:{w}", WORD_BITS) for w in words} | {_at(f"p:{w}", WORD_BITS) for w in stems}
        out = (tuple(marks), _at(f"s:{shape(token)}", TEXT_BITS))
        if len(token) <= 60:
            if len(self) >= CACHE:
                self.clear()
            self[token] = out
        return out


def text_features(text: str | None, tokens: Tokens) -> np.ndarray:
    """Positions of the features: words that occur, and shapes with each share that they reach."""
    found = (text or "").split()
    n = len(found)
    if not n:
        return np.array([_at("s:none", TEXT_BITS)], np.int32)
    words: set[int] = set()
    shapes: Counter = Counter()
    for token, k in Counter(found).items():
        w, s = tokens[token]
        words.update(w)
        shapes[s] += k
    same = sum(map(eq, found, found[1:]))
    if same:
        shapes[_at("s:same as before", TEXT_BITS)] += same
    for s, k in shapes.items():
        words.update((1 << WORD_BITS) + (s * 31 + i) % (1 << WORD_BITS) for i, least in enumerate(SHARES) if k >= least * (n + PRIOR))
    return np.fromiter(words, np.int32, len(words))


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    size = None if n_chars is None else int(max(n_chars, 0)).bit_length()
    names = [f"source={source}", f"lang={lang}", f"size={size}", f"lang={lang}&size={size}", f"source={source}&lang={lang}"]
    return np.array([_at(x, META_BITS) for x in names], np.int32)


@dataclass
class View:
    """Logistic regression on hashed features, and the line that calibrates its log odds.

    Features are scaled by the log ratio of the shares of good and of other documents that have them, as in a naive
    Bayes classifier; those in fewer than FEW documents are left out, and of the first ``against``
    those that speak for a document: a long text would make up for anything with ordinary words, a short one lack them.
    """

    bits: int
    against: int = 0
    weights: np.ndarray = field(default=None)
    bias: float = 0.0
    line: tuple[float, float] = (1.0, 0.0)

    def raw(self, x: list[np.ndarray]) -> np.ndarray:
        """Log odds before calibration."""
        return self.of(*_flat(x), len(x)) if x else np.zeros(0)

    def of(self, at: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """The same for ``n`` documents, of features side by side and the document of each."""
        return np.bincount(row, self.weights[at], n) + self.bias

    def fit(self, x: list[np.ndarray], y: np.ndarray, penalty: float, steps: int = 120) -> None:
        """Full-batch Adam."""
        at, row = _flat(x)
        is_good = y > 0.5
        good = np.bincount(at[is_good[row]], minlength=1 << self.bits)
        other = np.bincount(at[~is_good[row]], minlength=1 << self.bits)
        scale = np.log((good + 1) / (is_good.sum() + 2)) - np.log((other + 1) / ((~is_good).sum() + 2))
        scale[good + other < FEW] = 0
        scale[: self.against] = np.minimum(scale[: self.against], 0)
        some = scale[at] != 0
        at, row = at[some], row[some]
        values = scale[at]
        w = np.zeros(1 << self.bits)
        m, v = np.zeros_like(w), np.zeros_like(w)
        # A text that says nothing has the odds of the labels, so only evidence moves it.
        share = np.clip(y.mean(), 0.01, 0.99)
        bias = np.log(share / (1 - share))
        for t in range(1, steps + 1):
            e = (_sigmoid(np.bincount(row, w[at] * values, len(x)) + bias) - y) / len(x)
            g = np.bincount(at, e[row] * values, len(w)) + penalty * w / len(x)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.weights, self.bias = (w * scale).astype(np.float32), float(bias)


def _flat(x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(x), np.repeat(np.arange(len(x), dtype=np.int32), [len(a) for a in x])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _logistic(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the columns of ``z`` and a bias, by Newton's method with a small penalty."""
    a = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(a.shape[1])
    keep = np.diag([1e-2] * z.shape[1] + [1e-4])
    for _ in range(40):
        p = _sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep, a.T @ (p - y) + keep @ w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class CoTrained:
    """Both views, the weights that combine their log odds, and the share of good documents."""

    text: View | None
    meta: View | None
    blend: tuple[float, float, float]
    share: float
    handed: list[tuple[int, int]] = field(default_factory=list)  # each round: labels from the text view, from the metadata view

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """text view, metadata view and both: the calibrated chance that a document is good, of both views' log odds."""
        if self.text is None:
            return np.full((len(text), 3), self.share)
        a = text * self.text.line[0] + self.text.line[1]
        b = meta * self.meta.line[0] + self.meta.line[1]
        return np.column_stack([_sigmoid(a), _sigmoid(b), _sigmoid(a * self.blend[0] + b * self.blend[1] + self.blend[2])])


def _limits(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Below and above which log odds a view is sure: the mildest beyond which it was right on the documents kept apart."""
    out = []
    for sign, good in ((-1, False), (1, True)):
        order = np.argsort(-sign * raw)
        right = np.cumsum(y[order] == good) / np.arange(1, len(order) + 1)
        ok = np.flatnonzero((right >= SURE) & (np.arange(1, len(order) + 1) >= 20))
        out.append(sign * np.inf if not len(ok) or (y == good).mean() >= SURE else raw[order[ok[-1]]])
    return float(out[0]), float(out[1])


#: What a view may hand on: for each view, of a turn, the views and their limits, rows (key, text features, metadata
#: features, label).
Pool = Callable[[int, tuple[View, View], list[tuple[float, float]]], list[list[tuple]]]


def co_train(text: list[np.ndarray], meta: list[np.ndarray], good: list[float], pool: Pool | None = None, rounds: int = ROUNDS) -> CoTrained:
    """Fit on the features of labelled documents, of which each fifth is kept apart, and on what the views take from ``pool``."""
    y, xs = np.array(good, dtype=float), [text, meta]
    share = float(y.mean()) if len(y) else 1.0
    if len(set(good)) < 2:
        return CoTrained(None, None, (0.0, 0.0, 0.0), share)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:  # too few to keep any apart
        held = np.ones(len(y), bool)
        train = np.arange(len(y))
    else:
        train = np.flatnonzero(~held)
    apart = np.flatnonzero(held)
    views = (View(TEXT_BITS, against=1 << WORD_BITS), View(META_BITS))
    penalties = (0.5, 4.0)
    given: list[dict] = [{}, {}]  # for each view, what the other has handed it: features and label by key
    handed = []
    for turn in range(rounds + 1):
        for v, view in enumerate(views):
            rows = [xs[v][i] for i in train] + [x for x, _ in given[v].values()]
            view.fit(rows, np.array([*y[train], *(label for _, label in given[v].values())]), penalties[v])
        if turn == rounds or pool is None or len(apart) == len(y):
            break
        limits = [_limits(view.raw([xs[v][i] for i in apart]), y[apart]) for v, view in enumerate(views)]
        count = []
        for v, found in enumerate(pool(turn, views, limits)):
            other, before = given[1 - v], len(given[1 - v])
            for key, *x, label in found:
                other.setdefault(key, (x[1 - v], label))
            count.append(len(other) - before)
        handed.append(tuple(count))
        if not any(count):
            break
    z = []
    for v, view in enumerate(views):
        raw = view.raw([xs[v][i] for i in apart])
        a, b = _logistic(raw[:, None], y[apart])
        view.line = (max(float(a), 1e-3), float(b))
        z.append(raw * view.line[0] + view.line[1])
    blend = tuple(float(x) for x in _logistic(np.column_stack(z), y[apart]))
    return CoTrained(*views, blend, share, handed)


def features(docs: DataFrame) -> DataFrame:
    """The features of every document, written once."""

    @released
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tokens = Tokens()
        for batch in sliced(batches):
            text, *meta = (c.to_pylist() for c in batch.columns[2:])
            x = [text_features(t, tokens) for t in text]
            m = [meta_features(*r) for r in zip(*meta, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(x), _lists(m)], names=["row", "identity", "text", "meta"])

    rows = spread(docs).select(F.monotonically_increasing_id().alias("row"), identity().alias("identity"), "text", *FIELDS)
    return materialize(rows.mapInArrow(run, FEATURES), "quality-features")


def _lists(x: list[np.ndarray]):
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, x)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x) if x else np.zeros(0, np.int32), pa.int32()))


def _raws(batch, views: tuple[View, View]) -> list[np.ndarray]:
    """Both views' log odds of a batch of features."""
    out = []
    for name, view in zip(("text", "meta"), views, strict=True):
        column = batch.column(name)
        sizes = np.diff(column.offsets.to_numpy())
        out.append(view.of(column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes), len(sizes)))
    return out


def _in_memory(rows: list) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [np.array(r["text"], np.int32) for r in rows], [np.array(r["meta"], np.int32) for r in rows]


def _pool(rest: DataFrame, handed: int) -> Pool:
    """Over all of ``rest``, features of unlabelled documents."""
    spark = rest.sparkSession

    def take(turn: int, views: tuple[View, View], limits: list[tuple[float, float]]) -> list[list[tuple]]:
        shared = spark.sparkContext.broadcast((views, limits))

        @released
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            views, limits = shared.value
            for batch in batches:
                sides = [np.where(raw >= high, 1, np.where(raw <= low, 0, -1)) for raw, (low, high) in zip(_raws(batch, views), limits, strict=True)]
                some = (sides[0] >= 0) | (sides[1] >= 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").filter(pa.array(some)), batch.column("tag").filter(pa.array(some)), *(pa.array(s[some], pa.int32()) for s in sides)], names=["row", "tag", "side0", "side1"]
                )

        sure = rest.withColumn("tag", F.xxhash64("identity.id", "identity.h1", F.lit(turn))).select("row", "tag", "text", "meta").mapInArrow(run, "row long, tag long, side0 int, side1 int")
        sure = materialize(sure, "sure-documents")
        chosen = [(v, side, sure.where(f"side{v} = {side}").orderBy("tag", "row").limit(handed)) for v in (0, 1) for side in (0, 1)]
        picked: dict[int, list[tuple[int, int]]] = {}
        for v, side, rows in chosen:
            for r in rows.select("row").collect():  # ``handed`` at most
                picked.setdefault(r["row"], []).append((v, side))
        discard(sure)
        out: list[list[tuple]] = [[], []]
        if picked:
            ids = F.broadcast(spark.createDataFrame([(r,) for r in picked], "row long"))  # 4 x ``handed`` at most
            found = sorted(rest.join(ids, "row").select("row", "text", "meta").collect(), key=lambda r: r["row"])
            for r, text, meta in zip(found, *_in_memory(found), strict=True):
                for v, side in picked[r["row"]]:
                    out[v].append((r["row"], text, meta, float(side)))
        shared.unpersist()
        return out

    return take


def fit(x: DataFrame, labels: DataFrame, labelled: int = LABELLED, handed: int = HANDED, rounds: int = ROUNDS) -> CoTrained:
    """Both views, of ``features`` of the whole corpus and ``labels`` (doc_id, quality, toxic) of some."""
    good = F.min(((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int")).alias("good")
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(good)
    marks = materialize(marks, "quality-labels")
    share = F.pmod(F.xxhash64("id", F.lit("labelled")), F.lit(10**9)) < int(min(1.0, labelled / max(marks.count(), 1)) * 1e9)
    marks = F.broadcast(marks.where(share))  # about ``labelled``, whatever the corpus
    named = x.withColumn("id", F.when(~F.col("identity.none"), F.col("identity.id")))
    known = named.join(marks, "id")
    n = known.count()
    if n > 2 * labelled:  # ids that many rows share
        known = known.where(F.pmod(F.xxhash64("row"), F.lit(10**9)) < int(labelled / n * 1e9))
    rows = sorted(known.select("id", "text", "meta", "good").collect(), key=lambda r: (r["id"], r["text"], r["meta"]))
    text, meta = _in_memory(rows)
    rest = named.join(marks.select("id"), "id", "left_anti")
    return co_train(text, meta, [float(r["good"]) for r in rows], _pool(rest, handed) if handed else None, rounds)


def _scored(x: DataFrame, model: CoTrained, threshold: float) -> DataFrame:
    shared = x.sparkSession.sparkContext.broadcast(model)
    out = "identity struct<none:boolean,id:long,h1:long,h2:long>, text_score double, meta_score double, score double, accepted boolean"

    @released
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            raws = _raws(batch, (model.text, model.meta)) if model.text else [np.zeros(batch.num_rows)] * 2
            s = model.scores(*raws)
            yield pa.RecordBatch.from_arrays([batch.column("identity"), *(pa.array(s[:, i]) for i in range(3)), pa.array(s[:, 2] >= threshold)], names=[c.split()[0] for c in out.replace("struct<none:boolean,id:long,h1:long,h2:long>", "s").split(", ")])

    return x.select("identity", "text", "meta").mapInArrow(run, out)


def score(docs: DataFrame, model: CoTrained, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_score, meta_score, score and accepted for each row of ``docs``."""
    return _named(_scored(features(docs), model, threshold))


def _named(scored: DataFrame) -> DataFrame:
    return scored.select(F.when(~F.col("identity.none"), F.col("identity.id")).alias("doc_id"), "text_score", "meta_score", "score", "accepted")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The scores of all ``docs`` by a model that is fitted on those with labels."""
    x = features(docs)
    return _named(_scored(x, fit(x, labels), threshold))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all columns, that the classifier accepts."""
    x = features(docs)
    return keep(docs, _scored(x, fit(x, labels), threshold).select("identity", F.col("accepted").alias("kept")))
