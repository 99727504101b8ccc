"""Streams: commands on vaults with an undo that expires, restoring of texts that come in pieces, counts by outcome.

A vault's commands are dealt by vault_id and answered in the order of their arrival, with the vault as keyed state that
a checkpoint brings back. One micro-batch's change to a vault is kept as a whole or not at all. Spark's own rate limits
hold back a source, so nothing is dropped; a mistaken command gets an answer and changes nothing. A span that lies outside
of its text, cuts a character or begins within the one before it is left out. A vault without commands for as long as
``idle`` says is forgotten.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from maskwright.functions import surrogates as T
from maskwright.operators.shared import fresh

#: Seconds for which an anonymized text can be taken back.
UNDO_SECONDS = 300.0
#: Buckets that share out the streams whose texts are restored.
BUCKETS = 4096
COMMANDS = "vault_id string, req_id string, op string, text string, at double, spans array<struct<category:string,start:int,end:int,text:string,score:float>>"
ANSWERS = "vault_id string, req_id string, op string, outcome string, text string, count int, subs string, removed int"


def mint(category: str, real: str, attempt: int, seed: int = 0) -> str:
    """The surrogate that ``functions.surrogates.surrogate`` gives, on a worker."""
    key = f"{seed}|{category}|{real}|{attempt}"
    draw = lambda n, size: int(hashlib.md5(f"{key}|{n}".encode()).hexdigest()[:8], 16) % size
    pick = lambda n, items: items[draw(n, len(items))]
    if category == "private_person":
        return f"{pick(0, T.FORENAMES)} {pick(1, T.SURNAMES)}"
    if category == "private_email":
        return f"{pick(0, T.FORENAMES).lower()}.{pick(1, T.SURNAMES).lower()}{draw(2, 100):02}@{pick(3, T.DOMAINS)}"
    if category == "private_phone":
        return f"({draw(0, 800) + 200}) {draw(1, 800) + 200}-{draw(2, 10_000):04}"
    if category == "private_address":
        return f"{draw(0, 9899) + 1} {pick(1, T.STREETS)} {pick(2, T.STREET_KINDS)}"
    if category == "private_date":
        return f"{draw(0, 150) + 1900}-{draw(1, 12) + 1:02}-{draw(2, 28) + 1:02}"
    if category == "private_url":
        return f"https://{pick(0, T.DOMAINS)}/{pick(1, T.URL_WORDS)}-{pick(2, T.URL_WORDS)}-{draw(3, 100_000):05}"
    if category == "account_number":
        return f"{draw(0, 100_000):05}{draw(1, 100_000):05}"
    return "sk-fake-" + "".join(pick(i, T.ALNUM) for i in range(16))


def longest_first(text: str, pairs: list[tuple[str, str]]) -> tuple[str, int]:
    """The text with surrogates replaced in one pass, the longest first, and how many of them occur in it."""
    import re

    pairs = [(f, r) for f, r in pairs if f]
    if not pairs:
        return text, 0
    real: dict[str, str] = {}
    for f, r in pairs:
        real.setdefault(f, r)
    any_of = re.compile("|".join(re.escape(f) for f in sorted(real, key=len, reverse=True)))
    return any_of.sub(lambda m: real[m[0]], text), sum(f in text for f in real)


class Vault:
    """A vault's entries [category, real, fake] in order, found by value and by surrogate, and the last text that can be
    taken back."""

    def __init__(self, stored: str | None, cap: int, seed: int):
        held = json.loads(stored) if stored else {}
        self.undo, self.cap, self.seed = held.get("undo"), cap, seed
        self.fakes = {(c, r): f for c, r, f in held.get("entries", [])}  # in order
        self.taken = set(self.fakes.values())

    @property
    def entries(self) -> list[list[str]]:
        return [[c, r, f] for (c, r), f in self.fakes.items()]

    def stored(self) -> str:
        return json.dumps({"entries": self.entries, "undo": self.undo})

    def surrogate(self, category: str, real: str) -> str:
        if (category, real) in self.fakes:
            return self.fakes[category, real]
        fake = next((f for a in range(64) if (f := mint(category, real, a, self.seed)) not in self.taken), None)
        n = 0
        while fake is None or fake in self.taken:
            fake, n = f"{mint(category, real, 0, self.seed)}-{n:02}", n + 1
        self.fakes[category, real] = fake
        self.taken.add(fake)
        return fake

    def forget(self, many: int) -> None:
        """Without the oldest entries."""
        for key in list(self.fakes)[:many]:
            self.taken.discard(self.fakes.pop(key))

    def answer(self, op: str, text: str | None, at: float, spans) -> tuple[str, str | None, int, str | None, int]:
        """outcome, text, count, subs and how many entries the cap or clearing removed."""
        blank = not (text or "").strip()
        if op == "anonymize":
            if blank:
                return "empty", text, 0, None, 0
            data, out, pos, subs, found = text.encode(), [], 0, [], 0
            for s in sorted(spans if spans is not None else (), key=lambda s: s["start"]):
                found += 1
                if not pos <= s["start"] <= s["end"] <= len(data) or any(data[i : i + 1] and data[i] & 0xC0 == 0x80 for i in (s["start"], s["end"])):
                    continue
                fake = self.surrogate(s["category"], s["text"])
                out += [data[pos : s["start"]].decode(), fake]
                pos = s["end"]
                subs.append([fake, s["text"]])
            if not subs:
                return "no_pii", text, 0, None, 0
            removed = max(0, len(self.fakes) - self.cap) if self.cap else 0
            self.forget(removed)
            new = "".join(out) + data[pos:].decode()
            self.undo = {"previous": text, "expected": new, "at": at}
            return "anonymized", new, found, json.dumps(subs, ensure_ascii=False), removed
        if op == "restore":
            if blank:
                return "empty", text, 0, None, 0
            new, n = longest_first(text, [(f, r) for _, r, f in self.entries])
            if not n:
                return "nothing_to_restore", text, 0, None, 0
            self.undo = {"previous": text, "expected": new, "at": at}
            return "restored", new, n, None, 0
        if op == "undo":
            if not self.undo:
                return "no_undo", text, 0, None, 0
            if at - self.undo["at"] > UNDO_SECONDS:
                self.undo = None
                return "undo_expired", text, 0, None, 0
            if text != self.undo["expected"]:
                return "undo_refused", text, 0, None, 0
            previous, self.undo = self.undo["previous"], None
            return "undone", previous, 0, None, 0
        if op == "clear":
            removed, self.undo = len(self.fakes), None
            self.forget(removed)
            return "cleared", None, 0, None, removed
        if op == "snapshot":
            return "snapshot", None, len(self.entries), json.dumps([[f, r] for _, r, f in self.entries], ensure_ascii=False), 0
        return "unknown", text, 0, None, 0


def vault_commands(commands: DataFrame, cap: int = 0, seed: int = 0, idle: str | None = None) -> DataFrame:
    """Answers to a stream (or table) of COMMANDS; ``spans`` come from the pattern pass or a detector before.

    ``idle``, such as ``7 days``, is after how much time without commands a vault's state is dropped, in a stream that goes on
    (one that only takes what is there now would wait for the time to pass); by default never.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        vault = Vault(state.get[0] if state.exists else None, cap, seed)
        rows = pd.concat(list(parts)).sort_values(["at", "req_id"], kind="stable")
        out = []
        for r in rows.itertuples():
            spans = [x if isinstance(x, dict) else x.asDict() for x in (r.spans if r.spans is not None else ())]
            out.append((key[0], r.req_id, r.op, *vault.answer(r.op, r.text, r.at, spans)))
        state.update((vault.stored(),))
        if idle:
            state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ANSWERS.split(", ")])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return commands.groupBy("vault_id").applyInPandasWithState(run, ANSWERS, "stored string", "append", timeout)


class Surrogates:
    """The surrogates of (fake, real) pairs, made ready once: what begins one, and one expression for all of them."""

    def __init__(self, pairs: list[tuple[str, str]]):
        import re

        self.real: dict[str, str] = {}
        for f, r in pairs:
            if f:
                self.real.setdefault(f, r)
        self.sizes = sorted({len(f) for f in self.real})
        self.longest = max(self.sizes, default=0)
        self.heads = {f[:n] for f in self.real for n in range(1, len(f))}
        self.any_of = re.compile("|".join(re.escape(f) for f in sorted(self.real, key=len, reverse=True))) if self.real else None

    def restore(self, text: str) -> str:
        return self.any_of.sub(lambda m: self.real[m[0]], text) if self.any_of and text else text

    def split(self, text: str) -> int:
        """See ``split_safely``."""
        return next((at for at in range(max(0, len(text) - self.longest + 1), len(text)) if text[at:] in self.heads), len(text))

    def cut(self, text: str) -> int:
        """See ``safe_cut``."""
        cut = self.split(text)
        while cut and cut < len(text):
            at = next((a for a in range(max(0, cut - self.longest + 1), cut) if text[a:cut] in self.heads and any(a + n > cut and text[a : a + n] in self.real for n in self.sizes)), None)
            if at is None:
                return cut
            cut = at
        return cut


def split_safely(text: str, fakes: list[str]) -> int:
    """How much of a growing text can be given out: up to where a surrogate may have begun that isn't whole yet."""
    return Surrogates([(f, f) for f in fakes]).split(text)


def restore_stream(pieces: DataFrame, pairs: list[tuple[str, str]], buckets: int = BUCKETS) -> DataFrame:
    """stream_id, seq and text: pieces (stream_id, seq, text, last) with surrogates replaced, whole even where a piece
    ends within one. ``pairs`` are (fake, real), of a vault that fits a worker.

    Streams share the state of a bucket, as calling Python costs more than a short stream's pieces; a bucket keeps only
    what is still held back, and its pieces of one micro-batch are held at once.
    """
    ready: list[Surrogates] = []  # made once a task

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if not ready:
            ready.append(Surrogates(pairs))
        known = ready[0]
        held: dict[str | None, str] = dict(json.loads(state.get[0])) if state.exists else {}
        rows = [r for p in parts for r in zip(*(p[c].tolist() for c in ("seq", "stream_id", "text", "last")), strict=True)]
        rows.sort(key=lambda r: r[0])
        out = []
        for seq, stream, text, last in rows:
            so_far = held.get(stream, "") + (text or "")
            cut = len(so_far) if last else known.cut(so_far)
            out.append((stream, seq, known.restore(so_far[:cut])))
            held[stream] = so_far[cut:]
        state.update((json.dumps([x for x in held.items() if x[1]]),))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "text"])

    bucket = fresh(pieces, "_bucket")[0]
    dealt = pieces.withColumn(bucket, F.pmod(F.xxhash64("stream_id"), F.lit(buckets)))
    return dealt.groupBy(bucket).applyInPandasWithState(run, "stream_id string, seq long, text string", "held string", "append", GroupStateTimeout.NoTimeout)


def safe_cut(text: str, fakes: list[str]) -> int:
    """As ``split_safely``, but never within a whole surrogate that the rest might still make longer."""
    return Surrogates([(f, f) for f in fakes]).cut(text)


def outcome_counts(answers: DataFrame) -> DataFrame:
    """How many commands of each kind had each outcome."""
    return answers.groupBy("op", "outcome").agg(F.count(F.lit(1)).alias("n"))


def replica(events: DataFrame) -> DataFrame:
    """Each client's copy of a vault: the last state after its snapshots, deltas and clearings, in order.

    A snapshot replaces the copy unless it is empty and the copy is not; a delta puts in its pairs; clearing empties.
    ``events`` has vault_id, seq, kind and pairs (array of (fake, real)).
    """
    empty = F.create_map().cast("map<string,string>")
    as_map = lambda e: F.map_from_entries(e["pairs"])
    put = lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
    step = lambda a, e: (
        F.when(e["kind"] == "clear", empty)
        .when((e["kind"] == "snapshot") & ((F.size(e["pairs"]) > 0) | (F.size(a) == 0)), as_map(e))
        .when(e["kind"] == "delta", put(a, as_map(e)))
        .otherwise(a)
    )
    ordered = F.array_sort(F.collect_list(F.struct("seq", "kind", "pairs")))
    return events.groupBy("vault_id").agg(ordered.alias("e")).select("vault_id", F.aggregate("e", empty, step).alias("pairs"))


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Answers handed to ``sink`` batch by batch; a restart goes on from the checkpoint."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
