import random

from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import substring_dedup as S

SCHEMA = "doc_id long, text string, pos int, spans string"


def test_sentences():
    text = 'One two. "Three!" Four?\nfive\n\n 3.5 six。seven'
    assert [text[a:b] for a, b in S.sentences(text)] == ["One two. ", '"Three!" ', "Four?\n", "five\n\n ", "3.5 six。", "seven"]
    assert S.sentences("") == [] and S.sentences(" \n ") == []


def pieces(text):
    """Sentences as the docstring defines them, character by character: where each ends after its white space."""
    out, at, i = [], 0, 0
    while i < len(text):
        end = None
        if text[i] in "。！？":
            end = i + 1
            while end < len(text) and text[end] in "。！？":
                end += 1
        elif text[i] == "\n":
            end = i + 1
        elif text[i] in ".!?…":
            j = i + 1
            while j < len(text) and text[j] in ".!?…":
                j += 1
            while j < len(text) and text[j] in "\"')]»”’":
                j += 1
            if j < len(text) and text[j].isspace():
                end = j
            else:
                i = j - 1
        if end is not None:
            while end < len(text) and text[end].isspace():
                end += 1
            out.append(text[at:end])
            at = i = end
            continue
        i += 1
    return [p for p in [*out, text[at:]] if p.strip()]


def brute(rows, least, words):
    """Every run of sentences, compared as words; what any but the first equal one covers goes."""
    order = sorted({(r[0] if r[0] is not None else 1 << 62, r[1]) for r in rows if r[1]}, key=lambda x: x[0])
    seen, gone = set(), {}
    for doc, text in order:
        said = [tuple(p.split()) for p in pieces(text)]
        cut = gone.setdefault((doc, text), set())
        for i in range(len(said)):
            for j in range(i + least, len(said) + 1):
                if sum(map(len, said[i:j])) >= words:
                    run = tuple(said[i:j])
                    if run in seen:
                        cut.update(range(i, j))
                    seen.add(run)
    out = []
    for doc_id, text, *_ in rows:
        places, cut = pieces(text or ""), gone.get((doc_id if doc_id is not None else 1 << 62, text), set())
        out.append((doc_id, len(places), len(cut), None if text is None else "".join(p for i, p in enumerate(places) if i not in cut)))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=30))
def test_spans_are_the_shortest_runs(sizes):
    text = " ".join(" ".join(["w"] * n) + "." for n in sizes)
    long = {(i, j) for i in range(len(sizes)) for j in range(i + 2, len(sizes) + 1) if sum(sizes[i:j]) >= 9}
    first = {(i, min(b for a, b in long if a == i)) for i, _ in long}
    last = {(max(a for a, b in long if b == j), j) for _, j in long}
    assert {(i, i + n) for i, n, _ in S.spans(text, 2, 9)} == first | last


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD", 30)
    rng = random.Random(4)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.choice([1, 3, 6, 14]))).capitalize() + rng.choice(".!?") for _ in range(40)]
    shared = [" ".join(rng.choices(pool, k=6)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [" ".join(f"{rng.choice('xyz')}{rng.randrange(9)}" for _ in range(rng.choice([2, 9]))) + "." for _ in range(rng.randrange(6))]
        if rng.random() < 0.6:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        rows.append((i, rng.choice([" ", "\n"]).join(parts), 0, "x"))
    rows += [(60, rows[3][1], 0, "x"), (60, rows[3][1], 0, "x"), (61, None, 0, "x"), (62, "", 0, "x"), (None, rows[5][1], 0, "x"), (64, "k " * 50_000, 0, "x"), (65, "k " * 50_000, 0, "x")]
    for bound in (400_000, 0):
        monkeypatch.setattr(S, "BROADCAST_ROWS", bound)
        got = sorted(map(tuple, S.substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4), 2, 8).collect()), key=str)
        want = brute(rows, 2, 8)
        assert sum(w[2] > 0 for w in want) > 20
        assert [(r[0], r[1], r[2], r[4]) for r in got] == sorted(want, key=str)
    for r in got:
        text = next(t for i, t, *_ in rows if i == r[0] and len(pieces(t or "")) == r[1])
        assert sum(e - s for s, e in r[3]) == len(text or "") - len(r[4] or "")


def test_empty_table(spark):
    assert S.substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_sentence_alone_is_no_span(spark):
    line = " ".join(f"w{i}" for i in range(60)) + "."
    rows = [(i, f"a{i} b{i}. {line} c{i} d{i}.", 0, "x") for i in range(3)]
    assert {r.n_removed for r in S.substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()} == {0}


def test_all_sentences_of_a_planted_passage_go(spark):
    rng = random.Random(9)
    sentence = lambda k: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(k)) + "."
    for sizes in ((40, 15), (38, 8, 8), (12, 12, 12, 12, 12), (25, 9, 7, 3), (10, 10, 45, 2)):
        passage = " ".join(sentence(k) for k in sizes)
        rows = [(i, f"{sentence(30)} {passage} {sentence(30)}", 0, "x") for i in range(3)]
        got = {r.doc_id: r for r in S.substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert [got[i].n_removed for i in range(3)] == [0, len(sizes), len(sizes)], sizes
        assert all(passage.split()[0] not in got[i].text and passage.split()[-1] not in got[i].text for i in (1, 2))


def test_characters_count_in_scripts_without_spaces(spark):
    passage = "今日は天気がとても良いので散歩に行きます。明日は雨が降るそうですから家で本を読みます。"
    rows = [(i, f"{chr(0x4E00 + i) * 30}。{passage}{chr(0x5E00 + i) * 25}。", 0, "x") for i in range(3)]
    got = {r.doc_id: r for r in S.substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].n_removed == 0 and all(got[i].n_removed == 2 and passage not in got[i].text for i in (1, 2))
