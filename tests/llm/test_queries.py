"""The queries of the subpackage against their DuckDB SQL, and that each of the ten is registered."""

import duckdb
import pytest

from maskwright.llm import oracles, queries
from tests.test_queries import DATA, rows


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA), con.sql(oracles.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    data = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert rows(columns, [r.asDict() for r in got.collect()]) == rows(columns, data)


def test_all_ten_are_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES) == list(range(1, 11))


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


def test_op9_against_brute_force(spark):
    from tests.llm.test_jaccard_join import brute

    got = sorted(tuple(r)[:4] for r in queries.op9_jaccard_join(spark, DATA).collect())
    assert got == sorted(brute(documents(spark)))


def test_op10_against_brute_force(spark):
    from tests.llm.test_substring_dedup import pieces

    # Runs are compared as words. Every run is hashed that is long enough; longer ones than needed cover nothing more.
    seen, want = set(), {}
    for doc_id, text in sorted(documents(spark)):
        parts, gone = pieces(text or ""), set()
        said = [" ".join(p.split()) for p in parts]
        n = [len(p.split()) for p in said]
        for i in range(len(said)):
            held = 0
            for j in range(i, len(said)):
                held += n[j]
                if held >= 25 and j > i:
                    run = "\n".join(said[i : j + 1])
                    gone.update(range(i, j + 1) if run in seen else ())
                    seen.add(run)
                    if held >= 25 + max(n):
                        break
        want[doc_id] = (len(parts), len(gone), "".join(p for k, p in enumerate(parts) if k not in gone))
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in queries.op10_substring_dedup(spark, DATA).collect()}
    assert got == want and any(w[1] for w in want.values())


def test_op2_against_the_tokenizer(spark):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    tokenizer, fill, total = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json")), {}, 0
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in documents(spark)}
    for r in queries.op2_best_fit_packing(spark, DATA).collect():
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 2048 * r.piece and len(piece) == r.length and r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
    assert total == sum(map(len, ids.values())) and len(fill) <= 1.03 * total / 2048 + 1
    for parts in fill.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:], strict=False)) and min(parts)[0] == 0 and sum(n for _, n in parts) <= 2048


def test_op1_finds_the_keys_of_known_formats(spark):
    import re

    larger = "/root/testdata/sf0.01"
    found = {(r.doc_id, r.start): r for r in queries.op1_secret_scan(spark, larger).collect()}
    texts = [tuple(r) for r in spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "text").collect()]
    keys = [(i, m.start(1)) for i, t in texts for p in (r"\b(AKIA[A-Z0-9]{16})\b", r"token = \"([0-9a-f]{40})\"") for m in re.finditer(p, t or "")]
    assert len(keys) > 5 and all(found[k].secret for k in keys)
    assert not any(r.secret for r in found.values() if r.length < 20)
