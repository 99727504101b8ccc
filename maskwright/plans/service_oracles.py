"""DuckDB SQL for the queries of ``services``, written from the definitions."""

from __future__ import annotations

from maskwright.functions import surrogates as T
from maskwright.plans.oracles import _FIRST_SEEN, _MERGE, _SEGMENTS, DOCS, _at, _made, _spliced, spans, surrogate
from maskwright.plans.queries import MAIL

_CONTACTS = _made("contacts")
#: The chance of a label whose score is 1 above the other's.
_CHANCE = "exp(1.0) / (1 + exp(1.0))"
_TRIMMED = """a + length(piece) - length(ltrim(piece)) AS a, b - (length(piece) - length(rtrim(piece))) AS b"""
_FOURS = "SELECT id, 4 * k AS a, least(4 * k + 4, length(x)) AS b, substr(x, 4 * k + 1, 4) AS piece FROM {}, range(1000) AS t(k) WHERE k % 3 = 1 AND 4 * k < length(x)"
_HYBRID = f"""WITH RECURSIVE {spans(_CONTACTS)}, {_SEGMENTS},
        masked AS (SELECT id, string_agg(CASE WHEN category IS NULL THEN t ELSE ' ' END, '' ORDER BY k) AS x FROM parts GROUP BY id),
        tok AS ({_FOURS.format('masked')}),
        asked AS (SELECT id, {_TRIMMED} FROM tok WHERE trim(piece) <> ''),
        one AS (SELECT q.id, q.a, q.b, {_at('q.a', False)} AS s FROM asked q ASOF LEFT JOIN segments g ON q.id = g.id AND q.a >= g.m),
        two AS (SELECT q.id, q.s, {_at('q.b', True)} AS e FROM one q ASOF LEFT JOIN segments g ON q.id = g.id AND q.b >= g.m),
        todo AS (
            SELECT id, category, s, e, CAST(1 AS DOUBLE) AS score, n AS i FROM spans
            UNION ALL SELECT id, 'private_person', s, e, {_CHANCE}, 1000000 + s FROM two w
            WHERE s < e AND NOT EXISTS (SELECT 1 FROM spans r WHERE r.id = w.id AND r.s < w.e AND w.s < r.e)), {_MERGE},
        full_ AS (
            SELECT id AS doc_id, category, s, e, substr(src.text, CAST(s + 1 AS INT), CAST(e - s AS INT)) AS text, round(CAST(score AS DOUBLE), 4) AS score
            FROM merged JOIN src USING (id))"""
_NUMBERED = "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS n, category, s, e, text, score FROM full_"


def _person_and_address(category: str, real: str) -> str:
    draw = lambda n, size: f"(('0x' || substr(md5('0|' || {category} || '|' || {real} || '|0|{n}'), 1, 8))::BIGINT % {size})"
    pick = lambda n, items: f"([{', '.join(repr(x) for x in items)}])[1 + {draw(n, len(items))}]"
    return f"""CASE {category} WHEN 'private_person' THEN {pick(0, T.FORENAMES)} || ' ' || {pick(1, T.SURNAMES)}
        WHEN 'private_address' THEN ({draw(0, 9899)} + 1) || ' ' || {pick(1, T.STREETS)} || ' ' || {pick(2, T.STREET_KINDS)} ELSE {surrogate(category, real)} END"""


def _parts(kind: str, lines: list[str]) -> str:
    mail = "'s' || s_suppkey || '@shop.example.com'"
    rows = ", ".join(f"({i}, '{x}')" for i, x in enumerate(lines))
    return f"""SELECT 's' || s_suppkey || '.{kind}' AS path, CAST(n AS BIGINT) AS n, x || ' to ' || {surrogate("'private_email'", mail)} AS text, true AS clean
        FROM supplier, (VALUES {rows}) AS t(n, x)"""


_FIRST_TURNS = f"SELECT conv_id AS id, {MAIL} AS text FROM conversations WHERE turn = 0"

ORACLES: dict[str, str] = {
    "hybrid_detection": f"{_HYBRID} {_NUMBERED}",
    "hybrid_detection_sure": f"{_HYBRID} {_NUMBERED} WHERE score = 1",
    "serving_threshold": f"{_HYBRID} {_NUMBERED} WHERE score = 1 OR doc_id % 2 = 1",
    "model_detection": f"""WITH src AS (SELECT id, text AS x FROM ({_CONTACTS})), tok AS ({_FOURS.format('src')}),
        cut AS (SELECT id, {_TRIMMED} FROM tok WHERE trim(piece) <> ''),
        full_ AS (SELECT id AS doc_id, 'private_person' AS category, a AS s, b AS e, substr(x, CAST(a + 1 AS INT), CAST(b - a AS INT)) AS text, round({_CHANCE}, 4) AS score FROM cut JOIN src USING (id))
        {_NUMBERED}""",
    "window_merging": """WITH d AS (SELECT c_custkey AS doc_id, 3000 + c_custkey % 300 * 5 AS size FROM customer)
        SELECT doc_id, CAST(j AS BIGINT) AS n, CASE WHEN j % 2 = 0 THEN 'secret' ELSE 'private_person' END AS category, CAST(50 * j AS BIGINT) AS s,
               CAST(least(50 * j + 25, size) AS BIGINT) AS e, substr(repeat('abcde', 1000), CAST(50 * j + 1 AS INT), CAST(least(25, size - 50 * j) AS INT)) AS text
        FROM d, range(200) AS t(j) WHERE 50 * j < size""",
    "evaluated_detector": f"""WITH {spans(_CONTACTS)},
        gold AS (SELECT id, 'private_email' AS category, strpos(text, ' or write ') + 9 AS s, strpos(text, ' or write ') + 14 AS e FROM src UNION ALL SELECT id, NULL, 0, 12 FROM src),
        hits AS (
            SELECT category, 1 AS gold, CAST(EXISTS (SELECT 1 FROM spans p WHERE p.id = g.id AND p.category = g.category AND p.s < g.e AND g.s < p.e) AS INT) AS matched, 0 AS good, 0 AS fp
            FROM gold g WHERE category IS NOT NULL
            UNION ALL
            SELECT category, 0, 0, CAST(good AS INT), CAST(NOT good AND NOT spared AS INT) FROM (
                SELECT category, EXISTS (SELECT 1 FROM gold g WHERE g.id = p.id AND g.category = p.category AND p.s < g.e AND g.s < p.e) AS good,
                       EXISTS (SELECT 1 FROM gold g WHERE g.id = p.id AND g.category IS NULL AND p.s < g.e AND g.s < p.e) AS spared FROM spans p))
        SELECT coalesce(category, 'OVERALL') AS category, CAST(sum(gold) AS BIGINT) AS gold, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(good) AS BIGINT) AS good, CAST(sum(fp) AS BIGINT) AS fp
        FROM hits GROUP BY ROLLUP (category)""",
    "label_ids": "SELECT CAST(a AS BIGINT) AS id, b AS category FROM (VALUES (0, NULL), (1, 'secret'), (2, 'secret'), (3, 'private_person'), (4, 'private_url')) AS t(a, b)",
    "surrogate_kinds": f"""SELECT c_custkey, category, {_person_and_address('category', 'c_name')} AS fake FROM customer,
        (VALUES ('account_number'), ('private_address'), ('private_date'), ('private_email'), ('private_person'), ('private_phone'), ('private_url'), ('secret')) AS t(category)""",
    "vault_collisions": "SELECT count(*) AS n, count(*) AS n_fakes, count(*) AS n_dates, count(*) - 1 AS last FROM orders",
    "anonymize_missing_keys": f"SELECT doc_id, md5(anonymized) AS anonymized_md5 FROM ({_spliced(surrogate('category', 't'), 'anonymized')})",
    "vault_json": f"{_FIRST_SEEN} SELECT * FROM vault",
    "stored_vault": f"{_FIRST_SEEN} SELECT * FROM vault",
    "anonymized_before": f"WITH {spans(DOCS)} SELECT 'd' || id AS id FROM src UNION ALL SELECT 'a' || id FROM src WHERE id NOT IN (SELECT id FROM spans)",
    "run_summary": f"WITH {spans(DOCS)} SELECT (SELECT count(*) FROM src) AS documents, count(*) AS entries FROM (SELECT DISTINCT category, text FROM spans)",
    "combined_json": f"""WITH {spans(f"SELECT conv_id * 1000 + turn AS id, {MAIL} AS text FROM conversations")}
        SELECT id // 1000 AS conv_id, id % 1000 AS turn, md5('{{"anonymized":"x","vault":[' ||
               string_agg('{{"real":"' || text || '","fake":"' || {surrogate('category', 'text')} || '"}}', ',' ORDER BY n) || ']}}') AS json_md5 FROM spans GROUP BY id""",
    "vault_service": f"""WITH {spans(_FIRST_TURNS)},
        made AS (SELECT id, string_agg(t, '' ORDER BY k) AS x, string_agg(CASE WHEN category IS NULL THEN t ELSE {surrogate('category', 't')} END, '' ORDER BY k) AS a FROM parts GROUP BY id),
        counts AS (SELECT id, count(*) AS found, count(DISTINCT text) AS held FROM spans GROUP BY id)
        SELECT id AS conv_id, CAST(step AS BIGINT) AS step, op, outcome, md5(CASE said WHEN 'x' THEN x WHEN 'a' THEN a END) AS text_md5,
               CAST(CASE counted WHEN 'found' THEN found WHEN 'held' THEN held ELSE 0 END AS BIGINT) AS count, CASE WHEN op = 'clear' THEN held ELSE 0 END AS removed
        FROM made JOIN counts USING (id), (VALUES
            (0, 'anonymize', 'anonymized', 'a', 'found'), (1, 'restore', 'restored', 'x', 'held'), (2, 'undo', 'undone', 'a', ''), (3, 'undo', 'no_undo', 'x', ''),
            (4, 'anonymize', 'anonymized', 'a', 'found'), (5, 'undo', 'undo_refused', 'x', ''), (6, 'undo', 'undo_expired', 'a', ''), (7, 'restore', 'nothing_to_restore', 'x', ''),
            (8, 'snapshot', 'snapshot', '', 'held'), (9, 'clear', 'cleared', '', ''), (10, 'snapshot', 'snapshot', '', ''), (11, 'turn', 'unknown', 'x', '')) AS t(step, op, outcome, said, counted)""",
    "vault_replica": """WITH RECURSIVE l AS (SELECT l_orderkey AS id, l_linenumber AS line, max(l_partkey) AS p, max(l_suppkey) AS q FROM lineitem GROUP BY ALL),
        e AS (
            SELECT id, row_number() OVER (PARTITION BY id ORDER BY line) AS k, CASE WHEN line = 1 THEN 'snapshot' WHEN p % 7 = 0 THEN 'clear' WHEN p % 5 = 0 THEN 'snapshot' ELSE 'delta' END AS kind,
                   CASE WHEN q % 3 = 0 THEN MAP([]::VARCHAR[], []::VARCHAR[]) ELSE MAP(['f' || p % 9], ['r' || q]) END AS pairs FROM l),
        f AS (
            SELECT DISTINCT id, CAST(0 AS BIGINT) AS k, MAP([]::VARCHAR[], []::VARCHAR[]) AS held FROM e
            UNION ALL
            SELECT f.id, e.k, CASE WHEN kind = 'clear' THEN MAP([]::VARCHAR[], []::VARCHAR[]) WHEN kind = 'delta' THEN map_concat(held, pairs)
                   WHEN cardinality(pairs) > 0 OR cardinality(held) = 0 THEN pairs ELSE held END
            FROM f JOIN e ON e.id = f.id AND e.k = f.k + 1)
        SELECT id AS vault_id, array_to_string(list_sort(list_transform(map_entries(arg_max(held, k)), lambda x: x.key || '=' || x.value)), ' ') AS held FROM f GROUP BY id""",
    "docx_parts": _parts("docx", ["p0", "p2", "p1", "p3", "p4", "p5", "chart", "alt"]),
    "pptx_parts": _parts("pptx", ["p1", "p0", "p2", "chart", "alt"]),
    "xlsx_parts": _parts("xlsx", ["p0", "chart", "alt"]),
    "upload_routes": """SELECT p_partkey, CASE WHEN p_partkey % 10 IN (0, 1) THEN 'document' WHEN p_partkey % 10 IN (2, 3, 4, 7, 8) OR p_partkey % 7 IN (0, 1, 4, 6) THEN 'text' ELSE 'other' END AS kind FROM part""",
    "url_routes": r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS target FROM pages)
        SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'posted' WHEN regexp_matches(target, '\.example\.com/en/') THEN 'english' WHEN regexp_matches(target, '\.example\.net/') THEN 'net' END AS route,
               nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, regexp_replace(url, '([?&]page=)[^&#]*', '\1a+b%26%241', 'g') AS changed FROM p""",
    "request_origins": """SELECT c_custkey, c_custkey % 5 IN (0, 1, 4) AS allowed,
        regexp_full_match(translate(md5(CAST(c_custkey AS VARCHAR)), '0123456789', CASE WHEN c_custkey % 3 = 0 THEN 'ghijklmnop' ELSE 'ghijklmno9' END), '[a-p]{32}') AS extension FROM customer""",
    "request_bodies": """SELECT o_orderkey, 'messages/' || (i - 1) || '/text' AS path, 'message ' || i || ' of order ' || o_orderkey AS value
        FROM orders, range(1, 8) AS t(i) WHERE i <= o_orderkey % 7 + 1 AND i > o_orderkey % 7 - 3""",
    "nested_json": """SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN 'ORDER ' || o_orderkey END AS m,
        CASE WHEN o_orderkey % 10 = 0 THEN '[null,3]' ELSE '[null,"[[' || chr(92) || '"ORDER ' || o_orderkey || chr(92) || '"],1]",2]' END AS j FROM orders""",
    "scan_lines": f"""WITH {spans(_CONTACTS)}
        SELECT id, '{{"id":' || id || ',"spans":[' || string_agg('{{"category":"' || category || '","start":' || s || ',"end":' || e || ',"text":"' || text || '","score":1.0}}', ',' ORDER BY n) || ']}}' AS line
        FROM spans GROUP BY id""",
    "skipped_records": """SELECT CASE o_orderkey % 10 WHEN 0 THEN 'blank' WHEN 1 THEN 'not_json' ELSE 'read' END AS reason, count(*) AS n FROM orders GROUP BY 1""",
    "byte_order_mark": "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS id, c_name AS text FROM customer",
    "source_formats": "SELECT CAST(a AS BIGINT) AS id, b AS kind FROM (VALUES (0, 'jsonl'), (1, 'jsonl'), (2, 'tsv'), (3, 'lines'), (4, 'files'), (5, 'lines'), (6, 'lines')) AS t(a, b)",
    "any_frame": "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS text FROM nation",
    "base64_texts": "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN md5(text) END AS text_md5 FROM documents WHERE text IS NOT NULL",
    "entity_labels": """SELECT 'é from ' || n_name || ' ü ' || n_nationkey AS text, CASE WHEN n_nationkey % 2 = 1 THEN 'private_person' END AS category, CAST(8 AS BIGINT) AS s, CAST(8 + length(n_name) AS BIGINT) AS e FROM nation""",
}
