"""DuckDB SQL for the registered queries, written from the definitions and independent of the Spark expressions."""

from __future__ import annotations

from maskwright.functions import surrogates as T
from maskwright.functions.patterns import GROUPS, LUHN_GROUP, PLAIN
from maskwright.plans.queries import ESCAPED, MAIL, SYNTHETIC

SEP, FS = "chr(57344)", "chr(57345)"
_FIELDS = f" || {FS} || ".join(f"'\\{i}'" for i in range(1, len(GROUPS) + 1))
_CATEGORY = "CASE g " + " ".join(f"WHEN {i} THEN '{c}'" for i, (c, _) in enumerate(GROUPS, 1)) + " END"
_DIGITS = "regexp_replace(t, '[^0-9]', '', 'g')"
_LUHN = f"""(length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
    CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN CAST(substr({_DIGITS}, i, 1) AS INT)
         ELSE (2 * CAST(substr({_DIGITS}, i, 1) AS INT)) // 10 + (2 * CAST(substr({_DIGITS}, i, 1) AS INT)) % 10 END)) % 10 = 0)"""


def spans(source: str) -> str:
    """CTEs parts (id, k, t, s, e, category where a piece is a span) and spans (id, n, category, s, e, text) of ``source``
    (id, text): texts cut where the combined pattern matches, with running byte offsets."""
    return f"""
        src AS ({source}),
        marked AS (SELECT id, string_split(regexp_replace(text, '{PLAIN}', {SEP} || {_FIELDS} || {SEP}, 'g'), {SEP}) AS p FROM src),
        pieces AS (SELECT id, unnest(p) AS p, generate_subscripts(p, 1) AS k FROM marked),
        plain AS (SELECT id, k, replace(p, {FS}, '') AS t, CASE WHEN k % 2 = 0 THEN list_position(list_transform(string_split(p, {FS}), lambda x: x <> ''), true) END AS g FROM pieces),
        placed AS (SELECT id, k, t, g, CAST(sum(octet_length(encode(t))) OVER (PARTITION BY id ORDER BY k) AS BIGINT) AS e FROM plain),
        parts AS (SELECT id, k, t, e - octet_length(encode(t)) AS s, e, CASE WHEN g <> {LUHN_GROUP} OR g = {LUHN_GROUP} AND {_LUHN} THEN {_CATEGORY} END AS category FROM placed),
        spans AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS n, category, s, e, t AS text FROM parts WHERE category IS NOT NULL)"""


def surrogate(category: str, real: str) -> str:
    """The surrogate of a value at its first attempt."""
    draw = lambda n, size: f"(('0x' || substr(md5('0|' || {category} || '|' || {real} || '|0|{n}'), 1, 8))::BIGINT % {size})"
    pick = lambda n, items: f"([{', '.join(repr(x) for x in items)}])[1 + {draw(n, len(items))}]"
    pad = lambda x, n: f"lpad(CAST({x} AS VARCHAR), {n}, '0')"
    forms = {
        "private_email": f"lower({pick(0, T.FORENAMES)}) || '.' || lower({pick(1, T.SURNAMES)}) || {pad(draw(2, 100), 2)} || '@' || {pick(3, T.DOMAINS)}",
        "private_phone": f"'(' || ({draw(0, 800)} + 200) || ') ' || ({draw(1, 800)} + 200) || '-' || {pad(draw(2, 10000), 4)}",
        "private_date": f"({draw(0, 150)} + 1900) || '-' || {pad(f'({draw(1, 12)} + 1)', 2)} || '-' || {pad(f'({draw(2, 28)} + 1)', 2)}",
        "private_url": f"'https://' || {pick(0, T.DOMAINS)} || '/' || {pick(1, T.URL_WORDS)} || '-' || {pick(2, T.URL_WORDS)} || '-' || {pad(draw(3, 100000), 5)}",
        "account_number": f"{pad(draw(0, 100000), 5)} || {pad(draw(1, 100000), 5)}",
        "secret": "'sk-fake-' || " + " || ".join(pick(i, T.ALNUM) for i in range(16)),
    }
    return f"CASE {category} " + " ".join(f"WHEN '{c}' THEN {x}" for c, x in forms.items()) + " END"


DOCS = "SELECT doc_id AS id, text FROM documents"
PAGES = "SELECT page_id AS id, html AS text FROM pages"


def _scan(source: str, key: str = "id") -> str:
    return f"WITH {spans(source)} SELECT id AS {key}, n, category, s, e, text FROM spans"


def _made(name: str) -> str:
    source, key, text = SYNTHETIC[name]
    return f"SELECT CAST({key} AS BIGINT) AS id, {text} AS text FROM {source}"


def _spliced(piece: str, out: str, extra: str = "") -> str:
    return f"WITH {spans(DOCS)} SELECT id AS doc_id, string_agg(CASE WHEN category IS NULL THEN t ELSE {piece} END, '' ORDER BY k) AS {out}{extra} FROM parts GROUP BY id"


#: masked offsets of the pieces that a masked text is made of.
_SEGMENTS = """
        widths AS (SELECT id, s, e, category IS NOT NULL AS sentinel FROM parts WHERE e > s OR category IS NOT NULL),
        -- neighbouring pieces that are no spans are one gap
        runs AS (SELECT *, sum(CAST(sentinel OR before THEN 1 ELSE 0 END AS INT)) OVER (PARTITION BY id ORDER BY s) AS run
                 FROM (SELECT *, coalesce(lag(sentinel) OVER (PARTITION BY id ORDER BY s), true) AS before FROM widths)),
        gaps AS (SELECT id, run, min(s) AS s, max(e) AS e, bool_or(sentinel) AS sentinel FROM runs GROUP BY ALL),
        segments AS (SELECT *, CASE WHEN sentinel THEN 1 ELSE e - s END AS len, CAST(sum(CASE WHEN sentinel THEN 1 ELSE e - s END) OVER (PARTITION BY id ORDER BY s) - CASE WHEN sentinel THEN 1 ELSE e - s END AS BIGINT) AS m FROM gaps),
        sizes AS (SELECT src.id, coalesce(sum(len), 0) AS size FROM src LEFT JOIN segments USING (id) GROUP BY src.id)""".replace("CAST(sentinel OR before THEN 1 ELSE 0 END AS INT)", "CASE WHEN sentinel OR before THEN 1 ELSE 0 END")


def _at(pos: str, end: bool) -> str:
    return f"CASE WHEN g.id IS NULL THEN {pos} WHEN g.sentinel THEN {'g.e' if end else 'g.s'} ELSE g.s + least({pos} - g.m, g.len) END"


_MERGE = """
        ordered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, e DESC, i) AS k FROM todo),
        folded AS (
            SELECT id, k, 1 AS grp, category, s, e, score FROM ordered WHERE k = 1
            UNION ALL
            SELECT o.id, o.k, CASE WHEN hit THEN f.grp ELSE f.grp + 1 END, o.category, CASE WHEN hit THEN f.s ELSE o.s END,
                   CASE WHEN hit THEN greatest(f.e, o.e) ELSE o.e END, CASE WHEN hit AND NOT (o.e - o.s > f.e - f.s) THEN f.score ELSE o.score END
            FROM folded f JOIN ordered o ON o.id = f.id AND o.k = f.k + 1, LATERAL (SELECT o.category = f.category AND o.s < f.e AS hit)),
        merged AS (SELECT id, grp - 1 AS n, arg_max(category, k) AS category, arg_max(s, k) AS s, arg_max(e, k) AS e, arg_max(score, k) AS score FROM folded GROUP BY id, grp)"""

_ORDER_SPANS = """
        raw AS (SELECT DISTINCT l_orderkey AS id, CASE WHEN l_suppkey % 3 = 0 THEN 'secret' ELSE 'private_person' END AS category, l_partkey % 40 AS s,
                       l_partkey % 40 + 1 + l_suppkey % 12 AS e, l_quantity / 64 AS score FROM lineitem),
        todo AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY category, s, e, score) AS i FROM raw)"""

_EVAL = f"""WITH {spans(DOCS)},
        gold AS (
            SELECT id, CASE WHEN (id + n) % 4 <> 0 THEN category END AS category, s + (id % 2) * 6 AS s, s + (id % 2) * 6 + 5 AS e FROM spans
            UNION ALL SELECT id, 'private_person', 0, 4 FROM src),
        hits AS (
            SELECT category, 1 AS gold, CAST(EXISTS (SELECT 1 FROM spans p WHERE p.id = g.id AND p.category = g.category AND p.s < g.e AND g.s < p.e) AS INT) AS matched, 0 AS good, 0 AS fp
            FROM gold g WHERE category IS NOT NULL
            UNION ALL
            SELECT category, 0, 0, CAST(good AS INT), CAST(NOT good AND NOT spared AS INT) FROM (
                SELECT category, EXISTS (SELECT 1 FROM gold g WHERE g.id = p.id AND g.category = p.category AND p.s < g.e AND g.s < p.e) AS good,
                       EXISTS (SELECT 1 FROM gold g WHERE g.id = p.id AND g.category IS NULL AND p.s < g.e AND g.s < p.e) AS spared FROM spans p)),
        sums AS (SELECT coalesce(category, 'OVERALL') AS category, CAST(sum(gold) AS BIGINT) AS gold, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(good) AS BIGINT) AS good, CAST(sum(fp) AS BIGINT) AS fp FROM hits GROUP BY ROLLUP (category)),
        rates AS (SELECT *, CASE WHEN good + fp > 0 THEN good / (good + fp) END AS p, CASE WHEN gold > 0 THEN matched / gold END AS r FROM sums),
        scores AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END AS f FROM rates)"""

_TOKENS = """
        lines AS (SELECT l_orderkey AS id, l_linenumber AS k, max(l_partkey) AS p, max(l_suppkey) AS q, CAST(max(l_quantity) AS BIGINT) AS r FROM lineitem GROUP BY ALL),
        tokens AS (SELECT id, k, CASE WHEN q % 5 = 0 THEN 0 ELSE 3 END AS size, [p % 4, q % 4, r % 4, (p + r) % 3] AS x FROM lines),
        offsets AS (SELECT *, CAST(sum(size) OVER (PARTITION BY id ORDER BY k) AS BIGINT) AS e, list_max(x) AS top FROM tokens),
        best AS (SELECT id, k, e - size AS s, e, 1 / list_sum(list_transform(x, lambda v: exp(CAST(v - top AS DOUBLE)))) AS prob,
                 CASE WHEN size > 0 THEN CASE list_position(x, top) WHEN 2 THEN 'secret' WHEN 3 THEN 'private_person' WHEN 4 THEN 'private_person' END END AS category FROM offsets),
        edges AS (SELECT *, CASE WHEN category IS NOT NULL AND category IS NOT DISTINCT FROM lag(category) OVER (PARTITION BY id ORDER BY k) THEN 0 ELSE 1 END AS new FROM best),
        islands AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY k) AS island FROM edges),
        found AS (SELECT id, category, min(s) + 1 AS s, max(e) AS e, CAST(avg(prob) AS FLOAT) AS score FROM islands WHERE category IS NOT NULL GROUP BY id, island, category)"""


def _decoded(least: str) -> str:
    return f"""WITH {_TOKENS}, kept AS (SELECT * FROM found WHERE score >= {least})
        SELECT id AS doc_id, row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS n, category, s, e,
               substr(repeat(' ab', 10), CAST(1 + s % 3 AS INT), CAST(e - s AS INT)) AS text, round(CAST(score AS DOUBLE), 4) AS score FROM kept"""


def _vault(source: str = DOCS, name: str = "vault", rest: str = "") -> str:
    return f"{name} AS (SELECT row_number() OVER (ORDER BY f.a, f.b, category, text) - 1 AS seq, category, text AS real FROM (SELECT category, text, min({{'a': id, 'b': s}}) AS f FROM spans{rest} GROUP BY ALL))"


_NUMBERED = "row_number() OVER (ORDER BY doc_id) - 1"
_FIRST_SEEN = f"WITH {spans(DOCS)}, {_vault()}"
_UNESCAPED = r"array_to_string(list_transform(string_split(t, chr(92) || chr(92)), lambda x: replace(replace(replace(x, chr(92) || 'n', chr(10)), chr(92) || 'r', chr(13)), chr(92) || 't', chr(9))), chr(92))"

ORACLES: dict[str, str] = {
    "pii_scan": _scan(DOCS, "doc_id"),
    "pii_counts_by_category": f"WITH {spans(DOCS)} SELECT category, count(*) AS n_spans, count(DISTINCT id) AS n_docs, CAST(sum(e - s) AS BIGINT) AS n_bytes FROM spans GROUP BY category",
    "pii_pages_scan": _scan(PAGES),
    "luhn_cards": _scan(_made("cards")),
    "secret_patterns": _scan(_made("secrets")),
    "iban_ssn": _scan(_made("accounts")),
    "date_phone_variants": _scan(_made("contacts")),
    "redact_label": _spliced("'[' || upper(category) || ']'", "redacted"),
    "redact_block": _spliced("repeat('█', length(t))", "redacted"),
    "redact_char": _spliced("repeat('*', length(t))", "redacted"),
    "mask_reduction": f"""WITH {spans(DOCS)}
        SELECT CAST(sum(e - s) AS BIGINT) AS bytes_full, CAST(sum(CASE WHEN category IS NULL THEN e - s ELSE 1 END) AS BIGINT) AS bytes_masked,
               round((1 - sum(CASE WHEN category IS NULL THEN e - s ELSE 1 END) / sum(e - s)) * 100, 4) AS saved_percent FROM parts""",
    "mask_remap": f"""WITH {spans(DOCS)}, {_SEGMENTS},
        asked AS (SELECT id, k, CAST(floor(size * k / 39) AS BIGINT) AS pos FROM sizes, range(40) AS t(k))
        SELECT a.id AS doc_id, k, pos, {_at('pos', False)} AS at_start, {_at('pos', True)} AS at_end
        FROM asked a ASOF LEFT JOIN segments g ON a.id = g.id AND a.pos >= g.m""",
    "merge_overlapping": f"""WITH RECURSIVE {_ORDER_SPANS}, {_MERGE}
        SELECT id, n, category, s, e, substr(repeat('abcdefghij', 6), CAST(s + 1 AS INT), CAST(e - s AS INT)) AS text, score FROM merged""",
    "combine_anti": f"""WITH RECURSIVE {spans(DOCS)}, {_SEGMENTS},
        asked AS (SELECT id, p * 200 AS a, p * 200 + 5 + p % 3 * 20 AS b FROM sizes, range(1000) AS t(p) WHERE p * 200 + 5 + p % 3 * 20 <= size),
        one AS (SELECT q.id, q.a, q.b, {_at('q.a', False)} AS s FROM asked q ASOF LEFT JOIN segments g ON q.id = g.id AND q.a >= g.m),
        two AS (SELECT q.id, q.s, {_at('q.b', True)} AS e FROM one q ASOF LEFT JOIN segments g ON q.id = g.id AND q.b >= g.m),
        bytes AS (SELECT id, encode(text) AS d FROM src),
        ends AS (SELECT t.*, hex(d) AS h, octet_length(d) AS size FROM two t JOIN bytes USING (id)),
        whole AS (SELECT id, s, e FROM ends WHERE s < e AND e <= size AND NOT substr(h, CAST(2 * s + 1 AS INT), 1) IN ('8', '9', 'A', 'B') AND (e = size OR NOT substr(h, CAST(2 * e + 1 AS INT), 1) IN ('8', '9', 'A', 'B'))),
        todo AS (
            SELECT id, category, s, e, 1.0 AS score, n AS i FROM spans
            UNION ALL SELECT id, 'private_person', s, e, 0.5, 1000000 + s FROM whole w WHERE NOT EXISTS (SELECT 1 FROM spans r WHERE r.id = w.id AND r.s < w.e AND w.s < r.e)), {_MERGE}
        SELECT id AS doc_id, n, category, s, e FROM merged""",
    "vault_first_seen": f"{_FIRST_SEEN} SELECT * FROM vault",
    "anonymize_documents": _spliced(surrogate("category", "t"), "anonymized", ", count(category) AS n_placements"),
    "anonymize_subs": f"WITH {spans(DOCS)} SELECT id AS doc_id, n, text AS real, {surrogate('category', 'text')} AS fake FROM spans",
    "deanonymize_roundtrip": "SELECT doc_id, md5(text) AS restored_md5 FROM documents",
    "restore_plan": f"WITH {spans(DOCS)} SELECT src.id AS doc_id, count(DISTINCT category || spans.text) AS n_entries FROM src LEFT JOIN spans USING (id) GROUP BY src.id",
    "restore_longest_prefix": """WITH t AS (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT 'fk' || l_partkey || 'é fkfk' || l_suppkey)), ' ') AS a FROM lineitem GROUP BY 1)
        SELECT l_orderkey, regexp_replace(a, 'fk(1500|1[0-4][0-9]{2}|[1-9][0-9]{2}|[1-9][0-9]|[1-9])', 'R\\1!', 'g') AS restored FROM t""",
    "vault_cap": f"{_FIRST_SEEN} SELECT *, CASE WHEN seq > (SELECT max(seq) FROM vault) - 10 THEN 'kept' ELSE 'gone' END AS state FROM vault",
    "vault_resume": f"""WITH one AS (WITH {spans(PAGES)}, {_vault()} SELECT * FROM vault),
        two AS (WITH {spans(DOCS)}, {_vault(rest=" WHERE (category, text) NOT IN (SELECT (category, real) FROM one)")} SELECT * FROM vault)
        SELECT * FROM one UNION ALL SELECT seq + (SELECT count(*) FROM one), category, real FROM two""",
    "vault_export": f"""{_FIRST_SEEN}, f AS (SELECT *, {surrogate('category', 'real')} AS fake FROM vault)
        SELECT seq AS ord, '  {{' || chr(10) || '    "category": "' || category || '",' || chr(10) || '    "real": "' || real || '",' || chr(10) || '    "fake": "' || fake || '"' || chr(10)
               || CASE WHEN seq = (SELECT max(seq) FROM f) THEN '  }}' ELSE '  }},' END AS line FROM f UNION ALL SELECT -1, '[' UNION ALL SELECT 4611686018427387904, ']'""",
    "eval_counts": f"{_EVAL} SELECT category, gold, matched, good, fp, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1 FROM scores",
    "eval_table": f"""{_EVAL}, shown AS (SELECT *, list_position(['account_number', 'private_address', 'private_date', 'private_email', 'private_person', 'private_phone', 'private_url', 'secret', 'OVERALL'], category) - 1 AS ord FROM scores)
        SELECT CAST(ord AS BIGINT) AS ord, printf('%-16s %6d %7d %4d %9s %7s %6s', category, gold, matched, fp, coalesce(printf('%.1f%%', p * 100), '  -  '), coalesce(printf('%.1f%%', r * 100), '  -  '), coalesce(printf('%.1f%%', f * 100), '  -  ')) AS line FROM shown""",
    "token_windows": r"""WITH t AS (SELECT doc_id, len(string_split_regex(text, '\s+')) AS n FROM documents),
        w AS (SELECT doc_id, n, k AS win, k * 896 AS tok_start, least(k * 896 + 1024, n) AS tok_end FROM t, range(0, 1000) AS r(k) WHERE k = 0 OR (k - 1) * 896 + 1024 < n)
        SELECT doc_id, CAST(win AS BIGINT) AS win, CAST(tok_start AS BIGINT) AS tok_start, CAST(tok_end AS BIGINT) AS tok_end,
               CAST(greatest(1, least(16, 4096 // (tok_end - tok_start))) AS BIGINT) AS batch_rows,
               CAST(CASE WHEN tok_end - tok_start <= 64 THEN 64 WHEN tok_end - tok_start <= 128 THEN 128 WHEN tok_end - tok_start <= 256 THEN 256 WHEN tok_end - tok_start <= 512 THEN 512 ELSE 1024 END AS BIGINT) AS padded FROM w""",
    "decode_spans": _decoded("0"),
    "min_score_filter": _decoded("CAST(0.4321 AS FLOAT)"),
    "tsv_unescape": f"SELECT o_orderkey, md5({_UNESCAPED}) AS plain_md5, md5(replace(t, chr(92), chr(92) || chr(92))) AS escaped_md5 FROM (SELECT o_orderkey, {ESCAPED} AS t FROM orders)",
    "char_to_byte": """SELECT doc_id, CAST(100 * k AS BIGINT) AS at, octet_length(encode(text[1:100 * k])) AS byte
        FROM documents, LATERAL (SELECT unnest(range(0, length(text) // 100 + 1)) AS k) WHERE text IS NOT NULL""",
    "json_string_leaves": """SELECT event_id, 'messages/0/kind' AS path, event_type AS value, true AS content FROM events
        UNION ALL SELECT event_id, 'id', 'e' || event_id, false FROM events""",
    "json_write_back": """SELECT event_id, '{"messages":[{"kind":"' || upper(event_type) || '","value":' || CAST(trunc(value) AS BIGINT) || '}]}' AS j FROM events""",
    "prose_filter": r"""SELECT doc_id, length(text) >= 12 AND regexp_matches(text, '\s') AND NOT regexp_full_match(text, '[A-Za-z0-9_\-./:]+') AND NOT regexp_full_match(text, '(?i)[0-9a-f-]{8,}') AS prose,
        trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' AS blank FROM documents""",
    "scan_report": f"""WITH {spans(DOCS)}, l AS (SELECT id, string_agg(category || ' [' || s || '..' || e || '] score=1.000 ' || text, chr(10) ORDER BY n) AS report FROM spans GROUP BY id)
        SELECT src.id AS doc_id, coalesce(report, 'no PII detected') AS report FROM src LEFT JOIN l USING (id)""",
    "jsonl_reframe": f"""WITH r AS ({_spliced("'[' || upper(category) || ']'", "redacted")})
        SELECT doc_id, '{{"doc":' || doc_id || ',"text":' || to_json(redacted) || ',"z":1.5}}' AS line FROM r""",
    "source_lines": f"SELECT {_NUMBERED} AS id, md5(text) AS text_md5 FROM documents",
    "source_jsonl": f"SELECT {_NUMBERED} AS id, md5(text) AS text_md5, doc_id FROM documents",
    "source_tsv": "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS id, c_name AS text FROM customer",
    "source_delimited": "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS id, c_name AS text FROM customer UNION ALL SELECT (SELECT count(*) FROM customer), ''",
    "source_files": "SELECT 'r' || n_regionkey || '/' || n_name || '.txt' AS id, n_name || chr(10) || 'line é' AS text FROM nation",
    "labelled_corpus": f"""WITH {spans(DOCS)} SELECT coalesce(category, 'OVERALL') AS category, count(*) AS gold, count(*) AS matched, count(*) AS good, CAST(0 AS BIGINT) AS fp FROM spans GROUP BY ROLLUP (category)""",
    "conversation_anonymize": f"""WITH {spans(f"SELECT conv_id * 1000 + turn AS id, {MAIL} AS text FROM conversations")}
        SELECT id // 1000 AS conv_id, id % 1000 AS turn, string_agg(CASE WHEN category IS NULL THEN t ELSE {surrogate('category', 't')} END, '' ORDER BY k) AS anonymized FROM parts GROUP BY id""",
    "stream_restore": """WITH t AS (SELECT CAST(o_custkey AS VARCHAR) AS stream_id, string_agg('pay sk-fake-' || o_orderkey % 250 || ' now; ', '' ORDER BY o_orderkey) AS a FROM orders GROUP BY 1)
        SELECT stream_id, regexp_replace(a, 'sk-fake-(1[0-9]{2}|[1-9][0-9]|[0-9])', 'KEY\\1', 'g') AS restored FROM t""",
}
for _kind in ("ooxml", "pdf"):
    _mail, _date = "'s' || s_suppkey || '@shop.example.com'", "'2020-01-' || lpad(CAST(1 + s_suppkey % 28 AS VARCHAR), 2, '0')"
    ORACLES[f"{_kind}_rewrite"] = f"""SELECT 's' || s_suppkey || '.{'docx' if _kind == 'ooxml' else 'pdf'}' AS path,
        'Write to ' || {surrogate("'private_email'", _mail)} || ' on ' || {surrogate("'private_date'", _date)} || '.' AS text, CAST(2 AS BIGINT) AS n_placements FROM supplier"""
ORACLES["stream_vault"] = ORACLES["conversation_anonymize"].replace("AS anonymized FROM", "AS anonymized, 'anonymized' AS outcome FROM")
ORACLES["stream_outcomes"] = "SELECT 'anonymize' AS op, 'anonymized' AS outcome, count(*) AS n FROM conversations"
