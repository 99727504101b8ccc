"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op8_decontamination": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        i AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS g
            FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(k) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM windows),
        grams AS (
            SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS g
            FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(k) WHERE len(w) >= n),
        hits AS (SELECT r, k, n, item_id FROM grams JOIN windows USING (n, g)),
        hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(k, k + n)) AS t(p) GROUP BY r),
        found AS (
            SELECT r, count(DISTINCT item_id) AS n_items,
                   list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN found USING (r)""",
    "op5_warc": r"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
        b AS (
            SELECT page_id, octet_length(encode(payload)) AS payload_bytes,
                   array_to_string(list_transform(range(0, 32), lambda k:
                       substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                              1 + (('0x' || substr(hex, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) % 32, 1)), '')
                   AS payload_digest
            FROM p),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM b)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to
        FROM g""",
    # From the definition: whole conversations as lists, pairs by question, the first turn in which two lists differ.
    "op7_preference_format": r"""
        WITH t AS (
            SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
        c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS x FROM t GROUP BY conv_id),
        p AS (SELECT *, list_filter(range(1, len(x) + 1), lambda i: x[i].role = 'assistant') AS spots FROM c),
        s AS (
            SELECT conv_id, x[1:spots[len(spots)]] AS x, x[1:spots[1] - 1] AS q, x[spots[1]].text AS reply, len(spots) AS n,
                   list_sum(list_transform(spots, lambda i: length(x[i].text))) AS size
            FROM p WHERE len(spots) > 0),
        k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY conv_id) - 1 AS k FROM s WHERE len(q) > 0),
        m AS (
            SELECT a.conv_id AS a, b.conv_id AS b, a.size >= b.size AS fuller FROM k a JOIN k b
            ON a.q = b.q AND a.k % 2 = 0 AND b.k = a.k + 1),
        pairs AS (
            SELECT a.conv_id, b.conv_id AS other_id, a.x AS c, b.x AS r
            FROM m JOIN s a ON a.conv_id = CASE WHEN fuller THEN m.a ELSE m.b END JOIN s b ON b.conv_id = CASE WHEN fuller THEN m.b ELSE m.a END
            UNION ALL
            SELECT conv_id, NULL, x, x[1:len(x) - 1] || [{'role': 'assistant', 'text': CASE WHEN n > 1 THEN reply ELSE '' END}]
            FROM s WHERE conv_id NOT IN (SELECT a FROM m UNION ALL SELECT b FROM m)),
        d AS (
            SELECT *, coalesce(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] <> r[i])[1] - 1, least(len(c), len(r))) AS n FROM pairs),
        marked AS (
            SELECT conv_id, other_id, n,
                   list_transform(c, lambda x: {'trained': x.role = 'assistant', 'head': '<|im_start|>' || replace(x.role, '<|', '< |') || chr(10), 'body': replace(x.text, '<|', '< |') || '<|im_end|>'}) AS c,
                   list_transform(r, lambda x: {'trained': x.role = 'assistant', 'head': '<|im_start|>' || replace(x.role, '<|', '< |') || chr(10), 'body': replace(x.text, '<|', '< |') || '<|im_end|>'}) AS r
            FROM d),
        parts AS (SELECT conv_id, other_id, n, c[1:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM marked)
        SELECT conv_id, CAST(other_id AS BIGINT) AS other_id, CAST(n AS INT) AS n_common,
               array_to_string(list_transform(p, lambda x: x.head || x.body || chr(10)), '') AS prompt,
               array_to_string(list_transform(c, lambda x: x.head || x.body || chr(10)), '') AS chosen,
               array_to_string(list_transform(r, lambda x: x.head || x.body || chr(10)), '') AS rejected,
               array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].trained), lambda i:
                   (coalesce(list_sum(list_transform(c[1:i - 1], lambda x: length(x.head) + length(x.body) + 1)), 0) + length(c[i].head)) || ':' ||
                   (coalesce(list_sum(list_transform(c[1:i - 1], lambda x: length(x.head) + length(x.body) + 1)), 0) + length(c[i].head) + length(c[i].body))), ' ') AS chosen_spans,
               array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].trained), lambda i:
                   (coalesce(list_sum(list_transform(r[1:i - 1], lambda x: length(x.head) + length(x.body) + 1)), 0) + length(r[i].head)) || ':' ||
                   (coalesce(list_sum(list_transform(r[1:i - 1], lambda x: length(x.head) + length(x.body) + 1)), 0) + length(r[i].head) + length(r[i].body))), ' ') AS rejected_spans
        FROM parts""",
}
