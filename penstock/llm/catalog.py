"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations


from penstock.llm import (
    op1_ann, op2_chat_format, op3_suffix_dedup, op4_quality, op5_mixing, op6_decontaminate, op7_pii, op8_line_dedup, op9_sharding, op10_jaccard_join,
    op11_hard_negatives, op12_language_id, op13_prefix_trie,
)

QUERIES = {
    "op1_ann": op1_ann.digest,
    "op2_chat_format": op2_chat_format.digest,
    "op3_suffix_dedup": op3_suffix_dedup.digest,
    "op4_quality": op4_quality.digest,
    "op5_mixing": op5_mixing.digest,
    "op6_decontaminate": op6_decontaminate.digest,
    "op7_pii": op7_pii.digest,
    "op8_line_dedup": op8_line_dedup.digest,
    "op8_passage_dedup": op8_line_dedup.passages,
    "op9_sharding": op9_sharding.digest,
    "op10_jaccard_join": op10_jaccard_join.digest,
    "op11_hard_negatives": op11_hard_negatives.digest,
    "op12_language_id": op12_language_id.digest,
    "op13_prefix_trie": op13_prefix_trie.digest,
}

ORACLES: dict[str, str] = {
    "op11_hard_negatives": op11_hard_negatives.ORACLE,
    "op3_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 99)) AS p, h FROM d WHERE length(h) >= 200),
        k AS (SELECT doc_id, p, md5_number(h[2 * p + 1:2 * p + 200]) AS s FROM w),
        r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 AS again FROM k),
        o AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM r WHERE again),
        g AS (SELECT doc_id, p, sum((q IS NULL OR p > q + 100)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM o),
        s AS (SELECT doc_id, span, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY doc_id, span),
        e AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS c,
                     row_number() OVER (PARTITION BY doc_id ORDER BY a) AS i FROM s),
        kept AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
                        string_agg(CASE WHEN i = 1 THEN h[1:2 * a] ELSE '' END
                                   || CASE WHEN c IS NULL THEN h[2 * b + 1:] ELSE h[2 * b + 1:2 * c] END, '' ORDER BY a) AS k
                 FROM e JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(k, h))) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op10_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
        u AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM l),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM u x JOIN u y ON x.s = y.s AND x.doc_id <> y.doc_id
              GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
        r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
        SELECT r.a AS doc_id, len(any_value(l.s))::BIGINT AS n_shingles, min(r.b) AS component_id
        FROM r JOIN l ON l.doc_id = r.a GROUP BY r.a
    """,
    "op2_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        m AS (SELECT *, replace(text, '\', '\b') AS t0,
                     CASE role WHEN 'system' THEN 5 + 6 WHEN 'user' THEN 6 + 7 WHEN 'assistant' THEN 6 + 7 ELSE 7 + 4 + 8 + length(role) END AS marks FROM c),
        e AS (SELECT *, replace(replace(replace(replace(replace(t0, '<s>', '\0'), '</s>', '\1'), '<other>', '\2'), '<is>', '\3'), '</other>', '\4') AS t1 FROM m),
        f AS (SELECT *, replace(replace(replace(replace(replace(replace(t1, '<sys>', '\5'), '</sys>', '\6'), '[INST]', '\7'), '[/INST]', '\8'),
                                        '<asst>', '\9'), '</asst>', '\a') AS t2 FROM e)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               (3 + 4 + sum(marks + length(t2)))::BIGINT AS formatted_chars
        FROM f GROUP BY conv_id
    """,
    "op5_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                          ('0x' || substr(md5('mix-1:' || doc_id || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS h FROM documents),
        s AS (SELECT source, sum(size)::DOUBLE AS n, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS i FROM d GROUP BY source),
        w AS (SELECT *, [5.0, 2.0, 1.0][i % 3 + 1]::DOUBLE AS w, 2 * n AS cap FROM s),
        l AS (SELECT *, (1.5::DOUBLE * sum(n) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM w
              WINDOW b AS (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT arg_min(level, cap / w) AS final FROM l WHERE level * w <= cap),
        t AS (SELECT source, n, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * w) END AS target FROM l, f),
        c AS (SELECT d.*, n, target, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS copies FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        r AS (SELECT *, target - copies * n AS rest, sum(size) OVER (PARTITION BY source, h) AS here,
                     sum(size) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto FROM c)
        SELECT doc_id, size, n::BIGINT AS source_size, target,
               (size * CASE WHEN target >= 2 * n THEN 2
                            ELSE copies + (upto <= rest OR upto - here <= rest AND 2 * (rest - upto + here) >= here)::INT END)::BIGINT AS taken FROM r
    """,
    "op8_line_dedup": r"""
        WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\n]+\n*|\n+') AS l FROM documents),
        b AS (SELECT *, list_transform(l, lambda x: trim(x, chr(32) || chr(9) || chr(13) || chr(10))) AS b FROM l),
        w AS (SELECT doc_id, unnest(range(1, len(b) - 1)) AS p, b FROM b WHERE len(b) >= 3),
        r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY b[p:p + 2] ORDER BY doc_id, p) > 1 AS again FROM w),
        c AS (SELECT DISTINCT doc_id, p + k AS i FROM r, (SELECT unnest(range(3)) AS k) WHERE again),
        e AS (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM l),
        k AS (SELECT e.*, c.i IS NOT NULL AS gone FROM e LEFT JOIN c USING (doc_id, i)),
        g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM k),
        s AS (SELECT doc_id, sum(gone::INT) AS n_removed, sum(starts::INT) AS n_runs,
                     coalesce(string_agg(x, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM g GROUP BY doc_id)
        SELECT doc_id, len(l)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
               sha256(coalesce(kept, '')) AS kept_sha256 FROM l LEFT JOIN s USING (doc_id)
    """,
    "op8_passage_dedup": r"""
        WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\n]+\n*|\n+') AS l FROM documents),
        b AS (SELECT *, list_transform(l, lambda x: trim(x, chr(32) || chr(9) || chr(13) || chr(10))) AS b FROM l),
        o AS (SELECT doc_id, unnest(range(1, len(b) + 1)) AS p, b, list_transform(b, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS n FROM b),
        w AS (SELECT doc_id, p, m, b[p:p + m - 1] AS s FROM o, (SELECT unnest([1, 2, 3]) AS m)
              WHERE p + m - 1 <= len(b) AND (m = 3 OR list_sum(n[p:p + m - 1]) >= 50)),
        r AS (SELECT doc_id, p, m, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 AS again FROM w),
        c AS (SELECT DISTINCT doc_id, p + k AS i FROM r, (SELECT unnest(range(3)) AS k) WHERE again AND k < m),
        e AS (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM l),
        k AS (SELECT e.*, c.i IS NOT NULL AS gone FROM e LEFT JOIN c USING (doc_id, i)),
        g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM k),
        s AS (SELECT doc_id, sum(gone::INT) AS n_removed, sum(starts::INT) AS n_runs,
                     coalesce(string_agg(x, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM g GROUP BY doc_id)
        SELECT doc_id, len(l)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
               sha256(coalesce(kept, '')) AS kept_sha256 FROM l LEFT JOIN s USING (doc_id)
    """,
}
