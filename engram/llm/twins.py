"""DuckDB SQL that gives the rows of the registered queries of this subpackage."""

from __future__ import annotations

OP1 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS total FROM sized GROUP BY source
), weighed AS (
  SELECT source, total, total * 2.0::DOUBLE AS bound,
         ([3, 1, 2])[1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM totals
), filled AS (
  SELECT *, row_number() OVER o AS place,
         sum(total) OVER ()::DOUBLE * 1.5 - coalesce(sum(bound) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
         sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open
  FROM weighed WINDOW o AS (ORDER BY bound / weight, encode(source) NULLS LAST)
), judged AS (
  SELECT *, bound * open <= left_over * weight AS is_full FROM filled
), level AS (
  SELECT arg_min(left_over / open, place) AS level FROM judged WHERE NOT is_full
), aims AS (
  SELECT source, total, CASE WHEN is_full THEN bound ELSE level * weight END AS target FROM judged CROSS JOIN level
), ordered AS (
  SELECT s.*, a.total, a.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead,
         CASE WHEN a.total > 0 THEN floor(a.target)::BIGINT // a.total ELSE 0 END AS whole
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, total AS source_size, target,
       (whole * size + greatest(0, least(size, floor(target)::BIGINT - whole * total - ahead)))::BIGINT AS taken
FROM ordered
"""

OP3 = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM split
), tokens AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM sets
  UNION
  SELECT reach.x, pairs.y FROM reach JOIN pairs ON reach.y = pairs.x
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.component_id
FROM sets s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = s.doc_id
"""

OP8 = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, len(w) AS n,
         unnest(list_transform(range(1, len(w) + 1), lambda i: array_to_string(w[i:i + 12], ' '))) AS win
  FROM split
), judged AS (
  SELECT doc_id, i, word, i + 12 <= n AND min(doc_id) FILTER (WHERE i + 12 <= n) OVER (PARTITION BY win, i + 12 <= n) < doc_id AS again
  FROM places
), covered AS (
  SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM judged
), kept AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
  FROM covered GROUP BY doc_id
)
SELECT s.doc_id, len(s.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id
"""

OP2 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), formed AS (
  SELECT *, 36 - 3 + length(regexp_replace(role, '([<\[])(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\2\\\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\2\\\3', 'g')) - 1 AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM formed GROUP BY conv_id
"""

OP10 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM g
"""

OP9 = r"""
WITH split AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), places AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, len(w) AS n, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i:i + 7])) AS win FROM split
), twice AS (
  SELECT doc_id, i, i + 7 <= n AND count(*) FILTER (WHERE i + 7 <= n) OVER (PARTITION BY doc_id, win) > 1 AS again FROM places
), covered AS (
  SELECT doc_id, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM twice
), repeats AS (
  SELECT doc_id, count(*) FILTER (WHERE c) AS r FROM covered GROUP BY doc_id
), counts AS (
  SELECT s.doc_id, s.lang, s.source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         len(l) AS n_lines, coalesce(r.r, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN repeats r ON r.doc_id = s.doc_id
), rated AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         n_symbols / greatest(word_chars, 1) AS symbol_share, n_dup_lines / greatest(n_lines, 1) AS dup_line_share,
         n_repeat_words / greatest(n_words, 1) AS repeat_share, word_chars / greatest(n_words, 1) AS mean_word
  FROM counts
), quartiles AS (
  SELECT lang, source, count(*) AS n, quantile_disc(symbol_share, [0.25, 0.75]) AS a, quantile_disc(dup_line_share, [0.25, 0.75]) AS b,
         quantile_disc(repeat_share, [0.25, 0.75]) AS c, quantile_disc(mean_word, [0.25, 0.75]) AS d
  FROM rated WHERE NOT base_failed GROUP BY GROUPING SETS ((lang, source), (lang))
), bounds AS (
  SELECT g.lang, g.source, CASE WHEN g.n >= 30 THEN g.a ELSE w.a END AS a, CASE WHEN g.n >= 30 THEN g.b ELSE w.b END AS b,
         CASE WHEN g.n >= 30 THEN g.c ELSE w.c END AS c, CASE WHEN g.n >= 30 THEN g.d ELSE w.d END AS d
  FROM quartiles g JOIN quartiles w ON g.lang = w.lang AND w.source IS NULL WHERE g.source IS NOT NULL
)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(symbol_share > a[2] + 3 * (a[2] - a[1]) + 0.1 OR dup_line_share > b[2] + 3 * (b[2] - b[1]) + 0.3
         OR repeat_share > c[2] + 3 * (c[2] - c[1]) + 0.15 OR mean_word > d[2] + 3 * (d[2] - d[1]) + 3 OR mean_word < d[1] - 3 * (d[2] - d[1]) - 3, false) AS kept
FROM rated r LEFT JOIN bounds b ON r.lang = b.lang AND r.source = b.source
"""

OP13 = r"""
WITH terms AS (
  SELECT row_number() OVER () AS row_key, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), totals AS (
  SELECT count(*) FILTER (WHERE len(t) > 0)::BIGINT AS docs, sum(len(t))::BIGINT AS total FROM terms
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), counted AS (
  SELECT row_key, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT row_key, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM terms) GROUP BY ALL
), weighed AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM counted, totals WHERE term IN (SELECT term FROM asked) GROUP BY term, docs
), scored AS (
  SELECT item_id, row_key, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::BIGINT AS score
  FROM counted JOIN weighed USING (term) JOIN asked USING (term), totals GROUP BY item_id, row_key, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

TWINS = {
    "op1_mix_sources": OP1, "op2_chat_format": OP2, "op3_jaccard_join": OP3, "op8_substring_dedup": OP8,
    "op9_quality_rules": OP9, "op10_warc_revisits": OP10, "op13_ranked_search": OP13,
}
