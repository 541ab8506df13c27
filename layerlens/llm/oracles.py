"""DuckDB SQL of the queries that SQL can express, over the whole tables."""

from __future__ import annotations

from layerlens.llm.quality import BOILERPLATE

W = r"[^\x20\x09-\x0D]+"

_PHRASES = " OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE)

OP1 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{W}') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1
), covered AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 4)) AS p FROM twice) GROUP BY doc_id
), line AS (
  SELECT doc_id, l, lower(l) AS low, regexp_extract_all(l, '{W}') AS w, regexp_extract_all(lower(l), '{W}') AS lw
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{W}')
), judged AS (
  SELECT doc_id, l, list_sum(list_transform(w, lambda x: len(x))) AS chars,
    len(regexp_extract_all(l, '[#*$%&|<>]')) * 100 > len(w) * 30
    OR (len(w) >= 3 AND len(regexp_extract_all(l, '\p{{Lu}}{{2,}}')) * 100 > len(w) * 50)
    OR (len(list_filter(w, lambda x: x IN ('|', '>', '»', '•', '·'))) >= 1
        AND len(list_filter(w, lambda x: x IN ('|', '>', '»', '•', '·'))) * 100 > len(w) * 20)
    OR {_PHRASES}
    OR (len(w) >= 12 AND len(list_distinct(lw)) * 100 < len(w) * 25)
    OR (len(w) >= 8 AND 100 * len(list_filter(generate_series(2, len(lw)),
        lambda i: lw[i] = lw[i-1] AND len(lw[i]) <= 40 AND (i = 2 OR lw[i-1] <> lw[i-2]))) > len(w) * 20) AS bad
  FROM line
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup, count(*) FILTER (bad) AS n_bad,
    coalesce(sum(chars) FILTER (NOT bad), 0) AS chars_left
  FROM judged GROUP BY doc_id
), base AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, coalesce(n_bad, 0) AS n_bad_lines, coalesce(chars_left, 0)::BIGINT AS chars_left
  FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN lines USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, n_bad_lines,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND (word_chars - chars_left) * 100 <= word_chars * 30 AS kept
FROM base
"""

OP5 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{W}') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM win) WHERE m < doc_id
), gone AS (
  SELECT doc_id, list(p) AS gone FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM hit) GROUP BY doc_id
), word AS (
  SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d
), stay AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept
  FROM word LEFT JOIN gone USING (doc_id) WHERE gone IS NULL OR NOT list_contains(gone, p) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN stay USING (doc_id)
"""

OP8 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{W}') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)
), both_ways AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT DISTINCT a AS doc_id, a AS r FROM both_ways
  UNION
  SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a
), comp AS (
  SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""

_PROBE = "'\\### Assistant: </turn> ok'"

OP10 = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_PROBE} UNION ALL SELECT -7, 1, 'assistant', {_PROBE}
), o AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
    row_number() OVER w AS nth, count(*) OVER (PARTITION BY conv_id) AS n
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), t AS (
  SELECT *, CASE WHEN nth = 1 THEN role IN ('system', 'user')
      WHEN before IN ('system', 'assistant') THEN role = 'user'
      WHEN before = 'user' THEN role = 'assistant' ELSE false END
    AND (nth < n OR role = 'assistant') AS fits,
    len(text) + len(regexp_extract_all(text, '[\\#<]')) + len(role) + len(regexp_extract_all(role, '[\\#<:\n]')) + 14 AS chars
  FROM o
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, bool_and(fits) AS valid
FROM t GROUP BY conv_id
"""

# CRC-32 byte by byte, over a table that the rule of its polynomial gives
OP11 = r"""
WITH RECURSIVE tab AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
    FROM (SELECT unnest(range(256)) AS i)
  )
), w AS (
  SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS nth, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
  UNION ALL
  SELECT 'b', item_id, row_number() OVER (), regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark
), f AS (
  SELECT side, nth, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w
), counted AS (
  SELECT side, nth, f, count(*) AS n FROM f GROUP BY ALL
), bytes AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)
), crc AS (
  SELECT f, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT)),
    lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), 4294967295), 4294967295) % 10000 AS bucket
  FROM bytes, tab
), total AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t
  FROM counted JOIN crc USING (f) GROUP BY bucket
), all_of AS (
  SELECT coalesce(sum(s), 0) AS bs, coalesce(sum(t), 0) AS bt FROM total
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (bs + 10000))::DOUBLE / ((s + 1) * (bt + 10000))::DOUBLE))::BIGINT AS g FROM total, all_of
), mass AS (
  SELECT nth, sum(n) AS n, sum(n * g) AS m FROM counted JOIN crc USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY nth
), known AS (
  SELECT id AS doc_id, nth, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features,
    coalesce(floor(m::DOUBLE / n::DOUBLE), 0)::BIGINT AS weight,
    ('0x' || sha256('7:' || coalesce(id::VARCHAR, ''))[1:8])::BIGINT AS h
  FROM w LEFT JOIN mass USING (nth) WHERE side = 'd'
), scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM known
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS r,
    count(*) FILTER (n_words >= 20) OVER () AS big_n FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_words >= 20 AND r <= big_n * 25 // 100 THEN r END AS rank
FROM ranked
"""

OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
    list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * r.q[i]))::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

ORACLES = {
    "op1_quality_rules": OP1,
    "op5_substring_dedup": OP5,
    "op8_jaccard_join": OP8,
    "op10_chat_format": OP10,
    "op11_importance": OP11,
    "op13_hard_negatives": OP13,
}
