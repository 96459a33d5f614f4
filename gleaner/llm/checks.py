"""Check SQL (DuckDB) of the queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

OP3 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
    FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) t(i) WHERE len(w) > 0),
runs AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
    FROM d, (SELECT DISTINCT n FROM win) l, unnest(range(1, len(w) - n + 2)) t(i)),
hits AS (SELECT r, i, n, item_id FROM runs JOIN win USING (n, s)),
cov AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) t(k) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
    FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""

OP5 = r"""
WITH m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
ls AS (SELECT r, i, string_split(text, chr(10))[i] AS line FROM m, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i)),
lv AS (SELECT r, i, regexp_extract(line, '^(?:[ \t]*>)+') AS mark, line FROM ls),
p AS (SELECT r, i, len(regexp_replace(mark, '[^>]', '', 'g')) AS lev, substr(line, len(mark) + 1) AS body FROM lv),
n AS (SELECT *, trim(regexp_replace(lower(body), '[\x09-\x0D\x20]+', ' ', 'g')) AS norm,
    sum(edge) OVER (PARTITION BY r ORDER BY i) AS no FROM (
    SELECT *, (lev IS DISTINCT FROM lag(lev) OVER (PARTITION BY r ORDER BY i))::INT AS edge FROM p)),
own AS (SELECT r, string_agg(body, chr(10) ORDER BY i) AS clean,
    trim(regexp_replace(lower(string_agg(body, ' ' ORDER BY i)), '[\x09-\x0D\x20]+', ' ', 'g')) AS whole
    FROM n WHERE lev = 0 GROUP BY r),
origin AS (SELECT DISTINCT conv_id, turn AS from_turn, said FROM (
    SELECT r, whole AS said FROM own UNION ALL SELECT r, norm FROM n WHERE lev = 0) JOIN m USING (r)
    WHERE turn IS NOT NULL AND regexp_matches(said, '[\p{L}\p{N}]')),
passage AS (SELECT r, no, any_value(lev) AS lev,
    trim(regexp_replace(lower(string_agg(body, ' ' ORDER BY i)), '[\x09-\x0D\x20]+', ' ', 'g')) AS whole
    FROM n WHERE lev > 0 GROUP BY r, no),
asked AS (SELECT r, no, lev, 0 AS line, whole AS said FROM passage UNION ALL SELECT r, no, lev, 1, norm FROM n WHERE lev > 0),
met AS (SELECT a.r, no, lev, line, max(from_turn) AS from_turn FROM asked a JOIN m USING (r)
    JOIN origin o ON o.conv_id = m.conv_id AND o.said = a.said AND from_turn < m.turn
    WHERE regexp_matches(a.said, '[\p{L}\p{N}]') GROUP BY ALL),
byp AS (SELECT r, no, min(lev) AS lev, coalesce(max(from_turn) FILTER (line = 0), max(from_turn)) AS from_turn FROM met GROUP BY r, no),
lk AS (SELECT r, count(*) AS n_linked, arg_max(from_turn, (1000000 - lev) * 1000000000 + from_turn) AS linked FROM byp GROUP BY r),
q AS (SELECT r, max(lev) AS max_level, count(*) FILTER (lev > 0) AS n_quoted, count(DISTINCT no) FILTER (lev > 0) AS n_passages
    FROM n GROUP BY r)
SELECT conv_id, turn, role, max_level::BIGINT AS max_level, n_quoted::BIGINT AS n_quoted, n_passages::BIGINT AS n_passages,
    coalesce(n_linked, 0)::BIGINT AS n_linked,
    coalesce(linked, max(turn) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS reply_to,
    (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, trim(coalesce(clean, ''), chr(10))) - 1)::BIGINT AS position,
    trim(coalesce(clean, ''), chr(10)) AS text
FROM m JOIN q USING (r) LEFT JOIN own USING (r) LEFT JOIN lk USING (r)
"""

OP7 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM d, unnest(range(1, len(w) - 1)) t(i)),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY r),
l AS (SELECT r, sum(n) AS n_lines, count(*) AS n_distinct, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS n_unlike FROM (
    SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines - n_distinct, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
    (len(w) - coalesce(n_unlike, 0))::BIGINT AS n_dup_words,
    (length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')))::BIGINT AS n_upper
    FROM d LEFT JOIN rep USING (r) LEFT JOIN l USING (r)),
f AS (SELECT *, (n_words < 50) OR (n_repeat_words * 100 > n_words * 50) AS base_failed,
    (n_words < 50)::BIGINT + 2 * (n_repeat_words * 100 > n_words * 50)::BIGINT + 4 * (n_symbols * 10 > n_words)::BIGINT
    + 8 * (n_dup_words * 100 > n_words * 30)::BIGINT
    + 16 * ((word_chars > n_words * 12) OR (word_chars * 2 < n_words * 5))::BIGINT
    + 32 * (n_upper * 100 > word_chars * 40)::BIGINT AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules = 0 AS kept, failed_rules FROM f
"""

OP8 = r"""
WITH tab AS (SELECT list(list_reduce(range(0, 8), lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END),
    i::BIGINT) ORDER BY i) AS t FROM range(0, 256) v(i)),
d AS (SELECT doc_id, coalesce(text, '') AS s, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, (strlen(s) + 1)::BIGINT AS size, xor(list_reduce(list_transform(range(0, strlen(s)),
    lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT AS crc FROM d, tab),
o AS (SELECT *, sum(size) OVER (ORDER BY crc, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before,
    row_number() OVER (ORDER BY crc, doc_id, size) AS place, sum(size) OVER () AS total FROM c),
g AS (SELECT *, sum(size) OVER (PARTITION BY crc) AS whole, min(before) OVER (PARTITION BY crc) AS first FROM o),
s AS (SELECT *, least(15, ((CASE WHEN whole <= floor(total * 0.01 / 16) THEN first * 2 + whole ELSE before * 2 + size END)::HUGEINT
    * 16) // (2 * total::HUGEINT))::INT AS shard FROM g)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard,
    (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM s
"""

OP9 = r"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT r, doc_id, i, l[i] AS a, l[i + 1] AS b, l[i + 2] AS c FROM d, unnest(range(1, len(l) - 1)) t(i)
    WHERE regexp_matches(l[i] || l[i + 1] || l[i + 2], '[^\x20\x09-\x0D]')),
f AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS n FROM w),
gone AS (SELECT DISTINCT r, i + k AS i FROM f, (VALUES (0), (1), (2)) v(k) WHERE n > 1),
e AS (SELECT r, i, i - row_number() OVER (PARTITION BY r ORDER BY i) AS island FROM gone),
s AS (SELECT r, count(*) AS n_removed, count(DISTINCT island) AS n_spans FROM e GROUP BY r),
a AS (SELECT r, i, l[i] AS line FROM d, unnest(range(1, len(l) + 1)) t(i)),
k AS (SELECT r, string_agg(line, chr(10) ORDER BY i) AS kept FROM a ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, (CASE WHEN text IS NULL THEN 0 ELSE len(l) END)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
    coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (r) LEFT JOIN k USING (r)
"""

SQL = {
    "op3_decontamination": OP3,
    "op5_quote_linking": OP5,
    "op7_quality_rules": OP7,
    "op8_sharding": OP8,
    "op9_line_dedup": OP9,
}
