"""SQL for those queries whose whole result SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP3 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w) t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r(d, t) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON r.t = l.a)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM (SELECT d AS doc_id, min(t) AS component_id FROM r GROUP BY d) c LEFT JOIN n ON n.doc_id = c.doc_id
"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT h, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h
"""

OP7 = rf"""
WITH i AS MATERIALIZED (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(8, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(8, len(w)) + 2), lambda k: array_to_string(w[k:k + least(8, len(w)) - 1], ' '))) AS t FROM i WHERE len(w) > 0),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM documents),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS t FROM d, (SELECT DISTINCT n FROM iw) z WHERE len(w) >= n),
h AS (SELECT doc_id, k, dw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.t = iw.t),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM h) q GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) q GROUP BY doc_id),
nw AS MATERIALIZED (SELECT DISTINCT item, w[k] AS a, list_distinct(w[k:k + n - 1]) AS s FROM (SELECT item, w, least(8, len(w)) AS n, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS k FROM i WHERE len(w) > 0) q),
dp AS MATERIALIZED (SELECT doc_id, unnest(w) AS a, unnest(list_transform(range(1, len(w) + 1), lambda k: w[greatest(1, k - 16):k + 16])) AS s FROM d),
m AS (SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS near FROM (SELECT DISTINCT doc_id, item FROM (SELECT doc_id, item, len(list_filter(nw.s, lambda x: list_contains(dp.s, x))) = len(nw.s) AS near FROM dp JOIN nw ON dp.a = nw.a) q WHERE near) q GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated,
  coalesce(n_near, 0) AS n_near_items, sha256(coalesce(near, '')) AS near_items_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS k, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS x FROM d WHERE len(w) >= 3),
u AS (SELECT doc_id, x FROM v GROUP BY doc_id, x HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT v.doc_id, unnest(range(k, k + 3)) AS pos FROM v JOIN u ON u.doc_id = v.doc_id AND u.x = v.x) q GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) q WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, coalesce(l.n, 0) AS n_lines,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id),
b AS (SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END + CASE WHEN 100 * n_upper > 60 * n_letters THEN 64 ELSE 0 END AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

OP12 = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, good, toxic, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, w.doc_id > min(w.doc_id) OVER (PARTITION BY t) AS e FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS bits, count(*) AS n, count(*) FILTER (good = 1) AS n_good, count(*) FILTER (toxic = 1) AS n_toxic FROM f GROUP BY ALL),
x AS (SELECT unnest([1, 2, 4, 8, 16]) AS bit, unnest(['A', 'B', 'C', 'D', 'E']) AS name),
o AS (SELECT p.name || q.name || r.name || s.name || t.name AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM x p, x q, x r, x s, x t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND (p.bit | q.bit | r.bit | s.bit | t.bit) = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step - 1])::INT AS prior FROM (SELECT filter_order, bits, unnest(range(1, 6))::INT AS step FROM o) q),
g AS (SELECT part, filter_order, step, s.bit, CAST(coalesce(sum(n) FILTER ((m.bits & (bit | coalesce(prior, 0))) = 0), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER ((m.bits & bit) <> 0 AND (m.bits & coalesce(prior, 0)) = 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER ((m.bits & bit) <> 0 AND (m.bits & coalesce(prior, 0)) <> 0), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (m.bits = bit), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n_good) FILTER ((m.bits & bit) <> 0 AND (m.bits & coalesce(prior, 0)) = 0), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n_toxic) FILTER ((m.bits & bit) <> 0 AND (m.bits & coalesce(prior, 0)) = 0), 0) AS BIGINT) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, s.bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM g
"""

OP13 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, 6)) AS m) z WHERE len(w) >= m) q GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (SELECT lang, m, phrase, a, w, unnest(range(1, m)) AS cut FROM c),
s AS (SELECT k.lang, k.phrase, k.a, cut, l.f AS l, r.f AS r, n, CAST(CAST(1000 AS HUGEINT) * k.a * n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(w[cut + 1:k.m], ' ') JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
x AS (SELECT DISTINCT c.lang, c.phrase FROM (SELECT lang, a, array_to_string(w[x:x + y - 1], ' ') AS part FROM c, (SELECT unnest(range(1, 5)) AS x) u, (SELECT unnest(range(2, 5)) AS y) v WHERE y < m AND x + y - 1 <= m) q JOIN c ON c.lang = q.lang AND c.phrase = q.part WHERE 100 * q.a >= 100 * c.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.lang = b.lang AND x.phrase = b.phrase)) q WHERE rank <= 2000
"""

SQL = {"op3_ngram_jaccard_join": OP3, "op6_warc": OP6, "op7_decontamination": OP7, "op10_quality_rules": OP10, "op12_filter_audit": OP12, "op13_collocations": OP13}
