"""SQL twins (DuckDB) of the queries that SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^ \t\n\x0B\f\r]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id WHERE a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85 GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON s.doc_id = m.a
"""

# CRC-32 step by step over the bytes: the table comes from the polynomial by rule.
OP7 = """
WITH RECURSIVE g AS (SELECT i, CAST(i AS UBIGINT) AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM g WHERE k < 8),
t AS (SELECT list(c ORDER BY i) AS t FROM g WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS x, md5(coalesce(text, '')) AS h FROM documents),
b AS (SELECT doc_id, h, x, CAST(octet_length(encode(x)) + 8 AS BIGINT) AS size, hex(encode(x)) AS hx FROM d),
crc AS (SELECT doc_id, h, size, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, size - 8), lambda i: CAST(('0x' || hx[2 * i + 1:2 * i + 2]) AS UBIGINT))), lambda acc, y: xor(acc >> 8, t.t[CAST(xor(acc, y) & 255 AS INTEGER) + 1])), 4294967295::UBIGINT) AS crc FROM b, t),
o AS (SELECT *, sum(size) OVER (ORDER BY h, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS upto, sum(size) OVER () AS total, row_number() OVER (ORDER BY h, doc_id NULLS FIRST) AS rn FROM crc),
s AS (SELECT *, least(23, CAST(upto * 24 // total AS INTEGER)) AS shard FROM o)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY rn) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""

OP11 = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\n\x0B\f\r]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^ \t]+') AS w FROM t),
n AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
o AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) s(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM o GROUP BY ALL),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE f >= 10 AND k > 1),
u AS (SELECT lang, k, phrase, w, f AS a, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.phrase, u.a, u.cut, x.f AS l, y.f AS r, 1000000 * u.a * u.a // (x.f * y.f) AS score FROM u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(u.w[1:u.cut], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.w[u.cut + 1:u.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, f FROM c WHERE k = 3),
m AS (SELECT lang, phrase, max(f) AS f FROM i GROUP BY ALL),
k AS (SELECT b.* FROM b LEFT JOIN m USING (lang, phrase) WHERE m.f IS NULL OR 100 * m.f < 50 * b.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""

# CRC-32 of each distinct feature's bytes, as in OP7.
OP13 = rf"""
WITH RECURSIVE g AS (SELECT i, CAST(i AS UBIGINT) AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM g WHERE k < 8),
t AS (SELECT list(c ORDER BY i) AS t FROM g WHERE k = 8),
w AS (SELECT 0 AS part, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents UNION ALL SELECT 1, item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
o AS (SELECT part, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS x FROM w),
d AS (SELECT DISTINCT x, hex(encode(x)) AS hx, octet_length(encode(x)) AS b FROM o),
h AS (SELECT x, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, b), lambda i: CAST(('0x' || hx[2 * i + 1:2 * i + 2]) AS UBIGINT))), lambda acc, y: xor(acc >> 8, t.t[CAST(xor(acc, y) & 255 AS INTEGER) + 1])), 4294967295::UBIGINT) % 10000 AS INTEGER) AS bucket FROM d, t),
e AS (SELECT part, doc_id, bucket FROM o JOIN h USING (x)),
n AS (SELECT bucket, count(*) FILTER (part = 0) AS s, count(*) FILTER (part = 1) AS t FROM e GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM n),
v AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain FROM n, a),
f AS (SELECT doc_id, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM e JOIN v USING (bucket) WHERE part = 0 GROUP BY doc_id),
z AS (SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST(('0x' || sha256('7:' || doc_id)[1:8]) AS UBIGINT) AS h FROM w LEFT JOIN f USING (doc_id) WHERE part = 0),
y AS (SELECT doc_id, words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM z),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE words >= 20),
q AS (SELECT 25 * count(*) // 100 AS most FROM r)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CAST(CASE WHEN rank <= most THEN rank END AS BIGINT) AS rank FROM y LEFT JOIN r USING (doc_id), q
"""
