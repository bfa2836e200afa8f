"""DuckDB SQL for the queries that SQL can express, over the driver's tables."""

OP3 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM p),
least_doc AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
bad AS (SELECT win.doc_id, win.i FROM win JOIN least_doc ON win.k = least_doc.k WHERE least_doc.d < win.doc_id),
cut AS (SELECT DISTINCT doc_id, i + o AS j FROM bad, range(0, 13) t(o)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.j) AS s FROM words LEFT JOIN cut ON words.doc_id = cut.doc_id AND words.j = cut.j WHERE cut.j IS NULL GROUP BY words.doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM cut GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id LEFT JOIN gone ON w.doc_id = gone.doc_id
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{words}')"
_PLAIN = _WORDS.format(words=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

OP5 = f"""
WITH d AS (SELECT doc_id, {_PLAIN} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_PLAIN} AS ws FROM benchmark),
item_windows AS (SELECT item, 10 AS n, array_to_string(ws[i:i + 9], ' ') AS k FROM (SELECT item, ws, unnest(range(1, len(ws) - 8)) AS i FROM b WHERE len(ws) >= 10)
 UNION SELECT item, len(ws) AS n, array_to_string(ws, ' ') AS k FROM b WHERE len(ws) BETWEEN 1 AND 9),
sizes AS (SELECT DISTINCT n FROM item_windows),
p AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n),
hits AS (SELECT p.doc_id, p.i, p.n, w.item FROM (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM p) p JOIN item_windows w ON p.n = w.n AND p.k = w.k),
hit_words AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hw.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(hi.n, 0) AS BIGINT) AS n_items,
 sha256(coalesce(hi.names, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words hw ON d.doc_id = hw.doc_id LEFT JOIN hit_items hi ON d.doc_id = hi.doc_id
"""

_SPACED = _WORDS.format(words=r"[^\x20\x09-\x0D]+")

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_.n >= 75 * (x.n + y.n - both_.n)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(v, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.v, edges.b FROM reach JOIN edges ON reach.r = edges.a),
roots AS (SELECT v, min(r) AS root FROM reach GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, roots.root AS component_id, roots.root = d.doc_id AS kept
FROM d JOIN roots ON roots.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP11 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
t AS (SELECT page_id, html, n, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
 CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM t
"""

_TERMS = _WORDS.format(words=r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")

OP12 = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS ws FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ws)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30),
seen AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(ws) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY ALL),
volume AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
total AS (SELECT lang, source, sum(n) AS n FROM seen GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, CAST(coalesce(s.n, 0) AS HUGEINT) AS n, CAST(coalesce(t.n, 0) + 5 * v.v AS HUGEINT) AS room
 FROM groups g JOIN kept k ON g.lang = k.lang JOIN volume v ON v.lang = g.lang LEFT JOIN total t ON t.lang = g.lang AND t.source = g.source
 LEFT JOIN seen s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term),
p AS (SELECT lang, source, term, n, 1 + 1000000000 * (n + 5) // room AS p FROM dense),
whole AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM dense GROUP BY ALL),
room AS (SELECT lang, CAST(sum(n) AS HUGEINT) + 5 * count(*) AS room FROM whole GROUP BY lang),
q AS (SELECT w.lang, w.term, 1 + 1000000000 * (w.n + 5) // r.room AS q FROM whole w JOIN room r ON r.lang = w.lang),
both_ AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(c.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN both_ c ON c.lang = a.lang AND c.source = a.source AND c.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= 50
"""

_RUNS = _WORDS.format(words=r"[A-Za-z\x{00C0}-\x{00FF}]+")
# One bit of a crc32 register, eight times, and its table of 256; bytes of a run are of ASCII or U+00C0 to U+00FF.
_BIT = "(CASE WHEN {c} % 2 = 1 THEN xor({c} // 2, 3988292384) ELSE {c} // 2 END)"

OP13 = f"""
WITH RECURSIVE crc_table(k, c, step) AS (SELECT range, CAST(range AS BIGINT), 0 FROM range(256)
 UNION ALL SELECT k, {_BIT.format(c='c')}, step + 1 FROM crc_table WHERE step < 8),
t AS (SELECT list(c ORDER BY k) AS t FROM crc_table WHERE step = 8),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest({_RUNS}) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
coded AS (SELECT doc_id, run, n, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN [CAST(ord(ch) AS BIGINT)] ELSE [195, ord(ch) - 64] END)) AS b FROM runs),
hashed AS (SELECT doc_id, run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS h FROM coded, t),
made AS (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, CAST(h % length(run) AS INT)) || substring(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near_ AS (SELECT DISTINCT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
 UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near_ GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 5 * w.n THEN b.top END AS form_n, CASE WHEN b.top >= 5 * w.n THEN min(x.other) END AS form
 FROM words w LEFT JOIN best b ON b.word = w.word LEFT JOIN near_ x ON x.word = w.word AND x.n = b.top GROUP BY w.word, w.n, b.n_near, b.top),
path(word, stop) AS (SELECT word, word FROM formed UNION ALL SELECT p.word, f.form FROM path p JOIN formed f ON f.word = p.stop WHERE f.form IS NOT NULL),
ends AS (SELECT p.word, p.stop AS root FROM path p JOIN formed f ON f.word = p.stop WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM formed f JOIN ends e ON e.word = f.word
"""
