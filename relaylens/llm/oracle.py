"""The operators that SQL can express, for the comparison engine (one row in, one row out)."""

_WORDS = r"""
SELECT doc_id, text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')
 AS ws FROM documents"""

# Classes: pairs that share a run of five words, then reachability over links.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE docs AS ({_WORDS}),
texts AS (SELECT min(doc_id) AS rep, ws FROM docs WHERE len(ws) > 0 GROUP BY ws),
runs AS (SELECT DISTINCT rep, array_to_string(ws[i:i + 4], ' ') AS run
 FROM (SELECT rep, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM texts) t),
sizes AS (SELECT rep, count(*) AS n FROM runs GROUP BY rep),
common AS (SELECT a.rep AS u, b.rep AS v, count(*) AS c FROM runs a JOIN runs b USING (run)
 WHERE a.rep <> b.rep GROUP BY 1, 2),
links AS (SELECT u, v FROM common JOIN sizes x ON x.rep = u JOIN sizes y ON y.rep = v
 WHERE c >= 0.8 * (x.n + y.n - c)),
reach AS (SELECT rep AS node, rep AS other FROM texts
 UNION SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.other),
classes AS (SELECT node, min(other) AS class_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, CAST(len(d.ws) AS INTEGER) AS n_words,
 d.doc_id = coalesce(c.class_id, d.doc_id) AS kept
FROM docs d LEFT JOIN texts t ON t.ws = d.ws LEFT JOIN classes c ON c.node = t.rep"""

EMBEDDINGS = """
WITH RECURSIVE vectors AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
 FROM embeddings),
usable AS (SELECT * FROM vectors WHERE e IS NOT NULL AND len(e) > 0
 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b
 ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e)
 >= 0.9 * sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))),
reach AS (SELECT vec_id AS node, vec_id AS other FROM vectors
 UNION SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.other)
SELECT vec_id, (SELECT count(*) FROM links WHERE u = vec_id) AS n_links, component_id,
 vec_id = component_id AS kept
FROM vectors JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) c ON node = vec_id"""

PASSAGES = rf"""
WITH docs AS ({_WORDS}),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
 FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM docs WHERE len(ws) >= 50) d),
earliest AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
removed AS (SELECT DISTINCT doc_id, i + unnest(range(0, 50)) AS i
 FROM windows JOIN earliest USING (h) WHERE first < doc_id),
placed AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
 FROM placed ANTI JOIN removed USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, len(d.ws) - coalesce(k.n, 0) AS n_removed,
 sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

RANKED = rf"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id,
 regexp_extract_all({_LOWER.format("text")}, '{_TERM}') AS ts FROM documents),
lengths AS (SELECT d, doc_id, CAST(len(ts) AS BIGINT) AS n FROM docs WHERE len(ts) > 0),
sums AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{_TERM}')) AS term
 FROM benchmark),
held AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(ts) AS term FROM docs) t
 WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE)))
 AS BIGINT) AS w FROM held, sums GROUP BY term, n_docs),
masses AS (SELECT d, doc_id, 100 - 90 + (90 * n * n_docs) // n_terms AS m FROM lengths, sums),
scores AS (SELECT item_id, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
 FROM wanted JOIN held USING (term) JOIN weights USING (term) JOIN masses USING (d) GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
 FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""

# The checksum, byte by byte, from the table of its 256 steps.
_CRC = """xor(CAST(4294967295 AS BIGINT), list_reduce(
 list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
 lambda crc, b: xor(crc >> 8, steps[CAST(xor(crc, b) & 255 AS INTEGER) + 1])))"""

PERIODIC = rf"""
WITH steps AS (SELECT list(list_reduce(list_concat([CAST(i AS BIGINT)], [CAST(0 AS BIGINT) for x in range(8)]),
 lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps FROM range(256) t(i)),
numbered AS (SELECT row_number() OVER () AS d, doc_id, {_CRC} AS h, list_filter(string_split_regex(
 coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents, steps),
places AS (SELECT d, doc_id, h, ws, CAST(len(ws) AS BIGINT) AS n, h // 10 AS g, CASE WHEN len(ws) > 0
 THEN (h // 10) % len(ws) END AS a FROM numbered),
docs AS (SELECT d, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a
 THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE ws END AS ws FROM places),
placed AS (SELECT d, len(ws) AS n, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM docs),
equal AS (SELECT x.d, y.i - x.i AS p, x.i FROM placed x JOIN placed y ON x.d = y.d AND x.word = y.word
 AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (SELECT d, p, min(i) AS s, count(*) + p AS len FROM
 (SELECT *, i - row_number() OVER (PARTITION BY d, p ORDER BY i) AS island FROM equal) e
 GROUP BY d, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
runs AS (SELECT * FROM stretches x WHERE NOT EXISTS (SELECT 1 FROM stretches y WHERE y.d = x.d AND y.p < x.p
 AND y.s <= x.s AND y.s + y.len >= x.s + x.len)),
listed AS (SELECT d, count(*) AS n_runs, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS lines
 FROM runs GROUP BY d),
first AS (SELECT * FROM runs x QUALIFY row_number() OVER (PARTITION BY d ORDER BY len / p DESC, s, p) = 1),
gone AS (SELECT DISTINCT d, unnest(range(s + p, s + len)) AS i FROM runs),
kept AS (SELECT d, string_agg(word, ' ' ORDER BY i) AS text FROM placed ANTI JOIN gone USING (d, i) GROUP BY d)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, len AS length, p AS period,
 (1000 * len) // p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
 sha256(coalesce(text, '')) AS collapsed_sha256
FROM docs LEFT JOIN listed USING (d) LEFT JOIN first USING (d) LEFT JOIN kept USING (d)"""
