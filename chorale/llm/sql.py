"""DuckDB SQL for the results of the queries that SQL can express."""

#: Base 32 of a digest: five bits at a time of its 160.
OP1 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(x, (k // 8 * 10 + 1)::BIGINT, 10))::BIGINT >> (35 - 5 * (k % 8))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p
"""

#: doc_id, the statistics and kept, over a relation named docs (doc_id, text, and a row number as rid).
_QUALITY = r"""
base AS (
  SELECT rid, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM docs
), lines AS (
  SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM base
), wins AS (
  SELECT rid, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda k: ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2])) AS g
  FROM base WHERE len(ws) >= 3
), many AS (
  SELECT rid, i FROM wins QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), cover AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM many, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), stats AS (
  SELECT b.rid, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
    length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '\p{L}', '', 'g')) AS n_letters,
    len(list_filter(ws, lambda x: NOT regexp_matches(x, '\p{L}'))) AS n_letterless, len(list_distinct(ws)) AS n_distinct,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{2022}]'))) AS n_bullets, len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$'))) AS n_ellipses
  FROM base b JOIN lines USING (rid) LEFT JOIN cover c USING (rid)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats
), quality AS (
  SELECT *, NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words
    OR 10 * n_dup_lines > 4 * n_lines OR 10 * n_upper > 3 * n_letters
    OR 10 * n_letterless > 2 * n_words OR 20 * n_distinct < n_words OR 10 * n_bullets > 9 * n_lines OR 10 * n_ellipses > 3 * n_lines) AS kept FROM judged
)
"""

OP2 = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
{_QUALITY}
SELECT d.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept
FROM docs d JOIN quality USING (rid)
"""

OP6 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
  row_number() OVER (PARTITION BY n ORDER BY doc_id) = 1 AS kept, sha256(n) AS text_sha256
FROM t
"""

OP7 = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(r, '^[^?#]*\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS q
  FROM rest
), canon AS (
  SELECT *, CASE WHEN host = '' THEN '' ELSE host || regexp_replace(path, '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS c FROM parts
), listed AS (
  SELECT DISTINCT c FROM canon WHERE c <> '' AND (starts_with(md5(c), '0') OR regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.'))
), rules(verdict, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM canon, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT page_id, host, path, b.rule, coalesce(b.verdict, CASE WHEN c IN (SELECT c FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM canon LEFT JOIN best b USING (page_id)
"""

OP10 = r"""
WITH docs AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), lines AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM docs
), codes AS (
  SELECT doc_id, i, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded, ('0x' || substr(md5(line), 1, 12))::BIGINT % 2147483647 AS code FROM lines
), rolled AS (
  SELECT *, (code * 31 + coalesce(lag(code) OVER w, 0) * 1000003) % 2147483647 AS v FROM codes WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), scales(d, r) AS (
  VALUES (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)
), ends AS (
  SELECT DISTINCT * FROM (
    SELECT doc_id, d, r, i AS e FROM rolled, scales WHERE v % d = r
    UNION ALL SELECT doc_id, d, r, unnest([0, len(l)]) AS e FROM docs, scales)
), nexts AS (
  SELECT doc_id, e AS a0, lead(e) OVER w AS e1, lead(e, 2) OVER w AS e2 FROM ends WINDOW w AS (PARTITION BY doc_id, d, r ORDER BY e)
), stops AS (
  SELECT DISTINCT doc_id, a0, CASE WHEN e1 - a0 >= 2 THEN e1 ELSE coalesce(e2, e1) END AS stop FROM nexts WHERE e1 IS NOT NULL
), parts AS (
  SELECT doc_id, stop, unnest(range(a0 + 1, stop + 1, 64)) AS a FROM stops
), pieces AS (
  SELECT DISTINCT doc_id, a, least(a + 63, stop) AS b FROM parts
), spans AS (
  SELECT doc_id, a, b, array_to_string(l[a:b], chr(10)) AS chunk FROM pieces JOIN docs USING (doc_id)
  WHERE b > a AND len(list_filter(l[a:b], lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) > 1
), placed AS (
  SELECT *, first_value(doc_id) OVER w AS d1, first_value(b) OVER w AS b1 FROM spans WINDOW w AS (PARTITION BY chunk ORDER BY doc_id, a, b)
), cuts AS (
  SELECT * FROM placed WHERE NOT (doc_id = d1 AND a <= b1)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM cuts
), whole AS (
  SELECT n.doc_id, count(*) AS n_lines, count(g.i) AS n_removed_lines, string_agg(line, chr(10) ORDER BY n.i) FILTER (g.i IS NULL) AS cleaned
  FROM lines n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.i = n.i GROUP BY n.doc_id
)
SELECT doc_id, n_lines, coalesce(c.n, 0)::BIGINT AS n_removed_chunks, n_removed_lines, CASE WHEN text IS NOT NULL THEN md5(coalesce(cleaned, '')) END AS cleaned_md5
FROM docs JOIN whole USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM cuts GROUP BY doc_id) c USING (doc_id)
"""

#: CRC-32 by its polynomial, eight steps for each byte of a word; words are hashed once.
OP13 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), words AS (
  SELECT rid, unnest(ws) AS w FROM docs
), wanted AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), known AS (
  SELECT w, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM (SELECT w, 1 AS s, 0 AS t FROM words UNION ALL SELECT w, 0, 1 FROM wanted) GROUP BY w
), hexed AS (
  SELECT *, hex(encode(w)) AS h FROM known
), hashed AS (
  SELECT w, s, t, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
    lambda crc, b: list_reduce(range(0, 8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(crc, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket FROM hexed
), buckets AS (
  SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM buckets) + 10000) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM buckets) + 10000))))::BIGINT AS gain FROM buckets
), weights AS (
  SELECT rid, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM words JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY rid
), scored AS (
  SELECT rid, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5) / 4294967296.0))))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (rid)
), drawn AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= able * 10 // 100 THEN place END AS rank FROM scored LEFT JOIN drawn USING (rid)
"""
