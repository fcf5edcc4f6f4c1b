"""DuckDB SQL with the same rows as the queries, written apart from the operators' expressions."""

QUALITY_RULES = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
spaced AS (SELECT r, string_split(translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' ') AS ws, string_split(text, chr(10)) AS ls, text FROM docs),
words AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT r, list_filter(ws, lambda x: x <> '') AS w FROM spaced)),
wc AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY r),
sym AS (SELECT r, length(text) - length(translate(text, '#*$%&|<>', '')) AS n FROM spaced),
lines AS (SELECT r, unnest(ls) AS l FROM spaced),
full_lines AS (SELECT r, l FROM lines WHERE trim(l, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
lc AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM full_lines GROUP BY r),
three AS (SELECT r, i, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p AS t FROM words WINDOW p AS (PARTITION BY r ORDER BY i)),
often AS (SELECT r, t FROM three WHERE t IS NOT NULL GROUP BY r, t HAVING count(*) > 1),
covered AS (SELECT DISTINCT r, i + d AS i FROM three JOIN often USING (r, t), (SELECT unnest([0, 1, 2]) AS d)),
rc AS (SELECT r, count(*) AS n FROM covered GROUP BY r),
counts AS (
  SELECT d.r, doc_id, lang, source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    CASE WHEN n_words IS NULL THEN 0 ELSE sym.n END::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(rc.n, 0)::BIGINT AS n_repeat_words
  FROM docs d LEFT JOIN wc USING (r) LEFT JOIN sym USING (r) LEFT JOIN lc USING (r) LEFT JOIN rc USING (r)),
measures AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_symbols * 1000000 // greatest(word_chars, 1) AS symbol_ppm, n_dup_lines * 1000000 // greatest(n_lines, 1) AS dup_line_ppm,
    n_repeat_words * 1000000 // greatest(n_words, 1) AS repeat_ppm, word_chars * 1000 // greatest(n_words, 1) AS milli
  FROM counts),
long AS (
  SELECT lang, source, m.measure, m.value FROM (
    SELECT lang, source, unnest([{'measure': 'symbol_ppm', 'value': symbol_ppm}, {'measure': 'dup_line_ppm', 'value': dup_line_ppm},
      {'measure': 'repeat_ppm', 'value': repeat_ppm}, {'measure': 'milli', 'value': milli}]) AS m
    FROM measures WHERE NOT base_failed)),
binned AS (SELECT coalesce(lang, chr(1)) AS lang, coalesce(source, chr(1)) AS source, measure,
    CASE WHEN value < 64 THEN value ELSE (value >> (length(bin(value)) - 6)) << (length(bin(value)) - 6) END AS b FROM long),
levels AS (SELECT lang, source, measure, b FROM binned UNION ALL SELECT lang, chr(2), measure, b FROM binned UNION ALL SELECT chr(2), chr(2), measure, b FROM binned),
ranked AS (SELECT lang, source, measure, b, row_number() OVER (PARTITION BY lang, source, measure ORDER BY b) AS nth, count(*) OVER (PARTITION BY lang, source, measure) AS n FROM levels),
q AS (
  SELECT lang, source, measure, max(n) AS n, min(b) FILTER (4 * nth >= n) AS q1, min(b) FILTER (2 * nth >= n) AS q2, min(b) FILTER (4 * nth >= 3 * n) AS q3, min(b) FILTER (10 * nth >= 9 * n) AS d9
  FROM ranked GROUP BY ALL),
bins AS (SELECT lang, source, measure, b, count(*) AS n FROM levels WHERE measure IN ('symbol_ppm', 'dup_line_ppm') GROUP BY ALL),
summed AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lang, source, measure) AS total FROM bins),
filled AS (SELECT *, lead(b) OVER (PARTITION BY lang, source, measure ORDER BY b) AS next FROM (SELECT * FROM summed WHERE n * 1000 >= total)),
gaps AS (SELECT *, (next + unit) * 1000 // (b + unit) AS wide FROM (SELECT *, CASE WHEN measure = 'symbol_ppm' THEN 10000 ELSE 100000 END AS unit FROM filled) WHERE 2 * upto >= total AND next + unit >= 4 * (b + unit)),
widest AS (SELECT lang, source, measure, b AS low, next AS high FROM gaps QUALIFY row_number() OVER (PARTITION BY lang, source, measure ORDER BY wide DESC, b) = 1),
sizes AS (SELECT lang, measure, max(total) AS n FROM summed WHERE source = chr(2) AND lang <> chr(2) GROUP BY ALL),
edges AS (SELECT z.lang, z.measure, CASE WHEN z.n < 50 THEN a.low ELSE w.low END AS low, CASE WHEN z.n < 50 THEN a.high ELSE w.high END AS high
  FROM sizes z LEFT JOIN widest w ON w.lang = z.lang AND w.source = chr(2) AND w.measure = z.measure LEFT JOIN widest a ON a.lang = chr(2) AND a.measure = z.measure),
sides AS (SELECT b.lang, b.source, b.measure, any_value(e.low) AS low, any_value(e.high) AS high, sum(b.n) AS n, max(b.b) FILTER (b.b <= e.low) AS below, min(b.b) FILTER (b.b >= e.high) AS above
  FROM bins b JOIN edges e ON e.lang = b.lang AND e.measure = b.measure WHERE b.source <> chr(2) AND e.high IS NOT NULL GROUP BY b.lang, b.source, b.measure),
cuts AS (SELECT lang, source, measure, ((n * coalesce(below, low) + 50 * low) // (n + 50) + (n * coalesce(above, high) + 50 * high) // (n + 50)) // 2 AS cut FROM sides),
s AS (SELECT lang, source, measure, n, q2 AS mid, CASE WHEN measure = 'milli' THEN least(q2 - q1, q3 - q2) ELSE d9 - q2 END AS spread FROM q WHERE measure IN ('repeat_ppm', 'milli')),
chosen AS (
  SELECT o.lang, o.source, o.measure,
    (o.n * o.mid + 50 * ((l.n * l.mid + 50 * a.mid) // (l.n + 50))) // (o.n + 50) AS mid,
    (o.n * o.spread + 50 * ((l.n * l.spread + 50 * a.spread) // (l.n + 50))) // (o.n + 50) AS spread
  FROM s o JOIN s l ON l.lang = o.lang AND l.source = chr(2) AND l.measure = o.measure
  JOIN s a ON a.lang = chr(2) AND a.source = chr(2) AND a.measure = o.measure WHERE o.source <> chr(2)),
rules AS (SELECT * FROM (VALUES ('repeat_ppm', 12, 10000), ('milli', 16, 150)) AS t(measure, fence, floor)),
reaches AS (SELECT lang, source, measure, mid, fence * greatest(floor, spread) AS reach FROM chosen JOIN rules USING (measure)),
votes AS (SELECT lang, measure, b, row_number() OVER (PARTITION BY lang, measure ORDER BY b) AS nth, count(*) OVER (PARTITION BY lang, measure) AS n
  FROM (SELECT lang, measure, CASE WHEN reach < 64 THEN reach ELSE (reach >> (length(bin(reach)) - 6)) << (length(bin(reach)) - 6) END AS b FROM reaches)),
middle AS (SELECT lang, measure, min(b) FILTER (2 * nth >= n) AS most FROM votes GROUP BY ALL),
fences AS (SELECT lang, source, measure, mid, least(reach, 3 * most // 2) AS reach FROM reaches JOIN middle USING (lang, measure)),
limits AS (
  SELECT lang, source,
    (SELECT max(cut) FROM cuts c WHERE c.lang = f.lang AND c.source = f.source AND c.measure = 'symbol_ppm') AS symbol_max,
    (SELECT max(cut) FROM cuts c WHERE c.lang = f.lang AND c.source = f.source AND c.measure = 'dup_line_ppm') AS dup_max,
    max(CASE WHEN measure = 'repeat_ppm' THEN mid + reach END) AS repeat_max,
    max(CASE WHEN measure = 'milli' THEN mid + reach END) AS milli_max,
    max(CASE WHEN measure = 'milli' THEN mid - reach END) AS milli_min
  FROM fences f GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR coalesce(symbol_ppm > symbol_max, false) OR coalesce(dup_line_ppm > dup_max, false) OR coalesce(repeat_ppm > repeat_max, false)
    OR coalesce(milli > milli_max, false) OR coalesce(milli < milli_min, false)) AS kept
FROM measures m LEFT JOIN limits t ON t.lang = coalesce(m.lang, chr(1)) AND t.source = coalesce(m.source, chr(1))
"""

URL_FILTERS = r"""
WITH split AS (
  SELECT page_id, url, html,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, url, html, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '') AS query FROM split),
named AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '(\.html|/)$', '') ||
      coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid)='))), '&'), ''), '') END AS canon
  FROM parts),
rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS t(say, h, p)),
fit AS (
  SELECT row_number() OVER () AS k, n.* FROM named n),
best AS (
  SELECT k, arg_max(h || p, length(h || p)) AS rule, arg_max(say, length(h || p)) AS say
  FROM fit JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k),
listed AS (SELECT canon FROM named WHERE canon IS NOT NULL GROUP BY canon HAVING count(DISTINCT html) > 1)
SELECT page_id, host, path, rule, coalesce(say, CASE WHEN canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM fit LEFT JOIN best USING (k)
"""

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
full_lines AS (SELECT doc_id, i, trim(raw, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line FROM lines WHERE trim(raw, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) <> ''),
three AS (
  SELECT doc_id, i, lead(i) OVER w AS i2, lead(i, 2) OVER w AS i3, line || chr(10) || lead(line) OVER w || chr(10) || lead(line, 2) OVER w AS t
  FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
placed AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, i) AS nth FROM three WHERE t IS NOT NULL),
covered AS (SELECT DISTINCT doc_id, unnest([i, i2, i3]) AS i FROM placed WHERE nth > 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.n, 0)::BIGINT AS n_removed_lines
FROM documents d LEFT JOIN (
  SELECT l.doc_id, string_agg(raw, chr(10) ORDER BY l.i) FILTER (c.i IS NULL) AS text, count(c.i) AS n
  FROM lines l LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.i = l.i GROUP BY l.doc_id) k USING (doc_id)
"""

TOP_K = r"""
WITH fit AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
asked AS (SELECT row_number() OVER () AS q_row, vec_id, v FROM fit WHERE vec_id % 50 = 0),
scored AS (SELECT q_row, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM asked q JOIN fit c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q_row ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

CHAT_FORMAT = r"""
WITH RECURSIVE lines AS (
  SELECT conv_id, turn, md5(text) AS row, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE text IS NOT NULL)),
levels AS (
  SELECT conv_id, turn, row, i, length(regexp_replace(regexp_extract(line, '^[ \t]*(?:>[ \t]*)+'), '[^>]', '', 'g')) AS level,
    regexp_replace(line, '^[ \t]*(?:>[ \t]*)+', '') AS body FROM lines),
marked AS (
  SELECT *, NOT regexp_matches(body, '\S') AS blank,
    (level <> lag(level, 1, -1) OVER w OR NOT regexp_matches(body, '\S'))::INT AS starts FROM levels WINDOW w AS (PARTITION BY conv_id, turn, row ORDER BY i)),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id, turn, row ORDER BY i) AS run FROM marked QUALIFY NOT blank),
texts AS (
  SELECT conv_id, turn, level, string_agg(body, ' ' ORDER BY i) AS unit FROM runs GROUP BY conv_id, turn, row, run, level
  UNION ALL SELECT conv_id, turn, level, body FROM runs),
units AS (SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(lower(unit), '\s+', ' ', 'g')) AS unit FROM texts),
firsts AS (SELECT conv_id, unit, min(turn) AS of_turn FROM units WHERE level = 0 GROUP BY ALL),
found AS (
  SELECT q.conv_id, q.turn, q.level, f.of_turn, sum(length(q.unit)) AS chars, count(*) AS n
  FROM units q JOIN firsts f ON f.conv_id = q.conv_id AND f.unit = q.unit AND f.of_turn < q.turn WHERE q.level > 0 GROUP BY ALL),
parents AS (
  SELECT conv_id, turn, arg_max(of_turn, (-level, chars, of_turn)) AS parent_turn, sum(n)::BIGINT AS n_linked FROM found GROUP BY ALL),
keys AS (SELECT DISTINCT conv_id, turn, parent_turn FROM conversations LEFT JOIN parents USING (conv_id, turn)),
walk AS (
  SELECT conv_id, turn, turn::VARCHAR AS path, 0 AS depth FROM keys WHERE parent_turn IS NULL
  UNION ALL SELECT k.conv_id, k.turn, w.path || '.' || k.turn, w.depth + 1 FROM keys k JOIN walk w ON w.conv_id = k.conv_id AND w.turn = k.parent_turn),
own AS (
  SELECT c.conv_id, c.turn, c.role, CASE WHEN text IS NULL THEN NULL ELSE regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '^[ \t]*>')), chr(10)), '^\s+|\s+$', '', 'g') END AS text
  FROM conversations c)
SELECT o.conv_id, o.turn, o.role, o.text, p.parent_turn::VARCHAR AS parent_turn, coalesce(p.n_linked, 0)::BIGINT AS n_linked, w.depth::BIGINT AS depth, w.path
FROM own o LEFT JOIN parents p USING (conv_id, turn) LEFT JOIN walk w USING (conv_id, turn)
"""

DECONTAMINATION = r"""
WITH lowered AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
items AS (SELECT item_id, regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, lowered),
windows AS (SELECT DISTINCT item_id, len(t) AS n, array_to_string(t, ' ') AS t FROM (
  SELECT item_id, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: w[i:i + 9])) AS t FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents, lowered),
places AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes),
found AS (SELECT r, i, p.n, item_id FROM (SELECT p.r, p.n, p.i, array_to_string(w[i:i + p.n - 1], ' ') AS t FROM places p JOIN docs USING (r)) p JOIN windows v ON v.n = p.n AND v.t = p.t),
hits AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest(range(i, i + n)) AS i FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""

_TREE = """{name} AS (
  SELECT g, idx, n, digest, 0 AS level FROM {leaves}
  UNION ALL SELECT g, idx // 2, any_value(n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)), any_value(level) + 1 FROM {name} WHERE n > 1 GROUP BY g, idx // 2)"""

MERKLE = (
    r"""
WITH RECURSIVE docs AS (
  SELECT *, (SELECT (4294967295 - list_reduce(list_concat([4294967295::BIGINT], list_transform(range(8 * length(doc_id::VARCHAR)), lambda k: k)), lambda c, k: CASE WHEN k % 8 = 0 THEN
      CASE WHEN xor(c, ascii(substr(doc_id::VARCHAR, k // 8 + 1, 1))) % 2 = 1 THEN xor(xor(c, ascii(substr(doc_id::VARCHAR, k // 8 + 1, 1))) >> 1, 3988292384) ELSE xor(c, ascii(substr(doc_id::VARCHAR, k // 8 + 1, 1))) >> 1 END
      ELSE CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END END)) % 7 = 0) AS tampers FROM documents),
f AS (SELECT *, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS before,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS after FROM docs),
l AS (SELECT doc_id, lang, sha256(before || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || after) AS leaf,
    sha256(before || coalesce(length((n_chars + tampers::INT)::VARCHAR) || ':' || (n_chars + tampers::INT), '-') || after) AS claimed FROM f),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS n FROM (SELECT DISTINCT lang FROM l)),
leaves AS (SELECT l.*, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n, leaf AS digest FROM l JOIN langs ON l.lang IS NOT DISTINCT FROM langs.lang),
"""
    + _TREE.format(name="lower", leaves="leaves")
    + """,
subroots AS (SELECT 0 AS g, langs.g AS idx, langs.n AS n, digest FROM langs JOIN lower ON lower.g = langs.g AND lower.n = 1),
"""
    + _TREE.format(name="upper", leaves="subroots")
    + """,
ways AS (
  SELECT g, leaf_idx, list(struct_pack(level := level, sibling := sibling, is_right := is_right) ORDER BY level) AS way FROM (
    SELECT a.g, a.idx AS leaf_idx, x.level, s.digest AS sibling, (a.idx >> x.level) % 2 = 1 AS is_right
    FROM leaves a JOIN (SELECT DISTINCT g, level, n FROM lower WHERE n > 1) x ON x.g = a.g LEFT JOIN lower s ON s.g = a.g AND s.level = x.level AND s.idx = xor(a.idx >> x.level, 1)) GROUP BY ALL),
top_ways AS (
  SELECT g, list(struct_pack(level := level, sibling := sibling, is_right := is_right) ORDER BY level) AS way FROM (
    SELECT a.idx AS g, x.level, s.digest AS sibling, (a.idx >> x.level) % 2 = 1 AS is_right
    FROM subroots a JOIN (SELECT DISTINCT level, n FROM upper WHERE n > 1) x ON true LEFT JOIN upper s ON s.level = x.level AND s.idx = xor(a.idx >> x.level, 1)) GROUP BY ALL),
proofs AS (
  SELECT a.*, s.digest AS subroot, (SELECT digest FROM upper WHERE n = 1) AS root, list_concat(coalesce(w.way, []), coalesce(t.way, [])) AS way
  FROM leaves a JOIN subroots s ON s.idx = a.g LEFT JOIN ways w ON w.g = a.g AND w.leaf_idx = a.idx LEFT JOIN top_ways t ON t.g = a.g)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_filter(list_transform(way, lambda x: x.sibling), lambda x: x IS NOT NULL), ''), '')) AS proof_sha256,
  folded AS folded_root, folded = root AS verified
FROM (SELECT *, list_reduce(list_concat([struct_pack(node := claimed, is_right := false)], list_transform(way, lambda x: struct_pack(node := x.sibling, is_right := x.is_right))),
    lambda a, x: struct_pack(node := sha256(CASE WHEN x.is_right THEN coalesce(x.node, '') || a.node ELSE a.node || coalesce(x.node, '') END), is_right := false)).node AS folded FROM proofs)
"""
)
