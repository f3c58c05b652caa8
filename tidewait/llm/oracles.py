"""The SQL each native query is compared with."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
keyed AS (SELECT *, trim(translate(line, '{UPPER}', '{LOWER}'), {BLANKS}) AS key FROM lines),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

MIX = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
rows AS (SELECT *, CAST(length(bin(size)) AS BIGINT) AS bits FROM sized),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size * bits) AS DOUBLE) AS size_bits,
  min(bits) AS low, max(bits) AS high FROM rows GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS r FROM totals),
weighted AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM ranked),
sums AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS t, sum(w) OVER () AS ws,
  coalesce(sum(cap) OVER b, 0.0::DOUBLE) AS cap_before, coalesce(sum(w) OVER b, 0.0::DOUBLE) AS w_before FROM weighted
  WINDOW b AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, cap * (ws - w_before) <= (t - cap_before) * w AS is_capped FROM sums),
level AS (SELECT *, sum(CASE WHEN is_capped THEN cap ELSE 0 END) OVER () AS cs, sum(CASE WHEN is_capped THEN w ELSE 0 END) OVER () AS wcs FROM capped),
targets AS (SELECT *, CASE WHEN is_capped THEN cap ELSE w * (t - cs) / (ws - wcs) END AS target FROM level),
ratios AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio,
  CASE WHEN source_size > 0 THEN size_bits / source_size ELSE 0 END AS mean FROM targets),
shaped AS (SELECT *, greatest(mean - low, high - mean) AS reach, least(ratio, 2.0::DOUBLE - ratio) AS room FROM ratios),
expected AS (SELECT d.doc_id, d.source, d.size, s.source_size, s.target,
  CASE WHEN reach > 0 AND room > 0 THEN ratio + 0.5::DOUBLE * room * (mean - d.bits) / reach ELSE ratio END AS e
  FROM rows d JOIN shaped s ON d.source IS NOT DISTINCT FROM s.source),
parts AS (SELECT *, CAST(floor(e) AS BIGINT) AS certain, e - floor(e) AS p,
  (CAST('0x' || substr(md5('5:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM expected),
opened AS (SELECT *, target - CAST(sum(certain * size) OVER (PARTITION BY source) AS BIGINT) AS open,
  CASE WHEN p > 0 THEN u / (1.0::DOUBLE - u) * ((1.0::DOUBLE - p) / p) END AS q FROM parts),
ordered AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS until FROM opened)
SELECT doc_id, source, size, source_size, target,
  certain + CASE WHEN q IS NOT NULL AND 2 * until - size < 2.0::DOUBLE * open THEN 1 ELSE 0 END AS copies,
  CAST((certain + CASE WHEN q IS NOT NULL AND 2 * until - size < 2.0::DOUBLE * open THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM ordered
"""


def shards_sql(max_bytes: int) -> str:
    return f"""
WITH rows AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')), 1, 15) AS BIGINT) AS h FROM documents),
start AS (SELECT CAST(length(bin(greatest(CAST(sum(n_bytes) AS BIGINT) // {max_bytes}, 1))) - 1 AS BIGINT) AS low FROM rows),
levels AS (SELECT doc_id, n_bytes, h, depth, h >> CAST(60 - depth AS BIGINT) AS bucket
  FROM rows, start, (SELECT unnest(range(61)) AS depth) d WHERE depth >= low),
sums AS (SELECT depth, bucket, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs FROM levels GROUP BY depth, bucket
  HAVING sum(n_bytes) <= {max_bytes} OR min(h) = max(h)),
chosen AS (SELECT l.doc_id, l.n_bytes, l.h, min(l.depth) AS depth FROM levels l JOIN sums s ON l.depth = s.depth AND l.bucket = s.bucket
  GROUP BY l.doc_id, l.n_bytes, l.h)
SELECT c.doc_id, c.n_bytes, 's' || CASE WHEN c.depth > 0 THEN lpad(bin(s.bucket), CAST(c.depth AS INTEGER), '0') ELSE '' END AS shard,
  CAST(c.depth AS INTEGER) AS depth, s.shard_docs, s.shard_bytes, s.shard_bytes > {max_bytes} AS over_limit
FROM chosen c JOIN sums s ON s.depth = c.depth AND s.bucket = c.h >> CAST(60 - c.depth AS BIGINT)
"""

# Word by word: every window of every item against every place of every document that holds its first word.
CONTAMINATION = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
win AS (SELECT item_id, least(10, len(ws)) AS n, unnest([list_slice(ws, s + 1, s + least(10, len(ws))) FOR s IN range(greatest(len(ws) - 9, 1))]) AS w FROM bw WHERE len(ws) > 0),
win2 AS (SELECT DISTINCT item_id, n, array_to_string(w, ' ') AS w FROM win),
lens AS (SELECT DISTINCT n FROM win2),
places AS (SELECT doc_id, n, unnest(range(len(ws) - n + 1)) AS s, ws FROM dw, lens WHERE len(ws) >= n),
grams AS (SELECT doc_id, n, s, array_to_string(list_slice(ws, s + 1, s + n), ' ') AS w FROM places),
occ AS (SELECT g.doc_id, g.s, g.n, w.item_id FROM grams g JOIN win2 w ON g.n = w.n AND g.w = w.w),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

CHAT = """
WITH t AS (SELECT DISTINCT conv_id, coalesce(CAST(turn AS BIGINT), -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
b AS (SELECT *, CAST(floor(turn / 64) AS BIGINT) AS block FROM t),
p AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY conv_id, block ORDER BY turn, role, text) - 1) / 1024) AS BIGINT) AS part FROM b),
pieces AS (
  SELECT t.conv_id, speaker, block, part, turn, role, text, role = speaker AS own,
    '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head,
    replace(text, '<|', '<\\|') || '<|im_end|>' || chr(10) AS body
  FROM p t JOIN people ON t.conv_id IS NOT DISTINCT FROM people.conv_id),
placed AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, block, part ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
  - length(body) AS start FROM pieces)
SELECT conv_id, speaker, block, part, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
  sha256(string_agg(head || body, '' ORDER BY turn, role, text)) AS text_sha256,
  sha256(coalesce(string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(body) - 1 AS BIGINT), ',' ORDER BY turn, role, text) FILTER (own), '')) AS mask_sha256
FROM placed GROUP BY conv_id, speaker, block, part
"""

# All pairs that share a shingle, by their exact counts; components by repeated minima.
JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
u AS (SELECT doc_id, len(ws) AS k, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
v AS (SELECT doc_id, k, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS g FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, hash(g) AS g FROM v WHERE i <= greatest(k - 4, 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
often AS (SELECT s.* FROM s JOIN (SELECT g FROM s GROUP BY g HAVING count(*) > 1) USING (g)),
able AS (SELECT doc_id FROM often JOIN n USING (doc_id) GROUP BY doc_id, n HAVING 100 * count(*) >= 80 * n),
t AS (SELECT often.* FROM often JOIN able USING (doc_id)),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM t x JOIN t y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
half AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""

# Every 100-byte string of every text, two hexadecimal digits a byte.
REPEATS = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, h, length(h) // 2 AS n, CAST(unnest(range((length(h) // 2 + 255) // 256)) AS BIGINT) AS c FROM h),
d AS (SELECT doc_id, n, c, substr(h, 512 * c + 1, 712) AS h FROM c),
b AS (SELECT doc_id, n, c, h, CAST(unnest(range(least(256, n - 256 * c))) AS BIGINT) AS i FROM d),
w AS (SELECT doc_id, 256 * c + i AS p, substr(h, 2 * i + 1, 2) AS x, CASE WHEN 256 * c + i + 100 <= n THEN hash(substr(h, 2 * i + 1, 200)) END AS s FROM b),
f AS (SELECT doc_id, p, x, CASE WHEN s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 THEN p END AS q FROM w),
g AS (SELECT doc_id, p, x, max(q) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM f),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS starts FROM g),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, coalesce(string_agg(x, '' ORDER BY p) FILTER (NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT h.doc_id, CAST(length(h.h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM h LEFT JOIN k USING (doc_id)
"""

# Every query against every other row.
TOP_K = """
WITH usable AS (SELECT vec_id, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM usable),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

# Every anchor against every other row.
HARD_NEGATIVES = """
WITH usable AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
v AS (SELECT vec_id, label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM usable),
p AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
neg AS (SELECT pos.*, p.vec_id AS negative_id, p.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY p.score DESC, p.vec_id) AS INTEGER) AS rank
  FROM pos JOIN p ON p.anchor_id = pos.anchor_id AND NOT p.same AND 50 * positive_score <= 100 * p.score AND 100 * p.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
"""

DIVERGENCE = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
n AS (SELECT row_number() OVER () AS id, * FROM d),
t AS (SELECT id, lang, source, unnest(ts) AS term FROM n),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
ln AS (SELECT lang, sum(total) AS total FROM gn GROUP BY lang),
lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (CAST(lc.n AS HUGEINT) + 5)) // (CAST(ln.total AS HUGEINT) + 5 * v) AS q
  FROM lc JOIN ln USING (lang) JOIN sizes USING (lang)),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n,
  1 + (CAST(1000000000 AS HUGEINT) * (CAST(coalesce(c.n, 0) AS HUGEINT) + 5)) // (CAST(gn.total AS HUGEINT) + 5 * v) AS p
  FROM gn JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
every AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
