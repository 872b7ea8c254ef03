"""DuckDB SQL that returns the rows of the queries which SQL can express on whole tables."""

from tessera.llm.urls import SUFFIXES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
raw AS (
  SELECT doc_id, unnest(CASE WHEN w IS NULL OR len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM raw),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT c.a, c.b FROM common c JOIN size x ON x.doc_id = c.a JOIN size y ON y.doc_id = c.b WHERE 100 * c.i >= 75 * (x.n + y.n - c.i)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(v, u) AS (SELECT a, a FROM edges UNION SELECT r.v, e.b FROM reach r JOIN edges e ON e.a = r.u),
comp AS (SELECT v, min(u) AS c FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN size s ON s.doc_id = d.doc_id LEFT JOIN comp c ON c.v = d.doc_id
"""


MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, 3.0 * sum(size)::DOUBLE AS cap FROM sized GROUP BY source),
weighted AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM sources),
levels AS (
  SELECT *, cap / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
goal AS (
  SELECT source, source_size, least(cap, weight * coalesce(max(CASE WHEN level <= ratio THEN level END) OVER (), max(ratio) OVER ()))::DOUBLE AS target FROM levels),
placed AS (
  SELECT d.*, g.source_size, g.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS so_far
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
copies AS (
  SELECT doc_id, source, size, pass * source_size + so_far AS position, (pass * source_size + so_far) / target AS finish
  FROM placed, (SELECT unnest([0, 1, 2]) AS pass) WHERE size > 0 AND target > 0),
served AS (SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, source, position ROWS UNBOUNDED PRECEDING) AS total FROM copies),
taken AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM served WHERE total <= (SELECT round(sum(target)) FROM goal) GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(t.taken, 0)::BIGINT AS taken FROM placed p LEFT JOIN taken t ON t.doc_id = p.doc_id
"""

URL_FILTER = r"""
WITH rest AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (SELECT page_id, url, """ + _LOWER.format("regexp_extract(r, '^[^/?#]*')") + r""" AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
bad AS (SELECT doc_id, 1 - max(quality) AS bad FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
seen AS (
  SELECT s.host, sum(b.bad)::DOUBLE AS bad, count(*)::DOUBLE AS n
  FROM split s JOIN bad b ON b.doc_id = try_cast(regexp_extract(s.url, '^[^:]*://[^/?#]*/[a-z]+/([0-9]+)', 1) AS BIGINT) GROUP BY s.host),
base AS (
  SELECT h.host, array_to_string(list_slice(string_split(h.host, '.'), -2 - wide, -1), '.') AS domain, array_to_string(list_slice(string_split(h.host, '.'), -1 - wide, -1), '.') AS suffix,
    coalesce(s.bad, 0.0) AS bad, coalesce(s.n, 0.0) AS n
  FROM (SELECT host, (array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') IN (""" + ", ".join(f"'{s}'" for s in SUFFIXES) + r"""))::INT AS wide FROM (SELECT DISTINCT host FROM split)) h
  LEFT JOIN seen s ON s.host = h.host),
domains AS (SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM base GROUP BY 1, 2),
tops AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n, (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0.5) FROM base) AS p FROM domains GROUP BY 1),
k0 AS (SELECT 1 / least(greatest(coalesce((sum(n * (bad / n - p) ** 2) - sum(p * (1 - p))) / nullif(sum(p * (1 - p) * (n - 1)), 0), 0.001), 0.001), 0.5) - 1 AS k FROM tops WHERE n > 0),
tops2 AS (SELECT suffix, (bad + k * p) / (n + k) AS p FROM tops, k0),
domains1 AS (SELECT d.*, t.p FROM domains d JOIN tops2 t ON t.suffix = d.suffix),
k1 AS (SELECT 1 / least(greatest(coalesce((sum(n * (bad / n - p) ** 2) - sum(p * (1 - p))) / nullif(sum(p * (1 - p) * (n - 1)), 0), 0.001), 0.001), 0.5) - 1 AS k FROM domains1 WHERE n > 0),
domains2 AS (SELECT domain, suffix, (bad + k * p) / (n + k) AS p FROM domains1, k1),
hosts1 AS (SELECT b.*, d.p FROM base b JOIN domains2 d ON d.domain = b.domain AND d.suffix = b.suffix),
k2 AS (SELECT 1 / least(greatest(coalesce((sum(n * (bad / n - p) ** 2) - sum(p * (1 - p))) / nullif(sum(p * (1 - p) * (n - 1)), 0), 0.001), 0.001), 0.5) - 1 AS k FROM hosts1 WHERE n > 0),
known AS (SELECT host, m - 1.645 * sqrt(m * (1 - m) / (n + k + 1)) AS bound FROM (SELECT host, n, k, (bad + k * p) / (n + k) AS m FROM hosts1, k2)),
rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fits AS (
  SELECT s.page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.v, length(r.h || r.p)) AS v
  FROM split s JOIN rules r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p) GROUP BY s.page_id)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.v, CASE WHEN k.bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM split s JOIN known k ON k.host = s.host LEFT JOIN fits f ON f.page_id = s.page_id
"""

DECONTAMINATION = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(""" + _LOWER.format("text") + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(""" + _LOWER.format("text") + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0)),
places AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS MATERIALIZED (SELECT p.doc_id, p.k, p.n, v.item_id FROM places p JOIN windows v ON v.n = p.n AND v.s = p.s),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS k FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(w.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(w.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words w ON w.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id
"""

REPEATED_LINES = r"""
WITH raw AS (SELECT DISTINCT doc_id, md5(text) AS t, text FROM documents WHERE text IS NOT NULL),
split AS (SELECT doc_id, t, unnest(string_split(text, chr(10))) AS c, unnest(range(len(string_split(text, chr(10))))) AS line FROM raw),
counted AS (SELECT doc_id, t, line, md5(c) AS h, len(regexp_extract_all(c, '[^\x20\x09-\x0D]+')) AS words FROM split),
lines AS MATERIALIZED (
  SELECT *, row_number() OVER o AS seq, (sum(words) OVER o - words)::BIGINT AS ahead FROM counted WHERE words > 0
  WINDOW o AS (PARTITION BY doc_id, t ORDER BY line ROWS UNBOUNDED PRECEDING)),
grams AS MATERIALIZED (
  SELECT doc_id, t, seq, md5(array_to_string(list(h) OVER g, '')) AS gram, sum(words) OVER g AS gram_words, min(h || lpad(seq::VARCHAR, 10, '0')) OVER g AS least
  FROM lines WINDOW g AS (PARTITION BY doc_id, t ORDER BY ahead RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING)),
chosen AS (SELECT DISTINCT doc_id, t, substr(least, 33)::BIGINT AS seq FROM grams WHERE gram_words >= 20),
prints AS MATERIALIZED (SELECT g.doc_id, g.t, g.seq, g.gram FROM grams g JOIN chosen c ON c.doc_id IS NOT DISTINCT FROM g.doc_id AND c.t = g.t AND c.seq = g.seq WHERE g.gram_words >= 20),
ranked AS (SELECT *, row_number() OVER (PARTITION BY gram ORDER BY doc_id NULLS LAST, t, seq) AS r FROM prints),
matches AS MATERIALIZED (
  SELECT b.doc_id, b.t, b.seq, a.doc_id AS a_id, a.t AS a_t, b.seq - a.seq AS shift FROM ranked b JOIN ranked a ON a.gram = b.gram AND a.r = 1 WHERE b.r > 1),
pairs AS (SELECT DISTINCT doc_id, t, a_id, a_t, shift FROM matches),
equal AS (
  SELECT p.*, b.seq, b.line, b.ahead, b.words, b.seq - row_number() OVER (PARTITION BY p.doc_id, p.t, p.a_id, p.a_t, p.shift ORDER BY b.seq) AS island
  FROM pairs p JOIN lines b ON b.doc_id IS NOT DISTINCT FROM p.doc_id AND b.t = p.t
  JOIN lines a ON a.doc_id IS NOT DISTINCT FROM p.a_id AND a.t = p.a_t AND a.seq = b.seq - p.shift AND a.h = b.h),
runs AS (
  SELECT doc_id, t, a_id, a_t, shift, island, min(seq) AS s, max(seq) AS e, min(line) AS first_line, max(line) AS last_line, max(ahead + words) - min(ahead) AS n_words
  FROM equal GROUP BY ALL),
found AS MATERIALIZED (
  SELECT DISTINCT r.doc_id, r.t, r.s, r.e, r.first_line::BIGINT AS first_line, r.last_line::BIGINT AS last_line, r.n_words::BIGINT AS n_words, r.a_id AS source_doc_id, r.shift, r.a_t
  FROM runs r JOIN matches m ON m.doc_id IS NOT DISTINCT FROM r.doc_id AND m.t = r.t AND m.a_id IS NOT DISTINCT FROM r.a_id AND m.a_t = r.a_t AND m.shift = r.shift AND m.seq BETWEEN r.s AND r.e),
shortest AS MATERIALIZED (
  SELECT doc_id, t, seq AS s, max(seq) OVER f AS e, md5(array_to_string(list(h) OVER f, '')) AS gram, sum(words) OVER f AS n FROM lines
  WINDOW f AS (PARTITION BY doc_id, t ORDER BY ahead RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING)
  UNION SELECT doc_id, t, min(seq) OVER u, seq, md5(array_to_string(list(h) OVER u, '')), sum(words) OVER u FROM lines
  WINDOW u AS (PARTITION BY doc_id, t ORDER BY ahead + words RANGE BETWEEN 19 PRECEDING AND CURRENT ROW)),
placed AS (
  SELECT *, row_number() OVER p AS r, first_value(doc_id) OVER p AS a_id, first_value(t) OVER p AS a_t, s - first_value(s) OVER p AS shift
  FROM shortest WHERE e > s AND n >= 20 WINDOW p AS (PARTITION BY gram ORDER BY doc_id NULLS LAST, t, s)),
bare AS MATERIALIZED (
  SELECT l.doc_id, l.t, l.seq FROM lines l LEFT JOIN found f ON f.doc_id IS NOT DISTINCT FROM l.doc_id AND f.t = l.t AND l.seq BETWEEN f.s AND f.e WHERE f.s IS NULL),
later AS (
  SELECT DISTINCT p.doc_id, p.t, p.a_id, p.a_t, p.shift, p.s, p.e FROM placed p JOIN bare b ON b.doc_id IS NOT DISTINCT FROM p.doc_id AND b.t = p.t AND b.seq BETWEEN p.s AND p.e WHERE p.r > 1),
reached AS (SELECT *, max(e) OVER (PARTITION BY doc_id, t, a_id, a_t, shift ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM later),
numbered AS (SELECT *, sum(CASE WHEN s <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, t, a_id, a_t, shift ORDER BY s, e) AS run FROM reached),
joined AS (SELECT doc_id, t, a_id, a_t, shift, run, min(s) AS s, max(e) AS e FROM numbered GROUP BY ALL),
more AS (
  SELECT j.doc_id, x.line::BIGINT AS first_line, y.line::BIGINT AS last_line, (y.ahead + y.words - x.ahead)::BIGINT AS n_words, j.a_id AS source_doc_id
  FROM joined j JOIN lines x ON x.doc_id IS NOT DISTINCT FROM j.doc_id AND x.t = j.t AND x.seq = j.s JOIN lines y ON y.doc_id IS NOT DISTINCT FROM j.doc_id AND y.t = j.t AND y.seq = j.e)
SELECT doc_id, first_line, last_line, n_words, source_doc_id FROM found UNION ALL SELECT * FROM more
"""

BY_QUERY = {
    "op2_near_duplicates": NEAR_DUPLICATES,
    "op3_mixing": MIXING,
    "op4_url_filter": URL_FILTER,
    "op7_decontamination": DECONTAMINATION,
    "op8_repeated_lines": REPEATED_LINES,
}
