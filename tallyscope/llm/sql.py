"""SQL twins (DuckDB) of the corpus queries that SQL can express."""

from __future__ import annotations

LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
HOST = LOW.format(r"coalesce(regexp_extract({url}, '^(?s:.*?)://([^/?#]*)', 1), '')")
PATH = r"coalesce(regexp_extract({url}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '')"
KEY = (
    r"CASE WHEN contains({url}, '://') THEN "
    + LOW.format(r"regexp_extract({url}, '^((?s:.*?)://[^/?#]*)([^#]*)', 1)")
    + r" || regexp_extract({url}, '^((?s:.*?)://[^/?#]*)([^#]*)', 2) END"
)

OP1 = rf"""
WITH RECURSIVE rules(action, host, path) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
tags AS (
  SELECT url, unnest([
    regexp_extract(regexp_extract(html, '(?i)<link\b[^<>]*\brel\s*=\s*["'']?canonical\b[^<>]*>'), '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?i)<meta\b[^<>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^<>]*>'), '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)
  ]) AS target FROM pages),
resolved AS (
  SELECT url, CASE WHEN contains(target, '://') THEN target
    WHEN starts_with(target, '//') THEN regexp_extract(url, '^([^:/?#]+):', 1) || ':' || target
    WHEN starts_with(target, '/') THEN regexp_extract(url, '^((?s:.*?)://[^/?#]*)', 1) || target END AS target
  FROM tags WHERE target <> ''),
links AS (
  SELECT DISTINCT a, b FROM (SELECT {KEY.format(url="url")} AS a, {KEY.format(url="target")} AS b FROM resolved)
  WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS other FROM ends UNION SELECT r.node, e.b FROM reach r JOIN ends e ON r.other = e.a),
urls AS (
  SELECT page_id, {KEY.format(url="url")} AS key, {HOST.format(url="url")} AS host, {PATH.format(url="url")} AS path FROM pages
  UNION ALL BY NAME SELECT NULL AS page_id, key, {HOST.format(url="key")} AS host, {PATH.format(url="key")} AS path
  FROM (SELECT DISTINCT other AS key FROM reach)),
judged AS (
  SELECT u.*, (SELECT r.host || r.path FROM rules r WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
      ORDER BY length(r.host || r.path) DESC LIMIT 1) AS rule,
    (SELECT r.action FROM rules r WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
      ORDER BY length(r.host || r.path) DESC LIMIT 1) AS action
  FROM urls u),
spread AS (
  SELECT r.node FROM reach r JOIN (SELECT key, min(action) AS action FROM judged GROUP BY key) j ON r.other = j.key
  GROUP BY r.node HAVING bool_or(j.action = 'block') AND NOT coalesce(bool_or(j.action = 'allow'), false))
SELECT page_id, host, path, rule,
  coalesce(action, CASE WHEN key IN (SELECT node FROM spread) THEN 'block' END, 'allow') AS verdict
FROM judged WHERE page_id IS NOT NULL
"""

OP2 = rf"""
WITH plain AS (
  SELECT row_number() OVER () AS rid, page_id, {HOST.format(url="url")} AS host,
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'),
      '(?i)</?(?:p|li|ul|ol|br|div|nav|h[1-6]|article|footer|header|section|title|table|tr|td|th|body|head|html)(?:[\s/][^<>]*)?>', chr(10), 'g'),
      '<[^<>]*>', '', 'g') AS text
  FROM pages),
parsed AS (
  SELECT rid, page_id, host, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM plain),
totals AS (SELECT host, count(*) AS n_pages FROM parsed GROUP BY host),
seen AS (SELECT DISTINCT rid, host, unnest(lines) AS line FROM parsed),
common AS (
  SELECT host, line FROM seen JOIN totals USING (host) GROUP BY host, line, n_pages HAVING count(*) > 0.5 * n_pages),
drops AS (SELECT rid, list(line) AS gone FROM seen JOIN common USING (host, line) GROUP BY rid),
kept AS (
  SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), x)) AS stay
  FROM parsed LEFT JOIN drops USING (rid))
SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(stay) AS n_dropped, array_to_string(stay, chr(10)) AS text FROM kept
"""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP5 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, {WORDS.format(LOW.format("coalesce(text, '')"))} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
items AS (SELECT doc_id, unnest(s) AS item FROM sets),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM items x JOIN items y ON x.item = y.item AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sets p ON a = p.doc_id JOIN sets q ON b = q.doc_id WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)),
reach AS (SELECT doc_id AS node, doc_id AS other FROM sets UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT doc_id, len(s) AS n_shingles, (SELECT min(other) FROM reach WHERE node = doc_id) AS component_id FROM sets
"""

OP8 = rf"""
WITH sized AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")}) AS size, md5(doc_id::varchar) AS ord FROM documents),
per AS (SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0::double, 2.0::double, 1.0::double][(rank % 3 + 1)::int] AS weight, source_size * 2.0::double AS cap FROM per),
levels AS (
  SELECT *, cap / weight AS ratio,
    (sum(source_size) OVER () * 1.5::double - coalesce(sum(cap) OVER before, 0.0::double))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0::double)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, rank, source_size, CASE WHEN f.level IS NULL OR ratio <= f.level THEN cap ELSE weight * f.level END AS target
  FROM levels CROSS JOIN (SELECT min({{'ratio': ratio, 'rank': rank, 'level': level}}).level AS level FROM levels WHERE ratio > level) f),
placed AS (
  SELECT s.*, t.source_size, t.target, t.rank, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY ord, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, CASE WHEN size > 0 THEN (start + size / 2.0::double <= target)::int + (start + source_size + size / 2.0::double <= target)::int ELSE 0 END AS copies,
    least(start / target, 1.0::double) AS share, [1.5::double, 1.0::double, 0.5::double][(rank % 3 + 1)::int] AS a,
    [0.5::double, 1.0::double, 1.5::double][(rank % 3 + 1)::int] AS b
  FROM placed)
SELECT doc_id, size::bigint AS size, source_size, target, (copies * size)::bigint AS taken,
  CASE WHEN copies > 0 THEN least(CASE WHEN share <= 0 THEN 0.0::double
    ELSE 2.0::double * share / (a + sqrt(greatest(a * a + 2.0::double * (b - a) * share, 0.0::double))) END, 1.0::double) END AS position
FROM taken
"""

OP9 = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
groups AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM texts JOIN groups USING (body)
"""

TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".replace("{}", LOW)

OP11 = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {TERMS.format("coalesce(text, '')")} AS terms FROM documents),
items AS (SELECT row_number() OVER () AS item, item_id, {TERMS.format("coalesce(text, '')")} AS terms FROM benchmark),
stats AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS big_n, sum(len(terms))::bigint AS big_l FROM docs),
wanted AS (SELECT item, item_id, term, count(*) AS often FROM (SELECT item, item_id, unnest(terms) AS term FROM items) GROUP BY ALL),
postings AS (
  SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)::double))::bigint AS w FROM postings, stats GROUP BY term, big_n),
scored AS (
  SELECT item, item_id, rid, doc_id, sum(often * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::bigint AS score
  FROM wanted JOIN postings USING (term) JOIN weights USING (term), stats GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::int AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def _ball_kmeans(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """Plain k-means on the same integers, a pair of steps for each round."""
    far = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) AS x FROM embeddings "
        f"WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM kept ORDER BY h LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"a{i} AS MATERIALIZED (SELECT v.rid, v.vec_id, min({{'d': {far}, 'c': c.c}}) AS best FROM kept v, c{i} c GROUP BY v.rid, v.vec_id)"
        )
        if i < rounds:
            steps.append(
                f"m{i} AS MATERIALIZED (SELECT c, list(floor(s / n)::bigint ORDER BY p) AS x FROM (SELECT a.best.c AS c, p, sum(v.x[p])::double AS s, count(*)::double AS n "
                f"FROM a{i} a JOIN kept v USING (rid), range(1, {dims} + 1) r(p) GROUP BY ALL) GROUP BY c), "
                f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.x, o.x) AS x FROM c{i} o LEFT JOIN m{i} m USING (c))"
            )
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, best.c::int AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::bigint AS cluster_inertia, sum(best.d) OVER ()::bigint AS inertia,
  sha256(array_to_string(f.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} f ON a.best.c = f.c
"""
    )


OP12 = _ball_kmeans()

SQL = {
    "op1_url_filter": OP1,
    "op2_line_dedup": OP2,
    "op5_ngram_join": OP5,
    "op8_source_mix": OP8,
    "op9_exact_dedup": OP9,
    "op11_ranked_search": OP11,
    "op12_ball_kmeans": OP12,
}
