"""SQL that DuckDB runs for the rows of the queries that it can express."""

from __future__ import annotations

from .url_filters import SUFFIXES as PUBLIC

SUFFIXES = ", ".join(f"'{s}'" for s in PUBLIC)
AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
DIGIT = "('0x' || substr(h, {i}, 5))::BIGINT"
#: Five hex digits make four base32 digits.
BASE32 = " || ".join(" || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(({DIGIT.format(i=1 + 5 * k)} >> {s}) & 31 AS BIGINT), 1)" for s in (15, 10, 5, 0)) for k in range(8))

OP1 = f"""
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first_id THEN first_id END AS refers_to, 1::BIGINT AS n_requests, 1::BIGINT AS n_metadata
FROM (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM (SELECT page_id, strlen(p) AS payload_bytes, {BASE32} AS payload_digest FROM (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS h FROM pages)))
"""

STRENGTH = """least(greatest(coalesce(CASE WHEN (sum(n*pow(k/n-m,2))-sum(m*(1-m)))/nullif(sum((n-1)*m*(1-m)),0) > 0 THEN 1/((sum(n*pow(k/n-m,2))-sum(m*(1-m)))/nullif(sum((n-1)*m*(1-m)),0))-1 ELSE 1000.0 END, 1000.0), 2.0), 1000.0)"""
UPPER = "a/(a+b) + 1.645*sqrt(a/(a+b)*(1-a/(a+b))/(a+b+1)) < 0.5"
SHRUNK = "s*m+k AS a, s*(1-m)+n-k AS b"
OP6 = rf"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://')+3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^([^/?#]*)', 1), '{AZ}', '{az}') AS host, regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
b AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS bare FROM p),
y AS (SELECT *, string_split(bare, '.') AS l, CASE WHEN len(string_split(bare, '.')) >= 2 THEN string_split(bare, '.')[-2] || '.' || string_split(bare, '.')[-1] ELSE bare END AS two, regexp_matches(bare, '^[0-9.]+$') AS num FROM b),
q AS (SELECT page_id, host, path, CASE WHEN num THEN bare WHEN two IN ({SUFFIXES}) AND len(l) >= 3 THEN l[-3] || '.' || two ELSE two END AS domain, CASE WHEN num THEN bare WHEN two IN ({SUFFIXES}) THEN two ELSE l[-1] END AS suffix FROM y),
o AS (SELECT host, domain, suffix, CASE WHEN quality=1 AND toxic=0 THEN 1 ELSE 0 END AS good FROM q JOIN labels l ON l.doc_id = TRY_CAST(nullif(regexp_extract(path, '/([0-9]+)', 1), '') AS BIGINT) WHERE host <> '' AND quality IS NOT NULL AND toxic IS NOT NULL),
h AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(good)::DOUBLE AS k FROM o GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
x AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
t AS (SELECT (coalesce(sum(k), 0)+1)/(coalesce(sum(n), 0)+2) AS m FROM x),
xs AS (SELECT x.*, t.m FROM x, t), x2 AS (SELECT xs.*, {SHRUNK} FROM xs, (SELECT {STRENGTH} AS s FROM xs)),
ds AS (SELECT d.*, a/(a+b) AS m FROM d JOIN (SELECT suffix, a, b FROM x2) USING (suffix)), d2 AS (SELECT ds.*, {SHRUNK} FROM ds, (SELECT {STRENGTH} AS s FROM ds)),
hs AS (SELECT h.*, a/(a+b) AS m FROM h JOIN (SELECT domain, a, b FROM d2) USING (domain)), h2 AS (SELECT hs.*, {SHRUNK} FROM hs, (SELECT {STRENGTH} AS s FROM hs)),
ruled AS (SELECT *, CASE WHEN (host='example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN (host='example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host='org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host='net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM q)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN coalesce((SELECT {UPPER} FROM h2 WHERE h2.host=ruled.host AND ruled.host <> ''), (SELECT {UPPER} FROM d2 WHERE d2.domain=ruled.domain AND ruled.host <> ''), (SELECT {UPPER} FROM x2 WHERE x2.suffix=ruled.suffix AND ruled.host <> ''), (SELECT {UPPER} FROM (SELECT 2*m AS a, 2-2*m AS b FROM t))) THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""

OP10 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{AZ}', '{az}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w)-3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100*n_both >= 80*(nx.n+ny.n-n_both)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce((SELECT min(y) FROM reach WHERE x = doc_id), doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id)
"""


def op9(rules, stop_words, base_words: int, base_percent: int) -> str:
    """The measures, and the table of thresholds as one condition."""
    stop = "[" + ", ".join(f"'{w}'" for w in sorted(set(stop_words))) + "]"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"
    ends = [f"{r.measure} >= {r.low}" for r in rules if r.low is not None] + [f"{r.measure} <= {r.high}" for r in rules if r.high is not None]
    removed = lambda chars: f"length(t) - length(translate(t, '{chars}', ''))"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, w[i:i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w)-1)) AS i FROM t)),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT t.doc_id, t, w, l, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, {removed('#*$%&|<>')} AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM t LEFT JOIN r USING (doc_id)),
q AS (SELECT *, word_chars/greatest(n_words, 1) AS mean_word_chars, n_symbols/greatest(n_words, 1) AS symbols_per_word, ({removed('!')})/greatest(n_words, 1) AS exclamations_per_word, ({removed(upper)})/greatest(word_chars, 1) AS upper_case_ratio,
  len(list_intersect(w, {stop})) AS n_stop_words, n_dup_lines/greatest(len(l), 1) AS dup_line_ratio, len(list_filter(l, lambda x: regexp_matches(x, '^ *[-*•]')))/greatest(len(l), 1) AS bullet_line_ratio, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…) *$')))/greatest(len(l), 1) AS ellipsis_line_ratio,
  n_words < {base_words} OR 100*n_repeat_words > {base_percent}*n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(ends)} AS kept FROM q
"""
