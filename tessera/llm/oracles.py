"""DuckDB SQL with the rows of those queries that SQL can express."""

from __future__ import annotations

from tessera.llm.url_filter import ENTITIES, RULES

#: Where ``url_mirror_redirects`` leads all urls, by their paths.
MIRROR = "http://mirror.invalid"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

#: Sets of shingles joined on shingles; components by reachability.
OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [hash(array_to_string(w, ' '))]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i : i + 4], ' ')))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n_shingles FROM g),
x AS (SELECT doc_id, unnest(s) AS sh FROM g),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT i.a, i.b FROM i JOIN n p ON i.a = p.doc_id JOIN n q ON i.b = q.doc_id WHERE 100 * k >= 85 * (p.n_shingles + q.n_shingles - k)),
r(doc_id, label) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.label FROM r JOIN e ON r.doc_id = e.a),
c AS (SELECT doc_id, min(label) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)"""

OP2 = f"""SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(folded) AS text_sha256
FROM (SELECT doc_id, {_FOLDED} AS folded FROM documents) WINDOW g AS (PARTITION BY folded)"""

#: The checksum is the usual reflected CRC-32 (polynomial 0xEDB88320), byte by byte.
OP3 = """WITH tab AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_concat([n::UBIGINT], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) x(n))),
d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
c AS (SELECT d.*, (strlen(text) + 8)::BIGINT AS size, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::UBIGINT)),
  lambda c, y: xor(c >> 8, t[(xor(c, y) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM d, tab),
b AS (SELECT c.*, md5('tessera:' || coalesce(doc_id::VARCHAR, 'null') || ':' || text_crc32::VARCHAR) AS draw FROM c),
f AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY draw, doc_id, text_crc32, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS fraction FROM b),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, draw, doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END, text_crc32, size) - 1 AS place, count(*) OVER () AS n FROM f),
s AS (SELECT *, (place * 24 // n)::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, place - (shard::BIGINT * n + 23) // 24 AS slot, NULL::INT AS grown_shard, source FROM s"""


#: The base counts of the quality rules.
RULE_COUNTS = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM t, range(3) x(k) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
c AS (SELECT w.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c"""


def _op5(redirects: str = "") -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p, r: f"(({h} = '{r[1]}' OR ends_with({h}, '.{r[1]}')) AND starts_with({p}, '{r[2]}'))"
    rule = lambda h, p: "CASE " + " ".join(f"WHEN {fits(h, p, r)} THEN '{r[1]}{r[2]}'" for r in rules) + " END"
    verdict = lambda h, p: "CASE " + " ".join(f"WHEN {fits(h, p, r)} THEN '{r[0]}'" for r in rules) + " END"
    host = lambda u: f"translate(coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}')"
    path = lambda u: f"coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    form = lambda u: (
        f"'http://' || regexp_replace({host(u)}, '^www\\.', '') || regexp_replace({path(u)}, '/+$', '') || '/' || "
        f"regexp_replace(regexp_replace(regexp_extract({u}, '(?s)^.*?://[^?#]*(\\?[^#]*)', 1), '([?&])(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\\1', 'g'), '[?&]+$', '')"
    )
    link = "CASE WHEN contains(l, '://') THEN l WHEN starts_with(l, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || l WHEN starts_with(l, '/') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || '://' || {h} || l ELSE regexp_extract(url, '(?s)^(.*?)://', 1) || '://' || {h} || CASE WHEN regexp_replace({p}, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace({p}, '[^/]*$', '') END || l END".format(h=host("url"), p=path("url"))
    unescaped = "l"
    for entity, mark in ENTITIES:
        unescaped = f"replace({unescaped}, '{entity}', '{mark * 2 if mark == chr(39) else mark}')"
    return f"""WITH RECURSIVE tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\b[^>]*>')) AS tag FROM pages WHERE contains(url, '://')),
  found AS (SELECT url, CASE WHEN regexp_matches(tag, '(?i)^<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b') THEN regexp_extract(tag, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)
    WHEN regexp_matches(tag, '(?i)^<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b') THEN regexp_extract(tag, '(?i)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1) END AS l FROM tags),
  plain AS (SELECT url, {unescaped} AS l FROM found),
  links AS (SELECT DISTINCT url, {link} AS target FROM plain WHERE l <> ''{redirects}),
  urls AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT target FROM links) WHERE contains(url, '://')),
  own AS (SELECT url, {form("url")} AS target FROM urls),
  edge AS (SELECT url AS a, target AS b FROM own UNION SELECT target, url FROM own UNION SELECT url, target FROM links UNION SELECT target, url FROM links),
  node AS (SELECT a AS url FROM edge UNION SELECT b FROM edge),
  reach(url, other) AS (SELECT url, url FROM node UNION SELECT r.url, e.b FROM reach r JOIN edge e ON r.other = e.a),
  passed AS (SELECT r.url, min({verdict(host("r.other"), path("r.other"))}) AS v FROM reach r GROUP BY r.url)
  SELECT page_id, {host("p.url")} AS host, {path("p.url")} AS path, {rule(host("p.url"), path("p.url"))} AS rule,
  coalesce({verdict(host("p.url"), path("p.url"))}, passed.v, 'allow') AS verdict FROM pages p LEFT JOIN passed ON p.url = passed.url"""


OP5 = _op5()
_PATH = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
MIRRORED = _op5(f" UNION SELECT url, '{MIRROR}' || {_PATH} FROM pages WHERE {_PATH} <> ''")

ORACLE_SQL = {
    "op1_minhash_near_dedup": OP1,
    "op2_exact_dedup": OP2,
    "op3_stratified_shards": OP3,
    "op5_url_aliases": OP5,
    "quality_rule_counts": RULE_COUNTS,
    "url_mirror_redirects": MIRRORED,
}
