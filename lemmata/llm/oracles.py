"""DuckDB SQL that says what the registered queries return, for those that SQL can express. It shares nothing with them but the contract."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"'[^\x20\x09-\x0D]+'"


def _host(u: str) -> str:
    return f"translate(coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}')"


def _path(u: str) -> str:
    return f"coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _address(u: str) -> str:
    """Host, path without dot segments, query."""
    path, query = _path(u), f"regexp_extract({u}, '(?s)^.*?://[^?#]*(\\?[^#]*)', 1)"
    plain = (
        f"list_reduce(string_split({path}, '/'), lambda done, x: CASE WHEN x = '.' THEN done WHEN x = '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || x END)"
        f" || CASE WHEN regexp_matches({path}, '/\\.\\.?$') THEN '/' ELSE '' END"
    )
    path = f"CASE WHEN contains({path}, '/.') THEN {plain} WHEN {path} = '' THEN '/' ELSE {path} END"
    return f"CASE WHEN {_host(u)} <> '' THEN {_host(u)} || ({path}) || CASE WHEN {query} = '?' THEN '' ELSE {query} END END"


def _value(name: str) -> str:
    rule = f"""'(?is)[\\s"''/]{name}\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s>"'']+))'"""
    return "trim(" + " || ".join(f"regexp_extract(tag, {rule}, {i})" for i in (1, 2, 3)) + ")"


def _rules(host: str, path: str) -> tuple[str, str]:
    """Rule and verdict, the longest first."""
    rules = [("block", "example.org", "/en/1"), ("block", "example.org", "/es/"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("allow", "org", "/")]
    fits = [(f"({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}')", h + p, v) for v, h, p in rules]
    return tuple("CASE " + " ".join(f"WHEN {x[0]} THEN '{x[i]}'" for x in fits) + " END" for i in (1, 2))


OP1 = rf"""WITH RECURSIVE tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE contains(url, '://') AND html IS NOT NULL),
  targets AS (SELECT url, replace(trim(CASE WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches({_value("rel")}, '(?i)(^|\s)canonical(\s|$)') THEN {_value("href")}
    WHEN regexp_matches(tag, '(?i)^<meta') AND regexp_matches({_value("http-equiv")}, '(?i)^refresh$') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?\s*([^"''>\s]+)', 1) END), '&amp;', '&') AS t FROM tags),
  resolved AS (SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN 'x:' || t WHEN starts_with(t, '/') THEN 'x://' || {_host("url")} || t
    WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(t, '#') THEN NULL WHEN starts_with(t, '?') THEN 'x://' || {_host("url")} || {_path("url")} || t
    ELSE 'x://' || {_host("url")} || CASE WHEN contains({_path("url")}, '/') THEN regexp_extract({_path("url")}, '(?s)^(.*/)', 1) ELSE '/' END || t END AS t FROM targets WHERE t <> ''),
  edges AS (SELECT {_address("url")} AS a, {_address("t")} AS b FROM resolved), both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
  reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT node, b FROM reach JOIN both_ways ON other = a),
  told AS (SELECT node, {_rules("split_part(other, '/', 1)", "split_part(substr(other, strpos(other, '/')), '?', 1)")[1]} AS v FROM reach),
  reached AS (SELECT node FROM told GROUP BY 1 HAVING bool_or(coalesce(v = 'block', false)) AND NOT bool_or(coalesce(v = 'allow', false))),
  judged AS (SELECT page_id, {_host("url")} AS host, {_path("url")} AS path, {_address("url")} IN (SELECT node FROM reached) AS alias FROM pages)
  SELECT page_id, host, path, {_rules("host", "path")[0]} AS rule, coalesce({_rules("host", "path")[1]}, CASE WHEN alias THEN 'block' ELSE 'allow' END) AS verdict,
    CASE WHEN {_rules("host", "path")[0]} IS NOT NULL THEN 'rule' WHEN alias THEN 'alias' ELSE 'default' END AS decided_by FROM judged"""

OP3 = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD}) AS w FROM documents),
  sets AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END)) AS s FROM words),
  keyed AS MATERIALIZED (SELECT doc_id, len(s) AS n, sha256(array_to_string(s, chr(10))) AS k, s FROM sets),
  classes AS MATERIALIZED (SELECT k, any_value(s) AS s, any_value(n) AS n FROM keyed WHERE n > 0 GROUP BY k), tokens AS MATERIALIZED (SELECT k, n, md5(unnest(s)) AS t FROM classes),
  pairs AS (SELECT a.k AS a, b.k AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.k <> b.k AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY a.k, b.k, a.n, b.n
    HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
  links AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT x.k, y.k FROM keyed x JOIN keyed y ON x.doc_id = y.doc_id AND x.k <> y.k WHERE x.n > 0 AND y.n > 0),
  reach AS (SELECT k AS node, k AS other FROM classes UNION SELECT node, b FROM reach JOIN links ON other = a),
  least_id AS (SELECT k, min(doc_id) AS d FROM keyed GROUP BY 1), found AS (SELECT node, min(d) AS c FROM reach JOIN least_id ON other = k GROUP BY 1)
  SELECT doc_id, n AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept FROM keyed LEFT JOIN found ON k = node"""

OP7 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  scored AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score FROM (SELECT DISTINCT ON (vec_id) * FROM v WHERE vec_id % 50 = 0) q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e))
  SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored) WHERE r <= 5"""

OP8 = """WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
  pieces AS (SELECT r, doc_id, n, j, substr(h, 2000 * j + 1, 2198) AS p FROM (SELECT *, unnest(range(0, (n + 999) // 1000)) AS j FROM texts)),
  places AS MATERIALIZED (SELECT r, doc_id, 1000 * j + k AS i, key, b FROM (SELECT r, doc_id, j, unnest(range(0, least(1000, n - 1000 * j))) AS k,
    unnest(list_transform(range(0, least(1000, n - 1000 * j)), lambda k: CASE WHEN 1000 * j + k + 100 <= n THEN md5_number(substr(p, 2 * k + 1, 200)) END)) AS key,
    unnest(list_transform(range(0, least(1000, n - 1000 * j)), lambda k: substr(p, 2 * k + 1, 2))) AS b FROM pieces)),
  firsts AS (SELECT key, min({'d': doc_id, 'i': i}) AS f FROM places WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1),
  late AS MATERIALIZED (SELECT r, i FROM places JOIN firsts USING (key) WHERE {'d': doc_id, 'i': i} > f),
  marked AS (SELECT p.r, p.i, b, count(late.i) OVER (PARTITION BY p.r ORDER BY p.i ROWS 99 PRECEDING) > 0 AS gone FROM places p LEFT JOIN late ON p.r = late.r AND p.i = late.i),
  spans AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS head FROM marked),
  kept AS (SELECT r, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS h FROM spans GROUP BY r)
  SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256 FROM texts LEFT JOIN kept USING (r)"""

OP9 = f"""WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
  places AS MATERIALIZED (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM texts),
  windows AS MATERIALIZED (SELECT r, i, md5_number(array_to_string(w[i:i + 34], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM texts)),
  again AS MATERIALIZED (SELECT r, i FROM windows WHERE k IN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1)),
  marked AS (SELECT p.r, p.i, word, count(again.i) OVER (PARTITION BY p.r ORDER BY p.i ROWS 34 PRECEDING) > 0 AS gone FROM places p LEFT JOIN again ON p.r = again.r AND p.i = again.i),
  kept AS (SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM marked GROUP BY r)
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (r)"""

ORACLE_SQL = {"op1_url_filters": OP1, "op3_min_max_near_dedup": OP3, "op7_cover_tree_top_k": OP7, "op8_suffix_array_dedup": OP8, "op9_substring_dedup": OP9}
