"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from testimony.llm.url_equivalence import CANONICAL, ENTITIES, REFRESH, REFRESH_URL, VALUE

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

CHAT = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS place FROM t),
p AS (SELECT *, string_agg(md5(role || chr(31) || text), '') OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM r),
e AS (SELECT conv_id, max(place) AS n_turns, arg_max(prefix, place) AS whole FROM p GROUP BY 1),
f AS (SELECT whole, min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS n_copies FROM e GROUP BY 1),
proper AS (SELECT DISTINCT prefix FROM p JOIN e USING (conv_id) WHERE place < n_turns),
kept AS (SELECT conv_id, n_turns, n_copies FROM f WHERE whole NOT IN (SELECT prefix FROM proper))
SELECT conv_id, place, n_turns, n_copies,
  '<|im_start|>' || replace(role, '<|im_', '<| im_') || chr(10) || replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS rendered
FROM r JOIN kept USING (conv_id)
"""


def _repeats(n: int) -> str:
    """Words and characters inside n-word windows that their text holds twice or more."""
    return f"""
g{n} AS (SELECT doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') AS k FROM d, unnest(range(1, len(w) - {n - 2})) AS u(i)),
h{n} AS (SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT doc_id, i FROM g{n} QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1), unnest(range(0, {n})) AS v(j)),
c{n} AS (SELECT doc_id, count(*) AS words, sum(length(w[pos])) AS chars FROM h{n} JOIN d USING (doc_id) GROUP BY 1)"""


REPETITION = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
l AS (SELECT doc_id, line FROM d, unnest(string_split(text, chr(10))) AS u(line) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
s AS (SELECT doc_id, line, count(*) AS n, count(*) * length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM l GROUP BY 1, 2),
m AS (SELECT doc_id, sum(n - 1) AS dup, sum(chars) FILTER (n > 1) AS chars FROM s GROUP BY 1),
{','.join(_repeats(n) for n in (3, 5, 7, 10))},
b AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(m.dup, 0) AS n_dup_lines, coalesce(c3.words, 0) AS n_repeat_words,
  coalesce(m.chars, 0) AS dup_line_chars, coalesce(c5.chars, 0) AS x5, coalesce(c7.chars, 0) AS x7, coalesce(c10.chars, 0) AS x10
  FROM d LEFT JOIN m USING (doc_id) LEFT JOIN c3 USING (doc_id) LEFT JOIN c5 USING (doc_id) LEFT JOIN c7 USING (doc_id) LEFT JOIN c10 USING (doc_id))
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, dup_line_chars::BIGINT AS dup_line_chars,
  x5::BIGINT AS chars_5, x7::BIGINT AS chars_7, x10::BIGINT AS chars_10, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * dup_line_chars > 30 * word_chars OR 100 * x5 > 30 * word_chars OR 100 * x7 > 26 * word_chars OR 100 * x10 > 20 * word_chars) AS kept
FROM b
"""

_HOST = "translate(regexp_extract({0}, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract({0}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"
_SLASHED = f"CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END"
_KEY = f"{_HOST} || ({_SLASHED}) || regexp_extract({{0}}, '^[^?#]*(\\?[^#]*)', 1)"
_RULED = """(SELECT struct_pack(rule := r.host || r.path, verdict := r.verdict) FROM rules r
  WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) ORDER BY length(r.host || r.path) DESC, r.verdict LIMIT 1)"""



def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _attribute(tag: str, name: str) -> str:
    return " || ".join(f"regexp_extract({tag}, {_sql(rf'(?i)\s{name}{VALUE}')}, {i})" for i in (2, 3, 4))


def _decoded(value: str) -> str:
    for entity, char in ENTITIES:
        value = f"replace({value}, {_sql(entity)}, {_sql(char)})"
    return rf"regexp_replace({value}, '^\s+|\s+$', '', 'g')"


def _first(tags: str, wanted: str) -> str:
    return f"list_filter(regexp_extract_all(seen, {_sql(rf'(?i)<{tags}\s[^>]*>')}), lambda t: regexp_matches(t, {_sql(wanted)}))[1]"


_FLAT = f"""CASE WHEN contains({_PATH.format('t')}, '/.') THEN array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split({_PATH.format('t')}, '/'), lambda x: [x])),
  lambda a, x: CASE WHEN x[1] = '.' THEN a WHEN x[1] = '..' THEN CASE WHEN len(a) > 1 THEN a[1:len(a) - 1] ELSE a END ELSE list_concat(a, x) END), '/')
  || CASE WHEN string_split({_PATH.format('t')}, '/')[-1] IN ('.', '..') THEN '/' ELSE '' END ELSE {_PATH.format('t')} END"""

URLS = rf"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
clear AS (SELECT url, regexp_replace(html, '(?s)<!--.*?(-->|\z)', ' ', 'g') AS seen FROM pages WHERE url LIKE '%://%'),
href AS (SELECT DISTINCT url, unnest([{_decoded(_attribute(_first("link", CANONICAL), "href"))},
  {_decoded(f"regexp_extract({_attribute(_first('meta', REFRESH), 'content')}, {_sql(REFRESH_URL)}, 1)")}]) AS h FROM clear),
found AS (SELECT url, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN h WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
  WHEN starts_with(h, '//') THEN 'http:' || h WHEN starts_with(h, '/') THEN 'http://' || {_HOST.format("url")} || h
  WHEN starts_with(h, '?') THEN 'http://' || {_HOST.format("url")} || ({_SLASHED.format("url")}) || h WHEN starts_with(h, '#') THEN url
  ELSE 'http://' || {_HOST.format("url")} || coalesce(nullif(regexp_extract({_PATH.format("url")}, '^(.*/)', 1), ''), '/') || h END AS t FROM href WHERE h <> ''),
links AS (SELECT url, regexp_extract(t, '^([^:]*://[^/?#]*)', 1) || ({_FLAT}) || regexp_extract(t, '(?s)^[^?#]*([?#].*)', 1) AS target FROM found WHERE t IS NOT NULL),
edges AS (SELECT {_KEY.format("url")} AS a, {_KEY.format("target")} AS b FROM links),
pairs AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
ends AS (SELECT url FROM links UNION SELECT target FROM links),
bad AS (SELECT {_KEY.format("url")} AS node, {_RULED} AS r FROM (SELECT url, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path FROM ends) u),
reach(node) AS (SELECT node FROM bad WHERE r.verdict = 'block' UNION SELECT b FROM reach JOIN pairs ON a = node),
u AS (SELECT page_id, url, coalesce({_HOST.format("url")}, '') AS host, coalesce({_PATH.format("url")}, '') AS path FROM pages),
v AS (SELECT u.*, {_RULED} AS r FROM u)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, CASE WHEN url LIKE '%://%' AND {_KEY.format("url")} IN (SELECT node FROM reach) THEN 'block' END, 'allow') AS verdict FROM v
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html)::BIGINT AS n, sha256(html) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS kept FROM q WHERE n >= 100 GROUP BY 1)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN kept < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN kept < page_id THEN kept END AS refers_to FROM q LEFT JOIN f USING (digest)
"""

_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAM = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_ALNUM} AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS k FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(i) WHERE len(w) > 0),
g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM d, (SELECT DISTINCT n FROM p) AS x(n), unnest(range(1, len(w) - n + 2)) AS u(i)),
h AS (SELECT doc_id, i, g.n, item FROM g JOIN p ON g.k = p.k AND g.n = p.n),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, unnest(range(0, n)) AS v(j) GROUP BY 1),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM d, unnest(range(1, len(w) - 18)) AS u(i)),
later AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM later, unnest(range(0, 20)) AS v(j)),
words AS (SELECT doc_id, pos, w[pos] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(pos)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

# CRC-32 byte by byte over a table made by its rule; runs hold characters of one or two bytes.
SPELLING = """
WITH RECURSIVE bits(i, c, n) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM bits WHERE n < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE n = 8),
runs AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY 1, 2),
coded AS (SELECT run, n, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
  lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 + (unicode(x) >> 6))::BIGINT, (128 + (unicode(x) & 63))::BIGINT] END))),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])) AS reg FROM runs, crc),
hashed AS (SELECT run, n, xor(reg, 4294967295) AS h FROM coded),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN run[:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word, n FROM hashed) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
spots AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
shorter AS (SELECT DISTINCT word, word[:i - 1] || word[i + 1:] AS less FROM spots),
holes AS (SELECT word, word[:i - 1] || chr(1) || word[i + 1:] AS hole FROM spots),
near AS MATERIALIZED (SELECT s.word AS a, w.word AS b FROM shorter s JOIN words w ON w.word = s.less UNION SELECT w.word, s.word FROM shorter s JOIN words w ON w.word = s.less
  UNION SELECT x.word, y.word FROM holes x JOIN holes y USING (hole) WHERE x.word <> y.word),
best AS (SELECT a AS word, count(*) AS n_near, min({'n': -n, 'word': b}) AS top FROM near JOIN words w ON w.word = b GROUP BY 1),
formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.n >= 2 * n THEN top.word END AS form, CASE WHEN -top.n >= 2 * n THEN -top.n END AS form_n FROM words LEFT JOIN best USING (word)),
chain(word, root) AS (SELECT word, form FROM formed WHERE form IS NOT NULL UNION SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n::BIGINT AS form_n FROM formed LEFT JOIN ends USING (word)
"""

ORACLE = {
    "op1_chat_collapse": CHAT,
    "op2_repetition": REPETITION,
    "op4_url_equivalence": URLS,
    "op5_arc_convert": WARC,
    "op6_fm_decontam": DECONTAM,
    "op8_cover_dedup": SUBSTRINGS,
    "op11_spelling_groups": SPELLING,
}
