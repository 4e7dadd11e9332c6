"""DuckDB SQL for the queries of this subpackage, over whole tables.

Token encoding has none.
"""

from __future__ import annotations

URL_FILTER = """
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(rule, rhost, rpath, v) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
j AS (
  SELECT u.*, r.rule, r.v, row_number() OVER (PARTITION BY page_id, u.host, u.path ORDER BY length(rule) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM j WHERE k = 1
"""

DECONTAMINATION = r"""
WITH fold(f, t) AS (VALUES ('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), f, t), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, fold),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), f, t), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, fold),
bw AS (SELECT item_id, w[i:i + 9] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(g) AS n FROM bw),
dw AS (SELECT doc_id, i, n, w[i:i + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""

# Equal texts and all pairs that share a run of five words; classes by walking links.
NGRAM_JOIN = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT w, min(doc_id) AS rep, count(*) AS copies FROM d GROUP BY w),
g AS (SELECT DISTINCT rep, w[i:i + 4] AS g FROM (SELECT rep, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM t WHERE len(w) > 0)),
s AS (SELECT rep, count(*) AS n FROM g GROUP BY rep),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM g a JOIN g b USING (g) WHERE a.rep <> b.rep GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.rep = a JOIN s y ON y.rep = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
c(rep, m) AS (SELECT rep, rep FROM t UNION SELECT l.b, c.m FROM c JOIN l ON l.a = c.rep WHERE c.m < l.b),
k AS (SELECT rep, min(m) AS class_id FROM c GROUP BY rep),
n AS (SELECT a AS rep, count(*) AS n, sum(copies) AS docs FROM l JOIN t ON rep = b GROUP BY a)
SELECT d.doc_id, CASE WHEN len(d.w) = 0 THEN d.doc_id ELSE class_id END AS class_id, CAST(CASE WHEN len(d.w) = 0 THEN 0 ELSE copies - 1 + coalesce(docs, 0) END AS BIGINT) AS n_links, CAST(coalesce(n, 0) AS BIGINT) AS n_text_links
FROM d JOIN t USING (w) JOIN k USING (rep) LEFT JOIN n USING (rep)
"""


def _spans(kind: str, pattern: str, valid: str = "true") -> str:
    """Places by the text between matches: (doc_id, kind, s, e, v, text nearby on both sides)."""
    return f"""{kind}_m AS (SELECT doc_id, m, string_split_regex(body, '{pattern}') AS gaps FROM (SELECT doc_id, body, regexp_extract_all(body, '{pattern}') AS m FROM t) WHERE len(m) > 0),
{kind}_s AS (SELECT doc_id, '{kind}' AS kind, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, m[i] AS v, right(gaps[i], 48) AS b, left(gaps[i + 1], 48) AS a
  FROM (SELECT doc_id, m, gaps, unnest(range(1, len(m) + 1)) AS i FROM {kind}_m)),
{kind} AS (SELECT doc_id, kind, s, s + length(v) AS e, v, a, b FROM {kind}_s WHERE {valid})"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({_DIGITS})[i] AS INTEGER) ELSE (CAST(reverse({_DIGITS})[i] AS INTEGER) * 2) // 10 + (CAST(reverse({_DIGITS})[i] AS INTEGER) * 2) % 10 END)) % 10 = 0"
_TEXT = "t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)"
_COUNT = "CAST(count(*) FILTER (kind = '{0}') AS BIGINT) AS n_{0}"
_LIST = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY {0}) FILTER (kind IS NOT NULL), '')"

_CODE = "list_reduce(list_transform(string_split(substr(x, 5) || left(x, 4), ''), lambda c: CASE WHEN ord(c) < 58 THEN ord(c) - 48 ELSE ord(c) - 55 END), lambda m, c: (m * CASE WHEN c < 10 THEN 10 ELSE 100 END + c) % 97, 0)"
_MOD97 = f"(SELECT {_CODE} FROM (SELECT replace(v, ' ', '') AS x)) = 1"
PII = f"""
WITH {_TEXT},
{_spans('email', r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')},
{_spans('ip', r'[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+', "len(list_filter(string_split(v, '.'), lambda p: TRY_CAST(p AS HUGEINT) > 255 OR TRY_CAST(p AS HUGEINT) IS NULL)) = 0")},
{_spans('card', r'[0-9](?:[\x20-]?[0-9])+', f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}")},
{_spans('phone', r'\+[0-9][\x20().0-9-]+[0-9]', f"length({_DIGITS}) BETWEEN 8 AND 15")},
{_spans('iban', r'\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b', _MOD97)},
{_spans('ssn', r'[0-9-]{11,}', "regexp_full_match(v, '[0-9]{3}-[0-9]{2}-[0-9]{4}')")},
k(kind, rank, least, proposed, speaks) AS (VALUES ('email', 1, 0, 80, '(?i)(?:mail|contact|write)'), ('ip', 2, 0, 60, '(?i)(?:(?:^|[^a-z])ip(?:[^a-z]|$)|address|host|server)'),
  ('card', 3, 0, 80, '(?i)(?:card|visa|credit|payment)'), ('phone', 4, 0, 50, '(?i)(?:phone|call|tel|mobile|fax)'), ('iban', 5, 60, 70, '(?i)(?:iban|account|bank)'), ('ssn', 6, 60, 30, '(?i)(?:ssn|social security)')),
f AS (FROM email UNION ALL FROM ip UNION ALL FROM card UNION ALL FROM phone UNION ALL FROM iban UNION ALL FROM ssn),
g AS (SELECT doc_id, kind, rank, s, e, least, least(proposed + CASE WHEN regexp_matches(b, speaks) OR regexp_matches(a, speaks) THEN 30 ELSE 0 END
        - CASE WHEN regexp_matches(b, '(?i)(?:version|isbn|order|serial|build)') OR regexp_matches(a, '(?i)(?:version|isbn|order|serial|build)') THEN 30 ELSE 0 END, 100) AS score FROM f JOIN k USING (kind)),
a AS (FROM g WHERE score >= least)
SELECT t.doc_id, {', '.join(_COUNT.format(k) for k in ('email', 'ip', 'card', 'phone'))}, sha256({_LIST.format("rank, s").replace("kind IS NOT NULL", "rank <= 4")}) AS base_sha256, {_LIST.format("rank, s")} AS spans,
       coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY rank, s), '') AS scores
FROM t LEFT JOIN a USING (doc_id) GROUP BY t.doc_id
"""

_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?(?:[A-Za-z0-9+/_.=-]+)"
_GROUP = r"regexp_extract(v, '(?i:password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)', 1)"
SECRETS = f"""
WITH {_TEXT},
{_spans('assign', _ASSIGN, f"length({_GROUP}) >= 6")},
{_spans('access', r'AKIA[A-Z0-9]+', "length(v) >= 20")},
{_spans('hex', r'[0-9a-f]+', "length(v) >= 24")},
{_spans('private_key', r'-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----')},
{_spans('git_token', r'gh[pousr]_[A-Za-z0-9]{36,}')},
{_spans('chat_token', r'xox[abprs]-[A-Za-z0-9-]{10,}')},
{_spans('web_token', r'eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}')},
a AS (SELECT *, list_position(['assign','access','hex','private_key','git_token','chat_token','web_token'], kind) AS rank
      FROM (FROM assign UNION ALL FROM access UNION ALL FROM hex UNION ALL FROM private_key UNION ALL FROM git_token UNION ALL FROM chat_token UNION ALL FROM web_token))
SELECT t.doc_id, {', '.join(_COUNT.format(k) for k in ('assign', 'access', 'hex'))}, sha256({_LIST.format("s, rank").replace("kind IS NOT NULL", "rank <= 3")}) AS base_sha256, {_LIST.format("s, rank")} AS spans
FROM t LEFT JOIN a USING (doc_id) GROUP BY t.doc_id
"""

# A document counts by its whole text, as in the query; a line's first holder keeps it.
QUALITY = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS body FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(body, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM t),
g AS (SELECT r, i, w[i:i + 4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
dup AS (SELECT r, i FROM g JOIN (SELECT r, g FROM g GROUP BY ALL HAVING count(*) > 1) USING (r, g)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY r),
ln AS (SELECT r, doc_id, host, body, unnest(string_split(body, chr(10))) AS line FROM t),
dl AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY r),
nl AS (SELECT r, doc_id, host, body, trim(lower(regexp_replace(line, '[ \t\x0B\f\r]+', ' ', 'g'))) AS line FROM ln),
hosts AS (SELECT host, count(DISTINCT body) AS n FROM t GROUP BY host),
freq AS (SELECT host, line, arg_min(body, doc_id) AS first FROM nl JOIN hosts USING (host) WHERE line <> '' GROUP BY host, line, n HAVING count(DISTINCT body) >= 5 AND count(DISTINCT body) > 0.01 * n),
lost AS (SELECT r, sum(length(line)) AS total, sum(CASE WHEN f.line IS NULL OR first = body THEN 0 ELSE length(nl.line) END) AS gone FROM nl LEFT JOIN freq f USING (host, line) WHERE nl.line <> '' GROUP BY r),
f AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(gone, 0) AS gone, coalesce(total, 0) AS total
      FROM t JOIN w USING (r) LEFT JOIN dl USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND (gone = 0 OR 1 - gone::DOUBLE / total >= 0.3) AS kept
FROM f
"""

# The capacity by binary search over greedy walks, the checksum by its table: some twenty seconds for two megabytes of text.
SHARDING = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS h, strlen(coalesce(text, '')) + 1 AS size FROM documents),
g AS (SELECT h, any_value(t) AS t, sum(size) AS size FROM d GROUP BY h),
e AS (SELECT h, t, size, CAST(sum(size) OVER (ORDER BY h) AS BIGINT) AS e FROM g),
l AS (SELECT list(e ORDER BY e) AS ends, max(e) AS total, CAST(max(size) AS BIGINT) AS largest FROM e),
s(lo, hi) AS (
  SELECT greatest(largest, (total + 15) // 16), total FROM l
  UNION ALL
  SELECT CASE WHEN fits THEN lo ELSE mid + 1 END, CASE WHEN fits THEN mid ELSE hi END
  FROM (SELECT lo, hi, (lo + hi) // 2 AS mid, list_reduce(range(16), lambda a, k: coalesce(list_max(list_filter(ends, lambda x: x <= a + (lo + hi) // 2)), 0), 0::BIGINT) >= total AS fits FROM s, l WHERE lo < hi)),
cap AS (SELECT lo AS c FROM s WHERE lo = hi),
cut(k, z) AS (SELECT 0, 0::BIGINT UNION ALL SELECT k + 1, (SELECT max(e) FROM e WHERE e <= z + c) FROM cut, cap, l WHERE z < total),
tab AS (SELECT list(v ORDER BY n) AS tab FROM (SELECT n, list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n) AS v FROM range(256) r(n))),
crc AS (SELECT h, xor(list_reduce(list_transform(range(0, strlen(t)), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS crc FROM (SELECT h, t, hex(encode(t)) AS x FROM e), tab),
p AS (SELECT doc_id, d.h, d.size, (SELECT count(*) FROM cut, l WHERE k > 0 AND z < total AND z <= e.e - e.size) AS shard FROM d JOIN e USING (h))
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p JOIN crc USING (h)
"""

# Base32 by groups of five hex digits, which are four digits of five bits.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((CAST('0x' || substr(x, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1]), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""

# For pages with one article of headings and paragraphs, and the few character references of the test tables.
HTML_TEXT = r"""
WITH a AS (SELECT page_id, url, replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '<br>', ' ') AS body FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(?:p|h1)>'), lambda x: regexp_replace(x, '<[^>]+>', '', 'g')) AS parts FROM a),
c AS (SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g')) AS parts FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""

# Runs as islands of equal five-word windows at one distance; a run inside one of a smaller period has that period.
PERIODIC_RUNS = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, CAST(doc_id AS VARCHAR) AS s, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tab AS (SELECT list(v ORDER BY n) AS tab FROM (SELECT n, list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n) AS v FROM range(256) r(n))),
c AS (SELECT r, doc_id, w, len(w) AS n, xor(list_reduce(list_transform(range(0, length(s)), lambda i: CAST(ord(s[i + 1]) AS BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM t, tab),
a AS (SELECT *, h // 10 AS g, (h // 10) % greatest(n, 1) AS a FROM c),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
f AS (SELECT r, n, i, w[i + 1:i + 5] AS g FROM (SELECT r, n, w, unnest(range(0, n - 4)) AS i FROM d WHERE n >= 6)),
e AS (SELECT x.r, y.i - x.i AS q, x.i FROM f x JOIN f y ON x.r = y.r AND x.g = y.g AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
k AS (SELECT r, q, min(i) AS start, count(*) + 4 + q AS length FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e) GROUP BY r, q, island HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
m AS (SELECT r, q, start, length FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.r = k.r AND o.q < k.q AND o.start <= k.start AND o.start + o.length >= k.start + k.length)),
s AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines, arg_min({'s': start, 'l': length, 'q': q}, {'o': -length / q, 's': start, 'q': q}) AS best FROM m GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM m),
left_over AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS body FROM (SELECT r, w[i + 1] AS word, i FROM (SELECT r, w, unnest(range(0, n)) AS i FROM d)) LEFT JOIN gone USING (r, i) WHERE gone.i IS NULL GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period, CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM d LEFT JOIN s USING (r) LEFT JOIN left_over USING (r)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": URL_FILTER,
    "op2_decontamination": DECONTAMINATION,
    "op3_sharding": SHARDING,
    "op4_warc": WARC,
    "op5_ngram_join": NGRAM_JOIN,
    "op6_html_text": HTML_TEXT,
    "op7_pii": PII,
    "op8_secret_scan": SECRETS,
    "op9_quality_rules": QUALITY,
    "op11_periodic_runs": PERIODIC_RUNS,
}
