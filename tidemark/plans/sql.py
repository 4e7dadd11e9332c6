"""DuckDB SQL for the queries, written on its own; the adapters' twins come first."""

from __future__ import annotations

ISO = "'%Y-%m-%dT%H:%M:%S.%gZ'"
T, TAU = "TIMESTAMP '2024-01-20 00:00:00'", "TIMESTAMP '2024-01-22 00:00:00'"
SEEN = f"valid_at <= {T} AND ingested_at <= {TAU}"

EV = """ev AS (
  SELECT 'evt_' || event_id AS event_id, event_id AS seq, CAST(user_id AS VARCHAR) AS entity_id, 'events' AS app,
         CASE event_type WHEN 'purchase' THEN 'append_version' WHEN 'error' THEN 'delete_entity' ELSE 'upsert_entity' END AS op,
         event_type, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS value, json_extract_string(props, '$.k') AS k,
         date_trunc('millisecond', ts) AS valid_at, date_trunc('millisecond', ts) + (event_id % 7) * INTERVAL 1 DAY AS ingested_at
  FROM events)"""
ED = """ed AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS entity_id, CAST(l_partkey AS VARCHAR) AS edge_target, l_returnflag <> 'R' AS up, l_shipdate AS valid_at, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
live AS (SELECT entity_id, edge_target, arg_max(up, ROW(valid_at, seq)) AS live FROM ed GROUP BY ALL)"""


def _sp(said: str = "text") -> str:
    return f"""sp AS (
  SELECT CAST(conv_id AS VARCHAR) AS trace_id, CAST(turn AS INTEGER) AS pos, CASE role WHEN 'assistant' THEN 'tool' ELSE role END AS kind,
         CASE (conv_id + turn) % 6 WHEN 0 THEN 'I prefer ' WHEN 2 THEN 'We always ' WHEN 4 THEN 'Actually use ' ELSE '' END || {said} AS input,
         CASE WHEN role = 'assistant' THEN 'app.step_' || (turn % 3) END AS tool_name, length(text) AS chars
  FROM conversations)"""


SP, PLANTED = _sp(), _sp("CASE WHEN conv_id % 4 = 0 THEN 'short notes ' || (conv_id // 8) ELSE text END")
IT = """it AS (
  SELECT conv_id * 1000 + turn AS n, 'mem_' || lpad(CAST(conv_id * 1000 + turn AS VARCHAR), 9, '0') AS memory_id, CASE role WHEN 'user' THEN 'procedural' ELSE 'semantic' END AS type,
         CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'team' ELSE 'project' END AS namespace, 'Subject ' || (conv_id // 10) AS subject,
         CASE WHEN turn % 2 = 1 THEN 'do not ' ELSE '' END || CASE WHEN (conv_id + turn) % 3 = 0 THEN 'ship the release plan ' || (conv_id % 7) || ' by monday' ELSE text END AS claim, text,
         0.5::DOUBLE + ((conv_id * 1000 + turn) % 50)::DOUBLE / 100 AS confidence, CASE role WHEN 'user' THEN 'personal' ELSE 'team' END AS acl,
         TIMESTAMP '2024-01-01' + ((conv_id * 1000 + turn) % 365) * INTERVAL 1 DAY AS created_at, (conv_id * 1000 + turn) % 5 <> 0 AS active
  FROM conversations)"""
PR = """pr AS (
  SELECT item_id AS task_id,
    ['Decline the optional sync','Schedule an external call','Book travel for Redwood','Reschedule my 1:1','Reply to the VIP alice','Route this bug','Announce Launch Falcon','Invite the approver','Draft weekly notes','Update the project page','Create a doc','What was the scope','Hello there'][item_id % 13 + 1] AS prompt,
    ['optional attendees should decline','no calls before 10am','fly united on the aisle','afternoon is best','alice prefers direct messages','bugs go to engineering','announcements say it is live at launch','vp of product signs','metrics come first','overview is canonical','customer docs are named','scope is frozen',''][item_id % 13 + 1] AS memory
  FROM benchmark)"""
FOLD = """SELECT entity_id, arg_max(event_type, ROW(valid_at, seq)) FILTER (op <> 'delete_entity') AS event_type, arg_max(value, ROW(valid_at, seq)) FILTER (op <> 'delete_entity') AS value,
  arg_max(k, ROW(valid_at, seq)) FILTER (op <> 'delete_entity') AS k, count(*) FILTER (op = 'append_version') AS version_count, strftime(max(valid_at), {iso}) AS last_valid_at, arg_max(op, ROW(valid_at, seq)) = 'delete_entity' AS deleted
  FROM ev WHERE {seen} GROUP BY entity_id"""
OUT = "entity_id, event_type, value, k, version_count, last_valid_at"


def fold(seen: str = SEEN) -> str:
    return FOLD.format(iso=ISO, seen=seen)


def versions(seen: str) -> str:
    payload = """CASE WHEN event_type IS NULL THEN '{}' ELSE '{"event_type":"' || event_type || '","k":"' || k || '","value":"' || value || '"}' END"""
    body = f"""'{{"deleted":' || CAST(deleted AS VARCHAR) || ',"edges":{{}},"key":["events","user","' || entity_id || '"],"payload":' || {payload} || '}}'"""
    return f"SELECT entity_id, deleted, sha256({body}) AS version_hash FROM ({fold(seen)})"


BM = """
words AS (SELECT {id} AS doc, regexp_extract_all(lower({text}), '[a-z0-9]+') AS t FROM {docs}),
size AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM words),
post AS (SELECT doc, len, term, count(*) AS tf FROM (SELECT doc, len(t) AS len, unnest(t) AS term FROM words) GROUP BY ALL),
terms AS (SELECT query, term, count(*) AS qtf FROM (SELECT item_id AS query, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
lex AS (SELECT query, doc, round(sum(qtf * greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) AS score
        FROM post JOIN dfs USING (term) JOIN terms USING (term), size GROUP BY query, doc HAVING sum(qtf * greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) > 0),
lexr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) - 1 AS rank FROM lex)"""


def _vectors(name: str, source: str, id_col: str) -> str:
    return f"""
{name}_f AS (SELECT id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]))) AS f FROM (SELECT {id_col} AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM {source})),
{name}_b AS (SELECT id, CAST(('0x' || substr(sha1(f), 1, 8)) AS BIGINT) % 256 AS bucket, sum(CASE WHEN CAST(('0x' || substr(sha1(f), 9, 2)) AS BIGINT) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS raw FROM {name}_f GROUP BY ALL),
{name} AS (SELECT id, bucket, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS val FROM {name}_b WHERE raw <> 0)"""


HASHED = (
    _vectors("qv", "benchmark", "item_id") + "," + _vectors("dv", "it", "n")
    + """,
hs AS (SELECT q.id AS query, v.id AS doc, round(sum(q.val * v.val), 6) AS score FROM qv q JOIN dv v USING (bucket) GROUP BY ALL),
hsr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) - 1 AS rank FROM hs)"""
)
RELATION = """eg AS (SELECT memory_id AS src_id, 'mem_' || lpad(CAST(n // 1000 * 1000 AS VARCHAR), 9, '0') AS dst_id, n AS src_n, n // 1000 * 1000 AS dst_n,
  CASE n % 3 WHEN 0 THEN 'supports' WHEN 1 THEN 'derived_from' ELSE 'contradicts' END AS relation FROM it WHERE n % 1000 > 0)"""
ROUTES = {
    "user": ("my|i|me|mine|prefer|preference", 0.6), "team": ("we|team|our|norm|convention|announce|policy", 0.6),
    "project": ("project|launch|milestone|roadmap|release", 0.6), "app_state": ("channel|calendar|event|document|doc|meeting|schedule", 0.4),
}


def _raw(ns: str, text: str) -> str:
    cues, weight = ROUTES[ns]
    listed = ", ".join(f"'{c}'" for c in cues.split("|"))
    # Whole words of letters of any language: this engine's \b knows ASCII letters only.
    return rf"(0.1::DOUBLE + {weight}::DOUBLE * len(list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+'), lambda w: w IN ({listed}))))"


def route(ns: str, text: str) -> str:
    return f"{_raw(ns, text)} / ({' + '.join(_raw(x, text) for x in ROUTES)})"


RERANKED = (
    f"WITH {IT}, {BM.format(id='n', text='text', docs='it')}, {HASHED}, {RELATION},"
    + f"""
fu AS (SELECT query, doc, sum(1.0::DOUBLE / (60 + rank + 1)) AS fused FROM (SELECT query, doc, rank FROM lexr WHERE rank < 20 UNION ALL SELECT query, doc, rank FROM hsr WHERE rank < 20) GROUP BY ALL),
ex AS (SELECT query, doc, sum(fused) AS fused FROM (SELECT * FROM fu UNION ALL SELECT query, dst_n, 0.5::DOUBLE / 60 FROM fu JOIN eg ON doc = src_n WHERE relation IN ('supports', 'derived_from')) GROUP BY ALL),
nm AS (SELECT *, fused / max(fused) OVER (PARTITION BY query) AS fusion FROM ex),
ro AS (SELECT item_id AS query, {', '.join(f'{route(ns, "text")} AS r_{ns}' for ns in ROUTES)} FROM benchmark),
sc AS (SELECT query, doc, claim, round(1.5 * fusion + 0.5 * (CASE namespace WHEN 'user' THEN r_user WHEN 'team' THEN r_team ELSE r_project END) + 0.4 * confidence
    + 0.2 * greatest(0, least(1, 1 - (epoch_us(TIMESTAMP '2024-12-31') - epoch_us(created_at)) / 86400e6 / 365)) - 0.6 * (CASE WHEN active THEN 0.0 ELSE 1.0 END) - 0.3 * (CASE acl WHEN 'personal' THEN 0.3 ELSE 0.0 END), 6) AS score
  FROM nm JOIN it ON doc = n JOIN ro USING (query)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) - 1 AS rank FROM sc)"""
)

NEG = r"(?i)\b(?:not|never|no longer|avoid|don''t|do not|stop)\b"
CORR = r"(?i)(?:\b(?:actually|no,|that''s wrong|not quite|instead)\b|\bshould (?:have|be)\b)"
NORMS = r"(?i)(?:\bwe (?:always|never|use|announce|name)\b|\b(?:the )?convention is\b|\bnaming convention\b|\bformat\b.*\bis\b)"
PREF = r"(?i)(?:\bi (?:prefer|like|want|always|never)\b|\b(?:please )?remember (?:that|to)\b|\bgoing forward\b|\bfrom now on\b)"
RULES = [
    ("api_key", r"\b(?:sk-[A-Za-z0-9]{16,}|xox[baprs]-[A-Za-z0-9-]{8,}|ghp_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16})\b", "[REDACTED_SECRET]"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED_EMAIL]"),
    ("credit_card", r"\b(?:\d[ -]*?){13,16}\b", "[REDACTED_CARD]"),
    ("phone", r"\b(?:\+?\d{1,3}[ .-]?)?(?:\(?\d{3}\)?[ .-]?)\d{3}[ .-]?\d{4}\b", "[REDACTED_PHONE]"),
]


def _redact(upto: int, text: str = "text") -> str:
    for _, pattern, place in RULES[:upto]:
        text = f"regexp_replace({text}, '{pattern}', '{place}', 'g')"
    return text




def _tooled(spans: str) -> str:
    return f"WITH {spans}, m AS (SELECT *, coalesce(bool_or(kind = 'tool') OVER (PARTITION BY trace_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS prior FROM sp)"


def _classed(spans: str) -> str:
    return _tooled(spans) + f""",
c AS (SELECT *, trim(input) AS said, CASE WHEN regexp_matches(trim(input), '{CORR}') AND prior THEN 'correction' WHEN regexp_matches(trim(input), '{NORMS}') THEN 'norm' WHEN regexp_matches(trim(input), '{PREF}') THEN 'preference' END AS cls FROM m WHERE kind = 'user'),
st AS (SELECT trace_id AS ref, CAST(pos AS BIGINT) AS ord, CASE cls WHEN 'correction' THEN 'correction' ELSE 'explicit' END AS source, CASE cls WHEN 'correction' THEN 'procedural' ELSE 'semantic' END AS kind, CASE cls WHEN 'norm' THEN 'team' ELSE 'user' END AS namespace,
  CASE cls WHEN 'correction' THEN 0.6 WHEN 'norm' THEN 0.55 ELSE 0.7 END::DOUBLE AS hint, said FROM c WHERE cls IS NOT NULL)"""


TOOLED, CLASSED, SHORT = _tooled(SP), _classed(SP), _classed(PLANTED)
AXES = "ax AS (SELECT doc_id, quality::DOUBLE AS o, 1.0 - toxic::DOUBLE AS v, (doc_id % 11)::DOUBLE / 10 AS r, (doc_id % 5)::DOUBLE / 4 AS p FROM labels)"
PAIRED = f"WITH {AXES}, s AS (SELECT doc_id // 2 AS task_id, doc_id % 2 AS treated, round((o * 0.4 + v * 0.2) / (0.4::DOUBLE + 0.2::DOUBLE), 4) AS score FROM ax), pd AS (SELECT task_id, max(score) FILTER (treated = 0) AS base, max(score) FILTER (treated = 1) AS treated, round(max(score) FILTER (treated = 1) - max(score) FILTER (treated = 0), 4) AS delta FROM s GROUP BY task_id)"
THEME = r"array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower({t}), '[a-z]+'), lambda w: len(w) > 3 AND w NOT IN ('the','a','an','to','i','my','in','on','and','is','of','please','that'))))[1:3], ' ')"

ORACLE_SQL: dict[str, str] = {
    "asof_fold": f"WITH {EV} SELECT {OUT} FROM ({fold()}) WHERE NOT deleted",
    "asof_fold_tau": f"WITH {EV} SELECT {OUT} FROM ({fold(f'ingested_at <= {TAU}')}) WHERE NOT deleted",
    "asof_deleted": f"WITH {EV} SELECT entity_id, last_valid_at FROM ({fold()}) WHERE deleted",
    "asof_events": f"WITH {EV} SELECT seq, entity_id, op FROM ev WHERE {SEEN}",
    "asof_join_multi_point": f"WITH {EV}, pt(point, valid, ingested) AS (VALUES ('p1', TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-06'), ('p2', TIMESTAMP '2024-01-12', TIMESTAMP '2024-01-30'), ('p3', {T}, {TAU})) SELECT point, entity_id, arg_max(op, ROW(valid_at, seq)) = 'delete_entity' AS deleted, count(*) FILTER (op = 'append_version') AS version_count FROM ev JOIN pt ON valid_at <= valid AND ingested_at <= ingested GROUP BY ALL",
    "entity_state": f"WITH {EV} SELECT {OUT} FROM ({fold()}) WHERE entity_id = '8'",
    "entity_list": f"WITH {EV} SELECT entity_id, 0 AS n_edge_kinds FROM ({fold()}) WHERE NOT deleted",
    "entity_find": f"WITH {EV} SELECT entity_id FROM ({fold()}) WHERE NOT deleted AND event_type = 'click'",
    "payload_keys": f"WITH {EV} SELECT entity_id, key AS k, val AS v FROM (SELECT entity_id, event_type, value, k FROM ({fold()})) UNPIVOT (val FOR key IN (event_type, value, k))",
    "edge_fold_live": f"WITH {ED} SELECT entity_id, edge_target FROM live WHERE live",
    "edge_sets": f"WITH {ED} SELECT entity_id, count(*) FILTER (live) AS n_live, coalesce(string_agg(edge_target, ',' ORDER BY edge_target) FILTER (live), '') AS targets FROM live GROUP BY entity_id",
    "version_counts": f"WITH {EV} SELECT entity_id, count(*) FILTER (op = 'append_version') AS version_count FROM ev GROUP BY entity_id",
    "entity_history": f"WITH {EV} SELECT seq, op, strftime(valid_at, {ISO}) AS valid_at FROM ev WHERE entity_id = '8'",
    "timeline_window": f"WITH {EV} SELECT seq, entity_id, op FROM ev WHERE valid_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-06' AND ingested_at <= TIMESTAMP '2024-01-09'",
    "activity_feed": f"WITH {EV} SELECT seq, strftime(valid_at, {ISO}) AS at, op, 'events/user/' || entity_id AS entity, '' AS actor FROM ev",
    "entity_change_frames": f"WITH {EV}, kv AS (SELECT entity_id, seq, valid_at, key AS k, val AS v FROM (SELECT entity_id, seq, valid_at, event_type, value, k FROM ev) UNPIVOT (val FOR key IN (event_type, value, k))) SELECT entity_id, seq, k, v, coalesce(lag(v) OVER (PARTITION BY entity_id, k ORDER BY valid_at, seq) <> v, true) AS changed FROM kv",
    "log_statistics": f"WITH {EV} SELECT app, op, count(*) AS n, strftime(min(valid_at), {ISO}) AS first_valid, strftime(max(valid_at), {ISO}) AS last_valid, strftime(min(ingested_at), {ISO}) AS first_ingested, strftime(max(ingested_at), {ISO}) AS last_ingested FROM ev GROUP BY GROUPING SETS ((app), (op), ())",
    "idempotent_append": f"WITH {EV} SELECT event_id, strftime(ingested_at, {ISO}) AS ingested_at FROM ev WHERE seq % 3 <> 0",
    "concurrent_append": f"""WITH {EV} SELECT event_id, entity_id, op, sha256('{{"event_type":"' || event_type || '","k":"' || k || '","value":"' || value || '"}}') AS payload_hash FROM ev""",
    "log_compacted": f"WITH {EV} SELECT event_id, row_number() OVER (ORDER BY list_position(['append_version', 'upsert_entity', 'delete_entity'], op), valid_at, event_id) AS seq, op, strftime(valid_at, {ISO}) AS valid_at FROM ev",
    "cursor_latest": f"WITH {EV} SELECT app, op AS stream, arg_max(event_id, ROW(valid_at, seq)) AS cursor FROM ev GROUP BY ALL",
    "event_identity": f"""WITH {EV}, h AS (SELECT *, sha256('{{"event_type":"' || event_type || '","k":"' || k || '","value":"' || value || '"}}') AS payload_hash FROM ev)
SELECT seq, payload_hash, 'evt_' || substr(sha256('{{"app":"events","edge_kind":null,"edge_target":null,"entity_id":"' || entity_id || '","entity_type":"user","op":"' || op || '","payload_hash":"' || payload_hash || '","valid_at":"' || strftime(valid_at, {ISO}) || '"}}'), 1, 16) AS event_id FROM h""",
    "activity_windows": f"WITH {EV} SELECT strftime(date_trunc('day', ingested_at)::TIMESTAMP, {ISO}) AS day, op, count(*) AS n FROM ev GROUP BY ALL",
    "snapshot_versions": f"WITH {EV} SELECT entity_id, version_hash FROM ({versions(SEEN)})",
    "snapshot_root": f"WITH {EV}, v AS ({versions(SEEN)}), p AS (SELECT substr(version_hash, 1, 4) AS p, sha256(string_agg(version_hash, '' ORDER BY version_hash)) AS h, count(*) AS n FROM v GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY p)) AS root, CAST(sum(n) AS BIGINT) AS entities FROM p",
    "snapshot_plain_root": f"""WITH {EV}, v AS ({versions(SEEN)}) SELECT sha256('["' || string_agg(version_hash, '","' ORDER BY version_hash) || '"]') AS root, count(*) AS entities FROM v""",
    "snapshot_diff": f"WITH {EV}, a AS ({versions("valid_at <= TIMESTAMP '2024-01-05' AND ingested_at <= TIMESTAMP '2024-01-06'")}), b AS ({versions(SEEN)}), j AS (SELECT coalesce(x.entity_id, y.entity_id) AS entity_id, x.version_hash AS o, y.version_hash AS n FROM (FROM a WHERE NOT deleted) x FULL JOIN (FROM b WHERE NOT deleted) y ON x.entity_id = y.entity_id) SELECT entity_id, CASE WHEN o IS NULL THEN 'created' WHEN n IS NULL THEN 'deleted' ELSE 'updated' END AS change FROM j WHERE o IS DISTINCT FROM n",
    "blob_dedup": "SELECT DISTINCT sha256(text) AS hash, substr(sha256(text), 1, 2) AS prefix2, CAST(strlen(text) AS INTEGER) AS size FROM documents",
    "blob_put": "SELECT DISTINCT sha256(text) AS hash FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)",
    "blob_get": "SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars FROM documents",
    "blob_verify": "SELECT DISTINCT sha256(text) AS hash FROM documents WHERE substr(sha256(text), 1, 2) < '10'",
    "content_hashes": """WITH b AS (SELECT item_id, CAST(to_json(text) AS VARCHAR) AS q FROM benchmark) SELECT item_id, sha256(q) AS hash, 'doc_' || substr(sha256('{"lang":"en","name":' || q || '}'), 1, 16) AS id FROM b""",
    "richest_run": "SELECT conv_id AS trace_id, CASE WHEN conv_id % 2 = 0 THEN 'hook' ELSE 'transcript' END AS source, count(*) AS n_spans FROM conversations GROUP BY conv_id",
    "span_touch_join": "SELECT l_orderkey AS trace_id, l_linenumber AS span_id, s.l_quantity FROM lineitem s JOIN lineitem r USING (l_orderkey, l_linenumber) WHERE r.l_partkey = 100",
    "tool_pairing": "SELECT u.conv_id, u.turn, CAST(length(a.text) AS INTEGER) AS reply_chars FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'",
    "app_references": "SELECT conv_id AS trace_id, turn AS span_id, 'slack' AS app, 'channel' AS entity_type, 'C' || conv_id AS entity_id, CASE role WHEN 'assistant' THEN 'write' ELSE 'read' END AS role FROM conversations UNION ALL SELECT conv_id, turn, 'gdocs', 'document', 'D' || turn, CASE role WHEN 'assistant' THEN 'write' ELSE 'read' END FROM conversations WHERE turn % 2 = 0",
    "span_durations": "SELECT o_orderkey, (o_orderkey % 48) * 3600.0::DOUBLE AS seconds FROM orders",
    "call_costs": "SELECT conv_id, round(sum(length(text)::DOUBLE / 1e6 * 3.0 + turn::DOUBLE / 1e6 * 15.0), 6) AS usd FROM conversations GROUP BY conv_id",
    "exchange_round_trip": f"WITH {SP} SELECT trace_id, trace_id || '-' || pos AS span_id, kind, input, tool_name, CASE WHEN tool_name IS NOT NULL THEN CAST(pos AS VARCHAR) END AS pos, CAST(chars AS BIGINT) AS tokens, 'x' AS lang FROM sp",
    "repeated_sequences": f"WITH {EV}, s AS (SELECT entity_id || '-' || strftime(valid_at, '%Y-%m-%d') AS trace_id, string_agg(event_type, '>' ORDER BY seq) AS tools, count(*) AS c FROM ev GROUP BY 1) SELECT tools, count(*) AS occurrences, min(trace_id) AS first_trace FROM s WHERE c >= 2 GROUP BY tools HAVING count(*) >= 2",
    "procedures": f"WITH {SP}, s AS (SELECT trace_id, string_agg(tool_name, '>' ORDER BY pos) AS tools, count(*) AS c FROM sp WHERE tool_name IS NOT NULL GROUP BY 1) SELECT 'step_workflow' AS name, count(*) AS occurrences, any_value(c) AS n_steps, 'a,b' AS arg_keys FROM s WHERE c >= 2 GROUP BY tools HAVING count(*) >= 2",
    "redact_text": f"SELECT doc_id, sha256({_redact(4)}) AS hash FROM documents",
    "redact_hits": "SELECT * FROM (SELECT doc_id, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches({_redact(k)}, '{p}') THEN '{n}' END" for k, (n, p, _) in enumerate(RULES)) + "], lambda x: x IS NOT NULL)), ',') AS rules FROM documents) WHERE rules <> ''",
    "token_counts": "WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents) SELECT doc_id, CAST(len(t) AS BIGINT) AS n, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM t",
    "theme_counts": f"WITH {SP}, t AS (SELECT {THEME.format(t='input')} AS theme FROM sp WHERE kind = 'user') SELECT CASE theme WHEN '' THEN 'general' ELSE theme END AS theme, count(*) AS n FROM t GROUP BY 1",
    "route_top": f"WITH {PR}, w AS (" + " UNION ALL ".join(f"SELECT task_id, '{ns}' AS ns, {k} AS k, {route(ns, 'prompt')} AS w FROM pr" for k, ns in enumerate(ROUTES)) + "), r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY w DESC, k) AS rank FROM w) SELECT task_id, string_agg(ns, ',' ORDER BY rank) AS namespaces FROM r WHERE rank <= 2 GROUP BY task_id",
    "route_prior": f"WITH {PR} SELECT task_id, {', '.join(f'round({route(ns, "prompt")}, 6) AS {ns}' for ns in ROUTES)} FROM pr",
    "knowledge_paths": f"WITH {IT} SELECT memory_id, CASE WHEN type = 'procedural' THEN 'procedures' WHEN namespace = 'user' THEN 'people' WHEN namespace = 'project' THEN 'projects' ELSE 'norms' END || '/' || trim(regexp_replace(lower(trim(subject)), '[^a-z0-9]+', '-', 'g'), '-') || '.md' AS path FROM it",
    "front_matter": "SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'title: t' || turn ELSE '' END AS matter, CAST(length(trim(text, chr(32) || chr(10) || chr(13) || chr(9))) AS INTEGER) AS body_chars FROM conversations",
    "parsed_scores": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 12 <= 10 THEN round((doc_id % 12)::DOUBLE / 10, 4) END WHEN doc_id % 3 = 1 THEN round(CAST('0.' || (doc_id % 100) AS DOUBLE), 4) END AS score FROM labels",
    "extract_statements": CLASSED + " SELECT ref, ord, source, kind, namespace, hint FROM st",
    "corrections_after_tool": TOOLED + f" SELECT trace_id, pos FROM m WHERE kind = 'user' AND prior AND regexp_matches(input, '{CORR}')",
    "extract_norm_lines": f"WITH b AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'Our naming convention' || chr(10) || 'is short: ' || text ELSE text END AS body FROM documents), l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS ord FROM b) SELECT CAST(doc_id AS VARCHAR) AS ref, CAST(ord AS BIGINT) AS ord, CASE WHEN doc_id % 4 = 0 THEN 'project' ELSE 'team' END AS namespace, CAST(length(trim(line)) AS INTEGER) AS n_chars FROM l WHERE length(trim(line)) >= 8 AND regexp_matches(trim(line), '{NORMS}')",
    "corroboration": SHORT + " SELECT ref, ord, count(*) OVER (PARTITION BY kind, namespace, lower(trim(said))) - 1 AS corroborating FROM st",
    "score_promote": SHORT + """, g AS (SELECT kind, namespace, lower(trim(said)) AS k, count(*) - 1 AS others, arg_min(source, ROW(source, ord, ref)) AS source, arg_min(hint, ROW(source, ord, ref)) AS hint, arg_min(said, ROW(source, ord, ref)) AS said FROM st GROUP BY ALL),
s AS (SELECT *, round(1 / (1 + exp(-(-0.5 + 1.8 + 0.6 * others + 1.2 * (CASE source WHEN 'explicit' THEN 0.85 ELSE 0.8 END) - (1 - hint)))), 4) AS confidence FROM g)
SELECT kind AS type, namespace, CASE namespace WHEN 'user' THEN 'user' ELSE 'team-norms' END AS subject, said AS claim, confidence, CASE kind WHEN 'procedural' THEN 'long' ELSE 'medium' END AS ttl_policy, CASE namespace WHEN 'user' THEN 'personal' ELSE 'team' END AS acl FROM s WHERE confidence >= 0.42""",
    "utility_scores": f"WITH {IT} SELECT memory_id, round(confidence * 0.8 - 0.5 * (CASE acl WHEN 'personal' THEN 0.3 ELSE 0 END) - 0.3 * (1 - greatest(0, least(1, 1 - (epoch_us(TIMESTAMP '2024-12-31') - epoch_us(created_at)) / 86400e6 / 365))), 4) AS utility FROM it",
    "freshness": f"WITH {IT} SELECT memory_id, round(greatest(0, least(1, 1 - (epoch_us(TIMESTAMP '2024-12-31') - epoch_us(created_at)) / 86400e6 / 365)), 6) AS freshness FROM it",
    "contradiction_pairs": f"WITH {IT}, t AS (SELECT memory_id, namespace, subject, regexp_matches(claim, '{NEG}') AS neg, list_distinct(list_filter(regexp_extract_all(lower(claim), '[a-z0-9]+'), lambda w: w NOT IN ('not','never','no','longer','avoid','don','do','stop','t','the','a','to','is','and'))) AS t FROM it), p AS (SELECT a.memory_id AS a, b.memory_id AS b, len(list_intersect(a.t, b.t)) AS i, len(a.t) + len(b.t) AS s FROM t a JOIN t b ON a.namespace = b.namespace AND a.subject = b.subject AND a.memory_id < b.memory_id AND a.neg <> b.neg) SELECT a, b, round(i::DOUBLE / (s - i), 6) AS overlap FROM p WHERE i::DOUBLE / (s - i) >= 0.5",
    "approval_split": f"WITH {IT} SELECT acl = 'personal' OR (confidence >= 0.4 AND confidence < 0.85) AS review, acl, count(*) AS n FROM it GROUP BY ALL",
    "queue_status": f"WITH {EV} SELECT entity_id AS approval_id, arg_max(op, ROW(valid_at, seq)) AS status FROM ev GROUP BY 1",
    "bootstrap_facts": "SELECT 'user' AS namespace, c_name AS subject, c_name || ' is in timezone UTC+' || c_nationkey AS claim, 0.7::DOUBLE AS confidence FROM customer WHERE c_nationkey % 2 = 0 UNION ALL SELECT 'team', 'channels', 'Channel ' || n_name || ' is for region ' || n_regionkey, 0.65 FROM nation WHERE n_regionkey > 1",
    "subjects_index": f"WITH {IT} SELECT namespace, subject, string_agg(memory_id, ',' ORDER BY memory_id) AS ids FROM it WHERE active GROUP BY ALL",
    "knowledge_files": f"WITH {IT}, f AS (SELECT *, CASE WHEN type = 'procedural' THEN 'procedures' WHEN namespace = 'user' THEN 'people' WHEN namespace = 'project' THEN 'projects' ELSE 'norms' END || '/' || trim(regexp_replace(lower(trim(subject)), '[^a-z0-9]+', '-', 'g'), '-') || '.md' AS path FROM it WHERE active) SELECT path, sha256(string_agg('- ' || claim || ' (confidence ' || printf('%.2f', confidence) || ')', chr(10) ORDER BY confidence DESC, memory_id)) AS hash FROM f GROUP BY path",
    "memory_diff": f"WITH {IT}, b AS (SELECT memory_id, n % 4 <> 0 AS active FROM it WHERE n % 3 <> 0), a AS (SELECT memory_id, active FROM it WHERE n % 7 <> 0), j AS (SELECT coalesce(b.memory_id, a.memory_id) AS memory_id, b.active AS was, a.active AS now FROM b FULL JOIN a ON b.memory_id = a.memory_id), c AS (SELECT memory_id, CASE WHEN was IS NULL AND now THEN 'added' WHEN was AND NOT coalesce(now, false) THEN 'removed' WHEN NOT was AND now THEN 'reactivated' END AS change FROM j) SELECT * FROM c WHERE change IS NOT NULL",
    "provenance_edges": f"WITH {IT}, {RELATION} SELECT memory_id, coalesce((SELECT string_agg(relation || ' ' || dst_id, ';' ORDER BY relation || ' ' || dst_id) FROM eg WHERE src_id = memory_id), '') AS relations FROM it",
    "bm25_topk": f"WITH {BM.format(id='doc_id', text='text', docs='documents')} SELECT query, doc, score, CAST(rank AS INTEGER) AS rank FROM lexr WHERE rank < 5",
    "bm25_indexed": f"WITH {BM.format(id='doc_id', text='text', docs='documents')} SELECT query, doc, score, CAST(rank AS INTEGER) AS rank FROM lexr WHERE rank < 5",
    "bm25_incremental": f"WITH cur AS (SELECT conv_id, arg_max(text, turn) AS text, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id), kept AS (FROM cur WHERE NOT (role = 'assistant' AND conv_id % 5 = 0)), {BM.format(id='conv_id', text='text', docs='kept')} SELECT query, doc, score, CAST(rank AS INTEGER) AS rank FROM lexr WHERE rank < 3",
    "dense_topk": "WITH s AS (SELECT q.vec_id AS query, v.vec_id AS doc, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) - 1 AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank < 5",
    "hash_embed_topk": f"WITH {IT}, {HASHED} SELECT query, doc, score, CAST(rank AS INTEGER) AS rank FROM hsr WHERE rank < 5",
    "hash_embed_buckets": f"WITH {_vectors('qv', 'benchmark', 'item_id')} SELECT id, CAST(bucket AS INTEGER) AS bucket, round(val, 6) AS val FROM qv",
    "hybrid_rrf": f"WITH {IT}, {BM.format(id='n', text='text', docs='it')}, {HASHED} SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank + 1)), 6) AS fused FROM (SELECT query, doc, rank FROM lexr WHERE rank < 20 UNION ALL SELECT query, doc, rank FROM hsr WHERE rank < 20) GROUP BY ALL",
    "hybrid_rerank": RERANKED + " SELECT query, doc, score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank < 10",
    "budget_pack": RERANKED.replace("WITH ", "WITH RECURSIVE ", 1) + """,
c AS (SELECT query, rank, doc, greatest(1, length(claim) // 4) AS cost FROM rk WHERE rank < 20),
w AS (SELECT query, -1::BIGINT AS rank, 0::BIGINT AS used, []::BIGINT[] AS docs FROM (SELECT DISTINCT query FROM c)
  UNION ALL SELECT w.query, c.rank, CASE WHEN len(docs) < 5 AND (used + cost <= 600 OR len(docs) = 0) THEN used + cost ELSE used END, CASE WHEN len(docs) < 5 AND (used + cost <= 600 OR len(docs) = 0) THEN list_append(docs, doc) ELSE docs END
  FROM w JOIN c ON c.query = w.query AND c.rank = w.rank + 1)
SELECT query, CAST(arg_max(used, rank) AS INTEGER) AS used, array_to_string(arg_max(docs, rank), ',') AS docs FROM w GROUP BY query""",
    "graph_one_hop": f"WITH {IT}, {RELATION} SELECT memory_id AS doc, round(0.01::DOUBLE + 0.5::DOUBLE / 60 * (SELECT count(*) FROM eg WHERE dst_id = memory_id AND relation IN ('supports', 'derived_from')), 6) AS fused FROM it",
    "graph_two_hop": "WITH e AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier), s AS (SELECT * FROM e WHERE src IN ('s1', 's2', 's3')), h AS (SELECT src, src AS dst, 0 AS h FROM s UNION ALL SELECT src, dst, 1 FROM s UNION ALL SELECT s.src, e.src, 2 FROM s JOIN e USING (dst)) SELECT src, dst, round(1.0::DOUBLE / (min(h) + 1), 4) AS proximity FROM h GROUP BY ALL",
    "graph_three_hops": "WITH e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier), u AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e), h0 AS (SELECT 'n' || n_nationkey AS src, 'n' || n_nationkey AS dst, 0 AS h FROM nation WHERE n_nationkey < 3), h1 AS (SELECT DISTINCT src, y AS dst, 1 AS h FROM h0 JOIN u ON x = dst), h2 AS (SELECT DISTINCT src, y AS dst, 2 AS h FROM h1 JOIN u ON x = dst), h3 AS (SELECT DISTINCT src, y AS dst, 3 AS h FROM h2 JOIN u ON x = dst), m AS (SELECT src, dst, min(h) AS h FROM (FROM h0 UNION ALL FROM h1 UNION ALL FROM h2 UNION ALL FROM h3) GROUP BY ALL) SELECT src, round(1.0::DOUBLE / (h + 1), 4) AS proximity, count(*) AS n FROM m GROUP BY src, h",
    "strings_contained": "WITH w AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM benchmark) WHERE length(w) > 6), d AS (SELECT lower(text) AS t FROM documents) SELECT w AS word, count(*) AS n FROM w JOIN d ON contains(t, w) GROUP BY w",
    "retrieval_quality": "WITH b AS (SELECT item_id, list_transform(string_split(text, chr(10)), lambda x: lower(x)) AS c, list_transform(list_filter(string_split(text, ' '), lambda w: length(w) > 6), lambda x: lower(x)) AS s FROM benchmark), n AS (SELECT item_id, len(s) AS ns, len(c) AS nc, len(list_filter(c, lambda x: len(list_filter(s, lambda y: contains(x, y))) > 0)) AS rel, len(list_filter(s, lambda y: len(list_filter(c, lambda x: contains(x, y))) > 0)) AS cov FROM b), q AS (SELECT item_id, CASE WHEN ns = 0 THEN 1.0 ELSE round(least(1.0, rel::DOUBLE / least(ns, nc)), 4) END AS precision, CASE WHEN ns = 0 THEN 1.0 ELSE round(cov::DOUBLE / ns, 4) END AS recall FROM n) SELECT item_id, precision::DOUBLE AS precision, recall::DOUBLE AS recall, CASE WHEN precision + recall = 0 THEN 0.0 ELSE round(2 * precision * recall / (precision + recall), 4) END::DOUBLE AS f1 FROM q",
    "rubric_scores": f"WITH {AXES} SELECT doc_id, round(0.4::DOUBLE * o + 0.2::DOUBLE * r + 0.2::DOUBLE * p + 0.2::DOUBLE * v, 4) AS total, round((o * 0.4::DOUBLE + v * 0.2::DOUBLE) / (0.4::DOUBLE + 0.2::DOUBLE), 4) AS outcome_score, o >= 0.999 AND v >= 0.999 AS success FROM ax",
    "paired_delta": PAIRED + " SELECT * FROM pd WHERE delta IS NOT NULL",
    "win_rate": PAIRED + " SELECT round(avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END), 4) AS win_rate, round(avg(delta), 4) AS mean_delta, count(*) AS n FROM pd WHERE delta IS NOT NULL",
    "backtest_summary": PAIRED + " SELECT count(*) AS tasks, round(avg(base), 4) AS mean_base, round(avg(treated), 4) AS mean_treated, round(avg(delta), 4) AS mean_delta, round(avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END), 4) AS win_rate FROM pd WHERE delta IS NOT NULL",
    "wilcoxon": PAIRED + ", r AS (SELECT delta, rank() OVER (ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY abs(delta)) - 1)::DOUBLE / 2 AS rk FROM pd WHERE delta <> 0), ws AS (SELECT least(sum(rk) FILTER (delta > 0), sum(rk) FILTER (delta < 0)) AS st, count(*) AS n FROM r) SELECT st AS statistic, n, round((st - n * (n + 1)::DOUBLE / 4) / sqrt(n * (n + 1) * (2 * n + 1)::DOUBLE / 24), 6) AS z FROM ws",
    "kappa": "WITH c AS (SELECT count(*) AS n, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS o, avg(quality::DOUBLE) * avg(toxic::DOUBLE) + (1 - avg(quality::DOUBLE)) * (1 - avg(toxic::DOUBLE)) AS e FROM labels) SELECT round((o - e) / (1 - e), 4) AS kappa, n FROM c",
    "percentiles": "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.05), 4) AS p5, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95 FROM orders GROUP BY 1",
    "mine_tasks": CLASSED + f""", w AS (SELECT trace_id, string_agg(tool_name, '>' ORDER BY pos) AS s FROM sp WHERE tool_name IS NOT NULL GROUP BY 1)
SELECT 'repeated_request' AS kind, 'Recurring workflow ' || s AS summary, count(*) AS occurrences FROM w GROUP BY s HAVING count(*) >= 2
UNION ALL SELECT 'correction', 'Repeated correction about ' || CASE t WHEN '' THEN 'general' ELSE t END, count(*) FROM (SELECT {THEME.format(t='said')} AS t FROM st WHERE source = 'correction') GROUP BY t HAVING count(*) >= 2
UNION ALL SELECT DISTINCT 'durable_statement', substr(said, 1, 80), 1 FROM st WHERE source = 'explicit'""",
    "fault_injection": f"WITH {EV}, c AS (SELECT entity_id AS run_id, seq AS pos, event_type AS tool, row_number() OVER (PARTITION BY entity_id, event_type ORDER BY seq) AS t, row_number() OVER (PARTITION BY entity_id ORDER BY seq) AS a FROM ev), f AS (SELECT run_id, pos, tool, CASE WHEN tool = 'click' AND t = 2 THEN 'rate_limit' WHEN a = 3 THEN 'empty' WHEN tool = 'view' AND t = 1 THEN 'stale' END AS fault FROM c) SELECT * FROM f WHERE fault IS NOT NULL",
}

# The sweep of each subject, an item a step in its rank: of the later items that contradict it and are still there, it
# takes out those before the first that beats it, which takes out the item itself.
TOPICS = f"t AS (SELECT memory_id, namespace, subject, regexp_matches(claim, '{NEG}') AS neg, list_distinct(list_filter(regexp_extract_all(lower(claim), '[a-z0-9]+'), lambda w: w NOT IN ('not','never','no','longer','avoid','don','do','stop','t','the','a','to','is','and'))) AS t FROM it)"


def resolved(items: str, columns: str) -> str:
    """``columns`` and ``active`` of the table ``it`` that the WITH clause ``items`` makes."""
    return items.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {TOPICS},
p AS (SELECT a.memory_id AS a, b.memory_id AS b FROM t a JOIN t b ON a.namespace = b.namespace AND a.subject = b.subject AND a.memory_id < b.memory_id AND a.neg <> b.neg
      WHERE len(list_intersect(a.t, b.t))::DOUBLE / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) >= 0.5),
e AS (SELECT a AS x, b AS y FROM p UNION ALL SELECT b, a FROM p),
f AS (SELECT memory_id, namespace, subject, confidence AS c, created_at AS w, CASE acl WHEN 'personal' THEN 3 WHEN 'project' THEN 2 WHEN 'team' THEN 1 ELSE 0 END AS r FROM it WHERE memory_id IN (SELECT x FROM e)),
o AS (SELECT *, row_number() OVER (PARTITION BY namespace, subject ORDER BY c DESC, w, memory_id) AS k FROM f),
h AS (SELECT x.memory_id, list(y.memory_id ORDER BY y.k) AS ids, list(ROW(y.c, y.w, y.r) > ROW(x.c, x.w, x.r) ORDER BY y.k) AS beats FROM o x JOIN e ON e.x = x.memory_id JOIN o y ON y.memory_id = e.y AND y.k > x.k GROUP BY x.memory_id),
z AS (SELECT o.namespace, o.subject, o.k, o.memory_id, coalesce(ids, []) AS ids, coalesce(beats, []) AS beats FROM o LEFT JOIN h USING (memory_id)),
s(namespace, subject, k, gone) AS (
  SELECT DISTINCT namespace, subject, 0::BIGINT, []::VARCHAR[] FROM o
  UNION ALL
  SELECT namespace, subject, k + 1, CASE WHEN list_contains(gone, memory_id) THEN gone WHEN first > 0 THEN list_append(list_concat(gone, live[1:first - 1]), memory_id) ELSE list_concat(gone, live) END
  FROM (SELECT s.namespace, s.subject, s.k, gone, memory_id, list_filter(ids, lambda i: NOT list_contains(gone, i)) AS live,
               coalesce(list_position(list_transform(list_filter(ids, lambda i: NOT list_contains(gone, i)), lambda i: beats[list_position(ids, i)]), true), 0) AS first
        FROM s JOIN z ON z.namespace = s.namespace AND z.subject = s.subject AND z.k = s.k + 1)),
g AS (SELECT unnest(arg_max(gone, k)) AS memory_id FROM s GROUP BY namespace, subject)
SELECT {columns}, memory_id NOT IN (SELECT memory_id FROM g) AS active FROM it"""


ORACLE_SQL["resolve_active"] = resolved(f"WITH {IT}", "memory_id")

# The exact program, an item a step: best value and items of each budget.
ORACLE_SQL["budget_knapsack"] = RERANKED.replace("WITH ", "WITH RECURSIVE ", 1) + """,
c AS (SELECT query, doc, score, greatest(1, length(claim) // 4) AS cost, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS k FROM rk WHERE rank < 20),
w(query, k, best, pick) AS (
  SELECT query, 0::BIGINT, list_transform(range(601), lambda x: 0.0::DOUBLE), list_transform(range(601), lambda x: []::BIGINT[]) FROM (SELECT DISTINCT query FROM c)
  UNION ALL
  SELECT w.query, w.k + 1, list_transform(range(601), lambda x: CASE WHEN x >= cost AND best[x - cost + 1] + score > best[x + 1] THEN best[x - cost + 1] + score ELSE best[x + 1] END),
         list_transform(range(601), lambda x: CASE WHEN x >= cost AND best[x - cost + 1] + score > best[x + 1] THEN list_append(pick[x - cost + 1], doc) ELSE pick[x + 1] END)
  FROM w JOIN c ON c.query = w.query AND c.k = w.k + 1)
SELECT query, unnest(arg_max(pick[601], k)) AS id FROM w GROUP BY query"""


def _interval(value: str) -> str:
    """The generator's states by doubling: the step is composed with itself, so 2000 resamples take some twenty rounds."""
    return PAIRED.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
m AS (SELECT list({value} ORDER BY task_id) AS v, count(*) AS n FROM pd WHERE delta IS NOT NULL),
g(k, s, a, c) AS (
  SELECT 0, [(1103515245::BIGINT * 12345 + 12345) & 2147483647], 1103515245::BIGINT, 12345::BIGINT
  UNION ALL
  SELECT k + 1, list_concat(s, list_transform(s, lambda x: (x * a + c) & 2147483647)), (a * a) & 2147483647, (a * c + c) & 2147483647 FROM g, m WHERE len(s) < 2000 * n),
d AS (SELECT unnest(s) AS x, generate_subscripts(s, 1) - 1 AS i FROM (SELECT s FROM g ORDER BY k DESC LIMIT 1)),
r AS (SELECT sum(v[(x % n) + 1]) / any_value(n) AS mean FROM d, m WHERE i < 2000 * n GROUP BY i // n)
SELECT 'all' AS g, round(list_avg(any_value(v)), 4) AS estimate, round(quantile_cont(mean, 0.025), 4) AS low, round(quantile_cont(mean, 0.975), 4) AS high FROM r, m"""


ORACLE_SQL["bootstrap_ci"] = _interval("delta")
ORACLE_SQL["win_rate_ci"] = _interval("CASE WHEN delta > 0 THEN 1.0::DOUBLE ELSE 0.0 END")

# What each kind of prompt leads to, without its memory and with it, spelled out.
ACTIONS = [
    (0, "gcal.respond_event", '{"event_id":"ev_unknown","response":"accepted"}', "gcal.respond_event", '{"event_id":"ev_unknown","response":"declined"}'),
    (1, "gcal.create_event", '{"start":"08:00","summary":"Call Schedule"}', "gcal.create_event", '{"start":"10:00","summary":"Call Schedule"}'),
    (2, "gcal.create_event", '{"summary":"Travel airline any seat any"}', "gcal.create_event", '{"summary":"Travel airline United seat aisle"}'),
    (3, "gcal.update_event", '{"event_id":"ev_unknown","start":"12:00"}', "gcal.update_event", '{"event_id":"ev_unknown","start":"15:00"}'),
    (4, "slack.list_channels", "{}", "slack.send_dm", '{"text":"Following up personally.","user":"U_ALICE"}'),
    (5, "slack.post_message", '{"channel":"general","text":"Routing your request."}', "slack.post_message", '{"channel":"engineering","text":"Routing your request."}'),
    (6, "slack.post_message", '{"channel":"general","text":"Announcing Launch"}', "slack.post_message", '{"channel":"announcements","text":"Launch Launch is live"}'),
    (7, "gcal.create_event", '{"attendees":"team","summary":"Approval"}', "gcal.create_event", '{"attendees":"vp-product","summary":"Approval"}'),
    (8, "gdocs.create_document", '{"body":"## Notes","name":"Weekly Summary Update"}', "gdocs.create_document", r'{"body":"## Metrics\n## Highlights\n## Risks","name":"Weekly Summary Update"}'),
    (9, "gdocs.update_document", '{"body":"Updated.","document_id":"doc_unknown"}', "gdocs.update_document", '{"body":"Updated.","document_id":"doc_redwood_overview"}'),
    (10, "gdocs.create_document", '{"name":"Update"}', "gdocs.create_document", '{"name":"Customer Update 2026-05-20"}'),
    (11, "slack.post_message", '{"channel":"general","text":"I could not find a prior decision."}', "slack.post_message", '{"channel":"general","text":"Per the prior decision, scope is frozen."}'),
    (12, "slack.list_channels", "{}", "slack.list_channels", "{}"),
]
_ACTIONS = "a(k, t0, a0, t1, a1) AS (VALUES " + ", ".join(f"({k}, '{t0}', '{a0}', '{t1}', '{a1}')" for k, t0, a0, t1, a1 in ACTIONS) + ")"
_DONE = f"WITH {_ACTIONS}, done AS (SELECT item_id AS task_id, 'without_memory' AS condition, t0 AS tool, a0 AS args FROM benchmark JOIN a ON k = item_id % 13 UNION ALL SELECT item_id, 'with_memory', t1, a1 FROM benchmark JOIN a ON k = item_id % 13)"
ORACLE_SQL["policy_actions"] = _DONE + " SELECT * FROM done"
ORACLE_SQL["judged_runs"] = _DONE + """,
j AS (SELECT task_id, condition, CASE WHEN tool = 'gcal.create_event' AND contains(lower(args), 'united') THEN 1.0 ELSE 0.0 END::DOUBLE AS o, CASE WHEN tool = 'slack.send_dm' THEN 0.0 ELSE 1.0 END::DOUBLE AS v, CASE WHEN condition = 'with_memory' THEN 1.0 ELSE 0.0 END::DOUBLE AS r FROM done)
SELECT task_id, condition, o AS task_outcome, v AS action_validity, r AS memory_retrieval, round(0.4 * o + 0.2 * r + 0.2 * o + 0.2 * v, 4) AS total, round((0.4 * o + 0.2 * v) / 0.6, 4) AS outcome_score, o = 1 AND v = 1 AS success FROM j"""

# Gradient steps, an example a step in the stated order; the state holds the weights.
_STEPS = "1 / (1 + exp(-greatest(-60, least(60, z))))"
ORACLE_SQL["usefulness_model"] = f"""WITH RECURSIVE {IT},
x AS (SELECT list({{'t': type = 'procedural', 'n': namespace, 'c': confidence, 'r': 1.0::DOUBLE / (n % 7 + 1), 'y': CASE WHEN active THEN 1.0 ELSE 0.0 END::DOUBLE}} ORDER BY n) AS ex FROM it),
s(k, b, wp, ws, wu, wt, wj, wc, wr) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT k + 1, b - d, CASE WHEN e.t THEN wp - d ELSE wp END, CASE WHEN e.t THEN ws ELSE ws - d END, CASE WHEN e.n = 'user' THEN wu - d ELSE wu END, CASE WHEN e.n = 'team' THEN wt - d ELSE wt END, CASE WHEN e.n = 'project' THEN wj - d ELSE wj END, wc - d * e.c, wr - d * e.r
  FROM (SELECT *, 0.1::DOUBLE * ({_STEPS} - e.y) AS d FROM (SELECT *, b + (CASE WHEN e.t THEN wp ELSE ws END + CASE e.n WHEN 'user' THEN wu WHEN 'team' THEN wt ELSE wj END + wc * e.c + wr * e.r) AS z FROM (SELECT s.*, ex[(k % len(ex)) + 1] AS e FROM s, x WHERE k < 20 * len(ex))))),
f AS (FROM s ORDER BY k DESC LIMIT 1),
w AS (SELECT unnest(['', 'confidence', 'inv_rank', 'ns=project', 'ns=team', 'ns=user', 'type=procedural', 'type=semantic']) AS feature, unnest([b, wc, wr, wj, wt, wu, wp, ws]) AS weight FROM f)
SELECT feature, round(weight, 6) AS weight FROM w WHERE feature = '' OR feature IN ('confidence', 'inv_rank') OR feature IN (SELECT 'ns=' || namespace FROM it UNION ALL SELECT 'type=' || type FROM it)"""
ORACLE_SQL["router_model"] = f"""WITH RECURSIVE {PR}, t AS (SELECT task_id, regexp_extract_all(lower(prompt), '[a-z0-9]+') AS t FROM pr),
v AS (SELECT list(DISTINCT w ORDER BY w) AS v FROM (SELECT unnest(t) AS w FROM t)),
x AS (SELECT list({{'c': list_transform(v, lambda w: len(list_filter(t, lambda u: u = w))::DOUBLE), 'n': CASE WHEN task_id % 2 = 0 THEN 'user' ELSE 'team' END}} ORDER BY task_id) AS ex FROM t, v),
s(model, k, b, w) AS (
  SELECT unnest(['user', 'team', 'project', 'app_state']), 0, 0.0::DOUBLE, list_transform(v, lambda x: 0.0::DOUBLE) FROM v
  UNION ALL
  SELECT model, k + 1, b - d, list_transform(list_zip(w, e.c), lambda p: p[1] - d * p[2])
  FROM (SELECT *, 0.2::DOUBLE * ({_STEPS} - CASE WHEN e.n = model THEN 1.0 ELSE 0.0 END) AS d FROM (SELECT *, b + list_inner_product(w, e.c) AS z FROM (SELECT s.*, ex[(k % len(ex)) + 1] AS e FROM s, x WHERE k < 30 * len(ex))))),
f AS (SELECT model, arg_max(b, k) AS b, arg_max(w, k) AS w FROM s GROUP BY model)
SELECT model, unnest(list_prepend('', v)) AS feature, round(unnest(list_prepend(b, w)), 6) AS weight FROM f, v"""
