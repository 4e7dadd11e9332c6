"""Queries that run whole jobs over the test tables: syncs, transcripts, ingest, stores, compiling, evaluation; with their SQL.

Sources are first written as the applications export them, whole tables each, and then read by the connectors.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import ids
from tidemark.operators import evals, fold, log, memory, replay, segments, stores, traces
from tidemark.plans import sql as S
from tidemark.plans.adapters import INGESTED, NOW, POINTS, VALID, app_events, items, prompts, spans, table
from tidemark.sources import connectors, transcripts
from tidemark.streaming import exports, sync
from tidemark.tables import fresh_path, stash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def _named(letter: str, column) -> F.Column:
    return F.concat(F.lit(letter), column)


def _export(spark: SparkSession, label: str, **parts: DataFrame) -> str:
    """One JSON document of lists, as an application exports it."""
    path, whole = fresh_path(spark, label), None
    for name, rows in parts.items():
        one = rows.agg(F.collect_list(F.struct("*")).alias(name))
        whole = one if whole is None else whole.crossJoin(one)  # a row each
    whole.select(F.to_json(F.struct("*"))).coalesce(1).write.text(path)
    return path


# -- sources ----------------------------------------------------------------------------------------------------------


@query(f"""
WITH c AS (SELECT *, 'C' || (conv_id % 25) AS ch, CAST(1710000000 + conv_id * 100 + turn AS VARCHAR) AS ts FROM conversations),
e AS (
  SELECT 'slack' AS app, 'user' AS entity_type, 'U' || c_custkey AS entity_id, 'upsert_entity' AS op, 1700000000 AS secs, c_name AS value FROM customer
  UNION ALL SELECT 'slack', 'channel', 'C' || n_nationkey, 'upsert_entity', 1700000000 + n_nationkey * 1000, n_name FROM nation
  UNION ALL SELECT 'slack', 'channel', 'C' || n_nationkey, 'upsert_edge', 1700000000 + n_nationkey * 1000, 'U' || n_regionkey FROM nation
  UNION ALL SELECT 'slack', 'message', ch || ':' || ts, 'upsert_entity', ts::BIGINT, text FROM c
  UNION ALL SELECT 'slack', 'message', ch || ':' || ts, 'status_change', ts::BIGINT, 'eyes' FROM c WHERE turn = 0
  UNION ALL SELECT 'slack', 'message', ch || ':' || ts, 'append_version', ts::BIGINT + 50, 'edited ' || conv_id FROM c WHERE turn = 1
  UNION ALL SELECT 'gcal', 'event', 'ev' || s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'delete_entity' ELSE 'upsert_entity' END, 1704067200 + s_suppkey * 60, CASE WHEN s_suppkey % 5 > 0 THEN s_name END FROM supplier
  UNION ALL SELECT 'gcal', 'event', 'ev' || s_suppkey, 'upsert_edge', 1704067200 + s_suppkey * 60, 'n' || s_nationkey || '@x.org' FROM supplier WHERE s_suppkey % 5 > 0
  UNION ALL SELECT 'gdocs', 'document', 'd' || n_nationkey, 'upsert_entity', 1704067200 + n_nationkey * 60, n_name FROM nation
  UNION ALL SELECT 'gdocs', 'document', 'd' || n_nationkey, 'append_version', 1704067200 + n_nationkey * 60, '# ' || n_name FROM nation
  UNION ALL SELECT 'gdocs', 'document', 'd' || n_nationkey, 'append_version', 1704067200 + n_nationkey * 60 + 3600, n_name || ' of ' || n_regionkey FROM nation
  UNION ALL SELECT 'gmail', 'message', 'm' || item_id, 'upsert_entity', 1700000000 + item_id, text FROM benchmark)
SELECT app, entity_type, entity_id, op, strftime(make_timestamp(secs * 1000000), {S.ISO}) AS valid_at, value FROM e""")
def synced_events(spark, d):
    """Chat, calendar, documents and mail, each synced twice into one log: the second time adds nothing."""
    talk = table(spark, d, "conversations").withColumn("ch", _named("C", F.col("conv_id") % 25)).withColumn("ts", (F.lit(1710000000) + F.col("conv_id") * 100 + F.col("turn")).cast("string"))
    nation, supplier = table(spark, d, "nation"), table(spark, d, "supplier")
    at = lambda key, plus=0: F.date_format(F.timestamp_seconds(F.lit(1704067200 + plus) + F.col(key) * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    users = table(spark, d, "customer").select(_named("U", F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"))
    channels = nation.select(_named("C", F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"), (F.lit(1700000000) + F.col("n_nationkey") * 1000).cast("string").alias("created"), F.array(_named("U", F.col("n_regionkey"))).alias("members"))
    seen = F.when(F.col("turn") == 0, F.array(F.struct(F.lit("eyes").alias("name"), F.array(F.lit("U1")).alias("users"))))
    said = F.create_map("ch", F.array(F.struct("ts", F.lit("U1").alias("user"), "text", seen.alias("reactions"))))
    edits = talk.filter("turn = 1").select(F.col("ch").alias("channel"), "ts", (F.col("ts").cast("bigint") + 50).cast("string").alias("edited_ts"), F.concat(F.lit("edited "), "conv_id").alias("text"))
    slack = f"{fresh_path(spark, 'slack')}.jsonl"  # a line a user, channel, message and edit, so that tasks share the reading
    line = lambda name, value: F.to_json(F.struct(value.alias(name))).alias("value")
    lines = [x.select(line(name, F.array(F.struct("*")))) for name, x in (("users", users), ("channels", channels), ("edits", edits))]
    reduce(DataFrame.unionByName, lines, talk.select(line("messages", said))).write.text(slack)
    guest = F.array(F.struct(F.concat(F.lit("n"), "s_nationkey", F.lit("@x.org")).alias("email"), F.lit("accepted").alias("responseStatus")))
    dates = supplier.select(F.struct(_named("ev", F.col("s_suppkey")).alias("id"), F.when(F.col("s_suppkey") % 5 == 0, "cancelled").otherwise("confirmed").alias("status"), F.col("s_name").alias("summary"), at("s_suppkey").alias("updated"), guest.alias("attendees")).alias("e"), (F.col("s_suppkey") % 2).alias("half"))
    calendar = _export(spark, "calendar", sync_batches=dates.groupBy(F.concat(F.lit("T"), "half").alias("sync_token")).agg(F.collect_list("e").alias("events")))
    revision = lambda n, body, plus: F.struct(F.lit(n).alias("revision_id"), at("n_nationkey", plus).alias("modified_time"), body.alias("exported_markdown"))
    revisions = F.array(revision("r1", F.concat(F.lit("# "), "n_name"), 0), revision("r2", F.concat("n_name", F.lit(" of "), "n_regionkey"), 3600))
    documents = _export(spark, "documents", documents=nation.select(_named("d", F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"), revisions.alias("revisions")))
    mail = _export(spark, "mail", messages=table(spark, d, "benchmark").select(_named("m", F.col("item_id")).alias("id"), ((F.lit(1700000000) + F.col("item_id")) * 1000).cast("string").alias("internalDate"), F.col("text").alias("subject")))
    path = fresh_path(spark, "log")
    for _ in range(2):
        for app, source in (("slack", slack), ("gcal", calendar), ("gdocs", documents), ("gmail", mail)):
            connectors.run_sync(spark, app, source, path, "2026-01-01")
    p = F.col("payload")
    value = F.coalesce("edge_target", p["markdown"], p["text"], p["subject"], p["summary"], p["reaction"], p["name"])
    return segments.read(spark, path).select("app", "entity_type", "entity_id", "op", ids.to_iso(F.col("valid_at")).alias("valid_at"), value.alias("value"))


@query("""
WITH l AS (
  SELECT conv_id % 16 AS s, conv_id, turn, 0 AS b, 'user' AS kind, text AS value FROM conversations WHERE role = 'user'
  UNION ALL SELECT conv_id % 16, conv_id, turn, 0, 'llm', text FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT conv_id % 16, conv_id, turn, 1, 'tool', '{"turn":"' || turn || '"} done ' || turn FROM conversations WHERE role = 'assistant'),
p AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY conv_id, turn, b) AS pos, kind, value FROM l)
SELECT s AS session, CAST(pos AS INTEGER) AS pos, kind, value FROM p
UNION ALL SELECT DISTINCT conv_id % 16, 0, 'agent', NULL FROM conversations""")
def transcript_spans(spark, d):
    """Conversations as sixteen transcripts with tool uses and their results, read back as spans."""
    at = F.concat((F.lit(1700000000) + F.col("conv_id") * 100 + F.col("turn")).cast("string"), F.lit(".5"))
    call = F.concat_ws("-", "conv_id", "turn")
    block = lambda **f: F.to_json(F.struct(*[(v if isinstance(v, F.Column) else F.lit(v)).alias(k) for k, v in f.items()]))
    use = block(type="tool_use", id=call, name="app.step", input=F.struct(F.col("turn").cast("string").alias("turn")))
    reply = F.concat(F.lit('{"role":"assistant","timestamp":"'), at, F.lit('","content":['), block(type="text", text=F.col("text")), F.lit(","), use, F.lit("]}"))
    result = F.concat(F.lit('{"role":"user","content":['), block(type="tool_result", tool_use_id=call, content=F.concat(F.lit("done "), "turn")), F.lit("]}"))
    plain = F.to_json(F.struct("role", at.alias("timestamp"), F.col("text").alias("content")))
    lines = table(spark, d, "conversations").withColumn("session", F.col("conv_id") % 16).select("session", "conv_id", "turn", F.posexplode(F.when(F.col("role") == "assistant", F.array(reply, result)).otherwise(F.array(plain))).alias("b", "value"))
    path = fresh_path(spark, "transcripts")
    lines.repartition("session").sortWithinPartitions("session", "conv_id", "turn", "b").select("session", "value").write.partitionBy("session").text(path)
    runs, found = transcripts.block_transcripts(spark, path)
    session = (((F.unix_seconds("started_at") - 1700000000) / 100).cast("bigint") % 16).alias("session")
    return found.join(runs.select("trace_id", session), "trace_id").select("session", "pos", "kind", F.when(F.col("kind") == "tool", F.concat_ws(" ", "input", "output")).otherwise(F.coalesce("input", "output")).alias("value"))


@query(f"""
WITH r AS (SELECT CAST(conv_id AS VARCHAR) AS trace_id, turn, {S._redact(4, "(text || CASE WHEN turn % 2 = 0 THEN ' write to a.b@example.org' ELSE '' END)")} AS t FROM conversations)
SELECT trace_id, count(*) AS n_spans, sha256(string_agg(CASE WHEN length(t) > 400 THEN 'blob://' || sha256(t) ELSE t END, '|' ORDER BY turn)) AS hash, string_agg('[REDACTED]:' || turn, '|' ORDER BY turn) AS args FROM r GROUP BY trace_id""")
def ingested_runs(spark, d):
    """Every run captured whole and without its last span, in either order, and once more: the whole one stays, redacted."""
    body = F.concat("text", F.when(F.col("turn") % 2 == 0, " write to a.b@example.org").otherwise(""))
    none = F.lit(None).cast("string")
    every = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("trace_id"), F.concat_ws("-", "conv_id", "turn").alias("span_id"), F.col("turn").alias("pos"), body.alias("input"), none.alias("output"), F.create_map(F.lit("token"), F.lit("t"), F.lit("n"), F.col("turn").cast("string")).alias("tool_args"))
    runs = every.groupBy("trace_id").agg(F.max("pos").alias("last")).withColumn("agent", F.lit("a"))
    thin = every.join(runs.select("trace_id", "last"), "trace_id").filter("pos < last").drop("last")
    home, early = fresh_path(spark, "home"), F.col("trace_id").cast("bigint") % 2 == 0
    for captured, day in ((thin.filter(early), 1), (every, 2), (thin, 3), (every, 4)):
        traces.ingest(runs.drop("last"), captured, home, f"2026-01-0{day}", 400)
    stored = traces.stored_spans(spark, home)
    whole = stored.groupBy("trace_id").agg(F.count("*").alias("n_spans"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "input"))), lambda x: x["input"]), "|").alias("t"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(":", F.col("tool_args")["token"], F.col("tool_args")["n"]).alias("a")))), lambda x: x["a"]), "|").alias("args"))
    return whole.select("trace_id", "n_spans", ids.sha256_hex(F.col("t")).alias("hash"), "args")


# -- states -----------------------------------------------------------------------------------------------------------


@query(f"""
WITH {S.EV}, kv AS (SELECT entity_id, seq, valid_at, op, key AS k, val AS v FROM (SELECT entity_id, seq, valid_at, op, event_type, value, k FROM ev WHERE entity_id IN (SELECT entity_id FROM ev)) UNPIVOT (val FOR key IN (event_type, value, k))),
c AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY entity_id, k ORDER BY valid_at, seq) <> v, true) AS changed FROM kv)
SELECT entity_id, seq, op, coalesce(string_agg(k || '=' || v, ',' ORDER BY k) FILTER (changed), '') AS changed, string_agg(k || '=' || v, ',' ORDER BY k) AS "full" FROM c GROUP BY entity_id, seq, op""")
def entity_frames(spark, d):
    shown = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return fold.frames(app_events(spark, d), ["entity_id"]).select("entity_id", "seq", "op", shown("changed").alias("changed"), shown("full").alias("full"))


@query(f"""
WITH {S.EV}, pt(point, valid, ingested) AS (VALUES ('p1', TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-06'), ('p2', TIMESTAMP '2024-01-12', TIMESTAMP '2024-01-30'), ('p3', {S.T}, {S.TAU}))
SELECT point, entity_id, arg_max(value, ROW(valid_at, seq)) FILTER (op <> 'delete_entity') AS value, arg_max(op, ROW(valid_at, seq)) = 'delete_entity' AS deleted FROM ev JOIN pt ON valid_at <= valid AND ingested_at <= ingested GROUP BY ALL""")
def asof_states(spark, d):
    points = spark.createDataFrame(POINTS, "point string, valid string, ingested string").select("point", F.col("valid").cast("timestamp"), F.col("ingested").cast("timestamp"))
    return fold.states_at_points(app_events(spark, d), points).select("point", "entity_id", F.col("payload")["value"].alias("value"), "deleted")


@query(f"WITH {S.EV}, v AS ({S.versions(S.SEEN)}), r AS ({S.ORACLE_SQL['snapshot_root'].split('p AS (', 1)[1].join(['WITH p AS (', ''])}) SELECT entity_id, version_hash, root FROM v, r")
def snapshot_loaded(spark, d):
    """A snapshot saved twice, listed once, and loaded with its manifest."""
    kept = stores.Snapshots(stores.Place(spark, fresh_path(spark, "snapshots")))
    states = fold.materialize(app_events(spark, d), VALID, INGESTED, include_deleted=True)
    made = {kept.save(states, "events", VALID, INGESTED, NOW) for _ in range(2)}
    return kept.list().filter(F.col("snapshot_id").isin(list(made))).join(kept.load(made.pop())).select("entity_id", "version_hash", "root")


# -- memory -----------------------------------------------------------------------------------------------------------


@query(f"WITH {S.IT} SELECT memory_id, subject, n % 6 <> 0 OR n % 3 = 0 AS active FROM it")
def memory_store(spark, d):
    """Items added twice, some switched off, some of these on again."""
    kept = stores.Memory(stores.Place(spark, fresh_path(spark, "memory")))
    own = items(spark, d)
    for _ in range(2):
        kept.add(own)
    kept.set_active(own.filter("n % 2 = 0").withColumn("active", F.lit(False)), "2026-01-01")
    kept.set_active(own.filter("n % 2 = 0").withColumn("active", (F.col("n") % 6 != 0) | (F.col("n") % 3 == 0)), "2026-01-02")
    return kept.items().select("memory_id", "subject", "active")


@query(f"WITH {S.IT} SELECT memory_id AS ref, CASE WHEN n % 4 = 0 THEN 'approved' WHEN n % 4 = 1 THEN 'rejected' ELSE 'pending' END AS status FROM it WHERE acl = 'personal' OR (confidence >= 0.4 AND confidence < 0.85)")
def approval_queue(spark, d):
    """What needs review is queued twice, and some of it is decided."""
    queue = stores.Approvals(stores.Place(spark, fresh_path(spark, "approvals")))
    waiting = items(spark, d).filter(memory.needs_review(F.col("confidence"), F.col("acl"))).select(F.lit("item").alias("kind"), F.col("memory_id").alias("ref"), F.col("claim").alias("payload"), "n")
    for _ in range(2):
        queue.enqueue(waiting, "2026-01-01")
    said = queue.entries("pending").join(waiting.select("ref", "n"), "ref").filter("n % 4 < 2")
    queue.decide(said.select("approval_id", F.when(F.col("n") % 4 == 0, "approved").otherwise("rejected").alias("status"), F.lit("x").alias("note")), "2026-01-01")
    return queue.entries().select("ref", "status")


_COMPILED = S.SHORT + """,
wf AS (SELECT string_agg(tool_name, ' then ' ORDER BY pos) AS s, count(*) AS c FROM sp WHERE tool_name IS NOT NULL GROUP BY trace_id),
every AS (
  SELECT source, ord, ref, kind, namespace, hint, 1 AS occ, said FROM st
  UNION ALL SELECT 'procedure', 0, '', 'procedural', 'team', 0.6, count(*), 'Repeated workflow ' || s FROM wf WHERE c >= 2 GROUP BY s HAVING count(*) >= 2),
gr AS (SELECT kind, namespace, lower(trim(said)) AS k, count(*) - 1 AS others, arg_min(source, ROW(source, ord, ref)) AS source, arg_min(hint, ROW(source, ord, ref)) AS hint, arg_min(occ, ROW(source, ord, ref)) AS occ, arg_min(said, ROW(source, ord, ref)) AS said FROM every GROUP BY kind, namespace, lower(trim(said))),
sc AS (SELECT *, round(1 / (1 + exp(-(-0.5 + 1.8 * (CASE source WHEN 'procedure' THEN 0 ELSE 1 END) + 0.5 * greatest(0, occ - 1) + 0.6 * others + 1.2 * (CASE source WHEN 'explicit' THEN 0.85 WHEN 'correction' THEN 0.8 ELSE 0.7 END) - (1 - hint)))), 4) AS confidence FROM gr),
it AS (SELECT 'mem_' || substr(sha256('{"claim":' || CAST(to_json(lower(trim(said))) AS VARCHAR) || ',"namespace":"' || namespace || '","subject":"' || subject || '","type":"' || kind || '"}'), 1, 16) AS memory_id, kind, namespace, subject, trim(said) AS claim, confidence, CASE namespace WHEN 'user' THEN 'personal' ELSE 'team' END AS acl, TIMESTAMP '2024-12-31' AS created_at
       FROM (SELECT *, CASE namespace WHEN 'user' THEN 'user' ELSE 'team-norms' END AS subject FROM sc) WHERE confidence >= 0.42)"""


@query(S.resolved(_COMPILED, "memory_id, kind AS type, namespace, confidence"))
def compiled_items(spark, d):
    """Statements and repeated workflows of all runs, compiled to items and resolved."""
    calls = spans(spark, d, planted=True)
    found = [memory.from_runs(calls), memory.from_sequences(traces.repeated_sequences(traces.tool_sequences(calls)))]
    return memory.compile_items(found, NOW)[0].select("memory_id", "type", "namespace", "confidence", "active")


# -- evaluation -------------------------------------------------------------------------------------------------------


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    """Prompts as tasks at one of three points in time; a trip to be booked with United is what is expected of all."""
    when = lambda k: F.element_at(F.array(*[F.lit(p[k]).cast("timestamp") for p in POINTS]), (F.col("task_id") % 3 + 1).cast("int"))
    field = F.struct(F.lit("summary").alias("name"), F.lit("United").alias("value"), F.lit(True).alias("contains"))
    return prompts(spark, d).select(
        "task_id", "prompt", when(1).alias("as_of_valid"), when(2).alias("as_of_ingest"), F.array(F.struct(F.lit("gcal").alias("app"), F.lit("gcal.create_event").alias("action"), F.array(field).alias("fields"))).alias("expected"),
        F.array(F.lit("slack.send_dm")).alias("forbidden"), F.lit(1).alias("max_writes"), F.array("memory").alias("memory_expected"), "memory",
    )


def _channels(spark: SparkSession, d: str) -> DataFrame:
    """Nations as channels that come up one a day and are known up to two days later."""
    day = lambda n: F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=n.cast("int"))
    key = F.col("n_nationkey")
    rows = log.upsert_entity(table(spark, d, "nation"), app="slack", entity_type="channel", entity_id=_named("C", key), valid_at=day(key), ingested_at=day(key + key % 3), payload=F.create_map(F.lit("name"), F.col("n_name")))
    return rows.withColumn("seq", F.lit(1).cast("bigint"))


_POINTS = "pt(k, t, tau) AS (VALUES (0, TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-06'), (1, TIMESTAMP '2024-01-12', TIMESTAMP '2024-01-30'), (2, TIMESTAMP '2024-01-20', TIMESTAMP '2024-01-22'))"
_NAMES = """nm AS (SELECT k, coalesce('["' || string_agg(n_name, '","' ORDER BY n_name) || '"]', '[]') AS names FROM pt LEFT JOIN nation ON TIMESTAMP '2024-01-01' + n_nationkey * INTERVAL 1 DAY <= t AND TIMESTAMP '2024-01-01' + (n_nationkey + n_nationkey % 3) * INTERVAL 1 DAY <= tau GROUP BY k)"""
_SCORED = """s AS (SELECT *, CASE WHEN tool = 'gcal.create_event' AND contains(lower(args), 'united') THEN 1.0 ELSE 0.0 END::DOUBLE AS o, CASE WHEN tool = 'slack.send_dm' THEN 0.0 ELSE 1.0 END::DOUBLE AS v FROM done)"""


@query(S._DONE + f""", {_POINTS}, {_NAMES}, {_SCORED}
SELECT task_id, condition, tool, CASE tool WHEN 'slack.list_channels' THEN names ELSE '{{"ok":true}}' END AS result, o AS task_outcome, CASE condition WHEN 'with_memory' THEN 1.0 ELSE 0.0 END::DOUBLE AS memory_retrieval, round((0.4 * o + 0.2 * v) / 0.6, 4) AS outcome_score
FROM s JOIN nm ON k = task_id % 3""")
def backtest_runs(spark, d):
    tasks = _tasks(spark, d)
    runs = replay.backtest(tasks.drop("memory"), tasks.select("task_id", F.array("memory").alias("claims")), _channels(spark, d))
    return runs.select("task_id", "condition", "tool", "result", "task_outcome", "memory_retrieval", "outcome_score")


@query(S._DONE.replace("done AS (", "done0 AS (", 1) + f""",
done AS (SELECT task_id, 'none' AS pack, tool, args, CASE WHEN task_id % 13 = 99 THEN 1.0 ELSE 0.0 END AS r FROM done0 WHERE condition = 'without_memory'
  UNION ALL SELECT task_id, 'own', tool, args, 1.0 FROM done0 WHERE condition = 'with_memory'
  UNION ALL SELECT task_id, 'travel', tool, args, CASE WHEN task_id % 13 IN (2, 12) THEN 1.0 ELSE 0.0 END FROM done0 WHERE condition = CASE WHEN task_id % 13 = 2 THEN 'with_memory' ELSE 'without_memory' END),
{_SCORED}, t AS (SELECT *, round(0.4 * o + 0.2 * r + 0.2 * o + 0.2 * v, 4) AS total FROM s)
SELECT task_id, pack, CAST(total AS DOUBLE) AS total, CAST(row_number() OVER (PARTITION BY task_id ORDER BY total DESC, pack) - 1 AS INTEGER) AS rank FROM t""")
def counterfactual_ranking(spark, d):
    """Every task without memory, with its own, and with that of travellers."""
    tasks = _tasks(spark, d)
    pack = lambda name, *claims: F.struct(F.lit(name).alias("pack"), F.array(*claims).cast("array<string>").alias("claims"))
    packs = tasks.select("task_id", F.explode(F.array(pack("none"), pack("own", F.col("memory")), pack("travel", F.lit("fly united on the aisle")))).alias("p")).select("task_id", "p.*")
    return replay.explore(tasks.drop("memory"), packs, _channels(spark, d)).select("task_id", "pack", "total", "rank")


_CALLS = [*replay.TOOLS, "slack.unknown"]


@query(f"""
WITH t(i, tool) AS (VALUES {', '.join(f"({i}, '{t}')" for i, t in enumerate(_CALLS))}),
c AS (SELECT s_suppkey AS k, s_name, i, tool, s_suppkey % 3 > 0 AS there FROM supplier, t),
n AS (SELECT '["' || string_agg(n_name, '","' ORDER BY n_name) || '"]' AS names FROM nation WHERE n_nationkey % 4 > 0)
SELECT k || '-' || i AS call_id, tool, CASE WHEN tool = 'slack.list_channels' THEN names WHEN tool IN ('gcal.get_event', 'gdocs.get_document') AND there THEN '{{"name":"' || s_name || '"}}'
    WHEN tool IN ('gcal.get_event', 'gdocs.get_document') THEN '{{"error":"not_found"}}' WHEN tool = 'slack.unknown' THEN '{{"error":"unknown_tool"}}' ELSE '{{"ok":true}}' END AS result,
  i BETWEEN {len(replay.READ_TOOLS)} AND {len(replay.TOOLS) - 1} AS is_write, CASE WHEN tool = 'slack.post_message' THEN CASE WHEN (k % 25) % 4 > 0 THEN 'C' || (k % 25) ELSE (SELECT n_name FROM nation WHERE n_nationkey = k % 25) END END AS channel_id FROM c, n""")
def tool_results(spark, d):
    """Each tool called for each supplier, against channels, events and documents of which some are gone."""
    supplier, nation = table(spark, d, "supplier"), table(spark, d, "nation")
    state = lambda rows, app, kind, key, name, gone: rows.select(F.lit(app).alias("app"), F.lit(kind).alias("entity_type"), key.alias("entity_id"), F.create_map(F.lit("name"), F.col(name)).alias("payload"), gone.alias("deleted"))
    gone = F.col("s_suppkey") % 3 == 0
    states = state(nation, "slack", "channel", _named("C", F.col("n_nationkey")), "n_name", F.col("n_nationkey") % 4 == 0).unionByName(state(supplier, "gcal", "event", _named("e", F.col("s_suppkey")), "s_name", gone)).unionByName(state(supplier, "gdocs", "document", _named("d", F.col("s_suppkey")), "s_name", gone))
    calls = supplier.withColumn("n_nationkey", F.col("s_suppkey") % 25).join(nation.select("n_nationkey", "n_name"), "n_nationkey").select("s_suppkey", "n_name", F.posexplode(F.array(*[F.lit(t) for t in _CALLS])).alias("i", "tool"))
    args = F.create_map(F.lit("channel"), F.col("n_name"), F.lit("event_id"), F.when(F.col("tool").startswith("gcal"), _named("e", F.col("s_suppkey"))), F.lit("document_id"), F.when(F.col("tool").startswith("gdocs"), _named("d", F.col("s_suppkey"))))
    done = replay.execute(calls.select(F.concat_ws("-", "s_suppkey", "i").alias("call_id"), "tool", args.alias("args")), states)
    return done.select("call_id", "tool", "result", "is_write", F.when(F.col("tool") == "slack.post_message", F.col("args")["channel_id"]).alias("channel_id"))


@query("SELECT 'c' || conv_id AS session_id, count(*) + 1 AS n, md5(string_agg(md5(text), '' ORDER BY turn)) AS prompts, 'closed' AS finished FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id")
def streamed_sessions(spark, d):
    """Every turn as a capture, in two runs of one stream; two conversations of three close, the others stay open."""
    source, out, checkpoint = (fresh_path(spark, f"sessions-{x}") for x in ("in", "out", "checkpoint"))
    talk = table(spark, d, "conversations")
    last = talk.groupBy("conv_id").agg(F.max("turn").alias("last"))
    at = lambda turn: F.lit("2026-01-01").cast("timestamp") + F.make_dt_interval(secs=turn)
    none = [F.lit(None).cast("string").alias(c) for c in ("tool_name", "tool_input", "tool_response")]
    session = F.concat(F.lit("c"), "conv_id").alias("session_id")
    said = talk.join(last, "conv_id").select("turn", "last", session, F.lit("UserPromptSubmit").alias("hook_event_name"), at(F.col("turn")).alias("received_at"), F.md5("text").alias("prompt"), *none)
    stop = last.filter("conv_id % 3 <> 0").select(session, F.lit("Stop").alias("hook_event_name"), at(F.col("last") + 1).alias("received_at"), F.lit(None).cast("string").alias("prompt"), *none)
    for part in (said.filter("2 * turn < last"), said.filter("2 * turn >= last").drop("turn", "last").unionByName(stop)):
        part.drop("turn", "last").write.mode("append").json(source)
        sync.start_sessions(sync.read_captures(spark, source), out, checkpoint).awaitTermination()
    turns = F.array_sort(F.collect_list(F.when(F.col("prompt").isNotNull(), F.struct("received_at", "prompt"))))
    return spark.read.parquet(out).groupBy("session_id", "finished").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(turns, lambda x: x["prompt"]), "")).alias("prompts")).select("session_id", "n", "prompts", "finished")


@query("SELECT 'ev' || c_custkey AS entity_id, c_custkey % 5 = 0 AS deleted, c_name AS summary, CASE WHEN c_custkey % 2 = 0 THEN 'n' || c_nationkey END AS guest FROM customer")
def streamed_calendar(spark, d):
    """A calendar's export as a stream: every event, then a second batch behind the first one's token that cancels some."""
    source, log_path, checkpoint = (fresh_path(spark, f"calendar-{x}") for x in ("in", "log", "checkpoint"))
    at = lambda plus: F.date_format(F.timestamp_seconds(F.lit(1704067200 + plus) + F.col("c_custkey")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated")
    guests = F.when(F.col("c_custkey") % 2 == 0, F.array(F.struct(F.concat(F.lit("n"), "c_nationkey").alias("email"), F.lit("accepted").alias("responseStatus")))).alias("attendees")
    rows = table(spark, d, "customer")
    made = rows.select(_named("ev", F.col("c_custkey")).alias("id"), F.lit("confirmed").alias("status"), F.col("c_name").alias("summary"), at(0), guests)
    gone = rows.filter("c_custkey % 5 = 0").select(_named("ev", F.col("c_custkey")).alias("id"), F.lit("cancelled").alias("status"), at(10**6))
    for name, batch in (("1-A", made), ("2-B", gone)):
        batch.select(F.to_json(F.struct("*"))).write.text(f"{source}/{name}.jsonl")
        exports.start_calendar(spark, source, log_path, checkpoint, "2026-01-01").awaitTermination()
    states = fold.materialize(segments.read(spark, log_path), include_deleted=True)
    return states.select("entity_id", "deleted", F.col("payload")["summary"].alias("summary"), F.get(F.col("edges")["attendee"], F.lit(0)).alias("guest"))


@query(f"WITH {S.EV} SELECT {S.OUT} FROM ({S.fold()}) WHERE NOT deleted")
def asof_fold_resumed(spark, d):
    """The states of a point, folded onto a snapshot of an earlier one from what is new since; late events are among that."""
    events, kept = app_events(spark, d), stores.Snapshots(stores.Place(spark, fresh_path(spark, "place")))
    made = kept.save_fold(events, None, *[F.lit(t).cast("timestamp") for t in POINTS[0][1:]], NOW)
    p, states = F.col("payload"), kept.fold_from(made, events, VALID, INGESTED)
    return states.select("entity_id", p["event_type"].alias("event_type"), p["value"].alias("value"), p["k"].alias("k"), "version_count", ids.to_iso(F.col("last_valid_at")).alias("last_valid_at"))


@query(f"WITH {S.EV}, a AS ({S.versions("valid_at <= TIMESTAMP '2024-01-20' AND ingested_at <= TIMESTAMP '2024-01-22'")}), b AS ({S.versions("valid_at <= TIMESTAMP '2024-01-20 01:00:00' AND ingested_at <= TIMESTAMP '2024-01-22'")}), x AS (SELECT entity_id, version_hash FROM a WHERE NOT deleted), y AS (SELECT entity_id, version_hash FROM b WHERE NOT deleted) SELECT entity_id, CASE WHEN x.version_hash IS NULL THEN 'created' WHEN y.version_hash IS NULL THEN 'deleted' ELSE 'updated' END AS change FROM x FULL JOIN y USING (entity_id) WHERE x.version_hash IS DISTINCT FROM y.version_hash")
def snapshot_tree_diff(spark, d):
    """Two saved snapshots, an hour apart, compared by their trees: only ranges of keys that differ are read."""
    events, kept = app_events(spark, d), stores.Snapshots(stores.Place(spark, fresh_path(spark, "place")))
    saved = []
    for valid in (VALID, "2024-01-20 01:00:00"):
        states = fold.materialize(events, valid, INGESTED, include_deleted=True)
        saved.append(kept.save(states, None, valid, INGESTED, NOW))
    return kept.difference(*saved).select("entity_id", "change")
