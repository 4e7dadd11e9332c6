import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fold, log, segments, traces
from tidemark.sources import connectors, files, transcripts
from tidemark.streaming import exports, sync

NOW = "2026-06-01 00:00:00"


def put(tmp_path, name, value):
    at = tmp_path / name
    at.write_text(value if isinstance(value, str) else json.dumps(value))
    return f"file://{at}"


@pytest.fixture
def slack(tmp_path):
    return put(tmp_path, "slack.json", {
        "team": {"id": "T1"}, "users": [{"id": "U1", "name": "ann", "tz": "UTC"}, {"id": "U2", "name": "bob", "is_admin": True}],
        "channels": [{"id": "C1", "name": "general", "topic": {"value": "all"}, "created": "1777000000", "members": ["U1", "U2"]}, {"id": "C2", "name": "dev", "topic": "code", "created": "1776000000", "members": ["U1"]}],
        "messages": {"C1": [{"ts": "1777000001.000100", "user": "U1", "text": "hi", "reactions": [{"name": "wave", "users": ["U2"]}]}]},
        "edits": [{"channel": "C1", "ts": "1777000001.000100", "edited_ts": "1777000009.5", "text": "hi all"}],
    })


def test_slack(spark, slack, tmp_path):
    events = connectors.slack(spark, slack, NOW)
    assert {r["op"]: r["n"] for r in events.groupBy("op").agg(F.count("*").alias("n")).collect()} == {"upsert_entity": 5, "upsert_edge": 3, "status_change": 1, "append_version": 1}
    log_path = f"file://{tmp_path}/log"
    assert connectors.run_sync(spark, "slack", slack, log_path, NOW) == {"emitted": 10, "new": 10}
    assert connectors.run_sync(spark, "slack", slack, log_path, "2026-07-01") == {"emitted": 10, "new": 0}
    states = {(r["entity_type"], r["entity_id"]): r for r in fold.materialize(segments.read(spark, log_path)).collect()}
    message = states["message", "C1:1777000001.000100"]
    assert message["payload"]["text"] == "hi all" and message["payload"]["reaction"] == "wave" and message["version_count"] == 1
    assert states["channel", "C1"]["payload"]["topic"] == "all" and states["channel", "C2"]["payload"]["topic"] == "code" and set(states["channel", "C1"]["edges"]["member"]) == {"U1", "U2"}
    assert states["user", "U1"]["last_valid_at"] == datetime(2026, 4, 12, 13, 20)


def test_slack_by_lines_is_slack_in_one_document(spark, slack, tmp_path):
    whole = json.loads((tmp_path / "slack.json").read_text())
    lines = [{name: [x]} for name in ("users", "channels", "edits") for x in whole[name]] + [{"messages": {c: [m]}} for c, ms in whole["messages"].items() for m in ms]
    (tmp_path / "slack.jsonl").mkdir()
    for k in range(3):
        put(tmp_path, f"slack.jsonl/part-{k}.txt", "\n".join(json.dumps(x) for x in lines[k::3]))
    every = lambda path: sorted(str(r) for r in connectors.slack(spark, path, NOW).collect())
    assert every(f"file://{tmp_path}/slack.jsonl") == every(slack)


def test_calendar_resumes_behind_its_token(spark, tmp_path):
    one = {"id": "e1", "status": "confirmed", "summary": "sync", "updated": "2026-05-01T10:00:00Z", "start": {"dateTime": "2026-05-03T10:00:00+02:00"}, "attendees": [{"email": "a@x.org", "responseStatus": "accepted"}, {"email": ""}]}
    path = put(tmp_path, "cal.json", {"calendar": {"id": "work"}, "sync_batches": [{"sync_token": "T1", "events": [one, {"id": "e2", "start": {"date": "2026-05-04"}}]}, {"sync_token": "T2", "events": [{"id": "e1", "status": "cancelled", "updated": "2026-05-02T10:00:00Z"}]}]})
    count = lambda token: connectors.calendar(spark, path, NOW, token).count()
    assert (count(None), count("T1"), count("T2"), count("gone")) == (4, 1, 0, 4) and connectors.last_token(spark, path) == "T2"
    states = {r["entity_id"]: r for r in fold.materialize(connectors.calendar(spark, path, NOW).withColumn("seq", F.monotonically_increasing_id()), include_deleted=True).collect()}
    assert states["e1"]["deleted"] and states["e1"]["edges"]["attendee"] == ["a@x.org"] and states["e2"]["last_valid_at"] == datetime(2026, 5, 4)


def test_documents_and_mail(spark, tmp_path):
    docs = put(tmp_path, "docs.json", {"documents": [{"id": "d1", "name": "Plan", "owners": ["ann"], "revisions": [{"revision_id": "1", "modified_time": "2026-05-01T00:00:00Z", "exported_markdown": "# a"}, {"revision_id": "2", "modified_time": "2026-05-02T00:00:00Z", "exported_markdown": "# b"}]}, {"id": "d2", "name": "Empty", "revisions": []}]})
    states = {r["entity_id"]: r for r in fold.materialize(connectors.documents(spark, docs, NOW).withColumn("seq", F.monotonically_increasing_id())).collect()}
    assert states["d1"]["payload"]["markdown"] == "# b" and states["d1"]["version_count"] == 2 and len(states["d1"]["payload"]["content_hash"]) == 64 and states["d2"]["version_count"] == 0
    mail = put(tmp_path, "mail.json", {"historyId": "9", "messages": [{"id": "m1", "internalDate": "1777000000123", "from": "a", "subject": "s", "labelIds": ["INBOX"]}]})
    row = connectors.mail(spark, mail, NOW).first()
    assert row["parent_entity_ref"] == "m1" and row["valid_at"] == datetime(2026, 4, 24, 3, 6, 40, 123000) and row["payload"]["labelIds"] == '["INBOX"]'
    with pytest.raises(ValueError, match="unknown source"):
        connectors.build("fax")
    body = F.array(*[F.struct(F.lit(s).alias("style"), F.lit(t).alias("text")) for s, t in [("TITLE", "Top\n"), ("HEADING_2", "Two"), ("NORMAL_TEXT", "text"), ("NORMAL_TEXT", "\n")]])
    assert spark.range(1).select(connectors.markdown_of(body)).first()[0] == "# Top\n\n## Two\n\ntext\n"


def test_block_transcripts(spark, tmp_path):
    lines = [
        {"role": "user", "timestamp": "2026-05-01T10:00:00Z", "content": "move it"},
        {"role": "assistant", "timestamp": "2026-05-01T10:00:01Z", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "u1", "name": "gcal.update_event", "input": {"event_id": "e1", "n": 2}}]},
        {"role": "user", "timestamp": "2026-05-01T10:00:02Z", "content": [{"type": "tool_result", "tool_use_id": "u1", "content": [{"type": "text", "text": "do"}, {"type": "text", "text": "ne"}], "is_error": True}]},
        {"role": "assistant", "ts": "1777629603.5", "content": {"type": "text", "text": "sorry"}},
        {"role": "user", "content": None},
    ]
    runs, spans = transcripts.block_transcripts(spark, put(tmp_path, "t.jsonl", "\n".join(map(json.dumps, lines))))
    run = runs.first()
    assert runs.count() == 1 and run["n_spans"] == 5 and run["started_at"] == datetime(2026, 5, 1, 10) and run["ended_at"] == datetime(2026, 5, 1, 10, 0, 3, 500000)
    rows = spans.orderBy("pos").collect()
    assert [r["kind"] for r in rows] == ["agent", "user", "llm", "tool", "llm"] and len({r["span_id"] for r in rows}) == 5
    tool = rows[3]
    assert (tool["output"], tool["status"], dict(tool["tool_args"]), tool["ended_at"]) == ("done", "error", {"event_id": "e1", "n": "2"}, datetime(2026, 5, 1, 10, 0, 2))
    assert all(r["parent_id"] == rows[0]["span_id"] for r in rows[1:]) and rows[0]["parent_id"] is None
    ref = traces.span_refs(spans).first()
    assert (ref["app"], ref["entity_type"], ref["entity_id"], ref["role"]) == ("gcal", "event", "e1", "write")
    back = transcripts.from_otel(transcripts.to_otel(spans.withColumns({"tokens": F.lit(3).cast("bigint"), "cost_usd": F.lit(0.5), "attributes": F.create_map(F.lit("x"), F.lit("y"))})))
    kept = ["trace_id", "span_id", "parent_id", "kind", "input", "output", "tool_name", "status", "started_at", "ended_at"]
    assert sorted(back.select(*kept).collect(), key=repr) == sorted(spans.select(*kept).collect(), key=repr) and back.first()["attributes"] == {"x": "y"}


def test_files_of_one_name_stay_two_runs(spark, tmp_path):
    for folder, said in (("a", "first"), ("b", "second")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "session.jsonl").write_text(json.dumps({"role": "user", "content": said}) + "\n" + json.dumps({"role": "assistant", "content": "ok"}))
    runs, spans = transcripts.block_transcripts(spark, f"{tmp_path}/*/session.jsonl")
    assert runs.count() == runs.select("trace_id").distinct().count() == 2
    home = f"file://{tmp_path}/home"
    assert traces.ingest(runs, spans, home, "2026-01-01") == 2
    stored = traces.stored_spans(spark, home)
    assert {tuple(sorted(filter(None, r["said"]))) for r in stored.groupBy("trace_id").agg(F.collect_list("input").alias("said")).collect()} == {("first",), ("second",)}
    with pytest.raises(ValueError, match="have the id"):
        traces.ingest(runs.unionByName(runs), spans, home, "2026-01-01")


def test_item_transcripts_and_captures(spark, tmp_path):
    session = {"id": "s9", "items": [{"type": "message", "role": "user", "timestamp": "2026-05-01T10:00:00Z", "content": [{"text": "a"}, {"text": "b"}]}, {"type": "function_call", "name": "slack.post_message", "arguments": "{\"channel\": \"C1\"}", "output": "ok"}, {"type": "tool_call", "name": "x", "arguments": "not json"}, {"type": "message", "role": "assistant", "content": "done"}]}
    runs, spans = transcripts.item_transcripts(spark, put(tmp_path, "s.json", session))
    rows = spans.orderBy("pos").collect()
    assert runs.first()["group_id"] == "s9" and [r["kind"] for r in rows] == ["agent", "user", "tool", "tool", "llm"]
    assert rows[1]["input"] == "ab" and dict(rows[2]["tool_args"]) == {"channel": "C1"} and dict(rows[3]["tool_args"]) == {"raw": "not json"}
    captured = spark.createDataFrame([("a", 1, "UserPromptSubmit", datetime(2026, 1, 1), "hi", None, None, None), ("a", 2, "PostToolUse", datetime(2026, 1, 2), None, "t.get", '{"doc_id": "d"}', "r"), ("b", 1, "Stop", datetime(2026, 1, 1), None, None, None, None)], "session_id string, n int, name string, received_at timestamp, prompt string, tool_name string, tool_input string, tool_response string")
    runs, spans = transcripts.captured_runs(captured)
    assert [r["group_id"] for r in runs.collect()] == ["a"] and spans.count() == 3


def test_richer_capture_wins(spark):
    rows = [("t", 3, "x", datetime(2026, 1, 2)), ("t", 3, "first", datetime(2026, 1, 1)), ("t", 2, "y", datetime(2025, 1, 1)), ("u", 1, "z", datetime(2026, 1, 1))]
    got = {r["trace_id"]: r["who"] for r in traces.richest(spark.createDataFrame(rows, "trace_id string, n_spans long, who string, ingested_at timestamp")).collect()}
    assert got == {"t": "first", "u": "z"}


def test_small_files(spark, tmp_path):
    task = {"task_id": "t1", "prompt": "p", "memory_expected": ["m"], "expected_writes": [{"app": "gcal", "action": "a", "expect": {"x": {"contains": "u"}, "y": 1}}], "max_writes": 2}
    put(tmp_path, "task.json", task)
    row = files.tasks(spark, [str(tmp_path / "task.json")]).first()
    assert [tuple(f) for f in row["expected"][0]["fields"]] == [("x", "u", True), ("y", "1", False)] and row["max_writes"] == 2 and row["forbidden"] == []
    put(tmp_path, "seed.json", {"items": [{"type": "semantic", "namespace": "team", "claim": "c", "confidence": 0.5}]})
    assert files.memory_seed(spark, str(tmp_path / "seed.json")).first()["subject"] is None
    pages = spark.createDataFrame([("norms/a.md", "- x"), ("people/b.md", "- y")], "path string, body string")
    assert files.write_knowledge(pages, str(tmp_path / "kb")) == ["norms/a.md", "people/b.md"]
    assert sorted(r["body"].strip() for r in files.read_knowledge(spark, f"file://{tmp_path}/kb").collect()) == ["- x", "- y"]


def test_streamed_sync_is_idempotent_and_keeps_late_events(spark, tmp_path):
    source, log_path = tmp_path / "in", f"file://{tmp_path}/log"
    source.mkdir()
    line = lambda k, day: json.dumps({"event_id": f"e{k}", "app": "a", "entity_type": "t", "entity_id": "x", "op": "upsert_entity", "payload": {"k": str(k)}, "valid_at": f"2026-01-{day:02d}T00:00:00Z", "ingested_at": "2026-02-01T00:00:00Z"})
    (source / "1.json").write_text(line(1, 9) + "\n" + line(2, 8) + "\n" + line(1, 9))
    go = lambda: sync.start_sync(sync.read_events(spark, str(source)), log_path, str(tmp_path / "cp")).awaitTermination()
    go()
    (source / "2.json").write_text(line(2, 8) + "\n" + line(3, 1))
    go()
    assert sorted(r["event_id"] for r in segments.read(spark, log_path).collect()) == ["e1", "e2", "e3"]
    assert fold.materialize(log.as_of(segments.read(spark, log_path), "2026-01-08")).first()["payload"] == {"k": "2"}


def test_streamed_sessions_finish_when_they_close_or_fall_silent(spark, tmp_path):
    source, done = tmp_path / "in", f"file://{tmp_path}/done"
    source.mkdir()
    line = lambda s, name, k, prompt="p": json.dumps({"session_id": s, "hook_event_name": name, "received_at": f"2026-01-01T00:00:{k:02d}Z", "prompt": prompt})

    def go(idle=3600):
        """A run of its own from the checkpoint; how many entries the state then holds."""
        run = sync.start_sessions(sync.read_captures(spark, str(source)), done, str(tmp_path / "cp"), idle)
        run.awaitTermination()
        return run.lastProgress["stateOperators"][0]["numRowsTotal"]

    finished = lambda: {(r["session_id"], r["hook_event_name"], r["prompt"], r["finished"]) for r in spark.read.parquet(done).collect()}
    (source / "1.json").write_text("\n".join([line("a", "UserPromptSubmit", 1), line("b", "UserPromptSubmit", 2), line("a", "UserPromptSubmit", 1)]))
    assert go(idle=1) > 0 and finished() == set()
    (source / "2.json").write_text("\n".join([line("a", "UserPromptSubmit", 1), line("a", "Stop", 3), line("c", "PostToolUse", 4)]))
    time.sleep(1.2)  # b falls silent meanwhile
    assert go() > 0
    first = {("a", "UserPromptSubmit", "p", "closed"), ("a", "Stop", "p", "closed"), ("b", "UserPromptSubmit", "p", "idle")}
    assert finished() == first and spark.read.parquet(done).count() == 3
    (source / "3.json").write_text("\n".join([line("c", "SessionEnd", 5), line("a", "UserPromptSubmit", 9, "late"), line("a", "Stop", 10)]))
    assert go() == 0  # every session is finished, so nothing is held
    assert finished() == first | {("c", "PostToolUse", "p", "closed"), ("c", "SessionEnd", "p", "closed"), ("a", "UserPromptSubmit", "late", "closed"), ("a", "Stop", "p", "closed")}
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled", "true") == "true"
    windows = sync.windowed_activity(sync.read_events(spark, str(source)))
    assert windows.isStreaming


def test_an_export_streams_behind_its_token(spark, tmp_path):
    folder, log_path = tmp_path / "export", f"file://{tmp_path}/log"
    folder.mkdir()
    event = lambda k, **f: json.dumps({"id": f"e{k}", "status": "confirmed", "summary": f"s{k}", "updated": f"2026-01-{k % 27 + 1:02d}T00:00:00Z"} | f)

    def go():
        """(rows read, events in the log) after a run of its own from the checkpoint."""
        run = exports.start_calendar(spark, f"file://{folder}", log_path, str(tmp_path / "cp"), "2026-02-01", range_bytes=300)
        run.awaitTermination()
        return sum(p["numInputRows"] for p in run.recentProgress), segments.read(spark, log_path).count()

    (folder / "0001-T1.jsonl").write_text("\n".join(event(k) for k in range(40)) + "\n\n")
    assert go() == (40, 40)
    assert go() == (0, 40)
    (folder / "0002-T2.jsonl").write_text(event(1, status="cancelled", updated="2026-01-30T00:00:00Z") + "\n" + event(50))
    assert go() == (2, 42)
    # The token is gone: everything is read again, and only what is new is added.
    for old in folder.iterdir():
        old.unlink()
    (folder / "0003-T9.jsonl").write_text("\n".join(event(k) for k in (0, 50, 60)))
    assert go() == (3, 43)
    states = {r["entity_id"]: r["deleted"] for r in fold.materialize(segments.read(spark, log_path), include_deleted=True).collect()}
    assert len(states) == 42 and [k for k, gone in states.items() if gone] == ["e1"]
    lines = [b"x" * n for n in (1, 299, 300, 301, 5, 700)]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "1-A-B.jsonl").write_bytes(b"\n".join(lines))
    reader = exports.TokenReader(f"file://{tmp_path}/one", 300)
    found = [row for p in reader.partitions({"token": None}, reader.latestOffset()) for row in reader.read(p)]
    assert found == [("A-B", x.decode()) for x in lines]
