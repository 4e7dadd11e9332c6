import json

import pytest

from tidemark import cli


def call(capsys, *argv):
    assert cli.main(list(argv)) == 0
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_sync_history_and_snapshots(spark, tmp_path, capsys):
    mail = tmp_path / "mail.json"
    mail.write_text(json.dumps({"historyId": "1", "messages": [{"id": "m1", "internalDate": "1777000000000", "subject": "a"}, {"id": "m2", "internalDate": "1777900000000", "subject": "b"}]}))
    home = ["--home", f"file://{tmp_path}/home"]
    sync = [*home, "sync", "run", "gmail", f"file://{mail}", "--ingested-at", "2026-05-05"]
    assert call(capsys, *sync) == [{"emitted": 2, "new": 2}] and call(capsys, *sync) == [{"emitted": 2, "new": 0}]
    assert {r.get("app") for r in call(capsys, *home, "sync", "stats")} == {"gmail", None}
    assert [r["op"] for r in call(capsys, *home, "history", "log", "--end", "2026-04-30")] == ["upsert_entity"]
    assert call(capsys, *home, "history", "show", "gmail", "message", "m2")[0]["payload"]["subject"] == "b"
    assert len(call(capsys, *home, "history", "ls", "--app", "gmail")) == 2
    assert call(capsys, *home, "history", "checkout", "2026-04-30") == []  # nothing was known by then
    assert len(call(capsys, *home, "history", "checkout", "2026-06-01")) == 2
    assert [r["change"] for r in call(capsys, *home, "history", "diff", "2026-04-30", "2026-06-01")] == ["created"]
    made = call(capsys, *home, "snapshot", "create", "2026-06-01")[0]
    assert made["entities"] == 2 and call(capsys, *home, "snapshot", "list")[0]["root"] == made["root"]


def test_traces(spark, tmp_path, capsys):
    lines = tmp_path / "t.jsonl"
    lines.write_text("\n".join(json.dumps(x) for x in [{"role": "user", "timestamp": "2026-05-01T10:00:00Z", "content": "hi"}, {"role": "assistant", "content": "yo"}]))
    home = ["--home", f"file://{tmp_path}/home"]
    assert call(capsys, *home, "trace", "ingest", f"file://{lines}", "--format", "blocks", "--ingested-at", "2026-05-05") == [{"runs": 1}]
    run = call(capsys, *home, "trace", "list")[0]
    assert run["n_spans"] == 3 and [r["kind"] for r in call(capsys, *home, "trace", "show", run["trace_id"])] == ["agent", "user", "llm"]


def test_memory_evaluation_and_pictures(spark, tmp_path, capsys):
    def said(*argv):
        assert cli.main(list(argv)) == 0
        return capsys.readouterr().out

    lines = lambda who: "\n".join(json.dumps(x) for x in [{"role": "user", "timestamp": "2026-05-01T10:00:00Z", "content": "I prefer to fly United on the aisle"}, {"role": "user", "timestamp": "2026-05-01T10:00:01Z", "content": f"my mail is {who}@example.org"}])
    (tmp_path / "t.jsonl").write_text(lines("a.b"))
    (tmp_path / "hooks.jsonl").write_text(json.dumps({"session_id": "t", "hook_event_name": "UserPromptSubmit", "received_at": "2026-05-01T10:00:00Z", "prompt": "I prefer to fly United on the aisle"}))
    mail = tmp_path / "mail.json"
    mail.write_text(json.dumps({"messages": [{"id": "m1", "internalDate": "1777000000000", "subject": "a"}]}))
    (tmp_path / "task.json").write_text(json.dumps({"task_id": "t1", "prompt": "Book travel for Redwood: which airline to fly", "as_of_valid": "2026-06-01", "as_of_ingest": "2026-06-01", "memory_expected": ["united"], "expected_writes": [{"app": "gcal", "action": "gcal.create_event", "expect": {"summary": {"contains": "united"}}}]}))
    home = ["--home", f"file://{tmp_path}/home"]
    call(capsys, *home, "sync", "run", "gmail", f"file://{mail}", "--ingested-at", "2026-05-05")
    assert call(capsys, *home, "trace", "hook", f"file://{tmp_path}/hooks.jsonl", "--ingested-at", "2026-05-01") == [{"runs": 1}]
    (tmp_path / "moved").mkdir()
    (tmp_path / "t.jsonl").rename(tmp_path / "moved" / "t.jsonl")
    assert call(capsys, *home, "trace", "ingest", f"file://{tmp_path}/moved/t.jsonl", "--format", "blocks", "--ingested-at", "2026-05-02") == [{"runs": 1}]
    run = call(capsys, *home, "trace", "list", "--agent", "assistant")
    assert len(run) == 1 and run[0]["n_spans"] == 3  # the transcript is the richer capture of the session that hooks saw
    shown = call(capsys, *home, "trace", "show", run[0]["trace_id"])
    assert [r.get("input") for r in shown] == [None, "I prefer to fly United on the aisle", "my mail is [REDACTED_EMAIL]"] and shown[2]["redactions"] == ["email"]
    assert call(capsys, *home, "memory", "compile", "--now", "2026-05-06") == [{"items": 1, "active": 1}] == call(capsys, *home, "memory", "compile", "--now", "2026-05-06")
    item = call(capsys, *home, "memory", "list")[0]
    assert item["claim"] == "I prefer to fly United on the aisle"
    assert call(capsys, *home, "memory", "retrieve", "which airline to fly", "--now", "2026-05-06")[0]["claims"] == [item["claim"]]
    report = said(*home, "eval", "run", str(tmp_path / "task.json"), "--now", "2026-05-06")
    assert "| t1 | 0.0 | 1.0 | 1.0 | 1.0 | 1.0 | 0.6667 |" in report
    assert "<td>t1</td>" in said(*home, "eval", "html", str(tmp_path / "task.json"), "--now", "2026-05-06")
    assert "upsert_entity" in said(*home, "viz", "timeline", "gmail", "message", "m1")
    assert item["memory_id"] in said(*home, "viz", "provenance") and "digraph" in said(*home, "viz", "provenance", "--format", "dot")
    first, second = (call(capsys, *home, "snapshot", "create", at)[0]["snapshot_id"] for at in ("2026-01-01", "2026-06-01"))
    assert [r["change"] for r in call(capsys, *home, "snapshot", "diff", first, second)] == ["created"]
    assert call(capsys, *home, "snapshot", "show", second)[0]["payload"]["subject"] == "a"
    assert call(capsys, *home, "info", "show")[0]["items"] == 1


def test_version_and_unknown(capsys):
    assert cli.main(["version"]) == 0 and capsys.readouterr().out.strip() == "0.1.0"
    with pytest.raises(SystemExit):
        cli.main(["history", "nothing"])
