"""Library calls that the queries don't reach: places, cursors, lists in expectations, captures, retries, reports."""

import json
from datetime import datetime

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark import tables
from tidemark.functions import text
from tidemark.operators import evals, fold, log, memory, replay, reports, segments, stores, traces
from tidemark.sources import connectors, files, transcripts
from tidemark.streaming import sync


@pytest.fixture(params=["folder", "catalog"])
def place(request, spark, tmp_path):
    if request.param == "folder":
        yield stores.Place(spark, f"file://{tmp_path}/place")
    else:
        spark.sql(f"create database kept location 'file://{tmp_path}/kept'")
        yield stores.Place(spark, "catalog:kept")
        spark.sql("drop database kept cascade")


def test_places_keep_the_last_word(place, spark):
    assert place.migrate("2026-01-01") == 0 and place.migrate("2026-01-02") == stores.VERSION
    cursors = stores.Cursors(place)
    assert cursors.get("gcal", "events") is None
    for token, day in (("T1", 1), ("T2", 2)):
        cursors.set("gcal", "events", token, f"2026-01-0{day}")
    assert cursors.get("gcal", "events") == "T2" and cursors.get("gcal", "other") is None
    cursors.set("gcal", "events", None, "2026-01-03")
    assert cursors.get("gcal", "events") is None
    kept = stores.Memory(place)
    rows = spark.createDataFrame([("m1", "team", "s", "a"), ("m2", "user", "s", "b")], "memory_id string, namespace string, subject string, claim string")
    kept.add(rows)
    kept.add(rows)
    kept.add_edges(spark.createDataFrame([("m1", "m2", "supports")] * 2, "src_id string, dst_id string, relation string"))
    kept.set_active(rows.filter("memory_id = 'm1'").select("memory_id", F.lit(False).alias("active")), "2026-01-01")
    assert {(r["memory_id"], r["active"]) for r in kept.items().collect()} == {("m1", False), ("m2", True)}
    assert kept.get("m1").count() == kept.by_subject("user", "s").count() == kept.edges_from("m1").count() == 1 and kept.edges_from("m2").isEmpty()
    queue = stores.Approvals(place)
    asked = spark.createDataFrame([("item", "m1", "p"), ("item", "m2", "p")], "kind string, ref string, payload string")
    queue.enqueue(asked, "2026-01-01")
    first = queue.entries("pending").orderBy("ref").first()["approval_id"]
    queue.decide(spark.createDataFrame([(first, "approved", "n"), ("unknown", "approved", "n")], "approval_id string, status string, note string"), "2026-01-01")
    queue.enqueue(asked, "2026-01-03")
    assert {(r["ref"], r["status"], r["note"]) for r in queue.entries().collect()} == {("m1", "approved", "n"), ("m2", "pending", None)}


def test_a_folder_of_our_own_is_refused_on_a_cluster():
    class Cluster:
        conf = type("C", (), {"get": lambda self, k, d=None: d})()
        sparkContext = type("S", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Cluster())


def test_calendar_goes_on_behind_its_token(spark, tmp_path):
    event = lambda k: {"id": f"e{k}", "status": "confirmed", "summary": f"s{k}", "updated": f"2026-01-0{k}T00:00:00Z"}
    source, log_path, cursors = tmp_path / "c.json", f"file://{tmp_path}/log", stores.Cursors(stores.Place(spark, f"file://{tmp_path}/p"))
    go = lambda day, **o: connectors.run_sync(spark, "gcal", f"file://{source}", log_path, f"2026-02-0{day}", cursors, **o)
    source.write_text(json.dumps({"sync_batches": [{"sync_token": "T1", "events": [event(1)]}]}))
    assert go(1) == {"emitted": 1, "new": 1} and go(2) == {"emitted": 0, "new": 0}
    source.write_text(json.dumps({"sync_batches": [{"sync_token": "T1", "events": [event(1)]}, {"sync_token": "T2", "events": [event(2)]}]}))
    assert go(3) == {"emitted": 1, "new": 1} and go(4, force=True) == {"emitted": 2, "new": 0} and cursors.get("gcal", "events") == "T2"
    other = f"{log_path}-2"  # the log keeps the token with the events
    once = lambda **o: connectors.run_sync(spark, "gcal", f"file://{source}", other, "2026-02-05", resume=True, **o)
    assert once() == {"emitted": 2, "new": 2} and once() == {"emitted": 0, "new": 0} and segments.cursor(spark, other, "gcal", "events") == "T2"
    found = segments.read(spark, log_path)
    event_id = found.filter("entity_id = 'e2'").first()["event_id"]
    assert log.payload_of(found, event_id)["summary"] == "s2" and log.payload_of(found, "none") == {} and log.has_event(found, event_id) and not log.has_event(found, "none")


def test_expected_text_may_be_in_a_list(spark):
    values = [('["Vp-Product", "x"]', "product", True), ('["a", "b"]', "c", True), ("[not json", "NOT", True), ("plain", "plain", False), ('["a"]', "a", False), (None, "a", True)]
    df = spark.createDataFrame(values, "v string, e string, c boolean")
    assert [r[0] for r in df.select(evals.field_matches(F.col("v"), F.col("e"), F.col("c"))).collect()] == [True, False, True, True, False, None]


def test_frames_carry_fields_that_a_version_does_not_name(spark):
    rows = [(1, "upsert_entity", {"a": "1", "b": "x"}), (2, "append_version", {"a": "2"}), (3, "delete_entity", {}), (4, "append_version", {"a": "2", "c": None})]
    events = spark.createDataFrame([("app", "t", "e", k, datetime(2026, 1, k), op, p) for k, op, p in rows], "app string, entity_type string, entity_id string, seq long, valid_at timestamp, op string, payload map<string,string>")
    frames = fold.frames(events)
    got = {r["seq"]: (r["changed"], r["full"]) for r in frames.collect()}
    assert got == {1: ({"a": "1", "b": "x"}, {"a": "1", "b": "x"}), 2: ({"a": "2"}, {"a": "2", "b": "x"}), 3: ({}, {"a": "2", "b": "x"}), 4: ({"c": None}, {"a": "2", "b": "x", "c": None})}
    assert reports.timeline(frames).splitlines()[1].endswith("append_version  a=2")


def test_arguments_are_redacted_at_any_depth(spark):
    args = {"to": "a.b@example.org", "body": '{"Password": "x", "list": ["call 212 555 0100", {"n": 1, "ok": true}]}', "token": "t", "n": "7", "odd": "{not json"}
    row = spark.createDataFrame([(json.dumps(args),), (None,)], "raw string").select(text.redact_args("raw").alias("r")).collect()
    assert row[1]["r"]["args"] is None
    got, hits = row[0]["r"]["args"], row[0]["r"]["hits"]
    assert got["to"] == "[REDACTED_EMAIL]" and got["token"] == "[REDACTED]" and got["n"] == "7" and got["odd"] == "{not json"
    assert json.loads(got["body"]) == {"Password": "[REDACTED]", "list": ["call [REDACTED_PHONE]", {"n": 1, "ok": True}]} and hits == ["email", "key:password", "key:token", "phone"]


def test_transcripts_are_preferred_to_captures(spark):
    schema = "session_id string, n int, name string, received_at timestamp, prompt string, tool_name string, tool_input string, tool_response string"
    capture = lambda *sessions: transcripts.captured_runs(spark.createDataFrame([(s, k, "UserPromptSubmit", datetime(2026, 1, k), f"hi {k}", None, None, None) for s in sessions for k in (1, 2)], schema))
    runs, spans = transcripts.preferred(capture("a"), capture("a", "b"))
    assert sorted(r["group_id"] for r in runs.collect()) == ["a", "b"] and spans.count() == 6 and spans.select("trace_id").distinct().count() == 2


def test_richer_capture_replaces_the_thinner_ones_spans(spark, tmp_path):
    home = f"file://{tmp_path}/home"
    span = lambda k: ("t", f"s{k}", k, "x" * 50 if k == 2 else f"text {k}", None, None)
    runs = spark.createDataFrame([("t", "agent")], "trace_id string, agent string")
    for captured, day, new in (([span(1)], 1, 1), ([span(2), span(3)], 2, 1), ([span(2), span(3)], 3, 0), ([span(4)], 4, 1)):
        assert traces.ingest(runs, spark.createDataFrame(captured, "trace_id string, span_id string, pos int, input string, output string, tool_args map<string,string>"), home, f"2026-01-0{day}", 40) == new
    assert {r["span_id"]: r["input"].split("://")[0] for r in traces.stored_spans(spark, home, "t").collect()} == {"s2": "blob", "s3": "text 3"}
    assert [r["n_spans"] for r in traces.stored_runs(spark, home, "agent").collect()] == [2] and traces.stored_runs(spark, home, "other").isEmpty()
    assert spark.read.parquet(f"{home}/blobs").first()["body"] == "x" * 50


def test_knowledge_goes_to_any_file_system(spark, tmp_path):
    root = f"file://{tmp_path}/kb"
    assert files.write_knowledge(spark.createDataFrame([("a/b.md", "- é")], "path string, body string"), root) == ["a/b.md"]
    assert files.read_knowledge(spark, root).first()["body"].strip() == "- é"
    files.write_provenance(spark.createDataFrame([("m", "c", ["supports n"])], "memory_id string, claim string, relations array<string>"), root)
    assert [tuple(r) for r in files.read_provenance(spark, root).collect()] == [("m", "c", ["supports n"])]


def test_a_deleted_edge_leaves_an_empty_kind(spark):
    at = lambda k: F.lit(f"2026-01-0{k}").cast("timestamp")
    one = spark.range(1)
    edge = lambda f, k: f(one, app="a", entity_type="t", entity_id=F.lit("x"), valid_at=at(k), ingested_at=at(k), edge_kind="member", edge_target=F.lit("y")).withColumn("seq", F.lit(k).cast("bigint"))
    events = edge(log.upsert_edge, 1).unionByName(edge(log.delete_edge, 2))
    assert fold.materialize(events, "2026-01-01").first()["edges"] == {"member": ["y"]} and fold.materialize(events).first()["edges"] == {"member": []}


def test_failed_syncs_start_again(monkeypatch):
    class Query:
        def __init__(self, fails):
            self.fails = fails

        def awaitTermination(self):
            if self.fails:
                raise StreamingQueryException("lost")

    starts = iter([Query(True), Query(True), Query(False)])
    sync.keep_syncing(lambda: next(starts), attempts=3, wait_seconds=0)
    with pytest.raises(StreamingQueryException):
        sync.keep_syncing(lambda: Query(True), attempts=2, wait_seconds=0)


def test_cold_start_and_compile(spark):
    states = [("slack", "user", "U1", {"name": "al", "tz": "CET"}), ("slack", "channel", "C1", {"name": "gen", "topic": "all"}), ("gdocs", "document", "D1", {"name": "Plan", "owners": '["bo"]', "markdown": "We always ship on Friday.\nshort"}), ("slack", "message", "M1", {"text": "We never ship on Friday."})]
    df = spark.createDataFrame([(*s, False) for s in states] + [("slack", "user", "U2", {"name": "x", "tz": "CET"}, True)], "app string, entity_type string, entity_id string, payload map<string,string>, deleted boolean")
    items, edges = memory.cold_start(df, "2026-01-01")
    claims = {r["claim"]: (r["namespace"], r["confidence"] > 0, r["active"]) for r in items.collect()}
    assert {"al is in timezone CET", "Channel gen is for all", "Document Plan is owned by bo"} <= claims.keys() and len(claims) >= 4 and edges.columns == ["src_id", "dst_id", "relation"]
    assert claims["Document Plan is owned by bo"][0] == "project"


def test_backtest_with_retrieval_and_its_reports(spark):
    items = spark.createDataFrame([("m1", "fly united on the aisle", "user", 0.9, "personal", True, datetime(2026, 1, 1)), ("m2", "post notes weekly", "team", 0.9, "team", True, datetime(2026, 1, 1))], "doc string, claim string, namespace string, confidence double, acl string, active boolean, created_at timestamp").withColumn("text", F.col("claim"))
    edges = spark.createDataFrame([], "src_id string, dst_id string, relation string")
    expected = [("gcal", "gcal.create_event", [("summary", "united", True)])]
    tasks = spark.createDataFrame([("t1", "Book travel, fly to Redwood", datetime(2026, 2, 1), datetime(2026, 2, 1), expected, [], None, ["united"]), ("t2", "List what is there", datetime(2026, 1, 1), datetime(2026, 1, 1), [], [], 0, [])], "task_id string, prompt string, as_of_valid timestamp, as_of_ingest timestamp, expected array<struct<app:string,action:string,fields:array<struct<name:string,value:string,contains:boolean>>>>, forbidden array<string>, max_writes int, memory_expected array<string>")
    channel = lambda name, at: spark.createDataFrame([(name,)], "n string").select(F.lit("slack").alias("app"), F.lit("channel").alias("entity_type"), F.col("n").alias("entity_id"), F.lit("upsert_entity").alias("op"), F.create_map(F.lit("name"), "n").alias("payload"), F.lit(at).cast("timestamp").alias("valid_at"), F.lit(at).cast("timestamp").alias("ingested_at"), F.lit(1).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("edge_kind"), F.lit(None).cast("string").alias("edge_target"))
    events = channel("early", "2025-12-01").unionByName(channel("late", "2026-01-15"))
    runs = tables.stash(replay.backtest_memory(tasks, items, edges, events, "2026-02-01"), "t")
    by = {(r["task_id"], r["condition"]): r for r in runs.collect()}
    assert len(by) == 4 and by["t1", "with_memory"]["success"] and not by["t1", "without_memory"]["success"]
    assert by["t2", "with_memory"]["result"] == '["early"]'  # the later channel isn't there yet
    idle = lambda prompt, memory: F.struct(F.lit("slack.list_channels").alias("tool"), F.create_map().cast("map<string,string>").alias("args"))
    assert {r["tool"] for r in replay.backtest_memory(tasks, items, edges, events, "2026-02-01", policy=idle).collect()} == {"slack.list_channels"}
    found = replay.retrieve.retrieve(tasks, items, edges, "2026-02-01", "task_id", "prompt", searches=(replay.retrieve.lexical_top,))
    assert {(r["query"], r["doc"]) for r in found.collect()} == {("t1", "m1")}
    f = reports.figures(runs)
    assert (f["tasks"], f["win_rate"], f["mean_delta"]) == (2, 0.5, 0.3334) and "| t1 |" in reports.markdown(runs) and 'class="up"' in reports.html(runs)
    packs = spark.createDataFrame([("t1", "b", ["fly united"]), ("t1", "a", ["nothing"]), ("t1", "c", [])], "task_id string, pack string, claims array<string>")
    assert [(r["pack"], r["rank"]) for r in replay.explore(tasks, packs, events).orderBy("rank").collect()] == [("b", 0), ("a", 1), ("c", 2)]
