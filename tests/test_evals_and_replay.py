import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import ids
from tidemark.operators import evals, learn, replay


def lcg_interval(values, iterations=2000, seed=12345):
    """Draw by draw."""
    state, means, n = seed, [], len(values)
    for _ in range(iterations):
        total = 0.0
        for _ in range(n):
            state = (1103515245 * state + 12345) & 0x7FFFFFFF
            total += values[state % n]
        means.append(total / n)
    return sum(values) / n, float(np.quantile(means, 0.025)), float(np.quantile(means, 0.975))


@pytest.mark.parametrize("n", [2, 15, 40])
def test_bootstrap_is_the_stated_generator(n):
    values = [random.Random(n).choice([0.0, 0.6667, -0.2]) for _ in range(n)]
    assert evals.bootstrap_interval(np.array(values), iterations=300) == pytest.approx(lcg_interval(values, 300))
    assert evals.bootstrap_interval(np.array([])) == (0.0, 0.0, 0.0) and evals.bootstrap_interval(np.array([2.0])) == (2.0, 2.0, 2.0)


def test_published_figures(spark):
    """Fourteen of fifteen tasks gain 0.6667: the published interval and win rate."""
    deltas = [(k, 0.0 if k == 5 else 0.6667, "all") for k in range(15)]
    df = spark.createDataFrame(deltas, "task_id int, delta double, g string")
    row = evals.bootstrap(df, "g", "task_id", "delta").first()
    assert (row["estimate"], row["low"], row["high"]) == (0.6223, 0.5334, 0.6667)
    assert evals.win_rate(df).first()["win_rate"] == 0.9333
    rank = evals.wilcoxon(df).first()
    assert (rank["statistic"], rank["n"]) == (0.0, 14) and evals.normal_p(rank["z"]) == pytest.approx(0.001, abs=5e-4)


def test_wilcoxon_and_kappa_by_hand(spark):
    r = random.Random(9)
    deltas = [r.choice([-2, -1, 0, 1, 2, 3]) / 2 for _ in range(60)]
    nonzero = sorted((d for d in deltas if d), key=abs)
    rank = lambda d: sum(abs(x) < abs(d) for x in nonzero) + (sum(abs(x) == abs(d) for x in nonzero) + 1) / 2
    stat = min(sum(rank(d) for d in nonzero if d > 0), sum(rank(d) for d in nonzero if d < 0))
    n = len(nonzero)
    row = evals.wilcoxon(spark.createDataFrame([(d,) for d in deltas], "delta double")).first()
    assert (row["statistic"], row["n"], row["z"]) == (stat, n, pytest.approx((stat - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24), abs=1e-6))
    pairs = [(r.randrange(3), r.randrange(3)) for _ in range(90)]
    same = sum(a == b for a, b in pairs) / 90
    chance = sum(sum(a == k for a, _ in pairs) * sum(b == k for _, b in pairs) for k in range(3)) / 8100
    assert evals.kappa(spark.createDataFrame(pairs, "a int, b int"), "a", "b").first()["kappa"] == round((same - chance) / (1 - chance), 4)
    assert evals.kappa(spark.createDataFrame([(1, 1)] * 3, "a int, b int"), "a", "b").first()["kappa"] == 1.0


POLICY = [
    ("Decline the optional sync with Bob", "optional attendees should decline", "gcal.respond_event", {"event_id": "ev_1on1_bob", "response": "declined"}),
    ("Schedule an external call with Redwood", "", "gcal.create_event", {"summary": "Call Schedule", "start": "08:00"}),
    ("Reschedule my 1:1", "mornings please: morning", "gcal.update_event", {"event_id": "ev_unknown", "start": "09:00"}),
    ("Reply to the VIP alice", "alice prefers direct messages", "slack.send_dm", {"user": "U_ALICE", "text": "Following up personally."}),
    ("Route this bug", "", "slack.post_message", {"channel": "general", "text": "Routing your request."}),
    ("Announce Falcon", "say it is live at launch in announcements", "slack.post_message", {"channel": "announcements", "text": "Launch Falcon is live"}),
    ("Draft weekly notes for Redwood", "metrics come first", "gdocs.create_document", {"name": "Weekly Summary Redwood", "body": "## Metrics\n## Highlights\n## Risks"}),
    ("Update the project page", "canonical", "gdocs.update_document", {"document_id": "doc_redwood_overview", "body": "Updated."}),
    ("what was in scope", "", "slack.post_message", {"channel": "general", "text": "I could not find a prior decision."}),
    ("create the doc", "", "gdocs.create_document", {"name": "Update"}),
    ("hello", "", "slack.list_channels", {}),
]


@pytest.mark.parametrize(("prompt", "memory", "tool", "args"), POLICY)
def test_policy(spark, prompt, memory, tool, args):
    call = spark.range(1).select(replay.decide(F.lit(prompt), F.lit(memory)).alias("c")).first()["c"]
    assert (call["tool"], dict(call["args"])) == (tool, args)


def test_tools_faults_and_judging(spark):
    states = spark.createDataFrame([("slack", "channel", "C1", {"name": "general"}, False), ("gcal", "event", "evt_1", {"summary": "x"}, False), ("gcal", "event", "evt_2", {"summary": "y"}, True)], "app string, entity_type string, entity_id string, payload map<string,string>, deleted boolean")
    calls = spark.createDataFrame([(1, "slack.post_message", {"channel": "general", "text": "t"}), (2, "slack.post_message", {"channel": "nowhere"}), (3, "gcal.get_event", {"event_id": "evt_1"}), (4, "gcal.get_event", {"event_id": "evt_2"}), (5, "slack.list_channels", {}), (6, "nope", {})], "call_id int, tool string, args map<string,string>")
    got = {r["call_id"]: r for r in replay.execute(calls, states).collect()}
    assert got[1]["args"]["channel_id"] == "C1" and got[2]["args"]["channel_id"] == "nowhere" and got[1]["is_write"]
    assert got[3]["result"] == '{"summary":"x"}' and "not_found" in got[4]["result"] and got[5]["result"] == '["general"]' and "unknown" in got[6]["result"]
    runs = spark.createDataFrame([("r", k, t) for k, t in enumerate("abaab")], "run_id string, pos int, tool string")
    faults = spark.createDataFrame([(1, "a", 2, "rate_limit"), (2, None, 3, "empty"), (3, "b", 2, "error")], "fault_no int, tool string, on_call int, kind string")
    struck = {r["pos"]: r["fault"] for r in replay.inject_faults(runs, faults).collect()}
    assert struck == {0: None, 1: None, 2: "rate_limit", 3: None, 4: "error"}
    body = spark.range(1).select(replay.fault_result(F.lit("rate_limit"), F.lit("t")), replay.fault_result(F.lit("odd"), F.lit("t")), replay.fault_result(F.lit(None).cast("string"), F.lit("t"))).first()
    assert tuple(body) == ('{"error":"rate_limited","retry_after":1,"tool":"t"}', '{"error":"tool_failed","tool":"t"}', None)
    fields = "array<struct<name:string,value:string,contains:boolean>>"
    tasks = spark.createDataFrame([(1, [("gcal", "create", [("summary", "united", True), ("seat", "aisle", False)])], ["send"], 1, ["aisle"]), (2, [], [], None, [])], f"task_id int, expected array<struct<app:string,action:string,fields:{fields}>>, forbidden array<string>, max_writes int, memory_expected array<string>")
    write = ("gcal", "create", {"summary": "Fly United", "seat": "aisle"})
    writes = spark.createDataFrame([(1, "good", [write]), (1, "bad", [("gcal", "create", {"summary": "x"}), ("a", "send", {})]), (1, "many", [write, write]), (2, "none", [])], "task_id int, condition string, writes array<struct<app:string,action:string,fields:map<string,string>>>")
    claims = spark.createDataFrame([(1, "good", ["prefers the aisle"])], "task_id int, condition string, claims array<string>")
    scores = {(r["task_id"], r["condition"]): (r["task_outcome"], r["action_validity"], r["memory_retrieval"], r["total"], r["outcome_score"], r["success"]) for r in evals.judge(tasks, writes, claims).collect()}
    assert scores == {(1, "good"): (1.0, 1.0, 1.0, 1.0, 1.0, True), (1, "bad"): (0.0, 0.0, 0.0, 0.0, 0.0, False), (1, "many"): (1.0, 0.5, 0.0, 0.7, 0.8333, False), (2, "none"): (1.0, 1.0, 1.0, 1.0, 1.0, True)}


def test_small_models_learn_and_predict(spark):
    rows = [({"a": 1.0}, 1.0), ({"b": 1.0}, 0.0)] * 10
    bias, weights = learn.fit_logistic(rows, 0.5, 50)
    assert weights["a"] > 1 and weights["b"] < -1
    examples = spark.createDataFrame([(k, q, n) for k, (q, n) in enumerate([("my tea", "user"), ("our norm", "team")] * 10)], "ord int, query string, namespace string")
    model = learn.fit_router(examples, ["user", "team"])
    asked = spark.createDataFrame([(1, "tea", 1.0), (2, "norm", 1.0)], "id int, feature string, value double")
    best = {r["id"]: r["model"] for r in learn.predict(asked, model, "id").groupBy("id").agg(F.max_by("model", "p").alias("model")).collect()}
    assert best == {1: "user", 2: "team"}


def test_mined_tasks(spark):
    sequences = spark.createDataFrame([("t1", ["a", "b"]), ("t2", ["a", "b"]), ("t3", ["c"]), ("t4", [])], "trace_id string, tools array<string>")
    said = spark.createDataFrame([("t1", "correction", "Actually use blue paint"), ("t2", "correction", "use paint, blue, actually"), ("t3", "explicit", "I prefer tea"), ("t4", "explicit", "I prefer tea")], "trace_id string, source string, text string")
    got = {tuple(r) for r in evals.mine(sequences, said).collect()}
    assert got == {("repeated_request", "Recurring workflow a>b", 2), ("correction", "Repeated correction about actually blue paint", 2), ("durable_statement", "I prefer tea", 1)}


def test_queue_identity(spark):
    assert spark.range(1).select(ids.new_id("appr", claim=F.lit("a"), namespace=F.lit(None))).first()[0].startswith("appr_")


def test_percentiles_by_selection(spark):
    r = random.Random(6)
    rows = [(g, r.choice([None, float(r.randrange(9)), r.random() * 100])) for g in ["hot"] * 900 + ["cold"] * 7 + [None] * 30] + [("one", 4.0), ("none", None)]
    got = {x["g"]: tuple(x)[1:] for x in evals.percentiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "v", [0.05, 0.5, 0.95, 1.0], ["g"]).collect()}
    for g in {g for g, _ in rows} - {"none"}:
        v = sorted(x for k, x in rows if k == g and x is not None)
        want = tuple(v[int(h)] + (v[min(int(h) + 1, len(v) - 1)] - v[int(h)]) * (h - int(h)) for h in (q * (len(v) - 1) for q in (0.05, 0.5, 0.95, 1.0)))
        assert all(abs(a - b) < 1e-4 for a, b in zip(got[g], want, strict=True)), g
    assert "none" not in got
