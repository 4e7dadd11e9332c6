"""Replay of tasks against a past state: a deterministic policy as columns, tools, faults and checks of what was written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import evals, fold, retrieve
from tidemark.operators.log import KEY
from tidemark.tables import stash

CALL = "struct<tool:string,args:map<string,string>>"
READ_TOOLS = ["slack.list_channels", "gcal.get_event", "gdocs.get_document"]
WRITE_TOOLS = ["slack.post_message", "slack.send_dm", "gcal.update_event", "gcal.create_event", "gcal.respond_event", "gdocs.create_document", "gdocs.update_document"]
TOOLS = READ_TOOLS + WRITE_TOOLS
#: Words that lead a command and name no project.
COMMAND_WORDS = ["announce", "post", "create", "reschedule", "draft", "send", "the", "a", "an", "my"]
PEOPLE = {"alice": "U_ALICE", "bob": "U_BOB", "carol": "U_CAROL"}


def _has(text: Column, *needles: str) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def _call(tool: str, **args) -> Column:
    parts = [x for k, v in args.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))]
    made = F.create_map(*parts) if parts else F.create_map()
    return F.struct(F.lit(tool).alias("tool"), made.cast("map<string,string>").alias("args")).cast(CALL)


def _pick(test: Column, yes: str, no: str) -> Column:
    return F.when(test, yes).otherwise(no)


def project_name(prompt: Column) -> Column:
    """The first word with a small letter behind its first that leads no command and begins with a capital."""
    words = F.regexp_extract_all(prompt, F.lit(r"\b([A-Za-z][a-z]+)\b"), F.lit(1))
    names = F.filter(words, lambda w: w.rlike("^[A-Z]") & ~F.lower(w).isin(COMMAND_WORDS))
    return F.coalesce(F.get(names, F.lit(0)), F.lit("Update"))


def event_named(prompt: Column) -> Column:
    """The event a prompt is about: one person has a known one."""
    return F.when(F.contains(F.lower(prompt), F.lit("bob")), "ev_1on1_bob").otherwise("ev_unknown")


def decide(prompt: Column, memory: Column) -> Column:
    """The tool call for a task: ordered rules, the first that fits; memory changes what a rule does, never which fits but one."""
    t, m = F.lower(prompt), F.lower(F.coalesce(memory, F.lit("")))
    name = project_name(prompt)
    person = F.when(F.lit(False), "U_UNKNOWN")
    for k, v in PEOPLE.items():
        person = person.when(F.contains(t, F.lit(k)), v)
    person = person.otherwise("U_UNKNOWN")
    both = lambda *words: F.lit(True) if not words else _has(m, words[0]) & both(*words[1:])
    start = F.when(_has(m, "afternoon"), "15:00").when(_has(m, "morning"), "09:00").otherwise("12:00")
    announced = F.when(both("is live", "launch"), F.concat(F.lit("Launch "), name, F.lit(" is live"))).otherwise(F.concat(F.lit("Announcing "), name))
    document = F.when(both("customer", "named"), F.concat(F.lit("Customer "), name, F.lit(" 2026-05-20"))).when(_has(t, "weekly", "summary"), F.concat(F.lit("Weekly Summary "), name)).otherwise(name)
    body = F.when(both("metric", "first"), "## Metrics\n## Highlights\n## Risks").when(_has(m, "section order", "template"), "## Attendees\n## Agenda\n## Decisions\n## Action Items").otherwise("## Notes")
    rules = [
        (_has(t, "decline", "optional"), _call("gcal.respond_event", event_id=event_named(prompt), response=_pick(both("optional attendees", "decline"), "declined", "accepted"))),
        (_has(t, "schedule", "external call") & ~_has(t, "reschedule"), _call("gcal.create_event", summary=F.concat(F.lit("Call "), name), start=_pick(_has(m, "before 10am", "10am pacific"), "10:00", "08:00"))),
        (_has(t, "travel", "itinerary", "flight"), _call("gcal.create_event", summary=F.concat(F.lit("Travel airline "), _pick(_has(m, "united"), "United", "any"), F.lit(" seat "), _pick(_has(m, "aisle"), "aisle", "any")))),
        (_has(t, "reschedule", "1:1"), _call("gcal.update_event", event_id=event_named(prompt), start=start)),
        (_has(t, "dm", "vip", "reply", "follow up with") & _has(m, "prefers direct messages", "personal reply", "high priority"), _call("slack.send_dm", user=person, text="Following up personally.")),
        (_has(t, "route"), _call("slack.post_message", channel=_pick(_has(m, "bugs go to", "engineering"), "engineering", "general"), text="Routing your request.")),
        (_has(t, "announce", "post"), _call("slack.post_message", channel=_pick(_has(m, "announcements"), "announcements", "general"), text=announced)),
        (_has(t, "approver", "invite", "review"), _call("gcal.create_event", summary="Approval", attendees=_pick(_has(m, "vp of product", "approver"), "vp-product", "team"))),
        (_has(t, "summary", "notes", "weekly"), _call("gdocs.create_document", name=document, body=body)),
        (_has(t, "update") & _has(t, "page", "project"), _call("gdocs.update_document", document_id=_pick(_has(m, "canonical", "overview"), "doc_redwood_overview", "doc_unknown"), body="Updated.")),
        (_has(t, "create") & _has(t, "doc"), _call("gdocs.create_document", name=document)),
        (_has(t, "decision", "prior", "scope"), _call("slack.post_message", channel="general", text=_pick(_has(m, "frozen", "do not reopen"), "Per the prior decision, scope is frozen.", "I could not find a prior decision."))),
    ]
    chain = None
    for test, action in rules:
        chain = F.when(test, action) if chain is None else chain.when(test, action)
    return chain.otherwise(_call(TOOLS[0]))


def execute(calls: DataFrame, states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Results of calls (call_id, tool, args): reads look up live state, writes are recorded and change no read.

    ``states`` is a fold with apps slack, gcal and gdocs. A channel is found by name or id (the least of equal names),
    and passes through if unknown. ``by`` names columns of both that tell states apart, as of points in time.
    """
    by = by or []
    live = states.filter(~F.col("deleted"))
    named = live.filter("app = 'slack' and entity_type = 'channel'").select(*by, F.col("payload")["name"].alias("__name"), F.col("entity_id").alias("__channel"))
    channels = named.groupBy(*by, "__name").agg(F.min("__channel").alias("__channel"))
    things = live.filter("(app = 'gcal' and entity_type = 'event') or (app = 'gdocs' and entity_type = 'document')").select(*by, F.col("app").alias("__of"), F.col("entity_id").alias("__want"), F.to_json("payload").alias("__payload"))
    wanted = calls.withColumn("__want", F.coalesce(F.col("args")["event_id"], F.col("args")["document_id"])).withColumn("__of", F.substring_index("tool", ".", 1)).withColumn("__name", F.col("args")["channel"])
    found = wanted.join(channels, [*by, "__name"], "left").join(things, [*by, "__want", "__of"], "left")
    names = named.groupBy(*by).agg(F.to_json(F.array_sort(F.collect_list("__name"))).alias("__names"))
    found = found.join(names, by, "left") if by else found.crossJoin(F.broadcast(names))  # one row without ``by``
    resolved = F.when(F.col("tool") == "slack.post_message", F.map_concat(F.map_filter("args", lambda k, v: k != "channel_id"), F.create_map(F.lit("channel_id"), F.coalesce("__channel", F.col("args")["channel"])))).otherwise(F.col("args"))
    result = F.when(F.col("tool") == "slack.list_channels", F.coalesce("__names", F.lit("[]"))).when(F.col("tool").isin("gcal.get_event", "gdocs.get_document"), F.coalesce("__payload", F.lit('{"error":"not_found"}'))).when(F.col("tool").isin(WRITE_TOOLS), '{"ok":true}').otherwise('{"error":"unknown_tool"}')
    return found.select(*by, "call_id", "tool", resolved.alias("args"), result.alias("result"), F.col("tool").isin(WRITE_TOOLS).alias("is_write"))


POINT = ["as_of_valid", "as_of_ingest"]


def run_conditions(tasks: DataFrame, mounted: DataFrame, events: DataFrame, policy: Callable[[Column, Column], Column] = decide, judge: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] = evals.judge) -> DataFrame:
    """Each task under each condition: what the policy calls, what that returns as of the task's point, and its scores.

    ``policy`` makes a call (tool, args) of a prompt and what memory says; ``judge`` scores tasks by writes and claims.

    ``tasks``: task_id, prompt, as_of_valid, as_of_ingest and what ``evals.judge`` asks for. ``mounted``: task_id,
    condition, claims. States are folded once for each point that tasks share, and the reads of a task see its own.
    """
    points = tasks.select(*POINT).distinct()
    seen = events.join(points, (F.col("valid_at") <= F.col(POINT[0])) & (F.col("ingested_at") <= F.col(POINT[1])))
    states = fold.materialize(seen, include_deleted=True, keys=[*POINT, *KEY])
    run = tasks.select("task_id", "prompt", *POINT).join(mounted, "task_id").withColumn("call", policy(F.col("prompt"), F.array_join("claims", "\n")))
    calls = run.select(F.struct("task_id", "condition").alias("call_id"), *POINT, "call.tool", "call.args")
    done = stash(execute(calls, states, POINT).select("call_id.*", "tool", "args", "result", "is_write"), "runs")
    write = F.struct(F.substring_index("tool", ".", 1).alias("app"), F.col("tool").alias("action"), F.col("args").alias("fields"))
    writes = done.select("task_id", "condition", F.filter(F.array(F.when(F.col("is_write"), write)), lambda w: w.isNotNull()).alias("writes"))
    return judge(tasks.drop("prompt", *POINT), writes, mounted).join(done.drop("is_write"), ["task_id", "condition"])


def backtest(tasks: DataFrame, claims: DataFrame, events: DataFrame, **options) -> DataFrame:
    """The paired run: every task without memory and with its claims (task_id, claims)."""
    none = F.array().cast("array<string>")
    both = F.array(F.struct(F.lit("without_memory").alias("condition"), none.alias("claims")), F.struct(F.lit("with_memory").alias("condition"), F.coalesce("claims", none).alias("claims")))
    return run_conditions(tasks, tasks.select("task_id").join(claims, "task_id", "left").select("task_id", F.explode(both).alias("c")).select("task_id", "c.*"), events, **options)


def backtest_memory(tasks: DataFrame, items: DataFrame, edges: DataFrame, events: DataFrame, now, top_k: int = 5, budget: int = 600, **options) -> DataFrame:
    """The paired run with what retrieval finds for each prompt among the items."""
    found = retrieve.packed(retrieve.retrieve(tasks, items, edges, now, "task_id", "prompt"), top_k, budget)
    return backtest(tasks, found.select(F.col("query").alias("task_id"), "claims"), events, **options)


def explore(tasks: DataFrame, packs: DataFrame, events: DataFrame, **options) -> DataFrame:
    """Runs of every task under each of its packs of claims (task_id, pack, claims), ranked by total, then name, from 0."""
    runs = run_conditions(tasks, packs.withColumnRenamed("pack", "condition"), events, **options).withColumnRenamed("condition", "pack")
    return runs.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("total"), "pack")) - 1)


def run_policy(tasks: DataFrame, memory: DataFrame) -> DataFrame:
    """(task_id, condition, tool, args): what the policy does with and without memory (task_id, memory)."""
    conditions = tasks.join(memory, "task_id", "left").withColumn("condition", F.explode(F.array(F.lit("without_memory"), F.lit("with_memory"))))
    call = decide(F.col("prompt"), F.when(F.col("condition") == "with_memory", F.col("memory")))
    return conditions.withColumn("call", call).select("task_id", "condition", "call.tool", "call.args")


def inject_faults(calls: DataFrame, faults: DataFrame) -> DataFrame:
    """Calls (run_id, pos, tool) with the fault (fault_no, tool, on_call, kind) that strikes each, the first listed.

    A fault of a tool counts that tool's calls in the run, a fault of no tool counts all.
    """
    per_tool = F.row_number().over(Window.partitionBy("run_id", "tool").orderBy("pos"))
    overall = F.row_number().over(Window.partitionBy("run_id").orderBy("pos"))
    counted = calls.withColumn("tool_call", per_tool).withColumn("any_call", overall)
    first = lambda rows, name, *by: rows.groupBy(*by).agg(F.min(F.struct("fault_no", "kind")).alias(name))
    of_tool = first(faults.filter("tool is not null"), "by_tool", "tool", F.col("on_call").alias("tool_call"))
    of_any = first(faults.filter("tool is null"), "by_any", F.col("on_call").alias("any_call"))
    struck = counted.join(of_tool, ["tool", "tool_call"], "left").join(of_any, "any_call", "left")
    return struck.select("run_id", "pos", "tool", F.least("by_tool", "by_any")["kind"].alias("fault"))


def fault_result(fault: Column, tool: Column) -> Column:
    """What a struck call returns."""
    return F.when(fault == "rate_limit", F.to_json(F.struct(F.lit("rate_limited").alias("error"), F.lit(1).alias("retry_after"), tool.alias("tool")))).when(fault == "empty", '{"result":null,"note":"empty result injected"}').when(fault == "stale", '{"stale":true,"note":"stale read injected"}').when(fault.isNotNull(), F.to_json(F.struct(F.lit("tool_failed").alias("error"), tool.alias("tool"))))


def no_forbidden(actions: Column, forbidden: Column) -> Column:
    return ~F.arrays_overlap(actions, forbidden)


def at_most(actions: Column, most: Column) -> Column:
    return most.isNull() | (F.size(actions) <= most)
