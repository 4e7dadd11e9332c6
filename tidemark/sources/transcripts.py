"""Agent transcripts and span exports become runs and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import ids
from tidemark.operators import traces

BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"
SPAN = "struct<kind:string,name:string,tool_name:string,tool_args:map<string,string>,input:string,output:string,started_at:timestamp,ended_at:timestamp,status:string>"


def parse_time(text: Column) -> Column:
    """ISO time or seconds since the epoch."""
    return F.coalesce(ids.from_epoch(F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text)), ids.from_iso(text))


def blocks(content: Column) -> Column:
    """Content that is a string, a block or a list of either, as a list of blocks; ``content`` is JSON text."""
    one = lambda body: F.from_json(F.concat(F.lit("["), body, F.lit("]")), BLOCKS)
    as_text = lambda s: F.to_json(F.struct(F.lit("text").alias("type"), s.alias("text")))
    items = F.from_json(content, "array<string>")
    listed = F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.when(F.startswith(F.ltrim(x), F.lit("{")), x).otherwise(as_text(x))), ","), F.lit("]"))
    plain = F.ltrim(content)
    return F.when(content.isNull(), F.from_json(F.lit("[]"), BLOCKS)).when(F.startswith(plain, F.lit("[")), F.from_json(listed, BLOCKS)).when(F.startswith(plain, F.lit("{")), one(content)).otherwise(one(as_text(content)))


def text_of(content: Column) -> Column:
    """Text of a string or of a list of text blocks."""
    parts = F.from_json(content, "array<struct<text:string>>")
    return F.when(F.startswith(F.ltrim(content), F.lit("[")), F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")).otherwise(content)


def arguments(raw: Column) -> Column:
    """Arguments as a map of text: JSON objects as they are, other JSON under ``value``, other text under ``raw``."""
    parsed = F.from_json(raw, "map<string,string>")
    is_json = F.try_parse_json(raw).isNotNull()
    other = F.when(is_json, F.create_map(F.lit("value"), raw)).otherwise(F.create_map(F.lit("raw"), raw))
    return F.when(raw.isNull(), F.create_map().cast("map<string,string>")).when(F.startswith(F.ltrim(raw), F.lit("{")) & is_json, parsed).otherwise(other)


def file_stem(path: Column) -> Column:
    """A file's name without its folders and its ending."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def preferred(transcripts: tuple[DataFrame, DataFrame], captures: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(runs, spans): transcripts, and captures of hooks for the sessions (groups) that have none."""
    (runs, spans), (more, more_spans) = transcripts, captures
    more = more.join(runs.select("group_id"), "group_id", "left_anti").select(*runs.columns)
    return runs.unionByName(more), spans.unionByName(more_spans.join(more.select("trace_id"), "trace_id", "left_semi"))


def _finish(rows: DataFrame, agent: str, workflow: str = "operational_assistant") -> tuple[DataFrame, DataFrame]:
    """(runs, spans) from rows (session, group_id, ord, span, seen): a root span, positions, ids and references.

    A run is told by its agent, its group and its first time: by no path, so a moved file is the same run, and a
    capture of hooks meets the transcript of its session. Without a time what it says first tells it, so files of one name
    stay apart.
    """
    bounds = rows.groupBy("session").agg(F.first("group_id", ignorenulls=True).alias("group_id"), F.min("seen").alias("started_at"), F.max("seen").alias("ended_at"), (F.count("span") + 1).alias("n_spans"), F.min_by(F.struct("span.kind", "span.name", "span.input", "span.output"), F.when(F.col("span").isNotNull(), F.col("ord"))).alias("opening"))
    opening = F.concat(F.lit("opening:"), ids.sha256_hex(F.coalesce(F.to_json("opening"), F.lit(""))))
    trace = ids.new_id("trace", agent=F.lit(agent), workflow_name=F.lit(workflow), group_id=F.col("group_id"), started_at=F.coalesce(ids.to_iso(F.col("started_at")), opening))
    runs = bounds.withColumn("trace_id", trace).drop("opening")
    order = Window.partitionBy("session").orderBy("ord")
    body = rows.filter("span is not null").withColumn("pos", F.row_number().over(order)).select("session", "pos", "span.*")
    none = F.lit(None)
    root = runs.select("session", F.lit(0).alias("pos"), F.lit("agent").alias("kind"), F.concat(F.lit(agent), F.lit("_session")).alias("name"), none.cast("string").alias("tool_name"), none.cast("map<string,string>").alias("tool_args"), none.cast("string").alias("input"), none.cast("string").alias("output"), none.cast("timestamp").alias("started_at"), none.cast("timestamp").alias("ended_at"), F.lit("ok").alias("status"))
    spans = root.unionByName(body).join(runs.select("session", "trace_id"), "session").drop("session")
    top = ids.new_id("span", kind=F.lit("agent"), name=F.concat(F.lit(agent), F.lit("_session")), trace_id=F.col("trace_id"))
    spans = spans.withColumn("parent_id", F.when(F.col("pos") > 0, top))
    spans = traces.with_span_ids(spans).withColumn("span_id", F.when(F.col("pos") == 0, top).otherwise(F.col("span_id")))
    return runs.select("trace_id", "group_id", F.lit(workflow).alias("workflow_name"), F.lit(agent).alias("agent"), "started_at", "ended_at", F.lit("ok").alias("status"), "n_spans"), spans


def _span(kind: Column, name: Column, seen: Column, tool: Column | None = None, args: Column | None = None, said: Column | None = None, out: Column | None = None, ended: Column | None = None, status: Column | None = None) -> Column:
    none = F.lit(None)
    pick = lambda x, t: (x if x is not None else none).cast(t)
    return F.struct(
        kind.alias("kind"), name.alias("name"), pick(tool, "string").alias("tool_name"), pick(args, "map<string,string>").alias("tool_args"), pick(said, "string").alias("input"), pick(out, "string").alias("output"),
        seen.alias("started_at"), pick(ended, "timestamp").alias("ended_at"), (status if status is not None else F.lit("ok")).alias("status"),
    ).cast(SPAN)


def block_transcripts(spark: SparkSession, path: str, agent: str = "assistant", group_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(runs, spans) of JSON Lines transcripts whose messages hold typed blocks; a file is a session and names its group.

    A tool use is paired with the first result of its id by a join within the session; user text and assistant text are
    spans of their own.
    """
    raw = spark.read.schema("role string, type string, timestamp string, ts string, content string").json(path)
    lines = raw.select(F.col("_metadata.file_path").alias("session"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("line"), F.coalesce("role", "type").alias("role"), parse_time(F.coalesce("timestamp", "ts")).alias("seen"), F.posexplode_outer(blocks(F.col("content"))).alias("b_pos", "b"))
    lines = lines.withColumn("ord", F.struct("line", "b_pos"))
    results = lines.filter("b.type = 'tool_result'").groupBy(F.col("session").alias("res_session"), F.col("b.tool_use_id").alias("use_id")).agg(F.min_by(F.struct(text_of(F.col("b.content")).alias("out"), F.coalesce("b.is_error", F.lit(False)).alias("bad"), F.col("seen").alias("at")), "ord").alias("res"))
    joined = lines.join(results, (F.col("session") == F.col("res_session")) & (F.col("b.id") == F.col("use_id")) & (F.col("b.type") == "tool_use"), "left")
    args = arguments(F.col("b.input"))
    tool = _span(F.lit("tool"), F.coalesce("b.name", F.lit("tool")), F.col("seen"), F.coalesce("b.name", F.lit("tool")), args, ids.canonical_map(args), F.col("res.out"), F.col("res.at"), F.when(F.col("res.bad"), "error").otherwise("ok"))
    span = (
        F.when(F.col("b.type") == "tool_use", tool)
        .when((F.col("b.type") == "text") & (F.col("role") == "user"), _span(F.lit("user"), F.lit("user_message"), F.col("seen"), said=F.col("b.text")))
        .when((F.col("b.type") == "text") & (F.col("role") == "assistant"), _span(F.lit("llm"), F.lit("assistant_message"), F.col("seen"), out=F.col("b.text")))
    )
    group = F.coalesce(F.lit(group_id).cast("string"), file_stem(F.col("session")))
    return _finish(joined.select("session", group.alias("group_id"), "ord", "seen", span.alias("span")), agent)


def item_transcripts(spark: SparkSession, path: str, agent: str = "coder", group_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(runs, spans) of session objects with an ``items`` list of messages and calls; a file is a session."""
    item = "struct<type:string,role:string,timestamp:string,content:string,name:string,arguments:string,output:string>"
    raw = spark.read.schema(f"id string, items array<{item}>").option("multiLine", True).json(path)
    rows = raw.select(F.col("_metadata.file_path").alias("session"), F.coalesce(F.lit(group_id).cast("string"), "id", file_stem(F.col("_metadata.file_path"))).alias("group_id"), F.posexplode("items").alias("ord", "i")).withColumn("seen", parse_time(F.col("i.timestamp")))
    said, args = text_of(F.col("i.content")), arguments(F.col("i.arguments"))
    name = F.coalesce("i.name", F.lit("tool"))
    span = (
        F.when((F.col("i.type") == "message") & (F.col("i.role") == "user"), _span(F.lit("user"), F.lit("user_message"), F.col("seen"), said=said))
        .when(F.col("i.type") == "message", _span(F.lit("llm"), F.lit("assistant_message"), F.col("seen"), out=said))
        .when(F.col("i.type").isin("function_call", "tool_call"), _span(F.lit("tool"), name, F.col("seen"), name, args, ids.canonical_map(args), F.col("i.output"), F.col("seen")))
    )
    return _finish(rows.select("session", "group_id", "ord", "seen", span.alias("span")), agent)


def read_hook_log(spark: SparkSession, path: str) -> DataFrame:
    """Captured events from JSON Lines that hooks have appended, numbered by their time."""
    raw = spark.read.schema("session_id string, hook_event_name string, received_at string, prompt string, tool_name string, tool_input string, tool_response string").json(path)
    at = parse_time(F.col("received_at"))
    return raw.select("session_id", F.row_number().over(Window.partitionBy("session_id").orderBy(at, "hook_event_name")).alias("n"), F.col("hook_event_name").alias("name"), at.alias("received_at"), "prompt", "tool_name", "tool_input", "tool_response")


def captured_runs(captures: DataFrame, agent: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """(runs, spans) of captured hook events (session_id, n, name, received_at, prompt, tool_name, tool_input, tool_response).

    The fallback where no transcript is there: prompts and finished tool calls. Sessions without either are dropped.
    """
    args = arguments(F.col("tool_input"))
    tool = F.coalesce("tool_name", F.lit("tool"))
    span = F.when(F.col("name") == "UserPromptSubmit", _span(F.lit("user"), F.lit("user_message"), F.col("received_at"), said=F.coalesce("prompt", F.lit("")))).when(F.col("name") == "PostToolUse", _span(F.lit("tool"), tool, F.col("received_at"), tool, args, ids.canonical_map(args), F.col("tool_response"), F.col("received_at")))
    rows = captures.select(F.col("session_id").alias("session"), F.col("session_id").alias("group_id"), F.col("n").alias("ord"), F.col("received_at").alias("seen"), span.alias("span"))
    runs, spans = _finish(rows, agent)
    full = runs.filter("n_spans > 1")
    return full, spans.join(full.select("trace_id"), "trace_id", "left_semi")


# Span kinds of the exchange format, and the attribute each field travels in.
KINDS = {"agent": "AGENT", "llm": "LLM", "tool": "TOOL", "user": "CHAIN", "other": "UNKNOWN"}
ATTRIBUTES = {"input": "input.value", "output": "output.value", "tool_name": "tool.name", "tokens": "llm.token_count.total", "cost_usd": "tidemark.cost_usd"}
KIND_ATTRIBUTE, EXACT_KIND, ARGS_ATTRIBUTE = "openinference.span.kind", "tidemark.kind", "tool.parameters"


def to_otel(spans: DataFrame) -> DataFrame:
    """Spans as exchange rows with a map of attributes; nothing is lost."""
    kind = F.when(F.lit(False), "")
    for k, v in KINDS.items():
        kind = kind.when(F.col("kind") == k, v)
    fields = F.create_map(*[x for f, a in ATTRIBUTES.items() for x in (F.lit(a), F.col(f).cast("string"))], F.lit(KIND_ATTRIBUTE), kind.otherwise("UNKNOWN"), F.lit(EXACT_KIND), F.col("kind"), F.lit(ARGS_ATTRIBUTE), ids.canonical_map(F.col("tool_args")))
    attributes = F.map_concat(F.coalesce("attributes", F.create_map().cast("map<string,string>")), F.map_filter(fields, lambda k, v: v.isNotNull()))
    return spans.select("trace_id", "span_id", "parent_id", F.coalesce("name", "kind").alias("name"), ids.to_iso(F.col("started_at")).alias("start_time"), ids.to_iso(F.col("ended_at")).alias("end_time"), F.upper("status").alias("status_code"), attributes.alias("attributes"))


def from_otel(rows: DataFrame) -> DataFrame:
    """Spans from exchange rows; attributes that name no field stay in the map."""
    a = F.col("attributes")
    known = [*ATTRIBUTES.values(), KIND_ATTRIBUTE, EXACT_KIND, ARGS_ATTRIBUTE]
    back = F.when(F.lit(False), "")
    for k, v in KINDS.items():
        back = back.when(a[KIND_ATTRIBUTE] == v, k)
    status = F.when(F.upper("status_code").isin("OK", "ERROR", "UNSET"), F.lower("status_code")).otherwise("error")
    return rows.select(
        "trace_id", "span_id", "parent_id", F.coalesce(a[EXACT_KIND], back.otherwise("other")).alias("kind"), "name", ids.from_iso(F.col("start_time")).alias("started_at"), ids.from_iso(F.col("end_time")).alias("ended_at"), status.alias("status"),
        a[ATTRIBUTES["input"]].alias("input"), a[ATTRIBUTES["output"]].alias("output"), a[ATTRIBUTES["tool_name"]].alias("tool_name"), F.from_json(a[ARGS_ATTRIBUTE], "map<string,string>").alias("tool_args"),
        a[ATTRIBUTES["tokens"]].cast("bigint").alias("tokens"), a[ATTRIBUTES["cost_usd"]].cast("double").alias("cost_usd"), F.map_filter(a, lambda k, v: ~k.isin(known)).alias("attributes"),
    )
