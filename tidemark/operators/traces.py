"""Runs and spans: which of two captures stays, references, pairing, tool sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import ids, text
from tidemark.operators import log
from tidemark.tables import exists, stash

RUN_SCHEMA = "trace_id string, group_id string, workflow_name string, agent string, started_at timestamp, ended_at timestamp, user_ref string, task_ref string, status string, n_spans bigint, ingested_at timestamp"
SPAN_SCHEMA = (
    "trace_id string, span_id string, parent_id string, kind string, name string, pos int, started_at timestamp, ended_at timestamp, status string, input string, output string, "
    "tool_name string, tool_args map<string,string>, tokens bigint, cost_usd double, redactions array<string>, attributes map<string,string>"
)
# Argument keys that name an entity, and parts of tool names that mean a write.
ARGUMENT_REFS = {
    "channel": ("slack", "channel"), "channel_id": ("slack", "channel"), "event_id": ("gcal", "event"), "calendar_id": ("gcal", "calendar"),
    "document_id": ("gdocs", "document"), "doc_id": ("gdocs", "document"), "file_id": ("drive", "file"),
}
WRITE_HINTS = ["post", "create", "update", "send", "delete", "insert", "move", "set", "add"]


def richest(captures: DataFrame, arrival: str = "ingested_at") -> DataFrame:
    """Of all captures of a run the one with most spans, the earlier if equal; partial aggregation, no window."""
    rest = [c for c in captures.columns if c != "trace_id"]
    best = F.max_by(F.struct(*rest), F.struct(F.col("n_spans").alias("n"), (-F.unix_micros(F.col(arrival).cast("timestamp"))).alias("early")))
    return captures.groupBy("trace_id").agg(best.alias("r")).select("trace_id", "r.*")


#: Longer inputs and outputs are kept as blobs, and the span names their hash.
OFFLOAD_CHARS = 16_384


def redacted_spans(spans: DataFrame) -> DataFrame:
    """Spans without secrets in input, output and arguments; ``redactions`` names the rules that applied."""
    said = ["input", "output"]
    hits = F.array_distinct(F.concat(*[F.coalesce(text.redaction_hits(F.col(c)), F.array().cast("array<string>")) for c in said], F.coalesce("__args.hits", F.array().cast("array<string>"))))
    marked = spans.withColumn("__args", text.redact_args(F.to_json("tool_args"))).withColumn("redactions", F.array_sort(hits))
    return marked.withColumns({c: text.redacted(F.col(c)) for c in said} | {"tool_args": F.col("__args.args")}).drop("__args")


def ingest(runs: DataFrame, spans: DataFrame, home: str, ingested_at, offload_chars: int = OFFLOAD_CHARS) -> int:
    """Append captured runs with their spans to the tables below ``home``, redacted, long texts as blobs; returns how many.

    A capture is told by its run and its spans, so the same one again adds nothing. A run keeps all its captures, and
    ``stored_runs`` and ``stored_spans`` give the richest. Two runs of one id in the same capture are an error: their
    spans can't be told apart.
    """
    if twice := runs.groupBy("trace_id").count().filter("count > 1").select("trace_id").first():
        raise ValueError(f"several runs of this capture have the id {twice['trace_id']}")
    spark, clean = runs.sparkSession, stash(redacted_spans(spans), "redacted")
    content = clean.groupBy("trace_id").agg(F.count("*").alias("n_spans"), F.sum(F.xxhash64("span_id", "input", "output").cast("decimal(38,0)")).cast("string").alias("content"))
    found = runs.drop("n_spans").join(content, "trace_id").withColumn("capture_id", ids.new_id("cap", trace_id=F.col("trace_id"), n_spans=F.col("n_spans"), content=F.col("content")))
    if exists(spark, f"{home}/runs"):
        found = found.join(spark.read.parquet(f"{home}/runs").select("capture_id"), "capture_id", "left_anti")
    new = stash(found.drop("content").withColumn("ingested_at", F.lit(ingested_at).cast("timestamp") if isinstance(ingested_at, str) else ingested_at), "captures")
    kept = clean.join(new.select("trace_id", "capture_id"), "trace_id")
    long = lambda c: F.length(c) > offload_chars
    bodies = kept.select(F.explode(F.array(*[F.when(long(c), F.col(c)) for c in ("input", "output")])).alias("body"))
    stored = spark.read.parquet(f"{home}/blobs") if exists(spark, f"{home}/blobs") else spark.createDataFrame([], "hash string, prefix2 string, body string, size int")
    log.put_blobs(bodies, "body", stored).write.mode("append").parquet(f"{home}/blobs")
    kept.withColumns({c: F.when(long(c), ids.blob_uri(ids.sha256_hex(F.col(c)))).otherwise(F.col(c)) for c in ("input", "output")}).write.mode("append").parquet(f"{home}/spans")
    new.write.mode("append").parquet(f"{home}/runs")  # last: spans without their run are never read
    return new.count()


def stored_runs(spark: SparkSession, home: str, agent: str | None = None) -> DataFrame:
    """The richest capture of each run, of one agent if it is named, the newest first."""
    found = richest(spark.read.parquet(f"{home}/runs"))
    return (found if agent is None else found.filter(F.col("agent") == agent)).orderBy(F.desc("ingested_at"), "trace_id")


def stored_spans(spark: SparkSession, home: str, trace_id: str | None = None) -> DataFrame:
    """The spans of each run's richest capture; thinner captures are passed over. A lost writer's repeats are one."""
    captures, spans = spark.read.parquet(f"{home}/runs"), spark.read.parquet(f"{home}/spans")
    if trace_id is not None:
        captures, spans = captures.filter(F.col("trace_id") == trace_id), spans.filter(F.col("trace_id") == trace_id)
    return spans.dropDuplicates(["trace_id", "capture_id", "span_id"]).join(richest(captures).select("trace_id", "capture_id"), ["trace_id", "capture_id"])


def with_span_ids(spans: DataFrame) -> DataFrame:
    """Span ids from content; spans of a run that collide are told apart by their position."""
    plain = ids.new_id("span", kind=F.col("kind"), name=F.col("name"), parent_id=F.col("parent_id"), tool_name=F.col("tool_name"), started_at=ids.to_iso(F.col("started_at")), input=F.col("input"))
    first = F.row_number().over(Window.partitionBy("trace_id", "__id").orderBy("pos")) == 1
    salted = F.concat(F.lit("span_"), ids.short_hash(F.concat_ws("#", "__id", "pos")))
    return spans.withColumn("__id", plain).withColumn("span_id", F.when(first, F.col("__id")).otherwise(salted)).drop("__id")


def is_write(tool_name: Column) -> Column:
    return F.lower(tool_name).rlike("|".join(WRITE_HINTS))


def app_refs(tool_name: Column, args: Column) -> Column:
    """Entities that a tool call touches: array of (app, entity_type, entity_id, role)."""
    role = F.when(is_write(tool_name), "write").otherwise("read")
    refs = [F.when(F.coalesce(args[k], F.lit("")) != "", F.struct(F.lit(app).alias("app"), F.lit(kind).alias("entity_type"), args[k].alias("entity_id"), role.alias("role"))) for k, (app, kind) in ARGUMENT_REFS.items()]
    return F.array_compact(F.array(*refs))


def span_refs(spans: DataFrame) -> DataFrame:
    return spans.filter("tool_name is not null").select("trace_id", "span_id", F.explode(app_refs(F.col("tool_name"), F.col("tool_args"))).alias("r")).select("trace_id", "span_id", "r.*")


def touching(spans: DataFrame, refs: DataFrame, app: str, entity_type: str, entity_id: str) -> DataFrame:
    """Spans that touch one entity; the filter reaches the references before the join."""
    wanted = refs.filter((F.col("app") == app) & (F.col("entity_type") == entity_type) & (F.col("entity_id") == entity_id))
    return spans.join(wanted.select("trace_id", "span_id", "role"), ["trace_id", "span_id"])


def paired(uses: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Each use with the first result of its key, if any."""
    rest = [c for c in results.columns if c != key]
    first = results.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])
    return uses.join(first, key, "left")


def duration_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def cost_usd(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def tool_sequences(spans: DataFrame) -> DataFrame:
    """(trace_id, tools): each run's tools in order."""
    calls = spans.filter("tool_name is not null").groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tool_name"))).alias("c"))
    return calls.select("trace_id", F.transform("c", lambda x: x["tool_name"]).alias("tools"))


def repeated_sequences(sequences: DataFrame, least: int = 2, length: int = 2) -> DataFrame:
    """(tools, occurrences, first_trace) of sequences that several runs share."""
    return sequences.filter(F.size("tools") >= length).groupBy("tools").agg(F.count("*").alias("occurrences"), F.min("trace_id").alias("first_trace")).filter(F.col("occurrences") >= least)


def procedures(spans: DataFrame, least: int = 2) -> DataFrame:
    """Repeated sequences with the argument keys of the first run, named by their most common verb (first seen if equal)."""
    found = repeated_sequences(tool_sequences(spans), least)
    verbs = F.transform(F.col("tools"), lambda t: F.element_at(F.split(F.element_at(F.split(t, r"\."), -1), "_"), 1))
    counted = F.transform(F.array_distinct(verbs), lambda v: F.struct((-F.size(F.filter(verbs, lambda x: x == v))).alias("n"), F.array_position(verbs, v).alias("at"), v.alias("verb")))
    args = spans.filter("tool_name is not null").groupBy(F.col("trace_id").alias("first_trace")).agg(F.array_sort(F.collect_list(F.struct("pos", "tool_name", F.array_sort(F.map_keys("tool_args")).alias("arg_keys")))).alias("steps"))
    named = found.withColumn("name", F.concat(F.element_at(F.array_sort(counted), 1)["verb"], F.lit("_workflow")))
    return named.join(args, "first_trace").select("name", "occurrences", F.transform("steps", lambda s: F.struct(s["tool_name"].alias("tool"), s["arg_keys"])).alias("steps"))
