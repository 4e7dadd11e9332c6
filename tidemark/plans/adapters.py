"""How the test tables stand for logs, runs, items and ratings; each adapter has its SQL twin in ``sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import ids

VALID, INGESTED = "2024-01-20 00:00:00", "2024-01-22 00:00:00"
POINTS = [("p1", "2024-01-05 00:00:00", "2024-01-06 00:00:00"), ("p2", "2024-01-12 00:00:00", "2024-01-30 00:00:00"), ("p3", VALID, INGESTED)]
NOW = "2024-12-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def app_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a log: users are entities, purchases versions, errors deletes; ingestion lags by the id."""
    op = F.when(F.col("event_type") == "purchase", "append_version").when(F.col("event_type") == "error", "delete_entity").otherwise("upsert_entity")
    payload = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("value"), F.col("value").cast("decimal(18,2)").cast("string"), F.lit("k"), F.get_json_object("props", "$.k"))
    valid = ids.to_millis(F.col("ts"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("evt_"), "event_id").alias("event_id"), F.lit("events").alias("app"), F.lit("user").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"), op.alias("op"), payload.alias("payload"),
        valid.alias("valid_at"), (valid + F.make_dt_interval(days=(F.col("event_id") % 7).cast("int"))).alias("ingested_at"), F.col("event_id").alias("seq"), F.lit(None).cast("string").alias("edge_kind"), F.lit(None).cast("string").alias("edge_target"),
    )


def edge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as edges from suppliers to parts; a returned line takes the edge away."""
    return table(spark, sf_dir, "lineitem").select(
        F.lit("shop").alias("app"), F.lit("supplier").alias("entity_type"), F.col("l_suppkey").cast("string").alias("entity_id"), F.when(F.col("l_returnflag") == "R", "delete_edge").otherwise("upsert_edge").alias("op"),
        F.create_map().cast("map<string,string>").alias("payload"), F.col("l_shipdate").alias("valid_at"), F.col("l_shipdate").alias("ingested_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.lit("part").alias("edge_kind"), F.col("l_partkey").cast("string").alias("edge_target"),
    )


def spans(spark: SparkSession, sf_dir: str, planted: bool = False) -> DataFrame:
    """``conversations`` as spans: assistants are tools, and some users say what is worth remembering.

    With ``planted`` every fourth conversation says one of a few short things instead of its texts: equal claims.
    """
    kind = (F.col("conv_id") + F.col("turn")) % 6
    lead = F.when(kind == 0, "I prefer ").when(kind == 2, "We always ").when(kind == 4, "Actually use ").otherwise("")
    said = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("short notes "), F.floor(F.col("conv_id") / 8).cast("string"))).otherwise(F.col("text")) if planted else F.col("text")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("trace_id"), F.col("turn").cast("int").alias("pos"), F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("kind"), F.concat(lead, said).alias("input"),
        F.when(F.col("role") == "assistant", F.concat(F.lit("app.step_"), F.col("turn") % 3)).alias("tool_name"), F.length("text").alias("chars"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as memory items, ten conversations a subject; every third states a release plan, odd ones deny."""
    number = F.col("conv_id") * 1000 + F.col("turn")
    plan = F.concat(F.lit("ship the release plan "), F.col("conv_id") % 7, F.lit(" by monday"))
    claim = F.concat(F.when(F.col("turn") % 2 == 1, "do not ").otherwise(""), F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, plan).otherwise(F.col("text")))
    subject = F.concat(F.lit("Subject "), F.floor(F.col("conv_id") / 10).cast("string"))
    return table(spark, sf_dir, "conversations").select(
        number.alias("n"), F.concat(F.lit("mem_"), F.lpad(number.cast("string"), 9, "0")).alias("memory_id"), F.when(F.col("role") == "user", "procedural").otherwise("semantic").alias("type"),
        F.when(F.col("role") == "user", "user").when(F.col("role") == "assistant", "team").otherwise("project").alias("namespace"), subject.alias("subject"), claim.alias("claim"), F.col("text").alias("text"),
        (0.5 + (number % 50) / 100).alias("confidence"), F.when(F.col("role") == "user", "personal").otherwise("team").alias("acl"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=(number % 365).cast("int"))).alias("created_at"), (number % 5 != 0).alias("active"),
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` items as prompts of all kinds, with a memory for each."""
    leads = ["Decline the optional sync", "Schedule an external call", "Book travel for Redwood", "Reschedule my 1:1", "Reply to the VIP alice", "Route this bug", "Announce Launch Falcon", "Invite the approver", "Draft weekly notes", "Update the project page", "Create a doc", "What was the scope", "Hello there"]
    memories = ["optional attendees should decline", "no calls before 10am", "fly united on the aisle", "afternoon is best", "alice prefers direct messages", "bugs go to engineering", "announcements say it is live at launch", "vp of product signs", "metrics come first", "overview is canonical", "customer docs are named", "scope is frozen", ""]
    k = (F.col("item_id") % len(leads)).cast("int")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), k + 1)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task_id"), pick(leads).alias("prompt"), pick(memories).alias("memory"))
