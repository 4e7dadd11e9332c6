"""The event log: what is new in a batch, as-of reads, history, feeds, statistics, cursors and blobs.

An event is (event_id, app, entity_type, entity_id, op, payload map, valid_at, ingested_at, seq) with optional
actor_ref, parent_entity_ref, source_cursor, provenance map, edge_kind and edge_target. The log is append-only.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ids

KEY = ["app", "entity_type", "entity_id"]
UPSERTS = ["upsert_entity", "append_version", "permission_change", "comment_add", "reaction_add", "status_change"]
DELETES = ["delete_entity"]
EDGES = ["upsert_edge", "delete_edge"]
EVENT_SCHEMA = (
    "event_id string, app string, entity_type string, entity_id string, op string, payload map<string,string>, valid_at timestamp, ingested_at timestamp, "
    "seq bigint, actor_ref string, parent_entity_ref string, source_cursor string, provenance map<string,string>, edge_target string, edge_kind string"
)


def event_id() -> Column:
    """The id that an event's content gives it; the time of ingestion is no part, so a repeated sync adds nothing."""
    return ids.new_id(
        "evt", app=F.col("app"), entity_type=F.col("entity_type"), entity_id=F.col("entity_id"), op=F.col("op"), valid_at=ids.to_iso(F.col("valid_at")),
        payload_hash=ids.sha256_hex(ids.canonical_map(F.col("payload"))), edge_target=F.col("edge_target"), edge_kind=F.col("edge_kind"),
    )


def to_events(df: DataFrame, op: str, *, app: str, entity_type: str, entity_id: Column, valid_at: Column, ingested_at: Column, payload: Column | None = None, actor_ref: Column | None = None, parent_entity_ref: Column | None = None, source_cursor: Column | None = None, provenance: dict[str, str] | None = None, edge_target: Column | None = None, edge_kind: str | None = None) -> DataFrame:
    """One event for each row; all connectors go through here."""
    none = F.lit(None).cast("string")
    maps = "map<string,string>"
    source = F.create_map(*[F.lit(x) for kv in (provenance or {}).items() for x in kv]).cast(maps) if provenance else F.lit(None).cast(maps)
    shaped = df.select(
        F.lit(app).alias("app"), F.lit(entity_type).alias("entity_type"), entity_id.cast("string").alias("entity_id"), F.lit(op).alias("op"),
        (payload if payload is not None else F.create_map()).cast(maps).alias("payload"), ids.to_millis(valid_at).alias("valid_at"), ids.to_millis(ingested_at).alias("ingested_at"),
        (actor_ref if actor_ref is not None else none).alias("actor_ref"), (parent_entity_ref if parent_entity_ref is not None else none).alias("parent_entity_ref"),
        (source_cursor if source_cursor is not None else none).alias("source_cursor"), source.alias("provenance"),
        (edge_target if edge_target is not None else none).cast("string").alias("edge_target"), F.lit(edge_kind).cast("string").alias("edge_kind"),
    )
    return shaped.withColumn("event_id", event_id())


def upsert_entity(df: DataFrame, **fields) -> DataFrame:
    return to_events(df, "upsert_entity", **fields)


def delete_entity(df: DataFrame, **fields) -> DataFrame:
    return to_events(df, "delete_entity", **fields)


def append_version(df: DataFrame, **fields) -> DataFrame:
    return to_events(df, "append_version", **fields)


def upsert_edge(df: DataFrame, **fields) -> DataFrame:
    return to_events(df, "upsert_edge", **fields)


def delete_edge(df: DataFrame, **fields) -> DataFrame:
    return to_events(df, "delete_edge", **fields)


def status_change(df: DataFrame, **fields) -> DataFrame:
    return to_events(df, "status_change", **fields)


def first_arrivals(events: DataFrame, order: list[str]) -> DataFrame:
    """One row for each event id, the first in ``order``; partial aggregation, no window."""
    rest = [c for c in events.columns if c != "event_id"]
    return events.groupBy("event_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("e")).select("event_id", "e.*")


def new_events(batch: DataFrame, log: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Events of ``batch`` that the log lacks, each once: the idempotent part of an append."""
    return first_arrivals(batch, order or ["ingested_at", *KEY]).join(log.select("event_id"), "event_id", "left_anti")


def as_time(at: datetime | str | Column) -> Column:
    return at if isinstance(at, Column) else F.lit(at).cast("timestamp")


def as_of(events: DataFrame, valid=None, ingested=None, **equal: str | None) -> DataFrame:
    """Events up to both times, bounds included, and with the given app, entity type or id."""
    for column, bound in (("valid_at", valid), ("ingested_at", ingested)):
        if bound is not None:
            events = events.filter(F.col(column) <= as_time(bound))
    for column, value in equal.items():
        if value is not None:
            events = events.filter(F.col(column) == value)
    return events


def history(events: DataFrame, app: str, entity_type: str, entity_id: str, ingested=None) -> DataFrame:
    """All versions of one entity, in order."""
    return as_of(events, ingested=ingested, app=app, entity_type=entity_type, entity_id=entity_id).orderBy("valid_at", "seq")


def timeline(events: DataFrame, start=None, end=None, app: str | None = None, ingested=None) -> DataFrame:
    """Events of a span of valid time, bounds included."""
    found = as_of(events, valid=end, ingested=ingested, app=app)
    return found if start is None else found.filter(F.col("valid_at") >= as_time(start))


def feed(events: DataFrame) -> DataFrame:
    """Activity lines: when, what, on what, by whom."""
    return events.select("seq", ids.to_iso(F.col("valid_at")).alias("at"), "op", F.concat_ws("/", *KEY).alias("entity"), F.coalesce("actor_ref", F.lit("")).alias("actor") if "actor_ref" in events.columns else F.lit("").alias("actor"))


def statistics(events: DataFrame) -> DataFrame:
    """Counts by app, by op and over all with the bounds of both time axes, in one pass of grouping sets."""
    return events.groupingSets([["app"], ["op"], []], "app", "op").agg(
        F.count("*").alias("n"), F.min("valid_at").alias("first_valid"), F.max("valid_at").alias("last_valid"), F.min("ingested_at").alias("first_ingested"), F.max("ingested_at").alias("last_ingested")
    )


def payload_of(events: DataFrame, event_id: str) -> dict[str, str]:
    """The payload of one event; empty if the log hasn't it."""
    row = events.filter(F.col("event_id") == event_id).select("payload").first()
    return dict(row["payload"] or {}) if row else {}


def has_event(events: DataFrame, event_id: str) -> bool:
    return not events.filter(F.col("event_id") == event_id).isEmpty()


def latest_cursor(cursors: DataFrame) -> DataFrame:
    """Of an append-only log (app, stream, cursor, updated_at): the current cursor of each stream."""
    return cursors.groupBy("app", "stream").agg(F.max_by("cursor", "updated_at").alias("cursor"))


# -- blobs ------------------------------------------------------------------------------------------------------------


def blobs(texts: DataFrame, body: str) -> DataFrame:
    """(hash, prefix2, body, size): each distinct body once, addressed by its SHA-256."""
    hashed = texts.select(ids.sha256_hex(F.col(body)).alias("hash"), F.col(body).alias("body")).filter("body is not null")
    return hashed.groupBy("hash").agg(F.first("body").alias("body")).select("hash", F.substring("hash", 1, 2).alias("prefix2"), "body", F.octet_length("body").alias("size"))


def put_blobs(texts: DataFrame, body: str, stored: DataFrame) -> DataFrame:
    """Blobs that the store lacks."""
    return blobs(texts, body).join(stored.select("hash"), "hash", "left_anti")


def get_blobs(refs: DataFrame, ref: str, stored: DataFrame, verify: bool = True) -> DataFrame:
    """Bodies for digests or URIs; a missing or corrupt one is an error when it is read."""
    found = refs.withColumn("hash", ids.parse_blob_uri(F.col(ref))).join(stored.select("hash", "body"), "hash", "left")
    if verify:
        sound = F.col("body").isNotNull() & (ids.sha256_hex(F.col("body")) == F.col("hash"))
        found = found.withColumn("body", F.when(sound, F.col("body")).otherwise(F.raise_error(F.concat(F.lit("blob missing or corrupt: "), F.coalesce("hash", F.lit("not a reference"))))))
    return found


def corrupt_blobs(stored: DataFrame) -> DataFrame:
    return stored.filter(ids.sha256_hex(F.col("body")) != F.col("hash")).select("hash")


def ordered(events: DataFrame) -> Window:
    return Window.partitionBy(*KEY).orderBy("valid_at", "seq")
