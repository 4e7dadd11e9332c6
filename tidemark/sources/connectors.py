"""Connectors: exports of applications become events of one algebra.

Each takes (spark, path, ingested_at) and reads JSON with a stated schema; all go through the shared event constructors.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import tables
from tidemark.functions import ids
from tidemark.operators import log, segments
from tidemark.operators.stores import Cursors

SLACK = (
    "team struct<id:string,name:string>, users array<struct<id:string,name:string,real_name:string,tz:string,is_admin:boolean>>, "
    "channels array<struct<id:string,name:string,topic:string,is_private:boolean,created:string,members:array<string>>>, "
    "messages map<string,array<struct<ts:string,user:string,text:string,reactions:array<struct<name:string,users:array<string>>>>>>, "
    "edits array<struct<channel:string,ts:string,edited_ts:string,text:string>>"
)
_TIME = "struct<dateTime:string,date:string>"
CALENDAR_EVENT = f"struct<id:string,status:string,summary:string,updated:string,start:{_TIME},end:{_TIME},recurrence:array<string>,attendees:array<struct<email:string,responseStatus:string>>>"
CALENDAR = f"calendar struct<id:string>, sync_batches array<struct<sync_token:string,events:array<{CALENDAR_EVENT}>>>"
DOCUMENTS = "drive struct<id:string>, documents array<struct<id:string,name:string,mimeType:string,owners:array<string>,revisions:array<struct<revision_id:string,modified_time:string,exported_markdown:string>>>>"
MAIL = "historyId string, messages array<struct<id:string,threadId:string,internalDate:string,from:string,to:string,subject:string,snippet:string,labelIds:array<string>>>"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents of any layout, a file each; a path that ends in ``.jsonl`` has a document a line, and is read in ranges."""
    return spark.read.schema(schema).option("multiLine", not path.rstrip("/").endswith(".jsonl")).json(path)


def _payload(**values: Column) -> Column:
    """A map of text values; lists and structs as JSON."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _epoch(text: Column) -> Column:
    return ids.from_epoch(F.coalesce(text, F.lit("0")))


def slack(spark: SparkSession, path: str, ingested_at) -> DataFrame:
    """Users (valid from the earliest channel), channels, members, messages, reactions as status, edits as versions.

    Lists may be dealt over any number of documents; the earliest channel is that of all.
    """
    raw, now = _read(spark, path, SLACK), log.as_time(ingested_at)
    base = {"app": "slack", "ingested_at": now}
    channels = raw.select(F.explode("channels").alias("c"))
    anchor = channels.agg(_epoch(F.min(F.col("c.created").cast("decimal(20,6)")).cast("string")).alias("anchor"))
    users = raw.select(F.explode("users").alias("u")).crossJoin(F.broadcast(anchor))  # one row
    messages = raw.select(F.explode("messages").alias("channel", "list")).select("channel", F.explode("list").alias("m")).withColumn("mid", F.concat_ws(":", "channel", "m.ts"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("string")
    topic = F.coalesce(F.get_json_object("c.topic", "$.value"), F.col("c.topic"))
    said = lambda body: _payload(id=F.col("mid"), channel=F.col("channel"), ts=F.col("m.ts"), user=F.col("m.user"), text=body, reactions=F.coalesce(F.to_json("m.reactions"), F.lit("[]")))
    reactions = messages.select("channel", "mid", "m", F.explode("m.reactions").alias("r"))
    edited = raw.select(F.explode("edits").alias("e")).withColumn("mid", F.concat_ws(":", "e.channel", "e.ts"))
    edits = messages.join(edited, "mid")
    message = {"entity_type": "message", "entity_id": F.col("mid"), **base}
    return _union([
        log.upsert_entity(users, entity_type="user", entity_id=F.col("u.id"), valid_at=F.col("anchor"), payload=_payload(id=F.col("u.id"), name=F.col("u.name"), real_name=F.col("u.real_name"), tz=F.col("u.tz"), is_admin=flag(F.col("u.is_admin"))), provenance={"source": "slack.users.list"}, **base),
        log.upsert_entity(channels, entity_type="channel", entity_id=F.col("c.id"), valid_at=_epoch(F.col("c.created")), payload=_payload(id=F.col("c.id"), name=F.col("c.name"), topic=topic, is_private=flag(F.col("c.is_private"))), provenance={"source": "slack.conversations.list"}, **base),
        log.upsert_edge(channels.select("c", F.explode("c.members").alias("member")), entity_type="channel", entity_id=F.col("c.id"), valid_at=_epoch(F.col("c.created")), edge_kind="member", edge_target=F.col("member"), provenance={"source": "slack.conversations.members"}, **base),
        log.upsert_entity(messages, valid_at=_epoch(F.col("m.ts")), payload=said(F.coalesce("m.text", F.lit(""))), actor_ref=F.col("m.user"), parent_entity_ref=F.col("channel"), source_cursor=F.col("m.ts"), provenance={"source": "slack.conversations.history"}, **message),
        log.status_change(reactions, valid_at=_epoch(F.col("m.ts")), payload=_payload(reaction=F.col("r.name"), users=F.coalesce(F.to_json("r.users"), F.lit("[]"))), provenance={"source": "slack.reactions"}, **message),
        log.append_version(edits, valid_at=_epoch(F.col("e.edited_ts")), payload=said(F.col("e.text")), provenance={"source": "slack.message_changed"}, **message),
    ])


def calendar(spark: SparkSession, path: str, ingested_at, after_token: str | None = None) -> DataFrame:
    """Batches behind the last consumed token; an unknown token means all of them."""
    raw, now = _read(spark, path, CALENDAR), log.as_time(ingested_at)
    resume = F.coalesce(F.array_position(F.transform("sync_batches", lambda b: b["sync_token"]), F.lit(after_token).cast("string")), F.lit(0))
    rows = raw.select(F.coalesce("calendar.id", F.lit("primary")).alias("cal"), resume.alias("done"), F.posexplode("sync_batches").alias("pos", "b")).filter(F.col("pos") >= F.col("done")).select("cal", F.explode("b.events").alias("e"))
    return calendar_events(rows, now)


def calendar_events(rows: DataFrame, now: Column) -> DataFrame:
    """Events from rows (calendar, event): cancelled ones are deletes, guests are edges."""
    at = lambda c: F.coalesce(F.col(f"e.{c}.dateTime"), F.col(f"e.{c}.date"))
    valid = F.coalesce(ids.from_iso(F.col("e.updated")), ids.from_iso(at("start")), now)
    rows = rows.withColumn("valid", valid)
    gone = F.coalesce(F.col("e.status") == "cancelled", F.lit(False))
    base = {"app": "gcal", "entity_type": "event", "entity_id": F.col("e.id"), "valid_at": F.col("valid"), "ingested_at": now}
    guests = rows.filter(~gone).select("e", "valid", F.explode("e.attendees").alias("a")).filter(F.coalesce("a.email", F.lit("")) != "")
    payload = _payload(id=F.col("e.id"), calendar_id=F.col("cal"), summary=F.col("e.summary"), status=F.col("e.status"), start=at("start"), end=at("end"), recurrence=F.coalesce(F.to_json("e.recurrence"), F.lit("[]")), attendees=F.coalesce(F.to_json("e.attendees"), F.lit("[]")))
    return _union([
        log.delete_entity(rows.filter(gone), provenance={"source": "calendar.events.list", "status": "cancelled"}, **base),
        log.upsert_entity(rows.filter(~gone), payload=payload, parent_entity_ref=F.col("cal"), source_cursor=F.col("e.updated"), provenance={"source": "calendar.events.list"}, **base),
        log.upsert_edge(guests, payload=_payload(responseStatus=F.col("a.responseStatus")), edge_kind="attendee", edge_target=F.col("a.email"), provenance={"source": "calendar.events.attendees"}, **base),
    ])


def last_token(spark: SparkSession, path: str) -> str | None:
    row = _read(spark, path, CALENDAR).select(F.element_at("sync_batches", -1)["sync_token"].alias("t")).first()
    return row["t"] if row else None


def documents(spark: SparkSession, path: str, ingested_at) -> DataFrame:
    """A document from its first revision on, and each revision as a version with its markdown and content hash."""
    raw, now = _read(spark, path, DOCUMENTS), log.as_time(ingested_at)
    docs = raw.select(F.explode("documents").alias("d"))
    revisions = docs.select("d", F.explode("d.revisions").alias("r"))
    owners = F.coalesce(F.to_json("d.owners"), F.lit("[]"))
    body = F.coalesce("r.exported_markdown", F.lit(""))
    base = {"app": "gdocs", "entity_type": "document", "entity_id": F.col("d.id"), "ingested_at": now}
    first = F.coalesce(ids.from_iso(F.get("d.revisions", F.lit(0))["modified_time"]), now)
    return _union([
        log.upsert_entity(docs, valid_at=first, payload=_payload(id=F.col("d.id"), name=F.col("d.name"), mime_type=F.col("d.mimeType"), owners=owners), provenance={"source": "drive.files.get"}, **base),
        log.append_version(revisions, valid_at=F.coalesce(ids.from_iso(F.col("r.modified_time")), now), payload=_payload(id=F.col("d.id"), name=F.col("d.name"), revision_id=F.col("r.revision_id"), mime_type=F.col("d.mimeType"), owners=owners, markdown=body, content_hash=ids.content_hash(body)), source_cursor=F.col("r.revision_id"), provenance={"source": "self_owned_export"}, **base),
    ])


def markdown_of(body: Column) -> Column:
    """Markdown of structured paragraphs: array of (style, text); empty ones go, titles and headings get their marks."""
    mark = lambda s: F.when(s == "TITLE", "# ").when(s.startswith("HEADING_"), F.concat(F.repeat(F.lit("#"), F.coalesce(F.element_at(F.split(s, "_"), 2).try_cast("int"), F.lit(1))), F.lit(" "))).otherwise("")
    lines = F.transform(F.filter(body, lambda p: F.rtrim(p["text"], F.lit("\n")) != ""), lambda p: F.concat(mark(F.coalesce(p["style"], F.lit("NORMAL_TEXT"))), F.rtrim(p["text"], F.lit("\n"))))
    return F.concat(F.array_join(lines, "\n\n"), F.lit("\n"))


def mail(spark: SparkSession, path: str, ingested_at) -> DataFrame:
    raw, now = _read(spark, path, MAIL), log.as_time(ingested_at)
    rows = raw.select(F.explode("messages").alias("m")).withColumn("thread", F.coalesce("m.threadId", "m.id"))
    payload = _payload(id=F.col("m.id"), threadId=F.col("thread"), **{"from": F.col("m.from")}, to=F.col("m.to"), subject=F.col("m.subject"), snippet=F.col("m.snippet"), labelIds=F.coalesce(F.to_json("m.labelIds"), F.lit("[]")))
    return log.upsert_entity(rows, app="gmail", entity_type="message", entity_id=F.col("m.id"), valid_at=F.coalesce(F.timestamp_millis(F.col("m.internalDate").cast("bigint")), now), ingested_at=now, payload=payload, parent_entity_ref=F.col("thread"), provenance={"source": "gmail.users.messages.get"})


REGISTRY: dict[str, Callable[..., DataFrame]] = {"slack": slack, "gcal": calendar, "gdocs": documents, "gmail": mail}


def build(name: str) -> Callable[..., DataFrame]:
    if name not in REGISTRY:
        raise ValueError(f"unknown source {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def run_sync(spark: SparkSession, name: str, path: str, log_path: str, ingested_at, cursors: Cursors | None = None, force: bool = False, resume: bool = False, **options) -> dict[str, int]:
    """Read a source and append what is new: counts of what it gave and of what was added.

    With ``cursors`` a calendar goes on behind its last token and keeps the new one once its events are in the log; with
    ``resume`` the log itself keeps it, in the commit that adds the events. ``force`` reads everything again.
    """
    if name == "gcal" and not force and (cursors or resume):
        options["after_token"] = cursors.get(name, "events") if cursors else segments.cursor(spark, log_path, name, "events")
    events = tables.stash(build(name)(spark, path, ingested_at, **options), "synced")
    position = {f"{name}/events": last_token(spark, path)} if resume and name == "gcal" else None
    counts = {"emitted": events.count(), "new": segments.append(spark, events, log_path, cursors=position).added}
    if cursors and name == "gcal":
        cursors.set(name, "events", last_token(spark, path), ingested_at)
    return counts
