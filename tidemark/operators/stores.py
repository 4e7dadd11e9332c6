"""Kept tables: memory items, approvals, snapshots and cursors. All are append-only; what holds now is the last word on each id.

A place is a folder, a database of the session's catalog (``catalog:NAME``) or a JDBC address (``jdbc:...``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import tables
from tidemark.functions import ids
from tidemark.operators import fold, snapshots
from tidemark.operators.log import KEY, as_time

SCHEMAS = {
    "items": "memory_id string, type string, namespace string, subject string, claim string, confidence double, ttl_policy string, acl string, source string, ref string, created_at timestamp",
    "edges": "src_id string, dst_id string, relation string",
    "activity": "memory_id string, active boolean, at timestamp",
    "approvals": "approval_id string, kind string, ref string, payload string, status string, note string, at timestamp",
    "cursors": "app string, stream string, cursor string, updated_at timestamp",
    "snapshots": "snapshot_id string, root string, entities bigint, as_of_valid timestamp, as_of_ingest timestamp, created_at timestamp",
    "snapshot_states": "snapshot_id string, app string, entity_type string, entity_id string, deleted boolean, payload map<string,string>, edges map<string,array<string>>, version_hash string, leaf string",
    "snapshot_trees": "snapshot_id string, depth int, node string, hash string, n bigint",
    "snapshot_partials": "snapshot_id string, app string, entity_type string, entity_id string, slot string, name string, target string, value string, valid_at timestamp, seq bigint, n bigint",
    "versions": "name string, version int, at timestamp",
}
#: The version of SCHEMAS; a place that has an older one gains the columns it lacks when it is read.
VERSION = 2


class Place:
    """Where tables are kept. Reads give the declared columns; columns that older files lack are null."""

    def __init__(self, spark: SparkSession, at: str, **options: str):
        self.spark, self.at, self.options = spark, at.rstrip("/"), options

    def _has(self, name: str) -> bool:
        if self.at.startswith("catalog:"):
            return self.spark.catalog.tableExists(self._name(name))
        return tables.exists(self.spark, f"{self.at}/{name}")

    def _name(self, name: str) -> str:
        return f"{self.at.removeprefix('catalog:')}.{name}"

    def read(self, name: str) -> DataFrame:
        schema = SCHEMAS[name]
        if self.at.startswith("jdbc:"):
            return self.spark.read.format("jdbc").options(url=self.at, dbtable=name, **self.options).load()
        if not self._has(name):
            return self.spark.createDataFrame([], schema)
        if self.at.startswith("catalog:"):
            found = self.spark.table(self._name(name))
            declared = self.spark.createDataFrame([], schema).schema
            return found.select(*[F.col(f.name) if f.name in found.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in declared])
        return self.spark.read.schema(schema).parquet(f"{self.at}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        declared = self.spark.createDataFrame([], SCHEMAS[name]).schema
        out = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in declared])
        if self.at.startswith("jdbc:"):
            out.write.format("jdbc").options(url=self.at, dbtable=name, **self.options).mode("append").save()
        elif self.at.startswith("catalog:"):
            out.write.mode("append").saveAsTable(self._name(name))
        else:
            out.write.mode("append").parquet(f"{self.at}/{name}")

    def migrate(self, now) -> int:
        """Note that this version of the tables holds here; gives the version before, 0 for a new place."""
        before = self.read("versions").filter("name = 'tables'").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
        if before < VERSION:
            self.append("versions", self.spark.range(1).select(F.lit("tables").alias("name"), F.lit(VERSION).alias("version"), as_time(now).alias("at")))
        return before


class Memory:
    """Items and their edges; an item's active flag is the last that was set, true if none was."""

    def __init__(self, place: Place):
        self.place = place

    def add(self, items: DataFrame) -> None:
        """Add the items that aren't there, each once; adding again adds none."""
        known = self.place.read("items").select("memory_id")
        self.place.append("items", items.dropDuplicates(["memory_id"]).join(known, "memory_id", "left_anti"))

    def add_edges(self, edges: DataFrame) -> None:
        keys = ["src_id", "dst_id", "relation"]
        self.place.append("edges", edges.select(*keys).distinct().join(self.place.read("edges"), keys, "left_anti"))

    def set_active(self, items: DataFrame, at) -> None:
        """From (memory_id, active)."""
        self.place.append("activity", items.select("memory_id", "active", as_time(at).alias("at")))

    def items(self) -> DataFrame:
        last = self.place.read("activity").groupBy("memory_id").agg(F.max_by("active", "at").alias("active"))
        return self.place.read("items").join(last, "memory_id", "left").withColumn("active", F.coalesce("active", F.lit(True)))

    def get(self, memory_id: str) -> DataFrame:
        return self.items().filter(F.col("memory_id") == memory_id)

    def by_subject(self, namespace: str, subject: str) -> DataFrame:
        return self.items().filter((F.col("namespace") == namespace) & (F.col("subject") == subject))

    def edges_from(self, memory_id: str) -> DataFrame:
        return self.place.read("edges").filter(F.col("src_id") == memory_id)


class Approvals:
    """A queue of what waits for a person; an id is made of the kind and the reference, so asking twice is one entry."""

    def __init__(self, place: Place):
        self.place = place

    def enqueue(self, rows: DataFrame, at) -> None:
        """From (kind, ref, payload): new entries are pending; known ones stay as they are."""
        new = rows.withColumn("approval_id", ids.new_id("apr", kind=F.col("kind"), ref=F.col("ref"))).dropDuplicates(["approval_id"])
        new = new.join(self.place.read("approvals").select("approval_id"), "approval_id", "left_anti")
        self.place.append("approvals", new.withColumn("status", F.lit("pending")).withColumn("at", as_time(at)))

    def decide(self, decisions: DataFrame, at) -> None:
        """From (approval_id, status, note); ids that aren't there are passed over."""
        known = self.entries().drop("status", "note", "at")
        self.place.append("approvals", decisions.select("approval_id", "status", "note").join(known, "approval_id").withColumn("at", as_time(at)))

    def entries(self, status: str | None = None) -> DataFrame:
        rest = ["kind", "ref", "payload", "status", "note", "at"]
        now = self.place.read("approvals").groupBy("approval_id").agg(F.max_by(F.struct(*rest), F.struct("at", F.col("status") != "pending")).alias("e")).select("approval_id", "e.*")
        return now if status is None else now.filter(F.col("status") == status)


class Snapshots:
    """States of all entities at a point of both time axes, tombstones too, with their manifest."""

    def __init__(self, place: Place):
        self.place = place

    def save(self, states: DataFrame, app: str | None, valid, ingested, now) -> str:
        """The snapshot's id, which its content and its point give; saving it again adds nothing."""
        hashed = tables.stash(states.join(snapshots.versions(states).select(*KEY, "version_hash"), KEY), "snapshot")
        at = [as_time(valid), as_time(ingested)]
        row = snapshots.root(hashed).select("root", "entities", snapshots.snapshot_id(F.col("root"), F.lit(app), *at).alias("snapshot_id"), at[0].alias("as_of_valid"), at[1].alias("as_of_ingest"), as_time(now).alias("created_at"))
        made = row.first()["snapshot_id"]
        if self.manifest(made).isEmpty():
            # In the order of leaves, so that a reader's row groups of other leaves are passed over.
            placed = hashed.withColumn("snapshot_id", F.lit(made)).withColumn("leaf", snapshots.leaf())
            self.place.append("snapshot_states", placed.repartitionByRange("leaf", *KEY).sortWithinPartitions("leaf"))
            self.place.append("snapshot_trees", snapshots.tree(hashed).withColumn("snapshot_id", F.lit(made)))
            self.place.append("snapshots", row)  # last: a state without its manifest isn't listed
        return made

    def save_fold(self, events: DataFrame, app: str | None, valid, ingested, now) -> str:
        """Save the states of a point together with the partials that later folds go on from; gives the snapshot's id."""
        partial = tables.stash(fold.partials(events if app is None else events.filter(F.col("app") == app), valid, ingested), "partials")
        made = self.save(fold.states_of(partial, include_deleted=True), app, valid, ingested, now)
        kept = self.place.read("snapshot_partials").filter(F.col("snapshot_id") == made)
        if kept.isEmpty():
            self.place.append("snapshot_partials", partial.withColumn("snapshot_id", F.lit(made)))
        return made

    def fold_from(self, snapshot_id: str, events: DataFrame, valid, ingested, include_deleted: bool = False) -> DataFrame:
        """States at a point not before the snapshot's on either axis, reading only events that the snapshot hasn't seen.

        ``events`` are those of the snapshot's application, if it has one.
        """
        at = self.manifest(snapshot_id).select("as_of_valid", "as_of_ingest").first()
        saved = self.place.read("snapshot_partials").filter(F.col("snapshot_id") == snapshot_id)
        if at is None or saved.isEmpty():
            raise ValueError(f"{snapshot_id} is no snapshot that a fold can go on from")
        return fold.states_of(fold.go_on(saved, events, at["as_of_valid"], at["as_of_ingest"], valid, ingested), include_deleted)

    def manifest(self, snapshot_id: str) -> DataFrame:
        return self.place.read("snapshots").filter(F.col("snapshot_id") == snapshot_id)

    def load(self, snapshot_id: str) -> DataFrame:
        return self.place.read("snapshot_states").filter(F.col("snapshot_id") == snapshot_id).drop("snapshot_id", "leaf")

    def tree(self, snapshot_id: str) -> DataFrame:
        return self.place.read("snapshot_trees").filter(F.col("snapshot_id") == snapshot_id).drop("snapshot_id")

    def difference(self, before: str, after: str) -> DataFrame:
        """The changes between two saved snapshots, reading only the ranges of keys in which their trees differ."""
        trees = [tables.stash(self.tree(s), "tree") for s in (before, after)]
        if any(t.isEmpty() for t in trees):  # saved before there were trees, or without an entity
            return snapshots.difference(self.load(before), self.load(after))
        ranges = snapshots.changed_leaves(*trees)
        states = self.place.read("snapshot_states").filter(F.col("leaf").isin(ranges))
        return snapshots.difference(*[states.filter(F.col("snapshot_id") == s) for s in (before, after)])

    def list(self) -> DataFrame:
        return self.place.read("snapshots").orderBy(F.col("created_at").desc(), "snapshot_id")


class Cursors:
    """The last position of each source's stream."""

    def __init__(self, place: Place):
        self.place = place

    def set(self, app: str, stream: str, cursor: str | None, at) -> None:
        """A null cursor clears the position, so that the next sync reads everything again."""
        self.place.append("cursors", self.place.spark.range(1).select(F.lit(app).alias("app"), F.lit(stream).alias("stream"), F.lit(cursor).cast("string").alias("cursor"), as_time(at).alias("updated_at")))

    def get(self, app: str, stream: str) -> str | None:
        last = self.place.read("cursors").filter((F.col("app") == app) & (F.col("stream") == stream))
        return last.agg(F.max_by(F.struct("cursor"), "updated_at").alias("c")).select("c.cursor").first()["cursor"]


