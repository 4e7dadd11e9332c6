"""State of entities at a point of both time axes.

The fold over an entity's events in (valid_at, seq) order is taken apart into aggregates that need no order and
combine on the map side: the last writer of each payload key, the last op that isn't on an edge, the last op on each
edge target, a count and a maximum. Deletes keep the payload and the edges; a kind whose targets are all gone stays
as an empty set; edge payloads aren't folded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.log import DELETES, EDGES, KEY, UPSERTS, as_of, as_time


def _when() -> Column:
    return F.struct("valid_at", "seq")


def payload_entries(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, k, v): the last value written to each payload key."""
    written = events.filter(F.col("op").isin(UPSERTS)).select(*keys, "valid_at", "seq", F.explode("payload").alias("k", "v"))
    return written.groupBy(*keys, "k").agg(F.max_by("v", _when()).alias("v"))


def edge_targets(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, edge_kind, edge_target, live): the last word on each edge."""
    return events.filter(F.col("op").isin(EDGES)).groupBy(*keys, "edge_kind", "edge_target").agg(F.max_by(F.col("op") == "upsert_edge", _when()).alias("live"))


def summary(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, deleted, last_valid_at, version_count) in one pass."""
    entity_op = ~F.col("op").isin(EDGES)
    return events.groupBy(*keys).agg(
        F.coalesce(F.max_by(F.col("op").isin(DELETES), F.when(entity_op, _when())), F.lit(False)).alias("deleted"),
        F.max("valid_at").alias("last_valid_at"),
        F.sum(F.when(F.col("op") == "append_version", 1).otherwise(0)).alias("version_count"),
    )


def materialize(events: DataFrame, valid=None, ingested=None, include_deleted: bool = False, keys: list[str] | None = None, **equal: str | None) -> DataFrame:
    """One row for each entity: payload and edges as maps, deleted, last_valid_at, version_count.

    A row holds all of an entity's edges; for entities with edges beyond a row's size use ``edge_targets``, one row each.
    """
    keys = keys or KEY
    seen = as_of(events, valid, ingested, **equal)
    payload = payload_entries(seen, keys).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("payload"))
    kinds = edge_targets(seen, keys).groupBy(*keys, "edge_kind").agg(F.array_sort(F.collect_set(F.when(F.col("live"), F.col("edge_target")))).alias("targets"))
    edges = kinds.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("edge_kind", "targets")))).alias("edges"))
    states = summary(seen, keys).join(payload, keys, "left").join(edges, keys, "left")
    states = states.select(
        *keys, F.coalesce("payload", F.create_map().cast("map<string,string>")).alias("payload"), F.coalesce("edges", F.create_map().cast("map<string,array<string>>")).alias("edges"), "deleted", "last_valid_at", "version_count"
    )
    return states if include_deleted else states.filter(~F.col("deleted"))


def entity_state(events: DataFrame, app: str, entity_type: str, entity_id: str, valid=None, ingested=None) -> DataFrame:
    """State of one entity, a tombstone too; no row if it has no event."""
    return materialize(events, valid, ingested, include_deleted=True, app=app, entity_type=entity_type, entity_id=entity_id)


def list_entities(events: DataFrame, valid=None, ingested=None, **equal: str | None) -> DataFrame:
    return materialize(events, valid, ingested, **equal).orderBy(*KEY)


def find_entities(states: DataFrame, **expect: str) -> DataFrame:
    """Live entities whose payload holds all given values."""
    found = states.filter(~F.col("deleted"))
    for k, v in expect.items():
        found = found.filter(F.col("payload")[k] == v)
    return found


#: Points that one pass over the events serves.
POINT_BLOCK = 64


def _place(at: Column, times: list) -> Column:
    """How many of the sorted times lie before ``at``, by halves; all of them where it is null."""

    def halves(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(at <= F.lit(times[mid]), halves(lo, mid)).otherwise(halves(mid + 1, hi))

    return halves(0, len(times))


def partials_at(events: DataFrame, points: DataFrame, point: str = "point", slots: list[str] | None = None) -> DataFrame:
    """The winning writes that each point (its id, valid, ingested) sees: partials with the point as a key.

    The points' times cut both axes into a grid. An event's cell is found by halves on either axis, and the events of an
    entity in a cell are folded to what wins there; a point then takes the cells that it dominates, by an equality join
    with a list of cells and points. So an event isn't compared with points: the cost is the events, and for each entity
    its cells times the points that see them. Points go to the driver, and POINT_BLOCK of them share a pass.
    """
    spark, every = events.sparkSession, None
    kind = points.schema[point].dataType.simpleString()
    held = sorted(((r[0], r[1], r[2]) for r in points.select(F.col("valid").cast("timestamp"), F.col("ingested").cast("timestamp"), point).collect() if r[0] is not None and r[1] is not None), key=lambda r: r[:2])
    for at in range(0, max(1, len(held)), POINT_BLOCK):
        block = held[at : at + POINT_BLOCK]
        valids, knowns = sorted({v for v, _, _ in block}), sorted({k for _, k, _ in block})
        seen = [(i, j, p) for v, k, p in block for i in range(valids.index(v) + 1) for j in range(knowns.index(k) + 1)]  # POINT_BLOCK ** 3 rows at most
        cells = spark.createDataFrame(seen, f"i int, j int, {point} {kind}")
        placed = events.withColumn("i", _place(F.col("valid_at"), valids)).withColumn("j", _place(F.col("ingested_at"), knowns)).filter((F.col("i") < len(valids)) & (F.col("j") < len(knowns)))
        writes = _writes(placed, ["i", "j", *KEY])
        folded = _winners(writes if slots is None else writes.filter(F.col("slot").isin(slots)), ["i", "j", *KEY])
        mine = _winners(folded.join(F.broadcast(cells), ["i", "j"]).drop("i", "j"), [point, *KEY])
        every = mine if every is None else every.unionByName(mine)
    return every


def at_points(events: DataFrame, points: DataFrame, point: str = "point") -> DataFrame:
    """As-of join: for each point (its id, valid, ingested) the summary of each entity that it may see."""
    return states_of(partials_at(events, points, point, ["entity", "seen"]), True, [point, *KEY]).drop("payload", "edges")


def frames(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, seq, valid_at, op, changed, full): for each version the fields that it changed, and all fields so far.

    Every entry's payload counts. A field's last value is carried over the versions that don't name it, so an entity
    costs its versions times its fields.
    """
    keys = keys or KEY
    each = events.select(*keys, "seq", "valid_at", "op", "payload")
    names = each.select(*keys, F.explode(F.map_keys("payload")).alias("k")).distinct()
    line = Window.partitionBy(*keys, "k").orderBy("valid_at", "seq")
    value = F.when(F.map_contains_key("payload", F.col("k")), F.struct(F.col("payload")[F.col("k")].alias("v")))
    cells = each.join(names, keys, "left").withColumn("now", value).withColumn("before", F.last("now", True).over(line.rowsBetween(Window.unboundedPreceding, -1))).withColumn("last", F.last("now", True).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    changed = F.col("now").isNotNull() & ~F.coalesce(F.col("now").eqNullSafe(F.col("before")), F.lit(False))
    entry = lambda test, c: F.map_from_entries(F.array_sort(F.collect_list(F.when(test, F.struct("k", F.col(f"{c}.v")))))).cast("map<string,string>")
    return cells.groupBy(*keys, "seq", "valid_at", "op").agg(entry(changed, "now").alias("changed"), entry(F.col("last").isNotNull(), "last").alias("full"))


def states_at_points(events: DataFrame, points: DataFrame, point: str = "point") -> DataFrame:
    """As-of join to whole states: payload and edges of each entity for each point (its id, valid, ingested), tombstones too."""
    return states_of(partials_at(events, points, point), True, [point, *KEY])


def change_frames(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """For each version and payload key: the value, the value before, and whether it changed. Every entry's payload counts."""
    keys = keys or KEY
    entries = events.select(*keys, "seq", "valid_at", F.explode("payload").alias("k", "v"))
    before = F.lag("v").over(Window.partitionBy(*keys, "k").orderBy("valid_at", "seq"))
    return entries.withColumn("before", before).withColumn("changed", F.col("before").isNull() | (F.col("before") != F.col("v")))


# -- folds that go on -------------------------------------------------------------------------------------------------

PARTIAL_FIELDS = ["slot", "name", "target", "value", "valid_at", "seq", "n"]


def _winners(writes: DataFrame, keys: list[str]) -> DataFrame:
    at = F.struct("valid_at", "seq")
    last = writes.groupBy(*keys, "slot", "name", "target").agg(F.max_by(F.struct("value"), at).alias("v"), F.max(at).alias("at"), F.sum("n").alias("n"))
    return last.select(*keys, "slot", "name", "target", "v.value", "at.valid_at", "at.seq", "n")


def _writes(events: DataFrame, keys: list[str]) -> DataFrame:
    """What each event writes: payload keys, an edge, whether the entity is deleted, and that it was seen."""
    text = lambda c: c.cast("string")
    one = lambda slot, name=None, target=None, value=None, n=0: F.struct(F.lit(slot).alias("slot"), text(name if name is not None else F.lit(None)).alias("name"), text(target if target is not None else F.lit(None)).alias("target"), text(value if value is not None else F.lit(None)).alias("value"), (n if n is not None else F.lit(0)).cast("bigint").alias("n"))
    none, on_edge = F.array().cast("array<struct<slot:string,name:string,target:string,value:string,n:bigint>>"), F.col("op").isin(EDGES)
    written = F.transform(F.map_entries("payload"), lambda e: one("payload", e["key"], None, e["value"], F.lit(0)))
    parts = [
        F.when(F.col("op").isin(UPSERTS) & F.col("payload").isNotNull(), written).otherwise(none),
        F.when(on_edge, F.array(one("edge", F.col("edge_kind"), F.col("edge_target"), F.col("op") == "upsert_edge", F.lit(0)))).otherwise(F.array(one("entity", None, None, F.col("op").isin(DELETES), F.lit(0)))),
        F.array(one("seen", None, None, None, F.when(F.col("op") == "append_version", 1).otherwise(0))),
    ]
    return events.select(*keys, "valid_at", "seq", F.explode(F.concat(*parts)).alias("w")).select(*keys, "w.slot", "w.name", "w.target", "w.value", "valid_at", "seq", "w.n")


def partials(events: DataFrame, valid=None, ingested=None, keys: list[str] | None = None) -> DataFrame:
    """(keys, slot, name, target, value, valid_at, seq, n): the writes that have won so far, which later events can be folded onto.

    A row for each payload key, edge target and entity; order doesn't matter, so late events find their place.
    """
    keys = keys or KEY
    return _winners(_writes(as_of(events, valid, ingested), keys), keys)


def go_on(saved: DataFrame, events: DataFrame, saved_valid, saved_ingested, valid=None, ingested=None, keys: list[str] | None = None) -> DataFrame:
    """Partials at a later point, from those saved at an earlier one and only the events that these haven't seen.

    Both times of the new point are at or behind those of the saved one. The test of what is unseen reaches the scan.
    """
    keys = keys or KEY
    unseen = as_of(events, valid, ingested).filter((F.col("valid_at") > as_time(saved_valid)) | (F.col("ingested_at") > as_time(saved_ingested)))
    return _winners(saved.select(*keys, *PARTIAL_FIELDS).unionByName(_writes(unseen, keys)), keys)


def states_of(partial: DataFrame, include_deleted: bool = False, keys: list[str] | None = None) -> DataFrame:
    """The states that partials stand for, as ``materialize`` gives them."""
    keys = keys or KEY
    slot = lambda name: F.col("slot") == name
    held = partial.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(slot("payload"), F.struct("name", "value"))))).alias("payload"),
        F.collect_list(F.when(slot("edge"), F.struct("name", "target", (F.col("value") == "true").alias("live")))).alias("e"),
        F.coalesce(F.max(F.when(slot("entity"), F.col("value") == "true")), F.lit(False)).alias("deleted"),
        F.max("valid_at").alias("last_valid_at"),
        F.sum("n").alias("version_count"),
    )
    kinds = F.array_sort(F.array_distinct(F.transform("e", lambda x: x["name"])))
    targets = lambda kind: F.array_sort(F.transform(F.filter("e", lambda x: (x["name"] == kind) & x["live"]), lambda x: x["target"]))
    edges = F.map_from_entries(F.transform(kinds, lambda k: F.struct(k.alias("k"), targets(k).alias("t"))))
    states = held.select(*keys, F.col("payload").cast("map<string,string>").alias("payload"), edges.cast("map<string,array<string>>").alias("edges"), "deleted", "last_valid_at", "version_count")
    return states if include_deleted else states.filter(~F.col("deleted"))
