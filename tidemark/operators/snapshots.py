"""Snapshots: a hash for each entity version, one root over all, and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ids
from tidemark.operators.log import KEY


def versions(states: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, version_hash): SHA-256 of the canonical JSON of the key, payload, edges and deletion, tombstones too."""
    keys = keys or KEY
    edges = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("edges")))) if "edges" in states.columns else F.lit("{}")
    key = F.to_json(F.array(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    body = F.concat(F.lit('{"deleted":'), F.col("deleted").cast("string"), F.lit(',"edges":'), edges, F.lit(',"key":'), key, F.lit(',"payload":'), ids.canonical_map(F.col("payload")), F.lit("}"))
    return states.select(*keys, "deleted", ids.sha256_hex(body).alias("version_hash"))


def plain_root(hashes: DataFrame) -> DataFrame:
    """One row (root, entities): SHA-256 of the canonical JSON list of all hashes in order, for snapshots whose hashes fit one row."""
    listed = hashes.agg(F.array_sort(F.collect_list("version_hash")).alias("h"))
    return listed.select(F.sha2(F.encode(F.to_json("h"), "UTF-8"), 256).alias("root"), F.size("h").cast("bigint").alias("entities"))


def root(hashes: DataFrame) -> DataFrame:
    """One row (root, entities): a set hash that needs no order.

    Hashes are grouped by their first four digits, sorted and hashed within each group, and the root hashes the groups'
    hashes in order: at most 65,536 rows meet at the end, and ten billion entities make groups of some 150,000.
    """
    parts = hashes.groupBy(F.substring("version_hash", 1, 4).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("version_hash")), ""), 256).alias("h"), F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"])
    return parts.agg(F.sha2(F.array_join(ordered, ""), 256).alias("root"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("entities"))


#: Leaves of a snapshot's tree: ranges of hashed keys, and how many digits of the hash name one. A leaf's parent has one digit less.
LEAF_DIGITS = 4


def leaf(keys: list[str] | None = None) -> Column:
    """The range of keys that an entity lies in: the first digits of a hash of its key."""
    return F.substring(F.sha2(F.to_json(F.array(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys or KEY])), 256), 1, LEAF_DIGITS)


def tree(hashes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(depth, node, hash, n): a Merkle tree over ranges of keys, from (keys, version_hash).

    A leaf hashes its entities' version hashes in the order of keys; a node of less depth hashes its children's in the
    order of their names. There are at most 16 ** LEAF_DIGITS leaves, whatever the number of entities; the root has depth 0.
    """
    keys = keys or KEY
    own = F.transform(F.array_sort(F.collect_list(F.struct(*keys, "version_hash"))), lambda x: x["version_hash"])
    level = hashes.withColumn("node", leaf(keys)).groupBy("node").agg(F.sha2(F.array_join(own, ""), 256).alias("hash"), F.count("*").alias("n"))
    every = level = level.select(F.lit(LEAF_DIGITS).alias("depth"), "node", "hash", "n")
    for depth in range(LEAF_DIGITS - 1, -1, -1):
        below = F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"])
        level = level.groupBy(F.substring("node", 1, depth).alias("node")).agg(F.sha2(F.array_join(below, ""), 256).alias("hash"), F.sum("n").alias("n")).select(F.lit(depth).alias("depth"), "node", "hash", "n")
        every = every.unionByName(level)
    return every


def changed_leaves(before: DataFrame, after: DataFrame) -> list[str]:
    """The leaves in which two trees differ: from the root down, only nodes below a differing one are compared."""
    open_nodes = [""]
    for depth in range(LEAF_DIGITS + 1):
        side = lambda t, name: t.filter((F.col("depth") == depth) & F.substring("node", 1, max(0, depth - 1)).isin(open_nodes)).select("node", F.col("hash").alias(name))  # noqa: B023, E731
        both = side(before, "old").join(side(after, "new"), "node", "full_outer")
        open_nodes = [r["node"] for r in both.filter(~F.col("old").eqNullSafe(F.col("new"))).select("node").collect()]  # a row a range
        if not open_nodes:
            return []
    return sorted(open_nodes)


def snapshot_id(root_hash, app, valid, ingested):
    return ids.new_id("snap", app=app, valid=ids.to_iso(valid), ingested=ids.to_iso(ingested), root=root_hash)


def difference(before: DataFrame, after: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, change): created, updated or deleted between two sets of versions; tombstones count as absent."""
    keys = keys or KEY
    live = lambda v, name: v.filter(~F.col("deleted")).select(*keys, F.col("version_hash").alias(name))
    both = live(before, "old").join(live(after, "new"), keys, "full_outer")
    change = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "updated")
    return both.withColumn("change", change).filter("change is not null").select(*keys, "change", "old", "new")


def memory_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(memory_id, change) of two sets of items (memory_id, active): added, removed (gone or inactive) or reactivated."""
    both = before.select("memory_id", F.col("active").alias("was")).join(after.select("memory_id", F.col("active").alias("is")), "memory_id", "full_outer")
    change = F.when(F.col("was").isNull() & F.col("is"), "added").when(F.col("was") & ~F.coalesce("is", F.lit(False)), "removed").when(~F.col("was") & F.col("is"), "reactivated")
    return both.select("memory_id", change.alias("change")).filter("change is not null")
