"""Sharding by a minimax contiguous partition, with DataFrame functions.

Documents of equal text form an atomic group; groups are ordered by the SHA-256 of their text (a fixed, well mixed
order that needs no second look at the texts). The smallest shard capacity for which a greedy walk over the group
sizes needs no more than the wanted shards is found by binary search, and the cuts are where that walk closes a shard.
The walk asks only "where is the last group end at or before this byte?", so it runs on the driver over a grid of at
most ``GRID`` cells that keep their first and last group end: with the ends known the walk over true ends proves a
capacity enough, and the walk that takes unknown places as ends proves one too small. Where both leave a gap, the grid
is laid again over the stretches that are still open; the result is exact at every size.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import carried, range_dealt, stash

GRID = 1 << 15


class _Ends:
    """Group ends as far as known: each cell has its first and last end."""

    def __init__(self, cells: list[tuple[int, int]]):
        self.first = [a for a, _ in cells]
        self.last = [b for _, b in cells]

    def known(self, x: int) -> int:
        """The last end at or before x that is known: never past the true one."""
        i = bisect.bisect_right(self.first, x) - 1
        if i < 0:
            return 0
        return self.last[i] if self.last[i] <= x else self.first[i]

    def hoped(self, x: int) -> int:
        """x itself where an end may lie between, else the true last end: never before the true one."""
        i = bisect.bisect_right(self.first, x) - 1
        if i < 0:
            return 0
        return self.last[i] if self.last[i] <= x else x


def _walk(step, capacity: int, shards: int, total: int) -> list[int]:
    cuts, at = [], 0
    for _ in range(shards):
        if at >= total:
            break
        at = max(at, step(at + capacity))
        cuts.append(at)
    return cuts


def _smallest(lo: int, hi: int, enough) -> int:
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if enough(mid) else (mid + 1, hi)
    return lo


def minimax_cuts(ends: DataFrame, total: int, largest: int, shards: int, grid: int = GRID) -> list[int]:
    """The ends (running sums) after which the shards of the smallest feasible capacity close; ``ends`` has column ``end``."""
    if not total:
        return []
    lo, hi = max(largest, -(-total // shards)), min(total, -(-total // shards) + largest)
    open_at, width = [(0, total)], 2 * total + 2
    kept: list[tuple[int, int]] = []
    while True:
        width = max(1, min(width // 2, -(-sum(b - a + 1 for a, b in open_at) // grid)))  # at least halved: it ends at single ends
        where = F.lit(False)
        for a, b in open_at:
            where = where | F.col("end").between(a, b)
        rows = ends.filter(where).groupBy(F.floor(F.col("end") / width).alias("cell")).agg(F.min("end").alias("a"), F.max("end").alias("b")).collect()  # about grid rows, or a few for each pair of shards
        inside = lambda x: any(a <= x <= b for a, b in open_at)
        kept = sorted({(r["a"], r["b"]) for r in rows} | {(x, x) for c in kept for x in c if not inside(x)})
        known = _Ends(kept)
        proven = _smallest(lo, hi, lambda c: _walk(known.known, c, shards, total)[-1] >= total)
        hoped = _smallest(lo, proven, lambda c: _walk(known.hoped, c, shards, total)[-1] >= total)
        if hoped == proven:
            return _walk(known.known, proven, shards, total)
        lo, hi = hoped, proven
        low, high = _walk(known.known, lo, shards, total), _walk(known.hoped, hi, shards, total)
        high += [total] * (len(low) - len(high))
        spans: list[tuple[int, int]] = []
        for a, b in sorted((max(0, a - width), min(total, b + width)) for a, b in zip(low, high, strict=False)):
            if spans and a <= spans[-1][1] + 1:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
            else:
                spans.append((a, b))
        open_at = spans


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", grid: int = GRID) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row; law ``bytes``: shard sizes are as near equal as whole groups allow.

    Size is the text's UTF-8 bytes (a null text: none) plus 1, and the CRC of a null text is that of an empty one.
    Null and empty texts are one group, as equal texts are. Ties and repeated rows get slots of their own, in an
    arbitrary order among equal rows. Null ids come first among equal texts. Texts of any length are hashed whole. Other
    columns are not read, whatever their names. An empty table gives an empty result. ``grown_shard`` is null under this law.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("crc"),
        F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("group"),
    )
    dealt = range_dealt(rows, "group", "id", "crc")
    parts = dealt.groupBy("pid").agg(F.min("group").alias("first_group"))
    ahead = Window.orderBy("pid")
    edges = parts.select("pid", F.lead("first_group").over(ahead).alias("next_group"))
    offsets = carried(dealt, bytes_before=F.col("size"), rows_before=F.lit(1).cast("long"))
    in_part = Window.partitionBy("pid").orderBy("group", "id")
    placed = (
        dealt.join(F.broadcast(offsets.join(edges, "pid")), "pid")
        .withColumn("place", F.col("rows_before") + F.row_number().over(in_part) - 1)
        .withColumn("end", F.col("bytes_before") + F.sum("size").over(in_part.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("after", F.coalesce(F.lead("group").over(in_part), "next_group"))
        .select("id", "size", "crc", "group", "place", "end", (F.col("after").isNull() | (F.col("after") != F.col("group"))).alias("closes"))
    )
    placed = stash(placed, "placed")
    ends = placed.filter("closes").select("end")
    # The largest group: sizes of equal groups add up in partial sums first, so a frequent text costs one row a task.
    facts = placed.groupBy("group").agg(F.sum("size").alias("size")).agg(F.sum("size").alias("total"), F.max("size").alias("largest")).first()
    cuts = minimax_cuts(ends, facts["total"] or 0, facts["largest"] or 0, shards, grid)
    start = F.col("end") - F.col("size")
    shard = sum((F.when(start >= cut, 1).otherwise(0) for cut in cuts[:-1]), F.lit(0))
    # Each shard's first place, in one row: where its rows begin.
    firsts = placed.select(*[F.min(F.when(start >= cut, F.col("place"))).alias(f"f{k}") for k, cut in enumerate(cuts[:-1])]).first() if len(cuts) > 1 else []
    first_place = F.lit(0).cast("long")
    for cut, place in zip(cuts[:-1], firsts, strict=True):
        first_place = F.when(start >= cut, F.lit(place)).otherwise(first_place)
    return placed.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        shard.cast("int").alias("shard"),
        (F.col("place") - first_place).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
