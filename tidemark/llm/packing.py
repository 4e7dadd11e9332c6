"""Packing tokenised documents into as few sequences as bounds allow.

A document is its ids and an end id. Longer ones are cut into pieces of the sequence length; whole pieces are sequences
of their own, and the shorter ones are packed by best fit decreasing in partitions of about ``PART_ITEMS`` pieces,
which get like shares of every length. In each partition dual feasible functions of the piece lengths (the length itself, and the three families of Fekete and
Schepers) give a lower bound on its bins. A partition that reaches its bound is certified: no packing of these pieces
has fewer bins. It closes its bins but for the least filled one, whose room other partitions may fill. Partitions with a
gap give up all bins with room; what was given up is dealt out anew, so that pieces of different partitions meet, and
packed again, until one partition holds the rest. If the total is above the bound of all pieces together, the bins
with room of all partitions are exchanged in the same way, between larger partitions, and the better packing stays.

The driver sees counts of bins and the histogram of lengths, which has a row for each length up to the sequence length.
Each round's partitions are written down, so lost executors cost no more than their tasks.

Null texts count as empty, and an empty text is one piece, the end id. Repeated rows are packed each. Null ids stay null.
Texts of any length are encoded whole. Extra columns are not read, whatever their names. An empty table gives an empty
result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import carried, range_dealt, release_memory, stash

#: Pieces of a partition, on average.
PART_ITEMS = 1 << 14
#: How often pieces of partitions with gaps are exchanged before their bins are closed, and bins of all partitions.
EXCHANGES, GLOBAL_EXCHANGES = 4, 3
#: Bytes of text encoded at a time (one text may be longer), and pieces of text whose ids a worker remembers.
SLICE_BYTES, REMEMBERED = 1 << 20, 1 << 20
#: Pieces of text that one call of the library encodes.
CALL_PARTS = 1 << 12


#: A mark behind an ASCII letter at the end of a word, and an ASCII capital that may be one character with what follows.
_MARK, _JOINED = re.compile(rb"(?<=[A-Za-z])([.,;:!?])(?=[ \t-\r]|\Z)"), re.compile(rb"[A-Z][\xcc\xcd]")


def _plain(text: bytes) -> bytes:
    """A text with the same ids and fewer different pieces between blanks: ASCII letters in lower case, marks behind words apart.

    For tokenizers that lower-case, and that begin a token where a mark follows a letter. Texts that may name a special
    token, or in which a capital's mark is a character of its own, keep their case.
    """
    text = _MARK.sub(rb" \1", text)
    return text if b"<|" in text or _JOINED.search(text) else text.lower()


class Encoder:
    """Packed ids of texts, little-endian unsigned 32-bit; one to a worker and tokenizer file.

    ``by_blanks`` encodes what stands between ASCII white space by itself and remembers the ids of what was seen; what is
    new in a text goes to the library in one call. That is exact only for tokenizers that drop white space and
    let no token and no normalisation reach across it; see also ``_plain``.
    """

    def __init__(self, path: str, by_blanks: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_blanks = Tokenizer.from_file(path), by_blanks
        self.known: dict[bytes, bytes] = {}

    def packed(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, parts: list[bytes]) -> None:
        if len(self.known) + len(parts) > REMEMBERED:
            self.known.clear()
        texts = [p.decode() for p in parts]
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        cuts = np.searchsorted(np.array([a for a, _ in found.offsets], np.int64), starts).tolist()
        self.known.update((p, ids[a:b].tobytes()) for p, a, b in zip(parts, cuts[:-1], cuts[1:], strict=True))

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text."""
        if not self.by_blanks:
            yield from (self.packed(t.decode()) for t in texts)
            return
        for text in texts:
            parts = _plain(text).split()
            found = list(map(self.known.get, parts))
            if None in found:
                fresh = list({p for p, ids in zip(parts, found, strict=True) if ids is None})
                for k in range(0, len(fresh), CALL_PARTS):
                    self._learn(fresh[k : k + CALL_PARTS])
                try:
                    found = list(map(self.known.__getitem__, parts))
                except KeyError:  # what was known before has gone to make room
                    found = [self.packed(text.decode())]
            yield b"".join(found)


@cache
def encoder(path: str | Callable[[], str], by_blanks: bool) -> Encoder:
    """The encoder of a tokenizer file; a function is asked for its path here, where the file is opened."""
    return Encoder(path() if callable(path) else path, by_blanks)


def cut_documents(docs: DataFrame, path: str | Callable[[], str], capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", by_blanks: bool = False, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each piece of every document; ``with_ids`` adds its packed ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["__id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    end, width = int(end_id).to_bytes(4, "little"), 4 * capacity

    def cut(batches):
        for batch in batches:
            sizes = np.cumsum(np.array(pc.fill_null(pc.binary_length(batch.column("__text")), 0), np.int64))
            at = 0
            while at < len(sizes):
                done = int(sizes[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(sizes, done + SLICE_BYTES, side="right")))
                part = batch.slice(at, stop - at)
                owner, piece, held = [], [], []
                texts = [t or b"" for t in part.column("__text").cast(pa.binary()).to_pylist()]
                for k, ids in enumerate(encoder(path, by_blanks)(texts)):
                    ids += end
                    for p, start in enumerate(range(0, len(ids), width)):
                        owner.append(k)
                        piece.append(p)
                        held.append(ids[start : start + width])
                columns = [part.column("__id").take(pa.array(owner, pa.int32())), pa.array(piece, pa.int32()), pa.array([p * capacity for p in piece], pa.int64()), pa.array([len(x) // 4 for x in held], pa.int64()), pa.array(list(map(zlib.crc32, held)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(held, pa.binary())] * with_ids, names)
                at = stop
        release_memory()

    read = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text"))
    return read.mapInArrow(cut, f"__id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids).withColumnRenamed("__id", id_col)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: from large to small, each into the fullest bin that has room for it."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, opened = 0, 0  # bit r of rooms: some bin has r tokens left
    for k, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        if fitting := rooms >> size:
            room = size + (fitting & -fitting).bit_length() - 1
            to = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, to = capacity, opened
            opened += 1
        bins[k], offsets[k] = to, capacity - room
        if left := room - size:
            by_room[left].append(to)
            rooms |= 1 << left
    return bins, offsets


def lower_bound(counts: np.ndarray, capacity: int, finest: int = 100) -> int:
    """Bins that any packing needs, from the number of items of each size 0 to ``capacity``, by dual feasible functions in whole numbers."""
    size, up = np.arange(capacity + 1), lambda a, b: int(-(-int(a) // int(b)))
    tokens = counts * size
    best = up(tokens.sum(), capacity)
    n_from, t_from = np.cumsum(counts[::-1])[::-1], np.cumsum(tokens[::-1])[::-1]
    at_least = lambda sums, s: int(sums[s]) if s <= capacity else 0
    for t in range(1, capacity // 2 + 1):
        # Small items count nothing, those that leave no room for the others a whole bin.
        best = max(best, at_least(n_from, capacity - t + 1) + up(at_least(t_from, t) - at_least(t_from, capacity - t + 1), capacity))
        # Large items lose by the steps that fit beside them, small ones count one step.
        steps, large = capacity // t, capacity // 2 + 1
        weight = int((counts[large:] * (steps - (capacity - size[large:]) // t)).sum()) + at_least(n_from, t) - at_least(n_from, large)
        best = max(best, up(weight, steps))
    for k in range(1, finest + 1):
        exact = (k + 1) * size % capacity == 0
        best = max(best, up((counts * np.where(exact, k * size, (k + 1) * size // capacity * capacity)).sum(), k * capacity))
    return best


def _dealt(pool: DataFrame, parts: int) -> DataFrame:
    """``pool`` with ``__part``: by turns in the order of lengths, so that every partition has as many pieces of each length as any other, but for one."""
    ranges = range_dealt(pool, "__size", "__row")
    before = carried(ranges, before=F.lit(1).cast("long"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("pid").orderBy("__size", "__row"))
    return ranges.join(F.broadcast(before), "pid").withColumn("__part", F.pmod(place, F.lit(parts)))


def _round(pool: DataFrame, parts: int, capacity: int, exchange: bool) -> DataFrame:
    """The pool packed in so many partitions, with ``__open``: the rows that are given up to the next round."""
    columns = [c for c in pool.columns if not c.startswith("__")]
    added = T.StructType([T.StructField(n, T.LongType()) for n in ("__part", "__bin", "__room", "offset")] + [T.StructField("__open", T.BooleanType())])
    last = parts == 1

    def pack(table: pa.Table) -> pa.Table:
        sizes = table.column("__size").to_numpy()
        bins, offsets = best_fit_decreasing(sizes, capacity)
        room = capacity - np.bincount(bins, weights=sizes).astype(np.int64)
        certified = len(room) == lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        given = (room > 0) & (np.arange(len(room)) == room.argmax() if certified or not exchange else True) & (not last)
        out = table.drop_columns(["__size"])
        for name, values in (("__bin", bins), ("__room", room[bins]), ("offset", offsets), ("__open", given[bins])):
            out = out.append_column(name, pa.array(values))
        return out

    dealt = pool.select("__row", *columns, F.col("__size"), F.lit(0).cast("long").alias("__part")) if last else _dealt(pool, parts).select("__row", *columns, "__size", "__part")
    held = T.StructType([f for f in pool.schema.fields if f.name in (*columns, "__row")])
    order = ["__row", *columns, "__part", "__bin", "__room", "offset", "__open"]
    schema = T.StructType(sorted([*held.fields, *added.fields], key=lambda f: order.index(f.name)))
    return dealt.groupBy("__part").applyInArrow(pack, schema)


def _packed(pool: DataFrame, number: int, capacity: int, part_items: int) -> tuple[list[DataFrame], int, int]:
    """(closed bins of each round, how many there are, the next round's number) of a pool of pieces."""
    closed, total, first = [], 0, number
    while rows := pool.count():
        done = stash(_round(pool, -(-rows // part_items), capacity, number - first < EXCHANGES), "packed")
        bins = {r["__open"]: r["count"] for r in done.filter("offset = 0").groupBy("__open").count().collect()}
        total += bins.get(False, 0)
        mine = done.filter("not __open").withColumn("sequence_id", F.lit(number << 56) + F.col("__part") * (1 << 20) + F.col("__bin"))
        closed.append(mine.drop("__open", "__part", "__bin"))
        if not bins.get(True):
            return closed, total, number + 1
        pool = done.filter("__open").withColumn("__size", F.col("length")).drop("__open", "__part", "__bin", "__room", "offset")
        number += 1
    return closed, total, number


def pack_pieces(pieces: DataFrame, capacity: int, part_items: int = PART_ITEMS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; column ``length`` is 1 to ``capacity``, other columns are kept.

    Columns whose names begin with two underscores are this module's own, as are ``sequence_id`` and ``offset``. A
    partition has four times ``capacity`` pieces at least, so that bins given up are always fewer than those packed.
    """
    part_items = max(part_items, 4 * capacity)
    rows = stash(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    full = rows.filter(F.col("length") >= capacity).select(*pieces.columns, (-1 - F.col("__row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.filter(F.col("length") < capacity).groupBy("length").count().collect():  # a row for each length
        counts[r["length"]] = r["count"]
    bound = lower_bound(counts, capacity)
    pool = rows.filter(F.col("length") < capacity).withColumn("__size", F.col("length"))
    closed, total, number = _packed(pool, 0, capacity, part_items)
    for k in range(GLOBAL_EXCHANGES):
        if total <= bound:
            break
        loose = [c.filter("__room > 0") for c in closed]
        before = sum(c.filter("offset = 0").count() for c in loose)
        again = loose[0].select("__row", *pieces.columns)
        for c in loose[1:]:
            again = again.unionByName(c.select("__row", *pieces.columns))
        better, after, number = _packed(again.withColumn("__size", F.col("length")), number, capacity, part_items << 2 * k + 1)
        if after >= before:
            continue
        closed, total = [c.filter("__room = 0") for c in closed] + better, total - before + after
    out = full
    for c in closed:
        out = out.unionByName(c.select(*pieces.columns, "sequence_id", "offset"))
    return out


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) from packed pieces with their ``ids``: each sequence's ids end to end; a sequence is bounded, and so is its group."""
    placed = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(placed, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))
