"""Periodic runs of words: stretches in which a text repeats itself several times in a row.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends. Runs are found by a
suffix automaton over the words: its states are taken from long to short and their ordered sets of end positions are
merged along suffix links, the smaller into the larger. Two ends that become neighbours in the set of a state at a
distance of no more than the state's length close a square, and a square seeds a run: it is extended to both sides while
words at that distance agree. The two last ends of a run that lie a period apart become neighbours where their suffix
links meet, so no run is missed. Set elements move some log n times each; seeds inside a stretch already found at their
distance are skipped.

Before that, words that can't lie in a run are left out: each word of a run lies in a run of ``gram`` words that recurs
within the run, so a sort of window hashes leaves the stretches where automata are needed. This loses nothing, as equal
windows have equal hashes; automata compare words themselves.

Null texts count as empty and have no runs. Texts of any length are searched whole, and each is one task's work. Null ids
and repeated rows stay as they are. Extra columns are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release_memory

#: A run spans so many periods, and so many words, at least.
MIN_PERIODS, MIN_WORDS = 4, 6
#: Bytes of text worked on at a time within a batch (one text may be longer), so that memory stays bounded.
SLICE_BYTES = 1 << 20
#: Entries of a block of an ordered set; a block of twice as many is split.
BLOCK = 1024
RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"


class _Ends:
    """An ordered set of end positions, in blocks, so that an insertion moves few of them."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, end: int):
        self.blocks, self.firsts, self.size = [[end]], [end], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Insert ``x``, which is not in the set; its neighbours come back."""
        k = max(0, bisect_right(self.firsts, x) - 1) if len(self.firsts) > 1 else 0
        block = self.blocks[k]
        at = bisect_left(block, x)
        before = block[at - 1] if at else self.blocks[k - 1][-1] if k else None
        after = block[at] if at < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else None
        block.insert(at, x)
        self.size += 1
        if not at:
            self.firsts[k] = x
        if len(block) > 2 * BLOCK:
            self.blocks[k : k + 1] = [block[:BLOCK], block[BLOCK:]]
            self.firsts.insert(k + 1, block[BLOCK])
        return before, after


def _automaton(words: list) -> tuple[list[int], list[int], list[int]]:
    """(length, suffix link, own end) of each state; clones have no end of their own: -1."""
    lengths, links, ends, steps = [0], [-1], [-1], [{}]
    last = 0
    for i, w in enumerate(words):
        new = len(lengths)
        lengths.append(i + 1)
        links.append(0)
        ends.append(i)
        steps.append({})
        p = last
        while p >= 0 and w not in steps[p]:
            steps[p][w] = new
            p = links[p]
        if p >= 0:
            q, wanted = steps[p][w], lengths[p] + 1
            if lengths[q] != wanted:
                twin = len(lengths)
                lengths.append(wanted)
                links.append(links[q])
                ends.append(-1)
                steps.append(dict(steps[q]))
                while p >= 0 and steps[p].get(w) == q:
                    steps[p][w] = twin
                    p = links[p]
                links[q] = twin
                q = twin
            links[new] = q
        last = new
    return lengths, links, ends


def square_seeds(words: list) -> Iterator[tuple[int, int]]:
    """(end, distance): a square whose halves end at ``end`` and ``end + distance``."""
    lengths, links, ends = _automaton(words)
    sets: list[_Ends | None] = [_Ends(e) if e >= 0 else None for e in ends]
    for state in sorted(range(1, len(lengths)), key=lengths.__getitem__, reverse=True):
        up = links[state]
        if not up:
            sets[state] = None  # the root's words are empty: no distance is as short
            continue
        small, large, reach = sets[state], sets[up], lengths[up]
        sets[state] = None
        if large is None:
            sets[up] = small
            continue
        if small.size > large.size:
            small, large = large, small
        for x in small:
            before, after = large.add(x)
            if before is not None and x - before <= reach:
                yield before, x - before
            if after is not None and after - x <= reach:
                yield x, after - x
        sets[up] = large


def _agree(words: np.ndarray, d: int, at: int, step: int) -> int:
    """How many places from ``at`` on, forwards or backwards, hold the word that stands ``d`` behind."""
    n, done, width = len(words) - d if step > 0 else -1, 0, 16
    while (left := abs(n - at) - done) > 0:
        width = min(2 * width, left, 1 << 16)
        lo = at + done if step > 0 else at - done - width + 1
        differ = (words[lo : lo + width] != words[lo + d : lo + d + width])[::step]
        if (k := int(differ.argmax())) or differ[0]:
            return done + k
        done += width
    return done


def _primitive(words: np.ndarray, start: int, d: int) -> bool:
    """Whether ``d`` words from ``start`` on, which are repeated behind, are no repetition of fewer."""
    rest, f = d, 2
    while rest > 1:
        if rest % f == 0:
            if np.array_equal(words[start : start + d], words[start + d // f : start + d // f + d]):
                return False
            while rest % f == 0:
                rest //= f
        f = f + 1 if f * f <= rest else max(f + 1, rest)
    return True


def find_runs(words: list, min_periods: int = MIN_PERIODS, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least that many periods (two or more) and words, in this order."""
    ids: dict = {}
    coded = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    found: list[tuple[int, int, int]] = []
    known: dict[int, list[tuple[int, int]]] = {}
    for end, d in square_seeds(coded.tolist()):
        stretches = known.setdefault(d, [])
        k = bisect_right(stretches, (end, len(words)))
        if k and end < stretches[k - 1][1]:
            continue
        lo, hi = end - _agree(coded, d, end, -1) + 1, end + _agree(coded, d, end, 1)
        insort(stretches, (lo, hi))
        if hi - lo + d >= max(min_words, min_periods * d) and _primitive(coded, lo, d):
            found.append((lo, hi - lo + d, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(hashes: np.ndarray, min_periods: int = MIN_PERIODS, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """(start, stop) of the stretches outside of which no run can lie, from one hash a word."""
    gram, n = min_words - min_words // min_periods, len(hashes)
    if n < min_words:
        return []
    mixed = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(mixed)].view(np.uint64)
    ordered = np.sort(mixed)
    if not (ordered[1:] == ordered[:-1]).any():
        return []
    order = np.argsort(mixed, kind="stable")
    twins = mixed[order[1:]] == mixed[order[:-1]]
    apart = np.where(twins, order[1:] - order[:-1], n)
    near = np.full(len(mixed), n)  # how far away the nearest equal window is
    near[order[1:]] = apart
    near[order[:-1]] = np.minimum(near[order[:-1]], apart)
    open_at = near < n
    while True:
        depth = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(open_at)
        depth[at] += 1
        np.add.at(depth, at + gram, -1)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(depth)[:-1] > 0, [0]])))
        starts, stops = edges[::2], edges[1::2]
        keep = stops - starts >= min_words
        starts, stops = starts[keep], stops[keep]
        # A window in a run recurs within a period, which is no more than this share of the stretch around it.
        room = np.zeros(n + 1, np.int64)
        room[starts], room[stops] = (stops - starts) // min_periods, 0
        marks = np.zeros(n + 1, np.int64)
        marks[starts] = starts + 1
        last = np.maximum.accumulate(marks)[: len(mixed)]
        inside = np.zeros(n + 1, np.int64)
        np.add.at(inside, starts, 1)
        np.add.at(inside, stops, -1)
        fits = open_at & (last > 0) & (np.cumsum(inside)[: len(mixed)] > 0) & (near <= room[np.maximum(last, 1) - 1])
        if (fits == open_at).all():
            return list(zip(starts.tolist(), stops.tolist(), strict=True))
        open_at = fits


def runs_of(words: list[bytes], min_periods: int = MIN_PERIODS, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's words, automata over the stretches that may hold some."""
    if len(words) < min_words:
        return []
    hashes = np.fromiter(map(hash, words), np.int64, len(words))
    return [(a + start, n, q) for a, b in stretches(hashes, min_periods, min_words) for start, n, q in find_runs(words[a:b], min_periods, min_words)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, each run cut to its first period."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, n, q in runs:
        depth[start + q] += 1
        depth[start + n] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()])


def detect_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_periods: int = MIN_PERIODS, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, n_words, runs, collapsed) for every row: its runs by start and period, and its words without repetitions.

    Words are what stands between ASCII white space. ``runs`` are word numbers from 0; ``collapsed`` drops a word where
    any run holds it behind its first period, and joins the others by one blank.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["__id", "n_words", "runs", "collapsed"]
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches):
        for batch in batches:
            ends = np.cumsum(np.array(pc.fill_null(pc.binary_length(batch.column("__text")), 0), np.int64))
            start = 0
            while start < len(ends):
                done = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
                part = batch.slice(start, stop - start)
                sizes, found, texts = [], [], []
                for text in part.column("__text").cast(pa.binary()).to_pylist():
                    words = (text or b"").split()
                    runs = runs_of(words, min_periods, min_words)
                    sizes.append(len(words))
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    texts.append(collapsed(words, runs))
                yield pa.RecordBatch.from_arrays([part.column("__id"), pa.array(sizes, pa.int64()), pa.array(found, run_type), pa.array(texts, pa.binary()).cast(pa.string())], names)
                start = stop
        release_memory()

    read = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text"))
    return read.mapInArrow(search, f"__id {kind}, n_words bigint, runs {RUN_TYPE}, collapsed string").withColumnRenamed("__id", id_col)


def greatest_run(runs: Column) -> Column:
    """Of an array of runs the one of most periods, compared exactly; of equals the first, then that of the least period."""
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda best, r: F.when(best.isNull() | more(best, r), r).otherwise(best))


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Figures and digests of what ``detect_runs`` found."""
    best = found.withColumn("__best", greatest_run(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return best.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("__best.start").alias("start"),
        F.col("__best.length").alias("length"),
        F.col("__best.period").alias("period"),
        F.floor(1000 * F.col("__best.length") / F.col("__best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
