"""Benchmark decontamination with an FM-index for each training shard.

Test phrases are windows of consecutive words of the benchmark's items (a shorter item is one phrase). A shard is a
run of documents with at most ``SHARD_WORDS`` words (one document may hold more). Words outside the benchmark's
vocabulary cannot lie in an occurrence, nor can a stretch of fewer words than the shortest phrase, so only the other
stretches are indexed; this loses nothing. All phrases are searched backwards at once through wavelet-tree ranks,
occurrences are located by sampled suffix positions, and overlapping ones merge to removal spans.

The benchmark goes to the executors in blocks of items of a bounded size. A shard is searched for one block after the
other, and a worker holds one block at a time, so a large benchmark costs time and no memory. Documents stay in place:
there is one pass over them, and nothing is shuffled.

Item ids are told as strings, of whatever type they are. Items that repeat an id are one item; items without an id are
searched like others and their words are hit, but no list names them. Null texts, of documents and of items, have no
words. Long texts are searched whole: one that exceeds a shard is a shard. Rows stay as they are, repeated ones too. An
empty benchmark hits nothing; an empty table gives an empty result. Other columns are not read but for those asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release_memory
from tidemark.llm.fm_index import FMIndex

WINDOW = 10
#: Words of a shard, and UTF-8 bytes of benchmark text in one block; a single longer item is a block of its own.
SHARD_WORDS = 500_000
BLOCK_BYTES = 16 << 20
#: Occurrences located at a time.
LOCATED = 1 << 20
#: A-Z to lower case; what isn't a digit, a letter or beyond ASCII parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class Phrases:
    """The distinct windows of some items, as rows of word numbers, with the items that hold each."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], set[str | None]] = {}
        for item, words in items:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for k in range(max(1, len(numbers) - window + 1) if numbers else 0):
                seen.setdefault(tuple(numbers[k : k + window]), set()).add(item)
        self.items = [sorted(i for i in x if i is not None) for x in seen.values()]
        self.lengths = np.array([len(x) for x in seen], np.int64)
        self.rows = np.zeros((len(seen), window), np.int64)
        for k, x in enumerate(seen):
            self.rows[k, : len(x)] = x
        self.shortest = int(self.lengths.min(initial=window))


def _occurrences(phrases: Phrases, texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, first word, phrase) of every occurrence in a shard; texts are word numbers, 0 for foreign words."""
    lengths = np.array([len(t) for t in texts], np.int64)
    total = int(lengths.sum())
    if not total or not len(phrases.rows):
        return
    flat = np.concatenate(texts)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    # Stretches of known words; documents end them too.
    known = flat > 0
    opens = known.copy()
    opens[1:] &= ~known[:-1]
    edges = starts[1:-1][starts[1:-1] < total]
    opens[edges] = known[edges]
    first = np.flatnonzero(opens)
    stretch = np.cumsum(opens) - 1
    size = np.bincount(stretch[known], minlength=len(first)) if len(first) else np.zeros(0, np.int64)
    wanted = size >= phrases.shortest
    if not wanted.any():
        return
    first, size = first[wanted], size[wanted]
    # The indexed text: each wanted stretch and a 0; source has the place in flat.
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.zeros(begin[-1], np.int64)
    source = np.repeat(first - begin[:-1], size + 1) + np.arange(begin[-1])
    inside = np.ones(begin[-1], bool)
    inside[begin[1:] - 1] = False
    text[inside] = flat[source[inside]]
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    lo, hi = index.search(phrases.rows, phrases.lengths)
    hit = np.flatnonzero(hi > lo)
    counts = hi[hit] - lo[hit]
    ends = np.cumsum(counts)
    for a in range(0, int(ends[-1]) if len(ends) else 0, LOCATED):
        flat_at = np.arange(a, min(a + LOCATED, int(ends[-1])))
        which = np.searchsorted(ends, flat_at, side="right")
        rows = lo[hit[which]] + flat_at - (ends[which] - counts[which])
        at = source[index.locate(rows)]
        doc = np.searchsorted(starts, at, side="right") - 1
        yield doc, at - starts[doc], hit[which]


def _shard_hits(blocks: Iterator[Phrases], words: list[list[bytes]]) -> tuple[list[list[dict]], list[list[str]]]:
    """For each document its merged spans of words and the items found, over all blocks of the benchmark."""
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    change = np.zeros(int(starts[-1]) + 1, np.int64)
    items: list[set[str]] = [set() for _ in words]
    for phrases in blocks:
        get = phrases.vocabulary.get
        for doc, at, phrase in _occurrences(phrases, [np.array([get(w, 0) for w in ws], np.int32) for ws in words]):
            place = starts[doc] + at
            np.add.at(change, place, 1)
            np.add.at(change, place + phrases.lengths[phrase], -1)
            for d, p in np.unique(np.stack([doc, phrase], 1), axis=0):
                items[d].update(phrases.items[p])
    covered = np.cumsum(change[:-1]) > 0
    spans: list[list[dict]] = [[] for _ in words]
    padded = np.concatenate([[False], covered, [False]])
    begins, stops = np.flatnonzero(padded[1:] & ~padded[:-1]), np.flatnonzero(~padded[1:] & padded[:-1])
    for a, b in zip(begins, stops, strict=True):  # a run may go on over a document's end
        d = int(np.searchsorted(starts, a, side="right") - 1)
        while a < b:
            stop = min(b, starts[d + 1])
            if stop > a:
                spans[d].append({"start": int(a - starts[d]), "end": int(stop - starts[d])})
            a, d = stop, d + 1
    return spans, [sorted(x) for x in items]


HITS = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The benchmark's items a block at a time; the driver holds one block."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("t is not null").toLocalIterator():
        if block and size + len(row["t"]) * 4 > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["i"], words_of(row["t"])))
        size += len(row["t"]) * 4
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """(id, kept columns, n_words, spans of words that are hit, items) for every row of ``docs``."""
    spark = docs.sparkSession
    kept = keep or []
    read = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text"), *[docs[c].alias(f"__keep_{c}") for c in kept])
    carried = [f.name for f in read.schema.fields if f.name.startswith("__keep_")]
    kinds = {f.name: f.dataType.simpleString() for f in read.schema.fields}
    schema = f"__id {kinds['__id']}, __text string, " + "".join(f"`{c}` {kinds[c]}, " for c in carried) + HITS
    held = [spark.sparkContext.broadcast(Phrases(b, window)) for b in _blocks(benchmark, item_col, item_text_col, block_bytes)]

    def blocks() -> Iterator[Phrases]:
        for one in held:
            yield one.value
            if len(held) > 1:  # of several blocks a worker keeps none
                vars(one).pop("_value", None)

    def run(batches):
        for batch in batches:
            words, start, count = [], 0, 0
            column = batch.column("__text")
            for k in range(len(column)):
                found = words_of(column[k].as_py())
                if words and count + len(found) > shard_words:
                    yield pack(batch.slice(start, k - start), words)
                    words, start, count = [], k, 0
                words.append(found)
                count += len(found)
            if words:
                yield pack(batch.slice(start), words)
        release_memory()

    def pack(part, words):
        spans, items = _shard_hits(blocks(), words)
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [part.column("__id"), part.column("__text"), *[part.column(c) for c in carried], pa.array([len(w) for w in words], pa.int64()), pa.array(spans, span_type), pa.array(items, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["__id", "__text", *carried, "n_words", "spans", "items"])

    found = read.mapInArrow(run, schema)
    return found.select(F.col("__id").alias(id_col), F.col("__text").alias(text_col), *[F.col(c).alias(c.removeprefix("__keep_")) for c in carried], "n_words", "spans", "items")


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    names = F.array_join(F.array_sort("items"), ",")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(names, "UTF-8"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


#: One word of a text, for removal: the same as ``words_of`` finds.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` without the words of its spans and what stands between them; one blank is left for each span."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    gaps = F.split(text, WORD, -1)
    flagged = F.transform(words, lambda w, i: F.exists(spans, lambda s: (s["start"] <= i) & (i < s["end"])))
    tail = F.slice(gaps, F.lit(2), F.size(words))
    after = F.concat(F.slice(flagged, F.lit(2), F.size(words)), F.array(F.lit(False)))
    kept = F.zip_with(F.zip_with(words, tail, lambda w, g: F.struct(w.alias("w"), g.alias("g"))), F.zip_with(flagged, after, lambda f, a: F.struct(f.alias("f"), a.alias("a"))), lambda x, y: F.when(y["f"] & y["a"], "").when(y["f"], F.concat(F.lit(" "), x["g"])).otherwise(F.concat(x["w"], x["g"])))
    return F.when(F.size(spans) > 0, F.concat(F.element_at(gaps, 1), F.array_join(kept, ""))).otherwise(text)
