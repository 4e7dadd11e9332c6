"""N-gram Jaccard join: MinHash banding, and exact verification on the full n-gram sets.

Words are runs of digits, letters and characters beyond ASCII, A-Z folded to lower case. A document's set holds the
hashes (64 bits) of its runs of five words; a document of fewer words has one run of them all, one without words has
none and joins nothing. Bands and rows are chosen so that a pair at the threshold meets in some band with the target
recall. Documents of equal word sequences are one text and are joined once, by partial aggregation.

Texts that share a band are a bucket. A pair belongs to the first band in which it meets, so it is verified once;
a bucket beyond ``BLOCK`` texts or ``BLOCK_BYTES`` of sets is split into blocks, and each pair of blocks is a task's
work, so no bucket has a cap and none lands in one task. A text travels once to each block of its bucket, which is the
price of an exact number of links. The sets travel only to buckets where a text has a pair of its own. What leaves a
bucket is linear in its texts: the number of links of each, and the edges that keep linked texts connected.

Results are one row per document: the class (the least id of all documents linked directly or through others), the
number of links (other documents with a similarity of the threshold or more, copies among them), the text's own least
id, and whether the row stands for its class: of each class one text does, in one document of it (with the least id).
Null texts have no words, join nothing and stand for themselves. Repeated rows count as copies. Texts of any length are
hashed whole, a piece at a time. An empty table gives an empty result. Only the id and the text are read, so other
columns may have any name. Null ids link like others, and name a class or stand for one only if no other id is there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import release_memory, stash

NGRAM, THRESHOLD, TARGET_RECALL = 5, 0.8, 0.9999
#: Texts, and bytes of their sets, in one block of a bucket (one text may be larger).
BLOCK, BLOCK_BYTES = 384, 4 << 20
#: N-grams hashed at a time, and pairs that are intersected one by one.
CHUNK, FEW = 1 << 20, 64
#: Bytes of text hashed at a time (one text may be longer).
SLICE_BYTES = 1 << 19
#: A-Z to lower case; what isn't a digit, a letter or beyond ASCII parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SEED = np.random.Generator(np.random.PCG64(20240607))
_ODD = _SEED.integers(0, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _SEED.integers(0, 1 << 63, 1024, dtype=np.uint64)


def choose_bands(threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> tuple[int, int]:
    """(bands, rows): the fewest hashes that reach the recall at the threshold while at most 40 % of pairs at half of it meet."""
    found = []
    for rows in range(1, 13):
        bands = max(1, math.ceil(math.log(1 - target_recall) / math.log(1 - threshold**rows)))
        if 1 - (1 - (threshold / 2) ** rows) ** bands <= 0.4:
            found.append((bands * rows, bands, rows))
    return min(found)[1:]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of folded bytes, a piece at a time; pieces end at blanks."""
    hashes, places, start = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while start < len(data):
        piece = data[start : start + SLICE_BYTES]
        if start + len(piece) < len(data):
            blanks = np.flatnonzero(piece == 32)
            if not len(blanks):  # one long word goes on behind the piece
                rest = np.flatnonzero(data[start + len(piece) :] == 32)
                piece = data[start : start + len(piece) + int(rest[0])] if len(rest) else data[start:]
            else:
                piece = piece[: blanks[-1] + 1]
        inside = piece != 32
        edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(first):
            within = np.arange(len(piece)) - np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [len(piece)]])))
            powers = _powers(0x9E3779B97F4A7C15, int((last - first).max()) + 1)
            values = np.where(inside, (piece.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(within, len(powers) - 1)], np.uint64(0))
            hashes.append(_mix(np.add.reduceat(values, first) + (last - first).astype(np.uint64)))
            places.append(first + start)
        start += len(piece)
    return np.concatenate(hashes), np.concatenate(places)


class Grams:
    """Word hashes and n-gram hashes of some texts, one after another, with each text's bounds."""

    def __init__(self, texts: list[str | None], n: int = NGRAM):
        data = [(t or "").encode() for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(d) + 1 for d in data])])
        self.words, first = _words(np.frombuffer(b" ".join(data).translate(_FOLD) + b" ", np.uint8))
        self.starts = np.searchsorted(first, bounds)  # each text's first word, and the number of words
        self.counts = np.diff(self.starts)
        del first
        # N-grams: one for each word that has n - 1 more behind it in its text, or for the first word of a shorter text.
        room = np.repeat(self.starts[1:], self.counts) - np.arange(len(self.words))
        some = np.flatnonzero(self.counts)
        wanted = room >= n
        wanted[self.starts[:-1][some]] = True
        begins = np.flatnonzero(wanted)
        self.grams = np.empty(len(begins), np.uint64)
        for a in range(0, len(begins), CHUNK):
            at = begins[a : a + CHUNK]
            sums, left = np.full(len(at), 0x1234567, np.uint64), room[at]
            for k in range(n):
                sums += np.where(left > k, self.words[np.minimum(at + k, len(self.words) - 1)] * _ODD[k], np.uint64(0))
            self.grams[a : a + CHUNK] = _mix(sums)
        self.gram_starts = np.searchsorted(begins, self.starts)

    def sequences(self) -> list[bytes]:
        """A 128-bit hash of each text's words in order."""
        out = np.zeros((len(self.counts), 2), np.uint64)
        full = np.flatnonzero(self.counts)
        if len(full):
            place = np.arange(len(self.words)) - np.repeat(self.starts[:-1], self.counts)
            longest = int(self.counts.max())
            for k, base in enumerate((0xD1342543DE82EF95, 0xAF251AF3B0F025B5)):
                out[full, k] = _mix(np.add.reduceat(_mix(self.words + _FLIP[k]) * _powers(base, longest)[place], self.starts[:-1][full]))
        return [x.tobytes() for x in out]

    def bands(self, bands: int, rows: int) -> np.ndarray:
        """Band hashes of each text that has words; a row of zeros for the others."""
        out = np.zeros((len(self.counts), bands), np.uint64)
        full = np.flatnonzero(self.counts)
        if not len(full):
            return out.view(np.int64)
        starts = self.gram_starts[:-1][full]
        for band in range(bands):
            value = np.full(len(full), band + 1, np.uint64)
            for row in range(rows):
                k = band * rows + row
                value = _mix(value + np.minimum.reduceat((self.grams ^ _FLIP[k]) * _ODD[k], starts) * _ODD[row])
            out[full, band] = value
        return out.view(np.int64)

    def set_of(self, k: int) -> np.ndarray:
        return np.unique(self.grams[self.gram_starts[k] : self.gram_starts[k + 1]])


def _slices(column: pa.Array) -> Iterator[tuple[int, int, list[str | None]]]:
    """(first, behind, texts) of runs of at most SLICE_BYTES of text; only one run is held as Python strings."""
    ends = np.cumsum(np.array(pc.fill_null(pc.binary_length(column), 0), np.int64))
    start = 0
    while start < len(ends):
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
        yield start, stop, column.slice(start, stop - start).to_pylist()
        start = stop


def sketch(docs: DataFrame, bands: int, rows: int, ngram: int = NGRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, seq, n_words, bands) for every row."""
    read = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("text"))
    kind = read.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a, b, texts in _slices(batch.column("text")):
                grams = Grams(texts, ngram)
                hashes = grams.bands(bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, hashes.size + 1, bands), pa.int32()), pa.array(hashes.ravel()))
                own = [batch.column(c).slice(a, b - a) for c in ("id", "text_hash")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(grams.sequences(), pa.binary()), pa.array(grams.counts, pa.int64()), lists], ["id", "text_hash", "seq", "n_words", "bands"])
        release_memory()

    return read.mapInArrow(run, f"id {kind}, text_hash bigint, seq binary, n_words bigint, bands array<bigint>")


def _groups(batches, names: list[str]) -> Iterator[dict[str, list]]:
    """The columns of each run of rows with an equal ``group``, over batch borders; rows come sorted by it."""
    held: dict[str, list] = {n: [] for n in names}
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in names}
        groups = columns["group"]
        start = 0
        for k in range(len(groups)):
            if held["group"] and groups[k] != held["group"][0] or k > start and groups[k] != groups[k - 1]:
                for n in names:
                    held[n] += columns[n][start:k]
                yield held
                held, start = {n: [] for n in names}, k
        for n in names:
            held[n] += columns[n][start:]
    if held["group"]:
        yield held


def _owned(bucket: int, bands: np.ndarray, sides: np.ndarray, cross: bool) -> np.ndarray:
    """Which pairs i < j of a bucket's texts meet here first; between blocks only pairs of both sides."""
    own = int(np.flatnonzero(bands[0] == bucket)[0])
    earlier = np.zeros((len(bands), len(bands)), bool)
    for t in range(own):
        earlier |= bands[:, t][:, None] == bands[:, t][None, :]
    pairs = np.triu(~earlier, 1)
    if cross:
        pairs &= sides[:, None] != sides[None, :]
    return pairs


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (i, j): a product of the matrices of what both sides hold."""
    if len(i) <= FEW:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    rows, row = np.unique(i, return_inverse=True)
    columns, column = np.unique(j, return_inverse=True)
    left, right = np.concatenate([sets[k] for k in rows]), np.concatenate([sets[k] for k in columns])
    if len(np.intersect1d(rows, columns)):
        found, often = np.unique(np.concatenate([sets[k] for k in np.union1d(rows, columns)]), return_counts=True)
        held = found[often > 1]
    else:
        held = np.intersect1d(left, right)
    both = np.zeros((len(rows), len(columns)))

    def placed(grams: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in held, text) of the grams that are held, by place."""
        at = np.searchsorted(held, grams)
        known = np.flatnonzero(held[np.minimum(at, len(held) - 1)] == grams) if len(held) else np.zeros(0, np.int64)
        known = known[np.argsort(at[known], kind="stable")]
        return at[known], np.repeat(np.arange(len(of)), [len(sets[k]) for k in of])[known]

    (at_left, of_left), (at_right, of_right) = placed(left, rows), placed(right, columns)
    width = 2048
    for a in range(0, len(held), width):
        parts = []
        for at, of, n in ((at_left, of_left, len(rows)), (at_right, of_right, len(columns))):
            lo, hi = np.searchsorted(at, [a, a + width])
            part = np.zeros((n, width), np.float32)
            part[of[lo:hi], at[lo:hi] - a] = 1
            parts.append(part)
        both += parts[0] @ parts[1].T
    return both[row, column].astype(np.int64)


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def _verify(group: dict[str, list], threshold: float) -> list[dict]:
    """For each text of a bucket with a link: other documents, other texts, and the text it hangs on."""
    order = sorted(range(len(group["seq"])), key=lambda k: group["seq"][k])
    bands = np.array([group["bands"][k] for k in order], np.int64)
    sides = np.array([group["side"][k] for k in order])
    copies = np.array([group["copies"][k] for k in order], np.int64)
    sets = [np.frombuffer(group["grams"][k], np.uint64) for k in order]
    sizes = np.array([len(s) for s in sets], np.int64)
    i, j = np.nonzero(_owned(group["bucket"][0], bands, sides, group["cross"][0]))
    if group["cross"][0]:  # each pair from the one side to the other
        swap = sides[i] > sides[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
    both = _intersections(sets, i, j)
    linked = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
    i, j = i[linked], j[linked]
    docs = np.bincount(i, copies[j], len(order)) + np.bincount(j, copies[i], len(order))
    texts = np.bincount(i, minlength=len(order)) + np.bincount(j, minlength=len(order))
    forest = _Forest(len(order))
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        forest.join(a, b)
    return [{"seq": group["seq"][order[k]], "docs": int(docs[k]), "texts": int(texts[k]), "root": group["seq"][order[forest.root(k)]]} for k in np.flatnonzero(texts).tolist()]


def _components(edges: DataFrame) -> DataFrame:
    """(u, v): for every node that isn't its component's least, that least node. Alternating large and small stars."""

    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.union(pairs.select("v", "u")).toDF("u", "v")
            least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
            out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            down = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            least = stash(down.groupBy("u").agg(F.min("v").alias("m")), "least")
            out = down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            out = out.union(least)
        return stash(out.filter("u <> v").distinct(), "stars")

    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now, before = edges, None
    while True:
        now = stars(stars(now, True), False)
        if (after := state(now)) == before:
            return now
        before = after


def join_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, ngram: int = NGRAM, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, class_id, n_links, n_text_links, text_id, n_words, text_hash, representative) for every row."""
    spark: SparkSession = docs.sparkSession
    bands, rows = choose_bands(threshold, target_recall)
    sketched = stash(sketch(docs, bands, rows, ngram, id_col, text_col), "sketch")
    document = F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_hash")  # one document of each text, by an id if there is one
    nodes = stash(sketched.filter("n_words > 0").groupBy("seq").agg(F.min("id").alias("text_id"), F.min(document).alias("document"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("n_words").alias("n_words")), "texts")

    members = nodes.select(F.explode("bands").alias("bucket"), "seq", "n_words")
    shared = stash(members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_words").alias("w")).filter("n > 1"), "buckets")
    members = members.drop("n_words")
    blocks = F.least(F.col("n"), F.ceil(F.greatest(F.col("n") / F.lit(block), F.col("w") * 8 / F.lit(block_bytes)))).cast("int")
    met = stash(members.join(shared, "bucket"), "met")
    side = F.pmod(F.hash("seq"), blocks)
    dealt = (
        met.join(nodes.select("seq", "bands"), "seq")
        .select("bucket", "seq", "bands", side.alias("side"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .withColumn("cross", F.col("side") != F.col("other"))
        .withColumn("group", F.xxhash64("bucket", F.least("side", "other"), F.greatest("side", "other")))
    )

    def owners(batches):
        names = ["group", "bucket", "seq", "bands", "side", "cross"]
        out: dict[str, list] = {n: [] for n in names}
        for group in _groups(batches, names):
            pairs = _owned(group["bucket"][0], np.array(group["bands"], np.int64), np.array(group["side"]), group["cross"][0])
            for k in np.flatnonzero(pairs.any(0) | pairs.any(1)).tolist():
                for n in names:
                    out[n].append(group[n][k])
            if len(out["group"]) >= 4096:
                yield pa.RecordBatch.from_pydict(out, schema)
                out = {n: [] for n in names}
        yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("group", pa.int64()), ("bucket", pa.int64()), ("seq", pa.binary()), ("bands", pa.list_(pa.int64())), ("side", pa.int32()), ("cross", pa.bool_())])
    columns = "group bigint, bucket bigint, seq binary, bands array<bigint>, side int, cross boolean"
    names = [f.name for f in schema]
    owned = stash(dealt.select(*names).repartition("group").sortWithinPartitions("group", "bucket").mapInArrow(owners, columns), "owned")

    # The sets of texts that have pairs: one document of each, its text hashed again.
    wanted = owned.select("seq").distinct().join(nodes.select("seq", "document.id", "document.text_hash", "copies"), "seq")
    read = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("text"))
    same = read["id"].eqNullSafe(wanted["id"]) & (read["text_hash"] == wanted["text_hash"])

    def hashed(batches):
        for batch in batches:
            for a, b, texts in _slices(batch.column("text")):
                grams = Grams(texts, ngram)
                found = [grams.set_of(k).tobytes() for k in range(b - a)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("seq", "copies")), pa.array(grams.sequences(), pa.binary()), pa.array(found, pa.binary())], ["seq", "copies", "own", "grams"])
        release_memory()

    sets = read.join(wanted, same).select("seq", "copies", "text").mapInArrow(hashed, "seq binary, copies bigint, own binary, grams binary")
    sets = stash(sets.filter("seq = own").dropDuplicates(["seq"]).drop("own"), "sets")

    def verified(batches):
        out_schema = pa.schema([("seq", pa.binary()), ("docs", pa.int64()), ("texts", pa.int64()), ("root", pa.binary())])
        out: list[dict] = []
        for group in _groups(batches, [*names, "copies", "grams"]):
            out += _verify(group, threshold)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, out_schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, out_schema)
        release_memory()

    links = stash(
        owned.join(sets, "seq").select(*names, "copies", "grams").repartition("group").sortWithinPartitions("group", "bucket").mapInArrow(verified, "seq binary, docs bigint, texts bigint, root binary"),
        "links",
    )
    tree = _components(stash(links.select(F.col("seq").alias("u"), F.col("root").alias("v")).filter("u <> v").distinct(), "edges"))
    counts = links.groupBy("seq").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    placed = nodes.select("seq", "text_id", "document", "copies").join(counts, "seq", "left").join(tree.select(F.col("u").alias("seq"), F.col("v").alias("root")), "seq", "left")
    placed = stash(placed.withColumn("root", F.coalesce("root", "seq")), "placed")
    least = stash(placed.groupBy("root").agg(F.min("text_id").alias("class_id"), F.min("document").alias("head")), "classes")
    zero = F.lit(0).cast("long")
    texts = stash(placed.join(least, "root").select("seq", "text_id", "class_id", "copies", "head", F.coalesce("docs", zero).alias("docs"), F.coalesce("texts", zero).alias("texts")), "joined")
    return (
        sketched.select("id", "text_hash", F.when(F.col("n_words") > 0, F.col("seq")).alias("seq"), "n_words")
        .join(texts, "seq", "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce("class_id", "id").alias("class_id"),
            F.coalesce(F.col("docs") + F.col("copies") - 1, zero).alias("n_links"),
            F.coalesce("texts", zero).alias("n_text_links"),
            F.coalesce("text_id", "id").alias("text_id"),
            "n_words",
            "text_hash",
            F.coalesce(F.col("id").eqNullSafe(F.col("head.id")) & (F.col("text_hash") == F.col("head.text_hash")) | F.col("head").isNull(), F.lit(False)).alias("representative"),
        )
    )
