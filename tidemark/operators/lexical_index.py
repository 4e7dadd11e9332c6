"""A kept lexical index: segments of postings in blocks of documents, tombstones, and the best k by block maxima.

Each change of the index is a folder of its own, and a manifest that only one writer can put names those that count. An
added segment deals its documents into parts, numbers them there, and keeps for each block of ``BLOCK_DOCS`` numbers and
each term the postings, the greatest count and the least length: with these a bound on any score in the block is known
whatever the collection's statistics have become since. Only the documents' words are shuffled, once, to their parts; a
part is bounded, and its postings are made and written where it lies. A removal is a list of ids; an id that is added
again counts where it was added last. So a change costs what it brings, and the statistics are taken when a query is
asked: only postings of query terms are kept for it.

A part answers a block of queries by itself. For each query the bounds of its terms are added up for all blocks at once;
blocks are scored from the greatest bound down, until no block can reach the k-th score that was found.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark import tables
from tidemark.functions.text import tokens
from tidemark.operators.blocked import B, DIGITS, K1, _blocks, _keep, _together
from tidemark.operators.segments import ATTEMPTS, Conflict, put_if_absent

#: Documents of a block, and of a part of a segment on average; words and characters of a part: a task holds a part's words,
#: and the postings of its query terms.
BLOCK_DOCS, PART_DOCS, PART_WORDS, PART_CHARS = 256, 1 << 17, 1 << 22, 1 << 26
#: Characters of the blocks whose words are coded and counted at a time; a block at least.
STEP_CHARS = 1 << 22
#: Bytes that a word of a query takes, in the block that is sent and in its weights.
QUERY_BYTES = 200


def _manifest(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/manifests/{version:020d}.json"


def changes(spark: SparkSession, root: str) -> tuple[int, list[dict]]:
    """(version, the changes that the index consists of, in order)."""
    names = sorted(n for n in tables.list_names(spark, f"{root.rstrip('/')}/manifests") if n.endswith(".json"))
    return (int(names[-1].removesuffix(".json")), json.loads(tables.read_text(spark, f"{root.rstrip('/')}/manifests/{names[-1]}"))) if names else (0, [])


def _commit(spark: SparkSession, root: str, change: dict) -> None:
    for _ in range(ATTEMPTS):
        version, known = changes(spark, root)
        if put_if_absent(spark, _manifest(root, version + 1), json.dumps([*known, change | {"at": version + 1}])):
            return
    raise Conflict(f"no manifest of {root} in {ATTEMPTS} attempts")


def add(docs: DataFrame, root: str, id_col: str, text_col: str, part_docs: int = PART_DOCS) -> None:
    """Add documents; those whose ids the index has are replaced. Ids of one batch are different. ``docs`` is read twice."""
    spark, name = docs.sparkSession, uuid.uuid4().hex
    at = f"{root.rstrip('/')}/segments/{name}"
    texts = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = F.regexp_count(F.lower("text"), F.lit("[a-z0-9]+"))  # as many as tokens() has
    n, total, chars = texts.agg(F.count("*"), F.coalesce(F.sum(words), F.lit(0)), F.coalesce(F.sum(F.length("text").cast("bigint")), F.lit(0))).first()
    parts = max(1, -(-n // part_docs), -(-total // PART_WORDS), -(-chars // PART_CHARS))
    dealt = texts.select(F.pmod(F.xxhash64("doc"), F.lit(parts)).cast("int").alias("part"), "doc", F.array_join(tokens(F.col("text")), " ").alias("words"))
    _built(dealt).write.parquet(f"{at}/postings")
    blocks = spark.read.parquet(f"{at}/postings").filter("docs is not null")
    each = blocks.select("part", "block", F.posexplode(F.arrays_zip("docs", "lens")).alias("place", "d"))
    each.select(F.col("d.docs").alias("doc"), F.col("d.lens").alias("len"), "part", (F.col("block") * BLOCK_DOCS + F.col("place")).alias("ord")).write.parquet(f"{at}/docs")
    _commit(spark, root, {"add": name})


def _built(dealt: DataFrame) -> DataFrame:
    """A part's postings, a few blocks at a time, by term and block; before them a row without a term for each block: its documents and their lengths."""
    doc_type, block_docs, step_chars = dealt.schema["doc"].dataType, BLOCK_DOCS, STEP_CHARS
    doc_arrow = to_arrow_type(doc_type)
    schema = pa.schema([("term", pa.string()), ("part", pa.int32()), ("block", pa.int32()), ("ords", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("max_tf", pa.int32()), ("min_len", pa.int64()), ("docs", pa.list_(doc_arrow)), ("lens", pa.list_(pa.int64()))])

    def table(n: int, **columns) -> pa.Table:
        return pa.table([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def counted(words: pa.Array, start: int, part: int) -> tuple[np.ndarray, pa.Table]:
        """The lengths of some blocks' documents, the first of which has the number ``start``, and their postings."""
        n, split = len(words), pc.split_pattern(words, " ")
        flat, owner = split.flatten(), np.repeat(np.arange(n), split.value_lengths().to_numpy())
        if n and pc.min(pc.binary_length(words)).as_py() == 0:  # a text without words is split into an empty one
            some = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
            flat, owner = flat.filter(pa.array(some)), owner[some]
        coded = flat.dictionary_encode()
        length, by_term = np.bincount(owner, minlength=n), pc.sort_indices(coded.dictionary).to_numpy()
        code_of = np.empty(len(by_term), np.int64)
        code_of[by_term] = np.arange(len(by_term))
        cells, tf = np.unique(code_of[coded.indices.to_numpy()] * n + owner, return_counts=True)
        code, at, tf = cells // n, cells % n, tf.astype(np.int32)
        block = ((at + start) // block_docs).astype(np.int32)
        first = np.flatnonzero(np.diff(code, prepend=-1) | np.diff(block, prepend=-1))
        if not len(first):
            return length, table(0)
        edges = pa.array(np.append(first, len(code)).astype(np.int32))
        lists = lambda values: pa.ListArray.from_arrays(edges, pa.array(values))
        least, most = np.minimum.reduceat(length[at], first), np.maximum.reduceat(tf, first)
        terms = coded.dictionary.take(pa.array(by_term[code[first]]))
        return length, table(len(first), term=terms, part=np.full(len(first), part, np.int32), block=block[first], ords=lists((at + start).astype(np.int32)), tfs=lists(tf), max_tf=most, min_len=least)

    def build(mine: pa.Table) -> pa.Table:
        n, part = len(mine), mine.column("part")[0].as_py()
        by_doc = pc.sort_indices(mine.column("doc"))
        ids, words = (mine.column(c).combine_chunks().take(by_doc) for c in ("doc", "words"))
        starts = np.arange(0, n, block_docs)
        chars = np.add.reduceat(pc.binary_length(words).to_numpy().astype(np.int64), starts)
        lengths, rows, a = [], [], 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(np.cumsum(chars[a:]), step_chars, side="right")) + a)
            length, some = counted(words.slice(a * block_docs, (b - a) * block_docs), a * block_docs, part)
            lengths.append(length)
            rows.append(some)
            a = b
        ends = pa.array(np.append(starts, n).astype(np.int32))
        lists = lambda values: pa.ListArray.from_arrays(ends, values)
        heads = table(len(starts), part=np.full(len(starts), part, np.int32), block=np.arange(len(starts), dtype=np.int32), docs=lists(ids.cast(doc_arrow)), lens=lists(pa.array(np.concatenate(lengths), pa.int64())))
        return pa.concat_tables([heads, *rows])

    kinds = f"term string, part int, block int, ords array<int>, tfs array<int>, max_tf int, min_len bigint, docs array<{doc_type.simpleString()}>, lens array<bigint>"
    return dealt.groupBy("part").applyInArrow(build, kinds)


def remove(ids: DataFrame, root: str, id_col: str) -> None:
    """Remove documents; ids that the index hasn't are passed over."""
    name = uuid.uuid4().hex
    ids.select(F.col(id_col).alias("doc")).distinct().write.parquet(f"{root.rstrip('/')}/removals/{name}")
    _commit(ids.sparkSession, root, {"remove": name})


def _live(spark: SparkSession, root: str, known: list[dict]) -> tuple[DataFrame, bool]:
    """(segment, part, ord, doc, len) of the documents that count, and whether that is all."""
    read = lambda c: spark.read.parquet(f"{root.rstrip('/')}/segments/{c['add']}/docs").withColumn("segment", F.lit(c["add"])).withColumn("at", F.lit(c["at"]))
    adds, gone = [c for c in known if "add" in c], [c for c in known if "remove" in c]
    every = read(adds[0])
    for c in adds[1:]:
        every = every.unionByName(read(c))
    if len(known) == 1:
        return every.drop("at"), True
    words = every.select("doc", "at", F.struct("segment", "part", "ord", "len").alias("d"))
    for c in gone:
        words = words.unionByName(spark.read.parquet(f"{root.rstrip('/')}/removals/{c['remove']}").select("doc", F.lit(c["at"]).alias("at"), F.lit(None).cast(words.schema["d"].dataType).alias("d")))
    last = words.groupBy("doc").agg(F.max_by("d", "at").alias("d"))
    return last.filter("d is not null").select("doc", "d.*"), False


def _shares(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def search(queries: DataFrame, root: str, query_id: str, query_text: str, k: int) -> DataFrame:
    """(query, doc, score, rank): the best k documents of the index by BM25, as ``lexical_top`` has them."""
    return _together(_found(queries, root, query_id, query_text, k)[0], k)


def search_work(queries: DataFrame, root: str, query_id: str, query_text: str, k: int) -> DataFrame:
    """(scored, skipped): how many postings of query terms a search scores, and how many its bounds spare it."""
    parts = _found(queries, root, query_id, query_text, k)[1]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.agg(F.sum("scored").alias("scored"), F.sum("skipped").alias("skipped"))


def _found(queries: DataFrame, root: str, query_id: str, query_text: str, k: int) -> tuple[list[DataFrame], list[DataFrame]]:
    spark = queries.sparkSession
    _, known = changes(spark, root)
    adds = [c["add"] for c in known if "add" in c]
    asked_type = queries.schema[query_id].dataType
    if not adds:
        raise ValueError(f"no document was ever added to {root}")
    live, whole = _live(spark, root, known)
    live = tables.stash(live, "live")
    n, mean = live.agg(F.count("*"), F.avg("len")).first()
    doc_type = live.schema["doc"].dataType
    read = lambda s: spark.read.parquet(f"{root.rstrip('/')}/segments/{s}/postings").select("term", "part", "block", "ords", "tfs", "max_tf", "min_len", F.lit(s).alias("segment"))
    every = read(adds[0])
    for s in adds[1:]:
        every = every.unionByName(read(s))
    asked = queries.select(F.col(query_id).alias("query"), tokens(F.coalesce(F.col(query_text), F.lit(""))).alias("t"))
    results, works = [], []
    for block in _blocks(asked, lambda t: QUERY_BYTES * (len(t) + 1)):
        code = {w: c for c, w in enumerate(sorted({w for _, t in block for w in t}))}
        terms = spark.createDataFrame(pa.table({"term": pa.array(code, pa.string()), "code": pa.array(code.values(), pa.int32())}))
        postings = tables.stash(every.join(F.broadcast(terms), "term").drop("term"), "asked")  # a block's words bound its terms
        if whole:
            often = dict(postings.groupBy("code").agg(F.sum(F.size("ords"))).collect())  # a row a query term
        else:
            often = dict(_counted(postings, live).groupBy("code").agg(F.sum("n")).collect())
        df = np.array([often.get(c, 0) for c in range(len(code))], np.float64)
        idf = np.maximum(0.0, np.log((n - df + 0.5) / (df + 0.5) + 1))
        weights = []  # (codes, weights) of each query
        for _, t in block:
            codes, times = np.unique(np.array([code[w] for w in t], np.int64), return_counts=True)
            weights.append((codes, times * idf[codes]))
        held = spark.sparkContext.broadcast(([q for q, _ in block], weights, mean or 1.0))
        found = tables.stash(_answered(postings, live, held, asked_type, doc_type, k), "found")
        results.append(found.filter("doc is not null").select("query", "doc", "score"))
        works.append(found.filter("scored is not null").select("scored", "skipped"))
    return results, works


def _counted(postings: DataFrame, live: DataFrame) -> DataFrame:
    """(code, n): how many documents that count hold a term, for each part."""

    def count(mine: pa.Table, docs: pa.Table) -> pa.Table:
        if not len(mine) or not len(docs):
            return pa.table({"code": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
        lists = mine.column("ords").combine_chunks()
        place, ords = lists.flatten().to_numpy(), docs.column("ord").to_numpy()
        alive = np.zeros(max(int(place.max()), int(ords.max())) + 1, bool)
        alive[ords] = True
        often = np.bincount(np.repeat(mine.column("code").to_numpy(), lists.value_lengths().to_numpy())[alive[place]])
        code = np.flatnonzero(often)
        return pa.table({"code": pa.array(code, pa.int32()), "n": pa.array(often[code], pa.int64())})

    keys = ["segment", "part"]
    return postings.select(*keys, "code", "ords").groupBy(*keys).cogroup(live.select(*keys, "ord").groupBy(*keys)).applyInArrow(count, "code int, n bigint")


def _answered(postings: DataFrame, live: DataFrame, held, asked_type, doc_type, k: int) -> DataFrame:
    """(query, doc, score) of each part's best k of each query, and a row (scored, skipped) for each part."""
    query_arrow, doc_arrow = to_arrow_type(asked_type), to_arrow_type(doc_type)

    def answer(mine: pa.Table, docs: pa.Table) -> pa.Table:
        names, weights, mean = held.value
        found, scored, skipped = [], 0, 0
        if len(docs) and len(mine):
            ords = docs.column("ord").to_numpy()
            size = int(ords.max()) + 1
            length, at = np.zeros(size, np.int64), np.full(size, -1, np.int64)
            length[ords], at[ords] = docs.column("len").to_numpy(), np.arange(len(docs))
            ids = docs.column("doc").to_numpy()
            ids = ids.astype(str) if ids.dtype == object else ids
            mine = mine.sort_by([("code", "ascending"), ("block", "ascending")]).combine_chunks()
            code, block = mine.column("code").to_numpy(), mine.column("block").to_numpy()
            first, last = np.searchsorted(code, np.arange(code.max() + 2)), int(code.max())
            lists = mine.column("ords").combine_chunks()
            starts, place, tf = lists.offsets.to_numpy(), lists.values.to_numpy(), mine.column("tfs").combine_chunks().values.to_numpy()
            bound = _shares(mine.column("max_tf").to_numpy(), mine.column("min_len").to_numpy(), mean)
            n_blocks = int(block.max()) + 1
            for q, (codes, value) in enumerate(weights):
                rows = [(c, w) for c, w in zip(codes.tolist(), value.tolist(), strict=True) if c <= last and first[c] < first[c + 1]]
                if not rows:
                    continue
                span = np.concatenate([np.arange(first[c], first[c + 1]) for c, _ in rows])
                weight = np.concatenate([np.full(first[c + 1] - first[c], w) for c, w in rows])
                most = np.bincount(block[span], weight * bound[span], n_blocks)
                by_block = np.argsort(block[span], kind="stable")
                span, weight = span[by_block], weight[by_block]
                edge = np.searchsorted(block[span], np.arange(n_blocks + 1))
                total = int((starts[span + 1] - starts[span]).sum())
                best, done, step = None, 0, 8
                order = np.flatnonzero(most > 0)
                order = order[np.argsort(-most[order], kind="stable")]
                while len(order):
                    if best is not None and len(best[2]) >= k and most[order[0]] + 10.0**-DIGITS < best[2][-1]:
                        break
                    now, order, step = order[:step], order[step:], min(2 * step, 256)
                    rows_now = np.concatenate([np.arange(edge[b], edge[b + 1]) for b in now.tolist()])
                    sizes = starts[span[rows_now] + 1] - starts[span[rows_now]]
                    take = np.repeat(starts[span[rows_now]] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                    done += len(take)
                    where = place[take]
                    alive = (where < size) & (at[np.minimum(where, size - 1)] >= 0)
                    where, take = where[alive], take[alive]
                    share = np.repeat(weight[rows_now], sizes)[alive] * _shares(tf[take], length[where], mean)
                    hit, inverse = np.unique(where, return_inverse=True)
                    score = np.round(np.bincount(inverse, share, len(hit)), DIGITS)
                    some = score > 0
                    part = _keep(np.full(int(some.sum()), q), ids[at[hit[some]]], score[some], k)
                    best = part if best is None else _keep(*(np.concatenate(x) for x in zip(best, part, strict=True)), k)
                scored, skipped = scored + done, skipped + total - done
                if best is not None:
                    found.append(best)
        query, doc, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else ([], [], [])
        m = len(query)
        return pa.table(
            {
                "query": pa.concat_arrays([pa.array([names[int(q)] for q in query], query_arrow), pa.nulls(1, query_arrow)]),
                "doc": pa.concat_arrays([pa.array(list(doc), doc_arrow), pa.nulls(1, doc_arrow)]),
                "score": pa.array([*map(float, score), None], pa.float64()),
                "scored": pa.array([None] * m + [scored], pa.int64()),
                "skipped": pa.array([None] * m + [skipped], pa.int64()),
            }
        )

    keys = ["segment", "part"]
    kinds = f"query {asked_type.simpleString()}, doc {doc_type.simpleString()}, score double, scored bigint, skipped bigint"
    return postings.groupBy(*keys).cogroup(live.groupBy(*keys)).applyInArrow(answer, kinds)
