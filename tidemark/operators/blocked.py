"""The best documents of many queries by matrix products: queries go to the executors in blocks, documents stay in place.

A batch of documents meets a block of queries in one product, and a task keeps the best k documents of each query, so
what is shuffled is k rows for each query and task. A block has a bound in bytes; more queries are more blocks, each a
pass of its own. Scores are rounded before they are compared, and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.functions import scoring
from tidemark.functions.text import tokens
from tidemark.tables import stash

#: Bytes of query vectors that are sent at a time, and numbers in one matrix of documents or scores; a step holds some eight of these.
BLOCK_BYTES, CELLS = 64 << 20, 1 << 20
#: Bytes that a word of a query takes as a string, in the vocabulary and in the weights.
WORD_BYTES = 240
DIGITS = 6
K1, B = 1.5, 0.75


def top(df: DataFrame, by: list[str], score: str, tie: str, k: int, rank: str = "rank") -> DataFrame:
    """The best k of each group, ranked from 0; Spark drops the rest before the shuffle (window group limit)."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn(rank, F.row_number().over(w) - 1).filter(F.col(rank) < k)


def _keep(query: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each query."""
    order = np.lexsort((doc, -score, query))
    query, doc, score = query[order], doc[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.concatenate([first, [len(query)]])))
    return query[place < k], doc[place < k], score[place < k]


def _best(scores: np.ndarray, ids: np.ndarray, k: int, positive: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document, score) of all that can be among the best k of a query's row of scores, ties included."""
    if positive:
        scores = np.where(scores > 0, scores, -np.inf)
    least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
    query, at = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    return _keep(query, ids[at], scores[query, at], k)


def _search(docs: DataFrame, id_col: str, columns: list[str], held, score: Callable[[object, pa.RecordBatch], np.ndarray], rows: int, k: int, positive: bool) -> DataFrame:
    """(query, doc, score): every task's best k. ``held``: broadcast (query ids, what ``score`` needs)."""
    kind, asked = docs.schema[id_col].dataType.simpleString(), held.value[2]
    query_type = to_arrow_type(asked)

    def run(batches):
        names, known, _ = held.value
        best = None
        for batch in batches:
            for a in range(0, len(batch), rows):
                part = batch.slice(a, rows)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                ids = ids.astype(str) if ids.dtype == object else ids
                found = _best(np.round(score(known, part), DIGITS), ids, k, positive)
                best = found if best is None else _keep(*(np.concatenate(x) for x in zip(best, found, strict=True)), k)
        if best is not None:
            query, doc, value = best
            yield pa.RecordBatch.from_arrays([pa.array([names[q] for q in query.tolist()], query_type), pa.array(doc), pa.array(value)], ["query", "doc", "score"])

    return docs.select(id_col, *columns).mapInArrow(run, f"query {asked.simpleString()}, doc {kind}, score double")


def _blocks(queries: DataFrame, size: Callable[[object], int]) -> Iterator[list]:
    """(query, value) rows a block at a time; the driver holds one block."""
    block, held = [], 0
    for row in queries.toLocalIterator():
        if block and held + size(row[1]) > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += size(row[1])
    yield block


def _together(parts: list[DataFrame], k: int) -> DataFrame:
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return top(every, ["query"], "score", "doc", k)


def _unit(matrix: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix) if out is None else out, where=norms > 0)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values one after another, how many each row has); null lists are empty."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), sizes


def vector_top(docs: DataFrame, queries: DataFrame, id_col: str, vec_col: str, query_id: str, query_vec: str, k: int) -> DataFrame:
    """(query, doc, score, rank): for each query vector the k documents of highest cosine. 0 for a zero norm or unequal lengths."""

    def score(known: dict[int, np.ndarray], part: pa.RecordBatch) -> np.ndarray:
        values, sizes = _lists(part.column(1))
        ends = np.cumsum(sizes)
        out = np.zeros((sum(len(at) for at, _ in known.values()), len(sizes)))
        for n, (at, vectors) in known.items():
            rows = np.flatnonzero(sizes == n)
            if n and len(rows):
                matrix = values[(ends[rows] - n)[:, None] + np.arange(n)].astype(np.float64)
                out[np.ix_(at, rows)] = vectors @ _unit(matrix).T
        return out

    parts = []
    for block in _blocks(queries.select(query_id, query_vec), lambda v: 8 * len(v or ())):
        sizes = np.array([len(v or ()) for _, v in block])
        known = {int(n): (np.flatnonzero(sizes == n), _unit(np.array([block[x][1] or () for x in np.flatnonzero(sizes == n)], np.float64).reshape(int((sizes == n).sum()), n))) for n in set(sizes.tolist())}
        held = docs.sparkSession.sparkContext.broadcast(([q for q, _ in block], known, queries.schema[query_id].dataType))
        widest = max([1, len(block), *known])
        parts.append(_search(docs, id_col, [vec_col], held, score, max(1, CELLS // widest), k, False))
    return _together(parts, k)


def _codes(text, dim: int):
    """2 * bucket + sign bit of each hashed token and pair of neighbours."""
    hashed = F.transform(scoring.text_features(tokens(F.coalesce(text, F.lit("")))), F.sha1)
    number = lambda h, at, n: F.conv(F.substring(h, at, n), 16, 10).cast("bigint")
    return F.transform(hashed, lambda h: (number(h, 1, 8) % dim * 2 + number(h, 9, 2) % 2).cast("int"))


def _hashed(values: np.ndarray, sizes: np.ndarray, dim: int) -> np.ndarray:
    cells = np.repeat(np.arange(len(sizes)), sizes) * dim + values // 2
    matrix = np.bincount(cells, 1.0 - 2.0 * (values % 2), len(sizes) * dim).astype(np.float64, copy=False).reshape(len(sizes), dim)
    return _unit(matrix, matrix)  # a zero row stays one


def hashed_top(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str, k: int, dim: int = scoring.DIM) -> DataFrame:
    """(query, doc, score, rank): the same for vectors of hashed tokens and pairs, made where the texts are."""
    coded = docs.select(F.col(id_col).alias("doc"), _codes(F.col(text_col), dim).alias("codes"))
    asked = queries.select(F.col(query_id).alias("query"), _codes(F.col(query_text), dim).alias("codes"))
    parts = []
    for block in _blocks(asked, lambda v: 8 * dim):
        sizes = np.array([len(v) for _, v in block], np.int64)
        known = _hashed(np.array([x for _, v in block for x in v], np.int64), sizes, dim)
        held = docs.sparkSession.sparkContext.broadcast(([q for q, _ in block], known, asked.schema["query"].dataType))
        parts.append(_search(coded, "doc", ["codes"], held, lambda known, part: known @ _hashed(*_lists(part.column(1)), dim).T, max(1, CELLS // max(dim, len(block))), k, False))
    return _together(parts, k)


def lexical_top(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str, k: int) -> DataFrame:
    """(query, doc, score, rank): BM25 of the documents that share a term; a term counts as often as the query repeats it.

    Texts are tokenised once, into a written table of the documents' lengths and query terms; document frequencies are
    counted from it, and a posting adds to the queries that hold its term.
    """
    spark = docs.sparkSession
    words = docs.select(F.col(id_col).alias("doc"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    kind = words.schema["doc"].dataType.simpleString()
    asked = queries.select(F.col(query_id).alias("query"), tokens(F.coalesce(F.col(query_text), F.lit(""))).alias("t"))
    parts = []
    for block in _blocks(asked, lambda t: WORD_BYTES * (len(t) + 1)):
        code = {w: c for c, w in enumerate(sorted({w for _, t in block for w in t}))}
        vocabulary = spark.sparkContext.broadcast(list(code))

        def index(batches, vocabulary=vocabulary):
            terms = pa.array(vocabulary.value, pa.string())
            for batch in batches:
                words, sizes = batch.column(1), batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                found = pc.index_in(words.flatten(), value_set=terms)
                known = found.is_valid().to_numpy(zero_copy_only=False)
                cells = np.repeat(np.arange(len(sizes)), sizes)[known] * max(1, len(terms)) + found.drop_null().to_numpy().astype(np.int64)
                cells, times = np.unique(cells, return_counts=True)
                offsets = pa.array(np.searchsorted(cells, np.arange(len(sizes) + 1) * max(1, len(terms))), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (cells % max(1, len(terms)), times)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["doc", "len", "codes", "times"])

        postings = stash(words.mapInArrow(index, f"doc {kind}, len bigint, codes array<int>, times array<int>"), "postings")
        n, mean = postings.agg(F.count("*"), F.avg("len")).first()
        often = dict(postings.select(F.explode("codes").alias("c")).groupBy("c").count().collect())  # a row a query term
        df = np.array([often.get(c, 0) for c in range(len(code))], np.float64)
        # Weights by term: the queries that hold it, one after another. A block's words bound their bytes.
        pairs = [np.unique(np.array([code[w] for w in t], np.int64), return_counts=True) for _, t in block]
        query_of = np.repeat(np.arange(len(block), dtype=np.int32), [len(c) for c, _ in pairs])
        term_of = np.concatenate([c for c, _ in pairs]) if pairs else np.zeros(0, np.int64)
        times = np.concatenate([n for _, n in pairs]) if pairs else np.zeros(0, np.int64)
        by_term = np.argsort(term_of, kind="stable")
        value = (times * np.maximum(0.0, np.log((n - df + 0.5) / (df + 0.5) + 1))[term_of])[by_term]
        first = np.searchsorted(term_of[by_term], np.arange(len(code) + 1))
        held = spark.sparkContext.broadcast(([q for q, _ in block], (first, query_of[by_term], value, len(block), mean or 1.0), asked.schema["query"].dataType))

        def score(known, part):
            first, query_of, value, n_queries, mean = known
            (codes, sizes), (times, _) = _lists(part.column(2)), _lists(part.column(3))
            length = part.column(1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            share = times * (K1 + 1) / (times + K1 * (1 - B + B * length[row] / mean))
            out = np.zeros(n_queries * len(sizes))
            met = first[codes + 1] - first[codes]  # a posting meets each query that holds its term
            ends = np.cumsum(met)
            at = 0
            while at < len(codes):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, side="right")))
                k_of = np.repeat(np.arange(at, stop), met[at:stop])
                place = np.arange(len(k_of)) - np.repeat(ends[at:stop] - met[at:stop] - (ends[at - 1] if at else 0), met[at:stop]) + np.repeat(first[codes[at:stop]], met[at:stop])
                out += np.bincount(query_of[place].astype(np.int64) * len(sizes) + row[k_of], value[place] * share[k_of], len(out))
                at = stop
            return out.reshape(n_queries, len(sizes))

        parts.append(_search(postings, "doc", ["len", "codes", "times"], held, score, max(1, CELLS // max(1, len(block))), k, True))
    return _together(parts, k)
