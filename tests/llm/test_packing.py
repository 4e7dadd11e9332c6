"""Packing against the library's ids, plain best fit decreasing and an exhaustive search."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import packing, queries


def fewest(sizes, capacity):
    """The least number of bins, by trying every place for each item."""
    best = len(sizes)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for b in {r: i for i, r in enumerate(rooms) if r >= sizes[k]}.values():
            put(k + 1, rooms[:b] + [rooms[b] - sizes[k]] + rooms[b + 1 :])
        put(k + 1, [*rooms, capacity - sizes[k]])

    put(0, [])
    return best


def test_bound_never_exceeds_the_fewest_bins_and_best_fit_is_a_packing():
    r, tight = random.Random(2), 0
    for _ in range(300):
        capacity = r.randrange(4, 30)
        sizes = sorted((r.randrange(1, capacity + 1) for _ in range(r.randrange(9))), reverse=True)
        least = fewest(sizes, capacity)
        bound = packing.lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        bins, offsets = packing.best_fit_decreasing(np.array(sizes, np.int64), capacity)
        held = {}
        for b, o, s in sorted(zip(bins.tolist(), offsets.tolist(), sizes, strict=True)):
            assert o == held.get(b, 0)
            held[b] = o + s
        assert bound <= least <= len(held) and all(v <= capacity for v in held.values())
        tight += bound == least
    assert tight > 280


def check_packing(rows, capacity, bound=None):
    """Gapless sequences within the capacity; as many as the bound says."""
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in held.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at and n >= 1
            at += n
        assert at <= capacity
    assert bound is None or len(held) == bound
    return len(held)


@pytest.mark.parametrize("kind", ["small", "large", "mixed"])
def test_partitions_with_gaps_exchange_pieces(spark, kind):
    r, capacity = random.Random(kind), 64
    size = {"small": lambda: r.randrange(1, 20), "large": lambda: r.randrange(20, 65), "mixed": lambda: r.choice([r.randrange(1, 65), 22, 33, 31])}[kind]
    sizes = [size() for _ in range(6000)]
    pieces = spark.createDataFrame([(7, n, "x") for n in sizes], "doc_id long, length long, note string").repartition(5)
    rows = packing.pack_pieces(pieces, capacity, part_items=300).collect()
    assert sorted(x["length"] for x in rows) == sorted(sizes) and {x["note"] for x in rows} == {"x"}
    bound = packing.lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
    whole = packing.best_fit_decreasing(np.array(sizes), capacity)[0].max() + 1
    assert bound <= check_packing(rows, capacity) <= whole + 1


def test_query_against_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(4)
    tricky = ["á b́ <|endoftext|>x <|STARTOFTEXT|> <|startoftext|>.", "\x1c\x85b Ä İI ﬁ 가 don't we'll 's 'LL.. a.b, c...,!", "H̱x, ̸a ≠ ≮. É. x́. 日本語。", "ONE, one. One; oNE!? ²³ ½ _ a_b"]
    texts = [None, "", " ", *tricky, "word " * 4095, "word " * 4096, "x" * 9000, " ".join(f"v{r.randrange(9000)}" for _ in range(5000))]
    texts += [" ".join(r.choice(["Alpha,", "beta", "Gamma.", "δέλτα", "42", "e-mail"]) for _ in range(r.randrange(900))) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (3, tricky[0]), (3, tricky[0])]
    docs = spark.createDataFrame([(i, t, -1, "own") for i, t in rows], "doc_id long, text string, length long, sequence_id string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_best_fit_packing(spark, str(tmp_path)).collect()
    library, want = Tokenizer.from_file(queries.tokenizer_path()), []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want.append((i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((tuple(x)[:5] for x in got), key=repr) == sorted(want, key=repr)
    lengths = [w[3] for w in want]
    check_packing(got, 4096, packing.lower_bound(np.bincount(lengths, minlength=4097), 4096))
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op12_best_fit_packing(spark, f"{tmp_path}/none").count() == 0


def test_whole_sequences(spark):
    docs = spark.createDataFrame([(k, f"alpha {'beta ' * k}") for k in range(60)], "doc_id long, text string")
    cut = packing.cut_documents(docs, queries.tokenizer_path, 100, 1, with_ids=True)
    whole = packing.cut_documents(docs, queries.tokenizer_path, 100, 1, with_ids=True, by_blanks=True)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))
    packed = packing.pack_pieces(cut, 100)
    made = packing.sequences(packed).collect()
    assert sum(r["length"] for r in made) == packed.agg(F.sum("length")).first()[0]
    assert all(len(r["ids"]) == 4 * r["length"] <= 400 for r in made)
    for p in packed.collect():
        s = next(r for r in made if r["sequence_id"] == p["sequence_id"])
        assert s["ids"][4 * p["offset"] : 4 * (p["offset"] + p["length"])] == p["ids"]
