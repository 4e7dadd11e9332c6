"""The kept lexical index against a search that reads everything."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark import tables
from tidemark.operators import blocked, lexical_index

WORDS = [f"w{k}" for k in range(400)]


def texts(spark, seed, ids):
    r = random.Random(seed)
    draw = lambda: " ".join(WORDS[min(399, int(r.paretovariate(0.6)))] for _ in range(r.randrange(0, 60)))
    return spark.createDataFrame([(i, draw()) for i in ids], "id long, text string")


def rows(df):
    return sorted(tuple(r) for r in df.select("query", "doc", "score", "rank").collect())


def test_changes_of_an_index_give_what_a_fresh_search_gives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_index, "BLOCK_DOCS", 16)
    root = f"file://{tmp_path}/index"
    queries = spark.createDataFrame([(k, " ".join(random.Random(k).choices(WORDS[:60], k=4)) + " w3 w3") for k in range(20)] + [(90, ""), (91, None), (92, "unknown words")], "q long, text string")
    with pytest.raises(ValueError, match="no document"):
        lexical_index.search(queries, root, "q", "text", 3)
    first, second = texts(spark, 1, range(600)), texts(spark, 2, range(400, 700))
    lexical_index.add(first, root, "id", "text", part_docs=250)
    check = lambda docs, k: rows(lexical_index.search(queries, root, "q", "text", k)) == rows(blocked.lexical_top(docs, queries, "id", "text", "q", "text", k))
    assert check(first, 5)
    files = {n for n in tables.list_names(spark, f"{root}/segments")}
    lexical_index.add(second, root, "id", "text")  # replaces 400 to 599
    lexical_index.remove(spark.range(0, 700, 3), root, "id")
    now = first.filter("id < 400").unionByName(second).filter("id % 3 <> 0")
    assert check(now, 4) and files < {n for n in tables.list_names(spark, f"{root}/segments")}
    lexical_index.add(texts(spark, 3, [0, 3]), root, "id", "text")  # removed ids come back
    assert check(now.unionByName(texts(spark, 3, [0, 3])), 700)


def test_bounds_spare_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_index, "BLOCK_DOCS", 16)
    root = f"file://{tmp_path}/index"
    docs = spark.createDataFrame([(k, "common " * (1 + (k < 40) * 9) + f"rare{k % 500}") for k in range(4000)], "id long, text string")
    lexical_index.add(docs, root, "id", "text")
    asked = spark.createDataFrame([(1, "common rare7")], "q long, text string")
    work = lexical_index.search_work(asked, root, "q", "text", 3).first()
    assert work["skipped"] > 2 * work["scored"] > 0 and work["scored"] + work["skipped"] == 4008
    assert rows(lexical_index.search(asked, root, "q", "text", 3)) == rows(blocked.lexical_top(docs, asked, "id", "text", "q", "text", 3))


def test_weights_of_many_queries_are_sparse(spark, monkeypatch):
    """Small blocks and pieces give the same ranks as large ones; a block's weights have an entry a word."""
    docs = texts(spark, 5, range(300))
    queries = texts(spark, 6, range(150)).withColumn("text", F.substring("text", 1, 60))
    want = rows(blocked.lexical_top(docs, queries, "id", "text", "id", "text", 3))
    monkeypatch.setattr(blocked, "CELLS", 500)
    monkeypatch.setattr(blocked, "BLOCK_BYTES", 100_000)
    assert rows(blocked.lexical_top(docs, queries, "id", "text", "id", "text", 3)) == want and len(want) > 300
    assert sorted(r[3] for r in want if r[0] == want[0][0]) == [0, 1, 2]


def test_parts_are_bounded_in_words(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_index, "PART_WORDS", 1000, raising=False)
    docs = spark.range(60).selectExpr("id AS doc", "repeat(concat('w', id, ' common '), 50) AS text")  # few, but long
    lexical_index.add(docs, f"{tmp_path}/index", "doc", "text")
    _, known = lexical_index.changes(spark, f"{tmp_path}/index")
    stored = spark.read.parquet(f"{tmp_path}/index/segments/{known[0]['add']}/docs")
    assert stored.select("part").distinct().count() == 6 and stored.count() == 60
    queries = spark.createDataFrame([(1, "w7 common")], "q long, text string")
    assert lexical_index.search(queries, f"{tmp_path}/index", "q", "text", 1).first()["doc"] == 7


def shuffled(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()


def test_added_words_are_shuffled_once(spark, tmp_path):
    docs = texts(spark, 7, range(6000))
    chars, before, folder = docs.agg(F.sum(F.length("text"))).first()[0], shuffled(spark), tables.fresh_path(spark, "x").rsplit("/", 1)[0]
    kept = set(tables.list_names(spark, folder))
    lexical_index.add(docs, f"file://{tmp_path}/index", "id", "text")
    assert shuffled(spark) - before < chars  # 4.0 times as much when terms, counts and postings were shuffled each
    assert set(tables.list_names(spark, folder)) == kept  # no copy of the texts stays


def test_parts_are_built_a_few_blocks_at_a_time(spark, tmp_path, monkeypatch):
    """Ids of another type, texts without words, an empty batch, parts bounded in characters, steps of a block or more."""
    monkeypatch.setattr(lexical_index, "BLOCK_DOCS", 8)
    monkeypatch.setattr(lexical_index, "STEP_CHARS", 1500, raising=False)
    monkeypatch.setattr(lexical_index, "PART_CHARS", 20_000, raising=False)
    root = f"file://{tmp_path}/index"
    odd = spark.createDataFrame([(-1, ""), (-2, None), (-3, "... !"), (-4, "  W3 É w5-W5 ")], "id long, text string")
    docs = texts(spark, 8, range(500)).unionByName(odd).withColumn("id", F.concat(F.lit("d"), "id"))
    queries = spark.createDataFrame([(k, " ".join(random.Random(k).choices(WORDS[:40], k=5))) for k in range(12)], "q long, text string")
    lexical_index.add(docs.limit(0), root, "id", "text")
    lexical_index.add(odd.filter("id = -3").withColumn("id", F.col("id").cast("string")), root, "id", "text")
    lexical_index.remove(odd.select(F.col("id").cast("string").alias("id")), root, "id")
    assert lexical_index.search(queries, root, "q", "text", 5).count() == 0
    lexical_index.add(docs, root, "id", "text")
    stored = spark.read.parquet(f"{root}/segments/{lexical_index.changes(spark, root)[1][-1]['add']}/docs")
    assert stored.count() == 504 and stored.select("part").distinct().count() == -(-docs.agg(F.sum(F.length("text"))).first()[0] // 20_000) > 1
    assert rows(lexical_index.search(queries, root, "q", "text", 5)) == rows(blocked.lexical_top(docs, queries, "id", "text", "q", "text", 5))
