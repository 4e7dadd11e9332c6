"""The stages on a small table of planted cases, against plain Python."""

import random

import corpus_pipeline


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(f"v{r.randrange(900)}" for _ in range(n))


def test_stages(spark, tmp_path):
    bench = prose("bench", 30)
    rows = [(k, prose(k, 80)) for k in range(20)]
    rows += [(100, prose(3, 80)), (101, prose(3, 80) + " tail"), (102, "too short"), (103, "a b c d e " * 30), (104, prose(104, 60) + " " + bench + " " + prose(105, 60)), (105, bench), (106, prose(106, 50) + ' token = "abcdef123456"'), (107, None), (108, ""), (5, prose(5, 80))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t else None, "keep") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, spans string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(path := f"{tmp_path}/{len(seen)}")
        now = spark.read.parquet(path)
        seen.append({r["doc_id"]: r for r in now.collect()})
    assert set(seen[0]) == {*range(20), 100, 101, 104, 105, 106}
    assert set(seen[1]) == {*range(20), 104, 105, 106}  # the least id of each group stays, repeated rows once
    assert set(seen[2]) == {*range(20), 104, 106} and bench not in seen[2][104]["text"] and seen[2][104]["text"].startswith(prose(104, 60))
    assert "abcdef123456" not in seen[3][106]["text"] and seen[3][106]["n_chars"] == len(seen[3][106]["text"])
    assert all(seen[3][k]["text"] == prose(k, 80) and seen[3][k]["spans"] == "keep" for k in range(20))
    done = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(done) == set(seen[3])

    import hashlib

    for i, r in done.items():
        assert r["decoded_sha256"] == hashlib.sha256(seen[3][i]["text"].encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(bytes(r["ids"])).hexdigest() and r["n_tokens"] * 4 == len(r["ids"])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_are_told_by_text_where_ids_repeat(spark):
    rows = [(1, prose(1, 80)), (1, prose(1, 80) + " tail"), (1, prose(2, 80)), (1, prose(2, 80)), (None, prose(3, 80)), (None, prose(3, 80)), (None, prose(3, 80) + " tail"), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in corpus_pipeline.near_copies(spark, docs, "").collect()), key=repr)
    kept = [t for i, t in got if i == 1]
    assert len(got) == 5 and prose(2, 80) in kept and sum(t.startswith(prose(1, 80)) for t in kept) == 1
    assert sum(t is None for _, t in got) == 2 and sum(i is None and t is not None for i, t in got) == 1
