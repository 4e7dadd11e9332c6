"""The ledger of secret scans: what is scanned, and where results come from."""

import random

from pyspark.sql import functions as F

from tidemark.llm import queries, secret_scan


def test_copies_are_scanned_once_and_known_blobs_never(spark, tmp_path):
    rows = [(k, f"password=hunter{k % 7}00", "en") for k in range(50)] + [(None, None, "en"), (60, "", "de"), (61, "plain", "de"), (61, "plain", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    ledger = f"file://{tmp_path}/ledger"
    stored = spark.read.parquet(f"{tmp_path}/documents.parquet")
    secret_scan.scan(stored.filter("doc_id < 3"), ledger).count()
    assert spark.read.parquet(ledger).count() == 3
    found = secret_scan.scan(stored, ledger)
    entries = spark.read.parquet(ledger)
    assert entries.count() == entries.select("blob").distinct().count() == 9  # seven secrets, the empty text, the plain one
    assert found.count() == len(rows) and found.filter("size(spans) = 1").count() == 50
    for source in (stored, docs):  # rows of files, and rows that lie in none
        secret_scan.scan(source, ledger).count()
        secret_scan.redact_documents(source, ledger).count()
        assert spark.read.parquet(ledger).count() == 9


def test_results_come_out_of_the_ledger(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    docs = spark.createDataFrame([(1, "nothing to see"), (2, "token=abcdef1"), (3, "nothing to see")], "doc_id long, text string")
    planted = spark.sql(f"SELECT sha2('nothing to see', 256) AS blob, '{secret_scan.RULES_VERSION}' AS rules, array(named_struct('kind', 'hex', 'start', 0, 'end', 7, 'value', 'nothing', 'before', '', 'after', '')) AS spans")
    planted.write.parquet(ledger)
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs, ledger).collect()}
    assert got[1] == got[3] and got[1][0]["kind"] == "hex" and got[2][0]["kind"] == "assign"
    assert {r["text"] for r in secret_scan.redact_documents(docs, ledger).collect()} == {"[SECRET:hex] to see", "[SECRET:assign]"}
    # Entries of another version of the rules count for nothing.
    planted.withColumn("rules", F.lit("old")).write.parquet(f"{ledger}-old")
    assert all(not r["spans"] for r in secret_scan.scan(docs.filter("doc_id <> 2"), f"{ledger}-old").collect())
    assert spark.read.parquet(f"{ledger}-old").count() == 2


def test_places_over_files_and_bitmaps(spark, tmp_path):
    spark.range(150000).withColumn("text", F.col("id").cast("string")).repartition(2).write.parquet(f"{tmp_path}/many")
    placed = secret_scan._placed(spark.read.parquet(f"{tmp_path}/many"), {"id": "id", "text": "text"})
    chosen = set(random.Random(8).sample(range(150000), 20000))
    picks = placed.join(spark.createDataFrame([(x,) for x in chosen], "id long"), "id")
    marked = secret_scan._marked(placed, secret_scan._bits(picks.select("__file", "__row")))
    assert {r["id"] for r in marked.filter("__set").select("id").collect()} == chosen and marked.count() == 150000


def test_query_over_a_part_filled_ledger(spark, sf):
    rows = queries.op8_secret_scan(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(rows) == docs.count()
    direct = secret_scan.report(docs.select("doc_id", secret_scan.find_secrets(F.coalesce("text", F.lit(""))).alias("spans")))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, direct.collect()))
