"""The corpus pipeline over ``documents``: quality rules, near copies, benchmark passages, secrets, token encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of ``docs``, whatever they are called; where a stage changes a text, ``n_chars`` follows it.

Null and empty texts have no words, so the first stage rejects them; the later ones keep them if they are given any.
Null ids and ids that repeat are documents like others, told apart by their texts; rows that repeat become one in
the second stage, and of rows that share id and text but not their other columns an arbitrary one stays. Ties for the place of a class go to the smaller hash of the text. Texts of any length pass whole. An
empty table gives an empty table at every stage, and an empty benchmark cuts nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, ngram_join, pieces, quality, queries, secret_scan
from tidemark.llm.common import scratch, stash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the others lose their boilerplate lines."""
    return quality.kept_documents(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents that links connect, the one with the least id stays, once; documents without words stay.

    A document is told by its id and a hash of its text, so rows that share an id are decided each by its own text.
    """
    with scratch(spark) as keep:  # the join's own tables go as soon as its decisions are written
        joined = ngram_join.join_documents(docs).filter("n_words > 0")
        told = joined.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.max("representative").alias("stays"), F.count("*").alias("rows"))
        told = keep(told.filter(~F.col("stays") | (F.col("rows") > 1)), "copies")
    of = docs.withColumn("__text_of_row", F.xxhash64("text"))
    same = lambda other: of["doc_id"].eqNullSafe(other["__id"]) & (of["__text_of_row"] == other["__hash"])
    repeated = told.filter("stays")
    single = of.join(told, same(told), "left_anti")
    rows = of.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "__text_of_row"])
    return single.unionByName(rows).drop("__text_of_row")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside an occurrence of a benchmark phrase are cut out; a document with no word left goes."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"__rest{k}") for k, c in enumerate(rest)])
    found = decontaminate.find_contamination(held, benchmark, keep=held.columns[2:])
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    left = found.filter((hit == 0) | (hit < F.col("n_words"))).withColumn("__cut", decontaminate.without_spans(F.col("text"), F.col("spans")))
    out = {c: F.col(f"__rest{k}") for k, c in enumerate(rest)} | {"doc_id": F.col("doc_id"), "text": F.col("__cut")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.size("spans") > 0, F.length("__cut").cast("bigint")).otherwise(out["n_chars"])
    return left.select(*[out[c].alias(c) for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    return secret_scan.redact_documents(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def token_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and piece starts of every text, packed, with digests of them and of the text that the ids decode to."""
    encoded = pieces.encode_documents(docs, queries.model_path, decode=True)
    return encoded.select("doc_id", "n_tokens", "ids", "starts", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"), F.sha2("starts", 256).alias("spans_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("secret scans", secrets),
    ("SentencePiece encoding and decoding", token_encoding),
]

#: MinHash bands, the FM-index and the tokenizer have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each over what its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"stage{k}")
    return docs
