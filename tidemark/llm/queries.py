"""The queries of this subpackage, each a thin layer over its operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, html_text, ngram_join, packing, pieces, pii, quality, runs, secret_scan, sharding, url_filter, warc, whitening
from tidemark.llm.common import fresh_path
from tidemark.llm.sql import ORACLE_SQL  # noqa: F401

URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=16)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    records = warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages"), folder), folder, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_text_links")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find_personal_data(_table(spark, sf_dir, "documents")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = _table(spark, sf_dir, "documents"), fresh_path(spark, "secret-ledger")
    secret_scan.scan(docs.filter("lang = 'en'"), ledger)  # an earlier run over the versions of one language has filled the ledger
    return secret_scan.report(secret_scan.scan(docs, ledger))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judge_documents(_table(spark, sf_dir, "documents")).select(*columns)


def model_path() -> str:
    """The model file of the public tokenizers, wherever they are installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_documents(_table(spark, sf_dir, "documents"), model_path, decode=True)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"), F.sha2("starts", 256).alias("spans_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth document, by a checksum of its id, repeats a part of its words from some word on to its end; ids that are null never."""
    words, h = quality.words_of(F.coalesce("text", F.lit(""))), F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))

    def planted(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p))), " ")

    chosen = quality.let(words, lambda w: F.when(F.size(w) > 0, quality.let(w, planted)).otherwise(F.col("text")))
    return docs.select("doc_id", F.when(h % 10 == 0, chosen).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(runs.detect_runs(with_planted_runs(_table(spark, sf_dir, "documents"))))


def tokenizer_path() -> str:
    """The tokenizer file of the public tokenizers, wherever they are installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # This tokenizer drops white space, and nothing it does reaches across it.
    pieces_of = packing.cut_documents(_table(spark, sf_dir, "documents"), tokenizer_path, capacity=4096, end_id=1, by_blanks=True)
    return packing.pack_pieces(pieces_of, capacity=4096)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=32)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_decontamination": op2_decontamination,
    "op3_sharding": op3_sharding,
    "op4_warc": op4_warc,
    "op5_ngram_join": op5_ngram_join,
    "op6_html_text": op6_html_text,
    "op7_pii": op7_pii,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_embedding_whitening": op13_embedding_whitening,
}
