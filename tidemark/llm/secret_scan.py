"""Secret scans with an incremental ledger of blobs, with DataFrame functions only.

Every historical version of a text is addressed by its content (SHA-256). The ledger holds, for each blob and version
of the rules, what a scan found. A run scans only blobs that the ledger lacks at the current version, each once however
many copies are new, appends them, and joins the findings back to all paths that hold a blob: results come out of the
ledger alone. Two runs at a time may both append a blob, and a reader takes one entry of it.

Texts are scanned where they stand. A row is told by its place, which is its file and its number there: the least place
of each unseen blob is chosen, and the chosen places go back to the scan as bitmaps, so that only hashes, places and
spans are shuffled. Bitmaps too large to broadcast make the texts move once.

Null texts count as empty. Repeated rows stay repeated. Texts are scanned whole, also with very many matches. Only the
id and the text are read, so other columns may have any name but those of this module, which begin with two underscores.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import exists, fresh_path, stash
from tidemark.llm.spans import SPAN_TYPE, if_contains, listed, masked, matches

#: Kinds in the order of reports, and their patterns. Long runs are matched whole, so a least length in a pattern drops what is shorter.
BASE_KINDS = ["assign", "access", "hex"]
PATTERNS = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"[0-9a-f]{24,}+",
    "private_key": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
    "git_token": r"gh[pousr]_[A-Za-z0-9]{36,}+",
    "chat_token": r"xox[abprs]-[A-Za-z0-9-]{10,}+",
    "web_token": r"eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+",
}
NEEDS = {"access": "AKIA", "private_key": "PRIVATE KEY-----", "git_token": "_", "chat_token": "xox", "web_token": "eyJ"}
LEAST_ASSIGNED = 6
LEDGER = f"blob string, rules string, spans array<{SPAN_TYPE}>"
RULES_VERSION = hashlib.sha256(repr((sorted(PATTERNS.items()), LEAST_ASSIGNED)).encode()).hexdigest()[:16]


def find_secrets(text: Column) -> Column:
    """Array of (kind, start, end, value, before, after) by start, then kind as listed."""
    empty = F.array().cast(f"array<{SPAN_TYPE}>")
    kinds = list(PATTERNS)
    found = {k: matches(text, k, p) for k, p in PATTERNS.items()}
    found["assign"] = F.filter(found["assign"], lambda s: F.length(F.regexp_extract(s["value"], PATTERNS["assign"], 1)) >= LEAST_ASSIGNED)
    found = {k: if_contains(text, NEEDS[k], s) if k in NEEDS else s for k, s in found.items()}
    rank = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(F.concat(empty, *found.values()), lambda s: F.struct(s["start"].alias("at"), F.array_position(rank, s["kind"]).alias("rank"), s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda x: x["span"])


def _blob(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def known(spark: SparkSession, ledger: str) -> DataFrame:
    """(blob, spans) of the ledger's entries at this version of the rules, one for each blob."""
    entries = spark.read.schema(LEDGER).parquet(ledger).filter(F.col("rules") == RULES_VERSION)
    return entries.groupBy("blob").agg(F.first("spans").alias("spans"))


def _placed(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns of ``docs`` by new names, and the place of each row: a hash of its file's path, and its number there.

    Rows that lie in no Parquet file are written to one.
    """
    columns = [F.col(f"`{c}`").alias(name) for name, c in names.items()]
    try:
        meta = docs.metadataColumn("_metadata")
        return docs.select(*columns, F.xxhash64(meta["file_path"]).alias("__file"), meta["row_index"].alias("__row"))
    except AnalysisException:
        return _placed(stash(docs.select(*columns), "versions"), {name: name for name in names})


def _bits(places: DataFrame) -> DataFrame:
    """(file, bucket, bits): places as bitmaps, of one bit for each row of a file; stored, some bytes for a thousand rows."""
    of = F.col("__row") + 1  # the functions count from 1
    return stash(places.groupBy("__file", F.bitmap_bucket_number(of).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(of)).alias("__bits")), "bits")


def _marked(placed: DataFrame, bits: DataFrame) -> DataFrame:
    """``placed`` with ``__set``: whether the bitmaps hold the row. They are broadcast if Spark finds them small enough, so that no text moves."""
    at = F.bitmap_bit_position(F.col("__row") + 1)
    byte = F.conv(F.hex(F.substring("__bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = placed.withColumn("__bucket", F.bitmap_bucket_number(F.col("__row") + 1)).join(bits, ["__file", "__bucket"], "left")
    return met.withColumn("__set", F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))).drop("__bits", "__bucket")


def _entered(placed: DataFrame, text_col: str, ledger: str, also: list[str]) -> DataFrame:
    """Scan what the ledger lacks and append it; gives (file, row, blob) of every row, and the columns ``also``."""
    spark, text = placed.sparkSession, F.col(f"`{text_col}`")
    places = stash(placed.select(*also, "__file", "__row", _blob(text).alias("__blob")), "places")
    first = places.groupBy("__blob").agg(F.min(F.struct("__file", "__row")).alias("__at"))
    if exists(spark, ledger):
        first = first.join(known(spark, ledger), F.col("__blob") == F.col("blob"), "left_anti")
    unseen = _marked(placed, _bits(first.select("__at.*"))).filter("__set")
    entries = unseen.select(_blob(text).alias("blob"), F.lit(RULES_VERSION).alias("rules"), find_secrets(F.coalesce(text, F.lit(""))).alias("spans"))
    entries.write.mode("append").parquet(ledger)
    return places


def scan(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, blob, spans) for every row of ``docs``, out of the ledger; ``ledger`` is the path of its table, kept between runs.

    Without a path the ledger starts empty, in the shared folder. A blob that the ledger has at ``RULES_VERSION`` isn't
    scanned again; a run that dies before its append leaves the ledger as it was, and the next run scans the same pairs.
    """
    spark, ledger = docs.sparkSession, ledger or fresh_path(docs.sparkSession, "secret-ledger")
    places = _entered(_placed(docs, {"__id": id_col, "__text": text_col}), "__text", ledger, ["__id"])
    found = known(spark, ledger).filter(F.size("spans") > 0).withColumnRenamed("blob", "__blob")
    rows = places.join(found, "__blob", "left")
    return rows.select(F.col("__id").alias(id_col), F.col("__blob").alias("blob"), F.coalesce("spans", F.array().cast(f"array<{SPAN_TYPE}>")).alias("spans"))


def redact_documents(docs: DataFrame, ledger: str | None = None, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with every secret of the ledger masked by its kind in the text; null texts stay null.

    Where a text changes, ``length_col`` is set to its new length. Rows without a secret stay where they stand; only the
    others meet the ledger.
    """
    spark, ledger = docs.sparkSession, ledger or fresh_path(docs.sparkSession, "secret-ledger")
    placed = _placed(docs, {c: c for c in docs.columns})
    places = _entered(placed, text_col, ledger, [])
    found = stash(known(spark, ledger).filter(F.size("spans") > 0).select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans")), "findings")
    marked = _marked(placed, _bits(places.join(found, "__blob", "left_semi").select("__file", "__row")))
    # Names of their own first: inside lambdas Spark would take a column of the same select for the one it reads.
    hit = marked.filter("__set").withColumn("__blob", _blob(F.col(f"`{text_col}`"))).join(found, "__blob").withColumn("__masked", redacted(F.col(f"`{text_col}`"), F.col("__spans")))
    out = {c: F.col(f"`{c}`") for c in docs.columns}
    clean = marked.filter("not __set").select(*[c.alias(name) for name, c in out.items()])
    out[text_col] = F.col("__masked")
    if length_col:
        out[length_col] = F.length("__masked").cast(docs.schema[length_col].dataType)
    return clean.unionByName(hit.select(*[c.alias(name) for name, c in out.items()]))


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    base = F.filter("spans", lambda s: s["kind"].isin(BASE_KINDS))
    return found.select(
        id_col,
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.encode(listed(base), "UTF-8"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every secret masked by its kind."""
    return masked(text, spans, "SECRET")
