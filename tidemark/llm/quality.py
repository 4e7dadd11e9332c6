"""Quality rules by cross-document line frequency, with DataFrame functions only.

Lines are normalised (lower case, single blanks, trimmed) and hashed. For each host and line the distinct documents
that hold it are counted; a document counts by the hash of its whole text, so that exact copies count once and every
different text counts, however much of it lies in shared lines. A line that more than a share of the host's documents
hold is boilerplate, at every size of host; a few documents at least must hold it, as chance alone makes two of them
share a line. The first holder of such a line, the one of the least id, keeps it, and all others lose it: so near copies,
whose lines are all frequent together, don't delete each other, and what only they say stays once. A document that keeps
too small a share of its characters is rejected, and the others lose such lines in ``kept_documents``. The rules on words
see the whole text.

Rows meet the boilerplate of their host as one list. Its length has a bound: a line in it stands in ``max_share`` of the
host's documents, so the list holds at most 1 / ``max_share`` times the lines of the host's average document.

Null texts count as empty. Null hosts are one host, and null ids come last. Equal texts of a host are judged alike, and repeated rows stay repeated. Texts of any
length are read whole, and each is one task's work. An empty table gives an empty result. Only the named columns are
read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stash

#: The white space between words, and the symbols that are counted.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[ \t-\r]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: A line is boilerplate if more than this share of a host's documents hold it, and so many at least.
MAX_SHARE, MIN_DOCS = 0.01, 5
#: A document is depleted if boilerplate leaves less than this share of its normalised characters.
MIN_LEFT = 0.3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_CLASS))


def _window_hashes(hashes: Column) -> Column:
    """One hash for each run of WINDOW words; the words' hashes come in."""
    starts = F.when(F.size(hashes) >= WINDOW, F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.element_at(hashes, i + k) for k in range(WINDOW)]))


def _covered(windows: Column) -> Column:
    """How many words lie in windows found twice or more: equal windows become neighbours in one sort."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twins(s: Column) -> Column:
        near = F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.array_sort(F.array_distinct(F.flatten(F.filter(near, lambda x: x.isNotNull()))))

    def reach(at: Column) -> Column:
        gaps = F.zip_with(F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at) - 1), lambda a, b: F.least(F.lit(WINDOW), b - a))
        return F.aggregate(gaps, F.lit(WINDOW), lambda acc, x: acc + x)

    return let(let(placed, twins), reach)


def _normal_lines(text: Column) -> Column:
    """(hash, characters) of each normalised line that has a word."""
    lines = F.split(F.lower(F.regexp_replace(text, r"[ \t\x0B\f\r]+", " ")), "\n")
    return F.transform(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("line"), F.length(x).cast("long").alias("n")))


def features(docs: DataFrame, id_col: str, text_col: str, host_col: str, carry: bool = False) -> DataFrame:
    """Row-local figures of every document; no shuffle. ``carry`` adds the row itself as a struct."""
    text = F.coalesce(docs[text_col], F.lit(""))
    whole = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if carry else []
    read = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[host_col]).alias("host"), text.alias("text"), *whole)
    hashes = F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))

    def judged(hs: Column) -> Column:
        return let(
            _window_hashes(hs),
            lambda ws: F.struct(
                F.size(hs).cast("long").alias("n_words"),
                F.when(F.size(F.array_distinct(ws)) < F.size(ws), _covered(ws)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
            ),
        )

    raw_lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return read.select(
        "id",
        "host",
        F.xxhash64("text").alias("text_hash"),
        let(hashes, judged).alias("w"),
        F.length(F.regexp_replace("text", BLANK_CLASS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        let(raw_lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _normal_lines(F.col("text")).alias("lines"),
        *read.columns[3:],
    ).select("id", "host", "text_hash", "w.*", "word_chars", "n_symbols", "n_dup_lines", "lines", *read.columns[3:]).withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    )


def frequent_lines(rows: DataFrame, max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS) -> DataFrame:
    """(host, gone): each host's boilerplate, as (hash of the line, hash of the text of its first holder), from rows (id, host, text_hash, lines).

    Different texts are counted. Of a line's holders the one of the least id is the first.
    """
    held = rows.select("id", "host", "text_hash", F.explode("lines.line").alias("line")).groupBy("host", "line", "text_hash").agg(F.min("id").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash"))["text_hash"]
    seen = held.groupBy("host", "line").agg(F.count("*").alias("docs"), first.alias("first")).filter(F.col("docs") >= min_docs)
    hosts = rows.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    return seen.join(hosts, "host").filter(F.col("docs") > max_share * F.col("host_docs")).groupBy("host").agg(F.collect_list(F.struct("line", "first")).alias("gone"))


def _judged(rows: DataFrame, max_share: float, min_docs: int, min_left: float) -> DataFrame:
    """``rows`` with the boilerplate that each is to lose (``own``), its characters, and the verdict."""
    gone = stash(frequent_lines(rows, max_share, min_docs), "boilerplate")
    chars = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    held = F.array_intersect("lines.line", "gone.line")
    theirs = F.transform(F.filter("gone", lambda g: g["first"] == F.col("text_hash")), lambda g: g["line"])
    own = F.coalesce(F.when(F.size(held) > 0, F.array_except(held, theirs)), F.array().cast("array<bigint>"))
    lost = F.when(F.size("own") > 0, chars(F.filter("lines", lambda x: F.array_contains("own", x["line"])))).otherwise(F.lit(0).cast("long"))
    left = 1 - F.col("boilerplate_chars") / F.col("line_chars")
    met = rows.join(gone, "host", "left").withColumn("own", own).withColumn("line_chars", chars(F.col("lines"))).withColumn("boilerplate_chars", lost)
    return met.withColumn("kept", ~F.col("base_failed") & ((F.col("boilerplate_chars") == 0) | (left >= min_left)))


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per document: its figures, ``line_chars``, ``boilerplate_chars``, ``base_failed`` and ``kept``."""
    rows = stash(features(docs, id_col, text_col, host_col), "quality")
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "line_chars", "boilerplate_chars", "kept"]
    return _judged(rows, max_share, min_docs, min_left).select(F.col("id").alias(id_col), "text_hash", *figures)


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT, length_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, without boilerplate lines; ``length_col`` follows a changed text.

    Rows are written down once beside their figures and lines, so each is judged and cut by itself once it knows the
    boilerplate of its host.
    """
    rows = stash(features(docs, id_col, text_col, host_col, carry=True), "quality")
    held = _judged(rows, max_share, min_docs, min_left).filter("kept")
    cut = F.when(F.size("own") > 0, without_boilerplate(F.col("row")[text_col], F.col("own"))).otherwise(F.col("row")[text_col])
    out = {c: F.col("row")[c] for c in docs.columns} | {text_col: cut}
    if length_col:
        out[length_col] = F.when(F.size("own") > 0, F.length(cut).cast(docs.schema[length_col].dataType)).otherwise(out[length_col])
    return held.select(*[out[c].alias(c) for c in docs.columns])


def without_boilerplate(text: Column, lines: Column) -> Column:
    """``text`` without the lines whose normalised hash is in the array ``lines``; a null array removes none."""
    normal = lambda x: F.xxhash64(F.lower(F.trim(F.regexp_replace(x, r"[ \t\x0B\f\r]+", " "))))
    return F.when(lines.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(lines, normal(x))), "\n"))
