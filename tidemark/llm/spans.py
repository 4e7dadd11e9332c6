"""Spans of regular expressions inside texts, with DataFrame functions only.

Spark gives matches but not their places; a split by the same expression gives the text between them, so a running
sum of lengths gives every match's start and end in code points. Both walk the text once. Running sums and masked
texts are put together in chunks: a text with many matches costs about CHUNK steps for each, not one for each pair.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.llm.quality import let

SPAN_TYPE = "struct<kind:string,start:int,end:int,value:string,before:string,after:string>"
#: How many characters on either side of a match are kept as its context; they end where another match of the kind is.
CONTEXT = 48
#: Entries that are put together at a time.
CHUNK = 256


def _chunks(n: Column) -> Column:
    """Numbers of the chunks of ``n`` entries, from 0; n is 1 at least."""
    return F.sequence(F.lit(0), F.ceil(n / CHUNK).cast("int") - 1)


def _chunk(values: Column, k: Column) -> Column:
    return F.slice(values, k * CHUNK + 1, F.lit(CHUNK))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """What ``op`` makes of each beginning of an array of whole numbers, which has an entry at least."""

    def walk(part: Column) -> Column:
        step = lambda acc, x: F.concat(acc, F.array(F.coalesce(op(F.get(acc, F.size(acc) - 1), x), x)))
        return F.aggregate(part, F.array().cast("array<int>"), step)

    def joined(inner: Column) -> Column:
        ahead = walk(F.transform(inner, lambda c: F.element_at(c, -1)))
        return let(ahead, lambda a: F.flatten(F.transform(inner, lambda c, k: F.when(k == 0, c).otherwise(F.transform(c, lambda x: op(F.get(a, k - 1), x))))))

    return let(F.transform(_chunks(F.size(values)), lambda k: walk(_chunk(values, k))), joined)


def matches(text: Column, kind: str, pattern: str) -> Column:
    """Array of (kind, start, end, value, before, after) of the leftmost non-overlapping matches; the last two are nearby text."""
    empty = F.array().cast(f"array<{SPAN_TYPE}>")

    def placed(found: Column, gaps: Column) -> Column:
        n = F.size(found)
        ends = running(F.zip_with(found, F.slice(gaps, F.lit(1), n), lambda v, g: F.length(v) + F.length(g)), lambda a, b: a + b)
        near = F.zip_with(F.slice(gaps, F.lit(1), n), F.slice(gaps, F.lit(2), n), lambda b, a: F.struct(F.right(b, F.lit(CONTEXT)).alias("before"), F.left(a, F.lit(CONTEXT)).alias("after")))
        at = F.zip_with(found, ends, lambda v, e: F.struct(F.lit(kind).alias("kind"), (e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))
        return F.zip_with(at, near, lambda x, c: F.struct(x["kind"], x["start"], x["end"], x["value"], c["before"], c["after"]))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda gaps: placed(found, gaps))).otherwise(empty))


def if_contains(text: Column, needle: str, spans: Column) -> Column:
    """``spans`` where the text holds a string that every match needs, else none: a byte search is cheaper than a match."""
    return F.when(F.contains(text, F.lit(needle)), spans).otherwise(F.array().cast(f"array<{SPAN_TYPE}>"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    doubled = F.transform(F.split(F.reverse(digits(value)), ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(F.transform(doubled, lambda x: F.when(x > 9, x - 9).otherwise(x)), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number passes the mod-97 check: first four characters last, letters as 10 to 35, remainder 1."""
    plain = F.regexp_replace(value, " ", "")
    turned = let(plain, lambda p: F.concat(F.substr(p, F.lit(5)), F.left(p, F.lit(4))))
    code = lambda c: F.ascii(c)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(code(c) < 58, (a * 10 + code(c) - 48) % 97).otherwise((a * 100 + code(c) - 55) % 97)) == 1


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with every span replaced by ``mask`` and its kind; overlapping spans are masked as one, by the first's kind."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def between(s: Column, ends: Column) -> Column:
        """(where the text before a mask begins, where it ends, kind) of each span that begins behind those before it."""
        behind = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
        pairs = F.zip_with(s, behind, lambda x, at: F.struct(at.alias("at"), x["start"].alias("to"), x["kind"].alias("kind")))
        return F.filter(pairs, lambda p: p["to"] >= p["at"])

    def written(part: Column) -> Column:
        first, last = F.element_at(part, 1)["at"], F.element_at(part, -1)["to"]
        body = F.substr(text, first + 1, last - first)  # a chunk's own text first, so that its pieces are found in a short one
        return let(body, lambda b: F.array_join(F.transform(part, lambda p: F.concat(F.substr(b, p["at"] - first + 1, p["to"] - p["at"]), F.lit(f"[{mask}:"), p["kind"], F.lit("]"))), ""))

    def whole(s: Column) -> Column:
        return let(
            running(F.transform(s, lambda x: x["end"]), F.greatest),
            lambda ends: F.concat(
                let(between(s, ends), lambda ps: F.array_join(F.transform(_chunks(F.size(ps)), lambda k: let(_chunk(ps, k), written)), "")),
                F.substr(text, F.element_at(ends, -1) + 1),
            ),
        )

    return F.when(F.size(spans) > 0, let(ordered, whole)).otherwise(text)
