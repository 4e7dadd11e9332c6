"""Personal data, with DataFrame functions only: expressions propose, checksums confirm, nearby words adjust the score.

Every span has a kind, a place in code points (end exclusive), its value and a score in hundredths. Words that speak
for a kind or against it count on both sides of a span, up to the next match of the kind. Spans of the four base kinds
that pass their check always stay; spans of the other kinds stay from ``MIN_SCORE`` on. Null texts count as empty;
repeated rows stay repeated; texts are read whole, also with very many matches; only the id and the text are read, so
other columns may have any name. An empty table gives an empty result.

The patterns are the plain ones with two changes that keep the matches and bound the time on long runs: possessive
repeats, and a start only where the run of characters starts or the last match ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.spans import digits, if_contains, listed, luhn, masked, matches, mod97

#: Kinds in the order of reports, and their patterns.
BASE_KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])",
    "ssn": r"[0-9-]{11,}+",
}
BYTE = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"
SSN = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"
#: Hundredths of a proposal, of a confirmed checksum, and of words nearby that speak for it or against it.
PROPOSED = {"email": 80, "ip": 60, "card": 40, "phone": 50, "iban": 40, "ssn": 30}
CONFIRMED = {"card": 40, "iban": 30}
NEARBY = 30
FOR = {
    "email": r"(?i)(?:mail|contact|write)",
    "ip": r"(?i)(?:(?:^|[^a-z])ip(?:[^a-z]|$)|address|host|server)",
    "card": r"(?i)(?:card|visa|credit|payment)",
    "phone": r"(?i)(?:phone|call|tel|mobile|fax)",
    "iban": r"(?i)(?:iban|account|bank)",
    "ssn": r"(?i)(?:ssn|social security)",
}
AGAINST = r"(?i)(?:version|isbn|order|serial|build)"
MIN_SCORE = 60


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: p.rlike(BYTE))
    if kind == "card":
        return F.length(digits(v)).between(16, 19) & luhn(v)
    if kind == "phone":
        return F.length(digits(v)).between(8, 15)
    if kind == "iban":
        return mod97(v)
    if kind == "ssn":
        return v.rlike(SSN)
    return F.lit(True)


def _scored(spans: Column, kind: str) -> Column:
    def score(s: Column) -> Column:
        says = lambda pattern: F.when(s["before"].rlike(pattern) | s["after"].rlike(pattern), NEARBY).otherwise(0)
        return F.least(F.lit(PROPOSED[kind] + CONFIRMED.get(kind, 0)) + says(FOR[kind]) - says(AGAINST), F.lit(100))

    valid = F.filter(spans, lambda s: _valid(kind, s["value"]))
    out = F.transform(valid, lambda s: F.struct(s["kind"], s["start"], s["end"], s["value"], score(s).alias("score")))
    return out if kind in BASE_KINDS else F.filter(out, lambda s: s["score"] >= MIN_SCORE)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one array of spans for each kind): spans are (kind, start, end, value, score), by start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    needs = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
    found = {k: matches(text, k, p) for k, p in PATTERNS.items()}
    found = {k: if_contains(text, needs[k], s) if k in needs else s for k, s in found.items()}
    return docs.select(F.col(id_col), *[_scored(s, k).alias(k) for k, s in found.items()])


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, span lists and scores of what ``find_personal_data`` gives."""
    lists = lambda kinds: F.concat(*[F.col(k) for k in kinds])
    return found.select(
        id_col,
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.encode(listed(lists(BASE_KINDS)), "UTF-8"), 256).alias("base_sha256"),
        listed(lists(PATTERNS)).alias("spans"),
        F.array_join(F.transform(lists(PATTERNS), lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def redacted(text: Column, *kinds: Column) -> Column:
    """``text`` with the spans of the given arrays masked by their kind."""
    return masked(text, F.concat(*kinds), "PII")
