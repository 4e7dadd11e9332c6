"""Text functions: tokens, patterns of statements, redaction, routing, themes, markdown."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of statements worth remembering, case-insensitive.
PREFERENCE = [r"\bi (?:prefer|like|want|always|never)\b", r"\b(?:please )?remember (?:that|to)\b", r"\bgoing forward\b", r"\bfrom now on\b"]
NORM = [r"\bwe (?:always|never|use|announce|name)\b", r"\b(?:the )?convention is\b", r"\bnaming convention\b", r"\bformat\b.*\bis\b"]
CORRECTION = [r"\b(?:actually|no,|that's wrong|not quite|instead)\b", r"\bshould (?:have|be)\b"]
NEGATION = r"\b(?:not|never|no longer|avoid|don't|do not|stop)\b"
# Redaction rules (name, pattern, placeholder), in the order in which they apply.
REDACTIONS = [
    ("api_key", r"\b(?:sk-[A-Za-z0-9]{16,}|xox[baprs]-[A-Za-z0-9-]{8,}|ghp_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16})\b", "[REDACTED_SECRET]"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED_EMAIL]"),
    ("credit_card", r"\b(?:\d[ -]*?){13,16}\b", "[REDACTED_CARD]"),
    ("phone", r"\b(?:\+?\d{1,3}[ .-]?)?(?:\(?\d{3}\)?[ .-]?)\d{3}[ .-]?\d{4}\b", "[REDACTED_PHONE]"),
]
SENSITIVE_KEYS = ["password", "secret", "authorization", "token"]
# Cues of each namespace, and the weight of a hit; every namespace starts at BASE_WEIGHT.
ROUTES = {
    "user": (r"\b(?:my|i|me|mine|prefer|preference)\b", 0.6),
    "team": (r"\b(?:we|team|our|norm|convention|announce|policy)\b", 0.6),
    "project": (r"\b(?:project|launch|milestone|roadmap|release)\b", 0.6),
    "app_state": (r"\b(?:channel|calendar|event|document|doc|meeting|schedule)\b", 0.4),
}
BASE_WEIGHT = 0.1
# Words that carry no topic.
OVERLAP_STOP = ["not", "never", "no", "longer", "avoid", "don", "do", "stop", "t", "the", "a", "to", "is", "and"]
THEME_STOP = ["the", "a", "an", "to", "i", "my", "in", "on", "and", "is", "of", "please", "that"]
FOLDERS = {"user": "people", "project": "projects", "team": "norms"}


def either(patterns: list[str]) -> str:
    return "(?i)(?:" + "|".join(patterns) + ")"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def states_preference(text: Column) -> Column:
    return text.rlike(either(PREFERENCE))


def states_norm(text: Column) -> Column:
    return text.rlike(either(NORM))


def corrects(text: Column) -> Column:
    return text.rlike(either(CORRECTION))


def positive(text: Column) -> Column:
    """Polarity: no negation cue."""
    return ~text.rlike(f"(?i){NEGATION}")


def topic_tokens(text: Column) -> Column:
    return F.array_except(tokens(text), F.array(*[F.lit(w) for w in OVERLAP_STOP]))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def redacted(text: Column) -> Column:
    for _, pattern, placeholder in REDACTIONS:
        text = F.regexp_replace(text, pattern, placeholder)
    return text


def redaction_hits(text: Column) -> Column:
    """Names of the rules that apply, each asked of the text that the rules before it have left, sorted."""
    hits = []
    for name, pattern, placeholder in REDACTIONS:
        hits.append(F.when(text.rlike(pattern), F.lit(name)))
        text = F.regexp_replace(text, pattern, placeholder)
    return F.array_sort(F.array_compact(F.array(*hits)))


_RULES = [(n, re.compile(p), r) for n, p, r in REDACTIONS]


def redact_value(value, keys: list[str] | None = None):
    """(redacted copy, names of rules) of a JSON value of any depth; booleans stay."""
    secret, hits = {k.lower() for k in (SENSITIVE_KEYS if keys is None else keys)}, set()
    whole = [value]
    open_places: list[tuple[list | dict, object, str]] = [(whole, 0, "")]  # where a value stands, and the key it stands under
    while open_places:
        holder, at, key = open_places.pop()
        x = holder[at]
        if key.lower() in secret:
            hits.add(f"key:{key.lower()}")
            holder[at] = "[REDACTED]"
        elif isinstance(x, (dict, list)):
            holder[at] = copy = x.copy()
            open_places += [(copy, k, k) for k in copy] if isinstance(x, dict) else [(copy, k, "") for k in range(len(copy))]
        elif x is not None and not isinstance(x, bool):
            said = str(x)
            for name, pattern, placeholder in _RULES:
                said, n = pattern.subn(placeholder, said)
                hits |= {name} if n else set()
            if said != str(x):
                holder[at] = said
    return whole[0], hits


@F.pandas_udf(T.StructType().add("json", "string").add("hits", T.ArrayType(T.StringType())))
def redact_json(raw: pd.Series) -> pd.DataFrame:
    """JSON text of any depth, redacted, and the rules that applied; text that is no JSON is redacted as text."""

    def one(x):
        if x is None:
            return None, []
        try:
            value, hits = redact_value(json.loads(x))
            return json.dumps(value, ensure_ascii=False), sorted(hits)
        except ValueError:
            value, hits = redact_value(x)
            return value, sorted(hits)

    return pd.DataFrame([one(x) for x in raw], columns=["json", "hits"])


@F.pandas_udf(T.StructType().add("args", T.MapType(T.StringType(), T.StringType())).add("hits", T.ArrayType(T.StringType())))
def redact_args(raw: pd.Series) -> pd.DataFrame:
    """A call's arguments, given as a JSON object of texts, redacted by key and text; values that hold JSON are redacted at any depth."""

    def inner(v):
        if isinstance(v, str) and v.lstrip()[:1] in ("{", "["):
            try:
                return json.loads(v)
            except ValueError:
                return v
        return v

    def one(x):
        if x is None:
            return None, []
        given = json.loads(x)
        value, hits = redact_value({k: inner(v) for k, v in given.items()})
        same = lambda k: given[k] if value[k] == inner(given[k]) else value[k] if isinstance(value[k], str) else json.dumps(value[k], ensure_ascii=False)
        return {k: same(k) for k in given}, sorted(hits)

    return pd.DataFrame([one(x) for x in raw], columns=["args", "hits"])


def route(query: Column) -> Column:
    """Weight of each namespace, adding up to one, as a struct."""
    raw = {ns: BASE_WEIGHT + weight * F.size(F.regexp_extract_all(query, F.lit(f"(?i){cue}"), F.lit(0))) for ns, (cue, weight) in ROUTES.items()}
    total = raw["user"] + raw["team"] + raw["project"] + raw["app_state"]
    return F.struct(*[(w / total).alias(ns) for ns, w in raw.items()])


def top_routes(query: Column, n: int) -> Column:
    """The n namespaces of most weight, in the order of ROUTES where weights are equal."""
    weights = route(query)
    ranked = F.array_sort(F.array(*[F.struct((-weights[ns]).alias("w"), F.lit(k).alias("k"), F.lit(ns).alias("ns")) for k, ns in enumerate(ROUTES)]))
    return F.transform(F.slice(ranked, 1, n), lambda x: x["ns"])


def theme(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(THEME_STOP))
    joined = F.array_join(F.slice(F.array_sort(F.array_distinct(kept)), 1, 3), " ")
    return F.when(joined == "", "general").otherwise(joined)


def slug(text: Column) -> Column:
    s = F.btrim(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", "item").otherwise(s)


def path_for(kind: Column, namespace: Column, subject: Column) -> Column:
    """File of the knowledge base for an item: procedures by kind, the rest by namespace, one file a subject."""
    folder = F.when(kind == "procedural", "procedures")
    for ns, name in FOLDERS.items():
        folder = folder.when(namespace == ns, name)
    return F.concat(folder.otherwise("timeline"), F.lit("/"), slug(F.coalesce(subject, F.lit("general"))), F.lit(".md"))


def front_matter(document: Column) -> Column:
    """(matter, body) of a markdown document; no matter gives an empty one."""
    pattern = r"(?s)^---\n(.*?)\n---\n?(.*)$"
    has = document.rlike(pattern)
    return F.struct(F.when(has, F.regexp_extract(document, pattern, 1)).otherwise("").alias("matter"), F.btrim(F.when(has, F.regexp_extract(document, pattern, 2)).otherwise(document), F.lit(" \n\t\r")).alias("body"))


def render_document(matter: Column, body: Column) -> Column:
    return F.concat(F.lit("---\n"), matter, F.lit("\n---\n\n"), F.btrim(body, F.lit(" \n\t\r")), F.lit("\n"))


def parse_score(text: Column) -> Column:
    """A judge's score in free text: ``x/10``, else the first number from 0 to 1; null otherwise."""
    tenth = F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*/\s*10\b", 1)
    plain = F.regexp_extract(text, r"(?<![\d.])(\d*\.?\d+)(?![\d])", 1)
    value = F.when(tenth != "", tenth.try_cast("double") / 10).otherwise(plain.try_cast("double"))
    return F.when(value.between(0, 1), value)
