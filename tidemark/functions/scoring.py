"""Scores as columns: confidence, utility, freshness, rerank, rubrics, cosine, hashed features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the confidence model, reliability of sources, penalties, rerank and rubric weights.
CONFIDENCE = {"intercept": -0.5, "explicit": 1.8, "repeated": 0.5, "corroborating": 0.6, "reliability": 1.2, "contradiction": -1.1, "uncertainty": -1.0, "age": -0.02}
RELIABILITY = {"explicit": 0.85, "correction": 0.8, "procedure": 0.7, "app_norm": 0.6}
OTHER_RELIABILITY = 0.5
PENALTY = {"privacy": 0.5, "contradiction": 0.6, "staleness": 0.3, "read": 0.2}
RERANK = {"fusion": 1.5, "namespace": 0.5, "confidence": 0.4, "freshness": 0.2, "contradiction": 0.6, "privacy": 0.3}
PERSONAL_RISK = 0.3
RUBRIC = {"task_outcome": 0.4, "memory_retrieval": 0.2, "memory_application": 0.2, "action_validity": 0.2}
SUCCESS_FROM = 0.999
DIM = 256
CHARS_PER_TOKEN = 4


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def sigmoid(x: Column) -> Column:
    return F.when(x < -60, 0.0).when(x > 60, 1.0).otherwise(1 / (1 + F.exp(-x)))


def confidence(explicit=0, repeated=0, corroborating=0, reliability=0.5, contradiction=0, uncertainty=0.3, age=0) -> Column:
    z = F.lit(CONFIDENCE["intercept"])
    for name, x in {"explicit": explicit, "repeated": repeated, "corroborating": corroborating, "reliability": reliability, "contradiction": contradiction, "uncertainty": uncertainty, "age": age}.items():
        z = z + CONFIDENCE[name] * num(x)
    return F.round(sigmoid(z), 4)


def reliability(source: Column) -> Column:
    out = F.when(F.lit(False), OTHER_RELIABILITY)
    for name, value in RELIABILITY.items():
        out = out.when(source == name, value)
    return out.otherwise(OTHER_RELIABILITY)


def candidate_confidence(source: Column, hint: Column, occurrences=1, corroborating=0, contradiction=0, age=0) -> Column:
    """Confidence of an extracted candidate; its hint is the inverse of the extractor's uncertainty."""
    return confidence(
        explicit=source.isin("explicit", "correction").cast("double"),
        repeated=F.greatest(F.lit(0.0), num(occurrences) - 1),
        corroborating=corroborating,
        reliability=reliability(source),
        contradiction=contradiction,
        uncertainty=F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(1 - hint, F.lit(0.4)))),
        age=age,
    )


def utility(p_useful=0.5, impact=0.5, privacy=0, contradiction=0, staleness=0, read=0) -> Column:
    worth = num(p_useful) * num(impact)
    for name, x in {"privacy": privacy, "contradiction": contradiction, "staleness": staleness, "read": read}.items():
        worth = worth - PENALTY[name] * num(x)
    return F.round(worth, 4)


def freshness(at: Column, now: Column) -> Column:
    """From 1 down to 0 over a year; the present is a parameter."""
    days = (F.unix_micros(now) - F.unix_micros(at)) / 86_400e6
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - days / 365))


def rerank(fusion: Column, prior: Column, conf: Column, fresh: Column, active: Column, acl: Column) -> Column:
    return (
        RERANK["fusion"] * fusion + RERANK["namespace"] * prior + RERANK["confidence"] * conf + RERANK["freshness"] * fresh
        - RERANK["contradiction"] * F.when(active, 0.0).otherwise(1.0) - RERANK["privacy"] * F.when(acl == "personal", PERSONAL_RISK).otherwise(0.0)
    )


def token_cost(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN).cast("int"))


def rubric_total(**axes: Column) -> Column:
    return F.round(sum((RUBRIC[k] * axes[k] for k in RUBRIC), F.lit(0.0)), 4)


def outcome_score(task_outcome: Column, action_validity: Column) -> Column:
    a, b = RUBRIC["task_outcome"], RUBRIC["action_validity"]
    return F.round((task_outcome * a + action_validity * b) / (a + b), 4)


def success(task_outcome: Column, action_validity: Column) -> Column:
    return (task_outcome >= SUCCESS_FROM) & (action_validity >= SUCCESS_FROM)


def retrieval_scores(claims: Column, expected: Column) -> Column:
    """(precision, recall) of claims against expected substrings, any case; without expectations both are 1."""
    low, subs = F.transform(claims, F.lower), F.transform(expected, F.lower)
    relevant = F.size(F.filter(low, lambda c: F.exists(subs, lambda s: F.contains(c, s))))
    covered = F.size(F.filter(subs, lambda s: F.exists(low, lambda c: F.contains(c, s))))
    most = F.least(F.size(low), F.size(subs))
    precision = F.when(most > 0, F.least(F.lit(1.0), relevant / F.nullif(most, F.lit(0)))).otherwise(0.0)
    empty = F.size(expected) == 0
    return F.struct(F.when(empty, 1.0).otherwise(F.round(precision, 4)).alias("precision"), F.when(empty, 1.0).otherwise(F.round(covered / F.nullif(F.size(subs), F.lit(0)), 4)).alias("recall"))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, 0.0).otherwise(F.round(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), 4))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for empty arrays, unequal lengths or a zero norm."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    product = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (product == 0), 0.0).otherwise(dot / F.nullif(product, F.lit(0.0)))


def text_features(tokens: Column) -> Column:
    """Tokens and pairs of neighbours."""
    pairs = F.when(F.size(tokens) > 1, F.zip_with(F.slice(tokens, F.lit(1), F.size(tokens) - 1), F.slice(tokens, F.lit(2), F.size(tokens) - 1), lambda a, b: F.concat_ws("_", a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(tokens, pairs)


def bucket(feature: Column, dim: int = DIM) -> Column:
    return (F.conv(F.substring(F.sha1(feature), 1, 8), 16, 10).cast("bigint") % dim).cast("int")


def sign(feature: Column) -> Column:
    return F.when(F.conv(F.substring(F.sha1(feature), 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
