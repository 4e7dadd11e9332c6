"""Small models fitted by gradient steps in a fixed order."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import tokens


def _sigmoid(x: float) -> float:
    return 0.0 if x < -60 else 1.0 if x > 60 else 1 / (1 + math.exp(-x))


def fit_logistic(rows: list[tuple[dict[str, float], float]], rate: float, epochs: int) -> tuple[float, dict[str, float]]:
    """(bias, weights) after passes over (features, target) in the given order, one step a row."""
    bias, weights = 0.0, {}
    for _ in range(epochs):
        for features, target in rows:
            error = _sigmoid(bias + sum(weights.get(k, 0.0) * v for k, v in features.items())) - target
            bias -= rate * error
            for k, v in features.items():
                weights[k] = weights.get(k, 0.0) - rate * error * v
    return bias, weights


MODEL = "model string, feature string, weight double"


def _model(name: str, bias: float, weights: dict[str, float]) -> pd.DataFrame:
    return pd.DataFrame([(name, "", bias), *((name, k, w) for k, w in sorted(weights.items()))], columns=["model", "feature", "weight"])


def fit_usefulness(examples: DataFrame, rate: float = 0.1, epochs: int = 20) -> DataFrame:
    """(model, feature, weight) from (ord, type, namespace, confidence, rank, helped); the empty feature is the bias.

    The steps depend on each other, so the examples of one model are one task's work: feedback on retrievals, not a corpus.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [({f"type={r.type}": 1.0, f"ns={r.namespace}": 1.0, "confidence": float(r.confidence), "inv_rank": 1.0 / (r.rank + 1)}, 1.0 if r.helped else 0.0) for r in pdf.sort_values("ord").itertuples()]
        return _model("usefulness", *fit_logistic(rows, rate, epochs))

    return examples.groupBy(F.lit(1).alias("one")).applyInPandas(fit, MODEL)


def fit_router(examples: DataFrame, namespaces: list[str], rate: float = 0.2, epochs: int = 30) -> DataFrame:
    """(model, feature, weight) from (ord, query, namespace): a model for each namespace, each in a task of its own."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        name, rows = pdf["model"].iloc[0], []
        for r in pdf.sort_values("ord").itertuples():
            counts: dict[str, float] = {}
            for t in r.words:
                counts[t] = counts.get(t, 0.0) + 1.0
            rows.append((counts, 1.0 if r.namespace == name else 0.0))
        return _model(name, *fit_logistic(rows, rate, epochs))

    each = examples.select("ord", tokens(F.col("query")).alias("words"), "namespace", F.explode(F.array(*[F.lit(n) for n in namespaces])).alias("model"))
    return each.groupBy("model").applyInPandas(fit, MODEL)


def predict(features: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """(key, model, p) from (key, feature, value): a join with the weights and one aggregate."""
    bias = model.filter("feature = ''").select("model", F.col("weight").alias("bias"))
    z = features.join(model.filter("feature <> ''"), "feature").groupBy(key, "model").agg(F.sum(F.col("value") * F.col("weight")).alias("z"))
    return features.select(key).distinct().crossJoin(F.broadcast(bias)).join(z, [key, "model"], "left").select(key, "model", (1 / (1 + F.exp(-(F.col("bias") + F.coalesce("z", F.lit(0.0)))))).alias("p"))
