"""Queries without SQL over all rows of a table, against plain Python."""

import pytest

from tidemark.operators import evals, learn
from tidemark.plans import queries


def test_usefulness_model_fits_on_all_items(spark, tmp_path):
    rows = [(c, t, ("user", "assistant", "system")[(c + t) % 3], f"text {c} {t}") for c in range(40) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    examples = []
    for c, t, role, _ in rows:
        n = c * 1000 + t
        kind, space = ("procedural", "user") if role == "user" else ("semantic", "team" if role == "assistant" else "project")
        examples.append(({f"type={kind}": 1.0, f"ns={space}": 1.0, "confidence": 0.5 + n % 50 / 100, "inv_rank": 1 / (n % 7 + 1)}, float(n % 5 != 0)))
    bias, weights = learn.fit_logistic(examples, 0.1, 20)
    got = {r["feature"]: r["weight"] for r in queries.QUERIES["usefulness_model"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx({"": bias, **weights}, abs=1e-6)


def test_bootstrap_ci_takes_the_published_iterations(spark, sf):
    deltas = queries._paired(spark, sf).select("task_id", "delta").toPandas().sort_values("task_id")["delta"].to_numpy(float)
    row = queries.QUERIES["bootstrap_ci"](spark, sf).first()
    estimate, low, high = evals.bootstrap_interval(deltas, iterations=2000)
    assert (row["estimate"], row["low"], row["high"]) == (round(estimate, 4), round(low, 4), round(high, 4))
    assert (low, high) != evals.bootstrap_interval(deltas, iterations=200)[1:]
