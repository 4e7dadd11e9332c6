"""Evaluation: judging writes, paired comparison, intervals, rank tests, agreement, mining of tasks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scoring, text
from tidemark.tables import carried, range_dealt

LCG_A, LCG_C, LCG_MASK, LCG_SEED = 1103515245, 12345, 0x7FFFFFFF, 12345
SLICE_DRAWS = 1 << 20


def field_matches(value: Column, expected: Column, contains: Column) -> Column:
    """Whether a write's field is as expected: equal, or holding a substring in any case; of a list (as JSON) any entry may."""
    holds = lambda v: F.contains(F.lower(v), F.lower(expected))
    entries = F.from_json(value, "array<string>")
    listed = F.startswith(F.ltrim(value), F.lit("[")) & entries.isNotNull()
    return F.when(contains, F.when(listed, F.exists(entries, holds)).otherwise(holds(value))).otherwise(value == expected)


def judge(tasks: DataFrame, writes: DataFrame, claims: DataFrame) -> DataFrame:
    """Rubric of each (task_id, condition).

    ``tasks``: task_id, expected (array of app, action, fields: array of name, value, contains), forbidden, max_writes,
    memory_expected. ``writes``: task_id, condition, writes (array of app, action, fields map). ``claims``: task_id,
    condition, claims.
    """
    both = tasks.join(writes, "task_id").join(claims, ["task_id", "condition"], "left")
    made = lambda e: F.exists("writes", lambda w: (w["app"] == e["app"]) & (w["action"] == e["action"]) & F.forall(e["fields"], lambda f: F.coalesce(field_matches(w["fields"][f["name"]], f["value"], f["contains"]), F.lit(False))))
    n = F.size("expected")
    outcome = F.when(n == 0, 1.0).otherwise(F.size(F.filter("expected", made)) / F.nullif(n, F.lit(0)))
    forbidden = F.exists("writes", lambda w: F.array_contains(F.col("forbidden"), w["action"]))
    validity = F.when(forbidden, 0.0).when(F.col("max_writes").isNotNull() & (F.size("writes") > F.col("max_writes")), 0.5).otherwise(1.0)
    scored = both.withColumn("r", scoring.retrieval_scores(F.coalesce("claims", F.array().cast("array<string>")), F.col("memory_expected")))
    return scored.select("task_id", "condition", outcome.alias("task_outcome"), validity.alias("action_validity"), scoring.f1(F.col("r.precision"), F.col("r.recall")).alias("memory_retrieval"), outcome.alias("memory_application")).withColumn(
        "total", scoring.rubric_total(task_outcome=F.col("task_outcome"), memory_retrieval=F.col("memory_retrieval"), memory_application=F.col("memory_application"), action_validity=F.col("action_validity"))
    ).withColumn("outcome_score", scoring.outcome_score(F.col("task_outcome"), F.col("action_validity"))).withColumn("success", scoring.success(F.col("task_outcome"), F.col("action_validity")))


def paired_deltas(scores: DataFrame, key: str, condition: str, score: str, base: str, treated: str) -> DataFrame:
    """(key, base, treated, delta): one aggregate, no self-join."""
    at = lambda c: F.max(F.when(F.col(condition) == c, F.col(score)))
    return scores.groupBy(key).agg(at(base).alias("base"), at(treated).alias("treated")).withColumn("delta", F.round(F.col("treated") - F.col("base"), 4))


def win_rate(deltas: DataFrame, delta: str = "delta") -> DataFrame:
    return deltas.agg(F.round(F.avg(F.when(F.col(delta) > 0, 1.0).otherwise(0.0)), 4).alias("win_rate"), F.round(F.avg(delta), 4).alias("mean_delta"), F.count(delta).alias("n"))


def _lcg_states(start: int, count: int) -> np.ndarray:
    """The next ``count`` states after ``start``: the affine step is composed with itself by doubling, so no loop over draws."""
    out = np.empty(count, np.uint64)
    if count:
        out[0] = (LCG_A * start + LCG_C) & LCG_MASK
        a, c, n = LCG_A, LCG_C, 1
        while n < count:
            m = min(n, count - n)
            out[n : n + m] = (out[:m] * np.uint64(a) + np.uint64(c)) & np.uint64(LCG_MASK)
            a, c, n = (a * a) & LCG_MASK, (a * c + c) & LCG_MASK, n + m
    return out


def bootstrap_interval(values: np.ndarray, level: float = 0.95, iterations: int = 2000, seed: int = LCG_SEED) -> tuple[float, float, float]:
    """(estimate, low, high) of the mean, from the stated generator; draws are made in slices."""
    n = len(values)
    if n == 0:
        return 0.0, 0.0, 0.0
    if n == 1:
        return float(values[0]), float(values[0]), float(values[0])
    state, means, rows = seed & 0xFFFFFFFF, [], max(1, SLICE_DRAWS // n)
    for a in range(0, iterations, rows):
        m = min(rows, iterations - a)
        drawn = _lcg_states(state, m * n)
        state = int(drawn[-1])
        means.append(values[(drawn % np.uint64(n)).astype(np.int64)].reshape(m, n).sum(1) / n)
    spread = np.sort(np.concatenate(means))
    alpha = (1 - level) / 2
    return float(values.mean()), float(np.quantile(spread, alpha)), float(np.quantile(spread, 1 - alpha))


def bootstrap(values: DataFrame, group: str, order: str, value: str, **options) -> DataFrame:
    """(group, estimate, low, high): an interval for each group's mean. Groups are the deltas of one evaluation, and small."""

    def interval(pdf: pd.DataFrame) -> pd.DataFrame:
        estimate, low, high = bootstrap_interval(pdf.sort_values("o")["v"].to_numpy(float), **options)
        return pd.DataFrame([(pdf["g"].iloc[0], round(estimate, 4), round(low, 4), round(high, 4))], columns=["g", "estimate", "low", "high"])

    kind = dict(values.dtypes)[group]
    picked = values.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    return picked.groupBy("g").applyInPandas(interval, f"g {kind}, estimate double, low double, high double").withColumnRenamed("g", group)


def win_rate_interval(deltas: DataFrame, group: str, order: str, delta: str = "delta", **options) -> DataFrame:
    """(group, estimate, low, high): the same interval of the share of wins."""
    return bootstrap(deltas.withColumn("__won", F.when(F.col(delta) > 0, 1.0).otherwise(0.0)), group, order, "__won", **options)


def percentiles(values: DataFrame, value: str, qs: list[float], by: list[str]) -> DataFrame:
    """Exact percentiles with linear interpolation, by distributed selection: null values don't count.

    Equal values of a group are counted first. Values are dealt by ranges of (group, value), a range's ranks begin behind
    the count of what its group has in all ranges before it, and only the values that hold a wanted rank go on. A group
    may lie in many ranges, so no task and no buffer has all its values.
    """
    each = values.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    dealt = range_dealt(each, *by, "__v")
    parts = dealt.groupBy(*by, "pid").agg(F.sum("__n").alias("__own"))
    line, group = Window.partitionBy(*by).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    bases = parts.select(*by, "pid", F.coalesce(F.sum("__own").over(line), F.lit(0)).alias("__base"), F.sum("__own").over(group).alias("__all"))  # rows: ranges, and groups
    same = F.lit(True)
    for c in ["pid", *by]:
        same = same & dealt[c].eqNullSafe(bases[c])
    inside = Window.partitionBy(dealt["pid"], *[dealt[c] for c in by]).orderBy("__v")
    ranked = dealt.join(bases, same).select(*[dealt[c] for c in by], "__v", "__n", "__all", (F.col("__base") + F.sum("__n").over(inside) - F.col("__n")).alias("__first"))
    at = {q: F.lit(q) * (F.col("__all") - 1) for q in qs}
    holds = lambda rank: (F.col("__first") <= rank) & (rank < F.col("__first") + F.col("__n"))
    picked = ranked.groupBy(*by).agg(F.first("__all").alias("__all"), *[F.max(F.when(holds(f(at[q])), F.col("__v"))).alias(f"__{name}{k}") for k, q in enumerate(qs) for name, f in (("lo", F.floor), ("hi", F.ceil))])
    between = lambda k, q: F.col(f"__lo{k}") + (F.col(f"__hi{k}") - F.col(f"__lo{k}")) * (at[q] - F.floor(at[q]))
    return picked.select(*by, *[F.round(between(k, q), 4).alias(f"p{round(q * 100)}") for k, q in enumerate(qs)])


def wilcoxon(deltas: DataFrame, delta: str = "delta") -> DataFrame:
    """(statistic, n, z): signed ranks with average ranks for ties, zeros dropped, normal approximation.

    Ties are counted first, so equal sizes cost one row. Sizes are dealt by ranges, and a range's ranks begin behind the
    count of all ranges before it.
    """
    sizes = deltas.filter(F.col(delta) != 0).groupBy(F.abs(delta).alias("size")).agg(F.sum(F.when(F.col(delta) > 0, 1).otherwise(0)).alias("up"), F.count("*").alias("n"))
    dealt = range_dealt(sizes, "size")
    before = F.col("base") + F.coalesce(F.sum("n").over(Window.partitionBy("pid").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = dealt.join(F.broadcast(carried(dealt, base=F.col("n"))), "pid").withColumn("rank", before + (F.col("n") + 1) / 2)  # a row a partition
    sums = ranked.agg(F.sum(F.col("rank") * F.col("up")).alias("plus"), F.sum(F.col("rank") * (F.col("n") - F.col("up"))).alias("minus"), F.sum("n").alias("n"))
    n = F.col("n")
    return sums.select(F.least("plus", "minus").alias("statistic"), "n", F.round((F.least("plus", "minus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24), 6).alias("z"))


def normal_p(z: float) -> float:
    """Two-sided p-value of a normal score."""
    return round(max(0.0, min(1.0, 2 * (1 - 0.5 * (1 + math.erf(abs(z) / math.sqrt(2)))))), 4)


def kappa(rated: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters, from one table of counts."""
    cells = rated.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    margins = cells.select(F.col("a").alias("label"), F.col("n").alias("na"), F.lit(0).alias("nb")).union(cells.select(F.col("b"), F.lit(0), F.col("n"))).groupBy("label").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    seen = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    chance = margins.agg(F.sum(F.col("na") * F.col("nb")).alias("cross"))
    observed, expected = F.col("same") / F.col("n"), F.col("cross") / (F.col("n") * F.col("n"))
    return seen.crossJoin(chance).select(F.when(expected == 1, 1.0).otherwise(F.round((observed - expected) / F.nullif(1 - expected, F.lit(0.0)), 4)).alias("kappa"), "n")


def double_score(first: DataFrame, second: DataFrame, key: str, score: str, cut: float = 0.5) -> DataFrame:
    """Agreement of two judges that scored the same tasks, after a cut."""
    both = first.select(key, (F.col(score) >= cut).alias("a")).join(second.select(key, (F.col(score) >= cut).alias("b")), key)
    return kappa(both, "a", "b")


def mine(sequences: DataFrame, statements: DataFrame, least: int = 2) -> DataFrame:
    """(kind, summary, occurrences): recurring workflows, repeated corrections by theme, durable statements once each.

    ``sequences``: trace_id, tools. ``statements``: trace_id, source, text.
    """
    workflows = sequences.filter(F.size("tools") > 0).groupBy(F.array_join("tools", ">").alias("s")).agg(F.count("*").alias("occurrences")).filter(F.col("occurrences") >= least).select(F.lit("repeated_request").alias("kind"), F.concat(F.lit("Recurring workflow "), F.col("s")).alias("summary"), "occurrences")
    themes = statements.filter("source = 'correction'").groupBy(text.theme(F.col("text")).alias("t")).agg(F.count("*").alias("occurrences")).filter(F.col("occurrences") >= least).select(F.lit("correction").alias("kind"), F.concat(F.lit("Repeated correction about "), F.col("t")).alias("summary"), "occurrences")
    durable = statements.filter("source = 'explicit'").select(F.lit("durable_statement").alias("kind"), F.substring("text", 1, 80).alias("summary"), F.lit(1).cast("bigint").alias("occurrences")).distinct()
    return workflows.unionByName(themes).unionByName(durable)


def summarize(paired: DataFrame) -> DataFrame:
    """One row of a backtest's figures from (task_id, base, treated, delta)."""
    return paired.agg(F.count("*").alias("tasks"), F.round(F.avg("base"), 4).alias("mean_base"), F.round(F.avg("treated"), 4).alias("mean_treated"), F.round(F.avg("delta"), 4).alias("mean_delta"), F.round(F.avg(F.when(F.col("delta") > 0, 1.0).otherwise(0.0)), 4).alias("win_rate"))
