"""Texts for people: an evaluation's report, an entity's timeline, the provenance of items. Inputs are small results."""

from __future__ import annotations

import math
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ids
from tidemark.operators import evals

BASE, TREATED = "without_memory", "with_memory"


def figures(runs: DataFrame) -> dict:
    """Headline figures of (task_id, condition, task_outcome, ..., total, outcome_score, success) of both conditions."""
    paired = evals.paired_deltas(runs, "task_id", "condition", "outcome_score", BASE, TREATED).filter("delta is not null").withColumn("g", F.lit(0))
    means = {r["condition"]: r for r in runs.groupBy("condition").agg(*[F.round(F.avg(F.col(c).cast("double")), 4).alias(c) for c in ("outcome_score", "total", "success")]).collect()}
    out = {k: v for k, v in evals.summarize(paired).first().asDict().items()}
    for name, row in (("delta", evals.bootstrap(paired, "g", "task_id", "delta").first()), ("win_rate", evals.win_rate_interval(paired, "g", "task_id", "delta").first())):
        out |= {f"{name}_low": row["low"] if row else 0.0, f"{name}_high": row["high"] if row else 0.0}
    z = evals.wilcoxon(paired).first()["z"]
    out["wilcoxon_p"] = evals.normal_p(z) if z is not None and not math.isnan(z) else 1.0
    for label, condition in (("base", BASE), ("treated", TREATED)):
        out |= {f"{c}_{label}": means[condition][c] if condition in means else 0.0 for c in ("outcome_score", "total", "success")}
    return out


def _rows(runs: DataFrame) -> list:
    at = lambda condition, c: F.max(F.when(F.col("condition") == condition, F.col(c))).alias(f"{c}_{condition}")
    wanted = [(BASE, "task_outcome"), (TREATED, "task_outcome"), (TREATED, "memory_retrieval"), (TREATED, "memory_application"), (TREATED, "action_validity"), (BASE, "outcome_score"), (TREATED, "outcome_score")]
    return runs.groupBy("task_id").agg(*[at(*w) for w in wanted]).orderBy("task_id").collect()


def _cells(row) -> list[str]:
    delta = None if row[6] is None or row[7] is None else round(row[7] - row[6], 4)
    return [str(x) for x in (row[0], *row[1:6], delta)]


COLUMNS = ["task", "outcome without", "outcome with", "retrieval", "application", "validity", "delta"]


def markdown(runs: DataFrame) -> str:
    f = figures(runs)
    table = lambda head, rows: "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *rows])
    headline = [["outcome score", str(f["outcome_score_base"]), str(f["outcome_score_treated"]), str(f["mean_delta"])], ["success", str(f["success_base"]), str(f["success_treated"]), str(round(f["success_treated"] - f["success_base"], 4))]]
    return "\n\n".join([
        f"# Paired evaluation of {f['tasks']} tasks",
        table(["mean", "without memory", "with memory", "delta"], headline),
        f"Delta from {f['delta_low']} to {f['delta_high']} (95 %). Win rate {f['win_rate']}, from {f['win_rate_low']} to {f['win_rate_high']}. Signed ranks: p {f['wilcoxon_p']}.",
        table(COLUMNS, [_cells(r) for r in _rows(runs)]),
    ]) + "\n"


def html(runs: DataFrame, title: str = "Paired evaluation") -> str:
    f = figures(runs)
    row = lambda tag, cells, kind="": f"<tr{kind}>" + "".join(f"<{tag}>{escape(c)}</{tag}>" for c in cells) + "</tr>"
    sign = lambda cells: "" if cells[-1] == "None" else ' class="up"' if float(cells[-1]) > 0 else ' class="down"' if float(cells[-1]) < 0 else ""
    body = "\n".join(row("td", c, sign(c)) for c in map(_cells, _rows(runs)))
    style = "body{font:16px sans-serif;margin:2em}td,th{border:1px solid #ccc;padding:.3em .6em}.up{background:#e6f5e6}.down{background:#f9e3e3}"
    said = f"{f['tasks']} tasks: {f['outcome_score_base']} without memory, {f['outcome_score_treated']} with it; win rate {f['win_rate']}."
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title><style>{style}</style></head><body><h1>{escape(title)}</h1><p>{said}</p>\n<table>{row("th", COLUMNS)}\n{body}\n</table></body></html>\n'


def timeline(frames: DataFrame) -> str:
    """Lines of (valid_at, seq, op, changed map): when, what, and the fields that changed."""
    out = []
    for k, r in enumerate(frames.orderBy("valid_at", "seq").select(ids.to_iso(F.col("valid_at")).alias("at"), "op", "changed").collect()):
        out.append(f"{k:>4}  {r['at']}  {r['op']}  " + (", ".join(f"{n}={v}" for n, v in sorted(r["changed"].items())) or "-"))
    return "\n".join(out)


def provenance_text(linked: DataFrame) -> str:
    """Indented text of (memory_id, claim, confidence, relations)."""
    out = []
    for r in linked.orderBy("memory_id").collect():
        out += [f"{r['memory_id']} ({r['confidence']})", f"  {r['claim']}", *[f"  -> {x}" for x in r["relations"]]]
    return "\n".join(out)


def provenance_dot(items: DataFrame, edges: DataFrame) -> str:
    """The graph of items and edges in Graphviz's language; items that aren't active are grey."""
    quoted = lambda t: '"' + t.replace("\\", "\\\\").replace('"', '\\"').replace("\n", " ") + '"'
    nodes = [f"  {quoted(r['memory_id'])} [label={quoted(r['claim'])}{'' if r['active'] else ', color=grey'}];" for r in items.orderBy("memory_id").collect()]
    arrows = [f"  {quoted(r['src_id'])} -> {quoted(r['dst_id'])} [label={quoted(r['relation'])}];" for r in edges.orderBy("src_id", "dst_id", "relation").collect()]
    return "\n".join(["digraph items {", "  node [shape=box];", *nodes, *arrows, "}"])
