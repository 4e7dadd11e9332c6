"""Retrieval for many queries at once: rank fusion, graph hops, rerank, packing. The searches themselves are in ``blocked``."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scoring, text
from tidemark.functions.text import tokens
from tidemark.operators.blocked import hashed_top, lexical_top, top, vector_top  # noqa: F401
from tidemark.operators.log import as_time
from tidemark.tables import stash

RRF_K = 60
HOP_BONUS = 0.5 / 60
HOP_RELATIONS = ["supports", "derived_from"]


def hashed_vectors(docs: DataFrame, id_col: str, text_col: str, dim: int = scoring.DIM) -> DataFrame:
    """(id, bucket, val): sparse unit vectors of hashed tokens and pairs."""
    features = docs.select(F.col(id_col).alias("id"), F.explode(scoring.text_features(tokens(F.col(text_col)))).alias("f"))
    summed = features.groupBy("id", scoring.bucket(F.col("f"), dim).alias("bucket")).agg(F.sum(scoring.sign(F.col("f"))).alias("raw")).filter("raw <> 0")
    norms = summed.groupBy("id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return summed.join(norms, "id").select("id", "bucket", (F.col("raw") / F.col("norm")).alias("val"))


def fuse(rankings: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query, doc, rank) lists, ranks from 0.

    The lists are written down first. Spark 4.1 takes a union of lists that are dealt by query for one that still is,
    also where it has since merged partitions of either, and would sum the ranks of a document apart.
    """
    every = reduce(DataFrame.unionByName, [stash(r.select("query", "doc", "rank"), "ranking") for r in rankings])
    return every.groupBy("query", "doc").agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("fused"))


def expand(fused: DataFrame, edges: DataFrame) -> DataFrame:
    """One hop along supporting edges (src_id, dst_id, relation): each adds a bonus to what it points to."""
    hops = fused.join(edges.filter(F.col("relation").isin(HOP_RELATIONS)), F.col("doc") == F.col("src_id")).select("query", F.col("dst_id").alias("doc"), F.lit(HOP_BONUS).alias("fused"))
    return fused.unionByName(hops).groupBy("query", "doc").agg(F.sum("fused").alias("fused"))


def normalised(fused: DataFrame) -> DataFrame:
    return fused.withColumn("fusion", F.col("fused") / F.max("fused").over(Window.partitionBy("query")))


def proximity(edges: DataFrame, start: DataFrame, max_hops: int = 2) -> DataFrame:
    """(src, dst, proximity): 1 at the node itself, 1 / (hops + 1) for what undirected hops reach; nothing beyond ``max_hops``."""
    # Edges aren't made distinct: what a hop reaches is. A hop's start is a written table, so Spark knows when it can be sent to the edges.
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).toDF("dst", "far")
    seen = stash(start.select("src", F.col("src").alias("dst")).distinct().withColumn("hops", F.lit(0)), "hops")
    reached = seen
    for h in range(1, max_hops + 1):
        step = reached.join(both, "dst").select("src", F.col("far").alias("dst")).distinct().join(seen.select("src", "dst"), ["src", "dst"], "left_anti")
        reached = stash(step.withColumn("hops", F.lit(h)), "hops")
        seen = seen.unionByName(reached)
    return seen.select("src", "dst", F.round(1 / (F.col("hops") + 1), 4).alias("proximity"))


def current_documents(changes: DataFrame, id_col: str = "id", text_col: str = "text", order: str = "seq", removed: str = "removed") -> DataFrame:
    """(id, text): what an index holds after all changes: the last word on each id, unless that removes it."""
    last = changes.groupBy(id_col).agg(F.max_by(F.struct(F.col(text_col).alias("text"), F.col(removed).alias("removed")), F.col(order)).alias("c"))
    return last.filter(~F.col("c.removed")).select(id_col, F.col("c.text").alias(text_col))


def retrieve(queries: DataFrame, items: DataFrame, edges: DataFrame, now, query_id: str = "query", query_text: str = "text", candidates: int = 20, searches: tuple = (lexical_top, hashed_top)) -> DataFrame:
    """(query, doc, score, claim, cost): every candidate of every query with its rerank score, rounded.

    ``items``: doc, text, claim, namespace, confidence, acl, active, created_at. ``edges``: src_id, dst_id, relation of
    docs. Candidates are the best of each search (by terms and by hashed vectors), fused by rank, and what they support
    one hop on. A search takes items, queries, the names of their ids and texts, and k.
    """
    asked = queries.select(F.col(query_id).alias("query"), F.col(query_text).alias("text"))
    fused = fuse([find(items, asked, "doc", "text", "query", "text", candidates) for find in searches])
    ranked = normalised(expand(fused, edges)).join(items.drop("text"), "doc")
    routes = text.route(F.col("text"))
    prior = asked.select("query", F.create_map(*[x for ns in text.ROUTES for x in (F.lit(ns), routes[ns])]).alias("prior"))
    score = scoring.rerank(F.col("fusion"), F.coalesce(F.col("prior")[F.col("namespace")], F.lit(0.0)), F.col("confidence"), scoring.freshness(F.col("created_at"), as_time(now)), F.col("active"), F.col("acl"))
    return ranked.join(prior, "query").select("query", "doc", F.round(score, 6).alias("score"), "claim", scoring.token_cost(F.col("claim")).alias("cost"))


def packed(found: DataFrame, top_k: int = 5, budget: int = 600, candidates: int = 20) -> DataFrame:
    """(query, used, docs, claims) of what ``retrieve`` gives: the best that fit a budget of tokens, in their order."""
    ranked = top(found, ["query"], "score", "doc", candidates)
    picked = ranked.groupBy("query").agg(pack(F.collect_list(F.struct("rank", "doc", "cost")), top_k, budget, found.schema["doc"].dataType.simpleString()).alias("p"), F.map_from_entries(F.collect_list(F.struct("doc", "claim"))).alias("m"))
    return picked.select("query", "p.used", "p.docs", F.transform("p.docs", lambda i: F.col("m")[i]).alias("claims"))


def pack(ranked: Column, top_k: int = 5, budget: int = 600, id_type: str = "bigint") -> Column:
    """Greedy packing of an array of (rank, doc, cost): what is too dear is skipped, the first always fits, at most top_k."""
    kind = f"struct<used:int,docs:array<{id_type}>>"

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["docs"]) < top_k) & ((acc["used"] + x["cost"] <= budget) | (F.size(acc["docs"]) == 0))
        return F.when(fits, F.struct((acc["used"] + x["cost"]).alias("used"), F.concat(acc["docs"], F.array(x["doc"])).alias("docs"))).otherwise(acc).cast(kind)

    return F.aggregate(F.array_sort(ranked), F.struct(F.lit(0).alias("used"), F.array().cast(f"array<{id_type}>").alias("docs")).cast(kind), step)


def knapsack(items: DataFrame, budget: int, exact_budget: int = 5000, exact_items: int = 200) -> DataFrame:
    """(query, id) chosen to maximise value within the budget: an exact program for small problems, else by value density.

    Items are tried by value, then id; of equal totals the first found stays.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["value", "id"], ascending=[False, True])
        rows = [(i, float(v), max(1, int(t))) for i, v, t in zip(pdf["id"], pdf["value"], pdf["tokens"], strict=True) if t >= 0]
        if budget <= 0:
            rows = []
        if budget <= exact_budget and len(rows) <= exact_items:
            best, pick = [0.0] * (budget + 1), [()] * (budget + 1)
            for i, v, cost in rows:
                for w in range(budget, cost - 1, -1):
                    if best[w - cost] + v > best[w]:
                        best[w], pick[w] = best[w - cost] + v, (*pick[w - cost], i)
            chosen = set(pick[budget]) if budget > 0 else set()
        else:
            chosen, used = set(), 0
            for i, _, cost in sorted(rows, key=lambda r: (-r[1] / r[2], r[0])):
                if used + cost <= budget:
                    chosen.add(i)
                    used += cost
        return pdf[pdf["id"].isin(chosen)][["query", "id", "value", "tokens"]]

    kinds = dict(items.dtypes)
    return items.select("query", "id", "value", "tokens").groupBy("query").applyInPandas(choose, ", ".join(f"{c} {kinds[c]}" for c in ("query", "id", "value", "tokens")))
