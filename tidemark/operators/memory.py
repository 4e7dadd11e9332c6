"""Knowledge: candidates from runs and state, corroboration, scores, contradictions, approval, files."""

from __future__ import annotations

from collections import deque
from functools import reduce
from heapq import heapify, heappop, heapreplace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ids, scoring, text
from tidemark.operators.log import as_time
from tidemark.tables import stash

PROMOTE_FROM = 0.42
REVIEW_FROM, ACCEPT_FROM = 0.4, 0.85
OVERLAP_FROM = 0.5
#: Tokens of a block of claims: two blocks are compared by one task. A subject has ``MOST_BLOCKS`` of a polarity, which grow beyond that.
BLOCK_TOKENS, MOST_BLOCKS = 1 << 15, 8
# Fixed values by namespace or type.
ACL = {"user": "personal", "team": "team", "project": "project"}
ACL_RANK = {"personal": 3, "project": 2, "team": 1}
TTL = {"procedural": "long", "semantic": "medium", "episodic": "short"}
CANDIDATE = ["source", "kind", "namespace", "text", "hint", "ref", "subject", "occurrences", "ord"]


def lookup(column: Column, values: dict, default) -> Column:
    out = F.when(F.lit(False), F.lit(default))
    for k, v in values.items():
        out = out.when(column == k, F.lit(v))
    return out.otherwise(F.lit(default))


def _candidate(df: DataFrame, source, kind, namespace, said: Column, hint: Column, ref: Column, subject: Column | None = None, occurrences: Column | None = None, order: Column | None = None) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        lit(source).alias("source"), lit(kind).alias("kind"), lit(namespace).alias("namespace"), said.alias("text"), hint.cast("double").alias("hint"), ref.cast("string").alias("ref"),
        (subject if subject is not None else F.lit(None)).cast("string").alias("subject"), (occurrences if occurrences is not None else F.lit(1)).cast("bigint").alias("occurrences"),
        (order if order is not None else F.lit(0)).cast("bigint").alias("ord"),
    )


def after_tool(spans: DataFrame, is_tool: Column, trace: str = "trace_id", pos: str = "pos") -> DataFrame:
    """Spans with ``prior_tool``: whether a tool was called earlier in the run."""
    earlier = Window.partitionBy(trace).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("prior_tool", F.coalesce(F.max(is_tool).over(earlier), F.lit(False)))


def statement_class(said: Column, prior_tool: Column) -> Column:
    """correction, norm or preference, in this order; null for anything else."""
    return F.when(text.corrects(said) & prior_tool, "correction").when(text.states_norm(said), "norm").when(text.states_preference(said), "preference")


def from_runs(spans: DataFrame) -> DataFrame:
    """Candidates from what users said; spans are (trace_id, pos, kind, input)."""
    said = F.trim(F.coalesce("input", F.lit("")))
    marked = after_tool(spans, F.col("kind") == "tool").filter((F.col("kind") == "user") & (said != "")).withColumn("cls", statement_class(said, F.col("prior_tool"))).filter("cls is not null")
    return _candidate(
        marked, F.when(F.col("cls") == "correction", "correction").otherwise("explicit"), F.when(F.col("cls") == "correction", "procedural").otherwise("semantic"),
        F.when(F.col("cls") == "norm", "team").otherwise("user"), said, lookup(F.col("cls"), {"correction": 0.6, "norm": 0.55}, 0.7), F.col("trace_id"), order=F.col("pos"),
    )


def emitted(candidates: DataFrame) -> DataFrame:
    """Candidates that a run itself emitted (trace_id, text, kind, namespace, hint): trusted as explicit."""
    return _candidate(candidates, "explicit", F.col("kind"), F.col("namespace"), F.col("text"), F.col("hint"), F.col("trace_id"), order=F.lit(-1))


def from_sequences(sequences: DataFrame) -> DataFrame:
    """Candidates from repeated workflows (tools, occurrences, first_trace)."""
    said = F.concat(F.lit("Repeated workflow "), F.array_join("tools", " then "))
    return _candidate(sequences, "procedure", "procedural", "team", said, F.lit(0.6), F.col("first_trace"), occurrences=F.col("occurrences"))


def norm_lines(states: DataFrame, body: Column, document: Column, ref: Column) -> DataFrame:
    """Candidates from lines of current documents and messages that state a norm."""
    lines = states.select(ref.alias("ref"), document.alias("document"), F.posexplode(F.split(body, r"\r\n|\n|\r")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    found = lines.filter((F.length("line") >= 8) & text.states_norm(F.col("line")))
    return _candidate(found, "app_norm", "semantic", F.when(F.col("document"), "project").otherwise("team"), F.col("line"), F.lit(0.5), F.col("ref"), subject=F.when(F.col("document"), "document"), order=F.col("line_no"))


def claim_key() -> Column:
    return F.concat_ws("|", "kind", "namespace", F.lower(F.trim("text")))


def corroborated(candidates: DataFrame) -> DataFrame:
    """Candidates with how many others state the same claim."""
    keyed = candidates.withColumn("claim_key", claim_key())
    return keyed.join(keyed.groupBy("claim_key").agg((F.count("*") - 1).alias("corroborating")), "claim_key")


def infer_subject() -> Column:
    return F.coalesce("subject", lookup(F.col("namespace"), {"user": "user", "team": "team-norms", "project": "project"}, "general"))


def memory_id() -> Column:
    return ids.new_id("mem", type=F.col("type"), namespace=F.col("namespace"), subject=F.lower(F.trim("subject")), claim=F.lower(F.trim("claim")))


def promote(candidates: DataFrame, threshold: float = PROMOTE_FROM) -> DataFrame:
    """Items from candidates: claims are counted, scored and promoted once each; of equal claims the first in order stays.

    Equal claims meet in one aggregate (count and first candidate), so a frequent claim is combined on the map side.
    """
    order = F.struct("source", "ord", "ref")
    rest = [c for c in CANDIDATE if c not in ("kind", "namespace")]
    claims = candidates.withColumn("claim_key", claim_key()).groupBy("claim_key", "kind", "namespace").agg((F.count("*") - 1).alias("corroborating"), F.min_by(F.struct(*rest), order).alias("c"))
    scored = claims.select("kind", "namespace", "corroborating", "c.*").withColumn("confidence", scoring.candidate_confidence(F.col("source"), F.col("hint"), F.col("occurrences"), F.col("corroborating")))
    items = scored.filter(F.col("confidence") >= threshold).select(
        F.col("kind").alias("type"), "namespace", infer_subject().alias("subject"), F.trim("text").alias("claim"), "confidence",
        lookup(F.col("kind"), TTL, "medium").alias("ttl_policy"), lookup(F.col("namespace"), ACL, "team").alias("acl"), "source", "ref",
    )
    return items.select(memory_id().alias("memory_id"), "*")


def compile_items(candidates: list[DataFrame], now, threshold: float = PROMOTE_FROM, overlap: float = OVERLAP_FROM) -> tuple[DataFrame, DataFrame]:
    """(items with active, edges): candidates of all extractors together, corroborated, scored, promoted once each and resolved."""
    every = reduce(DataFrame.unionByName, [c.select(*CANDIDATE) for c in candidates])
    promoted = stash(promote(every, threshold).withColumn("created_at", as_time(now)), "promoted")  # read four times
    return resolve(promoted, overlap)


def cold_start(states: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(items with active, edges) from current state alone: plain facts, and norms that documents and messages state."""
    p = F.col("payload")
    of = lambda app, kind: states.filter((F.col("app") == app) & (F.col("entity_type") == kind) & ~F.col("deleted"))
    owner = F.get(F.from_json(p["owners"], "array<string>"), F.lit(0))
    facts = structured_facts(
        of("slack", "user").select(p["name"].alias("name"), p["real_name"].alias("real_name"), p["tz"].alias("tz")), of("slack", "channel").select(p["name"].alias("name"), p["topic"].alias("topic")), of("gdocs", "document").select(p["name"].alias("name"), owner.alias("owner"))
    )
    written = of("gdocs", "document").unionByName(of("slack", "message"))
    document = F.col("entity_type") == "document"
    norms, edges = compile_items([norm_lines(written, F.when(document, p["markdown"]).otherwise(p["text"]), document, F.col("entity_id"))], now)
    return norms.unionByName(facts.withColumn("created_at", as_time(now)).withColumn("active", F.lit(True)), allowMissingColumns=True), edges


def structured_facts(users: DataFrame, channels: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Cold start: time zones of people, topics of channels and owners of documents (name, owner), from current state."""
    name = F.coalesce("real_name", "name")
    people = users.filter(name.isNotNull() & F.col("tz").isNotNull()).select(F.lit("semantic").alias("type"), F.lit("user").alias("namespace"), name.alias("subject"), F.concat(name, F.lit(" is in timezone "), F.col("tz")).alias("claim"), F.lit(0.7).alias("confidence"), F.lit("team").alias("acl"))
    topics = channels.filter("name is not null and topic is not null").select(F.lit("semantic").alias("type"), F.lit("team").alias("namespace"), F.lit("channels").alias("subject"), F.concat(F.lit("Channel "), F.col("name"), F.lit(" is for "), F.col("topic")).alias("claim"), F.lit(0.65).alias("confidence"), F.lit("team").alias("acl"))
    items = people.unionByName(topics)
    if documents is not None:
        claim = F.concat(F.lit("Document "), F.col("name"), F.lit(" is owned by "), F.col("owner"))
        items = items.unionByName(documents.filter("name is not null and owner is not null").select(F.lit("semantic").alias("type"), F.lit("project").alias("namespace"), F.col("name").alias("subject"), claim.alias("claim"), F.lit(0.6).alias("confidence"), F.lit("project").alias("acl")))
    return items.select(memory_id().alias("memory_id"), "*")


def _claim_sets(items: DataFrame) -> DataFrame:
    """(memory_id, namespace, subject, pos, t, rep): items with topic tokens; items of one subject, polarity and set of tokens share ``rep``, the hash of these."""
    marked = items.select("memory_id", "namespace", F.coalesce("subject", F.lit("")).alias("subject"), text.positive(F.col("claim")).alias("pos"), F.array_sort(F.array_distinct(text.topic_tokens(F.col("claim")))).alias("t")).filter(F.size("t") > 0)
    return stash(marked.withColumn("rep", ids.sha256_hex(F.to_json(F.struct("namespace", "subject", "pos", "t")))), "claims")


def _hostile_sets(marked: DataFrame, overlap: float, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(namespace, subject, x, y, overlap): sets of one subject with opposite polarity that share a topic, each by its ``rep``; x affirms.

    A subject's affirming and denying sets are dealt into blocks of some ``block_tokens`` tokens, and each block of the
    ones meets each of the others, where pairs are compared and dropped at once: what is shuffled is sets, once for each
    block of the other side, and no candidate pairs. A subject has at most ``MOST_BLOCKS`` of a side, larger ones where it
    has more tokens, so no set is sent more often than that. Sets that none of their subject opposes aren't shuffled.
    """
    of = ["namespace", "subject"]
    sets = stash(marked.dropDuplicates(["rep"]).select("rep", "pos", *of, "t"), "sets")
    tokens = lambda pos: F.sum(F.when(F.col("pos") == pos, F.size("t")).otherwise(0))
    blocks = lambda pos: F.least(F.ceil(tokens(pos) / block_tokens), F.lit(MOST_BLOCKS)).cast("int")
    opposed = sets.groupBy(*of).agg(blocks(True).alias("of_x"), blocks(False).alias("of_y")).filter("of_x > 0 and of_y > 0")

    def side(pos: bool, name: str, other: str) -> DataFrame:
        mine = sets.filter(F.col("pos") == pos).join(opposed, of).select(*of, F.col("rep").alias(name), F.col("t").alias(f"t_{name}"), F.pmod(F.xxhash64("rep"), F.col(f"of_{name}")).alias(f"block_{name}"), f"of_{other}")
        return mine.withColumn(f"block_{other}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"of_{other}") - F.lit(1).cast("bigint")))).drop(f"of_{other}")

    met = side(True, "x", "y").join(side(False, "y", "x"), [*of, "block_x", "block_y"]).filter(F.size("t_x") >= overlap * F.size("t_y") - 1e-9).filter(F.size("t_y") >= overlap * F.size("t_x") - 1e-9)
    return met.select(*of, "x", "y", text.jaccard(F.col("t_x"), F.col("t_y")).alias("overlap")).filter(F.col("overlap") >= overlap)


def _drop(queue: deque[int], before: int, gone: list[bool]) -> None:
    """Take off the head of a queue what ranks before ``before`` or is superseded: neither is met again."""
    while queue and (queue[0] <= before or gone[queue[0]]):
        queue.popleft()


def contradictions(items: DataFrame, overlap: float = OVERLAP_FROM) -> DataFrame:
    """(a, b, overlap): items of one subject with opposite polarity that share a topic; a is the smaller id.

    Equal sets of tokens are compared once; the pairs of their items are the result's size, whatever finds them.
    """
    marked = _claim_sets(items)
    member = lambda name: marked.select(F.col("rep").alias(name), F.col("memory_id").alias(f"m_{name}"))
    pairs = _hostile_sets(marked, overlap).join(member("x"), "x").join(member("y"), "y")
    return pairs.select(F.least("m_x", "m_y").alias("a"), F.greatest("m_x", "m_y").alias("b"), "overlap")


def resolve(items: DataFrame, overlap: float = OVERLAP_FROM) -> tuple[DataFrame, DataFrame]:
    """(items with active, edges): the greedy sweep of each subject over its contradicting items.

    Sets of equal tokens are found hostile to each other once, and the sweep keeps each set's items in a queue: a step of
    it takes an item out, so n equal claims against m equal denials cost n + m steps and rows. Only items of hostile sets
    enter the sweep, a subject in one task. The stronger by confidence, then recency, then access wins; a superseded item
    supersedes nothing.
    """
    marked, of = _claim_sets(items), ["namespace", "subject"]
    hostile = stash(_hostile_sets(marked, overlap).select(*of, "x", "y"), "hostile")
    sets = hostile.select(F.col("x").alias("rep")).union(hostile.select("y")).distinct()
    facts = items.select("memory_id", "confidence", "created_at", lookup(F.col("acl"), ACL_RANK, 0).alias("acl_rank"))
    members = marked.join(sets, "rep", "left_semi").select("memory_id", *of, "rep").join(facts, "memory_id")

    def sweep(pairs: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        ranked = mine.sort_values(["confidence", "created_at", "memory_id"], ascending=[False, True, True])
        ids, rep = ranked["memory_id"].tolist(), ranked["rep"].tolist()
        strength = list(zip(ranked["confidence"], ranked["created_at"], ranked["acl_rank"], strict=True))
        queues: dict[str, deque[int]] = {}
        for k, r in enumerate(rep):
            queues.setdefault(r, deque()).append(k)
        against: dict[str, list[str]] = {}
        for x, y in zip(pairs["x"], pairs["y"], strict=True):
            against.setdefault(x, []).append(y)
            against.setdefault(y, []).append(x)
        gone, out = [False] * len(ids), []
        for a in range(len(ids)):
            if gone[a]:
                continue
            heads: list[tuple[int, str]] = []
            for r in against.get(rep[a], ()):
                _drop(queues[r], a, gone)
                if queues[r]:
                    heads.append((queues[r][0], r))
            heapify(heads)
            while heads:  # the hostile items behind a, by rank; each step supersedes one, or a itself
                b, r = heads[0]
                if strength[a] < strength[b]:
                    gone[a] = True
                    out.append((ids[b], ids[a]))
                    break
                gone[b] = True
                out.append((ids[a], ids[b]))
                _drop(queues[r], a, gone)
                if queues[r]:
                    heapreplace(heads, (queues[r][0], r))
                else:
                    heappop(heads)
        return pd.DataFrame(out, columns=["winner", "loser"])

    decided = stash(hostile.groupBy(*of).cogroup(members.groupBy(*of)).applyInPandas(sweep, "winner string, loser string"), "decided")
    edges = decided.select(F.col("winner").alias("src_id"), F.col("loser").alias("dst_id"), F.lit("supersedes").alias("relation")).unionByName(decided.select(F.col("loser").alias("src_id"), F.col("winner").alias("dst_id"), F.lit("contradicts").alias("relation")))
    losers = decided.select(F.col("loser").alias("memory_id"), F.lit(False).alias("__active")).distinct()
    return items.join(losers, "memory_id", "left").withColumn("active", F.coalesce("__active", F.lit(True))).drop("__active"), edges


def needs_review(confidence: Column, acl: Column) -> Column:
    return (acl == "personal") | ((confidence >= REVIEW_FROM) & (confidence < ACCEPT_FROM))


def queue_status(decisions: DataFrame) -> DataFrame:
    """Of an append-only log (approval_id, status, at): the current status of each item."""
    return decisions.groupBy("approval_id").agg(F.max_by("status", "at").alias("status"))


def subjects_index(items: DataFrame) -> DataFrame:
    """(namespace, subject, ids): active items of each subject, in order."""
    return items.filter("active").groupBy("namespace", "subject").agg(F.array_sort(F.collect_list("memory_id")).alias("ids"))


def knowledge_files(items: DataFrame) -> DataFrame:
    """(path, body): one markdown file a subject, active items by confidence, then id."""
    path = text.path_for(F.col("type"), F.col("namespace"), F.col("subject"))
    line = F.concat(F.lit("- "), F.col("claim"), F.lit(" (confidence "), F.format_number("confidence", 2), F.lit(")"))
    grouped = items.filter("active").groupBy(path.alias("path")).agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("o"), "memory_id", line.alias("line")))).alias("l"))
    return grouped.select("path", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))


def mounted(files: DataFrame, most_chars: int | None = None) -> DataFrame:
    """One text of all files in path order, cut to a length if one is given."""
    joined = files.agg(F.array_sort(F.collect_list(F.struct("path", "body"))).alias("f")).select(F.array_join(F.transform("f", lambda x: F.concat(F.lit("# file "), x["path"], F.lit("\n"), x["body"])), "\n\n").alias("text"))
    return joined if most_chars is None else joined.select(F.substring("text", 1, most_chars).alias("text"))


def provenance(items: DataFrame, edges: DataFrame) -> DataFrame:
    """(memory_id, claim, relations): each item with where it leads."""
    out = edges.groupBy(F.col("src_id").alias("memory_id")).agg(F.array_sort(F.collect_list(F.concat_ws(" ", "relation", "dst_id"))).alias("relations"))
    return items.join(out, "memory_id", "left").select("memory_id", "claim", F.coalesce("relations", F.array().cast("array<string>")).alias("relations"))
