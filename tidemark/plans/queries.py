"""One query for each operator, over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import ids, scoring, text
from tidemark.operators import evals, fold, learn, lexical_index, log, matching, memory, replay, retrieve, segments, snapshots, traces
from tidemark.plans.adapters import INGESTED, NOW, POINTS, VALID, app_events, edge_events, items, prompts, spans, table
from tidemark.sources import transcripts
from tidemark.tables import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ENTITY = ["entity_id"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _flat(states: DataFrame) -> DataFrame:
    p = F.col("payload")
    return states.select("entity_id", p["event_type"].alias("event_type"), p["value"].alias("value"), p["k"].alias("k"), "version_count", ids.to_iso(F.col("last_valid_at")).alias("last_valid_at"))


# -- log and fold -----------------------------------------------------------------------------------------------------


@query
def asof_fold(spark, d):
    return _flat(fold.materialize(app_events(spark, d), VALID, INGESTED))


@query
def asof_fold_tau(spark, d):
    return _flat(fold.materialize(app_events(spark, d), ingested=INGESTED))


@query
def asof_deleted(spark, d):
    return fold.materialize(app_events(spark, d), VALID, INGESTED, include_deleted=True).filter("deleted").select("entity_id", ids.to_iso(F.col("last_valid_at")).alias("last_valid_at"))


@query
def asof_events(spark, d):
    return log.as_of(app_events(spark, d), VALID, INGESTED, app="events").select("seq", "entity_id", "op")


@query
def asof_join_multi_point(spark, d):
    points = spark.createDataFrame(POINTS, "point string, valid string, ingested string").select("point", F.col("valid").cast("timestamp").alias("valid"), F.col("ingested").cast("timestamp").alias("ingested"))
    return fold.at_points(app_events(spark, d), points).select("point", "entity_id", "deleted", "version_count")


@query
def entity_state(spark, d):
    return _flat(fold.entity_state(app_events(spark, d), "events", "user", "8", VALID, INGESTED))


@query
def entity_list(spark, d):
    return fold.list_entities(app_events(spark, d), VALID, INGESTED, entity_type="user").select("entity_id", F.size("edges").alias("n_edge_kinds"))


@query
def entity_find(spark, d):
    return fold.find_entities(fold.materialize(app_events(spark, d), VALID, INGESTED), event_type="click").select("entity_id")


@query
def payload_keys(spark, d):
    return fold.payload_entries(log.as_of(app_events(spark, d), VALID, INGESTED), ENTITY)


@query
def edge_fold_live(spark, d):
    return fold.edge_targets(edge_events(spark, d), ENTITY).filter("live").select("entity_id", "edge_target")


@query
def edge_sets(spark, d):
    edges = F.col("edges")["part"]
    return fold.materialize(edge_events(spark, d)).select("entity_id", F.size(edges).cast("bigint").alias("n_live"), F.array_join(edges, ",").alias("targets"))


@query
def version_counts(spark, d):
    return fold.summary(app_events(spark, d), ENTITY).select("entity_id", "version_count")


@query
def entity_history(spark, d):
    return log.history(app_events(spark, d), "events", "user", "8").select("seq", "op", ids.to_iso(F.col("valid_at")).alias("valid_at"))


@query
def timeline_window(spark, d):
    return log.timeline(app_events(spark, d), "2024-01-03", "2024-01-06", ingested="2024-01-09").select("seq", "entity_id", "op")


@query
def activity_feed(spark, d):
    return log.feed(app_events(spark, d))


@query
def entity_change_frames(spark, d):
    return fold.change_frames(app_events(spark, d), ENTITY).select("entity_id", "seq", "k", "v", "changed")


@query
def log_statistics(spark, d):
    at = lambda c: ids.to_iso(F.col(c)).alias(c)
    return log.statistics(app_events(spark, d)).select("app", "op", "n", at("first_valid"), at("last_valid"), at("first_ingested"), at("last_ingested"))


@query
def idempotent_append(spark, d):
    events = app_events(spark, d)
    batch = events.unionByName(events.withColumn("ingested_at", F.col("ingested_at") + F.expr("interval 1 day")))
    return log.new_events(batch, events.filter("seq % 3 = 0"), ["ingested_at", "seq"]).select("event_id", ids.to_iso(F.col("ingested_at")).alias("ingested_at"))


@query
def concurrent_append(spark, d):
    """Two writers at once, whose batches overlap, into a log that has some of their events already."""
    events, root = app_events(spark, d), fresh_path(spark, "log")
    segments.append(spark, events.filter("op = 'delete_entity'"), root, ["ingested_at", "seq"])
    halves = [events.filter(c) for c in ("valid_at < '2024-01-20'", "valid_at > '2024-01-10'")]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda half: segments.append(spark, half, root, ["ingested_at", "seq"]), halves))
    return segments.read(spark, root).select("event_id", "entity_id", "op", ids.sha256_hex(ids.canonical_map(F.col("payload"))).alias("payload_hash"))


@query
def log_compacted(spark, d):
    """A log of many commits with its sequence numbers, after its segments were rewritten together."""
    events, root = app_events(spark, d), fresh_path(spark, "log")
    for op in ("append_version", "upsert_entity", "delete_entity"):
        segments.append(spark, events.filter(F.col("op") == op), root, ["ingested_at", "seq"])
    segments.compact(spark, root)
    return segments.read(spark, root).select("event_id", "seq", "op", ids.to_iso(F.col("valid_at")).alias("valid_at"))


@query
def cursor_latest(spark, d):
    events = app_events(spark, d)
    return log.latest_cursor(events.select("app", F.col("op").alias("stream"), "event_id", F.struct("valid_at", "seq").alias("updated_at")).withColumnRenamed("event_id", "cursor"))


@query
def event_identity(spark, d):
    return app_events(spark, d).select("seq", ids.sha256_hex(ids.canonical_map(F.col("payload"))).alias("payload_hash"), log.event_id().alias("event_id"))


@query
def activity_windows(spark, d):
    windows = app_events(spark, d).groupBy(F.window("ingested_at", "1 day"), "op").agg(F.count("*").alias("n"))
    return windows.select(ids.to_iso(F.col("window.start")).alias("day"), "op", "n")


# -- snapshots and blobs ----------------------------------------------------------------------------------------------


def _versions(spark, d, valid, ingested):
    return snapshots.versions(fold.materialize(app_events(spark, d), valid, ingested, include_deleted=True).drop("edges"))


@query
def snapshot_versions(spark, d):
    return _versions(spark, d, VALID, INGESTED).select("entity_id", "version_hash")


@query
def snapshot_root(spark, d):
    return snapshots.root(_versions(spark, d, VALID, INGESTED))


@query
def snapshot_plain_root(spark, d):
    return snapshots.plain_root(_versions(spark, d, VALID, INGESTED))


@query
def snapshot_diff(spark, d):
    return snapshots.difference(_versions(spark, d, POINTS[0][1], POINTS[0][2]), _versions(spark, d, VALID, INGESTED)).select("entity_id", "change")


@query
def blob_dedup(spark, d):
    return log.blobs(table(spark, d, "documents"), "text").select("hash", "prefix2", "size")


@query
def blob_put(spark, d):
    docs = table(spark, d, "documents")
    return log.put_blobs(docs, "text", log.blobs(docs.filter("doc_id % 2 = 0"), "text")).select("hash")


@query
def blob_get(spark, d):
    docs = table(spark, d, "documents")
    refs = docs.select("doc_id", ids.blob_uri(ids.sha256_hex(F.col("text"))).alias("uri"))
    return log.get_blobs(refs, "uri", log.blobs(docs, "text")).select("doc_id", F.length("body").alias("n_chars"))


@query
def blob_verify(spark, d):
    stored = log.blobs(table(spark, d, "documents"), "text")
    return log.corrupt_blobs(stored.withColumn("body", F.when(F.col("prefix2") < "10", F.concat("body", F.lit("x"))).otherwise(F.col("body"))))


@query
def content_hashes(spark, d):
    return table(spark, d, "benchmark").select("item_id", ids.content_hash(F.col("text")).alias("hash"), ids.new_id("doc", name=F.col("text"), lang=F.lit("en")).alias("id"))


# -- traces -----------------------------------------------------------------------------------------------------------


@query
def richest_run(spark, d):
    talk = table(spark, d, "conversations")
    count = talk.groupBy(F.col("conv_id").alias("trace_id")).agg(F.count("*").alias("n_spans"))
    at = lambda s: F.lit(s).cast("timestamp").alias("ingested_at")
    full = count.select("trace_id", F.lit("transcript").alias("source"), "n_spans", at("2024-01-02"))
    thin = count.select("trace_id", F.lit("hook").alias("source"), F.when(F.col("trace_id") % 2 == 0, F.col("n_spans")).otherwise(F.col("n_spans") - 1).alias("n_spans"), at("2024-01-01"))
    return traces.richest(full.unionByName(thin)).select("trace_id", "source", "n_spans")


@query
def span_touch_join(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").alias("span_id"), F.col("l_partkey").cast("string").alias("part"), "l_quantity")
    refs = lines.select("trace_id", "span_id", F.lit("shop").alias("app"), F.lit("part").alias("entity_type"), F.col("part").alias("entity_id"), F.lit("read").alias("role"))
    return traces.touching(lines.select("trace_id", "span_id", "l_quantity"), refs, "shop", "part", "100").select("trace_id", "span_id", "l_quantity")


@query
def tool_pairing(spark, d):
    talk = table(spark, d, "conversations")
    uses = talk.filter("role = 'user'").select("conv_id", "turn", F.concat_ws(":", "conv_id", (F.col("turn") + 1).cast("string")).alias("call"))
    results = talk.filter("role = 'assistant'").select(F.concat_ws(":", "conv_id", "turn").alias("call"), F.length("text").alias("reply_chars"))
    return traces.paired(uses, results, "call").select("conv_id", "turn", "reply_chars")


@query
def app_references(spark, d):
    args = F.create_map(F.lit("channel"), F.concat(F.lit("C"), F.col("conv_id")), F.lit("doc_id"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("D"), F.col("turn"))))
    tool = F.when(F.col("role") == "assistant", "slack.post_message").otherwise("slack.read")
    calls = table(spark, d, "conversations").select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("span_id"), tool.alias("tool_name"), args.alias("tool_args"))
    return traces.span_refs(calls)


@query
def span_durations(spark, d):
    start = F.col("o_orderdate").cast("timestamp")
    end = start + F.make_dt_interval(hours=(F.col("o_orderkey") % 48).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", traces.duration_seconds(start, end).alias("seconds"))


@query
def call_costs(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.round(F.sum(traces.cost_usd(F.length("text"), F.col("turn"), 3.0, 15.0)), 6).alias("usd"))


@query
def exchange_round_trip(spark, d):
    rows = spans(spark, d).select("trace_id", F.concat_ws("-", "trace_id", "pos").alias("span_id"), F.lit(None).cast("string").alias("parent_id"), "kind", F.lit(None).cast("string").alias("name"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("ended_at"), F.lit("ok").alias("status"), "input", F.lit(None).cast("string").alias("output"), "tool_name", F.when(F.col("tool_name").isNotNull(), F.create_map(F.lit("pos"), F.col("pos").cast("string"))).alias("tool_args"), F.col("chars").cast("bigint").alias("tokens"), F.lit(None).cast("double").alias("cost_usd"), F.create_map(F.lit("lang"), F.lit("x")).alias("attributes"))
    back = transcripts.from_otel(transcripts.to_otel(rows))
    return back.select("trace_id", "span_id", "kind", "input", "tool_name", F.col("tool_args")["pos"].alias("pos"), "tokens", F.col("attributes")["lang"].alias("lang"))


@query
def repeated_sequences(spark, d):
    daily = app_events(spark, d).select(F.concat_ws("-", "entity_id", F.to_date("valid_at").cast("string")).alias("trace_id"), F.col("seq").alias("pos"), F.col("payload")["event_type"].alias("tool_name"))
    return traces.repeated_sequences(traces.tool_sequences(daily)).select(F.array_join("tools", ">").alias("tools"), "occurrences", "first_trace")


@query
def procedures(spark, d):
    calls = spans(spark, d).withColumn("tool_args", F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.col("pos").cast("string")))
    found = traces.procedures(calls)
    return found.select("name", "occurrences", F.size("steps").cast("bigint").alias("n_steps"), F.array_join(F.element_at("steps", 1)["arg_keys"], ",").alias("arg_keys"))


# -- text -------------------------------------------------------------------------------------------------------------


@query
def redact_text(spark, d):
    return table(spark, d, "documents").select("doc_id", ids.sha256_hex(text.redacted(F.col("text"))).alias("hash"))


@query
def redact_hits(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.redaction_hits(F.col("text")), ",").alias("rules")).filter("rules <> ''")


@query
def token_counts(spark, d):
    t = text.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("bigint").alias("n"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"))


@query
def theme_counts(spark, d):
    return spans(spark, d).filter("kind = 'user'").groupBy(text.theme(F.col("input")).alias("theme")).agg(F.count("*").alias("n"))


@query
def route_prior(spark, d):
    r = text.route(F.col("prompt"))
    return prompts(spark, d).select("task_id", *[F.round(r[ns], 6).alias(ns) for ns in text.ROUTES])


@query
def route_top(spark, d):
    return prompts(spark, d).select("task_id", F.array_join(text.top_routes(F.col("prompt"), 2), ",").alias("namespaces"))


@query
def knowledge_paths(spark, d):
    return items(spark, d).select("memory_id", text.path_for(F.col("type"), F.col("namespace"), F.col("subject")).alias("path"))


@query
def front_matter(spark, d):
    doc = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("---\ntitle: t"), F.col("turn"), F.lit("\n---\n\n"), F.col("text"))).otherwise(F.col("text"))
    f = text.front_matter(doc)
    return table(spark, d, "conversations").select("conv_id", "turn", f["matter"].alias("matter"), F.length(f["body"]).alias("body_chars"))


@query
def parsed_scores(spark, d):
    said = F.concat(F.lit("score: "), F.when(F.col("doc_id") % 3 == 0, F.concat((F.col("doc_id") % 12).cast("string"), F.lit("/10"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("0."), (F.col("doc_id") % 100).cast("string"))).otherwise("none"))
    return table(spark, d, "labels").select("doc_id", F.round(text.parse_score(said), 4).alias("score"))


# -- memory -----------------------------------------------------------------------------------------------------------


@query
def extract_statements(spark, d):
    return memory.from_runs(spans(spark, d)).select("ref", "ord", "source", "kind", "namespace", "hint")


@query
def corrections_after_tool(spark, d):
    marked = memory.after_tool(spans(spark, d), F.col("kind") == "tool")
    return marked.filter((F.col("kind") == "user") & text.corrects(F.col("input")) & F.col("prior_tool")).select("trace_id", "pos")


@query
def extract_norm_lines(spark, d):
    body = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("Our naming convention\nis short: "), F.col("text"))).otherwise(F.col("text"))
    found = memory.norm_lines(table(spark, d, "documents"), body, F.col("doc_id") % 4 == 0, F.col("doc_id"))
    return found.select("ref", "ord", "namespace", F.length("text").alias("n_chars"))


def _candidates(spark, d):
    return memory.from_runs(spans(spark, d, planted=True))


@query
def corroboration(spark, d):
    return memory.corroborated(_candidates(spark, d)).select("ref", "ord", "corroborating")


@query
def score_promote(spark, d):
    return memory.promote(_candidates(spark, d)).select("type", "namespace", "subject", "claim", "confidence", "ttl_policy", "acl")


@query
def utility_scores(spark, d):
    return items(spark, d).select("memory_id", scoring.utility(p_useful=F.col("confidence"), impact=0.8, privacy=F.when(F.col("acl") == "personal", 0.3).otherwise(0.0), staleness=1 - scoring.freshness(F.col("created_at"), F.lit(NOW).cast("timestamp"))).alias("utility"))


@query
def freshness(spark, d):
    return items(spark, d).select("memory_id", F.round(scoring.freshness(F.col("created_at"), F.lit(NOW).cast("timestamp")), 6).alias("freshness"))


@query
def contradiction_pairs(spark, d):
    return memory.contradictions(items(spark, d)).select("a", "b", F.round("overlap", 6).alias("overlap"))


@query
def resolve_active(spark, d):
    active, _ = memory.resolve(items(spark, d).drop("active"))
    return active.select("memory_id", "active")


@query
def approval_split(spark, d):
    return items(spark, d).groupBy(memory.needs_review(F.col("confidence"), F.col("acl")).alias("review"), "acl").agg(F.count("*").alias("n"))


@query
def queue_status(spark, d):
    decisions = app_events(spark, d).select(F.col("entity_id").alias("approval_id"), F.col("op").alias("status"), F.struct("valid_at", "seq").alias("at"))
    return memory.queue_status(decisions)


@query
def bootstrap_facts(spark, d):
    users = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.lit(None).cast("string").alias("real_name"), F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("UTC+"), F.col("c_nationkey"))).alias("tz"))
    channels = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") > 1, F.concat(F.lit("region "), F.col("n_regionkey"))).alias("topic"))
    return memory.structured_facts(users, channels).select("namespace", "subject", "claim", "confidence")


@query
def subjects_index(spark, d):
    return memory.subjects_index(items(spark, d)).select("namespace", "subject", F.array_join("ids", ",").alias("ids"))


@query
def knowledge_files(spark, d):
    return memory.knowledge_files(items(spark, d)).select("path", ids.sha256_hex(F.col("body")).alias("hash"))


@query
def memory_diff(spark, d):
    now = items(spark, d)
    before = now.filter("n % 3 <> 0").select("memory_id", (F.col("n") % 4 != 0).alias("active"))
    return snapshots.memory_difference(before, now.filter("n % 7 <> 0"))


def _edges(spark, d):
    relation = F.when(F.col("n") % 3 == 0, "supports").when(F.col("n") % 3 == 1, "derived_from").otherwise("contradicts")
    target = F.concat(F.lit("mem_"), F.lpad(((F.col("n") / 1000).cast("bigint") * 1000).cast("string"), 9, "0"))
    return items(spark, d).filter("n % 1000 > 0").select(F.col("memory_id").alias("src_id"), target.alias("dst_id"), relation.alias("relation"))


@query
def provenance_edges(spark, d):
    return memory.provenance(items(spark, d), _edges(spark, d)).select("memory_id", F.array_join("relations", ";").alias("relations"))


# -- retrieval --------------------------------------------------------------------------------------------------------


@query
def bm25_topk(spark, d):
    return retrieve.lexical_top(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text", 5)


@query
def bm25_indexed(spark, d):
    """A kept index after four changes: old versions of some documents, others that go again, and the documents as they are."""
    docs, root = table(spark, d, "documents").select("doc_id", "text"), fresh_path(spark, "lexical-index")
    lexical_index.add(docs.filter("length(text) < 500").withColumn("text", F.upper(F.reverse("text"))), root, "doc_id", "text")
    gone = table(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), "text")
    lexical_index.add(gone, root, "doc_id", "text")
    lexical_index.add(docs, root, "doc_id", "text")
    lexical_index.remove(gone, root, "doc_id")
    return lexical_index.search(table(spark, d, "benchmark"), root, "item_id", "text", 5)


@query
def bm25_incremental(spark, d):
    """Turns are versions of their conversation's document; one that ends with an assistant's in every fifth is removed."""
    talk = table(spark, d, "conversations").withColumn("removed", (F.col("role") == "assistant") & (F.col("conv_id") % 5 == 0))
    return retrieve.lexical_top(retrieve.current_documents(talk, "conv_id", "text", "turn"), table(spark, d, "benchmark"), "conv_id", "text", "item_id", "text", 3)


@query
def dense_topk(spark, d):
    vectors = table(spark, d, "embeddings")
    return retrieve.vector_top(vectors, vectors.filter("vec_id % 100 = 0"), "vec_id", "embedding", "vec_id", "embedding", 5)


def _search(find, spark, d, k=20):
    return find(items(spark, d), table(spark, d, "benchmark"), "n", "text", "item_id", "text", k)


@query
def hash_embed_topk(spark, d):
    return _search(retrieve.hashed_top, spark, d, 5)


@query
def hash_embed_buckets(spark, d):
    return retrieve.hashed_vectors(table(spark, d, "benchmark"), "item_id", "text").select("id", "bucket", F.round("val", 6).alias("val"))


@query
def hybrid_rrf(spark, d):
    return retrieve.fuse([_search(retrieve.lexical_top, spark, d), _search(retrieve.hashed_top, spark, d)]).select("query", "doc", F.round("fused", 6).alias("fused"))


def _retrieved(spark, d):
    number = lambda c: F.substring(c, 5, 9).cast("bigint")
    edges = _edges(spark, d).select(number("src_id").alias("src_id"), number("dst_id").alias("dst_id"), "relation")
    own = items(spark, d).select(F.col("n").alias("doc"), "text", "claim", "namespace", "confidence", "acl", "active", "created_at")
    return retrieve.retrieve(table(spark, d, "benchmark"), own, edges, NOW, "item_id", "text")


@query
def hybrid_rerank(spark, d):
    return retrieve.top(_retrieved(spark, d), ["query"], "score", "doc", 10).select("query", "doc", "score", "rank")


@query
def budget_pack(spark, d):
    return retrieve.packed(_retrieved(spark, d)).select("query", "used", F.array_join("docs", ",").alias("docs"))


@query
def budget_knapsack(spark, d):
    ranked = retrieve.top(_retrieved(spark, d), ["query"], "score", "doc", 20)
    return retrieve.knapsack(ranked.select("query", F.col("doc").alias("id"), F.col("score").alias("value"), F.col("cost").alias("tokens")), 600).select("query", "id")


@query
def graph_one_hop(spark, d):
    start = items(spark, d).select(F.lit(1).alias("query"), F.col("memory_id").alias("doc"), F.lit(0.01).alias("fused"))
    return retrieve.expand(start, _edges(spark, d)).select("doc", F.round("fused", 6).alias("fused"))


@query
def graph_two_hop(spark, d):
    supplier = table(spark, d, "supplier")
    edges = supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    return retrieve.proximity(edges, edges.select("src").filter("src in ('s1', 's2', 's3')"))


@query
def graph_three_hops(spark, d):
    """From nations over suppliers to parts and back to suppliers: what three undirected hops reach."""
    name = lambda letter, c: F.concat(F.lit(letter), c)
    supplied = table(spark, d, "lineitem").select(name("s", "l_suppkey").alias("src"), name("p", "l_partkey").alias("dst"))
    based = table(spark, d, "supplier").select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"))
    start = table(spark, d, "nation").filter("n_nationkey < 3").select(name("n", "n_nationkey").alias("src"))
    return retrieve.proximity(supplied.union(based), start, 3).groupBy("src", "proximity").agg(F.count("*").alias("n"))


# -- evaluation -------------------------------------------------------------------------------------------------------


@query
def strings_contained(spark, d):
    """In how many documents each longer word of the benchmark stands, also inside of words."""
    words = table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("w")).filter("length(w) > 6").distinct()
    found = matching.containing(table(spark, d, "documents"), words, "doc_id", "text", "w", "w")
    return found.groupBy(F.col("string").alias("word")).agg(F.count("*").alias("n"))


@query
def retrieval_quality(spark, d):
    expected = F.filter(F.split("text", " "), lambda w: F.length(w) > 6)
    r = scoring.retrieval_scores(F.split("text", r"\n"), expected)
    return table(spark, d, "benchmark").select("item_id", r["precision"].alias("precision"), r["recall"].alias("recall"), scoring.f1(r["precision"], r["recall"]).alias("f1"))


def _axes(spark, d):
    return table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("task_outcome"), (1.0 - F.col("toxic")).alias("action_validity"), ((F.col("doc_id") % 11) / 10).alias("memory_retrieval"), ((F.col("doc_id") % 5) / 4).alias("memory_application"))


@query
def rubric_scores(spark, d):
    axes = _axes(spark, d)
    total = scoring.rubric_total(**{k: F.col(k) for k in scoring.RUBRIC})
    return axes.select("doc_id", total.alias("total"), scoring.outcome_score(F.col("task_outcome"), F.col("action_validity")).alias("outcome_score"), scoring.success(F.col("task_outcome"), F.col("action_validity")).alias("success"))


def _paired(spark, d):
    scored = _axes(spark, d).select((F.col("doc_id") / 2).cast("bigint").alias("task_id"), F.when(F.col("doc_id") % 2 == 0, "without").otherwise("with").alias("condition"), scoring.outcome_score(F.col("task_outcome"), F.col("action_validity")).alias("score"))
    return evals.paired_deltas(scored, "task_id", "condition", "score", "without", "with").filter("delta is not null")


@query
def paired_delta(spark, d):
    return _paired(spark, d)


@query
def win_rate(spark, d):
    return evals.win_rate(_paired(spark, d))


@query
def backtest_summary(spark, d):
    return evals.summarize(_paired(spark, d))


@query
def bootstrap_ci(spark, d):
    return evals.bootstrap(_paired(spark, d).withColumn("g", F.lit("all")), "g", "task_id", "delta")


@query
def win_rate_ci(spark, d):
    return evals.win_rate_interval(_paired(spark, d).withColumn("g", F.lit("all")), "g", "task_id", "delta")


@query
def wilcoxon(spark, d):
    return evals.wilcoxon(_paired(spark, d))


@query
def kappa(spark, d):
    return evals.kappa(table(spark, d, "labels"), "quality", "toxic")


@query
def percentiles(spark, d):
    return evals.percentiles(table(spark, d, "orders"), "o_totalprice", [0.05, 0.5, 0.95], ["o_orderstatus"])


@query
def mine_tasks(spark, d):
    calls = spans(spark, d)
    return evals.mine(traces.tool_sequences(calls), memory.from_runs(calls).select(F.col("ref").alias("trace_id"), "source", "text"))


@query
def policy_actions(spark, d):
    tasks = prompts(spark, d)
    done = replay.run_policy(tasks.select("task_id", "prompt"), tasks.select("task_id", "memory"))
    return done.select("task_id", "condition", "tool", ids.canonical_map(F.col("args")).alias("args"))


@query
def judged_runs(spark, d):
    tasks = prompts(spark, d)
    done = replay.run_policy(tasks.select("task_id", "prompt"), tasks.select("task_id", "memory"))
    writes = done.groupBy("task_id", "condition").agg(F.collect_list(F.struct(F.substring_index("tool", ".", 1).alias("app"), F.col("tool").alias("action"), F.col("args").alias("fields"))).alias("writes"))
    spec = tasks.select(
        "task_id", F.array(F.struct(F.lit("gcal").alias("app"), F.lit("gcal.create_event").alias("action"), F.array(F.struct(F.lit("summary").alias("name"), F.lit("United").alias("value"), F.lit(True).alias("contains"))).alias("fields"))).alias("expected"),
        F.array(F.lit("slack.send_dm")).alias("forbidden"), F.lit(1).alias("max_writes"), F.array("memory").alias("memory_expected"),
    )
    claims = done.select("task_id", "condition").join(tasks, "task_id").select("task_id", "condition", F.when(F.col("condition") == "with_memory", F.array("memory")).otherwise(F.array().cast("array<string>")).alias("claims"))
    return evals.judge(spec, writes, claims).select("task_id", "condition", "task_outcome", "action_validity", "memory_retrieval", "total", "outcome_score", "success")


@query
def fault_injection(spark, d):
    calls = app_events(spark, d).select(F.col("entity_id").alias("run_id"), F.col("seq").alias("pos"), F.col("payload")["event_type"].alias("tool"))
    faults = spark.createDataFrame([(1, "click", 2, "rate_limit"), (2, None, 3, "empty"), (3, "view", 1, "stale")], "fault_no int, tool string, on_call int, kind string")
    return replay.inject_faults(calls, faults).filter("fault is not null")


@query
def usefulness_model(spark, d):
    examples = items(spark, d).select(F.col("n").alias("ord"), "type", "namespace", "confidence", (F.col("n") % 7).alias("rank"), "active")
    model = learn.fit_usefulness(examples.withColumnRenamed("active", "helped"))
    return model.select("feature", F.round("weight", 6).alias("weight"))


@query
def router_model(spark, d):
    examples = prompts(spark, d).select(F.col("task_id").alias("ord"), F.col("prompt").alias("query"), F.when(F.col("task_id") % 2 == 0, "user").otherwise("team").alias("namespace"))
    model = learn.fit_router(examples, list(text.ROUTES))
    return model.select("model", "feature", F.round("weight", 6).alias("weight"))
