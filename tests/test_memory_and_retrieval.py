import math
import random
import re
import tracemalloc
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scoring, text
from tidemark.operators import blocked, memory, retrieve

CANDIDATES = "source string, kind string, namespace string, text string, hint double, ref string, subject string, occurrences bigint, ord bigint"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(
    ("source", "hint", "times", "others", "want"),
    [("explicit", 0.7, 1, 0, -0.5 + 1.8 + 1.2 * 0.85 - 0.3), ("app_norm", 0.5, 1, 0, -0.5 + 1.2 * 0.6 - 0.5), ("procedure", 0.6, 3, 2, -0.5 + 0.5 * 2 + 0.6 * 2 + 1.2 * 0.7 - 0.4), ("other", None, 1, 0, -0.5 + 1.2 * 0.5 - 0.4)],
)
def test_confidence(spark, source, hint, times, others, want):
    got = one(spark, scoring.candidate_confidence(F.lit(source), F.lit(hint).cast("double"), F.lit(times).cast("double"), F.lit(others).cast("double")))[0]
    assert got == round(1 / (1 + math.exp(-want)), 4)


def test_utility_freshness_and_scores(spark):
    now, old = F.lit(datetime(2026, 1, 1)), F.lit(datetime(2025, 7, 2, 12))
    assert one(spark, scoring.utility(0.9, 0.5, privacy=0.2), scoring.freshness(old, now), scoring.freshness(now, old), scoring.freshness(F.lit(datetime(2020, 1, 1)), now)) == (0.35, 0.5 - 0.0 + (1 - 182.5 / 365 - 0.5), 1.0, 0.0)
    assert one(spark, scoring.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))), scoring.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), scoring.cosine(F.array().cast("array<double>"), F.array().cast("array<double>")), scoring.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == (pytest.approx(2**-0.5), 0.0, 0.0, 0.0)
    said = F.array(F.lit("The launch is Friday"), F.lit("nothing"))
    r = scoring.retrieval_scores(said, F.array(F.lit("LAUNCH"), F.lit("budget")))
    assert one(spark, r["precision"], r["recall"], scoring.f1(r["precision"], r["recall"])) == (0.5, 0.5, 0.5)
    none = scoring.retrieval_scores(said, F.array().cast("array<string>"))
    assert one(spark, none["precision"], none["recall"]) == (1.0, 1.0)


@pytest.mark.parametrize(
    ("said", "prior", "want"),
    [("No, use X", True, None), ("no,use X", True, "correction"), ("Actually, we always ship", True, "correction"), ("Actually, we always ship", False, "norm"), ("I prefer tea", True, "preference"), ("hello", True, None), ("it should be blue", True, "correction"), ("The format of it is PDF", False, "norm")],
)
def test_statements(spark, said, prior, want):
    assert one(spark, memory.statement_class(F.lit(said), F.lit(prior)))[0] == want


def test_redaction(spark):
    said = "mail a.b@c.org or +1 (415) 555-0100, card 4111 1111 1111 1111, key sk-" + "a" * 20
    clean, hits = one(spark, text.redacted(F.lit(said)), text.redaction_hits(F.lit(said)))
    want, names = text.redact_value(said)
    assert clean == want and set(hits) == names == {"api_key", "email", "credit_card", "phone"}
    nested, hits = text.redact_value({"Token": "x", "a": [{"b": 4111111111111111, "c": True, "d": 1.5}, "a@b.org"]})
    assert nested == {"Token": "[REDACTED]", "a": [{"b": "[REDACTED_CARD]", "c": True, "d": 1.5}, "[REDACTED_EMAIL]"]} and hits == {"key:token", "credit_card", "email"}
    row = spark.createDataFrame([('{"password": 1, "n": [null, "x"]}',), (None,)], "j string").select(text.redact_json("j").alias("r")).select("r.*").collect()
    assert row[0]["json"] == '{"password": "[REDACTED]", "n": [null, "x"]}' and row[0]["hits"] == ["key:password"] and row[1]["json"] is None


def test_promotion_counts_equal_claims_once(spark):
    rows = [("explicit", "semantic", "user", "I prefer tea", 0.7, "t1", None, 1, 0), ("explicit", "semantic", "user", " i PREFER tea ", 0.7, "t2", None, 1, 0), ("other", "semantic", "team", "maybe", 0.0, "t3", None, 1, 0), ("app_norm", "semantic", "project", "we use UTC", 0.5, "d1", "document", 1, 0)]
    items = {r["claim"]: r for r in memory.promote(spark.createDataFrame(rows, CANDIDATES)).collect()}
    assert set(items) == {"I prefer tea", "we use UTC"} and items["I prefer tea"]["acl"] == "personal" and items["we use UTC"]["subject"] == "document"
    assert items["I prefer tea"]["confidence"] == round(1 / (1 + math.exp(-(-0.5 + 1.8 + 0.6 + 1.02 - 0.3))), 4)


def swept(items):
    """The greedy sweep, item by item."""
    stop = set(text.OVERLAP_STOP)
    tokens = lambda c: set(re.findall("[a-z0-9]+", c.lower())) - stop
    negative = lambda c: bool(re.search(text.NEGATION, c, re.I))
    gone = set()
    for key in {(i[1], i[2]) for i in items}:
        ranked = sorted((i for i in items if (i[1], i[2]) == key), key=lambda i: (-i[4], i[5], i[0]))
        for n, a in enumerate(ranked):
            for b in ranked[n + 1 :]:
                if a[0] in gone:
                    break
                ta, tb = tokens(a[3]), tokens(b[3])
                if b[0] in gone or negative(a[3]) == negative(b[3]) or not ta or not tb or len(ta & tb) / len(ta | tb) < 0.5:
                    continue
                rank = lambda i: (i[4], i[5], memory.ACL_RANK[i[6]])
                gone.add((b if rank(a) >= rank(b) else a)[0])
    return gone


def test_contradictions_resolve_as_a_sweep(spark):
    r = random.Random(4)
    stems = ["post weekly notes in general", "post weekly notes in general on friday", "deploy after review", "deploy after the review only"]
    items = []
    for k in range(60):
        claim = ("never " if r.random() < 0.5 else "") + r.choice(stems)
        items.append((f"m{k:02d}", r.choice(["team", "user"]), f"s{r.randrange(2)}", claim, r.choice([0.5, 0.7, 0.9]), datetime(2026, 1, 1 + r.randrange(4)), r.choice(["team", "personal", "project"])))
    df = spark.createDataFrame(items, "memory_id string, namespace string, subject string, claim string, confidence double, created_at timestamp, acl string")
    active, edges = memory.resolve(df)
    gone = swept(items)
    assert {x["memory_id"] for x in active.filter("not active").collect()} == gone and gone
    assert {x["dst_id"] for x in edges.filter("relation = 'supersedes'").collect()} == gone


def test_bm25_is_the_formula(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, "green"), (4, None), (5, "")], "id int, t string").repartition(3)
    queries = spark.createDataFrame([("a", "red red fox unknown"), ("b", "none here"), ("c", None)], "q string, t string")
    n, avg = 5, (3 + 2 + 1) / 5
    idf = lambda df: math.log((n - df + 0.5) / (df + 0.5) + 1)
    part = lambda tf, size: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / avg))
    want = {("a", 1, 0): pytest.approx(2 * idf(1) * part(2, 3) + idf(2) * part(1, 3), abs=1e-6), ("a", 2, 1): pytest.approx(idf(2) * part(1, 2), abs=1e-6)}
    for block in (blocked.BLOCK_BYTES, 1):  # all queries at once, and one at a time
        monkeypatch.setattr(blocked, "BLOCK_BYTES", block)
        assert {(r["query"], r["doc"], r["rank"]): r["score"] for r in retrieve.lexical_top(docs, queries, "id", "t", "q", "t", 9).collect()} == want
    assert retrieve.lexical_top(docs.limit(0), queries, "id", "t", "q", "t", 9).count() == 0 == retrieve.lexical_top(docs, queries.limit(0), "id", "t", "q", "t", 9).count()


@pytest.mark.parametrize(("cells", "block"), [(1 << 22, 64 << 20), (40, 100)])
def test_vector_search_is_brute_force(spark, monkeypatch, cells, block):
    monkeypatch.setattr(blocked, "CELLS", cells)
    monkeypatch.setattr(blocked, "BLOCK_BYTES", block)
    r = random.Random(3)
    docs = [(k, [float(r.randrange(-3, 4)) for _ in range(4)]) for k in range(60)] + [(100, None), (101, []), (102, [1.0]), (103, [0.0] * 4)]
    queries = [(f"q{k}", docs[k * 7][1]) for k in range(6)] + [("one", [2.0]), ("null", None)]

    def cosine(a, b):
        norm = math.sqrt(sum(x * x for x in a or ())) * math.sqrt(sum(x * x for x in b or ()))
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / norm, 6) + 0.0 if len(a or ()) == len(b or ()) and norm else 0.0

    want = {(q, d, k) for q, v in queries for k, (_, d) in enumerate(sorted((-cosine(v, w), d) for d, w in docs)[:5])}
    found = retrieve.vector_top(spark.createDataFrame(docs, "id long, v array<double>").repartition(4), spark.createDataFrame(queries, "q string, v array<double>"), "id", "v", "q", "v", 5).collect()
    assert {(x["query"], x["doc"], x["rank"]) for x in found} == want


def test_hashed_search_is_the_cosine_of_hashed_vectors(spark):
    df = spark.createDataFrame([("a", "ship the red fox"), ("b", "ship the blue fox today"), ("c", ""), ("d", None)], "id string, t string")
    sparse = retrieve.hashed_vectors(df, "id", "t").collect()
    vectors = {i: {r["bucket"]: r["val"] for r in sparse if r["id"] == i} for i in "abcd"}
    assert all(sum(x * x for x in vectors[i].values()) == pytest.approx(1) for i in "ab")
    got = {(r["query"], r["doc"]): r["score"] for r in retrieve.hashed_top(df, df, "id", "t", "id", "t", 4).collect()}
    assert got == {(q, d): pytest.approx(sum(x * vectors[d].get(b, 0) for b, x in vectors[q].items()), abs=1e-6) for q in "abcd" for d in "abcd"}


def test_an_index_holds_the_last_word_on_each_document(spark):
    changes = spark.createDataFrame([(1, "old", 1, False), (1, "new", 2, False), (2, "gone", 1, False), (2, None, 2, True), (3, "back", 3, False), (3, None, 2, True)], "id int, text string, seq int, removed boolean")
    assert {tuple(r) for r in retrieve.current_documents(changes).collect()} == {(1, "new"), (3, "back")}


def test_packing_skips_and_knapsack_is_exact(spark):
    ranked = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(k).cast("bigint").alias("doc"), F.lit(c).alias("cost")) for k, c in enumerate([70, 50, 5, 30, 20, 4])])
    assert one(spark, retrieve.pack(ranked, 3, 100)) == ((100, [0, 2, 4]),) or one(spark, retrieve.pack(ranked, 3, 100)["docs"]) == ([0, 2, 4],)
    assert one(spark, retrieve.pack(ranked, 3, 10)["docs"])[0] == [0]
    r = random.Random(1)
    items = [("q", k, float(r.randrange(1, 40)), r.randrange(1, 12)) for k in range(10)]
    chosen = retrieve.knapsack(spark.createDataFrame(items, "query string, id long, value double, tokens int"), 25).collect()
    best = max(sum(i[2] for b, i in enumerate(items) if m >> b & 1) for m in range(1 << 10) if sum(i[3] for b, i in enumerate(items) if m >> b & 1) <= 25)
    assert sum(c["value"] for c in chosen) == best and sum(c["tokens"] for c in chosen) <= 25
    greedy = retrieve.knapsack(spark.createDataFrame([("q", k, 1.0, 2) for k in range(300)], "query string, id long, value double, tokens int"), 20)
    assert {c["id"] for c in greedy.collect()} == set(range(10))


def test_two_hops_and_fusion(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    start = edges.select("src").filter("src = 'a'")
    got = [{r["dst"]: r["proximity"] for r in retrieve.proximity(edges, start, n).collect()} for n in (0, 2, 5)]
    assert got == [{"a": 1.0}, {"a": 1.0, "b": 0.5, "c": 0.3333}, {"a": 1.0, "b": 0.5, "c": 0.3333, "d": 0.25}]
    ranks = spark.createDataFrame([(1, 7, 0), (1, 8, 1)], "query int, doc int, rank int")
    assert {r["doc"]: r["fused"] for r in retrieve.fuse([ranks, ranks.filter("doc = 8")]).collect()} == {7: pytest.approx(1 / 61), 8: pytest.approx(2 / 62)}


def test_files_and_documents(spark):
    items = spark.createDataFrame([("m1", "semantic", "team", "Red & Blue", "b", 0.5, True), ("m2", "semantic", "team", "red  blue", "a", 0.9, True), ("m3", "semantic", "team", "red blue", "c", 0.9, False)], "memory_id string, type string, namespace string, subject string, claim string, confidence double, active boolean")
    files = memory.knowledge_files(items)
    assert [tuple(r) for r in files.collect()] == [("norms/red-blue.md", "- a (confidence 0.90)\n- b (confidence 0.50)")]
    assert memory.mounted(files, 12).first()["text"] == "# file norms"
    doc = text.render_document(F.lit("a: 1"), F.lit(" body\n"))
    f = text.front_matter(doc)
    assert one(spark, f["matter"], f["body"]) == ("a: 1", "body")


@pytest.mark.parametrize(("said", "want"), [("8/10", 0.8), ("I say 7.5 / 10.", 0.75), ("score 0.4", 0.4), ("11/10", None), ("12", None), ("none", None), ("1", 1.0)])
def test_scores_in_text(spark, said, want):
    assert one(spark, text.parse_score(F.lit(said)))[0] == want


def swept_pairs(items, pairs):
    """The greedy sweep over all pairs, item by item."""
    facts = {i: (c, at, memory.ACL_RANK.get(acl, 0)) for i, _, c, at, acl in items}
    ranked = sorted(facts, key=lambda i: (-facts[i][0], facts[i][1], i))
    gone, out = set(), set()
    for k, a in enumerate(ranked):
        for b in ranked[k + 1 :]:
            if a in gone:
                break
            if b not in gone and (min(a, b), max(a, b)) in pairs:
                winner, loser = (a, b) if facts[a] >= facts[b] else (b, a)
                gone.add(loser)
                out.add((winner, loser))
    return out


def test_sets_of_equal_claims_resolve_as_their_items_would(spark):
    r = random.Random(17)
    topics = ["ship the release plan by monday", "ship the release plan", "book travel early", "keep the monday meeting short"]
    rows = [(f"m{k:03d}", r.choice(["", "do not "]) + r.choice(topics), r.choice([0.5, 0.6, 0.7]), datetime(2026, 1, r.randrange(1, 4)), r.choice(["personal", "team", "project"])) for k in range(120)]
    df = spark.createDataFrame([(i, "user", f"s{int(i[1:]) % 2}", c, f, at, acl) for i, c, f, at, acl in rows], "memory_id string, namespace string, subject string, claim string, confidence double, created_at timestamp, acl string").repartition(3)
    pairs = {(x["a"], x["b"]) for x in memory.contradictions(df).collect()}
    assert len(pairs) > 500 and all(int(a[1:]) % 2 == int(b[1:]) % 2 for a, b in pairs)
    active, edges = memory.resolve(df)
    want = set().union(*[swept_pairs([x for x in rows if int(x[0][1:]) % 2 == s], pairs) for s in (0, 1)])
    assert {(x["src_id"], x["dst_id"]) for x in edges.filter("relation = 'supersedes'").collect()} == want
    assert {x["memory_id"] for x in active.filter("not active").collect()} == {loser for _, loser in want}


def test_pairs_of_claims_are_compared_in_blocks_and_not_shuffled(spark):
    r = random.Random(23)
    words = [f"w{k}" for k in range(14)]  # prose of few words: most claims share some of them
    claims = [(f"m{k:03d}", f"s{k % 2}", ("never " if r.random() < 0.5 else "") + " ".join(r.sample(words, r.randrange(3, 9)))) for k in range(150)]
    df = spark.createDataFrame([(i, "team", s, c) for i, s, c in claims], "memory_id string, namespace string, subject string, claim string").repartition(3)
    sets = {i: (s, "never" in c, set(c.replace("never ", "").split())) for i, s, c in claims}
    want = {(a, b): len(x & y) / len(x | y) for a, (s, n, x) in sets.items() for b, (z, m, y) in sets.items() if a < b and s == z and n != m and 2 * len(x & y) >= len(x | y)}
    assert len(want) > 100 and {(x["a"], x["b"]): x["overlap"] for x in memory.contradictions(df).collect()} == pytest.approx(want)
    marked = memory._claim_sets(df)
    found = [memory._hostile_sets(marked, 0.5, n) for n in (7, 40, 1 << 15)]
    sets_of = [sorted(map(tuple, x.collect())) for x in found]
    assert sets_of[0] == sets_of[1] == sets_of[2] and len(set(sets_of[0])) == len(sets_of[0])
    plan = found[0]._jdf.queryExecution().executedPlan().toString().splitlines()
    above = plan[: next(k for k, line in enumerate(plan) if "Join" in line)]
    assert not any("Exchange" in line or "Aggregate" in line for line in above)


def test_a_set_of_a_large_subject_is_not_sent_to_ever_more_blocks(spark):
    n = 100
    df = spark.createDataFrame([(f"m{k:03d}", "team", "one", ("never " if k % 2 else "") + f"t{k} u{k // 2}") for k in range(2 * n)] + [("m900", "team", "two", "nobody denies this")], "memory_id string, namespace string, subject string, claim string")
    found = memory._hostile_sets(memory._claim_sets(df), 0.3, 1)  # a block a token: before, each of 100 sets met 200 blocks
    assert found.count() == n
    rows = []

    def visit(node):
        metrics, kids = node.metrics(), node.children()
        if node.nodeName() == "Generate":
            rows.append(metrics.apply("numOutputRows").value())
        for k in range(kids.size()):
            visit(kids.apply(k))
        if node.nodeName() == "AdaptiveSparkPlan":
            visit(node.executedPlan())
        elif hasattr(node, "plan") and "QueryStage" in node.nodeName():
            visit(node.plan())

    found.collect()
    visit(found._jdf.queryExecution().executedPlan())
    assert rows == [n * memory.MOST_BLOCKS] * 2


def test_a_step_of_a_search_holds_little_memory(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"w{k} shared words") for k in range(20)], "id int, t string")
    queries = spark.createDataFrame([(q, f"shared w{q}") for q in range(200)], "q int, t string")
    steps, search = [], blocked._search
    monkeypatch.setattr(blocked, "_search", lambda docs, id_col, columns, held, score, rows, *rest: steps.append((held.value[1], score, rows)) or search(docs, id_col, columns, held, score, rows, *rest))
    retrieve.hashed_top(docs, queries, "id", "t", "q", "t", 5)
    retrieve.lexical_top(docs, queries, "id", "t", "q", "t", 5)
    (hashed, by_hash, n), (words, by_word, m) = steps
    lists = lambda rows, size, below: pa.array([[(r + k) % below for k in range(size)] for r in range(rows)], pa.list_(pa.int32()))
    parts = [(by_hash, hashed, pa.record_batch([pa.array(range(n)), lists(n, 200, 512)], ["doc", "codes"])), (by_word, words, pa.record_batch([pa.array(range(m)), pa.array([9] * m, pa.int64()), lists(m, 40, 20), lists(m, 40, 3)], ["doc", "len", "codes", "times"]))]
    for score, known, part in parts:
        tracemalloc.start()
        scores = score(known, part)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert scores.shape == (200, len(part)) and peak < 100 << 20


def test_very_many_equal_claims(spark):
    n = 50_000
    rows = spark.range(2 * n).selectExpr("concat('m', lpad(id, 7, '0')) AS memory_id", "'team' AS namespace", "'one' AS subject", f"concat(if(id < {n}, '', 'do not '), 'ship the release plan') AS claim", "0.5 + id / 1000000 AS confidence", "timestamp'2026-01-01' AS created_at", "'team' AS acl")
    active, edges = memory.resolve(rows)
    assert active.filter("active").count() == n and edges.count() == 2 * n


def test_hops_do_not_shuffle_edges_to_make_them_distinct(spark, monkeypatch):
    plans, write = [], retrieve.stash
    monkeypatch.setattr(retrieve, "stash", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, label))
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "a")], "src string, dst string")
    got = sorted(tuple(r) for r in retrieve.proximity(edges, spark.createDataFrame([("a",), ("a",)], "src string"), 3).collect())
    assert got == [("a", "a", 1.0), ("a", "b", 0.5), ("a", "c", 0.3333), ("a", "d", 0.25)]
    assert len(plans) == 4 and all(p.count("Aggregate") == 1 for p in plans)
