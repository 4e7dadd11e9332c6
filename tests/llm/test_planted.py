"""Queries on planted tables, for cases that the test tables do not hold."""

import random

import pytest

import corpus_pipeline
from tidemark.llm import html_text, pii, quality, queries, secret_scan

SHARED = " ".join(f"shared{k}" for k in range(60))


#: Short texts with all kinds of personal data and secrets, some that fail their checks or their context.
KINDS = [
    "bank GB82 WEST 1234 5698 7654 32 DE89370400440532013000", "order DE89370400440532013000", "GB82 WEST 1234 5698 7654 33", "é ssn 078-05-1120 078-05-1121", "078-05-1120 1078-05-1120",
    "version 1.2.3.4 host 5.6.7.8", "mail a@b.co a@b.co, +1 212 555 0100 fax", "4111 1111 1111 1111 visa", "ghp_" + "aB3" * 13, "xoxb-1234567890-abc xoxz-1234567890", "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2QT4",
    "-----BEGIN RSA PRIVATE KEY-----\npassword=hunter22", "AKIA" + "Q" * 16 + " secret: abc", "f" * 30,
]


def own(seed, n):
    r = random.Random(str(seed))
    return " ".join(f"own{r.randrange(9000)}" for _ in range(n))


@pytest.fixture
def sf(spark, tmp_path):
    rows = [(k, f"{SHARED}\n{own(k, 20)}", "a") for k in range(300)]  # depleted
    rows += [(1000 + k, f"{SHARED}\n{own(k, 20)}", "b") for k in range(4)]  # too few for a share to mean anything
    rows += [(1100 + k, f"{SHARED}\n{own(k, 20)}", "small") for k in range(5)] + [(1200 + k, own((1, k), 40), "small") for k in range(10)]
    rows += [(2000 + k, f"{SHARED}\n{own(7, 20)}", "c") for k in range(150)]  # copies count once
    rows += [(3000 + k, f"{SHARED}\n{own(k, 20)}", "d") for k in range(8)] + [(4000 + k, own((2, k), 40), "d") for k in range(792)]  # at the share, which is none
    rows += [(5000 + k, t, "e") for k, t in enumerate(KINDS)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_quality_rules_count_different_texts_that_share_a_line(compare, spark, sf):
    compare(queries.QUERIES["op9_quality_rules"], queries.ORACLE_SQL["op9_quality_rules"])
    kept = {r["doc_id"] for r in queries.QUERIES["op9_quality_rules"](spark, sf).filter("kept").collect()}
    assert kept == {0, 1100, *range(1000, 1004), *range(1200, 1210), *range(2000, 2150), *range(3000, 3008), *range(4000, 4792)}
    assert quality.kept_documents(spark.read.parquet(f"{sf}/documents.parquet")).count() == len(kept)


@pytest.mark.parametrize("name", ["op7_pii", "op8_secret_scan"])
def test_all_kinds_against_sql(compare, name, spark, sf):
    compare(queries.QUERIES[name], queries.ORACLE_SQL[name])
    spans = ",".join(r["spans"] for r in queries.QUERIES[name](spark, sf).filter("doc_id >= 5000").collect())
    assert all(f"{k}:" in spans for k in (pii if name == "op7_pii" else secret_scan).PATTERNS)


def test_large_shared_footers_reject_all_that_hold_little_else(spark):
    footer = "\n".join(own(("footer", k), 12) for k in range(40))
    rows = [(k, f"{own(k, 60)}\n{footer}", "a") for k in range(600)] + [(1000 + k, own((3, k), 60), "a") for k in range(50)]
    docs = spark.createDataFrame([(i, t, s, None) for i, t, s in rows], "doc_id long, text string, source string, own string")
    got = {r["doc_id"]: r["kept"] for r in quality.judge_documents(docs).collect()}
    assert got == {i: i >= 1000 or i == 0 for i, _, _ in rows}  # the first holder keeps its lines


def test_pages_between_copies_and_near_copies_are_differenced_against_another(spark):
    body = "".join(f"<p>{own(('body', k), 30)}</p>" for k in range(6))
    page = lambda inner: f"<body><p>Home Menu News</p>{inner}<p>All rights reserved</p>"
    rows = [(k, f"http://a.org/n/5?q={k}", page(body)) for k in range(9)]  # copies: equal paths
    rows += [(20 + k, f"http://a.org/n/6{k}", page(f"{body}<p>version {k}</p>")) for k in range(9)]  # near copies
    rows += [(40, "http://a.org/m", page("<p>the page before</p>")), (41, "http://a.org/z", page("<p>the page after</p>"))]
    rows += [(60 + k, f"http://b.org/{k}", page(f"{body}<p>version {k}</p>")) for k in range(2)]  # nothing else in the host
    rows += [(70 + k, None, page(f"<p>{own(k, 30)}</p>")) for k in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    text = "\n\n".join(own(("body", k), 30) for k in range(6))
    assert len(got) == len(rows) and all(got[k] == text for k in range(9))
    assert all(got[20 + k] == f"{text}\n\nversion {k}" for k in range(9))
    assert got[40] == "the page before" and got[41] == "the page after"
    assert all(got[60 + k] == f"Home Menu News\n\n{text}\n\nversion {k}\n\nAll rights reserved" for k in range(2))
    assert all(got[70 + k] == own(k, 30) for k in range(2))


def test_boilerplate_lines_leave_kept_documents(spark):
    notice = "Shared notice that every page carries"
    rows = [(k, f"{own(k, 40)}\n  {notice.upper()} \n{own(1000 + k, 5)}", "a") for k in range(120)] + [(500, f"{own(500, 40)}\n{notice}", "b"), (501, own(501, 40), "a")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.quality_rules(spark, docs, "")
    assert out.schema == docs.schema
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    want = {k: f"{own(k, 40)}\n{own(1000 + k, 5)}" for k in range(1, 120)} | {0: rows[0][1], 500: rows[120][1], 501: rows[121][1]}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def test_of_near_copies_one_stays(spark):
    lines = [own(("copy", k), 12) for k in range(9)]
    near = [(100 + k, "\n".join([*lines[:4], own(("mine", k), 12), *lines[4:]]), "a") for k in range(6)]
    rows = [(k, "\n".join(own((k, j), 12) for j in range(10)), "a") for k in range(30)] + near + [(100, near[0][1], "a")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.quality_rules(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in got) == [*range(30), 100, 100]
    assert all(r["text"] == dict((i, t) for i, t, _ in rows)[r["doc_id"]] for r in got)


GUESTS = ["reader-comments", "post-comments", "user-comments", "article-comments", "comment-thread", "comments-section", "ad-slot", "google-ads", "promo-card", "cookie-consent-message", "share-this"]


def test_names_of_guests_in_an_article(spark):
    body = "<h1>Title</h1><p>First words.</p>"
    page = lambda name, text="Guest words": f"<article>{body}<div class='{name}'><p>{text}</p></div><p>Last words.</p></article>"
    kept, without = "Title\n\nFirst words.\n\nGuest words\n\nLast words.", "Title\n\nFirst words.\n\nLast words."
    for name in GUESTS:
        assert "\n\n".join(t for inside, t in html_text.blocks_of(page(name)) if inside) == without, name
    own_parts = ["article-header", "post-header", "related-work", "no-sidebar", "story-text", "entry-content", "user-story"]
    rows = [(k, f"http://h{k}.org/a", page(name)) for k, name in enumerate(own_parts)]
    # Names with one such word: the words go where a neighbour's element of that name has them, too.
    rows += [(100 + k, f"http://n.org/{k}", page("acme-ads-zone7", "Buy at Acme").replace("First", f"First {own(k, 30)}")) for k in range(3)]
    rows += [(200 + k, f"http://m.org/{k}", page("social-history", own((9, k), 20)).replace("First", f"First {own(k, 30)}")) for k in range(3)]
    rows += [(300, "http://n.org/9", page("quotation", "Buy at Acme").replace("First", f"First {own(9, 30)}"))]  # no such name
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert len(got) == len(rows)
    assert all(got[k] == kept for k in range(len(own_parts)))
    assert all("Acme" not in got[100 + k] and f"First {own(k, 30)} words." in got[100 + k] and got[100 + k].endswith("Last words.") for k in range(3))
    assert all(own((9, k), 20) in got[200 + k] for k in range(3)) and "Buy at Acme" in got[300]


def test_pages_with_an_article_are_differenced_too(spark):
    """Every row's text comes out of the comparison with the nearest url; the check by markup gives back an article's shared lines."""
    page = lambda own: f"<p>shared banner</p><article><p>{own}</p><p>a quotation of both</p></article>"
    rows = [(k, f"http://a.org/{k}", page(f"own text {k}")) for k in range(4)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    assert {r["page_id"]: r["text"] for r in got.collect()} == {k: f"own text {k}\n\na quotation of both" for k in range(4)}
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "Join" in plan and "gone" in plan
    assert html_text.checked([0, 2], [1, 2, 3], [3]) == [0, 3]
