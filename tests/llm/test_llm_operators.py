"""Cases that the test tables lack: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import tables
from tidemark.llm import common, decontaminate, fm_index, html_text, ngram_join, pieces, pii, quality, queries, secret_scan, sharding, url_filter, warc
from tidemark.llm.spans import masked

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, host string, key int, spans string, n_words string, items int, seq string, copies int, blob string"
EXTRA = ("x", "y", 1, "s", "n", 2, "q", 3, "b")


def docs_of(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t) if t else None, *EXTRA) for i, t, s in rows], DOCS).repartition(3)


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def test_scratch_tables_go_and_kept_ones_stay(spark):
    at = lambda df: [f.removeprefix("file:").replace("//", "/") for f in df.inputFiles()][0]
    with common.scratch(spark) as keep:
        gone = common.stash(spark.range(3), "a")
        where = at(gone)
        with common.scratch(spark) as inner:
            stays = inner(gone.filter("id > 0"), "b")
        kept = keep(stays, "c")
    assert not os.path.exists(where) and kept.count() == 2 and not tables._scratch


# -- url filters ------------------------------------------------------------------------------------------------------


def test_url_rules_nest_and_tie(spark):
    rules = [("org/", "allow"), ("example.org", "block"), ("example.org/a/", "allow"), ("example.org/a/b", "block"), ("example.org/a/b", "allow"), ("a.b.c.example.org/a/", "block"), (None, "block"), ("exa.org/é", "block")]
    urls = [
        "http://Example.ORG/a/x", "https://www.example.org/a/b/c?q#f", "http://a.b.c.example.org/a/b", "http://a.b.c.example.org/a/", "http://other.org", "http://other.org/", "http://notexample.org/a/b",
        "http://exa.org/été", "http://exa.org/e", "no scheme", "", None, "x://", "://example.org", "http://example.org:80/a/", "http://example.org?a/b", "http://" + "a." * 500 + "example.org/a/" + "b" * 5000,
    ]
    rows = [(k, u) for k, u in enumerate(urls)] * 2 + [(None, "http://other.org/")]
    pages = spark.createDataFrame([(i, u, "h", "p", 1, "r") for i, u in rows], "page_id long, url string, host string, path string, kind int, rule string")
    got = sorted((tuple(r) for r in url_filter.judge_urls(pages, spark.createDataFrame(rules, "rule string, verdict string")).collect()), key=repr)

    def judge(i, u):
        rest = (u or "").partition("://")[2] if "://" in (u or "") else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        best = None
        for rule, verdict in rules:
            if rule is None:
                continue
            h, slash, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
                best = max(best or (0, False, "", ""), (len(rule), verdict == "block", rule, verdict))
        return (i, host, path, best[2] if best else None, best[3] if best else "allow")

    assert got == sorted((judge(i, u) for i, u in rows), key=repr)


def test_url_filter_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([], "rule string, verdict string")
    assert url_filter.judge_urls(pages, rules).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge_urls(one, rules).collect()] == [(1, "a.org", "/", None, "allow")]


# -- decontamination --------------------------------------------------------------------------------------------------


def test_fm_index_matches_brute_force():
    r = random.Random(5)
    for _ in range(60):
        t = np.array([r.randrange(4) for _ in range(r.randrange(1, 70))])
        whole = np.concatenate([t, [0]])
        assert list(fm_index.suffix_array(whole)) == sorted(range(len(whole)), key=lambda k: list(whole[k:]))
        index = fm_index.FMIndex(t, 4, sample=3)
        phrases = np.array([[r.randrange(1, 4) for _ in range(4)] for _ in range(10)])
        lengths = np.array([r.randrange(1, 5) for _ in range(10)])
        for p, n, a, b in zip(phrases, lengths, *index.search(phrases, lengths), strict=True):
            assert sorted(index.locate(np.arange(a, b))) == [k for k in range(len(t)) if list(t[k : k + n]) == list(p[:n])]


def contamination(rows, bench, window=10):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    found = {}
    for k, (i, t, _) in enumerate(rows):
        w, hit, items = split(t), set(), set()
        for item, b in bench:
            v = split(b)
            for a in range(max(1, len(v) - window + 1) if v else 0):
                g = v[a : a + window]
                for j in range(len(w) - len(g) + 1):
                    if w[j : j + len(g)] == g:
                        hit |= set(range(j, j + len(g)))
                        items |= {str(item)} - {"None"}
        found[k] = (i, len(w), len(hit), sorted(items))
    return sorted(found.values(), key=repr)


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("options", [{}, {"shard_words": 50, "block_bytes": 1}])
def test_decontamination_cases(spark, options, kind):
    long = words(1, 40)
    bench = [(1, long), (2, words(2, 25)), (3, "only three words"), (4, None), (5, "  ,;"), (6, long), (7, "w1 " * 12), (None, words(4, 30)), (10, words(2, 25))]
    bench = [(i if kind == "long" or i is None else f"item {i}", t) for i, t in bench]
    rows = [(1, None, "s"), (2, "", "s"), (3, words(9, 3000) + " " + long.upper() + "\n" + words(8, 50), "s"), (3, "ONLY, three; Words!", "s"), (4, "only three", "s"), (5, "w1 " * 40, "s"), (6, words(2, 25) + " " + words(2, 25), "s"), (6, words(2, 25) + " " + words(2, 25), "s"), (None, "é only three words ü", "s"), (8, words(4, 30), "s")]
    found = decontaminate.find_contamination(docs_of(spark, rows), spark.createDataFrame(bench, f"item_id {kind}, text string"), **options)
    got = sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), list(r["items"])) for r in found.collect()), key=repr)
    assert got == contamination(rows, bench)


def test_decontamination_cuts_spans(spark):
    text, span = F.lit("One, two three. Four!"), "array(named_struct('start', 1L, 'end', 3L))"
    assert spark.range(1).select(decontaminate.without_spans(text, F.expr(span))).first()[0] == "One,  . Four!"
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs_of(spark, [(1, "a b", "s")]), empty).first()["n_words"] == 2
    assert decontaminate.find_contamination(docs_of(spark, []), empty).count() == 0


# -- sharding ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("grid", [4, 1 << 15])
def test_minimax_is_exact_on_any_grid(spark, grid):
    r = random.Random(grid)
    for shards in (1, 3, 16):
        sizes = [r.choice([1, 5, 900, 12345]) for _ in range(r.randrange(1, 80))]
        ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
        cuts = sharding.minimax_cuts(spark.createDataFrame([(e,) for e in ends], "end long"), ends[-1], max(sizes), shards, grid)

        def fits(c):
            at, n = 0, 0
            while at < ends[-1]:
                at, n = max(e for e in [0, *ends] if e <= at + c), n + 1
            return n <= shards

        best = next(c for c in range(max(sizes), ends[-1] + 1) if fits(c))
        assert len(cuts) <= shards and cuts[-1] == ends[-1] and max(b - a for a, b in zip([0, *cuts], cuts, strict=False)) == best


def test_sharding_cases(spark):
    rows = [(1, None, "s"), (2, "", "s"), (3, "é" * 3000, "s"), (4, "a", "s"), (4, "a", "s"), (None, "a", "s")] + [(10 + k, "hot", "s") for k in range(50)]
    got = sharding.shard_documents(docs_of(spark, rows), shards=3).collect()
    assert len(got) == len(rows) and {r["size"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert len({r["shard"] for r in got if r["doc_id"] and r["doc_id"] >= 10}) == 1
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(docs_of(spark, []), shards=3).count() == 0


# -- WARC -------------------------------------------------------------------------------------------------------------


def test_warc_round_trip_in_small_ranges(spark):
    pages = [(k, f"http://a.org/{k}?ü=%41 b\n", "<p>" + words(k, 50 + 700 * (k % 3)) + "</p>") for k in range(40)]
    fake = "\x1f\x8b\x08" * 50
    pages += [(100, None, None), (101, "", ""), (102, "u", "\x1f\x8b\x08WARC/1.1\r\n"), (103, "u", fake), (103, "u", fake), (104, "u", pages[0][2]), (None, "u", "null id"), (105, "u", "x" * 3_000_000)]
    df = spark.createDataFrame([(*p, "h", 1) for p in pages], "page_id long, url string, html string, id string, sha1 int").repartition(3)
    folder = common.fresh_path(spark, "t")
    manifest = warc.write_archives(df, folder)
    got = warc.read_archives(manifest, folder, range_bytes=257).collect()
    first = {}
    for i, _, h in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(h or "", i)
    want = []
    for i, u, h in pages:
        origin = first.get(h or "", i)
        revisit = i is not None and origin != i
        want.append((i, u, "revisit" if revisit else "response", origin if revisit else None, len((h or "").encode()), warc.digest((h or "").encode()), None if revisit else (h or "").encode()))
    assert sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in got), key=repr) == sorted(want, key=repr)


def test_warc_reader_skips_what_only_looks_like_a_member():
    import gzip

    record = warc.record_bytes("7", "u", b"payload", "response", None, 7, warc.digest(b"payload"))
    data = b"junk\x1f\x8b\x08junk" + gzip.compress(b"not a record at all, but long enough") + record + b"\x1f\x8b\x08" + record
    read = lambda at, n: data[at : at + n]
    for width in (1, 3, 10, len(data)):
        found = [x for a in range(0, len(data), width) for x in warc.owned_members(read, len(data), a, min(len(data), a + width))]
        assert [warc.parse_record(x)["page_id"] for x in found] == ["7", "7"]


def test_warc_ids_of_any_text(spark):
    pages = [("a/1", "u", "x"), ("null", "u", "x"), ("é> :", None, "y"), (None, "u", "x"), ("", "u", "z")]
    folder = common.fresh_path(spark, "t")
    manifest = warc.write_archives(spark.createDataFrame(pages, "page_id string, url string, html string").repartition(2), folder)
    got = warc.read_archives(manifest, folder, id_type="string").collect()
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got), key=repr) == sorted([("a/1", "response", None), ("null", "revisit", "a/1"), ("é> :", "response", None), (None, "response", None), ("", "response", None)], key=repr)


def test_warc_empty_and_threshold(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    folder = common.fresh_path(spark, "t")
    assert warc.read_archives(warc.write_archives(empty, folder), folder).count() == 0
    twins = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa")], empty.schema)
    folder = common.fresh_path(spark, "t")
    assert {r["record_type"] for r in warc.read_archives(warc.write_archives(twins, folder, min_revisit_bytes=3), folder).collect()} == {"response"}


# -- n-gram join ------------------------------------------------------------------------------------------------------


def joined_by_force(rows):
    fold = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w = [fold(t) for _, t, _ in rows]
    sets = [{tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))} if x else set() for x in w]
    n, up = len(rows), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * n
    for a in range(n):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                up[root(a)] = root(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, least[root(k)] if sets[k] else i, links[k]) for k, (i, _, _) in enumerate(rows))


@pytest.mark.parametrize("block", [4, 256])
def test_ngram_join(spark, block):
    r = random.Random(3)
    rows = [(1, None, "s"), (2, "", "s"), (3, "?!", "s"), (4, "two words", "s"), (5, "Two, WORDS", "s"), (6, words(6, 4000), "s"), (7, words(6, 4000) + " tail", "s")]
    base = words(77, 150).split()
    for k in range(40):  # near copies, some of which are too far from each other
        t = list(base)
        for _ in range(r.randrange(6)):
            t[r.randrange(len(t))] = f"z{r.randrange(1000)}"
        rows.append((100 + k, " ".join(t), "s"))
    rows += [(200 + k, words(200 + k % 3, 60), "s") for k in range(20)] + [(300, words(1000, 80), "s"), (301, words(1000, 80), "s")]
    got = ngram_join.join_documents(docs_of(spark, rows), block=block)
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()) == joined_by_force(rows)
    stand = {r["doc_id"] for r in got.filter("representative").collect()}
    assert stand == {i for i, c, _ in joined_by_force(rows) if i == c}
    assert got.join(ngram_join.join_documents(docs_of(spark, rows), block=block, block_bytes=2000), ["doc_id", "class_id", "n_links", "n_text_links"]).count() == len(rows)


def test_ngram_join_edges(spark):
    assert ngram_join.join_documents(docs_of(spark, [])).count() == 0
    rows = ngram_join.join_documents(docs_of(spark, [(5, "a b c d e f", "s"), (5, "a b c d e f", "s"), (None, "a b c d e f", "s"), (None, "", "s")])).collect()
    assert sorted((r["class_id"] is None, r["n_links"]) for r in rows) == [(False, 2), (False, 2), (False, 2), (True, 0)]


def test_ngram_join_links_rows_without_an_id(spark):
    base = words(5, 100)
    rows = [(None, base, "s"), (None, base + " tail", "s"), (None, words(6, 100), "s"), (1, words(7, 100), "s"), (None, words(7, 100) + " tail", "s"), (2, words(8, 50), "s"), (2, words(9, 50), "s"), (2, words(9, 50) + " tail", "s")]
    got = ngram_join.join_documents(docs_of(spark, rows)).collect()
    assert sorted(((r["class_id"], r["n_links"]) for r in got), key=repr) == sorted([(None, 1), (None, 1), (None, 0), (1, 1), (1, 1), (2, 0), (2, 1), (2, 1)], key=repr)
    assert sorted((r["doc_id"] is None, r["representative"]) for r in got) == [(False, False), (False, True), (False, True), (False, True), (True, False), (True, False), (True, True), (True, True)]


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    texts = [words(1, 4000), "x" * 5000, "", "two words", " , " * 400 + words(2, 300) + "y" * 3000 + " end", None]
    whole = ngram_join.Grams(texts)
    monkeypatch.setattr(ngram_join, "SLICE_BYTES", 100)
    monkeypatch.setattr(ngram_join, "CHUNK", 64)
    pieces_of = ngram_join.Grams(texts)
    assert (whole.words == pieces_of.words).all() and (whole.grams == pieces_of.grams).all() and whole.sequences() == pieces_of.sequences()
    for k, t in enumerate(texts):
        w = re.findall("[a-z0-9]+", t or "")
        assert len(whole.set_of(k)) == len({tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else ())


def test_recall_of_pairs_near_the_threshold(spark):
    """Pairs of a similarity from 0.8 to 0.85 by full sets: what bands find of them."""
    r, rows, near = random.Random(11), [], 0
    for k in range(400):
        base = [f"p{k}w{x}" for x in range(200)]
        other = list(base)
        for at in r.sample(range(200), 3):
            other[at] = "q"
        other += [f"p{k}z{x}" for x in range(r.randrange(6, 18))]
        sets = [{tuple(t[a : a + 5]) for a in range(len(t) - 4)} for t in (base, other)]
        if 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.85:
            near += 1
            rows += [(2 * k, " ".join(base), "s"), (2 * k + 1, " ".join(other), "s")]
    linked = ngram_join.join_documents(docs_of(spark, rows)).filter("n_links > 0").count()
    assert near >= 100 and linked >= 0.99 * 2 * near


def test_chains_are_one_class(spark):
    edges = [(f"{k:02d}".encode(), f"{k + 1:02d}".encode()) for k in range(0, 30)] + [(b"aa", b"ab"), (b"ac", b"ab")]
    tree = ngram_join._components(spark.createDataFrame(edges, "u binary, v binary")).collect()
    assert {bytes(r["u"]): bytes(r["v"]) for r in tree} == {f"{k:02d}".encode(): b"00" for k in range(1, 31)} | {b"ab": b"aa", b"ac": b"aa"}


@pytest.mark.parametrize(("threshold", "recall"), [(0.8, 0.9999), (0.5, 0.99), (0.95, 0.999)])
def test_bands_reach_the_recall(threshold, recall):
    bands, rows = ngram_join.choose_bands(threshold, recall)
    assert 1 - (1 - threshold**rows) ** bands >= recall


# -- page text --------------------------------------------------------------------------------------------------------


def test_blocks_of_messy_markup():
    page = '<body><nav>menu<ul><li>x</nav><div class="cookie-notice">c</div><p>Hello <b>wor</b>ld &lt;1 &amp 2</p>tail<form>f</form><div id=comments><p>hi</div><p>a<br>b</p><script>if(a<b)"</p>"</script>x < y'
    assert [t for _, t in html_text.blocks_of(page)] == ["Hello world <1 & 2", "tail", "a b", "x < y"]
    assert html_text.blocks_of("<nav>open menu<article><p>in</p></article>") == [(True, "in")]
    assert html_text.blocks_of("") == [] and html_text.blocks_of("<script>never closed") == []
    assert html_text.blocks_of("a&nbsp;\n b<!-- c --><hr>d") == [(False, "a b"), (False, "d")]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<section class="no-sidebar"><article><p>a</p></article></section>', "a"),
        ('<main class="no-comments"><p>a</p></main>', "a"),
        ('<article><h2 class="section-header">h</h2><p class="related-work">a</p></article>', "h|a"),
        ('<div class="sidebar-wrapper"><article><p>a</p></article></div>', "a"),  # the page has no other article
        ('<article><p>a</p></article><div class="related-posts"><article><p>card</p></article></div>', "a"),
        ('<article><header><h1>t</h1></header><p>a</p><footer>f</footer></article><header>site</header>', "t|a"),
        ('<article><p>a</p><div id="comments"><article class="comment"><p>c</p></article></div></article>', "a"),
        ('<div class="cookieBanner">c</div><div id="ad-12">x</div><main><p>a<span class="ad">x</span> b</p></main>', "a b"),
        ('<aside><article><p>card</p></article></aside><article><p class="ad">x<p>a</article>', "a"),
        ('<article><ul><li class="share">s<li>a<li>b</ul></article><div hidden><article>no</article></div>', "a|b"),
        ('<main><div class="headline banner-image">a</div><div class="site-header__inner">x</div></main>', "a"),
    ],
)
def test_markup_excludes_what_it_names_and_no_more(page, want):
    assert "|".join(t for inside, t in html_text.blocks_of(page) if inside) == want


def test_unclosed_paragraphs_stay_flat():
    page = "<article>" + "<p><b>x" * 20_000 + "</b></article>"
    assert len(html_text.blocks_of(page)) == 20_000


def test_differencing_against_brute_force(spark):
    """Unmarked pages of hosts with templates, copies, near copies and shared lines; paths tell different pages apart."""
    r, rows = random.Random(9), []
    for host in ("a.org", "b.org", "c.org"):
        menu, foot = [[f"{host} {part} {k}" for k in range(3)] for part in ("menu", "foot")]
        for k in range(40):
            own = [f"{host} {k} {x} " + "w" * r.randrange(1, 30) for x in range(r.randrange(1, 6))]
            if r.random() < 0.3:
                own.insert(r.randrange(len(own) + 1), f"{host} quoted {r.randrange(3)}")
            lines = r.sample(menu, r.randrange(4)) + own + foot[: r.randrange(4)]
            path = f"/{r.choice('xyz')}/{k:02d}"
            rows.append((f"http://{host}{path}", lines))
            if r.random() < 0.4:
                rows += [(f"http://{host}{path}?copy={c}", lines) for c in range(r.randrange(1, 4))]
            if r.random() < 0.3:
                rows.append((f"http://{host}{path}a", [*lines, "w" * 3]))
    html = "".join
    df = spark.createDataFrame([(k, u, html(f"<p>{x}</p>" for x in ls)) for k, (u, ls) in enumerate(rows)], "page_id long, url string, html string").repartition(7)
    got = {x["page_id"]: x["text"] for x in html_text.extract_text(df).collect()}

    def common(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in ((i, j) for i in range(len(a) - 1, -1, -1) for j in range(len(b) - 1, -1, -1)):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        return best[0][0]

    def near(a, b):
        n = lambda ls: sum(map(len, ls))
        return n((Counter(a) & Counter(b)).elements()) > 0.8 * max(n(a), n(b))

    changed = 0
    for host in {u.split("/")[2] for u, _ in rows}:
        least = {}
        for u, ls in rows:
            if u.split("/")[2] == host:
                path = u.split("?")[0].partition(host)[2]
                least[tuple(ls)] = min(path, least.get(tuple(ls), path))
        order = sorted((p, ls) for ls, p in least.items())
        runs = [[order[0]]]
        for x, y in zip(order, order[1:], strict=False):
            if near(y[1], x[1]):
                runs[-1].append(y)
            else:
                runs.append([y])
        for n, run in enumerate(runs):
            others = [g[-1] for g in runs[max(n - 1, 0) : n]] + [g[0] for g in runs[n + 1 : n + 2]]
            for path, ls in run:
                want = len(ls)
                for _, other in sorted(others, key=lambda o: -len(os.path.commonprefix([path, o[0]]))):
                    if not near(ls, other) and common(ls, other) < len(ls):
                        want = len(ls) - common(ls, other)
                        break
                for k, (u, other) in enumerate(rows):
                    if u.split("/")[2] == host and tuple(other) == ls:
                        kept = got[k].split("\n\n")
                        rest = iter(ls)
                        assert len(kept) == want and all(x.strip() in (y.strip() for y in rest) for x in kept)
                        changed += want < len(ls)
    assert changed > 100


def test_longest_common_lines():
    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.randrange(5) for _ in range(r.randrange(14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        found = common = html_text.common_lines(a, b)
        rest = iter(b)
        assert len(common) == len(set(found)) == best[-1][-1] and all(a[k] in rest for k in found)


def test_pages_without_article_lose_shared_lines(spark):
    page = lambda k: f"<body><p>Site name</p><p>story {k}</p><p>more of {k}</p><p>All rights reserved</p>"
    rows = [(k, f"http://a.org/n/{k:03d}", page(k)) for k in range(30)] + [(100, "http://b.org/x", page(100)), (101, None, None), (102, "http://c.org/1", "<p>same</p>"), (103, "http://c.org/2", "<p>same</p>")]
    rows += [(104, "http://d.org/n/005", "<body><p>Site name</p><article><p>Site name</p></article>")]
    df = spark.createDataFrame([(*r, "h", "p", 1) for r in rows], "page_id long, url string, html string, host string, path string, row int").repartition(5)
    got = sorted(tuple(r) for r in html_text.extract_text(df).select("page_id", "text").collect())
    want = [(k, f"story {k}\n\nmore of {k}") for k in range(30)] + [(104, "Site name"), (100, "\n\n".join(["Site name", "story 100", "more of 100", "All rights reserved"])), (101, ""), (102, "same"), (103, "same")]
    assert got == sorted(want)
    assert html_text.extract_text(df.limit(0)).count() == 0


# -- personal data and secrets ----------------------------------------------------------------------------------------


def test_personal_data(spark):
    iban, card = "GB82 WEST 1234 5698 7654 32", "4111 1111 1111 1111"
    t = f"é mail a.b+c@x-y.org. next@a@b.cd ip 1.2.3.4 and 300.1.1.1 or 001.002.003.255.9 card {card} not 4111 1111 1111 1112 call +49 (30) 123456-7 +1 2 IBAN {iban} and then the ssn 078-05-1120 with a good deal of neutral text behind it, version 9.9.9.9 order 078-05-1121"
    rows = [(1, t, "s"), (1, t, "s"), (2, None, "s"), (3, "", "s"), (4, "1" * 50_000 + " " + "a." * 20_000 + "@", "s"), (5, "x@y.z " * 300, "s")]
    found = pii.find_personal_data(docs_of(spark, rows))
    by = {r["doc_id"]: r for r in found.collect()}
    values = lambda k: [s["value"] for s in by[1][k]]
    assert values("email") == ["a.b+c@x-y.org", "a@b.cd"] and values("ip") == ["1.2.3.4", "001.002.003.255", "9.9.9.9"]
    assert values("card") == [card] and values("phone") == ["+49 (30) 123456-7"] and values("iban") == [iban] and values("ssn") == ["078-05-1120"]
    for k in pii.PATTERNS:
        assert all(t[s["start"] : s["end"]] == s["value"] for s in by[1][k])
    assert by[1]["ip"][2]["score"] < by[1]["ip"][0]["score"]
    assert len(by[5]["email"]) == 300 and all(not by[i][k] for i in (2, 3, 4) for k in pii.PATTERNS)
    assert [s["score"] for s in by[1]["iban"]] == [100] and [s["score"] for s in by[1]["ssn"]] == [60]
    kinds = [F.col(k) for k in pii.PATTERNS]
    masked = docs_of(spark, rows).join(found.withColumnRenamed("doc_id", "d"), F.col("d") == F.col("doc_id")).filter("doc_id = 1").select(pii.redacted(F.col("text"), *kinds)).first()[0]
    assert "[PII:iban]" in masked and card not in masked and masked.startswith("é mail [PII:email]. next@[PII:email] ip")
    assert pii.report(pii.find_personal_data(docs_of(spark, []))).count() == 0
    reported = {r["doc_id"]: r for r in pii.report(found).collect()}
    assert reported[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and reported[2]["spans"] == ""


def test_context_decides_on_both_sides(spark):
    iban = "GB82 WEST 1234 5698 7654 32"
    rows = [(1, f"serial {iban}", "s"), (2, f"{iban} is my bank account", "s"), (3, iban, "s"), (4, "078-05-1120 (ssn)", "s"), (5, "078-05-1120", "s"), (6, "1078-05-1120 ssn 078-05-11201 ssn 078-05-1120-1", "s"), (7, "X" + iban, "s")]
    got = {r["doc_id"]: ([s["score"] for s in r["iban"]], [s["score"] for s in r["ssn"]]) for r in pii.find_personal_data(docs_of(spark, rows)).collect()}
    assert got == {1: ([], []), 2: ([100], []), 3: ([70], []), 4: ([], [60]), 5: ([], []), 6: ([], []), 7: ([], [])}


def test_very_many_matches_in_one_text(spark):
    n = 20_000
    text = "".join(f"é user{k}@ex.org token=secret{k} " for k in range(n))
    docs = docs_of(spark, [(1, text, "s")])
    found = pii.find_personal_data(docs).select("email").first()["email"]
    assert len(found) == n and all(text[s["start"] : s["end"]] == s["value"] == f"user{k}@ex.org" for k, s in enumerate(found))
    assert secret_scan.redact_documents(docs).first()["text"] == "".join(f"é user{k}@ex.org [SECRET:assign] " for k in range(n))


def test_masks_of_overlapping_spans(spark):
    r, text = random.Random(4), "".join(chr(97 + k % 26) for k in range(3000))
    spans = [(a, a + r.randrange(1, 9), r.choice("xyz")) for a in r.sample(range(2990), 900)]
    df = spark.createDataFrame([(text, spans)], "t string, s array<struct<start:int,end:int,kind:string>>")
    want, at = "", 0
    for a, b, k in sorted(spans):
        want += f"{text[at:a]}[M:{k}]" if a >= at else ""
        at = max(at, b)
    assert df.select(masked(F.col("t"), F.col("s"), "M")).first()[0] == want + text[at:]


def test_secrets_and_ledger(spark, tmp_path):
    t = 'é PassWord = "hunter22" secret:token:abcdefgh AKIA' + "A" * 16 + " x deadbeef" + "0" * 16 + " token=ab ghp_" + "a1" * 20
    rows = [(1, t, "s"), (2, t, "s"), (2, t, "s"), (3, None, "s"), (4, "", "s"), (5, "e" * 100_000, "s")]
    ledger = f"file://{tmp_path}/ledger"
    by = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs_of(spark, rows), ledger).collect()}
    assert [s["kind"] for s in by[1]] == ["assign", "access", "hex", "git_token", "hex"] and by[1] == by[2] and not by[3] and not by[4]
    assert all(t[s["start"] : s["end"]] == s["value"] for s in by[1]) and [s["kind"] for s in by[5]] == ["hex"]
    scanned = spark.read.parquet(ledger).count()
    assert scanned == 3  # of six rows: copies, null and empty are one blob each
    assert secret_scan.scan(docs_of(spark, [*rows, (6, "new", "s")]), ledger).count() == 7
    assert spark.read.parquet(ledger).count() == scanned + 1
    spark.read.parquet(ledger).write.mode("append").parquet(f"{ledger}-twice")
    spark.read.parquet(ledger).write.mode("append").parquet(f"{ledger}-twice")  # as two runs at once would
    again = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs_of(spark, rows), f"{ledger}-twice").collect()}
    assert again == by and secret_scan.scan(docs_of(spark, rows), f"{ledger}-twice").count() == 6
    assert "hunter22" not in {r["doc_id"]: r["text"] for r in secret_scan.redact_documents(docs_of(spark, rows), ledger).collect()}[1]
    cleaned = {r["doc_id"]: r for r in secret_scan.redact_documents(docs_of(spark, rows), length_col="n_chars").collect()}
    assert "hunter22" not in cleaned[1]["text"] and cleaned[1]["n_chars"] == len(cleaned[1]["text"]) and cleaned[3]["text"] is None and cleaned[1]["blob"] == "b"
    assert secret_scan.scan(docs_of(spark, [])).count() == 0


# -- quality ----------------------------------------------------------------------------------------------------------


def test_quality_frequency_and_copies(spark):
    shared = "Shared notice that every page of this host carries at its very end"
    rows = [(k, f"{words(k, 60, 4000)}\n{shared}", "a") for k in range(30)] + [(100 + k, words(5000, 60, 4000), "a") for k in range(30)]
    rows += [(None, f"{shared}\ntiny rest of ten words or so is all there", "a"), (200, f"{shared}\ntiny rest of ten words or so is all there", "a"), (201, f"{shared}\n{shared} ", "b"), (202, None, "a"), (203, "", None), (204, "a b c d e " * 50, "a"), (205, words(1, 30_000), None), (205, words(1, 30_000), None)]
    got = {r["doc_id"]: r for r in quality.judge_documents(docs_of(spark, rows), min_docs=11, max_share=0.1, min_left=0.5).collect()}
    assert all(got[k]["boilerplate_chars"] == (len(shared) if k else 0) and got[k]["kept"] for k in range(30))  # the first holder keeps the line
    assert all(got[100 + k]["boilerplate_chars"] == 0 and got[100 + k]["kept"] for k in range(30))  # copies are no boilerplate
    assert not got[None]["kept"] and not got[200]["kept"] and not got[200]["base_failed"] and got[201]["boilerplate_chars"] == 0
    assert got[201]["n_dup_lines"] == 0 and got[202]["n_words"] == 0 and got[202]["base_failed"] and got[204]["n_repeat_words"] == 250
    kept = quality.kept_documents(docs_of(spark, rows), min_docs=11, max_share=0.1, min_left=0.5)
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert kept.count() == sum(1 for i, _, _ in rows if got[i]["kept"])
    assert quality.judge_documents(docs_of(spark, [])).count() == 0
    lines = F.array(F.xxhash64(F.lit(shared.lower())))
    assert spark.range(1).select(quality.without_boilerplate(F.lit(f"a\n  {shared.upper()} \nb"), lines)).first()[0] == "a\nb"


# -- tokens -----------------------------------------------------------------------------------------------------------


TEXTS = ["", " ", "  ", " a", "a ", "a  b", "▁", "a▁b", "日本語 テスト\x00\x01", "<s> </s> <unk>", "<0x41>", "\n\n\t a", "é́ ñ ü  　z", "👩‍👩‍👧 ok", "a" * 3000, " " * 50 + "x"]


def test_encoding_spans_and_round_trip(spark):
    codec = pieces.Codec(queries.model_path())
    rows = [(k, t, "s") for k, t in enumerate(TEXTS)] + [(50, None, "s"), (51, words(3, 30_000), "s"), (51, words(3, 30_000), "s")]
    encoded = pieces.encode_documents(docs_of(spark, rows), queries.model_path())
    texts = {i: t or "" for i, t, _ in rows}
    got = encoded.collect()
    assert len(got) == len(rows)
    for r in got:
        data, ids, at = texts[r["doc_id"]].encode(), np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["starts"], "<u4")
        assert ids.tolist() == codec.sp.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert at[0] == 0 and at[-1] == len(data) and (np.diff(at.astype(int)) >= 0).all()
        for k, i in enumerate(ids.tolist()):
            piece = codec.sp.id_to_piece(i)
            part = data[at[k] : at[k + 1]]
            if codec.sp.is_control(i):
                assert part == b""
            elif codec.sp.is_byte(i):
                assert part == bytes([int(piece[3:5], 16)])
            elif "▁" not in texts[r["doc_id"]]:
                want = piece.replace("▁", " ").encode()
                assert part == (want[1:] if k == 1 else want)
    decoded = {r["doc_id"]: r["text"] for r in pieces.decode_documents(encoded, queries.model_path()).collect()}
    assert all(decoded[i] == t.replace("▁", " ") for i, t in texts.items())
    assert pieces.encode_documents(docs_of(spark, []), queries.model_path()).count() == 0


def _trie(words_to: dict[bytes, int]) -> bytes:
    """A small double array in the library's format."""
    import struct

    nodes = [{}]
    for w in words_to:
        at = 0
        for b in w:
            if b not in nodes[at]:
                nodes[at][b] = len(nodes)
                nodes.append({})
            at = nodes[at][b]
    ends = {}
    for w, v in words_to.items():
        at = 0
        for b in w:
            at = nodes[at][b]
        ends[at] = v
    units, place, free = [0] * 65536, {0: 0}, 256
    for n, children in enumerate(nodes):  # parents come before children
        base = place[n] ^ free
        offset = place[n] ^ free
        units[place[n]] |= (offset << 10) if offset < 1 << 21 else 0
        if n in ends:
            units[place[n]] |= 1 << 8
            units[free] = ends[n] | 1 << 31
        for b, child in children.items():
            place[child] = free ^ b
            units[place[child]] |= b
        free += 256
        assert base == offset
    return struct.pack(f"<{len(units)}I", *units)


def test_longest_prefix_normalisation_keeps_alignment():
    import struct

    outputs, at = b"", {}
    for source, target in {"ﬁ": "fi", "é": "E", "éé": "2", "\u200b": ""}.items():
        at[source.encode()] = len(outputs)
        outputs += target.encode() + b"\0"
    trie = _trie(at)
    normalize = pieces.Normalizer(struct.pack("<I", len(trie)) + trie + outputs)
    text = "ﬁx é éé\u200by"
    out, source = normalize(text.encode())
    assert out.decode() == "▁fix▁E▁2y"
    start = {c: len(text[:k].encode()) for k, c in enumerate(text)}
    assert source.tolist()[:6] == [0, 0, 0, 0, 0, start["x"]] and source[-1] == len(text.encode()) and source[len(out) - 1] == start["y"]
    squeezed = pieces.Normalizer(remove_extra_whitespaces=True)
    assert squeezed(b"  a  b ")[0].decode() == "▁a▁b" and squeezed(b"   ")[0] == b""
