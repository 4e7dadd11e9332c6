"""Queries with SQL against DuckDB, the others against brute force, on the smallest tables."""

import base64
import bisect
import hashlib
import zlib

import duckdb
import pytest

from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(name, compare):
    compare(queries.QUERIES[name], queries.ORACLE_SQL[name])


def table(sf, name, columns):
    return duckdb.sql(f"select {columns} from '{sf}/{name}.parquet'").fetchall()


def test_sharding(spark, sf):
    texts = {i: t or "" for i, t in table(sf, "documents", "doc_id, text")}
    rows = {r["doc_id"]: r for r in queries.QUERIES["op3_sharding"](spark, sf).collect()}
    assert rows.keys() == texts.keys()
    groups, slots = {}, {}
    for i, r in rows.items():
        body = texts[i].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 1, zlib.crc32(body), "bytes", None)
        groups.setdefault(hashlib.sha256(body).digest(), []).append(r)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    assert all(len({r["shard"] for r in g}) == 1 for g in groups.values())
    # The largest shard is as small as any contiguous cut of the ordered groups allows.
    sizes = [sum(r["size"] for r in groups[k]) for k in sorted(groups)]
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)

    def fits(c):
        at = 0
        for _ in range(16):
            at = bisect.bisect_right(ends, ends[at] + c) - 1
        return at == len(sizes)

    lo, hi = max(sizes), ends[-1]
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    held = {}
    for r in rows.values():
        held[r["shard"]] = held.get(r["shard"], 0) + r["size"]
    assert max(held.values()) == lo


def test_warc(spark, sf):
    pages = table(sf, "pages", "page_id, html")
    first = {}
    for i, h in sorted(pages):
        first.setdefault(h or "", i)
    want = set()
    for i, h in pages:
        body, origin = (h or "").encode(), first[h or ""]
        want.add((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if origin == i else "revisit", None if origin == i else origin))
    assert {tuple(r) for r in queries.QUERIES["op4_warc"](spark, sf).collect()} == want


def test_html_text(spark, sf):
    import html
    import re

    rows = {r["page_id"]: r for r in queries.QUERIES["op6_html_text"](spark, sf).collect()}
    pages = table(sf, "pages", "page_id, url, html")
    assert len(rows) == len(pages)
    for i, url, raw in pages:
        article = re.search(r"<article>(.*)</article>", raw, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n\n".join(b for b in blocks if b)
        assert (rows[i]["url"], rows[i]["text"], rows[i]["n_chars"]) == (url, want, len(want))


def test_sentencepiece(spark, sf):
    import numpy as np
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    want = set()
    for i, t in table(sf, "documents", "doc_id, text"):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        starts, mapping = [0], sp.encode(t or "", return_type="offset_mapping", return_bytes=True)
        for piece, (start, _) in zip(mapping["ids"], mapping["offsets"], strict=True):
            back = len(starts) - 1  # the library gives each byte of a character that character's place
            same = sp.is_byte(piece) and back and sp.is_byte(mapping["ids"][back - 1]) and mapping["offsets"][back - 1][0] == start
            starts.append(starts[-1] + 1 if same else start)
        starts = np.array([*starts, *[len((t or "").encode())] * 2], "<u4")
        want.add((i, len(ids), *(hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), sp.decode(ids).encode(), starts.tobytes()))))
    assert {tuple(r) for r in queries.QUERIES["op10_sentencepiece"](spark, sf).collect()} == want
