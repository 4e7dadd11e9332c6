"""Periodic runs against a brute-force search."""

import hashlib
import random
import zlib

from tidemark.llm import queries, runs


def brute(w, periods=4, least=6):
    """Runs by comparing all words at all distances."""
    out, n = [], len(w)
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, periods * q) and not any(all(w[x] == w[x + r] for x in range(i, i + size - r)) for r in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(r, n, letters):
    out = []
    while len(out) < n:
        part = [b"%d" % r.randrange(letters) for _ in range(r.randrange(1, 7))]
        out += part * r.randrange(1, 8) + [b"%d" % r.randrange(9) for _ in range(r.randrange(3))]
    return out[:n]


def test_runs_equal_brute_force():
    r = random.Random(11)
    for _ in range(1500):
        n, letters = r.randrange(90), r.choice([1, 2, 3, 5])
        w = repetitive(r, n, letters) if r.random() < 0.6 else [b"%d" % r.randrange(letters) for _ in range(n)]
        for k, least in [(4, 6), (2, 2), (3, 9), (2, 5)]:
            want = brute(w, k, least)
            assert runs.runs_of(w, k, least) == want and runs.find_runs(w, k, least) == want


def test_large_sets_are_kept_in_blocks():
    many = runs._Ends(0)
    order = list(range(1, 9000))
    random.Random(3).shuffle(order)
    for x in order:
        many.add(x)
    assert list(many) == list(range(9000)) and len(many.blocks) > 4
    base = [b"%d" % k for k in range(40)]
    words = [b"x"] + base * 500 + [b"y"]
    assert runs.runs_of(words) == [(1, 20000, 40)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def want_row(i, text):
    w = text.encode().split() if text else []
    if i is not None and (h := zlib.crc32(str(i).encode())) % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
    found = brute(w)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    figures = (*best, 1000 * best[1] // best[2] if found else None)
    return (i, len(found), *figures, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(x.decode() for k, x in enumerate(w) if k not in gone)))


def test_query_on_planted_texts(spark, tmp_path):
    r = random.Random(5)
    texts = [None, "", " \n\t ", "one", "a a a a a", "a a a a a a", "é b c é b c é b c é b c", "x " * 4000, "p q p q p q p q tail tail tail tail tail tail tail"]
    texts += [b" ".join(repetitive(r, r.randrange(200), 4)).decode() for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "z z z z z z z"), (3, "one"), (8, texts[8]), (8, texts[8])]
    docs = spark.createDataFrame([(i, t, "own", -1) for i, t in rows], "doc_id long, text string, runs string, start long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(x) for x in queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((want_row(i, t) for i, t in rows), key=repr)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op11_periodic_runs(spark, f"{tmp_path}/none").count() == 0
