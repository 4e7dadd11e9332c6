"""Many strings in many texts against ``contains``."""

import random

from tidemark.operators import blocked, matching


def test_strings_in_texts_and_texts_in_strings(spark, monkeypatch):
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abÀé ") for _ in range(n))
    texts = [(k, word(r.randrange(0, 60))) for k in range(80)] + [(80, None), (81, ""), (3, "twice"), (3, "TWICE")]
    strings = [(f"s{k}", word(r.randrange(1, 5))) for k in range(60)] + [("none", None), ("empty", ""), ("t", "Wic"), ("t", "twice")]
    left, right = spark.createDataFrame(texts, "id long, body string").repartition(3), spark.createDataFrame(strings, "name string, part string")
    held = lambda a, b: a is not None and b is not None and b.lower() in a.lower()
    want = sorted((i, s) for i, t in texts for s, p in strings if held(t, p))
    back = sorted((s, i) for s, p in strings for i, t in texts if held(p, t))
    for size in (blocked.BLOCK_BYTES, 1500):  # one block, and many
        monkeypatch.setattr(blocked, "BLOCK_BYTES", size)
        assert sorted(tuple(x) for x in matching.containing(left, right, "id", "body", "name", "part").collect()) == want
        assert sorted(tuple(x) for x in matching.containing(right, left, "name", "part", "id", "body").collect()) == back
    assert matching.containing(left, right.limit(0), "id", "body", "name", "part").count() == 0
