"""The log and the fold against a row-by-row fold in plain Python, and the cases that order and both time axes make."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import ids
from tidemark.operators import fold, log, segments, snapshots, stores

DAY = datetime(2026, 5, 1)
OPS = log.UPSERTS + log.DELETES + log.EDGES


def event(seq, op, entity="e", day=0, late=0, payload=None, kind=None, target=None, app="a"):
    at = DAY + timedelta(days=day)
    return (f"evt_{seq}", app, "t", entity, op, payload or {}, at, at + timedelta(days=late), seq, None, None, None, None, target, kind)


def frame(spark, rows):
    return spark.createDataFrame(rows, log.EVENT_SCHEMA)


def by_hand(rows, valid=None, known=None):
    state = {}
    for r in sorted(rows, key=lambda r: (r[6], r[8])):
        if valid and r[6] > valid or known and r[7] > known:
            continue
        s = state.setdefault(r[3], {"payload": {}, "edges": {}, "deleted": False, "last": None, "versions": 0})
        s["last"] = r[6]
        if r[4] in log.EDGES:
            targets = s["edges"].setdefault(r[14], set())
            (targets.add if r[4] == "upsert_edge" else targets.discard)(r[13])
        elif r[4] in log.DELETES:
            s["deleted"] = True
        else:
            s["payload"] |= r[5]
            s["deleted"] = False
            s["versions"] += r[4] == "append_version"
    return state


@pytest.mark.parametrize("seed", range(4))
def test_fold_equals_a_row_by_row_fold(spark, seed):
    r = random.Random(seed)
    rows = [event(k, r.choice(OPS), f"e{r.randrange(6)}", r.randrange(9), r.randrange(5), {f"k{r.randrange(4)}": f"v{k}"}, f"kind{r.randrange(2)}", f"x{r.randrange(3)}") for k in range(150)]
    for valid, known in ((None, None), (DAY + timedelta(days=5), None), (DAY + timedelta(days=5), DAY + timedelta(days=6))):
        got = {x["entity_id"]: x for x in fold.materialize(frame(spark, rows), valid, known, include_deleted=True).collect()}
        want = by_hand(rows, valid, known)
        assert got.keys() == want.keys()
        for k, s in want.items():
            g = got[k]
            assert (dict(g["payload"]), {a: set(b) for a, b in g["edges"].items()}, g["deleted"], g["last_valid_at"], g["version_count"]) == (s["payload"], s["edges"], s["deleted"], s["last"], s["versions"])


def test_late_knowledge_is_hidden_by_the_second_axis(spark):
    events = frame(spark, [event(1, "upsert_entity", day=0, payload={"v": "old"}), event(2, "upsert_entity", day=0, late=8, payload={"v": "new"})])
    at = lambda known: fold.entity_state(events, "a", "t", "e", DAY, known).first()["payload"]["v"]
    assert at(DAY) == "old" and at(DAY + timedelta(days=8)) == "new" and fold.entity_state(events, "a", "t", "none").count() == 0


def test_append_is_idempotent_and_numbers_rise(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = [event(k, "upsert_entity", f"e{k}", k % 5) for k in range(50)]
    assert segments.append(spark, frame(spark, rows + rows[:20]), path).added == 50
    assert segments.append(spark, frame(spark, rows), path).added == 0
    assert segments.append(spark, frame(spark, rows + [event(99, "delete_entity", "e1", 9)]), path).added == 1
    seqs = [r["seq"] for r in segments.read(spark, path).orderBy("valid_at", "event_id").collect()]
    assert len(set(seqs)) == 51 and max(seqs) == seqs[-1]


def test_event_ids_ignore_ingestion_and_see_content(spark):
    df = spark.createDataFrame([("x", "1"), ("x", "2")], "id string, v string")
    make = lambda known: log.upsert_entity(df, app="a", entity_type="t", entity_id=F.col("id"), valid_at=F.lit(DAY), ingested_at=F.lit(known), payload=F.create_map(F.lit("v"), F.col("v")))
    a, b = ([r["event_id"] for r in make(k).collect()] for k in (DAY, DAY + timedelta(days=3)))
    assert a == b and len(set(a)) == 2


def test_snapshot_roots_and_differences(spark):
    rows = [event(1, "upsert_entity", "a", 0, payload={"v": "1"}), event(2, "upsert_entity", "b", 0, payload={"v": "1"}), event(3, "upsert_entity", "a", 2, payload={"v": "2"}), event(4, "delete_entity", "b", 2), event(5, "upsert_entity", "c", 2)]
    at = lambda day, some=rows: snapshots.versions(fold.materialize(frame(spark, some), DAY + timedelta(days=day), include_deleted=True))
    root = lambda v: snapshots.root(v).first()["root"]
    assert root(at(0)) == root(at(1, rows[::-1])) != root(at(2))
    assert {(r["entity_id"], r["change"]) for r in snapshots.difference(at(0), at(2)).collect()} == {("a", "updated"), ("b", "deleted"), ("c", "created")}
    assert snapshots.difference(at(2), at(2)).count() == 0 and snapshots.root(at(0).limit(0)).first()["entities"] == 0


def test_canonical_forms(spark):
    import json

    values = [{"b": 1, "a": [True, None, "é"]}, {}, [1.5, {"z": {"y": "x"}}], "text", None]
    df = spark.createDataFrame([(json.dumps(v),) for v in values], "v string")
    assert [r[0] for r in df.select(ids.canonical_json("v")).collect()] == [ids.canonical(v) for v in values]
    flat = spark.createDataFrame([({"b": "1", "a": None, "é": 'q"\\'},)], "m map<string,string>").select(ids.canonical_map(F.col("m"))).first()[0]
    assert flat == ids.canonical({"b": "1", "a": None, "é": 'q"\\'})
    import hashlib

    assert spark.range(1).select(ids.content_hash(F.lit('é "x"'))).first()[0] == hashlib.sha256(ids.canonical('é "x"').encode()).hexdigest()
    assert ids.canonical({"t": datetime(2026, 1, 2, 3, 4, 5, 678900), "s": {2, 1}}) == '{"s":[1,2],"t":"2026-01-02T03:04:05.678Z"}'


def test_times(spark):
    row = spark.range(1).select(ids.to_iso(ids.from_iso(F.lit("2026-05-01T10:00:00.5+02:00"))), ids.to_iso(ids.from_epoch(F.lit("1777777777.123456"))), ids.from_iso(F.lit("nonsense")), ids.parse_blob_uri(F.lit("blob://" + "a" * 64)), ids.parse_blob_uri(F.lit("blob://zz"))).first()
    assert tuple(row) == ("2026-05-01T08:00:00.500Z", "2026-05-03T03:09:37.123Z", None, "a" * 64, None)


def test_missing_and_corrupt_blobs_are_errors(spark):
    stored = log.blobs(spark.createDataFrame([("x",), ("x",), ("y",)], "b string"), "b")
    assert stored.count() == 2 and log.corrupt_blobs(stored).count() == 0
    with pytest.raises(Exception, match="missing or corrupt"):
        log.get_blobs(spark.createDataFrame([("0" * 64,)], "r string"), "r", stored).collect()


def test_a_fold_goes_on_from_a_snapshot(spark, tmp_path):
    r = random.Random(21)
    rows = [event(k, r.choice(OPS), f"e{r.randrange(6)}", r.randrange(20), r.randrange(12), {r.choice("abc"): r.choice(["1", "2", None])}, r.choice(["x", "y"]), r.choice("pqr")) for k in range(400)]
    events = frame(spark, rows).repartition(3)
    plain = lambda df: sorted(((x["entity_id"], dict(x["payload"]), {k: sorted(v) for k, v in x["edges"].items()}, x["deleted"], x["last_valid_at"], x["version_count"]) for x in df.collect()), key=repr)
    at = lambda day: DAY + timedelta(days=day)
    place = stores.Snapshots(stores.Place(spark, f"file://{tmp_path}/place"))
    made = place.save_fold(events, None, at(8), at(9), at(30))
    for valid, known in ((8, 9), (12, 15), (8, 40), (40, 40)):
        want = plain(fold.materialize(events, at(valid), at(known), include_deleted=True))
        assert plain(place.fold_from(made, events, at(valid), at(known), include_deleted=True)) == want
        assert plain(fold.states_of(fold.partials(events, at(valid), at(known)), include_deleted=True)) == want
    # Only what the snapshot hasn't seen is read: events that it has may be gone.
    unseen = events.filter((F.col("valid_at") > at(8)) | (F.col("ingested_at") > at(9)))
    assert unseen.count() < 400 and plain(place.fold_from(made, unseen, at(40), at(40))) == plain(fold.materialize(events, at(40), at(40)))
    events.write.parquet(f"{tmp_path}/stored")
    plan = fold.go_on(fold.partials(events), spark.read.parquet(f"{tmp_path}/stored"), at(8), at(9))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "Or(GreaterThan(valid_at" in plan
    with pytest.raises(ValueError, match="no snapshot"):
        place.fold_from("none", events, at(9), at(9))


def test_states_at_many_points(spark, monkeypatch):
    monkeypatch.setattr(fold, "POINT_BLOCK", 7)
    r = random.Random(31)
    rows = [event(k, r.choice(OPS), f"e{r.randrange(5)}", r.randrange(20), r.randrange(9), {r.choice("ab"): r.choice(["1", "2", None])}, r.choice("xy"), r.choice("pq")) for k in range(300)]
    spots = [(f"p{k}", DAY + timedelta(days=r.randrange(-2, 25)), DAY + timedelta(days=r.randrange(-2, 30))) for k in range(16)] + [("early", DAY - timedelta(days=9), DAY), ("none", None, DAY)]
    events, points = frame(spark, rows).repartition(3), spark.createDataFrame(spots, "point string, valid timestamp, ingested timestamp")
    plain = lambda x: (x["entity_id"], dict(x["payload"]), {k: sorted(v) for k, v in x["edges"].items()}, x["deleted"], x["last_valid_at"], x["version_count"])
    found = fold.states_at_points(events, points)
    got = {}
    for x in found.collect():
        got.setdefault(x["point"], []).append(plain(x))
    short = {(x["point"], x["entity_id"]): tuple(x)[-3:] for x in fold.at_points(events, points).collect()}
    for name, valid, known in spots[:-1]:
        want = [plain(x) for x in fold.materialize(events, valid, known, include_deleted=True).collect()]
        assert sorted(got.get(name, []), key=repr) == sorted(want, key=repr), name
        assert all(short[name, w[0]] == w[-3:] for w in want)
    assert "none" not in got and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_difference_reads_only_ranges_that_differ(spark, tmp_path):
    rows = [event(k, "upsert_entity", f"e{k}", payload={"v": "1"}) for k in range(300)]
    later = rows + [event(1000, "upsert_entity", "e7", 1, payload={"v": "2"}), event(1001, "upsert_entity", "new", 1), event(1002, "delete_entity", "e9", 1)]
    kept = stores.Snapshots(stores.Place(spark, f"file://{tmp_path}/place"))
    states = [fold.materialize(frame(spark, r), include_deleted=True) for r in (rows, later)]
    a, b = (kept.save(s, None, DAY, DAY, DAY) for s in states)
    trees = [kept.tree(x) for x in (a, b)]
    assert all(t.filter("depth = 0").first()["n"] == n for t, n in zip(trees, (300, 301), strict=True))
    ranges = snapshots.changed_leaves(*trees)
    assert 1 <= len(ranges) <= 3 and snapshots.changed_leaves(trees[0], trees[0]) == []
    found = kept.difference(a, b)
    want = {tuple(x) for x in snapshots.difference(*[snapshots.versions(s) for s in states]).collect()}
    assert {tuple(x) for x in found.collect()} == want and {x[2:4] for x in want} == {("e7", "updated"), ("new", "created"), ("e9", "deleted")}
    assert "In(leaf" in found._jdf.queryExecution().executedPlan().toString() or "EqualTo(leaf" in found._jdf.queryExecution().executedPlan().toString()
    assert kept.difference(a, a).count() == 0 and kept.load(a).columns == [c for c in kept.load(a).columns if c != "leaf"]
