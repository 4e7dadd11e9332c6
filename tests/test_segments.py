"""The log in segments: two writers at once, readers by version, filters, compaction, rollback."""

import threading
from datetime import datetime, timedelta

import pytest

from tidemark import tables
from tidemark.operators import log, segments

DAY = datetime(2026, 5, 1)


def events(spark, numbers, **change):
    rows = [(f"evt_{k:05d}", "a", "t", f"e{k % 9}", "upsert_entity", {"k": str(k)} | change, DAY + timedelta(minutes=k), DAY, None, None, None, None, None, None, None) for k in numbers]
    return spark.createDataFrame(rows, log.EVENT_SCHEMA)


def held(spark, root, version=None):
    return {r["event_id"]: r["seq"] for r in segments.read(spark, root, version).select("event_id", "seq").collect()}


def test_append_versions_and_rollback(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    assert held(spark, root) == {} and segments.load(spark, root).version == 0
    first = segments.append(spark, events(spark, [*range(50), *range(20)]), root, segment_rows=20)
    assert (first.version, first.added, first.segments) == (1, 50, 0)
    again = segments.append(spark, events(spark, range(50)), root)
    assert (again.version, again.added) == (1, 0)
    more = segments.append(spark, events(spark, range(40, 60)), root, cursors={"a/s": "T1"})
    assert (more.version, more.added) == (2, 10) and segments.cursor(spark, root, "a", "s") == "T1"
    now = held(spark, root)
    assert sorted(now.values()) == list(range(1, 61)) and len(now) == 60
    assert held(spark, root, 1) == {k: v for k, v in now.items() if v <= 50}
    assert [k for k, _ in sorted(now.items(), key=lambda x: x[1])] == [f"evt_{k:05d}" for k in range(60)]  # by valid time within a commit
    with pytest.raises(RuntimeError, match="boom"):
        with segments.transaction(spark, root) as t:
            t.append(events(spark, [70]))
            t.set_cursor("a", "s", "T2")
            raise RuntimeError("boom")
    assert held(spark, root) == now and segments.cursor(spark, root, "a", "s") == "T1"
    with segments.transaction(spark, root) as t:
        t.append(events(spark, [70, 71]))
        t.append(events(spark, [71, 72]))
        t.set_cursor("a", "s", "T2")
    assert (t.done.added, segments.cursor(spark, root, "a", "s")) == (3, "T2")
    assert segments.read(spark, root).schema.names == segments.COLUMNS


def test_a_large_batch_opens_segments_and_asks_no_filters(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    n = segments.ASKED_MOST
    ids = lambda a, b: events(spark, range(1)).drop("event_id").crossJoin(spark.range(a, b).selectExpr("concat('evt_', sha2(cast(id AS string), 256)) AS event_id"))
    segments.append(spark, ids(0, 200), root, segment_rows=50)
    made = segments.load(spark, root).segments
    tables.delete(spark, f"{root}/filters/{made[0]['filter']}")
    done = segments.append(spark, ids(100, 100 + n), root)  # before, each of its ids asked each filter
    assert (done.added, done.opened) == (n - 100, 4) and segments.read(spark, root).select("event_id").distinct().count() == 100 + n == segments.read(spark, root).count()


def test_an_append_opens_only_segments_that_may_hold_an_id(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    # Ids without order in time, so that bounds say nothing.
    mixed = events(spark, range(4000)).selectExpr("concat('evt_', sha2(event_id, 256)) AS event_id", *[c for c in segments.COLUMNS if c != "event_id"])
    segments.append(spark, mixed, root, segment_rows=20)
    live = segments.load(spark, root).segments
    assert len(live) == 200 and sum(s["rows"] for s in live) == 4000
    owner = {r["event_id"]: r["segment"] for r in spark.read.schema("event_id string, segment string").parquet(*[f"{root}/data/{s['name']}" for s in live]).collect()}
    few = mixed.limit(3)
    holders = {owner[r["event_id"]] for r in few.collect()}
    asked = {s["name"] for s in segments.may_hold(spark, root, few.select("event_id"), live)}
    assert holders <= asked and len(asked) <= len(holders) + 6
    again = segments.append(spark, few, root)
    assert (again.added, again.segments) == (0, 200) and again.opened == len(asked)
    new = segments.append(spark, events(spark, range(5000, 5010)), root)
    assert new.added == 10 and new.opened <= 6
    before = held(spark, root)
    assert segments.compact(spark, root, segment_rows=1000) == 3 and held(spark, root) == before
    assert len(segments.load(spark, root).segments) == 5 and held(spark, root, 2) == before
    assert segments.append(spark, mixed, root).added == 0
    assert segments.clear(spark, root) > 0 and held(spark, root) == before and segments.versions(spark, root) == [3]


def test_two_writers_at_once_add_an_event_once(spark, tmp_path):
    root, done, errors = f"file://{tmp_path}/log", [], []
    start = threading.Barrier(3)

    def write(numbers):
        try:
            start.wait()
            done.append(segments.append(spark, events(spark, numbers), root).added)
        except Exception as failure:
            errors.append(failure)

    writers = [threading.Thread(target=write, args=(n,)) for n in (range(30), range(20, 50), range(10, 40))]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not errors and sum(done) == 50
    now = held(spark, root)
    assert len(now) == 50 and sorted(now.values()) == list(range(1, 51)) and len(segments.versions(spark, root)) == sum(n > 0 for n in done)


def test_put_if_absent(spark, tmp_path):
    path = f"file://{tmp_path}/x.json"
    assert segments.put_if_absent(spark, path, "one") and not segments.put_if_absent(spark, path, "two")
    assert (tmp_path / "x.json").read_text() == "one" and len(list(tmp_path.glob("*.draft"))) == 0
