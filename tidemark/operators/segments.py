"""The event log as a table of segments: commits that two writers can't both make, readers by version, key filters, compaction.

A segment is a file of up to ``SEGMENT_ROWS`` events, in order of (valid_at, event_id). A commit is a small file that
lists all live segments, named by its version; it appears whole, or not at all, and only one writer gets a version. Who
comes second looks at the segments that were added meanwhile, drops what they hold, and tries the next version, so an
event is added once however many writers bring it. Readers take the latest commit, or any earlier one.

Each segment has the least and greatest of its ids and a Bloom filter in blocks of 32,768 bits. An append asks the
filters and opens only the segments that may hold an id of the batch: its cost is the batch and the filters, some ten
bits an event, and not the log. A batch that is larger than a segment opens it without asking. Sequence numbers are a
segment's base and a row's place in it, so a commit that has to try again writes no rows again.
"""

from __future__ import annotations

import json
import os
import urllib.parse
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import tables
from tidemark.operators.log import EVENT_SCHEMA, KEY, first_arrivals

SEGMENT_ROWS = 1 << 20
#: A filter's bits for each id, the bits of a block, and how many of them an id sets.
BITS_PER_ID, BLOCK_BITS, HASHES = 10, 1 << 15, 6
#: Ids from which on a batch opens segments that are no larger than itself without asking their filters.
ASKED_MOST = 1 << 12
ATTEMPTS = 20
COLUMNS = [f.split()[0] for f in EVENT_SCHEMA.split(", ")]


class Conflict(RuntimeError):
    """Other writers were faster at every attempt, or took away what this one works on."""


@dataclass
class Commit:
    """What a version of the log consists of. ``cursors`` are positions of sources, set together with their events."""

    version: int = 0
    segments: list[dict] = field(default_factory=list)
    next_seq: int = 1
    cursors: dict[str, str | None] = field(default_factory=dict)


@dataclass
class Appended:
    version: int
    added: int
    #: Segments whose ids were read, and how many there were.
    opened: int
    segments: int


def put_if_absent(spark: SparkSession, path: str, body: str) -> bool:
    """Make a file with this content, all of it at once; False if the path is taken.

    By a hard link in local folders, and elsewhere by a rename that replaces nothing, as the file system's contract has it.
    """
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    tables.write_text(spark, draft, body)
    parts = urllib.parse.urlparse(path)
    if parts.scheme in ("", "file"):
        local = lambda p: urllib.parse.unquote(urllib.parse.urlparse(p).path)
        try:
            os.link(local(draft), local(path))
            return True
        except FileExistsError:
            return False
        finally:
            tables.delete(spark, draft)
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(at(draft), at(path), options)
        return True
    except Exception as failure:
        tables.delete(spark, draft)
        if "FileAlreadyExists" in str(failure):
            return False
        raise


def _commit_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/commits/{version:020d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    """All versions that were committed and not cleared away, in order."""
    names = tables.list_names(spark, f"{root.rstrip('/')}/commits")
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def load(spark: SparkSession, root: str, version: int | None = None) -> Commit:
    """The commit of a version, the latest if none is named; an empty one where no log is."""
    if version is None:
        known = versions(spark, root)
        if not known:
            return Commit()
        version = known[-1]
    return Commit(**json.loads(tables.read_text(spark, _commit_path(root, version))))


def _try(spark: SparkSession, root: str, commit: Commit) -> bool:
    return put_if_absent(spark, _commit_path(root, commit.version), json.dumps(commit.__dict__))


def _rows(spark: SparkSession, root: str, segments: list[dict]) -> DataFrame:
    """The events of some segments, with their sequence numbers."""
    if not segments:
        return spark.createDataFrame([], EVENT_SCHEMA)
    stored = EVENT_SCHEMA.replace("seq bigint", "place bigint, segment string")
    base = F.create_map(*[F.lit(x) for s in segments for x in (s["name"], s["base"])])
    rows = spark.read.schema(stored).parquet(*[f"{root.rstrip('/')}/data/{s['name']}" for s in segments])
    return rows.withColumn("seq", base[F.col("segment")] + F.col("place")).select(*COLUMNS)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The events of a version of the log."""
    return _rows(spark, root, load(spark, root, version).segments)


def _bits(event_id) -> list:
    return [F.pmod(F.xxhash64(event_id, F.lit(k)), F.lit(BLOCK_BITS)) for k in range(HASHES)]


def _bucket(event_id, buckets):
    return F.pmod(F.xxhash64(event_id, F.lit(-1)), buckets)


def may_hold(spark: SparkSession, root: str, ids: DataFrame, segments: list[dict]) -> list[dict]:
    """The segments that may hold one of the ids: by their bounds, then by their filters. None that holds one is left out.

    Asking a filter costs the batch, opening its segment costs the segment. So a batch of ``ASKED_MOST`` ids, of which
    some pass any filter by chance, asks only filters of segments that are larger than itself.
    """
    bounds = ids.agg(F.min("event_id"), F.max("event_id"), F.count("*")).first()
    if bounds[0] is None:
        return []
    within = [s for s in segments if s["min"] <= bounds[1] and s["max"] >= bounds[0]]
    opened = {s["name"] for s in within if bounds[2] >= max(ASKED_MOST, s["rows"])}
    segments = [s for s in within if s["name"] not in opened]
    if not segments:
        return within
    sizes = sorted({s["buckets"] for s in segments})
    asked = ids.select("event_id", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("buckets")).select("buckets", _bucket(F.col("event_id"), F.col("buckets")).alias("bucket"), F.array(*_bits(F.col("event_id"))).alias("at"))
    filters = spark.read.schema("segment string, buckets int, bucket bigint, bits binary").parquet(*sorted({f"{root.rstrip('/')}/filters/{s['filter']}" for s in segments}))
    filters = filters.filter(F.col("segment").isin([s["name"] for s in segments]))
    byte = lambda p: F.conv(F.hex(F.substring("bits", (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.lit(True)
    for k in range(HASHES):
        p = F.get("at", F.lit(k))
        held = held & (F.getbit(byte(p), p % 8) == 1)
    found = opened | {r["segment"] for r in filters.join(asked, ["buckets", "bucket"]).filter(held).select("segment").distinct().collect()}  # a row a segment
    return [s for s in within if s["name"] in found]


def _known(spark: SparkSession, root: str, ids: DataFrame, segments: list[dict]) -> tuple[DataFrame | None, int]:
    """(the ids that the segments hold, how many segments were opened for it)."""
    opened = may_hold(spark, root, ids, segments)
    if not opened:
        return None, 0
    return tables.stash(ids.join(_rows(spark, root, opened).select("event_id"), "event_id", "left_semi"), "known"), len(opened)


def _write(spark: SparkSession, root: str, rows: DataFrame, order: list[str], place, segment_rows: int, count: int) -> list[dict]:
    """Rows as new segments by ranges of ``order``, with their filters; the entries have base 0 yet."""
    made = uuid.uuid4().hex
    parts = -(-count // segment_rows)
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The rows of a partition are a segment; a partition's number is the upper part of the rising number.
    number = F.monotonically_increasing_id()
    placed = dealt.withColumn("place", place if place is not None else number.bitwiseAND((1 << 33) - 1)).withColumn("part", F.spark_partition_id()).withColumn("segment", F.concat(F.lit(f"{made}/part="), F.col("part")))
    placed.select(*[c if c != "seq" else "place" for c in COLUMNS], "segment", "part").write.partitionBy("part").parquet(f"{root.rstrip('/')}/data/{made}")
    stored = spark.read.schema("event_id string, segment string").parquet(f"{root.rstrip('/')}/data/{made}")
    facts = stored.groupBy("segment").agg(F.count("*").alias("rows"), F.min("event_id").alias("min"), F.max("event_id").alias("max")).collect()  # a row a segment
    entries = []
    for r in sorted(facts, key=lambda r: int(r["segment"].rpartition("=")[2])):
        blocks = -(-r["rows"] * BITS_PER_ID // BLOCK_BITS)
        entries.append({"name": r["segment"], "rows": r["rows"], "base": 0, "min": r["min"], "max": r["max"], "buckets": 1 << (blocks - 1).bit_length(), "filter": made})
    size = F.create_map(*[F.lit(x) for e in entries for x in (e["name"], e["buckets"])])
    keyed = stored.withColumn("buckets", size[F.col("segment")])
    marks = keyed.select("segment", "buckets", _bucket(F.col("event_id"), F.col("buckets")).alias("bucket"), F.explode(F.array(*_bits(F.col("event_id")))).alias("p"))
    marks.groupBy("segment", "buckets", "bucket").agg(F.bitmap_construct_agg("p").alias("bits")).write.parquet(f"{root.rstrip('/')}/filters/{made}")
    return entries


def append(spark: SparkSession, batch: DataFrame, root: str, order: list[str] | None = None, segment_rows: int = SEGMENT_ROWS, cursors: dict[str, str | None] | None = None) -> Appended:
    """Add the events that the log lacks, each once, and set ``cursors``, in one commit; adding again adds none.

    Of equal ids in the batch the first by ``order`` is added. Writers may run at the same time.
    """
    fresh = tables.stash(first_arrivals(batch, order or ["ingested_at", *KEY]), "fresh")
    seen: set[str] = set()
    entries, count, opened, head = [], None, 0, load(spark, root)
    for _ in range(ATTEMPTS):
        unseen = [s for s in head.segments if s["name"] not in seen]
        known, n = _known(spark, root, fresh.select("event_id"), unseen)
        seen |= {s["name"] for s in unseen}
        opened += n
        if known is not None and not known.isEmpty():
            fresh, count = tables.stash(fresh.join(known, "event_id", "left_anti"), "fresh"), None
        if count is None:
            count = fresh.count()
            columns = [F.col(c) if c in fresh.columns else F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in EVENT_SCHEMA.split(", ")) if c != "seq"]
            entries = _write(spark, root, fresh.select(*columns), ["valid_at", "event_id"], None, segment_rows, count) if count else []
        if not count and not cursors and head.version:
            return Appended(head.version, 0, opened, len(seen))
        at, based = head.next_seq, []
        for e in entries:
            based.append(e | {"base": at})
            at += e["rows"]
        commit = Commit(head.version + 1, head.segments + based, at, head.cursors | (cursors or {}))
        if _try(spark, root, commit):
            return Appended(commit.version, count, opened, len(seen))
        head = load(spark, root)
    raise Conflict(f"no commit to {root} in {ATTEMPTS} attempts")


class Transaction:
    """Batches and cursors that are added together or not at all."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.batches, self.cursors = spark, root, [], {}
        self.done: Appended | None = None

    def append(self, batch: DataFrame) -> None:
        self.batches.append(batch)

    def set_cursor(self, app: str, stream: str, cursor: str | None) -> None:
        self.cursors[f"{app}/{stream}"] = cursor


@contextmanager
def transaction(spark: SparkSession, root: str, **options) -> Iterator[Transaction]:
    """``with transaction(spark, root) as t``: what ``t`` was given is one commit at the end; an error in the block leaves the log as it was."""
    work = Transaction(spark, root)
    yield work
    every = spark.createDataFrame([], EVENT_SCHEMA).drop("seq")
    for batch in work.batches:
        every = every.unionByName(batch.drop("seq"), allowMissingColumns=True).select(*[c for c in COLUMNS if c != "seq"])
    work.done = append(spark, every, root, cursors=work.cursors, **options)


def cursor(spark: SparkSession, root: str, app: str, stream: str) -> str | None:
    """The position of a source's stream that was committed last."""
    return load(spark, root).cursors.get(f"{app}/{stream}")


def compact(spark: SparkSession, root: str, below: int | None = None, segment_rows: int = SEGMENT_ROWS) -> int:
    """Rewrite segments of fewer than ``below`` events together, with the sequence numbers they have; gives the version.

    Appends may commit meanwhile; another compaction of the same segments may not.
    """
    head = load(spark, root)
    small = [s for s in head.segments if s["rows"] < (below or segment_rows)]
    if len(small) < 2:
        return head.version
    merged = _write(spark, root, _rows(spark, root, small), ["seq"], F.col("seq"), segment_rows, sum(s["rows"] for s in small))
    gone = {s["name"] for s in small}
    for _ in range(ATTEMPTS):
        if not gone <= {s["name"] for s in head.segments}:
            raise Conflict("segments to be compacted are gone")
        commit = Commit(head.version + 1, merged + [s for s in head.segments if s["name"] not in gone], head.next_seq, head.cursors)
        if _try(spark, root, commit):
            return commit.version
        head = load(spark, root)
    raise Conflict(f"no commit to {root} in {ATTEMPTS} attempts")


def clear(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete all but the last ``keep`` versions, and the files that none of these has; gives how many folders went.

    Not while a writer is at work: what it has not committed yet belongs to no version.
    """
    known = versions(spark, root)
    kept = [load(spark, root, v) for v in known[-keep:]]
    used = {s["filter"] for c in kept for s in c.segments} | {s["name"].partition("/")[0] for c in kept for s in c.segments}
    for v in known[:-keep]:
        tables.delete(spark, _commit_path(root, v))
    gone = 0
    for kind in ("data", "filters"):
        for name in tables.list_names(spark, f"{root.rstrip('/')}/{kind}"):
            if name not in used:
                tables.delete(spark, f"{root.rstrip('/')}/{kind}/{name}")
                gone += 1
    return gone
