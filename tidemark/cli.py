"""A thin command line over the engine: ``python -m tidemark.cli GROUP COMMAND ...``. Results are printed as JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tidemark
from tidemark.operators import evals, fold, log, memory, replay, reports, retrieve, segments, snapshots, stores, traces
from tidemark.session import Config, open_session
from tidemark.sources import files
from tidemark.tables import stash


def show(df: DataFrame, limit: int) -> None:
    for row in df.limit(limit).toJSON().collect():
        print(row)


def events_of(spark: SparkSession, home: str) -> DataFrame:
    return segments.read(spark, f"{home}/events")


def versions_at(events: DataFrame, at: str, known: str) -> DataFrame:
    return snapshots.versions(fold.materialize(events, at, known, include_deleted=True))


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    home, name = args.home, f"{args.group} {args.command}"
    if name == "sync run":
        from tidemark.sources import connectors

        print(json.dumps(connectors.run_sync(spark, args.app, args.path, f"{home}/events", args.ingested_at)))
    elif name == "sync stats":
        show(log.statistics(events_of(spark, home)), args.limit)
    elif name == "history log":
        show(log.feed(log.timeline(events_of(spark, home), args.start, args.end, args.app)).orderBy("at", "seq"), args.limit)
    elif name == "history show":
        show(fold.entity_state(events_of(spark, home), args.app, args.type, args.id, args.as_of), args.limit)
    elif name == "history ls":
        show(fold.list_entities(events_of(spark, home), args.as_of, None, app=args.app, entity_type=args.type), args.limit)
    elif name == "history checkout":  # both axes at one time: what was true and known then
        show(fold.materialize(events_of(spark, home), args.as_of, args.as_of, app=args.app), args.limit)
    elif name == "history diff":  # both sides with what is known at the later time
        events = events_of(spark, home)
        show(snapshots.difference(versions_at(events, args.before, args.after), versions_at(events, args.after, args.after)), args.limit)
    elif name == "snapshot create":
        states = fold.materialize(events_of(spark, home), args.as_of, args.as_of, include_deleted=True, app=args.app)
        kept = stores.Snapshots(stores.Place(spark, home))
        show(kept.manifest(kept.save(states, args.app, args.as_of, args.as_of, args.now or args.as_of)), 1)
    elif name == "snapshot list":
        show(stores.Snapshots(stores.Place(spark, home)).list(), args.limit)
    elif name == "snapshot show":
        show(stores.Snapshots(stores.Place(spark, home)).load(args.id), args.limit)
    elif name == "snapshot diff":
        show(stores.Snapshots(stores.Place(spark, home)).difference(args.before, args.after), args.limit)
    elif name in ("trace ingest", "trace hook"):
        from tidemark.sources import transcripts

        if args.command == "hook":
            runs, spans = transcripts.captured_runs(transcripts.read_hook_log(spark, args.path))
            if args.transcripts:  # a transcript says more than the hooks of its session
                runs, spans = transcripts.preferred(transcripts.block_transcripts(spark, args.transcripts), (runs, spans))
        else:
            runs, spans = (transcripts.block_transcripts if args.format == "blocks" else transcripts.item_transcripts)(spark, args.path)
        print(json.dumps({"runs": traces.ingest(runs, spans, home, args.ingested_at)}))
    elif name == "trace list":
        show(traces.stored_runs(spark, home, args.agent), args.limit)
    elif name == "trace show":
        show(traces.stored_spans(spark, home, args.id).orderBy("pos"), args.limit)
    elif name == "memory compile":
        kept = stores.Memory(stores.Place(spark, home))
        items, edges = compiled(spark, home, args.now)
        kept.add(items)
        kept.add_edges(edges)
        kept.set_active(items.filter("not active").select("memory_id", "active"), args.now)
        print(json.dumps({"items": kept.items().count(), "active": kept.items().filter("active").count()}))
    elif name == "memory bootstrap":  # from the current state alone
        kept = stores.Memory(stores.Place(spark, home))
        items, edges = memory.cold_start(fold.materialize(events_of(spark, home)), args.now)
        kept.add(items)
        kept.add_edges(edges)
        print(json.dumps({"items": kept.items().count()}))
    elif name == "memory show":
        show(stores.Memory(stores.Place(spark, home)).get(args.id), 1)
    elif name == "memory list":
        show(stores.Memory(stores.Place(spark, home)).items().orderBy("memory_id"), args.limit)
    elif name == "memory retrieve":
        asked = spark.createDataFrame([(0, args.text)], "query int, text string")
        found = retrieve.retrieve(asked, *sources_of(spark, home), args.now)
        show(retrieve.packed(found, args.top_k, args.budget), args.limit)
    elif name == "memory files":
        kept = stores.Memory(stores.Place(spark, home))
        written = files.write_knowledge(memory.knowledge_files(kept.items()), args.path)
        written.append(files.write_provenance(memory.provenance(kept.items(), kept.place.read("edges")), args.path))
        print("\n".join(written))
    elif name == "eval mine":
        spans = traces.stored_spans(spark, home)
        show(evals.mine(traces.tool_sequences(spans), memory.from_runs(spans).select(F.col("ref").alias("trace_id"), "source", "text")), args.limit)
    elif name.startswith("eval "):
        tasks = files.tasks(spark, args.path).withColumns({c: F.col(c).cast("timestamp") for c in replay.POINT})
        runs = stash(replay.backtest_memory(tasks, *sources_of(spark, home), events_of(spark, home), args.now), "backtest")
        print(reports.markdown(runs) if args.command == "run" else reports.html(runs))
    elif name == "viz timeline":
        print(reports.timeline(fold.frames(log.history(events_of(spark, home), args.app, args.type, args.id))))
    elif name == "viz provenance":
        kept = stores.Memory(stores.Place(spark, home))
        items, edges = kept.items(), kept.place.read("edges")
        if args.format == "dot":
            print(reports.provenance_dot(items, edges))
        else:
            print(reports.provenance_text(memory.provenance(items, edges).join(items.select("memory_id", "confidence"), "memory_id")))
    elif name == "info show":
        here = {t: stores.Place(spark, home).read(t).count() for t in ("items", "edges", "approvals", "snapshots")}
        print(json.dumps({"version": tidemark.__version__, "home": home} | here))


def compiled(spark: SparkSession, home: str, now: str) -> tuple[DataFrame, DataFrame]:
    """Items from stored runs and the current state."""
    spans = traces.stored_spans(spark, home)
    states = fold.materialize(events_of(spark, home))
    body = F.coalesce(F.col("payload")["markdown"], F.col("payload")["text"])
    found = [memory.from_runs(spans), memory.from_sequences(traces.repeated_sequences(traces.tool_sequences(spans))), memory.norm_lines(states.filter(body.isNotNull()), body, F.col("entity_type") == "document", F.col("entity_id"))]
    return memory.compile_items(found, now)


def sources_of(spark: SparkSession, home: str) -> tuple[DataFrame, DataFrame]:
    """(items, edges) as retrieval takes them: an item is found by its claim."""
    kept = stores.Memory(stores.Place(spark, home))
    items = kept.items().select(F.col("memory_id").alias("doc"), F.col("claim").alias("text"), "claim", "namespace", "confidence", "acl", "active", "created_at")
    return items, kept.place.read("edges")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark")
    top.add_argument("--home", default=Config.from_env().home)
    top.add_argument("--limit", type=int, default=50)
    groups = top.add_subparsers(dest="group", required=True)
    version = groups.add_parser("version")
    version.set_defaults(command="")
    spec = {
        "sync": {"run": [("app",), ("path",), ("--ingested-at", True)], "stats": []},
        "history": {
            "log": [("--app",), ("--start",), ("--end",)], "show": [("app",), ("type",), ("id",), ("--as-of",)], "ls": [("--app",), ("--type",), ("--as-of",)],
            "checkout": [("as_of",), ("--app",)], "diff": [("before",), ("after",)],
        },
        "snapshot": {"create": [("as_of",), ("--app",), ("--now",)], "list": [], "show": [("id",)], "diff": [("before",), ("after",)]},
        "trace": {"ingest": [("path",), ("--format",), ("--ingested-at", True)], "hook": [("path",), ("--transcripts",), ("--ingested-at", True)], "list": [("--agent",)], "show": [("id",)]},
        "memory": {"compile": [("--now", True)], "bootstrap": [("--now", True)], "show": [("id",)], "list": [], "retrieve": [("text",), ("--now", True)], "files": [("path",)]},
        "eval": {"mine": [], "run": [("path", "+"), ("--now", True)], "html": [("path", "+"), ("--now", True)]},
        "viz": {"timeline": [("app",), ("type",), ("id",)], "provenance": [("--format",)]},
        "info": {"show": []},
    }
    for group, commands in spec.items():
        sub = groups.add_parser(group).add_subparsers(dest="command", required=True)
        for command, options in commands.items():
            p = sub.add_parser(command)
            for name, *more in options:
                p.add_argument(name, **({"required": True} if more == [True] else {"nargs": more[0]} if more else {}))
            if (group, command) == ("memory", "retrieve"):
                p.add_argument("--top-k", type=int, default=Config.from_env().top_k)
                p.add_argument("--budget", type=int, default=Config.from_env().token_budget)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.group == "version":
        print(tidemark.__version__)
        return 0
    run(args, open_session("tidemark-cli"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
