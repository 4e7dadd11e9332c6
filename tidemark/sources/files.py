"""Small files that drive an evaluation: tasks and memory seeds in YAML or JSON, and the knowledge base's folder."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidemark.tables import write_text

TASK_SCHEMA = (
    "task_id string, title string, prompt string, as_of_valid string, as_of_ingest string, memory_expected array<string>, "
    "expected array<struct<app:string,action:string,fields:array<struct<name:string,value:string,contains:boolean>>>>, forbidden array<string>, max_writes int"
)
SEED_SCHEMA = "type string, namespace string, subject string, claim string, confidence double, acl string"


def load(path: str | Path) -> dict:
    """One file; YAML needs PyYAML, JSON nothing."""
    body = Path(path).read_text(encoding="utf-8")
    if str(path).endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(body)
    return json.loads(body)


def task_row(raw: dict) -> dict:
    fields = lambda e: [{"name": k, "value": str(v["contains"] if isinstance(v, dict) else v), "contains": isinstance(v, dict)} for k, v in e.items()]
    return {
        "task_id": raw["task_id"], "title": raw.get("title"), "prompt": raw["prompt"], "as_of_valid": raw.get("as_of_valid"), "as_of_ingest": raw.get("as_of_ingest"),
        "memory_expected": raw.get("memory_expected") or [], "expected": [{"app": w["app"], "action": w["action"], "fields": fields(w.get("expect") or {})} for w in raw.get("expected_writes") or []],
        "forbidden": raw.get("forbidden_actions") or [], "max_writes": raw.get("max_writes"),
    }


def tasks(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([task_row(load(p)) for p in sorted(paths)], TASK_SCHEMA)


def memory_seed(spark: SparkSession, path: str) -> DataFrame:
    names = [f.split()[0] for f in SEED_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(i.get(n) for n in names) for i in load(path)["items"]], SEED_SCHEMA)


def write_knowledge(files: DataFrame, root: str) -> list[str]:
    """Write (path, body) rows below a folder of any file system that Spark knows, streamed a partition at a time; returns the paths."""
    written = []
    for row in files.toLocalIterator():
        write_text(files.sparkSession, f"{root.rstrip('/')}/{row['path']}", row["body"] + "\n")
        written.append(row["path"])
    return sorted(written)


def read_knowledge(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root).selectExpr("_metadata.file_path as path", "value as body")


def write_provenance(linked: DataFrame, root: str) -> str:
    """Write each item with its relations (memory_id, claim, relations) as JSON lines beside the files; returns the folder."""
    at = f"{root.rstrip('/')}/provenance"
    linked.select("memory_id", "claim", "relations").write.mode("overwrite").json(at)
    return at


def read_provenance(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("memory_id string, claim string, relations array<string>").json(f"{root.rstrip('/')}/provenance")
