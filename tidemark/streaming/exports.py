"""Exports with sync tokens as a stream: the token is the stream's offset, so the checkpoint is the cursor.

An export is a folder with a file of JSON lines, or a folder of such files, for each batch of changes, named
``ORDER-TOKEN.jsonl``; the order sorts by name, and a token is what the application gave with the batch. The stream has read up to a token. Where that token is
gone from the folder (applications let old ones expire), everything is read again, and an idempotent sink adds what is
new. Large files are read in ranges of bytes, each by a task that owns the lines that begin inside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark import tables
from tidemark.operators import log, segments
from tidemark.sources import connectors

RANGE_BYTES = 32 << 20


@dataclass
class Range(InputPartition):
    """Bytes of one file."""

    path: str
    token: str
    start: int
    stop: int


def token_of(name: str) -> str:
    return name.rpartition("/")[2].removesuffix(".jsonl").partition("-")[2]


def _folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


class TokenReader(DataSourceStreamReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def files(self) -> list[tuple[str, str, list[tuple[str, int]]]]:
        """(path, token, (path, bytes) of its files) of each batch, in order."""
        from pyarrow import fs

        system, path = _folder(self.path)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        out = []
        for batch in sorted(found, key=lambda f: f.path):
            if batch.path.endswith(".jsonl"):
                parts = [batch] if batch.is_file else system.get_file_info(fs.FileSelector(batch.path))
                out.append((batch.path, token_of(batch.path), [(p.path, p.size) for p in sorted(parts, key=lambda p: p.path) if p.is_file and p.base_name[0] not in "._"]))
        return out

    def initialOffset(self) -> dict:
        return {"token": None}

    def latestOffset(self) -> dict:
        files = self.files()
        return {"token": files[-1][1] if files else None}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files = self.files()
        tokens = [t for _, t, _ in files]
        after = tokens.index(start["token"]) + 1 if start["token"] in tokens else 0
        until = tokens.index(end["token"]) + 1 if end["token"] in tokens else len(tokens)
        if after >= until and start["token"] != end["token"]:  # the order of the tokens has changed: a new export
            after = 0
        return [Range(p, t, at, min(at + self.range_bytes, size)) for _, t, parts in files[after:until] for p, size in parts for at in range(0, size, self.range_bytes)]

    def read(self, partition: Range) -> Iterator[tuple[str, str]]:
        system, _ = _folder(self.path)
        with system.open_input_file(partition.path) as file:
            at = partition.start
            if at:  # a line that begins before belongs to the range before; one that begins right here is ours
                file.seek(at - 1)
                at += len(_line(file)) - 1
            file.seek(at)
            while at < partition.stop and (line := _line(file)):
                at += len(line)
                if text := line.decode().strip():
                    yield partition.token, text

    def commit(self, end: dict) -> None:
        pass


def _line(file) -> bytes:
    """The bytes up to and with the next line break, from where the file stands, which is then behind it."""
    parts, here = [], file.tell()
    while chunk := file.read(1 << 16):
        stop = chunk.find(b"\n") + 1
        parts.append(chunk[:stop] if stop else chunk)
        if stop:
            break
    line = b"".join(parts)
    file.seek(here + len(line))
    return line


class TokenExport(DataSource):
    """``spark.readStream.format("token_export").option("path", FOLDER)``: rows (token, line)."""

    @classmethod
    def name(cls) -> str:
        return "token_export"

    def schema(self) -> str:
        return "token string, line string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TokenReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


def read_export(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The stream of an export's lines."""
    spark.dataSource.register(TokenExport)
    return spark.readStream.format("token_export").option("path", path).option("rangeBytes", range_bytes).load()


def start_calendar(spark: SparkSession, path: str, log_path: str, checkpoint: str, ingested_at, calendar_id: str = "primary", interval: str | None = None, range_bytes: int = RANGE_BYTES) -> StreamingQuery:
    """A calendar's export into the log: once behind the last token, or at an interval. No table of cursors is kept."""

    def write(batch: DataFrame, _: int) -> None:
        rows = tables.stash(batch.select(F.lit(calendar_id).alias("cal"), F.from_json("line", connectors.CALENDAR_EVENT).alias("e")), "export")  # read three times
        segments.append(batch.sparkSession, connectors.calendar_events(rows, log.as_time(ingested_at)), log_path)

    writer = read_export(spark, path, range_bytes).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
