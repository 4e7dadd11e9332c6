"""Canonical JSON, content hashes, derived ids and timestamps, as columns."""

from __future__ import annotations

import json
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOB_SCHEME = "blob://"


def canonical(value) -> str:
    """JSON with sorted keys, no blanks, text kept as it is, times in ISO with milliseconds, sets sorted."""

    def plain(x):
        if isinstance(x, datetime):
            x = x if x.tzinfo else x.replace(tzinfo=timezone.utc)
            return x.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{x.microsecond // 1000:03d}Z"
        if isinstance(x, (set, frozenset)):
            return sorted(x)
        raise TypeError(f"no JSON form: {type(x).__name__}")

    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=plain)


@F.pandas_udf(T.StringType())
def canonical_json(raw: pd.Series) -> pd.Series:
    """JSON text of any depth in canonical form; null stays null. Flat maps have a native form, ``canonical_map``."""
    return raw.map(lambda x: None if x is None else canonical(json.loads(x)))


def canonical_map(m: Column) -> Column:
    """A map of strings in canonical form, without Python: entries sorted by key before they become JSON."""
    return F.when(m.isNull(), None).otherwise(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))), {"ignoreNullFields": "false"}))


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def quoted(text: Column) -> Column:
    """A string as JSON writes it, quotes and all."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def content_hash(text: Column) -> Column:
    """Hash of a string's canonical JSON, so of its quoted form."""
    return sha256_hex(quoted(text))


def short_hash(canonical_text: Column, length: int = 16) -> Column:
    return F.substring(sha256_hex(canonical_text), 1, length)


def new_id(prefix: str, **seed: Column) -> Column:
    """``prefix_`` and 16 hex digits of the hash of the seed's canonical JSON; null seeds are JSON null."""
    entries = F.array_sort(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in sorted(seed.items())]))
    return F.concat(F.lit(f"{prefix}_"), short_hash(F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"})))


def is_content_hash(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def blob_uri(digest: Column) -> Column:
    return F.concat(F.lit(BLOB_SCHEME), digest)


def parse_blob_uri(uri: Column) -> Column:
    """The digest of a blob URI or of a bare digest; null for anything else."""
    digest = F.regexp_replace(uri, f"^{BLOB_SCHEME}", "")
    return F.when(is_content_hash(digest), digest)


def to_iso(ts: Column) -> Column:
    """ISO time in UTC, cut to milliseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def from_iso(text: Column) -> Column:
    """Time of an ISO string with Z, an offset or none; null if it is none."""
    return F.to_timestamp(F.try_to_timestamp(text))


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_micros(F.round(seconds.cast("decimal(20,6)") * 1_000_000).cast("bigint"))


def to_epoch(ts: Column) -> Column:
    return F.unix_micros(ts) / 1e6


def to_millis(ts: Column) -> Column:
    """Cut to milliseconds, as the log keeps times."""
    return F.date_trunc("millisecond", ts)
