"""URL filters as a sort-merge range join, with DataFrame functions only.

A rule is a host with a path prefix. A url fits if its host is the rule's host or below it, and its path starts with
the rule's path. Written as reversed host, ``/`` and path, a rule's key is a prefix, so a rule covers one interval of
keys, and the intervals of all rules nest. A url has one key for each of its host's suffixes (as many labels at most
as the longest rule host has). Rules' opening and closing keys and url keys are sorted together in range partitions
and swept once; the sweep's stack of open rules is kept in windows: the running count of open rules is the stack's
height, and its top is the last rule that opened at that height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import carried, range_dealt

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OPEN, URL, CLOSE = 0, 1, 2


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    """Reversed host labels, ``/``, path, as bytes: byte order is the order of the sweep."""
    return F.encode(F.concat(F.array_join(labels, "."), F.lit("/"), path), "UTF-8")


def parse_rules(rules: DataFrame) -> DataFrame:
    """From (rule, verdict) to one row per distinct key; of rules with equal keys a blocking one wins, then the smaller string.

    A rule is ``host/path`` (the path starts with its ``/``) or ``host`` alone, which fits every path. Null rules go.
    """
    host = F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER)
    path = F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)")
    labels = F.reverse(F.split(host, r"\."))
    return (
        rules.filter("rule is not null")
        .select("rule", "verdict", _key(labels, path).alias("key"), F.size(labels).alias("n_labels"))
        .groupBy("key", "n_labels")
        .agg(F.min_by(F.struct("rule", "verdict"), F.struct(F.col("verdict") != "block", "rule")).alias("r"))
        .select("key", "n_labels", "r.rule", "r.verdict")
    )


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``urls``; the longest fitting rule wins, else ``default``.

    Null urls and urls without ``://`` have an empty host and path and get the default. Repeated rows stay repeated.
    An empty url table gives an empty result; without rules every url gets the default. Other columns are not read.
    Urls of any length are judged whole, and have no more keys than the longest rule's host has labels.
    """
    parsed = parse_rules(rules)
    most = parsed.agg(F.coalesce(F.max("n_labels"), F.lit(1)).alias("most"))  # one row
    most_labels = most.first()["most"]
    pages = (
        urls.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
        .groupBy("id", "host", "path")
        .agg(F.count("*").alias("copies"))
    )
    labels = F.reverse(F.split("host", r"\."))
    deepest = F.least(F.size(labels), F.lit(most_labels))
    keys = pages.select(
        "id", "host", "path", "copies", F.explode(F.transform(F.sequence(F.lit(1), deepest), lambda i: _key(F.slice(labels, F.lit(1), i), F.col("path")))).alias("key")
    ).withColumn("kind", F.lit(URL))
    opens = parsed.select("key", "rule", "verdict", F.lit(OPEN).alias("kind"))
    closes = parsed.select(F.concat("key", F.unhex(F.lit("FF"))).alias("key"), F.lit(CLOSE).alias("kind"))  # after all that starts with the key
    events = keys.unionByName(opens, allowMissingColumns=True).unionByName(closes, allowMissingColumns=True)
    dealt = range_dealt(events, "key", "kind", "id", "host", "path")

    step = F.when(F.col("kind") == OPEN, 1).when(F.col("kind") == CLOSE, -1).otherwise(0)
    swept_order = Window.partitionBy("pid").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    heights = carried(dealt, base=step)
    swept = dealt.join(F.broadcast(heights), "pid").withColumn("height", F.col("base") + F.sum(step).over(swept_order))

    # What is still open where a partition begins: for each height up to its base, the last rule that opened there before.
    top = F.struct("rule", "verdict")
    opened = swept.filter(F.col("kind") == OPEN).groupBy("pid", "height").agg(F.max_by(top, "key").alias("top"))
    wanted = heights.filter("base > 0").select("pid", F.explode(F.sequence(F.lit(1).cast("long"), "base")).alias("height")).withColumn("asks", F.lit(True))
    line = Window.partitionBy("height").orderBy("pid", F.col("asks").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    still_open = (
        opened.unionByName(wanted, allowMissingColumns=True)
        .withColumn("carried_top", F.last("top", ignorenulls=True).over(line))
        .filter("asks")
        .select("pid", "height", "carried_top")
    )
    at_height = Window.partitionBy("pid", "height").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        swept.withColumn("local_top", F.last(F.when(F.col("kind") == OPEN, top), ignorenulls=True).over(at_height))
        .filter(F.col("kind") == URL)
        .join(still_open, ["pid", "height"], "left")
        .withColumn("top", F.when(F.col("height") > 0, F.coalesce("local_top", "carried_top")))
    )
    best = F.max(F.when(F.col("top").isNotNull(), F.struct(F.length("top.rule").alias("n"), (F.col("top.verdict") == "block").alias("b"), "top.rule", "top.verdict")))
    judged = found.groupBy("id", "host", "path", "copies").agg(best.alias("best"))
    return judged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
