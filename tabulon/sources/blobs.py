"""Named objects of any size up to 2 GB as a table of blocks: put, list, get, byte ranges, deletes by prefix.

A range is found by an equality of (key, block), so that of a large object only the blocks it touches are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks

BLOCK = 1 << 20
#: Segments of letters, digits, dots, underscores and hyphens that begin with a letter or digit, parted by slashes.
SEGMENT, MOST_SEGMENTS = "[A-Za-z0-9][A-Za-z0-9._-]{0,127}", 8


def is_safe(key: Column) -> Column:
    """Whether a key names an object: no path that is absolute, climbs, or holds other characters. False for null."""
    return F.coalesce(key.rlike(rf"\A{SEGMENT}(/{SEGMENT}){{0,{MOST_SEGMENTS - 1}}}\z"), F.lit(False))


def put(objects: DataFrame, path: str, block: int = BLOCK) -> None:
    """Store objects (key, content); what stood under a key gives way. Objects without a safe key or content aren't stored: `refused` gives them.

    Of several contents of one key in a call, the one of the least SHA-256 stays. `block` may differ between calls.
    """
    one = objects.where(is_safe(F.col("key")) & F.col("content").isNotNull()).groupBy("key").agg(F.min_by("content", F.sha2("content", 256)).alias("content"))
    size = F.octet_length("content")
    parts = F.sequence(F.lit(0), F.floor(F.greatest(size - 1, F.lit(0)) / F.lit(block)).cast("int"))
    rows = one.select("key", size.cast("long").alias("length"), F.lit(block).alias("block"), "content", F.explode(parts).alias("part"))
    sinks.replace_documents(rows.withColumn("bytes", F.expr("substring(content, part * block + 1, block)")).drop("content"), path, key="key")


def refused(objects: DataFrame) -> DataFrame:
    """(key, reason) of the objects that `put` doesn't store."""
    return objects.select("key", F.when(~is_safe(F.col("key")), "unsafe key").when(F.col("content").isNull(), "no content").alias("reason")).where("reason is not null")


def listing(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(key, length) of the objects whose keys begin with `prefix`; the prefix reaches the scan, and no content is read."""
    found = sinks.read_documents(spark, path, "key").where("part = 0")
    return (found.where(F.col("key").startswith(prefix)) if prefix else found).select("key", "length")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """(key, length, block, part, bytes): the objects in pieces, for readers that go through large ones."""
    return sinks.read_documents(spark, path, "key")


def _joined(pieces: Column) -> Column:
    """One binary of sorted structs (part, bytes), in linear time."""
    return F.unhex(F.array_join(F.transform(F.array_sort(pieces), lambda p: F.hex(p["bytes"])), ""))


def get(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(key, content) of the objects named in `keys` (key); unknown ones have no row. For objects that fit in a row."""
    found = blocks(spark, path).join(keys.select("key").distinct(), "key", "left_semi")
    return found.groupBy("key").agg(_joined(F.collect_list(F.struct("part", "bytes"))).alias("content"))


def ranges(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """(key, first, last, content) for each different request (key, first, last), both ends included, with the bounds that were read.

    A missing first is 0, a missing last the end; bounds outside the object are moved into it. An unknown key has no row, an empty
    object one of no bytes with last -1. Of each object only the blocks that a request touches take part in the join.
    """
    asked = requests.select("key", F.col("first").cast("long"), F.col("last").cast("long")).distinct()
    heads = blocks(spark, path).where("part = 0").select("key", "length", "block")
    end = F.col("length") - 1
    first = F.greatest(F.least(F.coalesce("first", F.lit(0)), end), F.lit(0))
    bound = asked.join(heads, "key").select("key", "block", first.alias("first"), F.when(end < 0, end).otherwise(F.greatest(F.least(F.coalesce("last", end), end), first)).alias("last")).distinct()
    touched = F.sequence(F.floor(F.col("first") / F.col("block")).cast("int"), F.floor(F.greatest("last", F.lit(0)) / F.col("block")).cast("int"))
    wanted = bound.withColumn("part", F.explode(touched))
    pieces = wanted.join(blocks(spark, path).select("key", "part", "bytes"), ["key", "part"])
    start = "cast(greatest(first - part * cast(block as bigint), 0) as int)"
    piece = F.expr(f"substring(bytes, {start} + 1, greatest(cast(least(last - part * cast(block as bigint), block - 1) as int) - {start} + 1, 0))")
    return pieces.select("key", "first", "last", "part", piece.alias("bytes")).groupBy("key", "first", "last").agg(_joined(F.collect_list(F.struct("part", "bytes"))).alias("content"))


def delete_prefix(spark: SparkSession, path: str, prefix: str) -> None:
    """All objects whose keys begin with `prefix` go."""
    sinks.delete_documents(listing(spark, path, prefix), path, "key")
