"""Stored tables of documents' rows (pages with their boxes, passages, values, blobs): replaced, re-extracted, deleted and compacted by document.

A table is a folder of numbered writes. `rows/write=N` holds the rows of a write and `commits/write=N` the keys whose earlier rows
it supersedes; a write counts once its commit is complete, and no file that counts is ever changed. So a write costs what it writes,
a job that dies leaves the table as it was, and a reader sees whole writes only. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITE = "write__"


def _children(spark: SparkSession, path: str) -> dict[str, bool]:
    """Folders in a folder, and whether the job that wrote each one ended."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path(path)):
        return {}
    return {s.getPath().getName(): fs.exists(fs_path(s.getPath(), "_SUCCESS")) for s in fs.listStatus(fs_path(path)) if s.isDirectory()}


def _numbers(spark: SparkSession, path: str) -> tuple[list[int], int]:
    """(the writes that count, from the last compaction on, the next free number)."""
    commits = {(kind, int(n)): done for name, done in _children(spark, f"{path}/commits").items() for kind, _, n in [name.partition("=")]}
    done = {at for at, whole in commits.items() if whole}
    base = max((n for kind, n in done if kind == "base"), default=0)
    seen = [n for _, n in commits] + [int(name.partition("=")[2]) for name in _children(spark, f"{path}/rows")]
    return sorted(n for _, n in done if n >= base), max(seen, default=0) + 1


def replace_documents(rows: DataFrame, path: str, ids: DataFrame | None = None, key: str = "document_id") -> None:
    """All stored rows of the documents in `ids` (`key`; without it, those of `rows`) give way to `rows`; a second run changes nothing.

    Columns may differ between writes; what a write lacks is null. Rows without a key aren't stored.
    """
    spark = rows.sparkSession
    n = _numbers(spark, path)[1]
    written = f"{path}/rows/write={n}"
    rows.where(F.col(key).isNotNull()).write.parquet(written)
    gone = spark.read.parquet(written) if ids is None else ids
    gone.select(key).where(F.col(key).isNotNull()).distinct().write.parquet(f"{path}/commits/write={n}")


def delete_documents(ids: DataFrame, path: str, key: str = "document_id") -> None:
    """The stored rows of these documents go; unknown ones change nothing."""
    if _numbers(ids.sparkSession, path)[0]:
        replace_documents(read_documents(ids.sparkSession, path, key).limit(0), path, ids, key)


def read_documents(spark: SparkSession, path: str, key: str = "document_id") -> DataFrame:
    """The rows that no later write supersedes. Filters on columns reach the scans of all writes.

    The keys of the first write, which hold most of a table, aren't read; the later ones are few between compactions,
    and are broadcast if their measured size allows, else joined by a shuffle.
    """
    writes = _numbers(spark, path)[0]
    if not writes:
        raise ValueError(f"no table at {path}")
    out: DataFrame | None = None
    alike: dict[str, list[int]] = {}
    for n in writes:
        alike.setdefault(spark.read.parquet(f"{path}/rows/write={n}").schema.json(), []).append(n)
    for group in alike.values():
        found = [spark.read.parquet(f"{path}/rows/write={n}").withColumn(_WRITE, F.lit(n)) for n in group]
        for df in found:
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    later = [spark.read.parquet(f"{path}/commits/write={n}").select(F.col(key).alias("key__"), F.lit(n).alias("last__")) for n in writes[1:]]
    if later:
        gone = later[0]
        for df in later[1:]:
            gone = gone.unionByName(df)
        gone = gone.groupBy("key__").agg(F.max("last__").alias("last__"))
        out = out.join(gone, (F.col(key) == F.col("key__")) & (F.col(_WRITE) < F.col("last__")), "left_anti")
    return out.drop(_WRITE)


def compact(spark: SparkSession, path: str, key: str = "document_id") -> None:
    """All rows that count as one write, in ranges of the key, so that a search by key reads few files. Readers go on meanwhile.

    A document that holds a large part of all rows is spread over several ranges by a hash of its rows.
    """
    n = _numbers(spark, path)[1]
    rows = read_documents(spark, path, key)
    plain = [f.name for f in rows.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    rows.repartitionByRange(F.col(key), F.xxhash64(*plain)).sortWithinPartitions(key).write.parquet(f"{path}/rows/write={n}")
    rows.select(key).limit(0).write.parquet(f"{path}/commits/base={n}")


def vacuum(spark: SparkSession, path: str) -> int:
    """Folders of superseded and of broken writes go; how many went. For times without a writer or a reader of what was before the last compaction."""
    counted = set(_numbers(spark, path)[0])
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = [f"{path}/{part}/{name}" for part in ("commits", "rows") for name in _children(spark, f"{path}/{part}") if int(name.partition("=")[2]) not in counted]
    for place in old:
        fs.delete(fs_path(place), True)
    return len(old)
