"""Files that come in: refused, known already, or new; by folder or by a manifest. Answers recorded earlier, replayed by content."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import HEAD, sniff

MOST_BYTES = 20 << 20
_FOUND = "filename string, content binary, length long"


def _in_folder(spark: SparkSession, path: str, most_bytes: int) -> DataFrame:
    """Files of a folder; of those that are too large only name and length are read."""
    found = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("filename")
    small = found.where(F.col("length") <= most_bytes).select(name, "content", "length")
    return small.unionByName(found.where(F.col("length") > most_bytes).select(name, F.lit(None).cast("binary").alias("content"), "length"))


def _sniffed(found: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kinds = [(None, False) if h is None else sniff(bytes(h), n) for h, n in zip(frame["head"], frame["filename"], strict=True)]
            yield frame.drop(columns="head").assign(source_format=[k for k, _ in kinds], mismatch=[m for _, m in kinds])

    return found.withColumn("head", F.substring("content", 1, HEAD)).select("filename", "length", "content", "head").mapInPandas(run, "filename string, length long, content binary, source_format string, mismatch boolean")


def _judged(found: DataFrame, workspace_id: str, stored: DataFrame | None, most_bytes: int) -> DataFrame:
    out = _sniffed(found).withColumns({"workspace_id": F.lit(workspace_id), "content_hash": F.sha2("content", 256)})
    names = out.where("source_format is not null").groupBy(F.col("content_hash")).agg(F.min("filename").alias("first_name"))
    if stored is not None:
        known = stored.where(F.col("workspace_id") == workspace_id).select("content_hash").distinct().withColumn("known", F.lit(True))
        names = names.join(known, "content_hash", "left")
    else:
        names = names.withColumn("known", F.lit(None).cast("boolean"))
    out = out.join(names, "content_hash", "left")
    reason = F.when(F.col("length") > most_bytes, f"larger than {most_bytes} bytes").when(F.col("source_format").isNull(), "unknown format")
    status = F.when(reason.isNotNull(), "refused").when(F.col("known") | (F.col("filename") != F.col("first_name")), "duplicate").otherwise("new")
    out = out.withColumns({"status": status, "reason": reason})
    return out.select("workspace_id", "filename", "content_hash", "length", "source_format", "mismatch", "status", "reason", F.when(F.col("status") == "new", F.col("content")).alias("content"))


def intake(spark: SparkSession, path: str, workspace_id: str, stored: DataFrame | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """A row per file of a folder: (workspace_id, filename, content_hash, length, source_format, mismatch, status, reason, content).

    status: refused (with its reason: too large, of unknown format), duplicate (equal content is in `stored`
    (workspace_id, content_hash) under this workspace, or under a lesser name of this folder) or new, which alone keeps its content.
    One bad file leaves the others alone. A file that is too large isn't read; files of no bytes have no row, as Spark's reader passes over them.
    """
    return _judged(_in_folder(spark, path, most_bytes), workspace_id, stored, most_bytes)


def from_manifest(spark: SparkSession, path: str, workspace_id: str, stored: DataFrame | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """intake of the files that `manifest.json` of the folder names: a list, or a list under "documents", of names or of objects with "file".

    A name that the folder hasn't gives a row of status missing, with reason "not in the folder"; a manifest that is no JSON, one row of status refused.
    """
    text = spark.read.text(f"{path}/manifest.json", wholetext=True)
    good = F.try_parse_json("value").isNotNull()
    entries = F.coalesce(F.from_json("value", "documents array<string>")["documents"], F.from_json("value", "array<string>"))
    entry = text.where(good).select(F.explode(entries).alias("entry"))
    named = entry.select(F.when(F.col("entry").startswith("{"), F.get_json_object("entry", "$.file")).otherwise(F.col("entry")).alias("filename")).distinct()
    found = _in_folder(spark, path, most_bytes).join(named, "filename", "left_semi")
    judged = _judged(found, workspace_id, stored, most_bytes)
    listed = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("filename"))
    row = lambda df, name, status, reason: df.select(F.lit(workspace_id).alias("workspace_id"), name.alias("filename"), F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    lost = row(named.join(listed, "filename", "left_anti").unionByName(named.where("filename is null")).distinct(), F.coalesce("filename", F.lit("(unnamed)")), "missing", "not in the folder")
    broken = row(text.where(~good), F.lit("manifest.json"), "refused", "not valid JSON")
    return judged.unionByName(lost, allowMissingColumns=True).unionByName(broken, allowMissingColumns=True)


def replay(requests: DataFrame, path: str) -> DataFrame:
    """Requests (content_hash, kind, schema_version) with what was recorded for them: `response` (JSON text), `error` for a record that is no JSON.

    A record is the file `<first 16 of the hash>-<kind>[-v<version>].json` of the folder; the key is of the content, so it outlives
    changes of wording. A request without a record has neither. The requests' other columns stay.
    """
    spark = requests.sparkSession
    version = F.when(F.col("schema_version").isNotNull(), F.concat(F.lit("-v"), F.col("schema_version").cast("string"))).otherwise("")
    key = F.concat(F.substring("content_hash", 1, 16), F.lit("-"), F.col("kind"), version, F.lit(".json"))
    records = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("record__"), F.col("value").alias("text__"))
    good = F.try_parse_json("text__").isNotNull()
    out = requests.withColumn("record__", key).join(records, "record__", "left")
    error = F.when(F.col("text__").isNotNull() & ~good, F.concat(F.lit("the recorded response "), F.col("record__"), F.lit(" is not valid JSON")))
    return out.withColumns({"response": F.when(good, F.col("text__")), "error": error}).drop("record__", "text__")
