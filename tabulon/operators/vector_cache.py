"""A store of label vectors by embedding space, filled by what is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 64
STORED = "space string, text string, batch string, embedding array<double>"


class LengthMismatch(ValueError):
    """An embedder gave another number of vectors than it got texts."""


def vectors_for(texts: DataFrame, path: str, space: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(text, embedding) of the distinct, non-empty texts: stored ones are read, the others embedded and appended, once, whatever they are asked for later.

    embed: (text, batch) to (text, batch, embedding); batches hold about BATCH texts. A batch of which it gives back another number
    of rows is stored without vectors, all of it, as a vector of the wrong text is worse than none; so is a null vector, which
    isn't asked for again. The store is partitioned by space: vectors of one are never compared with another's, and reading is pruned.
    """
    spark = texts.sparkSession
    wanted = texts.select("text").where("text is not null and text <> ''").distinct()

    def stored() -> DataFrame:
        known = spark.read.schema(STORED).parquet(path).where(F.col("space") == space)
        return known.groupBy("text").agg(F.first("embedding", ignorenulls=True).alias("embedding"))  # two runs at once may both have stored one

    spark.createDataFrame([], STORED).write.partitionBy("space").mode("append").parquet(path)
    missing = wanted.join(stored(), "text", "left_anti")
    n = missing.count()
    if n:
        asked = missing.withColumn("batch", F.pmod(F.xxhash64("text"), F.lit(-(-n // BATCH))).cast("string"))
        given = embed(asked).select("text", "batch", "embedding")
        sizes = given.groupBy("batch").agg(F.count("*").alias("got"))
        whole = asked.groupBy("batch").agg(F.count("*").alias("n")).join(sizes, "batch").where("n = got").select("batch")
        kept = given.join(whole, "batch", "left_semi").groupBy("text").agg(F.first("embedding").alias("embedding"))
        asked.join(kept, "text", "left").select(F.lit(space).alias("space"), "text", "batch", "embedding").write.partitionBy("space").mode("append").parquet(path)
    return wanted.join(stored(), "text", "left").select("text", "embedding")
