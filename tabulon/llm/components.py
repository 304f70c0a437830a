"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """links (a, b) -> (v, c): each linked vertex and the smallest vertex of its component.

    Every round takes the least label of the neighbours, then the label of that label, so long chains halve.
    Rows are pre-aggregated by vertex before each shuffle; a round is written to the shared folder.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = scratch.keep(both.distinct(), f"{name}-edges")
    labels = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("least")).select("v", F.least("v", "least").alias("c"))
    done, turn = False, 0
    labels = scratch.keep(labels, f"{name}-0")
    while not done:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        next_ = labels.join(near, "v", "left").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        up = labels.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        next_ = next_.join(up, "c", "left").select("v", "old", F.least("c", "cc").alias("c"))
        turn += 1
        written = scratch.keep(next_, f"{name}-{turn}")
        done = written.where("c <> old").isEmpty()
        labels = written.select("v", "c")
        scratch.drop(f"{name}-{turn - 1}")
    return labels
