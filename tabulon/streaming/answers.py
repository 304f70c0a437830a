"""Answers as logs of events: what a reader has of each, and the turns before a question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Types of the events of an answer.
EVENT_TYPES = ("status", "sources", "visual", "visual_skipped", "token", "citation", "done", "error")


def fold_answers(events: DataFrame) -> DataFrame:
    """(message_id, text, stage, citations array of (n, text)) of each answer; events delivered twice count once.

    events: message_id, seq, type, text (the token, stage or citation), n (of a citation). A citation's number keeps its first place
    and its last text. An answer has some thousand events at most, so one is gathered in a row.
    """
    log = events.groupBy("message_id").agg(F.array_sort(F.collect_set(F.struct("seq", "type", "text", "n"))).alias("log"))
    of = lambda *types: F.filter("log", lambda e: e["type"].isin(*types))
    text = F.array_join(F.transform(of("token"), lambda e: e["text"]), "")
    last = F.get(F.reverse(of("status", "done", "error")), F.lit(0))
    stage = F.when(last["type"] == "done", "done").when(last["type"] == "error", "failed").otherwise(last["text"])
    cites = of("citation")
    numbers = F.array_distinct(F.transform(cites, lambda e: e["n"]))
    citations = F.transform(numbers, lambda n: F.struct(n.alias("n"), F.get(F.reverse(F.filter(cites, lambda e: e["n"] == n)), F.lit(0))["text"].alias("text")))
    return log.select("message_id", text.alias("text"), stage.alias("stage"), citations.alias("citations"))


def recent_turns(messages: DataFrame, turns: int) -> DataFrame:
    """The last 2 * turns messages of each workspace that didn't fail, without empty ones; `place` counts from the oldest.

    messages: workspace_id, created_at, id, role, content, status. Ties in time go by id. The first rank is a limit per group, which
    Spark takes before the shuffle.
    """
    of = W.partitionBy("workspace_id")
    rank = F.row_number().over(of.orderBy(F.desc("created_at"), F.desc("id")))
    rows = messages.where(~F.col("status").eqNullSafe("failed")).withColumn("rank_", rank).where(F.col("rank_") <= 2 * max(turns, 0))
    rows = rows.where("content is not null and content <> ''")
    return rows.withColumn("place", F.row_number().over(of.orderBy(F.desc("rank_")))).drop("rank_")
