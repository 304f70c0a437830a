"""Ordered logs and the answer stream: sequences per key, resuming, barriers, and the rewriting of a token stream."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BUSY = ("uploaded", "parsing", "extracting", "indexing")


def with_sequence(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Numbers 1, 2, ... without gaps within each key."""
    return events.withColumn("seq", F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("long"))


class Sequencer(StatefulProcessor):
    """The same over a stream: a counter per key in the state store, committed with the micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n = self.last.get()[0] if self.last.exists() else 0
        for frame in rows:
            frame = frame.sort_values("event_id").reset_index(drop=True)
            frame["seq"] = range(n + 1, n + 1 + len(frame))
            n += len(frame)
            yield frame
        self.last.update((n,))

    def close(self) -> None:
        pass


def sequence_stream(events: DataFrame, key: str) -> DataFrame:
    """events: key, event_id, type, payload."""
    kinds = dict(events.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in events.columns), "seq long"])
    return events.groupBy(key).transformWithStateInPandas(Sequencer(), schema, "append", "None")


def resume(log: DataFrame, key: str, seen: DataFrame, most: int | None = None) -> DataFrame:
    """Events after the last one each key's reader has (`seen`: key, after), each once; all of them, or `most` per key and call."""
    rows = log.join(seen, key).where(F.col("seq") > F.col("after")).drop("after").dropDuplicates([key, "seq"])
    if most is not None:
        rows = rows.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy("seq"))).where(F.col("r") <= most).drop("r")
    return rows


def idle_groups(docs: DataFrame, group: str, busy: tuple[str, ...] = BUSY) -> DataFrame:
    """Groups none of whose documents is busy."""
    return docs.groupBy(group).agg(F.count("*").alias("documents"), F.count_if(F.col("status").isin(*busy)).alias("busy")).where("busy = 0").drop("busy")


def latest_by(log: DataFrame, key: str) -> DataFrame:
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), "seq").alias("e")).select(key, "e.*")


_CHUNK = re.compile(r"\[\^chunk:([0-9a-fA-F-]{36})\]")


@dataclass
class Rewriter:
    """Deltas of an answer to events: chunk markers become numbered notes, placeholders become figures.

    The text of the events doesn't depend on where the deltas were cut. resolve: chunk id to a citation or None; figures: path to (text, unit).
    """

    resolve: Callable[[str], Any]
    figures: dict[str, tuple[str, str | None]]
    pending: str = ""
    notes: dict[str, int] = field(default_factory=dict)
    unit: str | None = None

    def feed(self, delta: str) -> list[tuple[str, Any]]:
        self.pending += delta
        return self._run(last=False)

    def flush(self) -> list[tuple[str, Any]]:
        return self._run(last=True)

    def _text(self, out: list, text: str) -> None:
        if text:
            if out and out[-1][0] == "token":
                out[-1] = ("token", out[-1][1] + text)
            else:
                out.append(("token", text))

    def _without_unit(self, text: str, last: bool) -> tuple[str, str]:
        """Text to emit and text to wait with, after a figure that ended in a unit."""
        if self.unit is None or not text:
            return text, ""
        wanted = " " + self.unit
        lead = text if text.startswith(" ") else " " + text
        if len(lead) <= len(wanted) and wanted.lower().startswith(lead.lower()) and not last:
            return "", text
        if lead.lower().startswith(wanted.lower()) and not lead[len(wanted) : len(wanted) + 1].isalnum():
            text = lead[len(wanted) :]
        self.unit = None
        return text, ""

    def _run(self, last: bool) -> list[tuple[str, Any]]:
        out: list[tuple[str, Any]] = []
        while self.pending:
            spots = [i for i in (self.pending.find("[^"), self.pending.find("{{")) if i >= 0]
            if not spots:
                keep = 0 if last or self.pending[-1] not in "[{" else 1
                text, rest = self.pending[: len(self.pending) - keep], self.pending[len(self.pending) - keep :]
                done, wait = self._without_unit(text, last)
                self._text(out, done)
                self.pending = wait + rest
                break
            at = min(spots)
            if at:
                done, wait = self._without_unit(self.pending[:at], True)
                self._text(out, done)
                self.pending = self.pending[at:]
            close = "]" if self.pending.startswith("[^") else "}}"
            end = self.pending.find(close)
            if end < 0:
                if last:
                    self._text(out, self.pending)
                    self.pending = ""
                break
            whole, self.pending = self.pending[: end + len(close)], self.pending[end + len(close) :]
            self._one(out, whole)
        return out

    def _one(self, out: list, whole: str) -> None:
        self.unit = None
        if whole.startswith("{{"):
            found = self.figures.get(whole[2:-2].strip())
            if found:
                text, self.unit = found
                self._text(out, text)
            return
        if not whole.startswith("[^chunk:"):
            self._text(out, whole)
            return
        m = _CHUNK.fullmatch(whole)
        if not m:
            return
        if m[1] not in self.notes:
            citation = self.resolve(m[1])
            if citation is None:
                return
            self.notes[m[1]] = len(self.notes) + 1
            out.append(("citation", (self.notes[m[1]], citation)))
        self._text(out, f"[^{self.notes[m[1]]}]")


def rewrite_answers(deltas: DataFrame, known_chunks: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """(message_id, text, cited): the finished text of each message and the chunks that its notes cite, in their order.

    deltas: message_id, position, text; known_chunks: message_id, chunk_id; figures: message_id, path, text, unit. What a message may cite
    and quote comes beside its deltas, once, and not with each of them; an answer has some thousand deltas at most. A null text is empty.
    """
    none = F.lit(None).cast("string")
    source = known_chunks.select("message_id", F.col("chunk_id").alias("name"), none.alias("text"), none.alias("unit"), F.lit(False).alias("figure"))
    if figures is not None:
        source = source.unionByName(figures.select("message_id", F.col("path").alias("name"), "text", "unit", F.lit(True).alias("figure")))

    def run(key: tuple, said: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if said.empty:
            return pd.DataFrame([], columns=["message_id", "text", "cited"])
        chunks = set(known.loc[~known["figure"].astype(bool), "name"])
        shown = {r.name: (r.text, r.unit) for r in known[known["figure"].astype(bool)].itertuples(index=False, name="Figure")} if len(known) else {}
        w = Rewriter(lambda c: c if c in chunks else None, shown)
        events = [e for text in said.sort_values("position")["text"] for e in w.feed(text or "")] + w.flush()
        return pd.DataFrame([(key[0], "".join(x for kind, x in events if kind == "token"), [x[1] for kind, x in events if kind == "citation"])], columns=["message_id", "text", "cited"])

    kind = dict(deltas.dtypes)["message_id"]
    return deltas.select("message_id", "position", "text").groupBy("message_id").cogroup(source.groupBy("message_id")).applyInPandas(run, f"message_id {kind}, text string, cited array<string>")
