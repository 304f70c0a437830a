"""Answers in flight as streams: buffers that readers follow from any place, heartbeats, expiry, and the rewriter over micro-batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import Rewriter

#: kind: open, event (payload), follow (reader, after), leave (reader), close. place orders the rows of an answer that come together.
REQUESTS = "message_id string, place long, kind string, reader string, after long, payload string"
DELIVERIES = "message_id string, reader string, seq long, type string, payload string"
MOST_EVENTS, HEARTBEAT_S, GRACE_S = 4000, 15.0, 60.0


class AnswerBuffer(StatefulProcessor):
    """The events of an answer, its readers and how far each is, in the state store.

    A reader gets what is buffered after its place and then what comes, each event once; a heartbeat after `heartbeat_s` without
    anything; and an end when the answer is closed and it has all. `grace_s` after closing the state goes, and who follows
    then, or follows what was never opened, gets `gone`. Events after closing, or beyond `most`, are dropped.
    """

    def __init__(self, heartbeat_s: float, grace_s: float, most: int) -> None:
        self.heartbeat, self.grace, self.most = int(heartbeat_s * 1000), int(grace_s * 1000), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "seq long, payload string")
        self.readers = handle.getMapState("readers", "reader string", "seen long, heard long")
        self.life = handle.getValueState("life", "n long, closed boolean, expires long")

    def _wake_at(self, when: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(when)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        life = self.life.get() if self.life.exists() else None
        n, closed, expires = life or (0, False, 0)
        fresh, out, following = [], [], {r[0]: [s, heard] for (r, (s, heard)) in self.readers.iterator()} if life else {}
        for row in pd.concat(list(rows)).sort_values("place").itertuples():
            if row.kind == "open" and life is None:
                life = (0, False, 0)
            elif life is None:
                out += [(key[0], row.reader, None, "gone", None)] if row.kind == "follow" else []
            elif row.kind == "event" and not closed and n < self.most:
                n += 1
                fresh.append((n, row.payload))
            elif row.kind == "follow":
                following[row.reader] = [max(0, int(row.after)), now]
            elif row.kind == "leave":
                following.pop(row.reader, None)
            elif row.kind == "close" and not closed:
                closed, expires = True, now + self.grace
        if life is not None:
            if fresh:
                self.events.appendList(fresh)
            least = min((seen for seen, _ in following.values()), default=n)
            held = [] if least >= n else fresh if least >= n - len(fresh) else list(self.events.get())
            for reader, state in list(following.items()):
                new = [(key[0], reader, seq, "event", payload) for seq, payload in held if seq > state[0]]
                if new:
                    state[:] = [n, now]
                out += new
                if closed:
                    out.append((key[0], reader, n, "end", None))
                    del following[reader]
            self._keep(following)
            self.life.update((n, closed, expires))
            if closed:
                self._wake_at(expires)
            elif following:
                self._wake_at(min(heard for _, heard in following.values()) + self.heartbeat)
        yield self._frame(out)

    def _keep(self, following: dict[str, list[int]]) -> None:
        self.readers.clear()
        for reader, (seen, heard) in following.items():
            self.readers.updateValue((reader,), (seen, heard))

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["message_id", "reader", "seq", "type", "payload"])
        return out.astype({"message_id": object, "reader": object, "seq": "Int64", "type": object, "payload": object})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        life = self.life.get() if self.life.exists() else None
        out: list[tuple] = []
        if life and life[1]:
            if now >= life[2]:
                for state in (self.events, self.readers, self.life):
                    state.clear()
        elif life:
            following = {r[0]: [s, heard] for (r, (s, heard)) in self.readers.iterator()}
            for reader, state in following.items():
                if now - state[1] >= self.heartbeat:
                    state[1] = now
                    out.append((key[0], reader, state[0], "heartbeat", None))
            self._keep(following)
            if following:
                self._wake_at(min(heard for _, heard in following.values()) + self.heartbeat)
        yield self._frame(out)

    def close(self) -> None:
        pass


def follow_answers(requests: DataFrame, *, heartbeat_s: float = HEARTBEAT_S, grace_s: float = GRACE_S, most: int = MOST_EVENTS) -> DataFrame:
    """A stream of REQUESTS to a stream of DELIVERIES, by answer; needs the RocksDB state store. State is committed with each micro-batch, so a restart repeats or loses nothing."""
    return requests.groupBy("message_id").transformWithStateInPandas(AnswerBuffer(heartbeat_s, grace_s, most), DELIVERIES, "append", "ProcessingTime")


#: kind: chunk (name: its id, text: the citation), figure (name: its path, text, unit), delta (text), end. position counts an answer's rows from 0.
PARTS = "message_id string, position long, kind string, name string, text string, unit string"
REWRITTEN = "message_id string, seq long, type string, text string, n int"


class RewriteStream(StatefulProcessor):
    """The rewriter of an answer between micro-batches: text held back, notes so far, known chunks and figures, and parts that came too early.

    Parts are taken in the order of their positions, whenever they come; one that comes again is passed over. Text of one
    micro-batch becomes one token event between two citations, which stands for merging what comes within some milliseconds.
    """

    def __init__(self, keep_s: float) -> None:
        self.keep_ms = int(keep_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "next long, seq long, pending string, unit string, ended boolean", self.keep_ms)
        self.known = handle.getMapState("known", "chunk string", "citation string", self.keep_ms)
        self.figures = handle.getMapState("figures", "path string", "text string, unit string", self.keep_ms)
        self.notes = handle.getMapState("notes", "chunk string", "n int", self.keep_ms)
        self.early = handle.getMapState("early", "position long", "kind string, name string, text string, unit string", self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        next_, seq, pending, unit, ended = self.at.get() if self.at.exists() else (0, 0, "", None, False)
        clean = lambda x: None if x is None or x != x else x
        parts = {p[0]: v for p, v in self.early.iterator()}
        for r in pd.concat(list(rows)).itertuples():
            if r.position >= next_ and not ended:
                parts[int(r.position)] = (r.kind, clean(r.name), clean(r.text), clean(r.unit))
        # a row per entry; an answer cites and quotes some dozen
        known = {c[0]: t[0] for c, t in self.known.iterator()}
        figures = {p[0]: tuple(v) for p, v in self.figures.iterator()}
        notes = {c[0]: n[0] for c, n in self.notes.iterator()}
        rewriter = Rewriter(known.get, figures, pending or "", notes, unit)
        events: list[tuple] = []
        while next_ in parts and not ended:
            kind, name, text, of = parts.pop(next_)
            next_ += 1
            if kind == "chunk":
                known[name] = text or ""
                self.known.updateValue((name,), (text or "",))
            elif kind == "figure":
                figures[name] = (text or "", of)
                self.figures.updateValue((name,), (text or "", of))
            elif kind == "delta":
                events += rewriter.feed(text or "")
            elif kind == "end":
                events += rewriter.flush()
                ended = True
        merged: list[list] = []
        for type_, what in events:
            if type_ == "token" and merged and merged[-1][0] == "token":
                merged[-1][1] += what
            elif type_ == "token":
                merged.append(["token", what, None])
            else:
                merged.append([type_, what[1], what[0]])
        for chunk, n in rewriter.notes.items():
            self.notes.updateValue((chunk,), (n,))
        self.early.clear()
        if ended:
            for state in (self.known, self.figures, self.notes):
                state.clear()
        else:
            for position, part in parts.items():
                self.early.updateValue((position,), part)
        self.at.update((next_, seq + len(merged), rewriter.pending, rewriter.unit, ended))
        out = pd.DataFrame([(key[0], seq + k, t, x, n) for k, (t, x, n) in enumerate(merged, 1)], columns=["message_id", "seq", "type", "text", "n"])
        yield out.astype({"message_id": object, "seq": "int64", "type": object, "text": object, "n": "Int32"})

    def close(self) -> None:
        pass


def rewrite_stream(parts: DataFrame, *, keep_s: float = 3600.0) -> DataFrame:
    """A stream of PARTS to REWRITTEN events; the text of an answer doesn't depend on where it was cut, nor on the micro-batches. State goes `keep_s` after the last change."""
    return parts.groupBy("message_id").transformWithStateInPandas(RewriteStream(keep_s), REWRITTEN, "append", "ProcessingTime")
