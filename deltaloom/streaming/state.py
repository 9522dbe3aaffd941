"""Keyed state of streams: edge changes gathered until a flush, feedback of own writes held back, the last conflicts of each agent.

All three run on transformWithState with state in RocksDB (``spark.sql.streaming.stateStore.providerClass``), which a restart from the
checkpoint takes up again. Time is event time: what a key holds goes when the watermark passes its time to live, and a
late event that comes before the watermark is seen in its place. Keys with null parts are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Seconds between flushes, seconds that a written file is known as one's own, seconds after which a change of it is an edit, conflicts kept.
FLUSH, OWN, EDIT, KEPT = 30, 60, 1, 10
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class EdgeChanges(StatefulProcessor):
    """Edges that a file gains and loses, in order of time, emitted together and cleared FLUSH seconds after the first one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.edges = handle.getListState("edges", "ms bigint, side string, src string, type string, dst string")
        self.due = handle.getValueState("due", "ms bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.ms, r.side, r.src, r.type, r.dst) for r in rows]
        self.edges.appendList(new)
        if not self.due.exists():
            due = min(n[0] for n in new) + FLUSH * 1000
            self.due.update((due,))
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = sorted(tuple(e) for e in self.edges.get())
        self.edges.clear()
        self.due.clear()
        side = lambda s: [(src, kind, dst) for _, at, src, kind, dst in held if at == s]
        yield Row(file=key[0], added=side("added"), removed=side("removed"))

    def close(self) -> None:
        pass


def edge_updates(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """file, added, removed (lists of src, type, dst) for a stream of file, ts, side (added or removed), src, type, dst."""
    edge = "array<struct<src: string, type: string, dst: string>>"
    rows = events.where("file IS NOT NULL AND ts IS NOT NULL").withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)
    return rows.groupBy("file").transformWithState(EdgeChanges(), f"file string, added {edge}, removed {edge}", "append", "eventTime")


class OwnWrites(StatefulProcessor):
    """Passes on what people change; an event of a file that was just written by the sync itself is not one of these."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.written = handle.getValueState("written", "ms bigint, digest string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r.ms, r.origin != "sync", r.digest or "")):
            if r.origin == "sync":
                self.written.update((r.ms, r.digest))
                self.handle.registerTimer(r.ms + OWN * 1000 + 1)
                continue
            held = self.written.get() if self.written.exists() else None
            if held is not None and r.ms - held[0] <= OWN * 1000 and (r.digest == held[1] or r.ms - held[0] <= EDIT * 1000):
                continue  # an echo: the same content, or too soon for an edit
            if held is not None:
                self.written.clear()
            yield Row(path=key[0], ms=r.ms, digest=r.digest)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.written.exists() and self.written.get()[0] + OWN * 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.written.clear()
        return iter(())

    def close(self) -> None:
        pass


def edits(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """path, ms, digest of the events (path, ts, origin, digest) that are no echo of a write with origin sync."""
    rows = events.where("path IS NOT NULL AND ts IS NOT NULL").withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)
    return rows.groupBy("path").transformWithState(OwnWrites(), "path string, ms bigint, digest string", "append", "eventTime")


class LastConflicts(StatefulProcessor):
    """The latest KEPT conflicts of a key, told anew whenever one comes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "ms bigint, file string, message string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = [tuple(k) for k in self.kept.get()] + [(r.ms, r.file, r.message) for r in rows]
        held = sorted(held, key=lambda k: (k[0], k[1] or "", k[2] or ""))[-KEPT:]
        self.kept.put(held)
        yield Row(agent=key[0], conflicts=held)

    def close(self) -> None:
        pass


def last_conflicts(events: DataFrame) -> DataFrame:
    """agent, conflicts (the latest ten: ms, file, message) for a stream of agent, ts, file, message; an update for each micro-batch that has any."""
    rows = events.where("agent IS NOT NULL AND ts IS NOT NULL").withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy("agent").transformWithState(LastConflicts(), "agent string, conflicts array<struct<ms: bigint, file: string, message: string>>", "update", "none")
