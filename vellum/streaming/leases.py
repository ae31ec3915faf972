"""Leases and escalation as streams, with keyed state and timers.

The key of leases is the task, as conflicts span assignments. State is a map from digest to (expiry, owner, files); expired
entries go when the next event of the task comes or when the event-time timer of the earliest expiry fires. Events later than
the watermark are dropped by Spark. The answers equal those of ``operators.leases.replayed`` for events in order of time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.leases import TTL

ANSWER = "task string, event_id long, status string"
SIGNAL = "task string, file string, kind string, n long, state string"


def rocksdb(spark) -> None:
    """State with timers and maps needs the RocksDB provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Leases(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getMapState("live", "digest string", "expires long, owner string, files string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "event_id"])
        live = {k[0]: list(v) for k, v in self.live.iterator()} if self.live.exists() else {}
        out = []
        for row in events.itertuples(index=False):
            now, files = int(row.at_s), row.files.split("\x1f")
            live = {d: x for d, x in live.items() if x[0] > now}
            mine = live.get(row.digest)
            if row.action == "release":
                status = "released" if mine and mine[1] == row.owner else "not_owner" if mine else "not_found"
                if status == "released":
                    live.pop(row.digest)
            elif mine:
                status = "renewed" if mine[1] == row.owner else "already_active"
                if status == "renewed":
                    live[row.digest] = [now + TTL, row.owner, mine[2]]
            elif any(set(x[2].split("\x1f")) & set(files) for x in live.values()):
                status = "conflict"
            else:
                status = "claimed"
                live[row.digest] = [now + TTL, row.owner, row.files]
            out.append((key[0], int(row.event_id), status))
        self._keep(live)
        yield pd.DataFrame(out, columns=["task", "event_id", "status"])

    def _keep(self, live: dict) -> None:
        if self.live.exists():
            self.live.clear()
        for d, x in live.items():
            self.live.updateValue((d,), (int(x[0]), x[1], x[2]))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if live:
            self.handle.registerTimer(min(int(x[0]) for x in live.values()) * 1000)

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        now = expired.getExpiryTimeInMs() // 1000
        self._keep({k[0]: list(v) for k, v in self.live.iterator() if v[0] > now} if self.live.exists() else {})
        yield pd.DataFrame({"task": [], "event_id": [], "status": []}).astype({"task": str, "event_id": "int64", "status": str})

    def close(self) -> None:
        pass


def answered(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Answers to a stream of (task, at TIMESTAMP, event_id, digest, owner, files ARRAY, action)."""
    rocksdb(events.sparkSession)
    rows = events.withWatermark("at", late).select("task", "at", F.unix_timestamp("at").alias("at_s"), "event_id", "digest", "owner", F.array_join("files", "\x1f").alias("files"), "action")
    return rows.groupBy("task").transformWithStateInPandas(Leases(), outputStructType=ANSWER, outputMode="Append", timeMode="EventTime")


class Signals(StatefulProcessor):
    """Retry counts of (file, kind) within a task: from the second signal human review, until one is resolved."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "file string, kind string", "n long, state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        out = []
        for row in pd.concat(list(rows)).sort_values(["at", "event_id"]).itertuples(index=False):
            at = (row.file, row.kind)
            n, state = self.counts.getValue(at) if self.counts.containsKey(at) else (0, "resolved")
            if row.resolved:
                n, state = 0, "resolved"
            else:
                n = 1 if state == "resolved" else n + 1
                state = "human_review_required" if n >= 2 else "retry"
            self.counts.updateValue(at, (n, state))
            out.append((key[0], row.file, row.kind, n, state))
        yield pd.DataFrame(out, columns=["task", "file", "kind", "n", "state"])

    def close(self) -> None:
        pass


def escalations(signals: DataFrame) -> DataFrame:
    """Every state that a stream of (task, file, kind, at, event_id, resolved) goes through."""
    rocksdb(signals.sparkSession)
    return signals.groupBy("task").transformWithStateInPandas(Signals(), outputStructType=SIGNAL, outputMode="Update", timeMode="None")


def session_counts(events: DataFrame, gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows of a stream of (task, at)."""
    return events.withWatermark("at", late).groupBy("task", F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("n")).select("task", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("until"), "n")
