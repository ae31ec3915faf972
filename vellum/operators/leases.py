"""Leases, failures and escalation replayed from events, in batch; ``streaming`` has them as streams.

Events come as (task, at TIMESTAMP, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold

TTL, HISTORY = 900, 256
FIRST_DELAY, MOST_DELAY, MOST_ATTEMPTS = 30, 3600, 5


def latest(events: DataFrame, until: str) -> DataFrame:
    """State of each lease (task, owner) at a moment: last event, whether it expired, seconds left."""
    e = events.where(F.col("at") <= F.lit(until).cast("timestamp")).groupBy("task").agg(F.max(F.struct("at", "event_id", "owner", "action")).alias("e"))
    left = F.lit(TTL) - (F.unix_timestamp(F.lit(until).cast("timestamp")) - F.unix_timestamp(F.col("e.at")))
    status = F.when(F.col("e.action") == "release", "released").when(left <= 0, "expired").otherwise("active")
    return e.select("task", "e.owner", "e.action", status.alias("status"), F.greatest(F.lit(0).cast("long"), left).alias("seconds_left"))


def renewals(events: DataFrame, ttl: int = TTL) -> DataFrame:
    """Every event with what it does to its lease: claimed, or renewed within ``ttl`` seconds of the event before."""
    w = Window.partitionBy("task").orderBy("at", "event_id")
    age = F.unix_timestamp("at") - F.unix_timestamp(F.lag("at").over(w))
    return events.select("task", "event_id", "at", age.alias("age")).withColumn("status", F.when(F.col("age") < ttl, "renewed").otherwise("claimed"))


def sessions(events: DataFrame, gap: int = TTL) -> DataFrame:
    """Runs of events of a task with less than ``gap`` seconds between: (task, nth, first, last, n)."""
    w = Window.partitionBy("task").orderBy("at", "event_id")
    rows = events.withColumn("starts", F.coalesce((F.unix_timestamp("at") - F.unix_timestamp(F.lag("at").over(w)) >= gap).cast("long"), F.lit(1).cast("long")))
    rows = rows.withColumn("nth", F.sum("starts").over(w))
    return rows.groupBy("task", "nth").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))


def conflicts(leases: DataFrame) -> DataFrame:
    """Active leases (lease, files ARRAY) that share a file: (file, n, first, last). Files are exploded, so that it is a grouped count."""
    return leases.select("lease", F.explode(F.array_distinct("files")).alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("lease").alias("first"), F.max("lease").alias("last")).where("n > 1")


def inactive_kept(leases: DataFrame, most: int = HISTORY) -> DataFrame:
    """All active leases and, of each task's inactive ones, the last ``most``."""
    w = Window.partitionBy("task", F.col("status") == "active").orderBy(F.desc("at"), F.desc("event_id"))
    return leases.withColumn("nth", F.row_number().over(w)).where((F.col("status") == "active") | (F.col("nth") <= most)).drop("nth")


def delay(attempt: Column) -> Column:
    """Seconds before the n-th try again: 30 doubled each time, an hour at most."""
    return F.least(F.lit(FIRST_DELAY) * F.pow(F.lit(2.0), F.least(attempt, F.lit(20)) - 1), F.lit(float(MOST_DELAY))).cast("long")


def retry_at(now: Column, kind: Column, attempt: Column, after: Column, reset: Column) -> Column:
    """(at, blocked): a given delay wins; a quota waits for its reset and is blocked without one; so is a task past 5 tries."""
    at = F.when(after.isNotNull(), F.timestamp_seconds(F.unix_timestamp(now) + after)).when(kind == "quota", reset).otherwise(F.timestamp_seconds(F.unix_timestamp(now) + delay(attempt)))
    blocked = ((kind == "quota") & reset.isNull() & after.isNull()) | (attempt > MOST_ATTEMPTS)
    return F.struct(F.when(~blocked, at).alias("at"), blocked.alias("blocked"))


def slots(configured: Column, wave: Column, temporary: Column, active: Column) -> Column:
    """Free slots under the least of the caps that are set."""
    return F.greatest(F.lit(0), F.least(configured, wave, temporary) - active)


def escalated(signals: DataFrame) -> DataFrame:
    """Signals (task, file, kind, seen: times in order of at, resolved): the state after the last: first or after a resolution retry,
    from the second on human review. (task, file, kind, n, state)."""
    w = Window.partitionBy("task", "file", "kind").orderBy("at", "event_id")
    rows = signals.withColumn("era", F.sum(F.col("resolved").cast("long")).over(w))
    last = rows.groupBy("task", "file", "kind").agg(F.max("era").alias("era"), F.max(F.struct("at", "event_id", "resolved")).alias("l"))
    n = rows.where("not resolved").groupBy("task", "file", "kind", "era").agg(F.count(F.lit(1)).alias("n"))
    out = last.join(n, ["task", "file", "kind", "era"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.select("task", "file", "kind", "n", F.when(F.col("l.resolved"), "resolved").when(F.col("n") >= 2, "human_review_required").otherwise("retry").alias("state"))


def replayed(events: DataFrame, ttl: int = TTL) -> DataFrame:
    """Claims (task, at, event_id, digest, owner, files) as the protocol answers them: same digest and owner renews, another owner finds it already
    active, shared files are a conflict, else claimed; leases expire after ``ttl`` seconds. (task, event_id, status)."""

    def start():
        return {}

    def step(live, row):
        if row is None:
            return live, []
        now = row["at"]
        live = {d: x for d, x in live.items() if x[0] > now}
        mine = live.get(row["digest"])
        if row["action"] == "release":
            status = "released" if mine and mine[1] == row["owner"] else "not_owner" if mine else "not_found"
            if status == "released":
                live.pop(row["digest"])
        elif mine:
            status = "renewed" if mine[1] == row["owner"] else "already_active"
            if status == "renewed":
                live[row["digest"]] = (now + ttl, row["owner"], mine[2])
        elif any(set(x[2]) & set(row["files"]) for x in live.values()):
            status = "conflict"
        else:
            status = "claimed"
            live[row["digest"]] = (now + ttl, row["owner"], row["files"])
        return live, [(row["task"], row["event_id"], status)]

    given = events.select("task", F.unix_timestamp("at").alias("at"), "event_id", "digest", "owner", "files", "action")
    return fold(given, ["task"], ["at", "event_id"], start, step, "task string, event_id long, status string")
