"""Packing units into batches, batches into waves and workers, and long texts into units.

Packing is sequential by definition: whether a unit starts a batch depends on all before it.
``folds.fold`` streams each sequence, sorted by Spark, with a state of a few numbers."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold

MOST_FILES, MOST_TOKENS, MOST_BYTES, MOST_LINES = 5, 12_000, 30_000, 350
LARGE, EXTREME = 12_000, 24_000


def severity(tokens: Column, large: int = LARGE, extreme: int = EXTREME) -> Column:
    return F.when(tokens >= extreme, "extreme").when(tokens >= large, "large").otherwise("ordinary")


def batches(df: DataFrame, by: str, unit: str, files: int = MOST_FILES, tokens: int = MOST_TOKENS, size: int = MOST_BYTES, lines: int = MOST_LINES) -> DataFrame:
    """Next-fit packing of (by, unit, tokens, bytes, lines) in order of unit: (by, unit, batch from 1, isolated)."""

    def start():
        return (1, 0, 0, 0, False)

    def step(state, row):
        if row is None:
            return state, []
        batch, n, t, ln, alone = state
        isolated = row["bytes"] > size or row["tokens"] > tokens or row["lines"] > lines
        if n and (alone or isolated or n >= files or t + row["tokens"] > tokens or ln + row["lines"] > lines):
            batch, n, t, ln = batch + 1, 0, 0, 0
        return (batch, n + 1, t + row["tokens"], ln + row["lines"], isolated), [(row[by], row[unit], batch, isolated)]

    kind = df.schema[by].dataType.simpleString().replace("bigint", "long")
    given = df.select(by, unit, F.col("tokens").cast("long"), F.col("bytes").cast("long"), F.col("lines").cast("long"))
    return fold(given, [by], [unit], start, step, f"{by} {kind}, {unit} long, batch long, isolated boolean")


def batch_queue(packed: DataFrame, stats: DataFrame, by: str, unit: str) -> DataFrame:
    """A row for each batch: by, batch, n_units, tokens, severity of its largest unit."""
    rows = packed.join(stats.select(by, unit, "tokens"), [by, unit])
    return rows.groupBy(by, "batch").agg(F.count(F.lit(1)).alias("n_units"), F.sum("tokens").alias("tokens"), severity(F.max("tokens")).alias("severity"))


def waves(df: DataFrame, by: str, order: str, cap: int = 3, reorder: bool = False) -> DataFrame:
    """Waves of (by, order, severity): runs of one severity, cut at a cap of 1 for extreme,
    2 at most for large, ``cap`` for ordinary groups. With ``reorder``, ordinary groups come before large ones
    between extreme ones. (by, order, wave from 1, reason, slots)."""
    df = df.select(by, order, "severity")
    w = Window.partitionBy(by).orderBy(order)
    if reorder:
        barrier = F.sum((F.col("severity") == "extreme").cast("long")).over(w)
        rank = F.when(F.col("severity") == "extreme", 0).when(F.col("severity") == "ordinary", 1).otherwise(2)
        w = Window.partitionBy(by).orderBy("segment", "rank", order)
        df = df.withColumn("segment", barrier).withColumn("rank", rank)
    slots = F.when(F.col("severity") == "extreme", 1).when(F.col("severity") == "large", F.least(F.lit(2), F.lit(cap))).otherwise(cap)
    turn = F.coalesce((F.lag("severity").over(w) != F.col("severity")).cast("long"), F.lit(1).cast("long"))
    df = df.withColumn("slots", slots).withColumn("place", F.row_number().over(w)).withColumn("turn", turn)
    df = df.withColumn("run", F.sum("turn").over(Window.partitionBy(by).orderBy("place")))
    df = df.withColumn("nth", F.row_number().over(Window.partitionBy(by, "run").orderBy("place")))
    df = df.withColumn("first", ((F.col("nth") - 1) % F.col("slots") == 0).cast("long"))
    return df.select(by, order, F.sum("first").over(Window.partitionBy(by).orderBy("place")).alias("wave"), F.col("severity").alias("reason"), "slots")


def concurrency(stats: DataFrame, by: str, cap: int = 3) -> DataFrame:
    """Workers that may run at once, from the severest unit of a group: 1, 2 or ``cap``."""
    worst = F.max("tokens")
    return stats.groupBy(by).agg(severity(worst).alias("severity"), F.when(worst >= EXTREME, 1).when(worst >= LARGE, min(2, cap)).otherwise(cap).alias("slots"))


def balanced(df: DataFrame, by: str, item: str, workers: int = 6) -> DataFrame:
    """Longest first to the least loaded worker (of ties, the first): (by, item, worker from 1)."""

    def start():
        return [(0, w) for w in range(1, workers + 1)]

    def step(heap, row):
        if row is None:
            return heap, []
        load, w = heapq.heappop(heap)
        heapq.heappush(heap, (load + row["tokens"], w))
        return heap, [(row[by], row[item], w)]

    kind = df.schema[by].dataType.simpleString().replace("bigint", "long")
    given = df.select(by, (-F.col("tokens").cast("long")).alias("rank"), item, F.col("tokens").cast("long"))
    return fold(given, [by], ["rank", item], start, step, f"{by} {kind}, {item} long, worker long")


def split_units(blocks: DataFrame, target: int = 4000, tail: float = 0.15) -> DataFrame:
    """Parts of long units from (unit, block_no, tokens): a part ends before the block that
    would take it past ``target``; a last part under ``tail`` of the target joins the one before.
    (unit, block_no, part from 1)."""

    def start():
        return {"parts": [], "rows": [], "now": 0}

    def step(state, row):
        if row is None:
            rows, sizes = state["rows"], state["parts"]
            last = len(sizes)
            if last > 1 and sizes[-1] < tail * target:
                rows = [(u, b, min(p, last - 1)) for u, b, p in rows]
            return state, rows
        sizes = state["parts"]
        if not sizes or (sizes[-1] and sizes[-1] + row["tokens"] > target):
            sizes.append(0)
        sizes[-1] += row["tokens"]
        made = []
        if len(sizes) > 2:  # only the last two parts can still change
            made = [r for r in state["rows"] if r[2] < len(sizes) - 1]
            state["rows"] = [r for r in state["rows"] if r[2] >= len(sizes) - 1]
        state["rows"].append((row["unit"], row["block_no"], len(sizes)))
        return state, made

    given = blocks.select("unit", F.col("block_no").cast("long"), F.col("tokens").cast("long"))
    kind = blocks.schema["unit"].dataType.simpleString().replace("bigint", "long")
    return fold(given, ["unit"], ["block_no"], start, step, f"unit {kind}, block_no long, part long")
