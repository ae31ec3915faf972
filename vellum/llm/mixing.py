"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets: the mix as a whole is ``share`` times all words; each source gets its part by
weight, but at most ``repeat`` times its own words, and what is above is shared again by
weight. Each source is dealt by a seeded hash of the key into shards of about
``SHARD_WORDS`` words, and each shard, its documents in seeded order, is cut into equal
blocks of about ``BLOCK_WORDS`` words. Block seats go to sources, and then to the shards
of a source, by the highest quotients votes / (2 * seats + 1). A shard with q seats for n
blocks takes every block q div n times, and q mod n blocks, those first in seeded
order, once more. Hot sources only have more shards.

Only a row for each source comes to the driver: sources are ranked against each other, and weighed by place.

Cases: null texts and texts without words have size 0 and are taken 0 times; a null
source is a source of its own, last in order; equal keys lie side by side in a shard and
are documents of their own; documents with a null key are dealt by their texts; an empty table gives
no rows; equal quotients go to the source first in order, the smaller shard, then the smaller number; a text
of any length is counted whole; other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Sequence
from math import ceil, floor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import WORD, arrow_rows, col, out_names, pieces, raw_texts, written

SHARD_WORDS, BLOCK_WORDS = 1 << 20, 128
SPANS = re.compile(WORD.encode())


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, repeat: float) -> list[float]:
    """Words for each source: ``share`` of all by weight, none above ``repeat`` times its size."""
    out, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        for i in open_:
            out[i] = left * weights[i] / total
        above = [i for i in open_ if out[i] > repeat * sizes[i]]
        if not above:
            break
        for i in above:
            out[i] = float(repeat * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(above)]
    return out


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int] | None = None) -> list[int]:
    """Seats by the highest quotients votes / (2 * seats + 1). Seats whose quotients lie above a divisor, found by halving, are
    given at once; the rest go one by one."""
    most = most or [seats] * len(votes)

    def above(divisor: float) -> list[int]:
        return [min(m, floor((v / divisor + 1) / 2)) if v > 0 else 0 for v, m in zip(votes, most, strict=True)]

    top = max(votes, default=0.0)
    if top <= 0:
        return [0] * len(votes)
    lo, hi = 0.0, top * 1.001  # at hi no seat is given
    for _ in range(100):
        mid = (lo + hi) / 2
        if mid <= 0 or sum(above(mid)) > seats:
            lo = mid
        else:
            hi = mid
    out = above(hi * (1 + 1e-12))
    heap = [(-v / (2 * s + 1), i) for i, (v, s) in enumerate(zip(votes, out, strict=True)) if s < most[i] and v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def class_seats(votes: Sequence[int], many: Sequence[int], seats: int) -> tuple[list[int], list[int]]:
    """Sainte-Laguë for classes of ``many`` parties with equal votes: seats of each party of a class, and how many of its parties
    get one more. Of equal quotients those of the smaller votes come first."""

    def above(divisor: float) -> list[int]:
        return [floor((v / divisor + 1) / 2) for v in votes]

    lo, hi = 0.0, max(votes) * 1.001
    for _ in range(100):
        mid = (lo + hi) / 2
        if mid <= 0 or sum(m * s for m, s in zip(many, above(mid), strict=True)) > seats:
            lo = mid
        else:
            hi = mid
    base = above(hi * (1 + 1e-12))
    extra, left = [0] * len(votes), seats - sum(m * s for m, s in zip(many, base, strict=True))
    heap = [(-v / (2 * s + 1), v, i) for i, (v, s) in enumerate(zip(votes, base, strict=True))]
    heapq.heapify(heap)
    while left > 0:
        _, v, i = heapq.heappop(heap)
        if left < many[i]:
            extra[i] = left
            break
        left -= many[i]
        base[i] += 1
        heapq.heappush(heap, (-v / (2 * base[i] + 1), v, i))
    return base, extra


def _unit(seed: int, *parts: Column) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


def mix(
    df: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, repeat: int = 2, seed: int = 11,
    text: str = "text", key: str = "doc_id", source: str = "source", shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row for each row of ``df``: key, source, text_hash, size, source_size, target (of
    the source), taken, and pieces: the ranges of words taken (lo, hi, times)."""
    spark = df.sparkSession
    docs = written(
        df.select(
            col(key).alias("key"), col(source).cast("string").alias("source"), F.xxhash64(col(text)).alias("text_hash"),
            F.coalesce(F.regexp_count(col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
        ),
        "mix-sizes",
    )
    found = docs.groupBy("source").agg(F.sum("size").alias("size")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, repeat)
    shards = [max(1, ceil(s / shard_words)) for s in sizes]
    plan = spark.createDataFrame(
        [(r["source"], r["size"], float(t), n) for r, t, n in zip(found, goal, shards, strict=True)],
        "source string, source_size long, target double, shards long",
    )
    docs = docs.join(F.broadcast(plan.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    docs = docs.withColumn("shard", F.pmod(_unit(seed, F.col("key"), F.when(F.col("key").isNull(), F.col("text_hash"))), F.col("shards")))
    full = docs.where("size > 0")

    cut = written(
        full.groupBy("source", "shard").agg(F.sum("size").alias("words"))
        .withColumn("blocks", F.greatest(F.lit(1).cast("long"), F.round(F.col("words") / block_words).cast("long"))),
        "mix-shards",
    )
    have = {r["source"]: r["n"] for r in cut.groupBy("source").agg(F.sum("blocks").alias("n")).collect()}
    blocks = [have.get(r["source"], 0) for r in found]
    votes = [t * b / s if s else 0.0 for t, b, s in zip(goal, blocks, sizes, strict=True)]
    seats = sainte_lague(votes, floor(sum(votes) + 0.5), [repeat * b for b in blocks])
    quota = spark.createDataFrame([(r["source"], n) for r, n in zip(found, seats, strict=True)], "s string, seats long")
    chosen = shard_quotas(cut.join(F.broadcast(quota), F.col("source").eqNullSafe(F.col("s"))).drop("s"))

    # blocks of a shard that are taken once more than the others
    rank = Window.partitionBy("source", "shard").orderBy(_unit(seed + 1, F.col("source"), F.col("shard"), F.col("block")), "block")
    extra = (
        chosen.where("quota % blocks > 0").select("source", "shard", (F.col("quota") % F.col("blocks")).alias("more"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        .withColumn("rank", F.row_number().over(rank)).where("rank <= more").select("source", "shard", "block", F.lit(1).alias("once"))
    )
    order = Window.partitionBy("source", "shard").orderBy(_unit(seed + 2, F.col("key"), F.col("shard")), "key", "text_hash", "size")
    placed = (
        full.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("row", F.row_number().over(order))
        .withColumn("start", F.col("end") - F.col("size"))
        .join(_same(chosen, "source", "shard"), [F.col("source").eqNullSafe(F.col("_source")), F.col("shard") == F.col("_shard")]).drop("_source", "_shard")
    )
    parts = placed.withColumn("block", F.explode(F.sequence(F.expr("((start + 1) * blocks + words - 1) div words - 1"), F.expr("(end * blocks + words - 1) div words - 1"))))
    parts = (
        parts.join(_same(extra, "source", "shard", "block"), [F.col("source").eqNullSafe(F.col("_source")), F.col("shard") == F.col("_shard"), F.col("block") == F.col("_block")], "left")
        .withColumn("times", F.expr("quota div blocks + coalesce(once, 0)"))
        .withColumn("lo", F.expr("greatest(block * words div blocks, start) - start"))
        .withColumn("hi", F.expr("least((block + 1) * words div blocks, end) - start"))
    )
    out = parts.groupBy("source", "shard", "row", "key", "text_hash", "size", "source_size", "target").agg(
        F.sum(F.expr("times * (hi - lo)")).cast("long").alias("taken"),
        F.array_sort(F.collect_list(F.when(F.col("times") > 0, F.struct("lo", "hi", "times")))).alias("pieces"),
    )
    names = ["key", "source", "text_hash", "size", "source_size", "target", "taken", "pieces"]
    empty = docs.where("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("pieces", F.array().cast(out.schema["pieces"].dataType))
    return out.select(*names).unionByName(empty.select(*names))


def _same(df: DataFrame, *names: str) -> DataFrame:
    """With join columns renamed, so that null sources can meet."""
    keep = [c for c in df.columns if c in {*names, "words", "blocks", "quota", "once"}]
    return df.select(*[F.col(c).alias(f"_{c}" if c in names else c) for c in keep])


def shard_quotas(cut: DataFrame) -> DataFrame:
    """Adds quota: the seats of each shard of a source (seats: of the source). Shards with equal numbers of blocks are one class, as
    they have equal quotients, so that a source is a row for each such number, whatever its shards. Of equal quotients those
    of smaller shards come first, then those of smaller numbers."""
    classes = cut.groupBy("source", "blocks").agg(F.count(F.lit(1)).alias("many"), F.first("seats").alias("seats"))
    schema = StructType([StructField("source", StringType()), *[StructField(c, LongType()) for c in ("blocks", "base", "extra")]])

    def quotas(rows):
        rows = rows.sort_values("blocks")
        base, extra = class_seats(rows["blocks"].tolist(), rows["many"].tolist(), int(rows["seats"].iloc[0]))
        return rows.assign(base=base, extra=extra)[["source", "blocks", "base", "extra"]]

    found = classes.groupBy("source").applyInPandas(quotas, schema).select(F.col("source").alias("_source"), F.col("blocks").alias("_blocks"), "base", "extra")
    both = cut.join(found, F.col("source").eqNullSafe(F.col("_source")) & (F.col("blocks") == F.col("_blocks"))).drop("_source", "_blocks")
    rank = Window.partitionBy("source", "blocks").orderBy("shard")
    once = both.where("extra > 0").withColumn("rank", F.row_number().over(rank)).select("source", "shard", "words", "blocks", (F.col("base") + (F.col("rank") <= F.col("extra")).cast("long")).alias("quota"))
    return once.unionByName(both.where("extra = 0").select("source", "shard", "words", "blocks", F.col("base").alias("quota")))


def materialise(df: DataFrame, plan: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The mix itself: key, the ``keep`` columns (named as ``out_names`` says) and text, a row for each time that words of
    a row of ``df`` are taken; white space between words that stay together is kept. Rows
    equal in key and text share one plan, that of the first in order of pieces."""
    n, named = len(keep), out_names(keep, ("key", "text"))
    once = plan.where("taken > 0").groupBy(F.col("key").alias("k"), F.col("text_hash").alias("h")).agg(F.min("pieces").alias("pieces"))
    given = df.select(col(key).alias("_key"), *[col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], col(text).alias("_text"))
    both = given.join(written(once, "mix-plan"), F.col("_key").eqNullSafe(F.col("k")) & (F.xxhash64("_text") == F.col("h"))).select("_key", *[f"_keep{i}" for i in range(n)], "_text", "pieces")

    def rows(batch: pa.RecordBatch):
        for part in pieces(batch, n + 1):
            at, out = [], []
            for i, (raw, taken) in enumerate(zip(raw_texts(part.column(n + 1)), part.column(n + 2).to_pylist(), strict=True)):
                spots = [m.span() for m in SPANS.finditer(raw)]
                for time in range(1, max(p["times"] for p in taken) + 1):
                    parts, end = [], None
                    for p in taken:
                        if p["times"] >= time:
                            lo, hi = spots[p["lo"]][0], spots[p["hi"] - 1][1]
                            parts.append(raw[end:lo] if end is not None and p["lo"] == last else b"\n" if parts else b"")
                            parts.append(raw[lo:hi])
                            end, last = hi, p["hi"]
                    at.append(i)
                    out.append(b"".join(parts).decode())
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(at, pa.int64())) for c in part.columns[: n + 1]], pa.array(out, pa.string())], names=["key", *named, "text"])

    kinds = [both.schema[c].dataType.simpleString() for c in ("_key", *[f"_keep{i}" for i in range(n)])]
    schema = ", ".join(f"`{c}` {k}" for c, k in zip(("key", *named), kinds, strict=True))
    return arrow_rows(both, rows, f"{schema}, text string")
