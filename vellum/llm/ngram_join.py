"""Exact Jaccard self-join on word n-grams by vertical partitioning, as components.

A text's set holds 64-bit hashes of its distinct shingles of ``SHINGLE`` words, A-Z
lower-cased; a shorter text's whole sequence is its one shingle. Texts with equal sets are one
class (a 64-bit sum over the set), and only classes are joined.

1. Global order: shingles that recur within blocks of texts are counted over all texts;
   the ``MOST_HEAVY`` most frequent, a bounded broadcast, come last, by power of 2 of
   their count, all others first, each by hash. Any order gives the same links; this one
   keeps frequent passages out of the first fragment.
2. The order is cut into ``FRAGMENTS`` of about equal total frequency, and each set with it: a
   segment is what a set has in a fragment.
3. Candidates: two linked sets of n and m share at least o = ceil(75 / 175 * (n + m)) shingles, so the
   first that they share stands at place n - o at most in one and m - o in the other. Rows (shingle,
   class, n, place) of the first n - ceil(0.75 n) + 1 shingles are dealt by shingle;
   in a posting, the members of a band of sizes are paired with their hub, the one where
   the shingle stands earliest: in a group of near copies that is the one with the fewest
   changes, to which most others are linked.
4. Verification: what paired classes share of those first shingles is counted from the postings; pairs for which
   the rest cannot make up go no further. Of the others, overlaps of segments are
   counted apart in each fragment and summed per pair.
5. Links make components. Members of a posting that are still in different components
   are paired in full, under the same bound on places, and verified alike. Members of one component
   need no more pairs, so a group of n near copies costs about n pairs, not n * n.

No pair that could link two components goes unverified, so components are those of all
links. Sets of candidate classes are found again by a scan that asks a Bloom filter;
what passes it wrongly finds no pair to join.

Cases: null and empty texts have an empty set and are their own component; repeated rows
and equal texts are one class; a null key is never a component's name while another is
there; a key of several fields is ordered as Spark orders structs; an empty table gives no
rows; a text of any length is taken whole; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import arrow_rows, col, discard, flat_words, mapped, mixed, pieces, release, written
from .graph import components

SHINGLE, PERCENT = 5, 75
MOST_HEAVY, LEAST_HEAVY = 1 << 21, 2
FRAGMENTS = 4
BLOCK, MOST_SEEN = 1 << 21, 500_000
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def sets_of(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets of all texts of a column, sorted, end to end; where each begins (one place more than texts); classes (0: empty)."""
    words, at = flat_words(column, lower=True)
    n = np.diff(at)
    sizes = np.where(n >= shingle, n - shingle + 1, n > 0)
    ends = np.cumsum(sizes)
    values = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    if len(words) >= shingle:
        total = words[: len(words) - shingle + 1] * ODD[0]
        for i in range(1, shingle):
            total += words[i : len(words) - shingle + 1 + i] * ODD[i]
        whole = np.ones(len(words), bool)  # whether a shingle that starts here lies in one text
        for i in range(1, shingle):
            whole[(at[1:] - i)[at[1:] >= i]] = False
        full = np.ones(len(values), bool)
        full[(ends - sizes)[(n > 0) & (n < shingle)]] = False
        values[full] = total[whole[: len(total)]]
    for k in range(1, shingle):
        short = np.flatnonzero(n == k)
        if len(short):
            values[(ends - sizes)[short]] = sum((words[at[short] + i] * ODD[i] for i in range(k)), np.uint64(k))
    values = mixed(values ^ ODD[4]).view(np.int64)
    edges = np.r_[0, ends]
    for lo, hi in zip(edges.tolist(), edges[1:].tolist(), strict=False):
        values[lo:hi].sort()
    once = np.r_[True, values[1:] != values[:-1]] if len(values) else np.zeros(0, bool)
    once[edges[:-1][sizes > 0]] = True
    edges = np.r_[0, np.cumsum(once)][edges]
    values = values[once]
    sums = np.r_[np.uint64(0), np.cumsum(mixed(values.view(np.uint64) ^ ODD[0]), dtype=np.uint64)][edges]
    return values, edges, np.diff(sums).view(np.int64)


def prefix_length(n, percent: int = PERCENT):
    return n - (percent * n + 99) // 100 + 1


class Order:
    """The global order: shingles that aren't heavy by hash, then heavy ones by place, and where it is cut. ``total``: of the
    sizes of all sets."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int = 0, fragments: int = FRAGMENTS) -> None:
        order = np.argsort(hashes)
        self.hashes, counts = hashes[order], counts[order]
        level = np.floor(np.log2(np.maximum(counts, 1))).astype(np.int8)
        by_place = np.argsort(level, kind="stable")
        self.place = np.empty(len(hashes), np.int32)
        self.place[by_place] = np.arange(1, len(hashes) + 1)
        heavy = np.cumsum(counts[by_place])
        total = max(total, int(counts.sum()), 1)
        self.light = total - int(counts.sum())
        cuts = total * np.arange(1, fragments) / fragments
        #: Pivots: hashes among those that aren't heavy, then places.
        self.by_hash = (-(2.0**63) + 2.0**64 * cuts[cuts < self.light] / max(1, self.light)).astype(np.int64)
        self.by_place = np.searchsorted(heavy, cuts[cuts >= self.light] - self.light, side="right") + 1
        self.maybe = np.zeros(1 << 21, np.uint8)
        top = self.hashes.view(np.uint64) >> np.uint64(40)
        np.bitwise_or.at(self.maybe, top >> np.uint64(3), np.uint8(1) << (top & np.uint64(7)).astype(np.uint8))

    def places(self, values: np.ndarray) -> np.ndarray:
        """0 of those that aren't heavy."""
        out = np.zeros(len(values), np.int32)
        top = values.view(np.uint64) >> np.uint64(40)
        some = np.flatnonzero(self.maybe[top >> np.uint64(3)] >> (top & np.uint64(7)).astype(np.uint8) & np.uint8(1))
        if len(some) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, values[some]), len(self.hashes) - 1)
            hit = self.hashes[at] == values[some]
            out[some[hit]] = self.place[at[hit]]
        return out

    def fragment(self, values: np.ndarray) -> np.ndarray:
        place = self.places(values)
        light = np.searchsorted(self.by_hash, values, side="right")
        return np.where(place == 0, light, len(self.by_hash) + np.searchsorted(self.by_place, place, side="right"))


def _texts_once(batch: pa.RecordBatch, text: int, seen: set[int]):
    """Sets of the texts of a batch in parts: values, edges, classes, and the texts whose class is met first."""
    for part in pieces(batch, text, 1 << 20):
        values, edges, classes = sets_of(part.column(text))
        new = []
        for i, (c, lo, hi) in enumerate(zip(classes.tolist(), edges.tolist(), edges[1:].tolist(), strict=False)):
            if hi > lo and c not in seen:
                if len(seen) > MOST_SEEN:
                    seen.clear()
                seen.add(c)
                new.append(i)
        yield part, values, edges, classes, new


def first_scan(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, n, class) of each row, and (hash, count) of what recurs in a block of texts; the other columns are null."""
    given = df.select(col(key).alias("key"), col(text).alias("t"))
    kind = given.schema["key"].dataType.simpleString()

    def run(batches):
        block, total, seen = [], 0, set()

        def recurring(kind):
            both = np.concatenate(block)
            both.sort()
            edge = np.flatnonzero(np.r_[True, both[1:] != both[:-1], True])
            n = np.diff(edge)
            at = np.flatnonzero(n > 1)
            return pa.RecordBatch.from_arrays([pa.nulls(len(at), kind), pa.nulls(len(at), pa.int32()), pa.array(both[edge[at]]), pa.array(n[at].astype(np.int32))], names=["key", "n", "hash", "count"])

        for batch in batches:
            for part, values, edges, classes, new in _texts_once(batch, 1, seen):
                for i in new:
                    block.append(values[edges[i] : edges[i + 1]])
                    total += len(block[-1])
                if total > BLOCK:
                    yield recurring(batch.schema.field(0).type)
                    block, total, seen = [], 0, set()
                n = np.diff(edges).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(classes), pa.nulls(len(n), pa.int32())], names=["key", "n", "hash", "count"])
        if block:
            yield recurring(batch.schema.field(0).type)

    return written(mapped(given, run, f"key {kind}, n int, hash long, count int"), "ngram-sets")


def global_order(scanned: DataFrame, most: int = MOST_HEAVY) -> Order:
    """At most ``most`` shingles come to the driver."""
    counts = scanned.where("count is not null")
    top = written(counts.groupBy("hash").agg(F.sum("count").alias("n")).where(F.col("n") >= LEAST_HEAVY), "ngram-heavy")
    wanted = top
    if top.count() > most:  # raise the least count by powers of 2 until they fit
        total, least = 0, 64
        for r in top.groupBy(F.floor(F.log2("n")).alias("k")).count().orderBy(F.desc("k")).collect():
            total += r["count"]
            if total > most:
                break
            least = r["k"]
        wanted = top.where(F.floor(F.log2("n")) >= least)
    got = wanted.select("hash", "n").toArrow()
    discard(top)
    total = scanned.where("count is null").agg(F.sum("n")).first()[0] or 0
    return Order(got["hash"].to_numpy().astype(np.int64), got["n"].to_numpy().astype(np.int64), total)


POSTING = "token long, class long, n int, pos int"


def postings(df: DataFrame, text: str, shared) -> DataFrame:
    """The prefix of each set in a broadcast Order, a row for each shingle; equal sets in a task once."""

    def run(batches):
        seen: set[int] = set()
        order = shared.value
        for batch in batches:
            for _, values, edges, classes, new in _texts_once(batch, 0, seen):
                if not new:
                    continue
                new = np.array(new)
                sizes = np.diff(edges)
                wanted = np.zeros(len(sizes), bool)
                wanted[new] = True
                p = np.where(wanted, prefix_length(sizes), 0)
                place = order.places(values)
                light = np.r_[0, np.cumsum(place == 0)]
                n_light = light[edges[1:]] - light[edges[:-1]]
                text_of = np.repeat(np.arange(len(sizes)), sizes)
                rank = light[:-1] - light[edges[:-1]][text_of]  # of a light one: those before it in its set
                take = np.flatnonzero((place == 0) & (rank < p[text_of]))
                token, owner, pos = [values[take]], [text_of[take]], [rank[take]]
                for i in np.flatnonzero(wanted & (n_light < p)).tolist():
                    lo, hi = edges[i], edges[i + 1]
                    heavy = np.flatnonzero(place[lo:hi])
                    heavy = heavy[np.argsort(place[lo:hi][heavy])][: p[i] - n_light[i]]
                    token.append(values[lo:hi][heavy])
                    owner.append(np.full(len(heavy), i))
                    pos.append(n_light[i] + np.arange(len(heavy)))
                token, owner, pos = map(np.concatenate, (token, owner, pos))
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(classes[owner]), pa.array(sizes[owner].astype(np.int32)), pa.array(pos.astype(np.int32))], names=["token", "class", "n", "pos"])

    return mapped(df.select(col(text).alias("t")), run, POSTING)


def _streamed(rows: DataFrame, run, schema: str, *order: str) -> DataFrame:
    return mapped(rows.repartition("token").sortWithinPartitions("token", *order), run, schema)


def shared_postings(rows: DataFrame) -> DataFrame:
    """Rows of shingles that two classes have, each once, with the band of n. Sorted partitions are read as a stream,
    whatever the length of a posting."""

    def run(batches):
        carry = None  # the last row so far, and whether it has been told
        for batch in batches:
            x = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            told = False
            if carry is not None:
                x, told = [np.r_[c, y] for c, y in zip(carry[0], x, strict=True)], carry[1]
            token, cls = x[:2]
            new = np.r_[True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])]
            x = [y[new] for y in x]
            same = x[0][1:] == x[0][:-1]
            tell = np.r_[same, False] | np.r_[False, same]
            carry = [y[-1:] for y in x], bool(tell[-1]) or (told and len(x[0]) == 1)
            tell[0] &= not told
            if tell.any():
                x = [y[tell] for y in x]
                band = np.floor(np.log(x[2]) / np.log(100 / PERCENT)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*map(pa.array, x), pa.array(band)], names=["token", "class", "n", "pos", "band"])

    return written(_streamed(rows, run, POSTING + ", band int", "class"), "ngram-postings")


def allowed(n: str, p: str, m: str, q: str, percent: int = PERCENT) -> str:
    """SQL: sets of n and m whose first common shingle stands at places p and q may be linked."""
    return f"100L * least({n}, {m}) >= {percent}L * greatest({n}, {m}) and {100 + percent}L * least({n} - {p}, {m} - {q}) >= {percent}L * ({n} + {m})"


PAIR = "a long, b long, na int, nb int"


def hub_pairs(shared: DataFrame) -> DataFrame:
    """(a, b, na, nb): each member of a posting with the hub of its band and with the member before it, if places allow."""

    def run(batches):
        hub = last = None
        for batch in batches:
            token, band, pos, cls, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            x = np.stack([token, band, cls, n, pos])
            if last is not None:
                x = np.c_[last, x]
            starts = np.r_[True, (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])]
            first = np.maximum.accumulate(np.where(starts, np.arange(x.shape[1]), 0))
            hubs = x[2:, first]
            if hub is not None:  # the run of the carried row began in a batch before
                hubs[:, first == 0] = hub
            member, before = np.flatnonzero(~starts), np.flatnonzero(~starts) - 1
            a, b = np.c_[x[2:, member], x[2:, member]], np.c_[hubs[:, member], x[2:, before]]
            (c, n1, p1), (d, n2, p2) = a, b
            ok = (c != d) & (100 * np.minimum(n1, n2) >= PERCENT * np.maximum(n1, n2)) & ((100 + PERCENT) * np.minimum(n1 - p1, n2 - p2) >= PERCENT * (n1 + n2))
            hub, last = hubs[:, -1:], x[:, -1:]
            if ok.any():
                flip = c > d
                out = np.unique(np.stack([np.where(flip, d, c), np.where(flip, c, d), np.where(flip, n2, n1), np.where(flip, n1, n2)])[:, ok], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1]), pa.array(out[2].astype(np.int32)), pa.array(out[3].astype(np.int32))], names=["a", "b", "na", "nb"])

    return _streamed(shared.select("token", "band", "pos", "class", "n"), run, PAIR, "band", "pos", "class").distinct()


def segments(df: DataFrame, text: str, classes: DataFrame, shared) -> DataFrame:
    """(c, fragment, segment) of the sets of ``classes`` (c), and of few others, cut by a broadcast Order; equal
    sets in different tasks come more than once."""
    filters = df.sparkSession.sparkContext.broadcast(bloom.build(classes))

    def run(batches):
        bits, order, seen = filters.value, shared.value, set()
        for batch in batches:
            for _, values, edges, classes, new in _texts_once(batch, 0, seen):
                new = np.array(new, np.int64)
                c, fragment, segment = [], [], []
                for i in new[bloom.passes(bits, classes[new])].tolist():
                    own = values[edges[i] : edges[i + 1]]
                    part = order.fragment(own)
                    for f in range(FRAGMENTS):
                        if len(x := own[part == f]):
                            c.append(int(classes[i]))
                            fragment.append(f)
                            segment.append(x.tobytes())
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(fragment, pa.int32()), pa.array(segment, pa.binary())], names=["c", "fragment", "segment"])

    made = written(mapped(df.select(col(text).alias("t")), run, "c long, fragment int, segment binary"), "ngram-segments", "none")
    filters.destroy()
    return made


def prefixes_allow(n: str, m: str, shared: str, percent: int = PERCENT) -> str:
    """SQL: a link is possible with ``shared`` common shingles in both prefixes. The set whose prefix ends first in the order
    has no other common shingle up to there, and beyond it at most what its prefix leaves."""
    rest = " , ".join(f"({percent}L * {x} + 99) div 100 - 1" for x in (n, m))
    return f"{100 + percent}L * ({shared} + greatest({rest})) >= {percent}L * ({n} + {m})"


def bounded(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """``pairs`` that what they share of their prefixes doesn't rule out."""
    own = pairs.join(shared.select(F.col("class").alias("a"), "token"), "a")
    both = own.join(shared.select(F.col("class").alias("b"), "token"), ["b", "token"])
    return both.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared")).where(prefixes_allow("na", "nb", "shared")).drop("shared")


def verified(df: DataFrame, text: str, pairs: DataFrame, shared: DataFrame, order, percent: int = PERCENT) -> DataFrame:
    """(a, b) of those ``pairs`` (a, b, na, nb) whose overlap makes a link: partial overlaps are counted apart in each fragment and
    summed."""
    pairs = written(bounded(pairs, shared), "ngram-bounded")
    wanted = written(pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct(), "ngram-wanted")
    sets = segments(df, text, wanted, order)
    left = pairs.join(sets.select(F.col("c").alias("a"), "fragment", F.col("segment").alias("x")), "a")
    both = left.join(sets.select(F.col("c").alias("b"), "fragment", F.col("segment").alias("y")), ["b", "fragment"])

    def overlap(batch: pa.RecordBatch):
        n = [len(np.intersect1d(np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64), assume_unique=True)) for x, y in zip(batch.column(5), batch.column(6), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(n, pa.int64())], names=["a", "b", "na", "nb", "fragment", "overlap"])

    counted = arrow_rows(both.select("a", "b", "na", "nb", "fragment", "x", "y"), overlap, f"{PAIR}, fragment int, overlap long")
    once = counted.groupBy("a", "b", "na", "nb", "fragment").agg(F.max("overlap").alias("overlap"))
    total = once.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    links = written(total.where(F.expr(f"{100 + percent} * overlap >= {percent} * (na + nb)")).select("a", "b"), "ngram-links")
    discard(wanted, sets, pairs)
    return links


def cross_pairs(shared: DataFrame, first: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs of members of a posting that lie in different components, if places allow, and weren't tried."""
    named = shared.join(first, shared["class"] == first["node"], "left").select("token", "class", "n", "pos", F.coalesce("component", "class").alias("part"))
    apart = named.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo != hi").select("token")
    named = written(named.join(apart, "token", "left_semi"), "ngram-apart")
    x, y = named.alias("x"), named.alias("y")
    may = F.expr(allowed("x.n", "x.pos", "y.n", "y.pos"))
    cross = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.class") < F.col("y.class")) & (F.col("x.part") != F.col("y.part")) & may)
    cross = cross.select(F.col("x.class").alias("a"), F.col("y.class").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct()
    out = written(cross.join(tried, ["a", "b"], "left_anti"), "ngram-cross")
    discard(named)
    return out


def join_components(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of ``df``: key, n_shingles, class, component (smallest key that
    links reach, itself included)."""
    spark = df.sparkSession
    scanned = first_scan(df, text, key)
    marks = scanned.where("count is null").select("key", "n", F.col("hash").alias("class"))
    order = spark.sparkContext.broadcast(global_order(scanned))
    shared = shared_postings(postings(df, text, order))
    release(spark)
    tried = written(hub_pairs(shared), "ngram-pairs")
    links = verified(df, text, tried, shared, order)
    release(spark)
    first = components(links)
    cross = cross_pairs(shared, first, tried)
    if not cross.isEmpty() and not (more := verified(df, text, cross, shared, order)).isEmpty():
        first = components(links.unionByName(more))
    order.destroy()
    discard(shared, tried, cross)
    release(spark)
    named = marks.join(first, marks["class"] == first["node"], "left").withColumn("part", F.coalesce("component", "class")).drop("node", "component")
    least = named.where("n > 0").groupBy("part").agg(F.min("key").alias("least"))
    full = named.where("n > 0").join(least, "part").select("key", "n", "class", F.col("least").alias("component"))
    return full.unionByName(named.where("n = 0").select("key", "n", "class", F.col("key").alias("component"))).select(
        "key", F.col("n").cast("long").alias("n_shingles"), "class", "component"
    )
