"""Removal of repeated passages: sharded Aho-Corasick automata over recurring windows.

A window is ``WINDOW`` consecutive words of one text. A word goes if a window that covers it also
starts in a document with a smaller key; windows are judged on the input.

1. Anchors. In each window the least hash of a ``GRAM``-word gram is its anchor. Equal windows
   have equal anchors, and neighbouring windows mostly share one, so anchors are about a
   fifth of all places. Those that two different texts have go into a Bloom filter; of
   equal texts, all but that with the smallest key go whole.
2. Confirmation. Windows whose anchor passes are counted, pre-aggregated in their blocks:
   what has a smaller and a larger key recurs, and becomes a phrase with its first key.
3. Automata. Each word has one of 255 letters, from its hash; a phrase is a string of
   ``WINDOW`` letters. Phrases are sharded by anchor, about ``SHARD_PHRASES`` in each, and each shard is
   compiled with pyahocorasick.
4. Streaming. Every text is streamed again; the stretches that may hold a phrase go to the
   shard of their anchor, laid end to end, and run through its automaton, which gives every
   occurrence, each checked by the 64-bit hash of its window. A shard with more than
   ``SHARD_USES`` occurrences is replicated, and its stretches are dealt over the copies.

Equality of windows is that of 64 bits over 13 word hashes together with 13 letters.

Cases: a null or short text has no window and keeps its words; a null key is larger than
any other; rows with equal keys don't take words from each other; repeated rows come out as
often as they came in; an empty table gives no rows; a text of any length is taken whole;
other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import arrow_rows, col, discard, flat_words, mixed, pieces, raw_texts, release, written

WINDOW, GRAM = 13, 5
BLOCK = 1 << 20
SHARD_PHRASES, SHARD_USES, LEAST_SHARDS = 100_000, 1_000_000, 16
LAST = (1 << 63) - 1
WHOLE = (1 << 31) - 1
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Windows:
    """Windows of all texts of a column, end to end: hashes, the text and first word of each, runs that share an
    anchor (starts, ends, anchors), and the letters of all words."""

    def __init__(self, column: pa.Array, window: int = WINDOW, gram: int = GRAM) -> None:
        words, at = flat_words(column)
        n = np.diff(at)
        self.letters = (words >> np.uint64(40)).astype(np.uint8)
        self.letters[self.letters == 0] = 1
        size = len(words) - window + 1
        if size < 1:
            words, size = np.zeros(window, np.uint64), 1
        inside = np.ones(max(len(words), window), bool)
        for i in range(1, window):
            inside[(at[1:] - i)[at[1:] >= i]] = False
        grams = words[: len(words) - gram + 1] * ODD[0]
        for i in range(1, gram):
            grams += words[i : len(words) - gram + 1 + i] * ODD[i]
        grams = mixed(grams)
        here = np.flatnonzero(inside[:size]) if len(self.letters) >= window else np.zeros(0, np.int64)
        whole = grams[:size] * ODD[1] + grams[gram : gram + size] * ODD[2] + grams[window - gram : window - gram + size] * ODD[3]
        self.hashes = mixed(whole[here]).view(np.int64)
        least, wide = grams, 1
        while wide * 2 <= window - gram + 1:
            least, wide = np.minimum(least[:-wide], least[wide:]), wide * 2
        rest = window - gram + 1 - wide
        least = np.minimum(least[: len(least) - rest], least[rest:])[here]
        self.words, self.text = here, np.repeat(np.arange(len(n)), np.maximum(n - window + 1, 0))
        self.first = at[:-1]
        edge = np.r_[True, (least[1:] != least[:-1]) | (self.text[1:] != self.text[:-1])] if len(here) else np.zeros(0, bool)
        self.starts = np.flatnonzero(edge)
        self.ends = np.r_[self.starts[1:], len(here)] if len(here) else self.starts
        self.anchors = least[self.starts].view(np.int64)


def _texts(df: DataFrame, text: str, key: str) -> DataFrame:
    """doc (a null key as the last number), mark (tells texts under one key apart), t, key."""
    return df.select(F.coalesce(col(key).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(col(text)).alias("mark"), col(text).alias("t"), col(key).alias("key"))


def _grouped(order_by: np.ndarray, *columns: np.ndarray):
    """Sorts by the first array: (starts of equal values, sorted arrays)."""
    order = np.argsort(order_by, kind="stable")
    out = [order_by[order], *(c[order] for c in columns)]
    return np.flatnonzero(np.r_[True, out[0][1:] != out[0][:-1]]), out


def copies(texts: DataFrame) -> DataFrame:
    """(doc, mark, lo, hi): all words of texts that a smaller key has too, if they have a window at all."""
    t = texts.select("doc", "mark", F.sha2(F.coalesce("t", F.lit("")).cast("binary"), 256).alias("sha"))
    first = written(t.groupBy("sha").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("sha", "first"), "phrase-copies")
    return t.join(first, "sha").where("doc > first").select("doc", "mark", F.lit(0).alias("lo"), F.lit(WHOLE).alias("hi"))


def recurring_anchors(texts: DataFrame) -> DataFrame:
    """Anchors (long) that two different texts have. Texts are told apart by 64 bits."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        anchors, texts_, total = [], [], 0

        def block():
            starts, (a, d) = _grouped(np.concatenate(anchors), np.concatenate(texts_))
            lo, hi = np.minimum.reduceat(d, starts), np.maximum.reduceat(d, starts)
            return pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(lo), pa.array(hi, mask=hi == lo)], names=["anchor", "lo", "hi"])

        for batch in batches:
            for part in pieces(batch, 1, 1 << 20):
                w = Windows(part.column(1))
                anchors.append(w.anchors)
                texts_.append(part.column(0).to_numpy(zero_copy_only=False)[w.text[w.starts]])
                total += len(w.anchors)
                if total > BLOCK:
                    yield block()
                    anchors, texts_, total = [], [], 0
        if total:
            yield block()

    rows = texts.select(F.xxhash64("t"), "t").mapInArrow(run, "anchor long, lo long, hi long")
    return rows.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max(F.coalesce("hi", "lo")).alias("hi")).where("lo < hi").select("anchor")


def phrases(texts: DataFrame, shared) -> DataFrame:
    """Windows that occur under two keys: hash, letters, bucket (of the anchor), first (key), n."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        parts, total = [], 0

        def block():
            hashes, letters, buckets, docs = (np.concatenate([p[i] for p in parts]) for i in range(4))
            starts, (h, x, b, d) = _grouped(hashes, letters, buckets, docs)
            lo, hi = np.minimum.reduceat(d, starts), np.maximum.reduceat(d, starts)
            n = np.diff(np.r_[starts, len(h)])
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WINDOW), len(starts), [None, pa.py_buffer(np.ascontiguousarray(x[starts]).tobytes())])
            return pa.RecordBatch.from_arrays(
                [pa.array(h[starts]), flat.cast(pa.binary()), pa.array(b[starts]), pa.array(lo), pa.array(hi, mask=hi == lo), pa.array(n.astype(np.int32))],
                names=["hash", "letters", "bucket", "lo", "hi", "n"],
            )

        for batch in batches:
            for part in pieces(batch, 1, 1 << 20):
                w = Windows(part.column(1))
                sizes = w.ends - w.starts
                at = np.flatnonzero(np.repeat(bloom.passes(shared.value, w.anchors), sizes))
                if not len(at):
                    continue
                letters = np.lib.stride_tricks.sliding_window_view(w.letters, WINDOW)[w.words[at]]
                docs = part.column(0).to_numpy(zero_copy_only=False)
                parts.append((w.hashes[at], letters, np.repeat(bucket_of(w.anchors), sizes)[at], docs[w.text[at]]))
                total += len(at)
                if total > BLOCK // 2:
                    yield block()
                    parts, total = [], 0
        if parts:
            yield block()

    rows = texts.select("doc", "t").mapInArrow(run, "hash long, letters binary, bucket int, lo long, hi long, n int")
    found = rows.groupBy("hash", "letters", "bucket").agg(F.min("lo").alias("first"), F.max(F.coalesce("hi", "lo")).alias("hi"), F.sum("n").alias("n"))
    return found.where("first < hi").drop("hi")


def bucket_of(anchors: np.ndarray) -> np.ndarray:
    return (anchors.view(np.uint64) >> np.uint64(30) & np.uint64((1 << 31) - 1)).astype(np.int32)


STRETCHES = "shard int, copy int, kind int, letters binary, hash long, first long, hashes binary, docs binary, marks binary, at binary, sizes binary"


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the spans, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)


def stretches(texts: DataFrame, filters, copies_of, shards: int) -> DataFrame:
    """Runs of windows with one anchor that may hold a phrase, dealt to shards: a row has all those of a block of texts,
    end to end, with doc, mark, first word and number of windows of each."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in STRETCHES.split(", ")]
        for batch in batches:
            for part in pieces(batch, 2, 4 << 20):
                w = Windows(part.column(2))
                if not len(w.starts):
                    continue
                hit = np.flatnonzero(np.logical_or.reduceat(bloom.passes(filters.value, w.hashes), w.starts))
                if not len(hit):
                    continue
                shard = bucket_of(w.anchors[hit]) % shards
                lo, n = w.starts[hit], (w.ends - w.starts)[hit]
                doc, mark = (part.column(i).to_numpy(zero_copy_only=False)[w.text[lo]] for i in range(2))
                at = w.words[lo]
                copy = (mixed(doc.view(np.uint64) * ODD[0] + at.astype(np.uint64)) % copies_of.value[shard].astype(np.uint64)).astype(np.int32)
                order = np.lexsort((copy, shard))
                shard, copy, lo, n, doc, mark, at = (x[order] for x in (shard, copy, lo, n, doc, mark, at))
                edge = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (copy[1:] != copy[:-1]), True])
                first = (at - w.first[w.text[lo]]).astype(np.int32)
                rows = [[] for _ in names]
                for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False):
                    row = (
                        shard[a], copy[a], 1, w.letters[_spans(at[a:b], n[a:b] + WINDOW - 1)].tobytes(), None, None, w.hashes[_spans(lo[a:b], n[a:b])].tobytes(),
                        doc[a:b].tobytes(), mark[a:b].tobytes(), first[a:b].tobytes(), n[a:b].astype(np.int32).tobytes(),
                    )
                    for x, y in zip(rows, row, strict=True):
                        x.append(y)
                kinds = [pa.int32()] * 3 + [pa.binary(), pa.int64(), pa.int64()] + [pa.binary()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=names)

    return texts.select("doc", "mark", "t").mapInArrow(run, STRETCHES)


class Shard:
    """The automaton of some phrases (letters, 64-bit hashes, first keys)."""

    def __init__(self, letters: list[bytes], hashes: np.ndarray, first: np.ndarray) -> None:
        order = sorted(range(len(letters)), key=letters.__getitem__)
        self.hashes, self.first = hashes[order], first[order]
        self.automaton = ahocorasick.Automaton()
        begin, before = [], None
        for i, k in enumerate(order):  # phrases with equal letters lie side by side
            if letters[k] != before:
                before = letters[k]
                self.automaton.add_word(before.decode("latin-1"), len(begin))
                begin.append(i)
        self.begin = np.array([*begin, len(order)])
        if begin:
            self.automaton.make_automaton()

    def occurrences(self, letters: bytes, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stretch, window in it, first key) of every phrase in stretches of ``sizes`` windows, laid end to end."""
        ends = np.cumsum(sizes + WINDOW - 1)
        found = list(self.automaton.iter(letters.decode("latin-1"))) if len(self.first) else []
        end = np.fromiter((e for e, _ in found), np.int64, len(found))
        which = np.fromiter((v for _, v in found), np.int64, len(found))
        start = end - WINDOW + 1
        stretch = np.searchsorted(ends, start, side="right")
        inside = end < ends[stretch]
        start, which, stretch = start[inside], which[inside], stretch[inside]
        window = start - (ends - sizes - WINDOW + 1)[stretch]
        own = hashes[(np.cumsum(sizes) - sizes)[stretch] + window]
        phrase = np.full(len(own), -1)
        for k in range(int(np.diff(self.begin).max(initial=0))):
            at = np.minimum(self.begin[which] + k, len(self.hashes) - 1)
            phrase = np.where((self.begin[which] + k < self.begin[which + 1]) & (self.hashes[at] == own), at, phrase)
        ok = phrase >= 0
        return stretch[ok], window[ok], self.first[phrase[ok]]


def locate(found: DataFrame, texts: DataFrame, filters) -> DataFrame:
    """(doc, mark, lo, hi): ranges of words covered by phrases with a smaller first key."""
    spark = found.sparkSession
    shards = max(LEAST_SHARDS, -(-found.count() // SHARD_PHRASES))
    found = found.withColumn("shard", F.col("bucket") % shards)
    uses = found.groupBy("shard").agg(F.sum("n").alias("n"))
    many = np.ones(shards, np.int32)  # a number for each SHARD_PHRASES phrases
    for r in uses.toArrow().to_pylist():
        many[r["shard"]] = -(-r["n"] // SHARD_USES)
    copies_of = spark.sparkContext.broadcast(many)
    n = uses.select("shard", F.expr(f"cast(ceil(n / {SHARD_USES}) as int)").alias("copies"))
    found = found.join(n, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), "letters", "hash", "first",
        *[F.lit(None).cast("binary").alias(c) for c in ("hashes", "docs", "marks", "at", "sizes")],
    )
    both = found.unionByName(stretches(texts, filters, copies_of, shards)).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, shard, known = None, None, ([], [], [])
        for batch in batches:
            shard_, copy, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            edge = np.flatnonzero(np.r_[True, (shard_[1:] != shard_[:-1]) | (copy[1:] != copy[:-1]) | (kind[1:] != kind[:-1]), True]).tolist()
            for a, b in zip(edge, edge[1:], strict=False):
                if (shard_[a], copy[a]) != now:
                    now, shard, known = (shard_[a], copy[a]), None, ([], [], [])
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    known[0].extend(part.column(3).to_pylist())
                    for i in (1, 2):
                        known[i].append(part.column(3 + i).to_numpy(zero_copy_only=False))
                    continue
                if shard is None:
                    none = [np.zeros(0, np.int64)]
                    shard, known = Shard(known[0], np.concatenate(known[1] or none), np.concatenate(known[2] or none)), ([], [], [])
                for row in part.to_pylist():
                    docs, marks = (np.frombuffer(row[c], np.int64) for c in ("docs", "marks"))
                    at, sizes = (np.frombuffer(row[c], np.int32) for c in ("at", "sizes"))
                    stretch, window, first = shard.occurrences(row["letters"], np.frombuffer(row["hashes"], np.int64), sizes.astype(np.int64))
                    own = first < docs[stretch]
                    stretch, lo = stretch[own], (window + at[stretch])[own]
                    if not len(lo):
                        continue
                    new = np.flatnonzero(np.r_[True, (stretch[1:] != stretch[:-1]) | (lo[1:] > lo[:-1] + WINDOW)])
                    hi = lo[np.r_[new[1:] - 1, len(lo) - 1]] + WINDOW
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[stretch[new]]), pa.array(marks[stretch[new]]), pa.array(lo[new].astype(np.int32)), pa.array(hi.astype(np.int32))], names=["doc", "mark", "lo", "hi"]
                    )

    return both.mapInArrow(run, "doc long, mark long, lo int, hi int")


def repeated_ranges(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, mark, ranges) of the texts that lose words; doc and mark as in ``_texts``."""
    spark = df.sparkSession
    texts = _texts(df, text, key)
    anchors = written(recurring_anchors(texts), "phrase-anchors")
    filters = spark.sparkContext.broadcast(bloom.build(anchors))
    found = written(phrases(texts, filters), "phrases")
    filters.destroy()
    discard(anchors)
    release(spark)
    filters = spark.sparkContext.broadcast(bloom.build(found.select("hash")))
    ranges = written(locate(found, texts, filters), "phrase-ranges")
    filters.destroy()
    discard(found)
    release(spark)
    ranges = ranges.unionByName(copies(texts))
    return ranges.groupBy("doc", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))


def _kept(raw: bytes | None, ranges: list | None) -> tuple[int, list[bytes]]:
    """Number of words, and those outside the ranges."""
    words = (raw or b"").split()
    gone = np.zeros(len(words), bool)
    if len(words) < WINDOW:
        return len(words), words
    for r in ranges or ():
        gone[r["lo"] : r["hi"]] = True
    return len(words), [words[i] for i in np.flatnonzero(~gone).tolist()]


def _applied(df: DataFrame, text: str, key: str, made, fields: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    docs = _texts(df, text, key)
    both = docs.join(repeated_ranges(df, text, key), ["doc", "mark"], "left").select("key", "t", "ranges")

    def rows(batch: pa.RecordBatch):
        for part in pieces(batch, 1):
            out = [made(*_kept(raw, r)) for raw, r in zip(raw_texts(part.column(1)), part.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, t) for x, (_, t) in zip(zip(*out, strict=True), fields, strict=True)]], names=["key", *[k for k, _ in fields]])

    return arrow_rows(both, rows, f"key {kind}, {schema}")


def remove(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row: key, n_words, n_removed, text (kept words, one space between)."""
    fields = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())]
    return _applied(df, text, key, lambda n, kept: (n, n - len(kept), b" ".join(kept).decode()), fields, "n_words long, n_removed long, text string")


def digests(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """As ``remove``, with the SHA-256 of the kept text in its place."""
    fields = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    return _applied(df, text, key, lambda n, kept: (n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), fields, "n_words long, n_removed long, kept_sha256 string")
