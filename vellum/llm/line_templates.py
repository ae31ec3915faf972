"""Line deduplication by a log-template tree.

Lines are split at newlines. The tree has a fixed depth: a line's node is its number of
words and its first ``DEPTH`` words, where words with a digit are the variable ``<*>``. In a
node the masked line that most documents have (of ties, the least text) leads a template; lines
with at least ``ALIKE`` percent of their words equal to the leader's, place by place, join
it, and the places where they differ become ``<*>``. The lines left over choose the next leader until none is left.
The first ``LEADERS`` leaders of all nodes are met by joins; what is left of a node then passes as a stream in the
leaders' order, where each line joins the first alike leader or becomes one, which gives the same templates.
Leaders are found by blocks of places, one more than may differ. A template that ``LEAST_DOCS`` documents or more have is
recurring: its lines are dropped from every document but the first that has it, so that no text is lost
from the corpus. Every line with a word counts; one of at most ``DEPTH`` words is its node, so
it is generalised in words with a digit alone.

Only hashes of lines are shuffled at first. Texts of lines follow for nodes that enough
documents have, found through a Bloom filter of fixed size; equal lines of a node become
one row before leaders are sought.

Cases: null and empty texts have no lines and stay as they are; rows with equal keys are one document, a
null key is one after all others; repeated rows come out as often as they came in; of a text
without any word left nothing is kept but the empty text; an empty table gives no
rows; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import merge
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.folds import fold
from . import bloom
from .common import arrow_rows, col, out_names, pieces, raw_texts, release, written

DEPTH, ALIKE, LEADERS, LEAST_DOCS, LEAST_WORDS = 3, 70, 3, 5, 1
LAST = (1 << 63) - 1
DIGIT = re.compile(rb"[0-9]")
VARIABLE = b"<*>"


def parsed(line: bytes) -> tuple[int, list[bytes]] | None:
    """Node and masked words of a line; None if it has no word."""
    words = line.split()
    if len(words) < LEAST_WORDS:
        return None
    masked = [VARIABLE if DIGIT.search(w) else w for w in words] if DIGIT.search(line) else words
    return signed(b"%d\n" % len(masked) + b" ".join(masked[:DEPTH])), masked


def signed(data: bytes) -> int:
    h = xxhash.xxh64_intdigest(data)
    return h - (1 << 64) if h >= 1 << 63 else h


def _texts(df: DataFrame, text: str, key: str) -> DataFrame:
    return df.select(F.coalesce(col(key).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(col(text)).alias("mark"), col(text).alias("t"), col(key).alias("key"))


def nodes(texts: DataFrame, least_docs: int) -> DataFrame:
    """Nodes (long) that ``least_docs`` documents have."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, out = [], []
        for doc, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
            own = {p[0] for line in (raw or b"").split(b"\n") if (p := parsed(line))}
            out += own
            docs += [doc] * len(own)
        return pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(docs, pa.int64())], names=["node", "doc"])

    pairs = arrow_rows(texts.select("doc", "t"), rows, "node long, doc long").distinct()
    return pairs.groupBy("node").count().where(F.col("count") >= least_docs).select("node")


def lines_in(texts: DataFrame, packed: np.ndarray) -> DataFrame:
    """Lines in nodes of the filter: node, line (hash), masked, doc, mark, at (number of the line)."""
    shared = texts.sparkSession.sparkContext.broadcast(packed)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in pieces(batch, 2, 1 << 20):  # a list of words for each line
            out = []
            for doc, mark, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), raw_texts(part.column(2)), strict=True):
                for at, line in enumerate((raw or b"").split(b"\n")):
                    if p := parsed(line):
                        out.append((p[0], p[1], doc, mark, at))
            if out:
                node = np.array([x[0] for x in out], np.int64)
                out = [out[i] for i in np.flatnonzero(bloom.passes(shared.value, node)).tolist()]
            if out:
                node, masked, doc, mark, at = zip(*out, strict=True)
                masked = [b" ".join(m) for m in masked]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node, pa.int64()), pa.array([signed(m) for m in masked], pa.int64()), pa.array([m.decode() for m in masked], pa.string()), pa.array(doc, pa.int64()), pa.array(mark, pa.int64()), pa.array(at, pa.int32())],
                    names=["node", "line", "masked", "doc", "mark", "at"],
                )

    return arrow_rows(texts.select("doc", "mark", "t"), rows, "node long, line long, masked string, doc long, mark long, at int")


def _equal_places(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def _place_blocks(words: list[str], need: int) -> list[tuple]:
    """The words after the first ``DEPTH`` in as many blocks as places may differ, and one: lines with ``need`` equal places share a block."""
    n, first = len(words) - need + 1, min(DEPTH, len(words))
    cuts = [first + (len(words) - first) * i // n for i in range(n + 1)]
    return [(i, *words[cuts[i] : cuts[i + 1]]) for i in range(n)]


def _led(left: DataFrame, alike: int) -> DataFrame:
    """(node, line, masked, leader): a node's lines, best first, join the first leader that is alike, or lead."""

    def start():
        return [], defaultdict(list)

    def step(state, row):
        if row is None:
            return state, []
        leaders, having = state
        words = row["masked"].split(" ")
        need = -(-alike * len(words) // 100)
        blocks = _place_blocks(words, need)
        for k in merge(*[having[b] for b in blocks if b in having]):
            if sum(map(eq, words, leaders[k])) >= need:
                break
        else:
            k = len(leaders)
            leaders.append(words)
            for b in blocks:
                having[b].append(k)
        return state, [(row["node"], row["line"], row["masked"], " ".join(leaders[k]))]

    ranked = left.select("node", "line", "masked", (-F.col("n")).alias("rank"))
    return fold(ranked, ["node"], ["rank", "masked"], start, step, "node long, line long, masked string, leader string")


def templates(lines: DataFrame, alike: int = ALIKE, leaders: int = LEADERS) -> DataFrame:
    """(node, line, template: hash, leader: masked line) of every distinct masked line."""
    once = lines.groupBy("node", "line", "doc").agg(F.min("masked").alias("masked"))
    left = written(once.groupBy("node", "line").agg(F.min("masked").alias("masked"), F.count(F.lit(1)).alias("n")), "line-variants")
    done = None
    for k in range(leaders):
        lead = written(left.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "masked")).alias("lead")).select("node", F.col("lead.masked").alias("leader")), "line-leaders")
        same = _equal_places(F.split("masked", " "), F.split("leader", " "))
        tried = left.join(lead, "node").withColumn("joins", 100 * same >= alike * F.size(F.split("masked", " ")))
        tried = written(tried, "line-tried")
        own = tried.where("joins").select("node", "line", "masked", "leader")
        done = own if done is None else done.unionByName(own)
        left = tried.where("not joins").select("node", "line", "masked", "n")
        if k + 1 < leaders and left.isEmpty():
            break
    rest = _led(left, alike)
    done = rest if done is None else done.unionByName(rest)
    return done.select("node", "line", "masked", "leader", F.xxhash64("node", "leader").alias("template"))


def template_texts(found: DataFrame) -> DataFrame:
    """(template, text, lines): leaders, with ``<*>`` where a line of the template differs."""
    places = found.select("template", "leader", F.posexplode(F.zip_with(F.split("masked", " "), F.split("leader", " "), lambda a, b: a == b)).alias("place", "same"))
    fixed = places.groupBy("template", "leader", "place").agg(F.min("same").alias("fixed"))
    fixed = fixed.select("template", "place", F.when(F.col("fixed"), F.get(F.split("leader", " "), F.col("place"))).otherwise("<*>").alias("word"))
    texts = fixed.groupBy("template").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("text"))
    return texts.join(found.groupBy("template").count().withColumnRenamed("count", "lines"), "template")


def recurring_lines(df: DataFrame, text: str = "text", key: str = "doc_id", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc, mark, gone: numbers of the lines to drop) of the texts that lose lines."""
    spark = df.sparkSession
    texts = _texts(df, text, key)
    packed = bloom.build(written(nodes(texts, least_docs), "line-nodes"))
    release(spark)
    lines = written(lines_in(texts, packed), "lines")
    named = written(templates(lines).select("node", "line", "template"), "line-templates")
    lines = written(lines.select("node", "line", "doc", "mark", "at").join(named, ["node", "line"]).select("template", "doc", "mark", "at"), "line-places")
    recurring = lines.groupBy("template", "doc").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.min("doc").alias("first"))
    recurring = written(recurring.where(F.col("docs") >= least_docs).select("template", "first"), "line-recurring")
    gone = lines.join(recurring, "template").where("doc != first")
    return gone.groupBy("doc", "mark").agg(F.collect_set("at").alias("gone"))


def drop_lines(df: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = (), least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row for each row: key, the ``keep`` columns (named as ``out_names`` says), text (without dropped lines), n_lines, n_dropped."""
    texts = df.select(*[col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], col(text).alias("_text"), col(key).alias("_key"))
    docs = texts.withColumn("doc", F.coalesce(F.col("_key").cast("long"), F.lit(LAST))).withColumn("mark", F.xxhash64("_text"))
    both = docs.join(recurring_lines(df, text, key, least_docs), ["doc", "mark"], "left")
    n, names = len(keep), out_names(keep, ("key", "text", "n_lines", "n_dropped"))
    both = both.select("_key", *[f"_keep{i}" for i in range(n)], "_text", "gone")

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in pieces(batch, n + 1):
            out = []
            for raw, gone in zip(raw_texts(part.column(n + 1)), part.column(n + 2).to_pylist(), strict=True):
                lines = raw.split(b"\n") if raw else []
                if gone:
                    gone = set(gone)
                    kept = [x for i, x in enumerate(lines) if i not in gone]
                    raw = b"\n".join(kept) if any(x.split() for x in kept) else b""
                out.append((None if raw is None else raw.decode(), len(lines), len(gone or ())))
            t, a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([*part.columns[: n + 1], pa.array(t, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["key", *names, "text", "n_lines", "n_dropped"])

    kinds = [both.schema[c].dataType.simpleString() for c in ("_key", *[f"_keep{i}" for i in range(n)])]
    schema = ", ".join(f"`{c}` {k}" for c, k in zip(("key", *names), kinds, strict=True))
    return arrow_rows(both, rows, f"{schema}, text string, n_lines long, n_dropped long")
