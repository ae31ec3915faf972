"""Exact deduplication by composable polynomial fingerprints.

A text's bytes, without white space, are the coefficients of a polynomial that is
evaluated modulo 2^61-1 at two fixed points. Chunks of ``CHUNK`` bytes are hashed apart;
for a chunk of n bytes after a prefix, ``fp = fp * point^n + fp(chunk)`` (``combine``). A text of more than
``HUGE`` bytes is cut into segments that different tasks hash; a grouped, ordered fold puts their
fingerprints together. Texts with equal fingerprints and lengths are then compared chunk by chunk: each
chunk of each text in such a group, found through a Bloom filter, is streamed, equal chunks collapse
before the shuffle, and a group with two different chunks in one place is split by the SHA-256
of its texts. Texts of groups of one are never shuffled; a group's rows meet its best row in a plain join, which
Spark splits where it is hot.

Cases: null counts as empty, all empty texts form one group; of ties for the longest
original text the smallest key stays, a null key after all others; repeated rows are a
group, and rows equal in key and length can't be told apart, so ``kept`` is true for each
of them if it is for one; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import SPACE_BYTES, arrow_rows, col, pieces, raw_texts, written

PRIME = (1 << 61) - 1
POINTS = (0x0123456789ABCDEF % PRIME, 0x1B873593CC9E2D51 % PRIME)
CHUNK = 1 << 15
#: Bytes of a text, and code points of the segments that longer ones are cut into.
HUGE, SEGMENT = 1 << 23, 1 << 21


def _powers(point: int) -> tuple[np.ndarray, np.ndarray]:
    """High and low 32 bits of point^(CHUNK-1) ... point^0."""
    out, x = np.empty(CHUNK, np.uint64), 1
    for i in range(CHUNK - 1, -1, -1):
        out[i] = x
        x = x * point % PRIME
    return out >> np.uint64(32), out & np.uint64(0xFFFFFFFF)


_TABLES: dict = {}


def fingerprint(data: bytes, points: tuple[int, ...] = POINTS) -> tuple[int, ...]:
    """Values of the polynomial at ``points``."""
    tables = [_TABLES[p] if p in _TABLES else _TABLES.setdefault(p, _powers(p)) for p in points]
    total = (0,) * len(points)
    for at in range(0, len(data), CHUNK):
        part = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - at), at).astype(np.uint64)
        n = len(part)
        own = tuple(((int(part @ hi[-n:]) << 32) + int(part @ lo[-n:])) % PRIME for hi, lo in tables)
        total = combine(total, own, n, points)
    return total


def combine(prefix: tuple[int, ...], suffix: tuple[int, ...], suffix_bytes: int, points: tuple[int, ...] = POINTS) -> tuple[int, ...]:
    """Fingerprint of two byte strings put together, from those of each."""
    return tuple((a * pow(p, suffix_bytes, PRIME) + b) % PRIME for a, b, p in zip(prefix, suffix, points, strict=True))


def normalised(raw: bytes | None) -> bytes:
    return (raw or b"").translate(None, SPACE_BYTES)


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", points: tuple[int, ...] = POINTS, huge: int = HUGE, segment: int = SEGMENT) -> DataFrame:
    """One row for each row: key, code points of the original text, bytes and fingerprint
    (fp1, fp2) and SHA-256 of the normalised text."""
    given = df.select(col(key).alias("key"), col(text).alias("t"))
    large = F.coalesce(F.octet_length("t"), F.lit(0)) > huge

    def rows(batch: pa.RecordBatch):
        for part in pieces(batch, 1):
            lengths = pa.compute.fill_null(pa.compute.utf8_length(part.column(1)), 0)
            texts = [normalised(x) for x in raw_texts(part.column(1))]
            fps = [fingerprint(x, points) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), lengths.cast(pa.int64()), pa.array(map(len, texts), pa.int64()), *[pa.array([f[i] for f in fps], pa.int64()) for i in (0, 1)], pa.array(hashlib.sha256(x).hexdigest() for x in texts)],
                names=["key", "chars", "bytes", "fp1", "fp2", "sha"],
            )

    own = arrow_rows(given.where(~large), rows, f"key {given.schema['key'].dataType.simpleString()}, chars long, bytes long, fp1 long, fp2 long, sha string")
    spaces = SPACE_BYTES.decode()
    rest = given.where(large).select(
        "key", "t", F.sha2(F.col("t").cast("binary"), 256).alias("id"), F.char_length("t").cast("long").alias("chars"),
        F.sha2(F.translate("t", spaces, "").cast("binary"), 256).alias("sha"),
    )
    return own.unionByName(rest.drop("t").join(_by_segments(rest, points, segment), "id").select("key", "chars", "bytes", "fp1", "fp2", "sha"))


def _by_segments(rest: DataFrame, points: tuple[int, ...], segment: int) -> DataFrame:
    """(id, bytes, fp1, fp2) of texts (id, t, chars), whose segments are hashed wherever they are."""
    cut = F.transform(F.sequence(F.lit(0).cast("long"), F.expr(f"(chars - 1) div {segment}")), lambda i: F.substring(F.col("t"), (i * segment + 1).cast("int"), F.lit(segment)))
    parts = rest.select("id", F.posexplode(cut).alias("number", "part")).repartition("id", "number")

    def hashed(batch: pa.RecordBatch):
        texts = [normalised(x) for x in raw_texts(batch.column(2))]
        fps = [fingerprint(x, points) for x in texts]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(map(len, texts), pa.int64()), *[pa.array([f[i] for f in fps], pa.int64()) for i in (0, 1)]], names=["id", "number", "bytes", "fp1", "fp2"])

    once = arrow_rows(parts, hashed, "id string, number int, bytes long, fp1 long, fp2 long").dropDuplicates(["id", "number"])
    listed = once.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("number", "bytes", "fp1", "fp2"))).alias("parts"))

    def put_together(batch: pa.RecordBatch):
        out = []
        for parts in batch.column(1).to_pylist():
            total, n = (0,) * len(points), 0
            for x in parts:
                total, n = combine(total, (x["fp1"], x["fp2"]), x["bytes"], points), n + x["bytes"]
            out.append((n, *total))
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in zip(*out, strict=True)]], names=["id", "bytes", "fp1", "fp2"])

    return arrow_rows(listed, put_together, "id string, bytes long, fp1 long, fp2 long")


def conflicts(df: DataFrame, groups: DataFrame, text: str = "text", points: tuple[int, ...] = POINTS) -> DataFrame:
    """Fingerprints in ``groups`` (fp1, fp2, bytes; a table that is read twice) that texts with different chunks share."""
    given = df.select(col(text).alias("t"))
    filters = df.sparkSession.sparkContext.broadcast(bloom.build(groups.select("fp1")))

    def fp_rows(batch: pa.RecordBatch):
        for part in pieces(batch, 0):
            texts = [normalised(x) for x in raw_texts(part.column(0))]
            fps = np.array([fingerprint(x, points) for x in texts], np.int64)
            some = np.flatnonzero(bloom.passes(filters.value, np.ascontiguousarray(fps[:, 0])))
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(fps[some, i]) for i in (0, 1)], pa.array([len(texts[i]) for i in some], pa.int64()), pa.array([texts[i] for i in some], pa.binary())],
                names=["fp1", "fp2", "bytes", "body"],
            )

    def chunk_rows(batch: pa.RecordBatch):
        for part in pieces(batch, 3):
            at, number, body = [], [], []
            for i, x in enumerate(part.column(3)):
                x = x.as_py()
                for k, start in enumerate(range(0, len(x), CHUNK)):
                    at.append(i)
                    number.append(k)
                    body.append(x[start : start + CHUNK])
            yield pa.RecordBatch.from_arrays(
                [part.column(c).take(pa.array(at, pa.int64())) for c in range(3)] + [pa.array(number, pa.int32()), pa.array(body, pa.binary())],
                names=["fp1", "fp2", "bytes", "number", "chunk"],
            )

    names = ["fp1", "fp2", "bytes"]
    bodies = arrow_rows(given, fp_rows, "fp1 long, fp2 long, bytes long, body binary")
    chunks = arrow_rows(bodies, chunk_rows, "fp1 long, fp2 long, bytes long, number int, chunk binary").distinct()
    many = chunks.groupBy(*names, "number").count().where("count > 1").select(*names).distinct()
    return many.join(groups.select(*names), names, "left_semi")


def dedup(df: DataFrame, text: str = "text", key: str = "doc_id", points: tuple[int, ...] = POINTS, huge: int = HUGE, segment: int = SEGMENT) -> DataFrame:
    """One row for each row of ``df``: key, keep_key (of the row that stays), group_size,
    kept, sha (of the normalised text)."""
    marks = written(fingerprints(df, text, key, points, huge, segment), "fingerprints")
    names = ["fp1", "fp2", "bytes"]
    groups = written(marks.groupBy(*names).count().where("count > 1 and bytes > 0").select(*names), "fp-groups")
    split = written(conflicts(df, groups, text, points), "conflicts")
    marks = marks.join(split.withColumn("split", F.lit(True)), names, "left")
    marks = marks.withColumn("part", F.when(F.col("split"), F.col("sha")).otherwise(F.lit("")))
    best = marks.groupBy(*names, "part").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct((-F.col("chars")).alias("c"), F.col("key").isNull().alias("n"), F.col("key").alias("k"))).alias("best"),
    )
    best = written(best.where("group_size > 1"), "fp-best")  # the join below has no aggregate on a side, so that Spark may split it
    both = marks.join(best, [*names, "part"], "left")
    return both.select(
        "key", F.when(F.col("best").isNull(), F.col("key")).otherwise(F.col("best.k")).alias("keep_key"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("best").isNull() | (F.col("key").eqNullSafe(F.col("best.k")) & (-F.col("chars") == F.col("best.c")))).alias("kept"), "sha",
    )
