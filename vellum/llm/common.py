"""What the operators of this subpackage share.

Word: a maximal run of characters outside ``[\\x20\\x09-\\x0D]``. For UTF-8
bytes that is exactly ``bytes.split()``, which the Python workers use.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Whether Spark deletes shuffle files at the end of each execution.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a batch that Spark hands to a worker, and how many a session asks for at most here (a longer row is alone).
BATCH_BYTES, MOST_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"


def col(name: str) -> Column:
    """A top-level column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def out_names(keep: tuple[str, ...], taken: tuple[str, ...]) -> list[str]:
    """Names of kept columns beside those of a result: one that clashes, in any case, gets ``_`` put after it until it doesn't."""
    used, out = {x.lower() for x in taken}, []
    for name in keep:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of our own only where none is set and all run in this process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file:///tmp/checkpoints/vellum"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/vellum-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """The same rows, written to the shared folder and read back: cuts the lineage
    and survives the loss of executors. Shuffle files of the writing go at its end, not when the driver's garbage happens to
    be collected."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``written`` wrote, once nothing reads it any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in little memory. Batches are bounded by bytes, not by Spark's 10,000 rows, on both sides of the pipe; as
    plans are run later, by others too, the session keeps that setting, unless it has a smaller one. A worker gives
    its free memory back before and after each task, as it outlives them."""
    spark = df.sparkSession
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_BYTES, "64m")) > MOST_BATCH:
        spark.conf.set(BATCH_BYTES, f"{MOST_BATCH}b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        yield from run(batches)
        trim()

    return df.mapInArrow(task, schema)


def arrow_rows(
    df: DataFrame, rows: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str
) -> DataFrame:
    """``mapped`` of a function on single batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = rows(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out

    return mapped(df, run, schema)


def pieces(batch: pa.RecordBatch, text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts come to about ``most`` bytes; a longer text is alone."""
    column = batch.column(text)
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def raw_texts(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of a string column."""
    for x in column.cast(pa.large_binary()):
        yield x.as_py()


_KEYS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0x9FB21C651E98DF25], np.uint64)
#: Of the 8 bytes loaded at a place, those of a word that has n left.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words longer than this are hashed apart, those of a text in steps of so many.
LONG_WORD, STEP = 256, 1 << 16


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    h = (h ^ (h >> np.uint64(32))) * _KEYS[2]
    h = (h ^ (h >> np.uint64(29))) * _KEYS[3]
    return h ^ (h >> np.uint64(32))


def flat_words(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts of a column, end to end, and where each text's begin (one place more than
    texts). A word's bytes are read 8 at a time, a step of words at once; ``lower``: A-Z as a-z."""
    column = pa.compute.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    n = int(offsets[-1] - offsets[0])
    raw = bytes(column.buffers()[2][int(offsets[0]) : int(offsets[-1])]) if n else b""
    offsets = offsets - offsets[0]
    raw = (raw.lower() if lower else raw) + bytes(8)
    data = np.frombuffer(raw, np.uint8)
    inner = (data[:n] != 32) & ((data[:n] - np.uint8(9)) > 4)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    edge = inner.copy()
    edge[1:] &= ~inner[:-1] | cut[1:n]
    starts = np.flatnonzero(edge)
    edge = inner
    edge[:-1] &= ~edge[1:] | cut[1:n]
    sizes = np.flatnonzero(edge) + 1 - starts
    loads = np.ndarray(n + 1, "<u8", raw, strides=(1,))
    out = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), STEP):
        start, size = starts[at : at + STEP], sizes[at : at + STEP]
        h = ((loads[start] & _MASKS[np.minimum(size, 8)]) ^ size.astype(np.uint64) * _KEYS[0]) * _KEYS[1]
        more, done = np.flatnonzero(size > 8), 8
        while len(more) and done < LONG_WORD:
            part = loads[start[more] + done] & _MASKS[np.minimum(size[more] - done, 8)]
            h[more] = mixed(h[more] ^ part) * _KEYS[0]
            done += 8
            more = more[size[more] > done]
        for i in more.tolist():
            h[i] = xxhash.xxh64_intdigest(raw[start[i] : start[i] + size[i]])
        out[at : at + STEP] = mixed(h)
    return out, np.searchsorted(starts, offsets)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are no longer held, and gives the driver's free memory back."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim()


def trim() -> None:
    """Gives this process's free memory back: a worker keeps what its earlier tasks had."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
