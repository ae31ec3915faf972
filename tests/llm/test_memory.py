"""What workers hold: small batches, free memory given back, lines in small parts."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.llm import bloom, common, language_id, ngram_join, piece_lattice
from vellum.llm import line_templates as lt


class Kept:
    """A table that keeps the function that it is mapped by."""

    def __init__(self, spark):
        self.sparkSession = spark

    def mapInArrow(self, run, schema):
        self.run = run


@pytest.fixture
def unset(spark):
    spark.conf.unset(common.BATCH_BYTES)
    yield spark
    spark.conf.unset(common.BATCH_BYTES)


def sizes(df):
    def rows(batch):
        return pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    return [tuple(r) for r in common.arrow_rows(df, rows, "n long, size long").collect()]


def test_batches_are_bounded_by_bytes(unset):
    texts = unset.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), F.when(F.col("id") == 30, 9 << 20).otherwise(1 << 19).cast("int")).alias("t"))
    got = sizes(texts)
    assert sum(n for n, _ in got) == 60 and sum(size for _, size in got) >= 59 * (1 << 19) + (9 << 20)
    assert sorted(size for _, size in got)[-2] <= common.MOST_BATCH + (1 << 20)


def test_a_smaller_setting_stays(unset):
    unset.conf.set(common.BATCH_BYTES, "1m")
    texts = unset.range(0, 16, 1, 1).select(F.repeat(F.lit("x"), 1 << 19).alias("t"))
    assert max(size for _, size in sizes(texts)) < 2 << 20
    assert unset.conf.get(common.BATCH_BYTES) == "1m"


def test_tasks_give_free_memory_back(spark, monkeypatch):
    seen, df = [], Kept(spark)
    monkeypatch.setattr(common, "trim", lambda: seen.append("trim"))
    common.arrow_rows(df, lambda batch: seen.append(batch.num_rows), "n long")
    assert list(df.run(iter([pa.RecordBatch.from_pydict({"n": [1, 2]})]))) == []
    assert seen == ["trim", 2, "trim"]


@pytest.mark.parametrize("module", [bloom, language_id, ngram_join, piece_lattice])
def test_modules_of_the_pipeline_map_so(module):
    assert module.mapped is common.mapped


def test_lines_are_held_a_part_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(lt, "arrow_rows", lambda df, rows, schema: rows)
    texts = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    rows = lt.lines_in(lt._texts(texts, "text", "doc_id"), np.zeros(1 << 15, np.uint8))
    text = "\n".join(["some short words are on this line"] * 1000)
    batch = pa.RecordBatch.from_pydict({"doc": list(range(120)), "mark": list(range(120)), "t": [text] * 120})
    tracemalloc.start()
    assert list(rows(batch)) == []
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 3 << 20 < batch.nbytes < 5 << 20
    assert peak < 8 * batch.nbytes
