"""Sequential folds over ordered rows of a key, as streams.

Rows are hashed by key and sorted within partitions, by Spark, with spill; the fold sees
Arrow batches one after the other and keeps only its state. A long key is a long
task, never a large one."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, list[tuple]]], schema: str) -> DataFrame:
    """``step(state, row)`` gives the next state and rows of ``schema``; ``start()`` is the state
    before the first row of a key. A row of its own, None, tells ``step`` that a key ended."""
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    fields = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = to_arrow_schema(_plain(schema))
        now, state = None, None
        out: list[tuple] = []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), out_schema, strict=True)], schema=out_schema)

        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in fields)
                if key != now:
                    if now is not None:
                        out += step(state, None)[1]
                    now, state = key, start()
                state, made = step(state, row)
                out += made
            if len(out) > 5000:
                yield block()
                out = []
        if now is not None:
            out += step(state, None)[1]
        if out:
            yield block()

    return rows.mapInArrow(run, schema)


def _plain(schema: str) -> StructType:
    fields = []
    for part in schema.split(","):
        name, kind = part.split(":") if ":" in part else part.split()
        fields.append((name.strip().strip("`"), kind.strip()))
    from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, TimestampType

    kinds = {"long": LongType(), "int": IntegerType(), "string": StringType(), "double": DoubleType(), "boolean": BooleanType(), "timestamp": TimestampType(), "array<string>": ArrayType(StringType()), "array<long>": ArrayType(LongType())}
    out = StructType()
    for name, kind in fields:
        out.add(name, kinds[kind])
    return out
