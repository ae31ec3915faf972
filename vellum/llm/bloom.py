"""Bloom filters over well-mixed 64-bit numbers: what they let pass wrongly costs time, never a
result. A filter is sized by the number of values, up to ``MOST_BITS``, which bounds its broadcast
for any input; some 3 * 10^7 values fill that, beyond it ever more passes wrongly. A value has all
its bits in one block, so that blocks are made apart, each by the task that has its values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, mixed

LEAST_BITS, MOST_BITS, BITS_EACH = 18, 28, 12
BLOCK = 15
SHIFTS = (0, 17, 34)


def _places(values: np.ndarray) -> list[np.ndarray]:
    h = mixed(values.view(np.uint64))
    return [(h >> np.uint64(s)) & np.uint64((1 << BLOCK) - 1) for s in SHIFTS]


def build(values: DataFrame) -> np.ndarray:
    """Packed bits over the one long column of ``values``, a table that is read twice."""
    (name,) = values.columns
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * values.count()).bit_length()))
    blocks = 1 << (bits - BLOCK)

    def run(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            block, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            order = np.argsort(block, kind="stable")
            block, v = block[order], v[order]
            edge = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]).tolist()
            places = _places(v)
            for lo, hi in zip(edge, edge[1:], strict=False):
                bit = own.setdefault(int(block[lo]), np.zeros(1 << BLOCK, bool))
                for at in places:
                    bit[at[lo:hi]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([np.packbits(x).tobytes() for x in own.values()], pa.binary())], names=["block", "bits"])

    dealt = values.where(F.col(name).isNotNull()).select(F.expr(f"cast(shiftrightunsigned({name}, 40) & {blocks - 1} as int)").alias("block"), name).repartition("block")
    made = mapped(dealt, run, "block int, bits binary").toArrow()
    out = np.zeros((blocks, 1 << (BLOCK - 3)), np.uint8)
    for block, x in zip(made.column(0).to_pylist(), made.column(1), strict=True):
        out[block] = np.frombuffer(x.as_py(), np.uint8)
    return out.ravel()


def passes(packed: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value may be in the set."""
    blocks = np.uint64(len(packed) >> (BLOCK - 3))
    start = (values.view(np.uint64) >> np.uint64(40) & (blocks - np.uint64(1))) << np.uint64(BLOCK)
    out = np.ones(len(values), bool)
    for at in _places(values):
        at |= start
        out &= (packed[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)).astype(bool)
    return out
