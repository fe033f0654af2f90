"""Fixed-size sets for broadcast: a Bloom filter built by tasks and merged by the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from chainweave.llm.bytewords import U, mix

#: 2**25 bits are 4 MB at any size of input; a fuller filter lets more rows through and stays right.
BITS = 25


def _slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys.astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(7))
    return (h >> U(64 - bits)).astype(np.int64), (mix(h) >> U(64 - bits)).astype(np.int64)


def bloom(keys: DataFrame, bits: int = BITS) -> Broadcast:
    """A broadcast array of 2**bits flags for the one long column of ``keys``."""
    size, parts = 1 << bits, 64

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(size >> 3, dtype=np.uint8)  # bits, as a worker's memory counts
        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for s in _slots(k, bits):
                np.bitwise_or.at(flags, s >> 3, (128 >> (s & 7)).astype(np.uint8))
        rows = [(p, x.tobytes()) for p, x in enumerate(np.split(flags, parts)) if x.any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "flags"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        got = np.zeros(size // parts // 8, dtype=np.uint8)
        for x in table.column("flags"):
            got |= np.frombuffer(x.as_py(), dtype=np.uint8)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "flags": pa.array([got.tobytes()], pa.binary())})

    kind = "part int, flags binary"
    flags = np.zeros((parts, size // parts // 8), dtype=np.uint8)
    for row in keys.mapInArrow(mark, kind).groupBy("part").applyInArrow(merge, kind).collect():  # at most 64 rows
        flags[row["part"]] = np.frombuffer(bytes(row["flags"]), dtype=np.uint8)
    return keys.sparkSession.sparkContext.broadcast(flags.reshape(-1))


def maybe_in(flags: np.ndarray, keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    """True for every key that was put in, and for a few others."""
    out = np.ones(len(keys), dtype=bool)
    for s in _slots(keys, bits):
        out &= (flags[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1
    return out
