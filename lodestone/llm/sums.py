"""Sums of vectors over all rows: each partition sums its own, the sums meet in a tree of bounded fan-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.blocks import pack, unpack
from lodestone.llm.common import materialize

FAN_IN = 32
_SUMS = pa.schema([("at", pa.int64()), ("sums", pa.binary())])


def sparse(vector: np.ndarray) -> bytes:
    """A vector of counts that are mostly zero."""
    at = np.flatnonzero(vector)
    places = pack(np.diff(at, prepend=0).astype(np.uint32))
    return len(vector).to_bytes(8, "little") + len(places).to_bytes(8, "little") + places + pack(vector[at].astype(np.int64))


def dense(data: bytes) -> np.ndarray:
    out, n = np.zeros(int.from_bytes(data[:8], "little")), int.from_bytes(data[8:16], "little")
    out[np.cumsum(unpack(data[16 : 16 + n], np.uint32), dtype=np.int64)] = unpack(data[16 + n :], np.int64)
    return out


def tree_sum(df: DataFrame, width: int, encode: Callable[[np.ndarray], bytes] = np.ndarray.tobytes, decode: Callable[[bytes], np.ndarray] = np.frombuffer) -> np.ndarray:
    """Sum of a table of binary rows (of doubles, unless encode and decode say otherwise), FAN_IN rows to a task, level by level; the driver
    gets FAN_IN rows at most."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for x in table["sums"]:
            total += decode(x.as_py())
        return pa.table({"at": [table["at"][0].as_py()], "sums": [encode(total)]}, schema=_SUMS)

    df = materialize(df, "sums")
    while df.count() > FAN_IN:
        df = materialize(df.select(F.floor(F.col("at") / FAN_IN).alias("at"), "sums").groupBy("at").applyInArrow(add, "at long, sums binary"), "sums")
    return sum((decode(bytes(r.sums)) for r in df.collect()), np.zeros(width))


def partition_sums(df: DataFrame, width: int, of: Callable[[pa.RecordBatch], np.ndarray], encode: Callable = np.ndarray.tobytes, decode: Callable = np.frombuffer) -> np.ndarray:
    """Sum over all rows: of(batch) gives a batch's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(width), False
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
                seen = True
        if seen:
            yield pa.RecordBatch.from_pydict({"at": [TaskContext.get().partitionId()], "sums": [encode(total)]}, schema=_SUMS)

    return tree_sum(df.mapInArrow(run, "at long, sums binary"), width, encode, decode)
