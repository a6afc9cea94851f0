"""Exact search of the largest inner products, by vectors sorted by length and partial sums in a rotated basis.

Vectors are written in blocks by descending length, packed in the least width that holds them. An orthogonal rotation (from the second moments
of all vectors) puts most of their weight into the leading coordinates. A query first meets the block of the longest vectors, which gives it a threshold; with it, blocks
are left out whose length times the query's can't reach it, then single vectors whose partial sum plus the product of the
residual lengths can't (Cauchy-Schwarz). What is left is scored exactly in integers. Thresholds only rise, and only what is strictly below is
left out, so ties are kept.

Traffic: vectors are shuffled once, to be sorted. Then queries go to the vectors: they are sorted by the length that a partner needs, and for each batch
of QUERY_BYTES of them, sent to all tasks, the blocks are read in place, as far down as the batch needs. A task returns the best k for each of its queries
at most. So what is sent grows with the queries and k, what is read with the vectors and the number of batches.

Defined results: a vector that is null, or holds a null or non-finite component, or has a null id, takes no part; scores beyond 64 bits wrap around; of rows
under one id the least vector counts, once; vectors meet only those with as many components; ties go to the smaller id; a query with
fewer partners than k has them all; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, new_folder, partitions
from lodestone.llm.sums import partition_sums

BLOCK = 4096
#: Packed bytes of a block, about, and blocks that a task meets (fewer where cores would idle).
BLOCK_BYTES = 4 << 20
CELL_BLOCKS = 64
#: Queries, and their packed bytes, that are sent to all tasks at once, at most.
QUERIES = 65536
QUERY_BYTES = 8 << 20
#: More components than this aren't rotated, as the second moments would not fit; bounds hold in any basis.
ROTATED = 2048
#: Products of components up to this size, summed, are exact in doubles.
_EXACT = 2.0**52

_PACKED = "dim int, block long, n int, longest double, ids binary, data binary"
_SCHEMA = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("longest", pa.float64()), ("ids", pa.binary()), ("data", pa.binary())])


def packed(vectors: np.ndarray) -> bytes:
    """Integers in the least width that holds all of them; the first byte is the width."""
    most = max(abs(int(vectors.min(initial=0))), abs(int(vectors.max(initial=0)) + 1))
    width = next(w for w in (2, 4, 8) if most <= 1 << (8 * w - 1))
    return bytes([width]) + vectors.astype(f"<i{width}").tobytes()


def unpacked(data: bytes, dim: int) -> np.ndarray:
    flat = np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)
    return flat.reshape(-1, dim) if dim else flat.reshape(0, 0)


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def _sorted_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Pack (dim, id, vector, norm) into blocks by descending length. Blocks are numbered by partition of the sorted rows and place in it, so
    their numbers rise as lengths fall, and nothing has to be counted."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, dim, number = [], None, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            data = np.array([v for _, v in held], np.int64).reshape(len(held), dim)
            longest = math.sqrt(float((data[0].astype(float) ** 2).sum()))
            ids = np.array([i for i, _ in held], np.int64).tobytes()
            return pa.RecordBatch.from_pydict({"dim": [dim], "block": [number], "n": [len(held)], "longest": [longest], "ids": [ids], "data": [packed(data)]}, schema=_SCHEMA)

        for batch in batches:
            for d, i, v in zip(batch["dim"].to_pylist(), batch["id"].to_pylist(), batch["vector"].to_pylist(), strict=True):
                if held and (d != dim or len(held) >= min(block, BLOCK_BYTES // (2 * max(1, d)) + 1)):
                    yield flush()
                    held, number = [], number + 1
                dim = d
                held.append((i, v))
        if held:
            yield flush()

    dealt = rows.repartitionByRange(partitions(rows), "dim", F.desc("norm"), "id").sortWithinPartitions("dim", F.desc("norm"), "id")
    return materialize(dealt.mapInArrow(gather, _PACKED), "vectors")


def _rows(row: dict, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, unpacked(row["data"], dim).reshape(len(ids), dim)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    return (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist())


class Search:
    """The best k of a set of queries so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.ids, self.vectors, self.rotation, self.k = ids, vectors, rotation, k
        self.turned = vectors.astype(float) @ rotation
        self.length = np.sqrt((self.turned**2).sum(1))
        self.floor = np.full(len(ids), -np.inf) if floors is None else floors.copy()
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))  # query, id, score
        dim = vectors.shape[1]
        self.steps = sorted({max(1, dim // 8), max(1, dim // 3)} - {dim}) if dim else []

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Score a block of vectors against all queries that it can matter to."""
        turned = vectors.astype(float) @ self.rotation
        length = np.sqrt((turned**2).sum(1))
        slack = 1e-9 * (1 + self.length * length.max(initial=0))
        take = np.flatnonzero(self.length * length.max(initial=0) + slack >= self.floor)
        for start in range(0, len(take), 512):
            self._meet(take[start : start + 512], ids, vectors, turned, length, slack)

    def _meet(self, q: np.ndarray, ids: np.ndarray, vectors: np.ndarray, turned: np.ndarray, length: np.ndarray, slack: np.ndarray) -> None:
        floor = (self.floor[q] - slack[q])[:, None]
        alive = np.multiply.outer(self.length[q], length) >= floor
        for h in self.steps:
            if not np.isfinite(floor).any() or not alive.any():
                break
            columns = np.flatnonzero(alive.any(0))
            rest = np.sqrt(np.maximum(length[columns] ** 2 - (turned[columns, :h] ** 2).sum(1), 0))
            own = np.sqrt(np.maximum(self.length[q] ** 2 - (self.turned[q, :h] ** 2).sum(1), 0))
            # Lengths of residuals are differences: the square root of their rounding is added.
            bound = self.turned[q, :h] @ turned[columns, :h].T + np.multiply.outer(own + 1e-6 * self.length[q], rest + 1e-6 * length[columns])
            alive[:, columns] &= bound >= floor
        alive &= self.ids[q][:, None] != ids[None, :]
        rows, columns = np.nonzero(alive)
        if not len(rows):
            return
        most = float(np.abs(self.vectors[q]).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
        if most < _EXACT and len(rows) * 8 > alive.size:
            score = (self.vectors[q].astype(float) @ vectors.T.astype(float))[rows, columns].astype(np.int64)
        else:
            score = np.concatenate([np.einsum("ij,ij->i", self.vectors[q[rows[s : s + 65536]]], vectors[columns[s : s + 65536]]) for s in range(0, len(rows), 65536)])
        keep = score >= self.floor[q[rows]]
        self._add(q[rows[keep]], ids[columns[keep]], score[keep])

    def _add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = (np.concatenate(p) for p in zip(self.best, (query, ids, score), strict=True))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        last = place == self.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last])
        self.best = query[keep], ids[keep], score[keep]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, cell_blocks: int = CELL_BLOCKS, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, id, score): for each row that is_query (a condition on ``id``) chooses, its k best partners among all other rows."""
    spark = vectors.sparkSession
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)
    # Only where ids repeat are vectors brought together by id.
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.select("id", quantised(F.col("v"), scale).alias("vector"))
    else:
        rows = rows.groupBy("id").agg(F.min(quantised(F.col("v"), scale)).alias("vector"))
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = rows.select(F.size("vector").alias("dim"), "id", "vector", norm.alias("norm"))
    blocks = _sorted_blocks(rows, block)
    found = new_folder(spark, "found")
    schema = "query_id long, id long, score long"
    spark.createDataFrame([], schema).write.parquet(found)
    for dim in sorted(r.dim for r in blocks.select("dim").distinct().collect()):
        _search(blocks.where(F.col("dim") == dim), dim, is_query, k, cell_blocks, queries, found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = spark.read.schema(schema).parquet(found).withColumn("rank", F.row_number().over(order))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


_QUERIES = pa.schema([("batch", pa.int64()), ("n", pa.int64()), ("need", pa.float64()), ("ids", pa.binary()), ("data", pa.binary()), ("floor", pa.binary())])


def _search(blocks: DataFrame, dim: int, is_query: Column, k: int, cell_blocks: int, queries: int, found: str) -> None:
    """Append (query_id, id, score) of the vectors of one size to a folder: the best k of each task for each query."""

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        return sum((x.T @ x for x in (_rows(row, dim)[1].astype(float) for row in _each(iter([batch])))), np.zeros((dim, dim))).reshape(-1)

    if 0 < dim <= ROTATED:
        rotation = np.linalg.svd(partition_sums(blocks.select("ids", "data"), dim * dim, moments).reshape(dim, dim))[0]
    else:
        rotation = np.eye(dim)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            ids, data = _rows(row, dim)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([x.tobytes() for x in data], pa.binary())], names=["id", "data"])

    asked = blocks.select("ids", "data").mapInArrow(single, "id long, data binary").where(is_query)
    # The longest vectors, a block at most: it is collected, as its size is fixed, and gives each query its first threshold.
    first = blocks.agg(F.min("block")).first()[0]
    first_ids, first_rows = _rows(blocks.where(F.col("block") == first).select("ids", "data").toArrow().to_pylist()[0], dim)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = np.frombuffer(b"".join(batch["data"].to_pylist()), np.int64).reshape(batch.num_rows, dim)
                search = Search(batch["id"].to_numpy(), own, rotation, k)
                search.meet(first_ids, first_rows)
                need = np.where(search.length > 0, search.floor / np.where(search.length > 0, search.length, 1), -np.inf)
                yield pa.RecordBatch.from_arrays([batch["id"], batch["data"], pa.array(search.floor), pa.array(need)], names=["id", "data", "floor", "need"])

    ready = materialize(asked.mapInArrow(floors, "id long, data binary, floor double, need double"), "floors")
    most = max(1, min(queries, QUERY_BYTES // (8 * max(1, dim))))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            ids, data, floor, need = zip(*held, strict=True)
            own = np.frombuffer(b"".join(data), np.int64).reshape(len(ids), dim)
            return pa.RecordBatch.from_pydict({"batch": [number], "n": [len(ids)], "need": [min(need)], "ids": [np.array(ids, np.int64).tobytes()], "data": [packed(own)], "floor": [np.array(floor).tobytes()]}, schema=_QUERIES)

        for batch in batches:
            for x in zip(*(batch[c].to_pylist() for c in ("id", "data", "floor", "need")), strict=True):
                held.append(x)
                if len(held) >= most:
                    yield flush()
                    held, number = [], number + 1
        if held:
            yield flush()

    dealt = ready.repartitionByRange(max(1, -(-ready.count() // most)), F.desc("need"), "id").sortWithinPartitions(F.desc("need"), "id")
    batches = materialize(dealt.mapInArrow(together, "batch long, n long, need double, ids binary, data binary, floor binary"), "asked")
    n, cores = blocks.count(), blocks.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(n, cores), -(-n // cell_blocks))
    # Neighbouring batches that are small go together; what is sent at once stays within the bound.
    spans: list[list] = []
    for r in sorted(batches.select("batch", "n", "need").collect()):
        if spans and spans[-1][2] + r.n <= most:
            spans[-1] = [spans[-1][0], r.batch, spans[-1][2] + r.n, min(spans[-1][3], r.need)]
        else:
            spans.append([r.batch, r.batch, r.n, r.need])
    for low, high, _, need in spans:
        held = sorted(batches.where(F.col("batch").between(low, high)).toArrow().to_pylist(), key=lambda row: row["batch"])
        ids, data = (np.concatenate(x) for x in zip(*(_rows(row, dim) for row in held), strict=True))
        floor = np.concatenate([np.frombuffer(row["floor"]) for row in held])

        def run(parts: Iterator[pa.RecordBatch], ids: np.ndarray = ids, data: np.ndarray = data, floor: np.ndarray = floor) -> Iterator[pa.RecordBatch]:
            search = Search(ids, data, rotation, k, floor)
            for row in _each(parts):
                search.meet(*_rows(row, dim))
            query, partner, score = search.best
            yield pa.RecordBatch.from_arrays([pa.array(search.ids[query]), pa.array(partner), pa.array(score)], names=["query_id", "id", "score"])

        far = blocks.where(F.col("longest") * (1 + 1e-9) + 1e-9 >= need) if math.isfinite(need) else blocks
        far.select("ids", "data").coalesce(tasks).mapInArrow(run, "query_id long, id long, score long").write.mode("append").parquet(found)
