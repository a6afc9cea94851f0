"""Packing of token sequences by cutting-stock column generation.

A document longer than a sequence is cut into full sequences and a rest. The lengths of all pieces form a histogram of at most
``capacity`` entries, which is gathered into CLASSES classes (a class counts as its longest member). The driver solves the linear program
over patterns of classes: simplex steps on the patterns at hand, a knapsack by dynamic programming prices new ones. Solutions are rounded
down; the few pieces that this leaves, a number that depends on the classes only, are packed first-fit. Each piece gets its rank within its
class from per-partition counts, and the rank says pattern, sequence and slot; no class, however common, is gathered in one task.

Defined results: a null or empty text is the end id alone; texts of any length are whole; repeated rows are packed row by row;
null ids stay null; an empty table gives no pieces; other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.bpe import map_ids
from lodestone.llm.common import materialize

CLASSES = 192
#: The linear program stops when this share of its value is proven to be all that is left to gain.
GAP = 1e-3
STEPS = 3000


def cut(docs: DataFrame, definition: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece of every document."""

    def consume(doc_ids: list, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        rows, start = [], 0
        for doc_id, end in zip(doc_ids, ends.tolist(), strict=True):
            own = np.append(ids[start:end], end_id).astype("<u4")
            rows += [(doc_id, at, min(capacity, len(own) - at), zlib.crc32(own[at : at + capacity]), len(own)) for at in range(0, len(own), capacity)]
            start = end
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_ids(docs, definition, consume, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long", id_col, text_col)


def classes(histogram: dict[int, int], most: int = CLASSES) -> list[int]:
    """Longest lengths of the classes: all lengths if they are few, else cuts that spread the rounding evenly."""
    lengths = sorted(histogram)
    if len(lengths) <= most:
        return lengths
    out, total, held = [], sum(np.sqrt(histogram[x]) for x in lengths), 0.0
    for x in lengths:
        held += np.sqrt(histogram[x])
        if held >= total / (most - 1) or x == lengths[-1]:
            out.append(x)
            held = 0.0
    return out


def _knapsack(sizes: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: bounded knapsack over binary splits of each class."""
    best, taken, parts = np.zeros(capacity + 1), [], []
    for i in np.argsort(-values / sizes):
        if values[i] <= 1e-12:
            break
        left, k = int(min(most[i], capacity // sizes[i])), 1
        while left > 0:
            n = min(k, left)
            left, k = left - n, k * 2
            room = n * int(sizes[i])
            other = best[: capacity + 1 - room] + n * values[i]
            better = other > best[room:] + 1e-12
            best[room:] = np.where(better, other, best[room:])
            taken.append(better)
            parts.append((i, n, room))
    pattern, at = np.zeros(len(sizes), np.int64), int(np.argmax(best))
    value = float(best[at])
    for better, (i, n, room) in zip(reversed(taken), reversed(parts), strict=True):
        if at >= room and better[at - room]:
            pattern[i] += n
            at -= room
    return value, pattern


def plan(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns (pieces of each class) and how many sequences follow each; all pieces are placed, exactly once."""
    s, n = np.array(sizes, np.int64), np.array(counts, np.int64)
    if not len(s):
        return []
    columns = [np.where(np.arange(len(s)) == i, np.minimum(capacity // s[i], n[i]), 0) for i in range(len(s))]
    basis = [*range(len(s))]
    inverse = np.diag([1 / c[i] for i, c in enumerate(columns)])
    x = inverse @ n
    for _ in range(STEPS):
        price = inverse.sum(0)  # every pattern costs one sequence
        value, pattern = _knapsack(s, np.maximum(price, 0), n, capacity)
        if value <= 1 + GAP:
            break
        columns.append(pattern)
        way = inverse @ pattern
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[out] = len(columns) - 1
        inverse[out] /= way[out]
        way[out] = 0
        inverse -= np.outer(way, inverse[out])
        x = np.maximum(inverse @ n, 0)
    left, out = n.copy(), []
    for k, amount in sorted(zip(basis, x, strict=True), key=lambda p: -p[1]):
        used = columns[k] > 0
        times = int(min(np.floor(amount + 1e-6), (left[used] // columns[k][used]).min())) if used.any() else 0
        if times > 0:
            out.append((columns[k], times))
            left -= columns[k] * times
    return out + _first_fit(s, left, capacity)


def _first_fit(s: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """First-fit decreasing: each sequence takes the longest pieces that fit; equal ones are made at once."""
    out, left = [], left.copy()
    while left.any():
        pattern, room = np.zeros(len(s), np.int64), capacity
        for i in np.argsort(-s):
            pattern[i] = min(left[i], room // s[i])
            room -= int(pattern[i] * s[i])
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        out.append((pattern, times))
        left -= pattern * times
    return out


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add sequence_id and offset to pieces (a table with ``length``, from 1 to capacity)."""
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = classes(histogram)
    edges = np.array(sizes, np.int64)
    counts = np.zeros(len(sizes), np.int64)
    for length, n in histogram.items():
        counts[np.searchsorted(edges, length)] += n
    patterns = plan(sizes, counts.tolist(), capacity)
    # For each class: the first rank that each pattern takes, its pieces to a sequence, its first sequence.
    firsts, each, bases, taken, base = [[] for _ in sizes], [[] for _ in sizes], [[] for _ in sizes], np.zeros(len(sizes), np.int64), 0
    for pattern, times in patterns:
        for i in np.flatnonzero(pattern):
            firsts[i].append(int(taken[i]))
            each[i].append(int(pattern[i]))
            bases[i].append(base)
        taken += pattern * times
        base += times
    fields = pieces.columns

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = np.zeros(len(sizes), np.int64), TaskContext.get().partitionId()
        for batch in batches:
            kind = np.searchsorted(edges, batch["length"].to_numpy())
            order = np.argsort(kind, kind="stable")
            starts = np.searchsorted(kind[order], np.arange(len(sizes)))
            rank = np.empty(len(kind), np.int64)
            rank[order] = np.arange(len(kind)) - starts[kind[order]] + seen[kind[order]]
            seen += np.bincount(kind, minlength=len(sizes))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(kind), part, np.int32)), pa.array(kind.astype(np.int32)), pa.array(rank)], names=[*fields, "__part", "__class", "__rank"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    ranked = materialize(pieces.mapInArrow(rank, f"{types}, __part int, __class int, __rank long"), "ranked")
    held = ranked.groupBy("__part", "__class").agg(F.count(F.lit(1)).alias("__n"))
    before = held.select("__part", "__class", (F.sum("__n").over(Window.partitionBy("__class").orderBy("__part")) - F.col("__n")).alias("__before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = [np.array(f, np.int64) for f in firsts]
        n, first = [np.array(e, np.int64) for e in each], [np.array(b, np.int64) for b in bases]
        for batch in batches:
            kind, at = batch["__class"].to_numpy(), batch["__rank"].to_numpy() + batch["__before"].to_numpy()
            sequence, slot = np.empty(len(kind), np.int64), np.empty(len(kind), np.int64)
            for i in np.unique(kind):
                own = kind == i
                k = np.searchsorted(starts[i], at[own], "right") - 1
                within = at[own] - starts[i][k]
                sequence[own], slot[own] = first[i][k] + within // n[i][k], within % n[i][k]
            yield pa.RecordBatch.from_arrays([*(batch[f] for f in fields), pa.array(sequence), pa.array(kind), pa.array(slot)], names=[*fields, "sequence_id", "__class", "__slot"])

    placed = ranked.join(before, ["__part", "__class"]).select(*fields, "__class", "__rank", "__before").mapInArrow(place, f"{types}, sequence_id long, __class int, __slot long")
    order = Window.partitionBy("sequence_id").orderBy(F.desc("__class"), "__slot")  # a sequence has capacity pieces at most
    return placed.select(*fields, "sequence_id", (F.sum("length").over(order) - F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, definition: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut and pack documents: a row per piece."""
    return pack(materialize(cut(docs, definition, capacity, end_id, id_col, text_col), "pieces"), capacity)
