"""Documents as blocks of word numbers, and a word table dealt by hash, for work that is done once per distinct word.

A block holds the documents of up to ``block_bytes`` of text, each as positions in a dictionary. Blocks that one task writes one after
another share a dictionary (up to ``share`` blocks, or DICTIONARY words): they are a group. Groups are written once, to a table bucketed
by group, so nothing depends on a scan being repeated in the same order and a lost executor costs a reread. The word table is made by
dealing each dictionary to hash buckets, packed: a word that every document holds is sent once a group, not once an occurrence, so
there is no hot key. What a bucket answers for its words goes back to the groups, whose own rows stay where they are.

Traffic: a group sends each of its distinct words once, in a message for each bucket that gets any. The number of buckets follows the
measured size of all dictionaries, which grow slower than the text, and is the number of shuffle partitions up to BUCKET_BYTES a bucket.

Memory: a task holds one group, or what one bucket gets (BUCKET_BYTES, packed). The tables are left to the cluster's clean-up, as results
are lazy and read them; common.drop_tables() takes those of this process out of the catalog.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestone.llm.common import input_bytes, own_table, partitions, shared_dir

BLOCK_BYTES = 16 << 20
BLOCK_WORDS = 4 << 20
#: Blocks, and distinct words, to a group at most (the last document may bring more words).
SHARE = 8
DICTIONARY = 1 << 19
#: Packed bytes that a bucket of the word table gets, about.
BUCKET_BYTES = 32 << 20
#: Text bytes, as stored, to a bucket of the table of blocks.
TABLE_BYTES = 128 << 20
#: Dictionary words below which a bucket isn't worth a task.
_FEW = 4096


def pack(array: np.ndarray) -> bytes:
    """Integers by planes of bytes, compressed; the first byte is the width, 8 bytes of length follow."""
    width = array.dtype.itemsize
    planes = np.ascontiguousarray(array).view(np.uint8).reshape(-1, width).T
    return bytes([width]) + len(array).to_bytes(8, "little") + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    raw = zstandard.ZstdDecompressor().decompress(data[9:], max_output_size=max(1, width * n))
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).reshape(-1).view(dtype)


def pack_words(words: list[bytes]) -> bytes:
    return len(words).to_bytes(8, "little") + zstandard.ZstdCompressor(level=3).compress(b" ".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    if not int.from_bytes(data[:8], "little"):
        return []
    return zstandard.ZstdDecompressor().decompressobj().decompress(data[8:]).split(b" ")


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in words), np.uint32, len(words))


def spans(hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of sorted hashes: buckets are ranges of hashes; those that get nothing are left out."""
    edges = np.searchsorted(hashes, [-(-(b << 32) // buckets) for b in range(buckets)] + [1 << 32])
    return [(b, int(s), int(e)) for b, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if e > s]


class _Builder:
    """The blocks of one group in the making."""

    def __init__(self, group: int):
        self.group, self.blocks = group, 0
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.counts = np.empty(0, np.int64)
        self.clear()

    def clear(self) -> None:
        self.ids, self.nulls, self.marks, self.lengths, self.positions, self.size, self.n = [], [], [], [], [], 0, 0

    def add(self, doc_id: int | None, mark: int, text: bytes) -> None:
        words = text.split()  # of bytes: exactly the white space of the contract
        self.positions.append(np.fromiter(map(self.number.__getitem__, words), np.uint32, len(words)))
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.marks.append(mark)
        self.lengths.append(len(words))
        self.size += len(text)
        self.n += len(words)

    def row(self, last: bool) -> dict:
        """The next block; the last one of a group carries the dictionary. There words stand by hash, then in order; place holds where
        each word number stands, counts how often each word occurs in the group's documents with a mark."""
        positions, lengths = np.concatenate([np.empty(0, np.uint32), *self.positions]), np.array(self.lengths, np.int64)
        held = np.bincount(positions[np.repeat(np.array(self.marks, bool), lengths)], minlength=len(self.number)) if len(positions) else np.zeros(len(self.number), np.int64)
        held[: len(self.counts)] += self.counts
        self.counts = held
        out = {
            "group": self.group,
            "block": self.group + self.blocks,
            "tokens": self.n,
            "ids": pack(np.array(self.ids, np.int64)),
            "nulls": pack(np.array(self.nulls, np.uint8)),
            "marks": pack(np.array(self.marks, np.uint8)),
            "lengths": pack(lengths.astype(np.uint32)),
            "positions": pack(positions),
        }
        self.blocks += 1
        self.clear()
        if last:
            words = list(self.number)
            self.number = {}
            order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
            order = order[np.argsort(word_hashes(words)[order], kind="stable")] if len(words) else order
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            packed = pack_words([words[i] for i in order])
            out |= {"words": packed, "place": pack(place), "counts": pack(self.counts[order]), "n_words": len(words), "packed": len(packed)}
        return out


_ARROW = pa.schema([
    ("group", pa.int64()), ("block", pa.int64()), ("tokens", pa.int64()), *((c, pa.binary()) for c in ("ids", "nulls", "marks", "lengths", "positions", "words", "place", "counts")),
    ("n_words", pa.int64()), ("packed", pa.int64()),
])
_BLOCK = ", ".join(f"`{f.name}` {'long' if f.type == pa.int64() else 'binary'}" for f in _ARROW)


class Blocks:
    """Documents written as blocks."""

    def __init__(self, table: DataFrame):
        self.table = table
        found = table.agg(F.count("n_words"), F.sum("n_words"), F.sum("packed"), F.sum("tokens")).first()
        self.groups, self.words, self.packed, self.tokens = (int(x or 0) for x in found)
        most = max(1, self.words // _FEW)
        self.buckets = max(1, min(partitions(table), most), -(-self.packed // BUCKET_BYTES))

    def answers(self, solve: Callable[[list[bytes], np.ndarray], Callable[[np.ndarray], bytes]], with_counts: bool = False) -> DataFrame:
        """Solve the word table: (group, bucket, answer). ``solve`` gets a bucket's distinct words (and, with counts, how
        often each occurs over all groups in documents with a mark) and returns what packs the answer for a list of them."""
        buckets = self.buckets

        def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    words = unpack_words(row["words"])
                    counts = unpack(row["counts"], np.int64) if with_counts else np.empty(0, np.int64)
                    packed = [(b, row["group"], pack_words(words[s:e]), pack(counts[s:e])) for b, s, e in spans(word_hashes(words), buckets)]
                    yield pa.RecordBatch.from_pylist([dict(zip(_REQUEST.names, r, strict=True)) for r in packed], schema=_REQUEST)

        def answer(table: pa.Table) -> pa.Table:
            number: dict[bytes, int] = defaultdict(count().__next__)
            asked = [np.fromiter(map(number.__getitem__, unpack_words(w.as_py())), np.int64) for w in table["words"]]
            totals = np.zeros(len(number), np.int64)
            if with_counts:
                for at, n in zip(asked, table["counts"], strict=True):
                    totals[at] += unpack(n.as_py(), np.int64)
            reply = solve(list(number), totals)
            return pa.table({"group": table["group"], "bucket": table["bucket"], "answer": pa.array([reply(at) for at in asked], pa.binary())})

        dictionaries = self.table.where("words IS NOT NULL").select("group", "words", "counts")
        dealt = dictionaries.mapInArrow(requests, "bucket int, group long, words binary, counts binary")
        return dealt.groupBy("bucket").applyInArrow(answer, "group long, bucket int, answer binary")

    def resolve(self, answers: DataFrame, prepare: Callable, read: Callable, schema: str) -> DataFrame:
        """Bring the answers, (group, bucket, ...), to their groups. ``prepare`` gets the dictionary's row and its answers as a table in
        order of buckets; ``read`` gets each block's row and what prepare made, and yields record batches."""

        empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

        def join(blocks: pa.Table, found: pa.Table) -> pa.Table:
            if not blocks.num_rows:
                return empty
            own = found.take(np.argsort(found["bucket"].to_numpy(), kind="stable")) if found.num_rows else found
            holder = next(i for i, x in enumerate(blocks["words"]) if x.is_valid)
            made, out = prepare(blocks.slice(holder, 1).to_pylist()[0], own), []
            for i in range(blocks.num_rows):
                out += read(blocks.slice(i, 1).to_pylist()[0], made)
            return pa.Table.from_batches(out) if out else empty

        return self.table.groupBy("group").cogroup(answers.groupBy("group")).applyInArrow(join, schema)


_REQUEST = pa.schema([("bucket", pa.int32()), ("group", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])


def _murmur(value: int) -> int:
    """The hash by which a table is bucketed, of a long: 32-bit Murmur3 with seed 42 (a fixed rule of the format)."""
    h = 42
    for k in (value & 0xFFFFFFFF, value >> 32 & 0xFFFFFFFF):
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
        h ^= k
        h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= 8
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def group_id(part: int, k: int, buckets: int) -> int:
    """Number of a partition's k-th group. Its lowest free bits are chosen so that groups spread evenly over the buckets: hashes alone
    would give one bucket several of a few hundred groups. The lowest byte is left to the blocks."""
    want = int((part * 0.6180339887498949 + k * 0.7548776662466927) % 1.0 * buckets)
    base = part << 40 | k << 24
    return next((x for x in range(base, base + (1 << 24), 256) if _murmur(x) % buckets == want), base)


def write_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark=None, lower: bool = False, block_bytes: int = BLOCK_BYTES, share: int = SHARE) -> Blocks:
    """Write the documents as blocks. mark: a small non-negative integer column for each document; lower: A-Z in lower case."""
    spark = docs.sparkSession
    buckets = max(8, partitions(docs), min(1 << 16, input_bytes(docs, text_col) // TABLE_BYTES))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (mark if mark is not None else F.lit(0)).cast("int").alias("mark"), text.cast("binary").alias("text"))
    share = min(share, 255)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), count()
        builder = _Builder(group_id(part, next(made), buckets))
        for batch in batches:
            for doc_id, mark, text in zip(batch["id"], batch["mark"], batch["text"], strict=True):
                data = text.as_py()
                builder.add(doc_id.as_py(), mark.as_py(), data.lower() if lower else data)
                if builder.size >= block_bytes or builder.n >= BLOCK_WORDS or len(builder.number) >= DICTIONARY:
                    last = builder.blocks + 1 >= share or len(builder.number) >= DICTIONARY
                    yield pa.RecordBatch.from_pylist([builder.row(last)], schema=_ARROW)
                    if last:
                        builder = _Builder(group_id(part, next(made), buckets))
        if builder.ids or builder.blocks:
            yield pa.RecordBatch.from_pylist([builder.row(True)], schema=_ARROW)

    name = own_table(f"blocks_{uuid.uuid4().hex}")
    rows.mapInArrow(build, _BLOCK).write.format("parquet").bucketBy(buckets, "group").option("path", f"{shared_dir(spark)}/{name}").option("compression", "none").saveAsTable(name)
    return Blocks(spark.table(name))
