"""Similarity join on n-gram sets: a prefix-tree join within groups that a prefix filter has proven to be closed.

1. Documents are written as blocks of word numbers. The distinct n-grams of each block are counted over the whole input, in
   packed form, which gives the global order: rare n-grams first, ties by hash.
2. Two sets that reach the threshold share one of their first ``n - ceil(t n) + 1`` n-grams in that order. What stands in one
   document only can't be shared, so only documents whose first n-grams are common send any, and only these. Sets that share one, and
   whose sizes allow the threshold, are tied; the components of these ties are closed under links.
3. Each component's sets are joined in a prefix tree (frequent n-grams first, so that near copies share long paths), traversed with
   partial overlaps; a subtree is left when the remaining lengths can't reach the threshold, or when all its sets are in the
   component already. A set is made again from its block when its component is known, and sent once, straight to its task. A
   component that is too large for a task is cut by sizes into bands, as sets link within a band or to the next one only, and
   bands into parts; parts that can link meet in pairs.
4. The links found (a forest for each task) and equal sets give the components of documents. Sets are named by their smallest id, so
   the least name of a component is its result, and nothing is joined by component.

Equal sets are one node, so copies aren't expanded; a common n-gram makes a chain of ties, not pairs, and is chained within each batch before it is sent. Hashes of n-grams have 56
bits and sets are told apart by 128 bits of their content: at a billion sets the chance of one wrong merger is below 1e-20.

Defined results: texts that are null, empty or blank have no n-grams and link with nothing, not with each other; texts with fewer words
than n have one n-gram; texts of any length are whole; repeated rows are rows of one set, so they link; the component of a
document with a null id is that of its set, and null if no other id is in it; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.blocks import Blocks, pack, unpack, unpack_words, write_blocks
from lodestone.llm.common import materialize, partitions
from lodestone.llm.graph import components

WORDS = 5
#: Similarity in hundredths: linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
BLOCK_BYTES = 16 << 20
#: N-grams that one task of the tree join holds, about.
TASK_GRAMS = 2 << 20
#: N-grams, and bytes of first n-grams, that one bucket gets, about.
BUCKET_GRAMS = 8 << 20
HEAD_BYTES = 32 << 20
_BITS = 56
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(hashes: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Distinct n-gram hashes, in order, of a text given as its words' hashes."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    width = min(n, len(hashes))
    total = np.zeros(len(hashes) - width + 1, np.uint64)
    for k in range(width):
        total = _mixed(total * _MIX + hashes[k : k + len(total)] + np.uint64(width))
    return np.unique(total >> np.uint64(64 - _BITS))


class _Texts:
    """A block's documents as sets."""

    def __init__(self, row: dict, n: int):
        self.n, words = n, unpack_words(row["words"])
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        self.hashes = hashes[unpack(row["place"], np.uint32)] if len(words) else hashes
        self.positions, self.ends = unpack(row["positions"], np.uint32), np.cumsum(unpack(row["lengths"], np.uint32), dtype=np.int64)
        self.ids = [None if z else i for i, z in zip(unpack(row["ids"], np.int64).tolist(), unpack(row["nulls"], np.uint8).tolist(), strict=True)]

    def set(self, k: int) -> np.ndarray:
        return grams(self.hashes[self.positions[self.ends[k - 1] if k else 0 : self.ends[k]]], self.n)


def sets_of(row: dict, n: int) -> tuple[list, list[np.ndarray], list[bytes], np.ndarray]:
    """Of a block: document ids, their sets, the sets' digests, and which documents are the first of their set."""
    texts = _Texts(row, n)
    sets, digests, seen, first = [], [], set(), np.zeros(len(texts.ids), bool)
    for k in range(len(texts.ids)):
        own = texts.set(k)
        digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
        first[k] = digest not in seen
        seen.add(digest)
        sets.append(own)
        digests.append(digest)
    return texts.ids, sets, digests, first


def _together(sets: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *(s for s, f in zip(sets, first, strict=True) if f)])


#: Rarity has a byte: counts up to this one are exact, larger ones go by quarters of a power of two.
_EXACT = 191


def rarity(holders: np.ndarray) -> np.ndarray:
    return np.where(holders <= _EXACT, holders, np.minimum(255, _EXACT + 1 + 4 * np.log2(np.maximum(holders, 1) / _EXACT)).astype(np.int64)).astype(np.uint8)


def _document_frequencies(blocks: Blocks, n: int, buckets: int, bits: int) -> DataFrame:
    """(group, bucket, answer): for each block's distinct n-grams in order, the rarity of each: in how many distinct sets of a block it stands.

    Only the leading bits of a hash are sent, as differences. Two n-grams may so count together; the order stays one function of the hash.
    """
    drop, share = np.uint64(_BITS - bits), np.uint64(-(-(1 << bits) // buckets))

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                _, sets, _, first = sets_of(row, n)
                key, holders = np.unique(_together(sets, first) >> drop, return_counts=True)
                edges = np.searchsorted(key, np.arange(buckets, dtype=np.uint64) * share)
                rows = []
                for b, (start, end) in enumerate(zip(edges, [*edges[1:], len(key)], strict=True)):
                    if end > start:
                        steps = np.diff(key[start:end], prepend=np.uint64(b) * share)
                        rows.append({"bucket": b, "group": row["group"], "steps": pack(steps.astype(np.uint32 if steps.max() < 1 << 32 else np.uint64)), "counts": pack(np.minimum(holders[start:end], 65535).astype(np.uint16))})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("bucket", pa.int32()), ("group", pa.int64()), ("steps", pa.binary()), ("counts", pa.binary())])

    def answer(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack(s.as_py(), np.uint32 if s.as_py()[0] == 4 else np.uint64), dtype=np.uint64) for s in table["steps"]]
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([unpack(c.as_py(), np.uint16) for c in table["counts"]]), minlength=len(every))
        found, ends = rarity(total)[inverse], np.cumsum([len(k) for k in keys])
        return pa.table({"group": table["group"], "bucket": table["bucket"], "answer": pa.array([pack(x) for x in np.split(found, ends[:-1])], pa.binary())})

    asked = blocks.table.select("group", "words", "place", "ids", "nulls", "lengths", "positions").mapInArrow(requests, "bucket int, group long, steps binary, counts binary")
    return asked.groupBy("bucket").applyInArrow(answer, "group long, bucket int, answer binary")


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Blocks:
    return write_blocks(docs, id_col, text_col, lower=True, block_bytes=block_bytes, share=1)  # a block is a group


def ordered_sets(blocks: Blocks, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n, digest, group, at, head) of every document, ``at`` its place in its block. head: those of the set's first n-grams in global
    order (rarity in the top byte, then hash) that stand in other sets too; null where there are none, as no other set can link then."""
    bits = min(_BITS, max(24, blocks.tokens.bit_length() + 5))
    buckets = max(partitions(blocks.table), -(-blocks.tokens // BUCKET_GRAMS))
    answers = _document_frequencies(blocks, n, buckets, bits)
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("group", pa.int64()), ("at", pa.int32()), ("head", pa.binary())])

    def read(row: dict, found: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, sets, digests, first = sets_of(row, n)
        every = np.unique(_together(sets, first) >> np.uint64(_BITS - bits))
        rare = np.concatenate([np.empty(0, np.uint8), *(unpack(a, np.uint8) for a in found)]).astype(np.uint64) << np.uint64(_BITS)
        rows = []
        for k, (doc_id, own, digest, f) in enumerate(zip(ids, sets, digests, first, strict=True)):
            head = None
            if f and len(own):
                order = own | rare[np.searchsorted(every, own >> np.uint64(_BITS - bits))]
                most = len(own) - -(-percent * len(own) // 100) + 1
                if np.count_nonzero(order < np.uint64(2 << _BITS)) < most:
                    order = np.sort(np.partition(order, most - 1)[:most])
                    head = order[np.searchsorted(order, np.uint64(2 << _BITS)) :].tobytes()
            rows.append((doc_id, len(own), digest, row["group"], k, head))
        for start in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[start : start + 4096], strict=True), schema, strict=True)], schema=schema)

    made = blocks.resolve(answers, lambda _, found: found["answer"].to_pylist(), read, "id long, n long, digest binary, group long, at int, head binary")
    return materialize(made, "sets")


def ties(suspects: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(a, b) digests: sets that share one of their first n-grams, and whose sizes allow a link, or stand between such. suspects: (digest, n, head), one
    row per set or more.

    A batch chains its own holders of an n-gram by size and sends a run of them as one interval of sizes, so what a bucket
    gets of an n-gram grows with the batches, not with its holders; intervals that touch are tied there.
    """
    columns = ("keys", "holder", "low", "high", "digests", "ties")
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in columns)])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [np.frombuffer(h.as_py(), np.uint64) for h in batch["head"]]
            if not heads:
                continue
            keys, owner = np.concatenate(heads), np.repeat(np.arange(len(heads)), [len(h) for h in heads])
            digests, n = batch["digest"].to_pylist(), batch["n"].to_numpy()
            order = np.lexsort((n[owner], keys))
            keys, owner, size = keys[order], owner[order], n[owner[order]]
            near = (keys[1:] == keys[:-1]) & (100 * size[:-1] >= percent * size[1:])
            found = Forest(len(heads))
            for x, y in np.unique(np.stack([owner[:-1][near], owner[1:][near]]), axis=1).T.tolist() if near.any() else ():
                found.union(x, y)
            stars = _stars(digests, found)
            first = np.flatnonzero(np.append(True, ~near))
            last = np.append(first[1:], len(keys)) - 1
            bucket = (_mixed(keys[first]) % np.uint64(buckets)).astype(np.int32)
            rows = []
            for b in np.unique(bucket).tolist():
                take = bucket == b
                own, at = np.unique(owner[first[take]], return_inverse=True)
                rows.append({"bucket": b, "keys": keys[first[take]].tobytes(), "holder": pack(at.astype(np.uint32)), "low": pack(size[first[take]].astype(np.uint32)), "high": pack(size[last[take]].astype(np.uint32)), "digests": b"".join(digests[i] for i in own), "ties": b""})
            rows[0]["ties"] = b"".join(x + y for x, y in zip(stars["a"].to_pylist(), stars["b"].to_pylist(), strict=True))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def tie(table: pa.Table) -> pa.Table:
        number: dict[bytes, int] = defaultdict(count().__next__)
        parts: list[list[np.ndarray]] = []
        pairs: list[tuple[int, int]] = []
        for row in table.to_pylist():
            names = [number[row["digests"][i : i + 16]] for i in range(0, len(row["digests"]), 16)]
            parts.append([np.frombuffer(row["keys"], np.uint64), np.array(names, np.int64)[unpack(row["holder"], np.uint32)], unpack(row["low"], np.uint32).astype(np.int64), unpack(row["high"], np.uint32).astype(np.int64)])
            pairs += [(number[row["ties"][i : i + 16]], number[row["ties"][i + 16 : i + 32]]) for i in range(0, len(row["ties"]), 32)]
        key, holder, low, high = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((low, key))
        key, holder, low, high = key[order], holder[order], low[order], high[order]
        same = key[1:] == key[:-1]
        rank = np.cumsum(np.append(0, ~same)).astype(np.int64) << 32
        reach = (np.maximum.accumulate(rank | high) - rank)[:-1]  # the largest size so far among the n-gram's holders
        near = same & (100 * reach >= percent * low[1:])
        pairs += np.unique(np.stack([holder[:-1][near], holder[1:][near]]), axis=1).T.tolist() if near.any() else []
        found = Forest(len(number))
        for x, y in pairs:
            found.union(x, y)
        return _stars(list(number), found)

    sent = suspects.mapInArrow(send, "bucket int, " + ", ".join(f"{c} binary" for c in columns))
    return sent.groupBy("bucket").applyInArrow(tie, "a binary, b binary")


class Forest:
    """Union-find."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = a = self.up[self.up[a]]
        return a

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _stars(names: list[bytes], forest: Forest) -> pa.Table:
    """(a, b): every member of a component of two or more with the component's least name: paths stay short for what follows."""
    roots = [forest.find(i) for i in range(len(names))]
    least: dict[int, bytes] = {}
    for name, root in zip(names, roots, strict=True):
        least[root] = min(name, least.get(root, name))
    out = [(name, least[root]) for name, root in zip(names, roots, strict=True) if name != least[root]]
    return pa.table({"a": pa.array([x[0] for x in out], pa.binary()), "b": pa.array([x[1] for x in out], pa.binary())})


class _Node:
    __slots__ = ("segment", "children", "sets", "low", "high", "most", "depth", "any", "one")

    def __init__(self, segment: np.ndarray, depth: int, size: int, most: int, member: int):
        self.segment, self.depth = segment, depth  # depth: n-grams on the path, this segment included
        self.children: dict[int, _Node] = {}
        self.sets: list[tuple[int, int]] = []  # (set, its size)
        self.low = self.high = size
        self.most = most  # the longest path of the subtree
        self.any, self.one = member, True  # a member of the subtree; whether all are in its component


class PrefixTree:
    """Sets as sorted arrays of numbers, in a tree of shared prefixes. A set's size may be more than its array's: the rest is in no other set."""

    def __init__(self, percent: int, universe: int, forest: Forest):
        self.percent, self.forest, self.mark = percent, forest, np.zeros(universe, bool)
        self.root = _Node(np.empty(0, np.int64), 0, 1 << 60, 0, -1)
        self.root.high = 0

    def insert(self, member: int, x: np.ndarray, size: int) -> None:
        node, at = self.root, 0
        while True:
            node.low, node.high, node.most = min(node.low, size), max(node.high, size), max(node.most, len(x))
            node.one = node.one and (node.any < 0 or self.forest.find(node.any) == self.forest.find(member))
            node.any = member if node.any < 0 else node.any
            if at == len(x):
                node.sets.append((member, size))
                return
            child = node.children.get(int(x[at]))
            if child is None:
                leaf = _Node(x[at:], len(x), size, len(x), member)
                leaf.sets.append((member, size))
                node.children[int(x[at])] = leaf
                return
            k = min(len(child.segment), len(x) - at)
            same = child.segment[:k] == x[at : at + k]
            shared = k if same.all() else int(np.argmin(same))
            if shared < len(child.segment):  # the child is split where the paths part
                top = _Node(child.segment[:shared], node.depth + shared, child.low, child.most, child.any)
                top.high, top.one = child.high, child.one
                child.segment = child.segment[shared:]
                top.children[int(child.segment[0])] = child
                node.children[int(x[at])] = top
                child = top
            node, at = child, at + shared

    def link(self, member: int, x: np.ndarray, n: int, found: list[tuple[int, int]]) -> None:
        """Join a set of size n with those in the tree: at least one link to every component that it links to."""
        mark, forest, t = self.mark, self.forest, self.percent
        mark[x] = True
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            if node.any < 0 or (node.one and forest.find(node.any) == forest.find(member)):
                continue
            if len(node.segment):
                overlap += int(np.count_nonzero(mark[node.segment]))
            last = node.segment[-1] if len(node.segment) else -1
            rest = len(x) - int(np.searchsorted(x, last, "right"))
            # A set of size m in the subtree, with a path of c <= min(m, most), shares at most overlap + min(rest, c - depth), and
            # needs t (n + m) / (100 + t).
            high = min(node.high, 100 * n // t)
            low = max(node.low, -(-t * n // 100))
            if low > high or (100 + t) * (overlap + min(rest, node.most - node.depth)) < t * (n + low):
                continue
            best = max(low, min(high, node.most))
            if (100 + t) * (overlap + min(node.most, best) - node.depth) < t * (n + best):
                continue
            for other, m in node.sets:
                if forest.find(other) != forest.find(member) and (100 + t) * overlap >= t * (n + m):
                    forest.union(other, member)
                    found.append((other, member))
            # The child that goes on as the set does comes first: once linked, its whole component is passed over.
            stack += sorted(((c, overlap) for c in node.children.values()), key=lambda p: mark[p[0].segment[0]])
        mark[x] = False


def tree_join(sets: list[np.ndarray], percent: int = PERCENT, sizes: list[int] | None = None) -> list[tuple[int, int]]:
    """Links among sets (sorted arrays of keys): a spanning forest of all that reach the threshold. sizes: of the whole sets,
    where keys that no other set has were left out."""
    if len(sets) < 2:
        return []
    sizes = sizes or [len(s) for s in sets]
    keys, number, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(keys), np.int64)
    rank[np.lexsort((keys, -holders))] = np.arange(len(keys))
    shared = np.count_nonzero(holders > 1)  # the others, last in rank, can't add to an overlap
    own = [np.sort(x[x < shared]) for x in np.split(rank[number], np.cumsum([len(s) for s in sets])[:-1])]
    forest, found = Forest(len(sets)), []
    tree = PrefixTree(percent, shared, forest)
    for i in sorted(range(len(sets)), key=lambda i: sizes[i]):
        tree.link(i, own[i], sizes[i], found)
        tree.insert(i, own[i], sizes[i])
    return found


def band(n: int, percent: int) -> int:
    """Sets that link are in one band or in neighbouring ones."""
    return int(np.log(n) / -np.log(percent / 100) + 1e-9) if percent < 100 else n


def meetings(n: int, digest: bytes, bands: dict[int, int] | None, percent: int) -> list[tuple[int, int]]:
    """The tasks, as pairs of parts, that a set takes part in. bands: the parts of each of its component's bands; None: all in one task."""
    if bands is None:
        return [(0, 0)]
    own = band(n, percent)
    part = own << 20 | int.from_bytes(digest[:6], "little") % bands[own]
    others = [b << 20 | k for b in (own - 1, own, own + 1) for k in range(bands.get(b, 0)) if b << 20 | k != part]
    return [(min(part, x), max(part, x)) for x in others] or [(part, part)]


#: A set's name: whether its id is null, the id (so that names sort as ids), the digest.
_NAME = "concat(IF(id IS NULL, X'01', X'00'), unhex(lpad(hex(coalesce(id, 0) ^ (-9223372036854775807L - 1L)), 16, '0')), digest)"
_ID_OF = "IF(substring({0}, 1, 1) = X'01', NULL, CAST(CAST(conv(hex(substring({0}, 2, 8)), 16, 10) AS DECIMAL(20, 0)) - CAST('9223372036854775808' AS DECIMAL(20, 0)) AS BIGINT))"
_DIGEST_OF = "substring({0}, 10, 16)"


def _joined(blocks: Blocks, owned: DataFrame, groups: DataFrame, n: int, percent: int, task_grams: int) -> DataFrame:
    """(a, b) names of sets that link, a forest for each task. owned: (digest, id, group, at, n); groups: (node, root) of what is tied."""
    named = owned.select("digest", F.col("group"), "at", "n", F.expr(_NAME).alias("name"))
    tied = materialize(named.join(groups, named["digest"] == groups["node"]).select("group", "at", "n", "name", "root"), "tied")
    if percent < 100:
        of = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(-np.log(percent / 100))) + 1e-9).cast("int")
    else:
        of = F.col("n").cast("int")
    # A component has a band for each third that sizes grow by, at most, so its bands are a short list. Small ones go whole.
    bands = tied.groupBy("root", of.alias("band")).agg(F.sum("n").alias("size"))
    parts = F.struct("band", F.ceil(F.col("size") * 2 / task_grams).cast("int").alias("parts"))
    large = bands.groupBy("root").agg(F.sum("size").alias("size"), F.collect_list(parts).alias("bands")).where(F.col("size") > task_grams).select("root", "bands")
    tied = tied.join(materialize(large, "large"), "root", "left")  # written, so that members of one component can be split
    schema = pa.schema([("root", pa.binary()), ("p", pa.int64()), ("q", pa.int64()), ("name", pa.binary()), ("set", pa.binary())])

    def send(row: dict, wanted: list[dict]) -> Iterator[pa.RecordBatch]:
        if not wanted:
            return
        texts, rows = _Texts(row, n), []
        for x in wanted:
            own = texts.set(x["at"])
            packed = pack(np.diff(own, prepend=np.uint64(0)))
            known = None if x["bands"] is None else {b["band"]: b["parts"] for b in x["bands"]}
            rows += [(x["root"], p, q, x["name"], packed) for p, q in meetings(len(own), x["name"][9:], known, percent)]
        for start in range(0, len(rows), 1024):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[start : start + 1024], strict=True), schema, strict=True)], schema=schema)

    def run(table: pa.Table) -> pa.Table:
        names = table["name"].to_pylist()
        found = Forest(len(names))
        for a, b in tree_join([np.cumsum(unpack(k.as_py(), np.uint64), dtype=np.uint64) for k in table["set"]], percent):
            found.union(a, b)
        return _stars(names, found)

    asked = tied.select("group", F.lit(0).alias("bucket"), "at", "root", "name", "bands")
    dealt = blocks.resolve(asked, lambda _, found: found.to_pylist(), send, "root binary, p long, q long, name binary, set binary")
    return dealt.groupBy("root", "p", "q").applyInArrow(run, "a binary, b binary")


def _owned(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, block_bytes: int = BLOCK_BYTES, task_grams: int = TASK_GRAMS) -> tuple[DataFrame, DataFrame]:
    """(id, n, digest, ...) of every document, and (digest, id, root) of every set that isn't empty: its smallest id, and the name of its
    component's least set, which is null where it has no links."""
    blocks = _blocks(docs, id_col, text_col, block_bytes)
    sets = ordered_sets(blocks, n, percent)
    sent = sets.where("head IS NOT NULL").select("digest", "n", "head")
    buckets = max(partitions(docs), 8, -(-(sent.agg(F.sum(F.octet_length("head").cast("long"))).first()[0] or 0) // HEAD_BYTES))
    groups = materialize(components(ties(sent, percent, buckets)), "groups")
    place = F.when(F.col("head").isNotNull(), F.struct("group", "at"))
    owned = sets.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.min(place).alias("place"), F.first("n").alias("n"))
    owned = materialize(owned.select("digest", "id", "place.group", "place.at", "n"), "owned")
    linked = components(_joined(blocks, owned, groups, n, percent, task_grams))
    linked = linked.select(F.expr(_DIGEST_OF.format("node")).alias("digest"), "root")
    return sets, materialize(owned.join(linked, "digest", "left").select("digest", "id", "root"), "linked")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES, task_grams: int = TASK_GRAMS) -> DataFrame:
    """(id, n_shingles, component_id) of every document; component_id: the smallest id that can be reached by links."""
    sets, owned = _owned(docs, id_col, text_col, n, percent, block_bytes, task_grams)
    named = owned.select("digest", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.expr(_ID_OF.format("root"))).alias("component_id"))
    out = sets.select("id", F.col("n").alias("n_shingles"), "digest")
    full = out.where("n_shingles > 0").join(named, "digest").select("id", "n_shingles", "component_id")
    return full.unionByName(out.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id")))


def set_digest(text: bytes, n: int = WORDS) -> bytes | None:
    """The digest of a text's set, as sets_of has it; None where the set is empty."""
    words = text.lower().split()
    own = grams(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words)), n)
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all its columns: one with the smallest id (null ids last), and of several sets under that id the one
    with the smallest digest. Rows without n-grams all stay."""
    sets, owned = _owned(docs, id_col, text_col, n, percent)
    least = owned.where(F.col("root").isNull() | (F.expr(_DIGEST_OF.format("root")) == F.col("digest")))
    kept = materialize(least.select(F.col("digest").alias("__digest"), F.col("id").alias("kept_id")), "kept")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__text"))
    members = sets.where("n > 0 AND id IS NOT NULL").select(F.col("id").alias("__id"), F.col("digest").alias("__digest")).join(kept, "__digest", "left")
    dropped = members.where("kept_id IS NULL OR kept_id <> __id").select("__id").distinct()
    # An id names its row unless other rows have it too, or it is null: these rows are told apart by their sets.
    shared = materialize(sets.groupBy("id").count().where("count > 1 OR id IS NULL").select(F.col("id").alias("__id")), "shared")
    if shared.isEmpty():
        return rows.join(dropped, "__id", "left_anti").select("row.*")
    named = shared.where("__id IS NOT NULL")
    sure = rows.where("__id IS NOT NULL").join(dropped.unionByName(named), "__id", "left_anti")
    digests = F.arrow_udf(lambda texts: pa.array([set_digest(t.as_py(), n) for t in texts], pa.binary()), "binary")
    unsure = rows.where("__id IS NULL").unionByName(rows.join(named, "__id", "left_semi")).withColumn("__digest", digests("__text"))
    one = unsure.join(kept, "__digest").where(F.col("__id").eqNullSafe(F.col("kept_id"))).dropDuplicates(["__digest"])
    return sure.select("row").unionByName(unsure.where("__digest IS NULL").select("row")).unionByName(one.select("row")).select("row.*")
