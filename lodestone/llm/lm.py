"""Language-model scores of whole documents: a causal self-attention model over subword ids.

All counts (words, subwords, documents) are exact over all training documents, from the table of distinct words. Windows tile the training
documents, so each token is a target once; from them come the subwords' profiles (see attention), by partition sums, and then the
weights: in each of ROUNDS rounds partitions train from common weights on the next share of their windows, in one pass, and their weights are
averaged in a tree. Only a partition with fewer than MIN_STEPS steps to make goes over its share again, until it has made so many. Scoring goes
over overlapping windows, each token once.

A document's score is the sum over its tokens, the end of the text included, of the model's log probability; a word's is the product over its
subwords, with what stands before as context. A word that has no subwords counts by its smoothed frequency.

Defined results: a null text counts as the empty text, which is the end token alone; texts of any length are whole; repeated rows
are scored, and counted, row by row; a null id counts as the empty text when folds are drawn; without training documents the
frequencies are uniform and the attention model is as it begins; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import attention
from lodestone.llm.blocks import Blocks, pack, unpack, write_blocks
from lodestone.llm.bpe import load, spread, word_ids
from lodestone.llm.common import fold, materialize
from lodestone.llm.sums import dense, partition_sums, sparse, tree_sum

ROUNDS = 4
#: Windows to a step.
BATCH = 256
#: Windows that one partition trains on in a round, about, and holds at once at most.
PART_WINDOWS = 65536
#: Windows that travel in one row.
RUN_WINDOWS = 1024
MIN_STEPS = 200
RATE = 0.01
CHUNK_WORDS = 1 << 17


def _answers(blocks: Blocks, definition: str, size: int) -> DataFrame:
    """For each word asked for: its count in training text and its ids. A bucket's first answer also holds its sums."""

    def solve(words: list[bytes], totals: np.ndarray) -> Callable[[np.ndarray], bytes]:
        flat, lengths = word_ids(definition, words)
        lengths = lengths.astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        sums = np.zeros(2 + size)
        sums[0], sums[1] = np.count_nonzero(totals), totals.sum()
        sums[2:] = np.bincount(flat, np.repeat(totals, lengths), minlength=size)
        heads = [sums.tobytes()]

        def reply(at: np.ndarray) -> bytes:
            parts = [heads.pop() if heads else b"", pack(totals[at]), pack(lengths[at].astype(np.uint32)), pack(spread(at, flat, lengths, starts).astype(np.uint32))]
            return b"".join(len(p).to_bytes(8, "little") + p for p in parts)

        return reply

    return materialize(blocks.answers(solve, with_counts=True), "answers")


def _parts(answer: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(answer):
        n = int.from_bytes(answer[at : at + 8], "little")
        out.append(answer[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _sums(answers: DataFrame, size: int) -> np.ndarray:
    def of(batch: pa.RecordBatch) -> np.ndarray:
        return sum((np.frombuffer(h) for x in batch["answer"] if (h := _parts(x.as_py())[0])), np.zeros(2 + size))

    return partition_sums(answers.select("answer"), 2 + size, of)


class _Words:
    """What the word table says of a group's words."""

    def __init__(self, dictionary: dict, found: pa.Table):
        parts = [_parts(a.as_py()) for a in found["answer"]]
        joined = lambda k, dtype: np.concatenate([np.empty(0, dtype), *(unpack(p[k], dtype) for p in parts)])
        self.counts, self.lengths, self.flat = joined(1, np.int64), joined(2, np.uint32).astype(np.int64), joined(3, np.uint32).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.place = unpack(dictionary["place"], np.uint32)


class _Texts:
    """A block's documents, by chunks."""

    def __init__(self, row: dict, words: _Words):
        self.table, self.positions = words, unpack(row["positions"], np.uint32)
        self.words = unpack(row["lengths"], np.uint32).astype(np.int64)
        self.marks = unpack(row["marks"], np.uint8)
        self.ids = [None if z else i for i, z in zip(unpack(row["ids"], np.int64).tolist(), unpack(row["nulls"], np.uint8).tolist(), strict=True)]

    def chunks(self, end_id: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(documents, their words, where each document's words end, their ids with an end each, where each document's ids end)."""
        ends, start = np.cumsum(self.words), 0
        while start < len(self.words):
            first = ends[start] - self.words[start]
            stop = max(start + 1, int(np.searchsorted(ends, first + CHUNK_WORDS, "right")))
            at = self.table.place[self.positions[first : ends[stop - 1]]]
            word_ends = ends[start:stop] - first
            upto = np.concatenate([[0], np.cumsum(self.table.lengths[at])])[word_ends]
            ids = np.insert(spread(at, self.table.flat, self.table.lengths, self.table.starts), upto, end_id)
            yield slice(start, stop), at, word_ends, ids, upto + np.arange(1, stop - start + 1)
            start = stop


def tiles(ids: np.ndarray, ends: np.ndarray, take: np.ndarray, start_id: int) -> np.ndarray:
    """Windows that tile the sequences to take (each ends where ends says): WINDOW + 1 ids each, the first the one before; the last of a
    sequence is padded with -1. Each token of a sequence is in one window's last WINDOW ids, once."""
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    begin, end = begins[take], ends[take]
    more = -(-(end - begin) // attention.WINDOW)
    of = np.repeat(np.arange(len(begin)), more)
    place = np.arange(len(of)) - np.repeat(np.cumsum(more) - more, more)
    index = (begin[of] + place * attention.WINDOW)[:, None] + np.arange(-1, attention.WINDOW)
    own = ids[np.clip(index, 0, max(0, len(ids) - 1))] if len(ids) else index
    return np.where(index < begin[of][:, None], start_id, np.where(index < end[of][:, None], own, -1)).astype(np.int32)


def _windows(blocks: Blocks, answers: DataFrame, end_id: int, start_id: int, tokens: int, texts: int) -> DataFrame:
    """(turn, ids) of all training windows (see tiles), packed RUN_WINDOWS to a row. tokens, texts: of training text, for the number of partitions."""
    schema = pa.schema([("turn", pa.int32()), ("ids", pa.binary())])

    def read(row: dict, words: _Words) -> Iterator[pa.RecordBatch]:
        attention.keep_memory()
        rng = np.random.default_rng(row["block"] & 0xFFFFFFFF)
        texts, turn = _Texts(row, words), int(rng.integers(ROUNDS))
        for docs, _, _, ids, ends in texts.chunks(end_id):
            got = tiles(ids, ends, texts.marks[docs] > 0, start_id)
            got = got[rng.permutation(len(got))]
            runs = [got[s : s + RUN_WINDOWS] for s in range(0, len(got), RUN_WINDOWS)]
            runs = [part for run in runs for part in (np.array_split(run, ROUNDS) if len(runs) < ROUNDS else [run]) if len(part)]
            yield pa.RecordBatch.from_arrays([pa.array([(turn + k) % ROUNDS for k in range(len(runs))], pa.int32()), pa.array([pack(x.reshape(-1)) for x in runs], pa.binary())], schema=schema)
            turn += len(runs)

    about = tokens // attention.WINDOW + texts
    return materialize(blocks.resolve(answers, _Words, read, "turn int, ids binary").repartition(max(1, -(-about // (PART_WINDOWS * ROUNDS)))), "windows")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Windows of a partition, about PART_WINDOWS at a time."""
    held, n = [], 0
    for x in (x for batch in batches for x in batch["ids"]):
        held.append(unpack(x.as_py(), np.int32).reshape(-1, attention.WINDOW + 1))
        n += len(held[-1])
        if n >= PART_WINDOWS:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def inventory_of(windows: DataFrame, counts: np.ndarray) -> attention.Inventory:
    """Embeddings and classes from the counts of all ids and their profiles over all windows."""
    ranks = attention.Ranks(counts)
    width = len(ranks.ids) * 3 * attention.GROUPS

    def of(batch: pa.RecordBatch) -> np.ndarray:
        attention.keep_memory()
        return sum((ranks.profile(x) for x in _unpacked(iter([batch]))), np.zeros(width, np.int64))

    return attention.Inventory(counts, partition_sums(windows.select("ids"), width, of, sparse, dense))


def steps(ids: np.ndarray, rng: np.random.Generator, least: int) -> Iterator[np.ndarray]:
    """The windows in batches, all once and in random order; where these are fewer than least, again from the start until there are so many."""
    once = -(-len(ids) // BATCH)
    for k in range(max(once, least)):
        if k % once == 0:
            order = rng.permutation(len(ids))
        yield ids[order[k % once * BATCH :][:BATCH]]


def train(windows: DataFrame, inventory: attention.Inventory, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Rounds of training in each partition, each on its own share of the windows, and averaging, weighted by the windows of each."""
    weights = attention.initial(inventory)
    width = len(attention.flatten(weights))
    single = lambda x: np.frombuffer(x, np.float32)
    encode = lambda x: x.astype(np.float32).tobytes()

    def learn(batches: Iterator[pa.RecordBatch], begin: dict[str, np.ndarray], turn: int) -> Iterator[pa.RecordBatch]:
        attention.keep_memory()
        p = {k: v.copy() for k, v in begin.items()}
        adam, rng, seen = attention.Adam(p, RATE / (1 + turn)), np.random.default_rng(turn), 0
        for k, ids in enumerate(_unpacked(batches)):  # a part that others follow has PART_WINDOWS, which are more steps than MIN_STEPS
            seen += len(ids)
            for own in steps(ids, rng, 0 if k else MIN_STEPS):
                _, g = attention.gradients(p, inventory, own[:, :-1], own[:, 1:])
                adam.step(p, g)
        if seen:  # averages are sums of weights over the windows, in thousands, so that floats hold them
            yield pa.RecordBatch.from_pydict({"at": [TaskContext.get().partitionId()], "sums": [encode(np.append(attention.flatten(p).astype(float) * seen, seen) / 1e3)]}, schema=pa.schema([("at", pa.int64()), ("sums", pa.binary())]))

    for turn in range(rounds):
        share = windows.where(F.col("turn") == turn).select("ids")
        total = tree_sum(share.mapInArrow(lambda it, w=weights, t=turn: learn(it, w, t), "at long, sums binary"), width + 1, encode, single)
        if total[-1]:
            weights = attention.unflatten(total[:-1] / total[-1], weights)
    return weights


def score(docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text", held_out_fold: int = 1) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; logarithms to base 10."""
    held_out = fold(F.col(id_col)) == held_out_fold
    size = max(load(definition).get_vocab(with_added_tokens=True).values()) + 1
    blocks = write_blocks(docs, id_col, text_col, mark=F.when(held_out, 0).otherwise(1), lower=True)
    answers = _answers(blocks, definition, size)
    sums = _sums(answers, size)
    texts = docs.where(~held_out).count()
    distinct, total = int(sums[0]) + (texts > 0), int(sums[1]) + texts
    counts = np.append(sums[2:], texts)  # the end has the id behind the vocabulary, the start the next one
    windows = _windows(blocks, answers, size, size + 1, int(sums[2:].sum()) + texts, texts)
    inventory = inventory_of(windows, counts)
    weights = train(windows, inventory)
    divisor = math.log10(total + 0.5 * (distinct + 1))
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    end_base = math.log10(texts + 0.5) - divisor

    def read(row: dict, words: _Words) -> Iterator[pa.RecordBatch]:
        attention.keep_memory()
        texts_of = _Texts(row, words)
        base_of = np.log10(words.counts + 0.5) - divisor
        for docs, at, word_ends, ids, ends in texts_of.chunks(size):
            of = attention.score_sequences(weights, inventory, ids, ends).astype(np.float64) / math.log(10)
            # Tokens by word: a document's words, then its end.
            n = np.insert(words.lengths[at], word_ends, 1)
            base = np.insert(base_of[at], word_ends, end_base)
            known = np.insert((words.counts[at] > 0).astype(np.int64), word_ends, int(texts > 0))
            stop = np.cumsum(n)
            upto = np.concatenate([[0.0], np.cumsum(of)])
            by_word = upto[stop] - upto[stop - n]
            scored = np.where(n > 0, by_word, base)
            doc_ends = word_ends + np.arange(1, len(word_ends) + 1)
            doc_starts = np.concatenate([[0], doc_ends[:-1]])
            rows = [texts_of.ids[docs], texts_of.marks[docs] == 0, doc_ends - doc_starts, np.add.reduceat(known, doc_starts), np.full(len(doc_ends), total), np.add.reduceat(base, doc_starts), np.add.reduceat(scored, doc_starts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return blocks.resolve(answers, _Words, read, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
