"""BPE encoding by a table of distinct words, and decoding by a join of ids with the vocabulary's pieces.

Words (runs between white space) are split in Spark, each distinct word is encoded once over the whole input, and the ids go
back to every place of the word. That equals encoding whole texts for tokenizers that drop white space and never look across
it, which is checked on loading. The vocabulary has a fixed size, so the join with its pieces is a lookup in each batch.

Defined results: a null text counts as the empty text and has no ids; texts of any length are encoded whole; repeated rows
and ids are encoded row by row; null ids stay null; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lodestone.llm.blocks import Blocks, pack, unpack, write_blocks

#: Tokens of output to a record batch.
BATCH_TOKENS = 1 << 20
_PROBES = ("a b", "It's here, 12 é", "x ...y", "<|startoftext|> a")


@lru_cache(maxsize=2)
def load(text: str):
    """Tokenizer of a definition (the content of its file), without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(text)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def read_definition(path: str) -> str:
    """A tokenizer's file, read on the driver and sent with the tasks; refused if words can't be encoded one by one."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    encode = lambda s: load(text).encode(s, add_special_tokens=False).ids
    for probe in _PROBES:
        if encode(probe) != sum((encode(w) for w in probe.split(" ")), []):
            raise ValueError("this tokenizer doesn't encode words independently of each other")
    return text


def word_ids(definition: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each word, flat, and how many each has."""
    tokenizer, flat, lengths = load(definition), [], np.empty(len(words), np.uint32)
    for start in range(0, len(words), 8192):
        for i, e in enumerate(tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words[start : start + 8192]], add_special_tokens=False), start):
            ids = e.ids
            lengths[i] = len(ids)
            flat += ids
    return np.array(flat, np.uint32), lengths


def spread(positions: np.ndarray, flat: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the words at these positions, one after another."""
    n = lengths[positions]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[positions] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def map_ids(docs: DataFrame, definition: str, consume: Callable, schema: str, id_col: str = "doc_id", text_col: str = "text", blocks: Blocks | None = None) -> DataFrame:
    """Encode every document and hand the ids on by chunks: consume(doc_ids, ids, ends) gives a record batch.

    doc_ids has None for null; ends are where each document's ids end.
    """
    blocks = blocks or write_blocks(docs, id_col, text_col)
    narrow = np.uint16 if load(definition).get_vocab_size() <= 1 << 16 else np.uint32

    def solve(words: list[bytes], _counts: np.ndarray) -> Callable[[np.ndarray], bytes]:
        flat, lengths = word_ids(definition, words)
        lengths = lengths.astype(np.int64)
        starts = np.cumsum(lengths) - lengths

        def reply(at: np.ndarray) -> bytes:
            head = pack(lengths[at].astype(np.uint32))
            return len(head).to_bytes(8, "little") + head + pack(spread(at, flat, lengths, starts).astype(narrow))

        return reply

    def prepare(dictionary: dict, found: pa.Table) -> tuple[np.ndarray, ...]:
        answers = found["answer"].to_pylist()
        heads = [int.from_bytes(a[:8], "little") for a in answers]
        lengths = np.concatenate([np.empty(0, np.int64), *(unpack(a[8 : 8 + h], np.uint32) for a, h in zip(answers, heads, strict=True))]).astype(np.int64)
        flat = np.concatenate([np.empty(0, narrow), *(unpack(a[8 + h :], narrow) for a, h in zip(answers, heads, strict=True))])
        return lengths, flat, np.cumsum(lengths) - lengths, unpack(dictionary["place"], np.uint32)

    def read(row: dict, made: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        lengths, flat, starts, place = made
        positions, words = unpack(row["positions"], np.uint32), unpack(row["lengths"], np.uint32).astype(np.int64)
        ids, nulls = unpack(row["ids"], np.int64).tolist(), unpack(row["nulls"], np.uint8).tolist()
        ends = np.cumsum(words)
        start = 0
        while start < len(ids):  # so many documents at a time as have about BATCH_TOKENS / 4 words
            first = ends[start] - words[start]
            end = max(start + 1, int(np.searchsorted(ends, first + BATCH_TOKENS // 4, "right")))
            at = place[positions[first : ends[end - 1]]]
            per_word = np.concatenate([[0], np.cumsum(lengths[at])])
            yield consume([None if z else i for i, z in zip(ids[start:end], nulls[start:end], strict=True)], spread(at, flat, lengths, starts), per_word[ends[start:end] - first])
            start = end

    return blocks.resolve(blocks.answers(solve), prepare, read, schema)


def encode(docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every document; definition: see read_definition."""

    def consume(doc_ids: list, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], names=["id", "ids"])

    return map_ids(docs, definition, consume, "id long, ids array<int>", id_col, text_col)


def decode(encoded: DataFrame, definition: str) -> DataFrame:
    """(id, n_tokens, ids_text, text) of encoded documents: each id joined with its piece, special tokens included.

    ids_text: the decimal ids joined by spaces. The tokenizer may have no decoder of its own: pieces are then joined by
    spaces, as its library does. Ids that the vocabulary doesn't have are left out of the text.
    """
    tokenizer = load(definition)
    if tokenizer.decoder is not None:
        raise ValueError("only tokenizers without a decoder of their own are supported")
    size = max(tokenizer.get_vocab(with_added_tokens=True).values(), default=-1) + 1

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(definition)  # once: a lookup compares whole definitions
        table = [vocabulary.id_to_token(i) for i in range(size)]
        piece, number = pa.array(table, pa.string()), pa.array([str(i) for i in range(size)])
        gaps = any(p is None for p in table)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                ids = batch["ids"]
                flat = ids.flatten()
                offsets = pc.subtract(ids.offsets, ids.offsets[0]) if len(ids) else ids.offsets
                texts = pc.binary_join(pa.ListArray.from_arrays(offsets, piece.take(flat)), " ") if not gaps else pa.array([" ".join(table[i] for i in x.as_py() if table[i] is not None) for x in ids])
                yield pa.RecordBatch.from_arrays([batch["id"], pc.list_value_length(ids), pc.binary_join(pa.ListArray.from_arrays(offsets, number.take(flat)), " "), texts], names=["id", "n_tokens", "ids_text", "text"])

    return encoded.mapInArrow(pieces, "id long, n_tokens int, ids_text string, text string")
