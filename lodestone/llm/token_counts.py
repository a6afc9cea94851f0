"""Token counts that follow edits: a segment tree of pre-token counts for each document.

A document's pre-tokens (the pieces that BPE never merges across) are gathered into leaves of about LEAF pre-tokens; the tree holds
characters and tokens of every subtree. An edit finds its leaves by descending on characters, re-encodes from the last leaf that starts
before the edit until the new boundaries meet an old leaf's start behind it, and updates the sums on the paths of those leaves only.

Leaves never start inside a run of white space: how a run is split depends on what follows it, everywhere else a boundary depends on
the character after it alone. A leaf that starts before the edit is therefore a safe place to start again.

Defined results: a null text counts as the empty text, with no tokens; texts of any length are whole; repeated rows keep trees of their own; edits
apply in order, positions are characters of the text as it then is, and are cut to its bounds; a null insertion is empty, a null
list of edits or edit has no effect; null ids stay null; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF = 48
#: Counts of so many distinct pre-tokens are kept by a worker before it starts anew.
CACHE = 1 << 20
EDITS = "array<struct<start:bigint,length:bigint,insert:string>>"


class Vocabulary:
    """A rank file's content and the pattern that splits text: counts the tokens of a pre-token, each distinct one once."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.pattern, self.known = regex.compile(pattern), {}

    def count(self, piece: str) -> int:
        if (n := self.known.get(piece)) is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            n = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return n


@lru_cache(maxsize=2)
def vocabulary(ranks: bytes, pattern: str) -> Vocabulary:
    return Vocabulary(ranks, pattern)


def read_ranks(path: str) -> bytes:
    """A rank file, read on the driver and sent with the tasks; its size is the vocabulary's."""
    with open(path, "rb") as f:
        return f.read()


class Tree:
    """Leaves' characters and tokens, with sums over subtrees."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.leaves = len(chars)
        self.base = 1 << max(0, (self.leaves - 1).bit_length())
        self.chars, self.tokens = self._filled(chars), self._filled(tokens)

    def _filled(self, leaves: list[int]) -> list[int]:
        out = [0] * self.base + leaves + [0] * (self.base - len(leaves))
        for k in range(self.base - 1, 0, -1):
            out[k] = out[2 * k] + out[2 * k + 1]
        return out

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it starts."""
        k, start = 1, 0
        while k < self.base:
            k *= 2
            if position >= start + self.chars[k]:
                start += self.chars[k]
                k += 1
        return k - self.base, start

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        k = leaf + self.base
        more, most = chars - self.chars[k], tokens - self.tokens[k]
        while k:
            self.chars[k] += more
            self.tokens[k] += most
            k >>= 1

    def lists(self) -> tuple[list[int], list[int]]:
        return self.chars[self.base : self.base + self.leaves], self.tokens[self.base : self.base + self.leaves]


def _leaves(v: Vocabulary, text: str, start: int, stop) -> tuple[list[int], list[int], int]:
    """Pre-tokens of text from start on, as leaves, up to the first boundary for which stop() is true; also where that is."""
    chars, tokens, held, tally, begun, at, count = [], [], 0, 0, start, start, v.count
    for m in v.pattern.finditer(text, start):
        begin, at_end = m.span()
        if held >= LEAF and not (text[begin - 1].isspace() and text[begin].isspace()):
            chars.append(begin - begun)
            tokens.append(tally)
            held, tally, begun = 0, 0, begin
        if begin > start and stop(begin):
            at = begin
            break
        tally += count(m[0])
        held += 1
        at = at_end
    else:
        at = len(text)
    if at > begun or not chars:
        chars.append(at - begun)
        tokens.append(tally)
    return chars, tokens, at


def plant(v: Vocabulary, text: str) -> Tree:
    return Tree(*_leaves(v, text, 0, lambda _: False)[:2])


def edit(v: Vocabulary, text: str, tree: Tree, start: int, length: int, insert: str) -> tuple[str, Tree, int]:
    """Replace length characters at start: the new text, its tree, and how many characters were encoded again."""
    start = max(0, min(start, len(text)))
    end = min(len(text), start + max(0, length))
    first, begin = tree.leaf_at(start - 1) if start else (0, 0)
    new, shift = text[:start] + insert + text[end:], len(insert) - (end - start)
    # Old leaves' starts behind the edit, found as the scan comes to them.
    chars = tree.chars
    state = [first, begin]  # the next leaf to look at, and where it starts in the old text

    def meets(at: int) -> bool:
        if at < start + len(insert) or at - shift < end:
            return False
        while state[0] < tree.leaves and (state[1] < at - shift or chars[tree.base + state[0]] == 0):
            state[1] += chars[tree.base + state[0]]
            state[0] += 1
        return state[0] < tree.leaves and state[1] == at - shift and not (new[at - 1].isspace() and new[at].isspace())

    sizes, tokens, stop = _leaves(v, new, begin, meets)
    last = state[0] if stop < len(new) else tree.leaves
    room = last - first
    if len(sizes) > room > 0 and sum(1 for _ in sizes) <= 4 * room:  # a few more than before: the last slot takes them, up to fourfold
        sizes, tokens = [*sizes[: room - 1], sum(sizes[room - 1 :])], [*tokens[: room - 1], sum(tokens[room - 1 :])]
    if len(sizes) <= room:
        for k in range(room):
            tree.set(first + k, sizes[k] if k < len(sizes) else 0, tokens[k] if k < len(tokens) else 0)
    else:
        old_chars, old_tokens = tree.lists()
        tree = Tree(old_chars[:first] + sizes + old_chars[last:], old_tokens[:first] + tokens + old_tokens[last:])
    return new, tree, stop - begin


def trees(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, chars, tokens, n_tokens) of every document, and the columns to keep: the leaves of its tree and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(ranks, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                made = [plant(v, x.as_py()) for x in batch["text"]]
                leaves = [t.lists() for t in made]
                own = [batch["id"], batch["text"], pa.array([a for a, _ in leaves], pa.list_(pa.int32())), pa.array([b for _, b in leaves], pa.list_(pa.int32())), pa.array([t.total for t in made], pa.int64())]
                yield pa.RecordBatch.from_arrays(own + [batch[f"keep_{c}"] for c in keep], names=["id", "text", "chars", "tokens", "n_tokens", *keep])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    kept = "".join(f", `{c}` {rows.schema[f'keep_{c}'].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"id long, text string, chars array<int>, tokens array<int>, n_tokens long{kept}")


def apply_edits(planted: DataFrame, ranks: bytes, pattern: str, edits_col: str = "edits") -> DataFrame:
    """(id, text, chars, tokens, n_before, n_tokens, n_edits, encoded_chars): documents with trees after their edits (a column of type EDITS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(ranks, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                rows = []
                for row in whole.slice(start, 256).to_pylist():
                    text, tree, again, n = row["text"], Tree(row["chars"], row["tokens"]), 0, 0
                    for e in row["edits"] or ():
                        if e is not None and e["start"] is not None:
                            text, tree, more = edit(v, text, tree, e["start"], e["length"] or 0, e["insert"] or "")
                            again, n = again + more, n + 1
                    rows.append((row["id"], text, *tree.lists(), row["n_tokens"], tree.total, n, again))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    i64, leaves = pa.int64(), pa.list_(pa.int32())
    schema = pa.schema([("id", i64), ("text", pa.string()), ("chars", leaves), ("tokens", leaves), ("n_before", i64), ("n_tokens", i64), ("n_edits", i64), ("encoded_chars", i64)])
    rows = planted.select("id", "text", "chars", "tokens", "n_tokens", F.col(edits_col).cast(EDITS).alias("edits"))
    return rows.mapInArrow(run, "id long, text string, chars array<int>, tokens array<int>, n_before long, n_tokens long, n_edits long, encoded_chars long")


def sample_edits(doc_id: Column, text: Column) -> Column:
    """Three edits of a document, by rule: its own first words put in at one place, some characters cut at another, a word written over a third."""
    size = F.char_length(F.coalesce(text, F.lit("")))
    place = lambda salt: F.pmod(F.xxhash64(doc_id, F.lit(salt)), size + 1)
    one = lambda start, length, insert: F.struct(start.alias("start"), F.lit(length).cast("long").alias("length"), insert.alias("insert"))
    return F.array(one(place(1), 0, F.concat(F.lit(" "), F.substring(F.coalesce(text, F.lit("")), 1, 40))), one(place(2), 9, F.lit("")), one(place(3), 4, F.lit("edit's 2 ")))
