import random

import public_tokenizers
from pyspark.sql import functions as F

from lodestone.llm import queries as Q
from lodestone.llm import token_counts as T

RANKS, PATTERN = T.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
V = T.vocabulary(RANKS, PATTERN)


def whole(text):
    return len(V.encoding.encode_ordinary(text))


def test_random_edits_match_encoding_anew():
    rng = random.Random(2)
    bits = ["word", " a", "  ", "\n", "\n\n \n", "'s", "'", "12", "!!", "é", "한", " \t ", "x" * 30, "…", "don't", " "]
    for trial in range(60):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 900)))
        tree = T.plant(V, text)
        assert tree.total == whole(text)
        for _ in range(25):
            start, length = rng.randrange(0, len(text) + 5), rng.choice([0, 0, 1, 3, 40, 400])
            insert = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 2, 5, 300 if trial % 9 == 0 else 3])))
            want = text[: min(start, len(text))] + insert + text[min(start, len(text)) + length :]
            text, tree, _ = T.edit(V, text, tree, start, length, insert)
            assert text == want and tree.total == whole(text)
            assert sum(tree.lists()[0]) == len(text)


def test_only_the_region_is_encoded_again():
    text = "some words that go on. " * 20_000
    _, tree, again = T.edit(V, text, T.plant(V, text), 200_000, 5, "new")
    assert again < 1000 and tree.total == whole(text[:200_000] + "new" + text[200_005:])


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.withColumn("edits", T.sample_edits(F.col("doc_id"), F.col("text"))).collect()
    got = {r.doc_id: r for r in Q.op9_token_counts(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for row in rows:
        text = row.text
        for e in row.edits:
            text = text[: e.start] + e.insert + text[e.start + e.length :]
        r = got[row.doc_id]
        assert (r.n_before, r.n_tokens, r.n_edits, r.n_chars) == (whole(row.text), whole(text), 3, len(text))


def test_edge_cases(spark):
    rows = [(1, None, None, "x"), (1, "", [(0, 0, "a b")], "y"), (None, "a b", [(5, 2, None), None, (None, 1, "q")], "z"), (2, "a", [(-3, 99, "x y z")], "")]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, edits {T.EDITS}, tokens string")
    got = sorted(((r.id, r.text, r.n_before, r.n_tokens, r.n_edits) for r in T.apply_edits(T.trees(docs, RANKS, PATTERN, keep=("edits",)), RANKS, PATTERN).collect()), key=str)
    assert got == sorted([(1, "", 0, 0, 0), (1, "a b", 0, 2, 1), (None, "a b", 2, 2, 1), (2, "x y z", 1, 3, 1)], key=str)
    assert T.trees(docs.limit(0), RANKS, PATTERN).count() == 0
