import zlib
from collections import defaultdict

import numpy as np
import pytest

from lodestone.llm import packing
from lodestone.llm import queries as Q


def tokens(rows):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t in rows]


def valid(got, want, capacity=4096):
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens].append(r)
    left = defaultdict(int)
    for i, ids in want:
        left[i, len(ids)] += 1
    assert set(pieces) == set(left)
    for i, ids in want:
        own = pieces[i, len(ids)]
        assert sum(r.length for r in own) == len(ids) * left[i, len(ids)]
        assert all(zlib.crc32(ids[r.start : r.start + r.length]) == r.ids_crc32 for r in own)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    used = padded = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        used, padded = used + at, padded + (at if at & (at - 1) == 0 else capacity)
    assert sorted(sequences) == list(range(len(sequences)))
    return used / padded if padded else 1


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert valid(Q.op10_packing(spark, sf_dir).collect(), tokens(rows)) > 0.98


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (3, "word " * 9000), (None, "x y z"), (5, "a b"), (5, "a b")] + [(100 + i, "w " * 2047) for i in range(50)]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, length int, start string").repartition(4)
    assert valid(packing.pack_documents(docs, Q.word_bpe()).collect(), tokens(rows)) > 0.98
    assert packing.pack_documents(docs.limit(0), Q.word_bpe()).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_plan_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    sizes = sorted(rng.choice(np.arange(1, 1200), 40, replace=False).tolist())
    counts = rng.integers(1, 5000, 40).tolist()
    found = packing.plan(sizes, counts, 4096)
    assert (sum(p * t for p, t in found) == counts).all()
    assert all(p @ np.array(sizes) <= 4096 for p, _ in found)
    assert sum(t for _, t in found) <= 1.005 * np.dot(sizes, counts) / 4096 + 45


def test_plan_of_a_known_optimum():
    found = packing.plan([1000, 1500, 2596, 3096, 4096], [700, 300, 300, 700, 55], 4096)
    assert sum(t for _, t in found) == 300 + 700 + 55


def test_knapsack_against_brute_force():
    sizes, values, most = np.array([3, 4, 5]), np.array([2.0, 3.1, 4.2]), np.array([2, 1, 3])
    best = max((a * 2 + b * 3.1 + c * 4.2) for a in range(3) for b in range(2) for c in range(4) if a * 3 + b * 4 + c * 5 <= 12)
    value, pattern = packing._knapsack(sizes, values, most, 12)
    assert value == pytest.approx(best) and pattern @ values == pytest.approx(best) and pattern @ sizes <= 12
