import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import attention as A
from lodestone.llm import lm
from lodestone.llm import queries as Q


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def brute(rows):
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    count, texts = Counter(), 0
    for i, t in rows:
        if fold(i) != 1:
            count.update(words(t))
            texts += 1
    n, v = sum(count.values()) + texts, len(count) + (texts > 0)
    z = n + 0.5 * (v + 1)
    out = []
    for i, t in rows:
        c = [*(count[w] for w in words(t)), texts]
        out.append((i, fold(i) == 1, len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 0.5) / z) for x in c)))
    return sorted(out, key=str)


def check(got, rows):
    got, want = sorted(map(tuple, got), key=str), brute(rows)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[2], r[5])), sorted(want, key=lambda r: (str(r[0]), r[2], r[5]))):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and math.isfinite(g[6]) and g[6] < 0


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = [tuple(r) for r in Q.op5_lm(spark, sf_dir).collect()]
    check(got, rows)
    held = [r for r in got if r[1]]
    tokens, base, score = (sum(r[k] for r in held) for k in (2, 5, 6))
    # The attention model alone is better than word frequencies on unseen text, by a margin (log10, a token) and in most documents.
    assert score / tokens > base / tokens + 0.05
    assert sum(r[6] > r[5] for r in held) > 0.5 * len(held)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "A a a"), (3, "A a a"), (None, "b"), (4, "x" * 5000 + " y"), (5, "word " * 20_000), (6, "\x85  "), (8, " \n")]
    docs = spark.createDataFrame([(*r, 1.0, "z") for r in rows], "doc_id long, text string, score double, id string").repartition(3)
    check(lm.score(docs, Q.word_bpe()).collect(), rows)
    assert lm.score(docs.limit(0), Q.word_bpe()).count() == 0


def test_training_sees_every_token(spark):
    rows = [(i, " ".join(f"w{(i + k) % 20}" for k in range(n))) for i, n in enumerate([3000, 400, 33, 1, 0, 40, 500])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen, train = [], lm.train

    def spied(windows, inventory, *a):
        held = [lm.unpack(bytes(r.ids), np.int32).reshape(-1, A.WINDOW + 1) for r in windows.collect()]
        seen.append((np.concatenate(held), inventory))
        return train(windows, inventory, *a)

    lm.train = spied
    try:
        got = lm.score(docs, Q.word_bpe()).collect()
    finally:
        lm.train = train
    windows, inventory = seen[0]
    flat, _ = lm.word_ids(Q.word_bpe(), [w.encode() for r in got if not r.held_out for w in words(dict(rows)[r.id])])
    want = np.append(flat, [inventory.start - 1] * sum(not r.held_out for r in got))  # each text's end too
    targets = windows[:, 1:]
    assert Counter(targets[targets >= 0].tolist()) == Counter(want.tolist())


def test_tiles_follow_each_other_within_a_sequence():
    lengths = [1, 5, A.WINDOW, A.WINDOW + 1, 200, 77]
    flat, ends = np.arange(sum(lengths)), np.cumsum(lengths)
    got = lm.tiles(flat, ends, np.array([True, True, True, False, True, True]), 999)
    assert sorted(got[:, 1:][got[:, 1:] >= 0].tolist()) == sorted(set(flat.tolist()) - set(range(38, 38 + A.WINDOW + 1)))
    for w in got:
        assert w[0] == (999 if w[1] in {0, *ends} else w[1] - 1) and set(np.diff(w[1:][w[1:] >= 0]).tolist()) <= {1}


def test_a_share_is_gone_over_again_only_as_far_as_steps_are_missing():
    rng = np.random.default_rng(0)
    for n, least in ((190 * lm.BATCH, lm.MIN_STEPS), (7 * lm.BATCH + 5, 20), (300, 0), (1, 3), (lm.PART_WINDOWS, lm.MIN_STEPS)):
        got, once = list(lm.steps(np.arange(n), rng, least)), -(-n // lm.BATCH)
        assert len(got) == max(once, least)  # 200 steps, not twice 190
        for s in range(0, len(got), once):
            held = np.concatenate(got[s : s + once])
            assert len(set(held.tolist())) == len(held) and (len(held) == n or s + once > len(got))
    assert lm.PART_WINDOWS >= lm.MIN_STEPS * lm.BATCH


def test_attention_carries_the_score_where_context_tells_the_word(spark):
    cycle = "the of and to in is for that with on as by at from it was be are this or".split()
    rows = [(i, " ".join(cycle[(i + k) % 20] for k in range(400))) for i in range(60)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), Q.word_bpe()).collect()
    held = [r for r in got if r.held_out]
    tokens, base, score = (sum(r[k] for r in held) for k in (2, 5, 6))
    # A quarter weight can't do better than this, however good the model is.
    assert held and score / tokens > math.log10(0.25 + 0.75 * 10 ** (base / tokens)) + 0.1


def small():
    rng = np.random.default_rng(0)
    inventory = A.Inventory(rng.integers(0, 50, 300).astype(float))
    p = A.initial(inventory)
    return rng, inventory, {k: v + rng.standard_normal(v.shape).astype(np.float32) * 0.1 for k, v in p.items()}


def test_probabilities_sum_to_one_and_masks_are_causal():
    rng, inventory, p = small()
    inputs = rng.integers(0, 300, (1, A.WINDOW))
    total = 0.0
    for t in range(300):
        total += np.exp(A.log_probabilities(p, inventory, inputs, np.full((1, A.WINDOW), t), A.WINDOW)[0, 5])
    assert total == pytest.approx(1, abs=1e-3)
    other = inputs.copy()
    other[0, 10:] = 7
    a, b = (A.log_probabilities(p, inventory, x, inputs, A.WINDOW)[0] for x in (inputs, other))
    assert np.allclose(a[:10], b[:10], atol=1e-5) and not np.allclose(a[10:], b[10:])


def test_each_token_once_with_context():
    rng, inventory, p = small()
    lengths = [1, 5, A.WINDOW, A.WINDOW + 1, 200, 77]
    flat, ends = rng.integers(0, 300, sum(lengths)), np.cumsum(lengths)
    got = A.score_sequences(p, inventory, flat, ends, batch=3)
    start = 0
    for end in ends:
        own, moved = flat[start:end], np.append(inventory.start, flat[start : end - 1])
        for t in range(len(own)):
            k = 0 if t < A.WINDOW else -(-(t + 1 - A.WINDOW) // A.STRIDE)
            begin = k * A.STRIDE
            window = moved[begin : t + 1][None]
            want = A.log_probabilities(p, inventory, window, own[begin : t + 1][None], 1)[0, 0]
            assert got[start + t] == pytest.approx(want, abs=1e-4)
        start = end


def test_gradients_match_differences():
    rng, inventory, p = small()
    p = {k: v.astype(np.float64) for k, v in p.items()}
    inputs, targets = rng.integers(0, 300, (5, 9)), rng.integers(0, 300, (5, 9))
    targets = np.where(inventory.of[targets] < 0, inventory.ids[0], targets)  # targets occur in training text
    targets[2, 5:] = inputs[2, 6:] = -1  # a window that ends early
    _, g = A.gradients(p, inventory, inputs, targets)
    assert set(g) == set(p)
    for k in p:
        for at in [tuple(rng.integers(0, n) for n in p[k].shape) for _ in range(12)]:
            up, down = ({n: v.copy() for n, v in p.items()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            want = (A.gradients(up, inventory, inputs, targets)[0] - A.gradients(down, inventory, inputs, targets)[0]) / 2e-5
            assert g[k][at] == pytest.approx(want, rel=2e-2, abs=2e-6), (k, at)


def test_loss_is_that_of_the_probabilities_and_pads_have_none():
    rng, inventory, p = small()
    inputs, targets = rng.integers(0, 300, (4, 12)), inventory.ids[rng.integers(0, len(inventory.ids), (4, 12))]
    loss, _ = A.gradients(p, inventory, inputs, targets)
    found = A.log_probabilities(p, inventory, inputs, targets, 12) - inventory.seen_log
    assert loss == pytest.approx(-float(found.mean()), abs=1e-4)
    targets[:, 8:] = inputs[:, 9:] = -1
    assert A.gradients(p, inventory, inputs, targets)[0] == pytest.approx(-float(found[:, :8].mean()), abs=1e-4)


def test_profile_counts_neighbours_and_every_id_has_an_embedding():
    counts = np.array([4.0, 0, 3, 2, 1])
    ranks = A.Ranks(counts)
    windows = np.array([[5, 0, 2, 0, 3], [0, 0, 3, 2, -1]])
    got = ranks.profile(windows).reshape(4, 3, A.GROUPS)
    before = np.zeros((4, A.GROUPS), int)
    for own, other in ((0, 5), (2, 0), (0, 2), (3, 0), (0, 0), (3, 0), (2, 3)):
        before[ranks.rank[own], ranks.group[other]] += 1
    assert (got[:, 0] == before).all() and got[:, 1].sum() == 6 and got[:, 2].sum() > 0
    inventory = A.Inventory(counts, got.reshape(-1))
    assert len({tuple(inventory.embedding[i]) for i in (0, 2, 3, 4)}) == 4
    rng = np.random.default_rng(1)
    large = A.Inventory(rng.integers(0, 3, 4000).astype(float))
    assert large.sizes.max() <= A.MEMBERS and large.sizes.sum() == len(large.ids)
    assert np.bincount(large.of[large.ids]).tolist() == large.sizes.tolist()


def test_batches_use_the_same_memory_again():
    import resource

    rng, inventory, p = small()
    windows = inventory.ids[rng.integers(0, len(inventory.ids), (256, A.WINDOW + 1))]
    flat, ends = windows.reshape(-1), np.array([windows.size])
    A.keep_memory()
    for batch in (lambda: A.gradients(p, inventory, windows[:, :-1], windows[:, 1:]), lambda: A.score_sequences(p, inventory, flat, ends)):
        for _ in range(5):
            batch()
        before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
        for _ in range(20):
            batch()
        assert (resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before) / 20 < 300  # pages; thousands, where each batch's arrays come anew


def test_attention_is_that_of_queries_keys_and_values():
    rng, inventory, p = small()
    inputs = rng.integers(0, 300, (3, A.WINDOW))
    x = inventory.embedding[inputs] + A._POSITIONS
    score = (x @ p["Q"]) @ (x @ p["K"]).transpose(0, 2, 1) / math.sqrt(A.WIDTH)
    weight = np.exp(score) * np.tri(A.WINDOW)
    seen = weight / weight.sum(2, keepdims=True) @ (x @ p["V"])
    want = np.maximum(np.concatenate([x, seen], 2).reshape(-1, 2 * A.WIDTH) @ p["M"] + p["m"], 0)
    got = A._layer(p, A._attend(p, inventory, inputs, A.WINDOW)[-1])
    assert np.allclose(got[:, :-1], want, atol=1e-4) and (got[:, -1] == 1).all()
