import math

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import queries as Q
from lodestone.llm import topk
from tests.oracle import assert_same


def test_oracle(spark, sf_dir):
    assert_same(Q.op4_topk(spark, sf_dir), sf_dir, Q.OP4_SQL)


def brute(rows, k):
    least = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own = [math.floor(1024 * float(np.float32(x))) for x in v]
            least[i] = min(least.get(i, own), own)
    out = []
    for q, v in least.items():
        if q % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in least.items() if i != q and len(w) == len(v))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_edge_cases_and_small_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(16) * math.exp(rng.standard_normal())).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0] * 16) for i in range(150)] + [(2000, None), (2010, []), (2011, []), (2020, [None] * 16), (2030, [math.nan] * 16), (2040, [math.inf] * 16), (2050, [0.0] * 16)]
    rows += [(10, rows[10][1]), (20, [9.0] * 16), (3000, [1.0, 2.0]), (3001, [3.0, -1.0]), (3010, [5.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, block string, id int").repartition(6)
    for sizes in ({"block": 32, "cell_blocks": 2, "queries": 20}, {}):
        got = sorted(map(tuple, topk.top_k(df, F.col("id") % 10 == 0, k=7, **sizes).collect()))
        assert got == brute(rows, 7)
    assert topk.top_k(df.limit(0), F.col("id") % 10 == 0).count() == 0


def test_pruning_leaves_most_out():
    rng = np.random.default_rng(0)
    base = (rng.standard_normal((3000, 32)) @ np.diag(np.exp(-np.arange(32) / 4)) * 1000).astype(np.int64)
    base = base[np.argsort(-(base**2).sum(1))]
    rotation = np.linalg.svd(base.T.astype(float) @ base)[0]
    search = topk.Search(np.arange(5), base[:5], rotation, 10)
    scored = []
    add = search._add
    search._add = lambda q, i, s: (scored.append(len(q)), add(q, i, s))
    for start in range(0, 3000, 300):
        search.meet(np.arange(start, start + 300), base[start : start + 300])
    assert sum(scored) < 5 * 3000 / 4


def test_vectors_are_packed_in_the_least_width():
    for most, width in ((32767, 2), (32768, 4), (-32768, 2), (2**31, 8), (0, 2)):
        data = np.array([[1, most], [-5, 0]], np.int64)
        assert topk.packed(data)[0] == width and (topk.unpacked(topk.packed(data), 2) == data).all()


def test_vectors_are_shuffled_once_and_only_to_be_sorted(spark, monkeypatch):
    plans = []

    def kept(df, name, real=topk.materialize):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(topk, "materialize", kept)
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(300)], "vec_id long, embedding array<float>").repartition(4)
    result = topk.top_k(df, F.col("id") % 10 == 0, block=16, queries=7)
    assert result.count() == 300
    exchanges = [line for plan in [*plans, result._jdf.queryExecution().executedPlan().toString()] for line in plan.splitlines() if "Exchange" in line]
    assert not any("hashpartitioning(dim" in x for x in exchanges)
    assert sum("rangepartitioning(dim" in x for x in exchanges) == 1 and not any("Window" in plan for plan in plans)
