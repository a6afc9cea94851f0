import re

import numpy as np
import pytest

from lodestone.llm import jaccard
from lodestone.llm import queries as Q
from lodestone.llm.graph import components
from tests.oracle import assert_same


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """(id, set size, component) by comparing every pair of different sets that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    names = {s: i for i, s in enumerate(dict.fromkeys(sets))}
    distinct, forest, holders = list(names), jaccard.Forest(len(names)), {}
    for i, s in enumerate(distinct):
        for other in {j for x in s for j in holders.get(x, ())}:
            both = len(s & distinct[other])
            if 100 * both >= 75 * (len(s) + len(distinct[other]) - both):
                forest.union(i, other)
        for x in s:
            holders.setdefault(x, []).append(i)
    least = {}
    for (doc_id, _), s in zip(rows, sets):
        if s and doc_id is not None:
            root = forest.find(names[s])
            least[root] = min(least.get(root, doc_id), doc_id)
    return sorted(((i, len(s), least.get(forest.find(names[s])) if s else i) for (i, _), s in zip(rows, sets)), key=str)


def found(df):
    return sorted(((r.id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = found(Q.op6_jaccard(spark, sf_dir).withColumnRenamed("doc_id", "id"))
    want = brute(rows)
    assert got == want and any(i != c for i, _, c in want)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_oracle(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    assert_same(Q.op6_jaccard(spark, sf_dir), sf_dir, Q.OP6_SQL)


def variants():
    rng = np.random.default_rng(5)
    word = lambda: "w" + str(rng.integers(0, 4000))
    passage = [word() for _ in range(50)]
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.integers(6, 150))]
        for _ in range(rng.integers(1, 14)):
            own = list(base)
            for _ in range(rng.integers(0, 4)):
                own[rng.integers(0, len(own))] = word()
            rows.append(own[: len(own) - int(rng.integers(0, 3))] + (passage if rng.random() < 0.3 else []))
    rows += [[word() for _ in range(rng.integers(0, 70))] + passage for _ in range(30)] + [[word()] * k for k in range(8)]
    return [(i, " ".join(w).title() if i % 3 else " ".join(w)) for i, w in enumerate(rows)]


def test_edge_cases_small_blocks_and_split_components(spark):
    rows = variants()
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "a b"), (1004, "A\tb"), (1005, "x " * 30_000), (1005, "x " * 30_000), (None, "A b"), (None, "lone words here"), (7, rows[8][1])]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n int, digest string").repartition(5)
    assert found(jaccard.join(docs, block_bytes=2000, task_grams=200)) == brute(rows)
    assert found(jaccard.join(docs)) == brute(rows)
    assert jaccard.join(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_tree_join_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(0, 90, rng.integers(1, 40))) for _ in range(25)]
    sets = [*base, *(np.unique(np.append(b[rng.random(len(b)) > 0.08], rng.integers(0, 60, rng.integers(0, 2)))) for b in base for _ in range(3))]
    sets = [s.astype(np.uint64) for s in {tuple(s.tolist()): s for s in sets if len(s)}.values()]
    forest, got = jaccard.Forest(len(sets)), jaccard.Forest(len(sets))
    links = set()
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                forest.union(i, j)
                links.add(frozenset((i, j)))
    for a, b in jaccard.tree_join(sets):
        assert frozenset((a, b)) in links
        got.union(a, b)
    assert [forest.find(i) for i in range(len(sets))] == [got.find(i) for i in range(len(sets))]
    keys, count = np.unique(np.concatenate(sets), return_counts=True)
    less = [s[np.isin(s, keys[count > 1])] for s in sets]
    again = jaccard.Forest(len(sets))
    for a, b in jaccard.tree_join(less, sizes=[len(s) for s in sets]):
        assert frozenset((a, b)) in links
        again.union(a, b)
    assert [forest.find(i) for i in range(len(sets))] == [again.find(i) for i in range(len(sets))]


def test_keep_one_goes_by_row(spark):
    near = [" ".join(f"w{k}" for k in range(60)) + x for x in ("", " more", " other")]
    rows = [(1, near[0]), (2, near[1]), (2, "a clean text under the same id"), (5, "b c d"), (5, "B  c d"), (None, near[2]), (None, "lone words"), (None, "Lone words"), (7, ""), (7, " "), (None, None)]
    rows += [(9, "x " + near[0].replace("w", "v")), (9, "y " + near[0].replace("w", "v")), (10, "z " + near[0].replace("w", "v"))]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, row string").repartition(3)
    got = [(r.doc_id, r.text) for r in jaccard.keep_one(docs).collect()]
    low = sorted(((i, " ".join((t or "").lower().split())) for i, t in got), key=str)
    nine = [t for i, t in low if i == 9]
    assert len(nine) == 1 and nine[0][0] in "xy"
    want = [(1, near[0]), (2, rows[2][1]), (5, "b c d"), (7, ""), (7, ""), (None, ""), (None, "lone words"), (9, nine[0])]
    assert low == sorted(want, key=str)
    unique = docs.where("doc_id IN (1, 10)").unionByName(spark.createDataFrame([(11, near[1], "z")], docs.schema))
    assert sorted(r.doc_id for r in jaccard.keep_one(unique).collect()) == [1, 10]


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 7), (7, 5), (9, 9), (None, 3), (200, 7)] + [(300, i) for i in range(301, 340)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {5: 5, 7: 5, 200: 5} | {i: 300 for i in range(300, 340)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_parts_that_can_link_meet():
    rng = np.random.default_rng(0)
    for percent in (75, 50, 90):
        sizes = [int(x) for x in rng.integers(1, 3000, 200)] + [1, 1, 2, 3, 4, 400, 300, 533]
        names = [rng.bytes(16) for _ in sizes]
        bands = {b: 1 + b % 3 for b in {jaccard.band(n, percent) for n in sizes}}
        tasks = [set(jaccard.meetings(n, d, bands, percent)) for n, d in zip(sizes, names)]
        for i, n in enumerate(sizes):
            assert tasks[i]
            for j, m in enumerate(sizes):
                if 100 * min(n, m) >= percent * max(n, m):
                    assert tasks[i] & tasks[j], (n, m)


def test_rarity_rises_with_the_count():
    counts = np.unique(np.concatenate([np.arange(1, 400), (1.1 ** np.arange(50, 300)).astype(int)]))
    found = jaccard.rarity(counts)
    assert (np.diff(found.astype(int)) >= 0).all() and len(np.unique(found)) > 240 and (found[:190] == counts[:190]).all()


def test_nothing_is_joined_by_component(spark, monkeypatch):
    plans = []

    def kept(df, name, real=jaccard.materialize):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(jaccard, "materialize", kept)
    rows = variants()
    assert jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).count() == len(rows)
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line and "root" in line.split("Join", 1)[1].split("]")[0]]
    assert len(joins) <= 1  # the few components that are too large for a task, with their members' places
