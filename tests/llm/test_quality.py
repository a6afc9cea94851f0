import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality
from lodestone.llm import queries as Q
from lodestone.llm.sums import dense, sparse, tree_sum


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in Q.op1_quality(spark, sf_dir).collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    right = [got[i].predicted == q for i, q in labels if got[i].held_out]
    assert np.mean(right) > 0.95


def test_normal_equations_match_numpy(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(["good" if rng.random() < 0.5 else "words"] * rng.integers(1, 9)) + ("!" * int(rng.integers(0, 9))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(t.count("!") < 3)) for i, t in enumerate(texts)], "doc_id long, quality int")
    model = quality.fit(quality.statistics(docs), labels, calibrate=F.col("id") % 4 == 0)
    x = np.array([quality.statistics_of(t.encode()) for t in texts], np.float32).astype(float)
    y = np.array([t.count("!") < 3 for t in texts], float)
    assert np.allclose(model.mean, x.mean(0))
    phi, take = model.features(x), np.arange(200) % 4 != 0
    d = quality.FEATURES + 1
    want = np.linalg.solve(phi[take].T @ phi[take] + quality.RIDGE * take.sum() * np.eye(d) / d, phi[take].T @ y[take])
    assert np.allclose(phi @ model.weights, phi @ want, atol=1e-6)
    assert (np.diff(model.values) > 0).all()


def test_edge_cases(spark):
    rows = [(1, None, "a", 1.0), (2, "", "b", 2.0), (3, "word " * 50_000, "c", 0.0), (3, "word " * 50_000, "c", 0.0), (None, "x", "d", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, score double")
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None), (2, 7), (None, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_keep_good_decides_as_classify_row_by_row(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    more = [(None, None, "en", "s", 0), (None, "", "en", "s", 0), (10**6, None, None, None, None), (10**6 + 1, "word " * 60_000, "en", "s", 1), (10**6 + 1, "$$$ ### !!!", "en", "s", 1), (10**6 + 2, "## && !! " * 500, None, "s", 1), (10**6 + 2, "## && !! " * 500, None, "s", 1)]
    every = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumns({"row": F.lit(1), "x": F.lit("x"), "id": F.lit(2), "batch": F.lit(None).cast("string"), "score": F.lit(0.5)})
    want = sorted((str(r.id), r.predicted) for r in quality.classify(every, labels).collect())
    kept = quality.keep_good(every, labels)
    assert kept.columns == every.columns
    got = sorted(str(r.doc_id) for r in kept.collect())
    assert got == sorted(i for i, p in want if p) and len(want) == every.count() and 0 < len(got) < len(want)
    assert quality.keep_good(every.limit(0), labels).count() == 0
    assert quality.keep_good(every, labels.limit(0)).count() == every.count()  # with no labels the score is 0.5


@pytest.mark.parametrize("n", [1, 40])
def test_tree_sum(spark, n):
    rows = spark.range(n * 30).repartition(n).mapInArrow(lambda it: (__import__("pyarrow").RecordBatch.from_pydict({"at": [int(i)], "sums": [np.array([float(i)]).tobytes()]}) for b in it for i in b["id"].to_pylist()), "at long, sums binary")
    assert tree_sum(rows, 1)[0] == sum(range(n * 30))


def test_isotonic():
    c, v = quality.isotonic(np.arange(4.0), np.array([2, 2, 0, 4.0]), np.array([1, 0, 0, 4.0]))
    assert v.tolist() == [0.25, 1.0] and c.tolist() == [0.5, 3.0]


def test_sparse_vectors_come_back():
    for v in (np.zeros(9), np.array([0, 3, 0, 0, 1e9, 1.0]), np.arange(5.0)):
        assert (dense(sparse(v)) == v).all()
