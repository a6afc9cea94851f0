import re

import corpus_pipeline
from pyspark.sql import functions as F

from lodestone.llm import quality
from lodestone.sources import read_table
from tests.llm.test_jaccard import brute
from tests.llm.test_packing import tokens, valid


def test_stages_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = read_table(spark, sf_dir, "documents")
    predicted = {r.id: r.predicted for r in quality.classify(docs, read_table(spark, sf_dir, "labels")).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if predicted[r.doc_id])
    seen, left = set(), []
    for i, t in rows:
        own = re.sub(r"[\x20\x09-\x0d]+", " ", t)
        if own not in seen:
            seen.add(own)
            left.append((i, t))
    root = {i: c for i, _, c in brute(left)}
    want = [(i, t) for i, t in left if root[i] == i]
    assert len(want) < len(left) < len(rows) < len(predicted)
    now = docs
    for (_, stage), expected in zip(corpus_pipeline.STAGES[:3], (rows, left, want), strict=True):
        now = stage(spark, now, sf_dir)
        assert now.columns == docs.columns
        assert sorted((r.doc_id, r.text) for r in now.collect()) == expected
    assert valid(corpus_pipeline.run(spark, sf_dir).collect(), tokens(want)) > 0.98


def test_edge_cases(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "a", "b", 0), (3, "a b c", "x", "y", 5), (3, "a b c", "x", "y", 5), (None, "a  b c", None, None, None), (4, "word " * 9000, "", "", 1)]
    docs, sf_dir = spark.createDataFrame(rows, schema), "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(spark, docs, sf_dir)
        assert docs.schema.simpleString() == spark.createDataFrame(rows, schema).schema.simpleString()
    assert sorted(r.doc_id for r in docs.collect()) == [1, 3, 4]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), sf_dir).count() == 0


def test_every_stage_on_clashing_columns_nulls_and_repeated_rows(spark):
    sf_dir = "/root/testdata/sf0.001"
    own = read_table(spark, sf_dir, "documents")
    schema = own.schema.simpleString()[7:-1].replace(":", " ")
    rows = [(None, None, None, None, None), (-1, "", "a", "b", 0), (-2, "alpha beta", "x", "y", 5), (-2, "alpha beta", "x", "y", 5), (-2, "gamma delta epsilon", "", "", 1), (-3, "word " * 40_000, "", "", 1)]
    names = ("row", "id", "digest", "n", "x", "group", "block", "__key", "__digest", "kept", "length", "words", "root")
    docs = own.unionByName(spark.createDataFrame(rows, schema)).withColumns({n: F.lit(i) for i, n in enumerate(names)})
    now, ids = docs, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, now = now, stage(spark, now, sf_dir)
        assert now.columns == docs.columns, name
        held = [tuple(r) for r in now.collect()]
        assert set(held) <= {tuple(r) for r in before.collect()} and held
    last = corpus_pipeline.STAGES[3][1](spark, now, sf_dir)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in now.select("doc_id").collect()} <= ids


def test_stages_state_their_defined_results():
    for _, stage in corpus_pipeline.STAGES:
        assert all(word in stage.__doc__ for word in ("null", "empty", "repeated")), stage.__name__
