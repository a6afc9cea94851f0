import hashlib

from pyspark.sql import functions as F

from lodestone.llm import exact_dedup as D
from lodestone.llm import queries as Q
from tests.oracle import assert_same

SCHEMA = "doc_id long, text string, digest string, keep_id int"


def test_oracle(spark, sf_dir):
    assert_same(Q.op8_exact_dedup(spark, sf_dir), sf_dir, Q.OP8_SQL)


def test_edge_cases_and_second_batch(spark):
    rows = [(5, "a  b", "x", 1), (3, "a\t\nb", "y", 2), (4, None, None, None), (9, "", "", 0), (7, "long " * 100_000, "", 0), (8, "a\u00a0b", "", 0), (8, "a\u00a0b", "", 0), (None, "a b", "", 0)]
    index = D.DigestIndex(spark, buckets=4)
    got = {(r.id, r.digest.hex()): (r.keep_id, r.group_size, r.kept) for r in D.deduplicate(spark.createDataFrame(rows, SCHEMA), index).collect()}
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {
        (5, h("a b")): (3, 3, False), (3, h("a b")): (3, 3, True), (None, h("a b")): (3, 3, False), (4, h("")): (4, 2, True), (9, h("")): (4, 2, False),
        (7, h("long " * 100_000)): (7, 1, True), (8, h("a\u00a0b")): (8, 2, True),
    }
    again = D.deduplicate(spark.createDataFrame([(1, "a b"), (2, "new"), (3, "a b")], "doc_id long, text string"), D.DigestIndex(spark, index.path, index.name, 4))
    assert {tuple(r) for r in again.select("id", "keep_id", "group_size", "kept").collect()} == {(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, False)}
    assert index.table().count() == 5
    index.drop()


def test_empty_and_keep_first(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert D.deduplicate(empty, D.DigestIndex(spark)).count() == 0
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"), F.lit(1).alias("id"))
    assert D.keep_first(docs).count() == 2001
    assert D.keep_first(docs).columns == docs.columns


def test_native_and_sort_merge(spark, sf_dir):
    plan = Q.op8_exact_dedup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Python" not in plan


def test_keep_first_chooses_the_same_of_rows_that_share_id_and_text(spark):
    rows = [(1, "a  b", f"k{i}", i % 3) for i in range(12)] + [(1, "a b", "k0", 0), (None, "n", "z", 1), (None, "n", "y", 1), (None, None, "x", 0), (4, "", "w", 0), (2, "a\tb", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, __key int")
    got = {tuple(map(str, sorted(map(str, map(tuple, D.keep_first(docs.repartition(n)).collect()))))) for n in (1, 3, 8)}
    assert len(got) == 1
    assert sorted(map(tuple, D.keep_first(docs).collect()), key=str) == sorted([(1, "a b", "k0", 0) if ("(1, 'a b'" in str(got)) else (1, "a  b", "k0", 0), (None, "n", "y", 1), (4, "", "w", 0)], key=str)
