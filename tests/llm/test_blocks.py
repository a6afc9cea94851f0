import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import blocks, bpe, common, exact_dedup
from lodestone.llm import queries as Q


def docs_of(spark, n, parts=8):
    word = F.concat(F.lit("w"), F.pmod(F.xxhash64("id", "k"), F.lit(5000)).cast("string"))
    rows = spark.range(n).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(60)))).groupBy("id").agg(F.concat_ws(" ", F.collect_list(word)).alias("text"))
    return rows.withColumnRenamed("id", "doc_id").repartition(parts, "doc_id")


def test_groups_spread_evenly_and_by_the_tables_own_hash(spark):
    ids = [blocks.group_id(p, k, 51) for p in range(37) for k in range(3)]
    assert len(set(ids)) == len(ids) and all(i % 256 == 0 for i in ids)
    real = spark.createDataFrame([(i,) for i in ids], "g long").select(F.hash("g").alias("h")).collect()
    assert [r.h for r in real] == [blocks._murmur(i) for i in ids]
    assert np.bincount([blocks._murmur(i) % 51 for i in ids], minlength=51).max() <= 5


def test_blocks_of_a_task_share_a_dictionary(spark):
    docs = docs_of(spark, 600, 2)
    made = blocks.write_blocks(docs, block_bytes=4000, share=5)
    rows = made.table.select("group", "block", "tokens", "n_words", F.col("words").isNotNull().alias("last")).collect()
    assert len(rows) > 20 and sum(r.tokens for r in rows) == 600 * 61 == made.tokens
    by_group = {g: sorted((r.block, r.last) for r in rows if r.group == g) for g in {r.group for r in rows}}
    assert all(len(x) <= 5 and [last for _, last in x] == [False] * (len(x) - 1) + [True] for x in by_group.values())
    assert made.groups == len(by_group)


def test_buckets_are_ranges_of_equal_width():
    hashes = np.sort(np.random.default_rng(0).integers(0, 1 << 32, 50_000, dtype=np.uint32))
    for n in (1, 2, 7, 51, 1000):
        got = blocks.spans(hashes, n)
        assert [b for b, _, _ in got] == list(range(n)) and got[0][1] == 0 and got[-1][2] == len(hashes)
        assert all(a[2] == b[1] for a, b in zip(got, got[1:])) and max(e - s for _, s, e in got) < 2 * len(hashes) / n + 50
        assert all((hashes[s:e].astype(np.uint64) * n >> np.uint64(32) == b).all() for b, s, e in got)
    assert blocks.spans(hashes[:0], 5) == []


def test_messages_grow_no_faster_than_the_input(spark):
    sent = []
    for n in (1200, 4800):  # with enough words for a bucket in each partition
        made = blocks.write_blocks(docs_of(spark, n, n // 100), block_bytes=8000)
        answers = made.answers(lambda words, _: lambda at: b"x" * len(at))
        sent.append((answers.count(), made.groups))
    assert sent[1][0] <= 4.4 * sent[0][0] and sent[1][1] == 4 * sent[0][1]


@pytest.mark.parametrize(("share", "size"), [(1, 10), (3, 1000), (8, 1 << 20)])
def test_results_do_not_depend_on_blocks(spark, share, size):
    docs = docs_of(spark, 200, 3).withColumn("text", F.when(F.col("doc_id") % 50 == 0, None).otherwise(F.col("text")))
    made, definition = blocks.write_blocks(docs, block_bytes=size, share=share), Q.word_bpe()
    import pyarrow as pa

    def consume(ids, flat, ends):
        return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "ids": pa.array([x.tolist() for x in np.split(flat, ends[:-1])], pa.list_(pa.int32()))})

    got = {r.id: r.ids for r in bpe.map_ids(docs, definition, consume, "id long, ids array<int>", blocks=made).collect()}
    assert got == {r.doc_id: bpe.load(definition).encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}


def test_tables_leave_the_catalog(spark):
    blocks.write_blocks(docs_of(spark, 10, 1))
    exact_dedup.DigestIndex(spark)
    exact_dedup.DigestIndex(spark, name="digest_index_to_keep")
    own = ("blocks_", "digest_index_")
    assert len({p for t in spark.catalog.listTables() for p in own if t.name.startswith(p)}) == 2
    common.drop_tables(spark)
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith(own)] == ["digest_index_to_keep"]
    exact_dedup.DigestIndex(spark, name="digest_index_to_keep").drop()


def test_sizes_of_tables_that_spark_does_not_know(spark):
    docs = docs_of(spark, 30, 2)
    assert common.input_bytes(docs, "text") == docs.agg(F.sum(F.octet_length("text"))).first()[0] or common.input_bytes(docs, "text") < 1 << 30
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    joined = table.join(table.select("doc_id"), "doc_id")
    assert common.input_bytes(joined, "text") < 4 * common.input_bytes(table, "text")
