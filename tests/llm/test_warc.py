import base64
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries as Q
from lodestone.llm import warc
from lodestone.llm.common import new_folder
from tests.oracle import assert_same

SCHEMA = "page_id long, url string, html string, digest string, kind int, shard int"


def brute(rows):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {}
    for i, h in rows:
        first[digest(h)] = min(first.get(digest(h), i), i)
    return sorted((i, len((h or "").encode()), digest(h), "response" if first[digest(h)] == i else "revisit", None if first[digest(h)] == i else first[digest(h)]) for i, h in rows)


def test_query(spark, sf_dir):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert sorted(map(tuple, Q.op3_warc(spark, sf_dir).collect())) == brute(rows)


def test_edge_cases_rolling_and_determinism(spark):
    data = [(i, f"http://h/{i}", "same" if i % 3 else f"é{i}" * (i % 50), "d", 0, 9) for i in range(300)] + [(900 + i, None, None if i % 2 else "", "", 1, 1) for i in range(6)]
    data += [(10**12, "u", "x" * 400_000, "", 0, 0), (10**12 + 1, "u", "x", "", 0, 0)]
    docs = spark.createDataFrame(data, SCHEMA)
    contents = []
    for parts in (1, 7):
        folder = new_folder(spark, "warc_test")
        warc.write(docs.repartition(parts), folder, shard_bytes=3000, roll_bytes=1500)
        found = warc.read(spark, folder)
        assert sorted((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()) == brute([(r[0], r[2]) for r in data])
        root = folder.removeprefix("file://")
        assert not os.path.exists(f"{root}/_temporary")
        names = sorted(n for n in os.listdir(root) if n.endswith(".gz"))
        assert len(names) > 3 and names == sorted(r.file for r in warc.manifest(spark, folder).collect())
        contents.append([open(f"{root}/{n}", "rb").read() for n in names])
        assert gzip.decompress(contents[-1][0]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert contents[0] == contents[1]


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (None, "v", "b"), (None, "w", "b")]
    folder = new_folder(spark, "warc_test")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    got = sorted(((r.id, r.record_type, r.refers_to) for r in warc.read(spark, folder).collect()), key=str)
    assert got == sorted([(1, "response", None), (1, "revisit", 1), (None, "revisit", 1), (None, "response", None), (None, "revisit", None)], key=str)
    empty = new_folder(spark, "warc_test")
    warc.write(spark.createDataFrame([], SCHEMA), empty)
    assert warc.read(spark, empty).count() == 0


def test_cuts_refine_crowded_ids(spark):
    ids = spark.range(2000).select((F.col("id") * 3).alias("id")).union(spark.range(1).select(F.lit(2**62).alias("id"))).withColumn("size", F.lit(10))
    edges = warc.cuts(ids, 1000)
    assert 19 <= len(edges) <= 45 and edges == sorted(edges)


def test_damaged_file():
    whole = warc.response(1, "u", b"abc", "d", 6)
    assert [b for _, b in warc.parse(iter([whole[:20], whole[20:] + whole]))][0].endswith(b"abc")
    with pytest.raises(ValueError):
        list(warc.parse(iter([whole[:-9]])))


HOSTILE = ["http://a/\r\n\r\nb", "http://a/\r\nb", "x\r\nWARC-Type: revisit", " lead", "trail\t", "\n", "a%0D%0Ab", "é/\u3000", "\x85", "plain", 'quo"te\\', "tab\there", "\x00\x7f"]


def test_urls_of_any_characters_come_back(spark):
    rows = [(i, u, f"page {i % 4}") for i, u in enumerate(HOSTILE)]
    folder = new_folder(spark, "warc_test")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    got = {r.id: (r.url, r.record_type) for r in warc.read(spark, folder).collect()}
    assert got == {i: (u, "response" if i < 4 else "revisit") for i, u, _ in rows}
    root = folder.removeprefix("file://")
    for name in os.listdir(root):
        if name.endswith(".gz"):
            heads = [part.split(b"\r\n\r\n")[0] for part in gzip.open(f"{root}/{name}").read().split(b"WARC/1.1\r\n")[1:]]
            assert all(sum(line.startswith(b"WARC-Type:") for line in head.split(b"\r\n")) == 1 for head in heads)


def jobs(spark, run):
    group = new_folder(spark, "counted")
    spark.sparkContext.setJobGroup(group, group)
    run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return n


def test_cuts_take_as_many_jobs_for_crowded_ids(spark):
    even = spark.range(256).select("id", F.lit(100).alias("size"))
    crowded = spark.range(256).select((F.col("id") + F.when(F.col("id") % 7 == 0, 2**60).otherwise(F.col("id") * 2**40)).alias("id"), F.lit(100).alias("size"))
    counts = [jobs(spark, lambda d=d, n=n: warc.cuts(d, n)) for d in (even, crowded) for n in (10, 1000, 10**6)]
    assert max(counts) <= 12 and max(counts) - min(counts) <= 3, counts
    assert warc.cuts(even, 1000) == list(range(10, 256, 10))


def test_a_shared_id_is_cut(spark):
    rows = [(7, "u", f"{i} " * 100) for i in range(200)] + [(None, "n", f"n{i} " * 100) for i in range(100)]
    folder = new_folder(spark, "warc_test")
    shards = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), folder, shard_bytes=5000)
    assert shards.select("shard").distinct().count() > 10
    assert warc.read(spark, folder).count() == 300


def test_oracle(spark, sf_dir):
    assert_same(Q.op3_warc(spark, sf_dir), sf_dir, Q.OP3_SQL)
