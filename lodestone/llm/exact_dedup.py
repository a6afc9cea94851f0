"""Exact deduplication against a persistent digest index, in DataFrame operations only.

The index is a table bucketed and sorted by the SHA-256 of the normalised text. A batch is reduced to one row per digest
(map-side first, so a text that holds a third of all rows shuffles once per task), sort-merge anti-joined with the index,
and what is new is appended. No text is shuffled, only digests.

Defined results: a null text counts as the empty text; texts of any length are digested whole; an empty batch changes
nothing and returns no rows; of equal texts the smallest id stays (null ids last); rows repeated under one id, and all rows
with a null id where no other id has the text, share one outcome; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, normalised, own_table, partitions, remove, shared_dir


class DigestIndex:
    """A bucketed, sorted table of digests at a path that every executor reaches; an existing one is attached again.

    Columns: digest, keep_id (the id of the row that stayed), batch (the append that brought it).
    """

    def __init__(self, spark: SparkSession, path: str | None = None, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or own_table(f"digest_index_{uuid.uuid4().hex}")
        self.path = path or f"{shared_dir(spark)}/{self.name}"
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, fresh: DataFrame) -> None:
        """Add rows; dealt as the buckets are, so that each bucket gets one file an append."""
        rows = fresh.repartition(self.buckets, "digest").select("digest", "keep_id", "batch")
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate a batch within itself and against the index, and append its new digests.

    Returns, for every row of the batch: id, keep_id, group_size (rows of the batch with that text), kept (this batch brought
    the text and this is the row that stays), digest.
    """
    digests = materialize(docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest")), "digests")
    groups = materialize(digests.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("group_size")), "digest_groups")
    batch = uuid.uuid4().hex
    fresh = groups.join(index.table().select("digest").hint("merge"), "digest", "left_anti")
    index.append(fresh.select("digest", F.col("first_id").alias("keep_id"), F.lit(batch).alias("batch")))
    # Written and reread, so that both sides of the last join are dealt by their own exchange and a hot digest can be split.
    known = materialize(groups.hint("merge").join(index.table(), "digest").select("digest", "keep_id", "group_size", (F.col("batch") == batch).alias("fresh")), "digest_known")
    return digests.join(known.hint("merge"), "digest").select(
        "id", "keep_id", "group_size", (F.col("fresh") & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"), "digest"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of a table that stay, with all their columns: one for each text. Of rows repeated under its id, the least by their other columns
    (as JSON) and the text's hash stays, so the choice is the same in any run; null ids come last."""
    index = DigestIndex(docs.sparkSession, buckets=max(8, partitions(docs)))
    key = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    kept = deduplicate(docs, index, id_col, text_col).where("kept").select(key(F.col("id")).alias("__key"), F.col("digest").alias("__digest")).distinct()
    others = F.to_json(F.struct(F.lit(0).alias("c"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col)))
    rows = docs.select(
        F.struct("*").alias("row"), F.struct(others, F.xxhash64(F.col(text_col))).alias("__order"),
        key(F.col(id_col).cast("long")).alias("__key"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("__digest"),
    )
    # One exchange of the texts: the join and the removal of repeated rows deal by the same two columns.
    stay = rows.join(kept.hint("merge"), ["__key", "__digest"], "left_semi").groupBy("__key", "__digest").agg(F.min_by("row", "__order").alias("row"))
    return stay.select("row.*")
