"""What the operators share: the folder that driver and executors both see, tables written there, text rules."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space that separates words.
WHITE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset on one machine (tests) a temporary one is set; on a cluster that is an error,
    as its executors wouldn't see a folder of the driver."""
    context = spark.sparkContext
    if not (base := spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='shared-')}")
        base = context.getCheckpointDir()
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_tables: list[str] = []


def own_table(name: str) -> str:
    """Note a catalog table that this process made for itself, for drop_tables()."""
    _tables.append(name)
    return name


def drop_tables(spark: SparkSession) -> None:
    """Take the catalog tables that this process made for itself out of the catalog, once their results have been used. Their files stay in the
    shared folder, for the cluster's clean-up."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def normalised(text: Column) -> Column:
    """Runs of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def fold(doc_id: Column, parts: int = 5) -> Column:
    """Fold of a document: crc32 of its id as text, modulo the number of folds. A null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts).cast("int")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame, text_col: str) -> int:
    """Stored bytes of the tables that a DataFrame reads. Where Spark doesn't know a table's size, the bytes of the texts, counted."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if max(sizes, default=0) < 1 << 60:
        return sum(sizes)
    return df.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
