"""Parquet source: one directory (or file) per table, opened through Spark's readers only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Tables of the test data.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, directory: str, name: str, schema: StructType | None = None) -> DataFrame:
    """Lazy scan of one table; Catalyst prunes columns and pushes filters into it."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{directory.rstrip('/')}/{name}.parquet")
