"""Catalog of registered tables: schemas, lookup and size statistics over Spark's session catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from lodestone.sources.parquet import TABLES, read_table


@dataclass(frozen=True)
class TableStats:
    """Planner statistics: rows (None when unknown) and the estimated size in bytes."""

    row_count: int | None
    size_bytes: int


def _schema(*columns: tuple[str, object, bool]) -> StructType:
    return StructType([StructField(name, kind, nullable) for name, kind, nullable in columns])


#: The sample catalog's schemas, with declared row count and bytes per row.
SAMPLE_TABLES = {
    "customers": (
        _schema(("id", LongType(), False), ("name", StringType(), False), ("email", StringType(), True), ("country", StringType(), True)),
        10_000, 128,
    ),
    "orders": (
        _schema(("id", LongType(), False), ("customer_id", LongType(), False), ("total", DoubleType(), False), ("status", StringType(), True)),
        500_000, 64,
    ),
    "products": (
        _schema(("id", LongType(), False), ("name", StringType(), False), ("price", DoubleType(), False)),
        2_000, 96,
    ),
}


class Catalog:
    """Names to lazily scanned tables. Names resolve as Spark resolves them, without regard to case."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._declared: dict[str, TableStats] = {}

    def register(self, name: str, source: str | DataFrame, schema: StructType | None = None, stats: TableStats | None = None) -> DataFrame:
        """Register a DataFrame, or the Parquet data at a path, under a name; a later registration replaces it."""
        frame = source if isinstance(source, DataFrame) else (self._spark.read.schema(schema) if schema else self._spark.read).parquet(source)
        frame.createOrReplaceTempView(name)
        self._declared.pop(name.lower(), None)
        if stats:
            self._declared[name.lower()] = stats
        return frame

    def register_dir(self, directory: str, names: tuple[str, ...] = TABLES) -> None:
        for name in names:
            self.register(name, read_table(self._spark, directory, name))

    def register_sample(self) -> None:
        """The sample schemas as empty tables, for planning against declared statistics."""
        for name, (schema, rows, width) in SAMPLE_TABLES.items():
            self.register(name, self._spark.createDataFrame([], schema), stats=TableStats(rows, rows * width))

    def get(self, name: str) -> StructType | None:
        """Schema of a table, None if it isn't registered."""
        return self._spark.table(name).schema if self._spark.catalog.tableExists(name) else None

    def column(self, table: str, name: str) -> StructField | None:
        schema = self.get(table)
        return next((f for f in schema.fields if f.name.lower() == name.lower()), None) if schema else None

    def stats(self, name: str) -> TableStats:
        """Declared statistics, or those Catalyst derives from file sizes (and ANALYZE, where run)."""
        if (found := self._declared.get(name.lower())) is not None:
            return found
        found = self._spark.table(name)._jdf.queryExecution().optimizedPlan().stats()
        rows = found.rowCount()
        return TableStats(int(str(rows.get())) if rows.isDefined() else None, int(str(found.sizeInBytes())))

    def tables(self) -> list[str]:
        return sorted(t.name for t in self._spark.catalog.listTables() if t.isTemporary)

    def drop(self, name: str) -> bool:
        self._declared.pop(name.lower(), None)
        try:
            return bool(self._spark.catalog.dropTempView(name))
        except AnalysisException:
            return False
