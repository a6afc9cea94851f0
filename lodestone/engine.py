"""SQL front door: text to DataFrame, with a query-only guard and plan inspection."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame, SparkSession

from lodestone.catalog import Catalog
from lodestone.plans.guard import parse_query
from lodestone.session import configure
from lodestone.sources.parquet import TABLES


class Engine:
    """A session with its catalog. ``sql`` returns lazy DataFrames; nothing runs before an action."""

    def __init__(self, spark: SparkSession):
        self.spark = configure(spark)
        self.catalog = Catalog(spark)

    @classmethod
    def over(cls, spark: SparkSession, directory: str, names: tuple[str, ...] = TABLES) -> Engine:
        """Engine with the named tables of a data directory registered."""
        engine = cls(spark)
        engine.catalog.register_dir(directory, names)
        return engine

    def sql(self, text: str) -> DataFrame:
        parse_query(self.spark, text)
        return self.spark.sql(text)

    def explain(self, text: str, mode: str = "formatted") -> str:
        """Plans of a query: simple, extended, codegen, cost or formatted."""
        frame, out = self.sql(text), io.StringIO()
        with contextlib.redirect_stdout(out):
            frame.explain(mode=mode)
        return out.getvalue()

    def logical_plan(self, text: str) -> str:
        """The analyzed logical plan."""
        return self.sql(text)._jdf.queryExecution().analyzed().toString()
