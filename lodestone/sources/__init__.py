from lodestone.sources.parquet import TABLES, read_table

__all__ = ["TABLES", "read_table"]
