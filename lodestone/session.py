"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Semantics, not tuning: backslashes in string literals are plain characters, arithmetic is ANSI,
#: plans adapt at run time (join strategy, skewed partitions, small partitions).
SEMANTIC_CONF = {
    "spark.sql.parser.escapedStringLiterals": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the engine's run-time settings to an existing session; sizes and memory stay the cluster's."""
    for key, value in SEMANTIC_CONF.items():
        spark.conf.set(key, value)
    return spark


def get_session(master: str = "local[*]", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Build or get a session; extra settings are passed as keyword arguments with dots as double underscores."""
    builder = SparkSession.builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())
