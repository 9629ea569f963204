"""Change logs: one row per command, totally ordered by seq."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: op is PUT, DELETE or GET; value is null for a tombstone and '' for a live empty value.
COMMANDS = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("term", T.LongType()),
        T.StructField("op", T.StringType(), False),
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.StringType()),
        T.StructField("op_id", T.LongType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_of(table(spark, sf_dir, "events"))


def log_of(events: DataFrame) -> DataFrame:
    """Events as a log, batch or stream: clicks, purchases and signups write, errors delete, views read."""
    writes = F.col("event_type").isin("click", "purchase", "signup")
    return events.select(
        (F.col("event_id") + 1).alias("seq"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("key"),
        F.when(F.col("event_type") == "error", "DELETE").when(F.col("event_type") == "view", "GET").otherwise("PUT").alias("op"),
        F.when(writes, F.col("props")).alias("value"),
        F.col("value").alias("latency_ms"),
    )
