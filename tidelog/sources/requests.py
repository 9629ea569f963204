"""Request facts: one row for each client request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import expressions as E
from tidelog.sources import changelog

VALUE_SIZE = 32


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as requests: outcomes and bodies follow from seq, latencies from value."""
    seq = F.col("event_id") + 1
    kind = F.col("event_type")
    op = F.when(kind == "error", "delete").when(kind == "view", "get").otherwise("put")
    status = F.when(seq % 50 == 7, 0).when(seq % 20 == 0, 503).when(seq % 20 == 1, 500).when((op == "get") & (seq % 3 == 0), 404).otherwise(200)
    error = F.when(seq % 150 == 7, "Get: context deadline exceeded (Client.Timeout exceeded)").when(seq % 150 == 57, "dial tcp: connection refused").when(seq % 50 == 7, "EOF")
    value = F.when(seq % 35 == 3, F.lit("stale")).otherwise(E.match_value(F.col("user_id"), VALUE_SIZE))
    body = (
        F.when(status == 0, F.lit(None).cast("string"))
        .when((status == 503) & (seq % 40 == 0), '{"error":"not leader"}')
        .when(status == 503, '{"error":"no available leader"}')
        .when((status == 500) & (seq % 60 == 1), '{"error":"request timeout"}')
        .when((status == 500) & (seq % 60 == 21), '{"error":"leadership changed before commit"}')
        .when(status == 500, '{"error":"disk"}')
        .when(status == 404, '{"error":"not found"}')
        .otherwise(F.concat(F.lit('{"value":"'), value, F.lit('"}')))
    )
    key = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    latency = F.floor(F.col("value") * 1000).cast("long") * 1000
    return changelog.table(spark, sf_dir, "events").select(
        seq.alias("seq"), "ts", op.alias("operation"), key.alias("key"), latency.alias("latency_ns"), status.cast("int").alias("http_status"), body.alias("body"), error.alias("network_error")
    )


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = changelog.table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("key"), E.match_value(F.col("user_id"), VALUE_SIZE).alias("expected"))
