"""Synthetic workloads and the settings of experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import expressions as E


READ_MODES = ("raft", "local")


def validate(total: int, write_ratio: float, delete_ratio: float, keyspace: int, value_size: int, concurrency: int = 1, read_mode: str = "raft", prefill: int = 0, warmup: int = 0, timeout: float = 5.0) -> None:
    """A ValueError that names the first setting that no run can have. No request at all (total 0) is allowed."""
    for name, value, least in (("concurrency", concurrency, 1), ("total", total, 0), ("keyspace", keyspace, 1), ("value_size", value_size, 1), ("prefill", prefill, 0), ("warmup", warmup, 0)):
        if value < least:
            raise ValueError(f"{name} must be at least {least}, not {value}")
    if not 0 <= write_ratio <= 1 or not 0 <= delete_ratio <= 1 or write_ratio + delete_ratio > 1:
        raise ValueError("write_ratio and delete_ratio must lie in 0 to 1, as must their sum")
    if read_mode not in READ_MODES:
        raise ValueError(f"read_mode must be one of {', '.join(READ_MODES)}, not {read_mode!r}")
    if timeout <= 0:
        raise ValueError(f"timeout must be greater than 0, not {timeout}")


def tasks(spark: SparkSession, total: int, write_ratio: float, delete_ratio: float, keyspace: int, value_size: int, seed: int) -> DataFrame:
    """seq, operation, key, value: operations drawn by their shares, keys evenly. The same seed and partitions give the same rows."""
    validate(total, write_ratio, delete_ratio, keyspace, value_size)
    drawn = spark.range(total).withColumns({"r": F.rand(seed), "k": F.floor(F.rand(seed + 1) * keyspace)})
    op = F.when(F.col("r") < write_ratio, "put").when(F.col("r") < write_ratio + delete_ratio, "delete").otherwise("get")
    return drawn.select((F.col("id") + 1).alias("seq"), op.alias("operation"), F.concat(F.lit("key_"), F.col("k").cast("string")).alias("key"), F.repeat(F.lit("v"), value_size).alias("value"))


def prefill(spark: SparkSession, keyspace: int, value_size: int) -> DataFrame:
    return spark.range(keyspace).select(F.concat(F.lit("key_"), F.col("id").cast("string")).alias("key"), F.repeat(F.lit("v"), value_size).alias("value"))


def with_ratios(cases: DataFrame) -> DataFrame:
    """Cases with the write and delete shares and prefill of their workload; an unknown workload is refused."""
    names = ["workload", "write_ratio", "delete_ratio", "prefill"]
    table = cases.sparkSession.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in E.WORKLOADS])))
    known = F.col("write_ratio").isNotNull()
    out = cases.join(F.broadcast(table), "workload", "left")  # a row for each named workload
    return out.withColumn("write_ratio", F.when(known, F.col("write_ratio")).otherwise(F.raise_error(F.concat(F.lit("unknown workload: "), F.col("workload"))).cast("double")))
