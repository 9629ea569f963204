"""Text, JSON and CSV inputs of reports, and figures about files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_stats(spark: SparkSession, path: str, pattern: str = "*", node: str = r"(node_\d+)") -> DataFrame:
    """node, files, bytes; node is null in the row for all."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length")
    own = found.withColumn("node", F.regexp_extract("path", node, 1))
    return own.rollup("node").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def count_in_log(spark: SparkSession, path: str, word: str = "compaction") -> DataFrame:
    """One row: how often the word stands in the lines, in any case."""
    return spark.read.text(path).agg(F.coalesce(F.sum(F.regexp_count(F.lower("value"), F.lit(word.lower()))), F.lit(0)).cast("long").alias("n"))


def fields(lines: DataFrame, prefix: str, names: list[str]) -> DataFrame:
    """Lines such as 'prefix|a=1|b=2' as columns; lines without the prefix are left out, fields that lack are null."""
    kept = lines.where(F.col("value").contains(f"{prefix}|"))
    rest = F.expr(f"substring(value, instr(value, '{prefix}|') + {len(prefix) + 1})")
    pairs = F.str_to_map(rest, F.lit("\\|"), F.lit("="))
    return kept.select(*[pairs[n].alias(n) for n in names])


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.option("header", True).option("sep", sep).schema(schema).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One document in each file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


_RAFT = "current_term long, is_leader boolean, commit_index long, last_applied long, log_length long"
_LSM = (
    "compaction_enabled boolean, get_total long, get_sstable_files_touched_total long, get_sstable_files_touched_max long, "
    "compaction_total long, compaction_max_ms double, compaction_last_ms double, sstable_count long"
)
METRICS = f"timestamp string, request_total long, put_total long, get_total long, delete_total long, http_500_total long, http_503_total long, nodes array<struct<node_id: long, raft: struct<{', '.join(x.replace(' ', ': ') for x in _RAFT.split(', '))}>, lsm: struct<{', '.join(x.replace(' ', ': ') for x in _LSM.split(', '))}>>>"


def node_metrics(snapshots: DataFrame) -> DataFrame:
    """A row for each node of each snapshot."""
    each = snapshots.select("timestamp", F.explode("nodes").alias("n"))
    return each.select("timestamp", F.to_timestamp("timestamp").alias("ts"), F.col("n.node_id").alias("node"), F.col("n.raft.current_term").alias("term"), F.coalesce("n.raft.is_leader", F.lit(False)).alias("is_leader"), "n.lsm.*")
