"""A store of keys for programs: put, delete, get and metrics over the segments of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import segments, state
from tidelog.sources import binary
from tidelog.streaming.apply import SegmentSink


class Store:
    """One writer and any number of readers. Commands of a batch take effect together, when its segment is in the manifest.

    A batch is a table, so a program that has many commands gives them at once: put and delete are batches of one. The
    number of the last batch decides recency; a batch that is given again with its number replaces itself.
    """

    def __init__(self, spark: SparkSession, folder: str, threshold: int = 4, enable_compaction: bool = True):
        self.spark, self.sink = spark, SegmentSink(folder, threshold, enable_compaction)
        self.folder = folder

    def _next(self) -> int:
        """One more than the last batch that the manifest has."""
        listed = self.sink.manifest(self.spark)
        return 1 + max((int(x[1:].split("_")[-1].split("-")[0]) for x in listed), default=-1)

    def apply(self, commands: DataFrame, batch_id: int | None = None) -> int:
        """commands: seq, op (PUT or DELETE), key, value; within the batch seq decides. The batch's number."""
        bad = commands.where(F.col("key").isNull() | (F.col("key") == "") | ~F.col("op").isin("PUT", "DELETE") | ((F.col("op") == "PUT") & F.col("value").isNull()))
        if bad.limit(1).count():
            raise ValueError("a command needs a key, PUT or DELETE, and for PUT a value")
        number = self._next() if batch_id is None else batch_id
        self.sink(commands, number)
        return number

    def put(self, key: str, value: str) -> int:
        return self.apply(self.spark.createDataFrame([(1, "PUT", key, value)], "seq long, op string, key string, value string"))

    def delete(self, key: str) -> int:
        """A key that isn't there may be deleted too."""
        return self.apply(self.spark.createDataFrame([(1, "DELETE", key, None)], "seq long, op string, key string, value string"))

    def state(self) -> DataFrame:
        """key, value of all live keys."""
        return segments.visible(self.sink.read(self.spark))

    def get_many(self, keys: DataFrame, read_mode: str = "raft", snapshot: DataFrame | None = None) -> DataFrame:
        """key, value, found for every wanted key. raft sees all batches; local reads a snapshot (of state()), which may be behind."""
        wanted = keys.select("key").distinct()
        if read_mode == "local":
            if snapshot is None:
                raise ValueError("a local read needs a snapshot")
            held = snapshot.withColumn("found", F.lit(True))
        elif read_mode == "raft":
            own = self.sink.read(self.spark)
            held = segments.visible(own.join(wanted, "key", "left_semi")).withColumn("found", F.lit(True))
        else:
            raise ValueError(f"read_mode must be raft or local, not {read_mode!r}")
        return wanted.join(held, "key", "left").select("key", "value", F.coalesce("found", F.lit(False)).alias("found"))

    def get(self, key: str) -> str | None:
        """None if the key was never written or is deleted; the filter on the key reaches the scan."""
        own = self.sink.read(self.spark).where(F.col("key") == key)
        row = segments.visible(own).first()
        return None if row is None else row.value

    def metrics(self) -> DataFrame:
        """One row: segments, entries, tombstones, live keys and bytes of keys and values."""
        own = self.sink.read(self.spark)
        sums = own.agg(F.count("*").alias("entries"), F.count_if(~state.live()).alias("tombstones"), F.coalesce(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))), F.lit(0)).alias("bytes"))
        live = segments.visible(own).agg(F.count("*").alias("live"))
        return sums.join(F.broadcast(live)).select(F.lit(len(self.sink.manifest(self.spark))).cast("long").alias("segments"), "entries", "tombstones", "live", "bytes")

    def clear(self) -> None:
        """Forgets all: an empty manifest, then what it no longer lists."""
        binary.put_text(self.spark, f"{self.folder}/manifest", "")
        self.sink.vacuum(self.spark)
