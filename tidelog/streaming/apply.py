"""Continuous apply: a stream of commands becomes keyed state, or segments with a catalog."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidelog.operators import segments, state
from tidelog.sources import binary, changelog

STATE = "key string, seq long, op string, value string"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a temporary one in local mode, and an error on a
    cluster, whose executors would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidelog-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class LastWrite(StatefulProcessor):
    """Keeps the write with the highest seq. Rows may come late, twice or out of order; an older seq is ignored."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("value", T.StringType())]))

    def handleInputRows(self, key, rows, timerValues):
        from pyspark.sql import Row

        seq, op, value = self.last.get() if self.last.exists() else (-1, None, None)
        before = seq
        for row in rows:
            if row.op != "GET" and row.seq > seq:
                seq, op, value = row.seq, row.op, row.value
        if seq > before:
            self.last.update((seq, op, value))
            yield Row(key=key[0], seq=seq, op=op, value=value)

    def close(self) -> None:
        pass


def last_writes(log: DataFrame) -> DataFrame:
    """A streaming log's changes of state: each batch gives the keys that it changed."""
    rows = log.select("key", F.col("seq").cast("long").alias("seq"), "op", "value")
    return rows.groupBy("key").transformWithState(LastWrite(), STATE, "Update", "None")


def final_state_stream(log: DataFrame) -> DataFrame:
    """The same by a built-in aggregate, for sinks that take complete or update mode."""
    newest = F.max_by(F.struct("seq", "op", "value"), "seq").alias("w")
    return state.writes(log).groupBy("key").agg(newest).select("key", "w.seq", "w.op", "w.value")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = changelog.table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)
    return changelog.log_of(raw)


def replay_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, applied until it ends; the state that is left."""
    out = shared_folder(spark, "stream-state")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/state/batch={batch_id}")  # a repeated batch replaces itself

    run = final_state_stream(events_stream(spark, sf_dir)).writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(save).start()
    run.awaitTermination()
    changes = spark.read.parquet(f"{out}/state")
    last = changes.groupBy("key").agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("w"))
    return last.where(state.live(F.col("w.op"))).select("key", "w.value", "w.seq")


class SegmentSink:
    """foreachBatch: each micro-batch is flushed as sorted segments of about flush_bytes; whenever there are as many as
    threshold, the oldest of them are merged into one.

    A manifest lists the segments, oldest first. Each change is a new manifest that takes the old one's place at once: a
    flush adds segments at the end, a merge puts its output where its inputs were. A segment that no manifest lists is
    garbage, of a batch or a merge that broke off or of inputs that were merged, and vacuum removes it. A batch that is
    repeated replaces what it wrote. A merge reads threshold segments, never all.
    """

    def __init__(self, folder: str, threshold: int = 4, enable_compaction: bool = True, flush_bytes: int = 64 << 20):
        self.folder, self.threshold, self.enabled, self.flush_bytes = folder, threshold, enable_compaction, flush_bytes

    def manifest(self, spark: SparkSession) -> list[str]:
        """Names of the segments, oldest first: b<batch>-<part>, or m<first>_<last> for a merge."""
        lines = binary.read_manifest(spark, f"{self.folder}/manifest").collect()
        return [x for r in lines for x in r.value.split(",") if x]

    def _commit(self, spark: SparkSession, listed: list[str]) -> None:
        binary.put_text(spark, f"{self.folder}/manifest", ",".join(listed))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = state.writes(batch)
        size, low, high = rows.agg(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))), F.min("seq"), F.max("seq")).first()
        if size is None:
            return
        parts = -(-size // self.flush_bytes)
        cuts = rows.select(F.col("seq").cast("double").alias("s")).stat.approxQuantile("s", [i / parts for i in range(1, parts)], 0.01) if parts > 1 else []
        listed = [x for x in self.manifest(spark) if not x.startswith(f"b{batch_id:09d}-")]
        edges = [low, *sorted({int(c) for c in cuts if low < c <= high}), high + 1]
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            listed.append(f"b{batch_id:09d}-{i:05d}")
            own = state.latest(rows.where((F.col("seq") >= a) & (F.col("seq") < b))).select(*segments.ENTRY)
            own.sortWithinPartitions("key").write.mode("overwrite").parquet(f"{self.folder}/{listed[-1]}")
        merged = {x for x in listed if x.startswith("m")}
        if not any(_covers(x, batch_id) for x in merged):  # a batch that is repeated after its merge is in it already
            self._commit(spark, listed)
        while self.enabled and len(self.manifest(spark)) >= self.threshold:
            self.compact(spark)
        self.vacuum(spark)

    def read(self, spark: SparkSession, names: list[str] | None = None) -> DataFrame:
        """Entries of the listed segments with seg_order, their place in the manifest."""
        listed = self.manifest(spark) if names is None else names
        schema = "key string, seq long, op string, value string"
        if not listed:
            return spark.createDataFrame([], f"seg_order long, {schema}")
        place = F.array_position(F.array(*[F.lit(x) for x in listed]), F.regexp_extract(F.input_file_name(), r"/([bm][^/]*)/[^/]*$", 1)) - 1
        return spark.read.schema(schema).parquet(*[f"{self.folder}/{x}" for x in listed]).select(place.cast("long").alias("seg_order"), *segments.ENTRY)

    def compact(self, spark: SparkSession) -> None:
        """Merges the oldest threshold segments. A tombstone may go, as no older segment is left."""
        listed = self.manifest(spark)
        inputs = listed[: self.threshold]
        out = f"m{_ends(inputs[0])[0]}_{_ends(inputs[-1])[1]}"
        merged = segments.merge(self.read(spark, inputs), drop_tombstones=True)
        merged.sortWithinPartitions("key").write.mode("overwrite").parquet(f"{self.folder}/{out}")
        self._commit(spark, [out, *listed[self.threshold :]])

    def vacuum(self, spark: SparkSession) -> list[str]:
        """Removes segments that the manifest doesn't list; readers that began before the last change must be done."""
        gone = sorted(set(x for x in binary.names(spark, self.folder) if x[0] in "bm" and x != "manifest") - set(self.manifest(spark)))
        for x in gone:
            at, fs = binary._folder(spark, f"{self.folder}/{x}")
            fs.delete(at, True)
        return gone


def _ends(name: str) -> tuple[str, str]:
    """The first and the last flushed segment in a segment, such as 000000003-00000."""
    return tuple(name[1:].split("_")) if name.startswith("m") else (name[1:], name[1:])


def _covers(merged: str, batch_id: int) -> bool:
    first, last = (int(x.split("-")[0]) for x in _ends(merged))
    return first <= batch_id <= last


def replay_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "stream-segments")
    sink = SegmentSink(f"{out}/segments")
    run = events_stream(spark, sf_dir).writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    run.awaitTermination()
    return segments.visible(sink.read(spark))


def replay_flushes(spark: SparkSession, sf_dir: str, flush_bytes: int) -> SegmentSink:
    """The events as a stream into a sink that flushes by size; the sink."""
    out = shared_folder(spark, "stream-flushes")
    sink = SegmentSink(f"{out}/segments", flush_bytes=flush_bytes)
    run = events_stream(spark, sf_dir).writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    run.awaitTermination()
    return sink


def replay_with_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the events, a stop, and the other half with a tenth of the first again, from the checkpoint; the state that is left."""
    out = shared_folder(spark, "stream-restart")
    events = changelog.log_of(changelog.table(spark, sf_dir, "events")).select("key", "seq", "op", "value")
    schema, middle = events.schema, events.agg(F.max("seq")).first()[0] // 2

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/state/batch={batch_id}")

    for half in (F.col("seq") <= middle, (F.col("seq") > middle) | (F.col("seq") % 10 == 0)):
        events.where(half).write.mode("append").parquet(f"{out}/source")
        log = spark.readStream.schema(schema).parquet(f"{out}/source")
        run = final_state_stream(log).writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(save).start()
        run.awaitTermination()
    changes = spark.read.parquet(f"{out}/state")
    last = changes.groupBy("key").agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("w"))
    return last.where(state.live(F.col("w.op"))).select("key", "w.value", "w.seq")


def replay_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as binary log files, read as a stream and applied; the state that is left."""
    out = shared_folder(spark, "stream-log-files")
    binary.write_log(changelog.from_events(spark, sf_dir), f"{out}/logs", files=3)
    rows = binary.as_log(binary.stream_log(spark, f"{out}/logs", strict=True))
    # files may come in any order, so recency is that of seq, which a state of the last writes keeps
    checkpoint = f"{out}/checkpoint"

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/state/batch={batch_id}")

    run = final_state_stream(rows).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    run.awaitTermination()
    last = spark.read.parquet(f"{out}/state").groupBy("key").agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("w"))
    return last.where(state.live(F.col("w.op"))).select("key", "w.value")
