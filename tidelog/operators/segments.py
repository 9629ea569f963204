"""Sorted segments with zone maps: how a log falls into them, what reads touch, and what compaction changes.

A segment is a range of seqs of which each key keeps its last write. seg_order decides recency: later is newer. Compaction
merges the oldest segments and puts the result where they were, so older values never come to shadow newer ones.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.operators import state

ENTRY = ["key", "seq", "op", "value"]


def assign(log: DataFrame, size: int) -> DataFrame:
    """seg_order, key, seq, op, value: segments of so many commands, each key once in a segment."""
    own = log.withColumn("seg_order", F.floor((F.col("seq") - 1) / size))
    return state.latest(own, by=("seg_order", "key")).select("seg_order", *ENTRY)


def zone_maps(segments: DataFrame) -> DataFrame:
    """The catalog: a row for each segment."""
    return segments.groupBy("seg_order").agg(
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
        F.count("*").alias("row_count"),
        F.count_if(F.col("op") == "DELETE").alias("tombstones"),
        F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).alias("size_bytes"),
    )


def flush_bytes(log: DataFrame, size: int) -> DataFrame:
    """Bytes that each segment's commands wrote, before and after keys were collapsed."""
    n = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    raw = state.writes(log).groupBy(F.floor((F.col("seq") - 1) / size).alias("seg_order")).agg(F.sum(n).alias("written_bytes"))
    kept = assign(log, size).groupBy("seg_order").agg(F.sum(n).alias("kept_bytes"))
    return raw.join(kept, "seg_order")


def flush_boundaries(log: DataFrame, limit: int = 4096) -> DataFrame:
    """Segments by bytes, exactly as a memtable of limit bytes flushes: an overwrite changes its size by the difference.

    Where a segment begins follows from all before it, so a shard of the log (column shard, or the whole log where it has
    none) is one sequence in one task. It passes in batches; a task holds the sizes of one segment's keys.
    """

    def fold(batches):
        shard = None
        for batch in batches:
            out = []
            for s, key, value in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "value"))):
                if s != shard:
                    shard, held, size, segment = s, {}, 0, 0
                n = 0 if value is None else len(value.encode())
                size += n - held[key] if key in held else len(key.encode()) + n
                held[key] = n
                out.append(segment)
                if size >= limit:
                    held, size, segment = {}, 0, segment + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "seg_order"])

    own = state.writes(log).withColumn("shard", F.coalesce(F.col("shard").cast("long"), F.lit(-1)) if "shard" in log.columns else F.lit(0).cast("long"))
    rows = own.select("shard", F.col("seq").cast("long").alias("seq"), "key", "op", "value").repartition("shard").sortWithinPartitions("shard", "seq")
    return rows.mapInArrow(fold, "shard long, seq long, key string, op string, value string, seg_order long")


#: Ranges that keys, and blocks that segments, are dealt to where keys are counted against the ranges of segments.
RANGES = 256

#: Before every seg_order: counts all segments.
ALL = -(1 << 63)


def _cuts(values: list, ranges: int) -> list:
    """At most ranges - 1 values that cut all into about equal ranges."""
    found = sorted(values)
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def _samples(keys: DataFrame, zones: DataFrame, ranges: int) -> tuple[list[str], list[int]]:
    """Cuts of the keys, wanted ones and ends of segments, and of the segments, from samples of bounded size."""
    some = keys.select("key").distinct().orderBy(F.xxhash64("key")).limit(ranges * 16).collect()
    own = zones.orderBy(F.xxhash64("seg_order")).limit(ranges * 16).collect()
    ends = {z.min_key for z in own} | {z.max_key for z in own}
    names = [k for k in (*(r.key for r in some), *ends) if k is not None]
    return _cuts(names, ranges), _cuts([z.seg_order for z in own if z.seg_order is not None], ranges)


def _place(cuts: list, kind: str, c: Column) -> Column:
    """How many cuts are at c or before it (null: none), in two steps of about the root of their number."""
    step = math.isqrt(len(cuts)) + 1
    among = lambda found, of: F.size(F.filter(of(F.array(*[F.lit(x) for x in found]).cast(f"array<{kind}>")), lambda x: x <= c))
    coarse = among(cuts[step - 1 :: step], lambda a: a) * step
    return coarse + among(cuts, lambda a: F.slice(a, coarse + 1, F.lit(step)))


def _holders(wanted: DataFrame, zones: DataFrame, cuts: tuple[list[str], list[int]]) -> DataFrame:
    """key, hit, n: the segments from seg_order hit on whose range holds the key. wanted has key and hit, each row once.

    They are counted, never listed: the segments that begin at the key or before it, less those that end before it. Of these
    ends, a task for each range of keys counts those in its range, and one for each block of segments, from the newest on,
    those in the ranges before. A row goes to one task of each kind, however many segments hold a key.
    """
    names, orders = cuts
    span, block = _place(names, "string", F.col("key")), _place(orders, "bigint", F.col("seg"))
    n_ranges, n_blocks = len(names) + 1, len(orders) + 1

    # At one key, segments begin before it is asked for (step 1) and end after that (step 3).
    start = F.struct(F.col("min_key").alias("key"), F.lit(1).cast("long").alias("n"), F.lit(1).alias("step"))
    end = F.struct(F.col("max_key").alias("key"), F.lit(-1).cast("long").alias("n"), F.lit(3).alias("step"))
    known = zones.where(F.col("seg_order").isNotNull() & F.col("min_key").isNotNull())
    ends = known.select(F.col("seg_order").cast("long").alias("seg"), F.inline(F.array(start, end))).withColumns({"range": span, "block": block})
    asked = wanted.select("key", F.col("hit").cast("long").alias("seg"), F.lit(None).cast("long").alias("n"), F.lit(2).alias("step")).withColumn("range", span)

    # What newer blocks have of each range: ranges times blocks rows at most, with a row for each so that none is left out.
    grid = zones.sparkSession.range(n_ranges * n_blocks).select((F.col("id") % n_ranges).cast("int").alias("range"), F.floor(F.col("id") / n_ranges).cast("int").alias("block"), F.lit(0).cast("long").alias("n"))
    cells = ends.select("range", "block", "n").unionByName(grid).groupBy("range", "block").agg(F.sum("n").alias("n"))
    newer = Window.partitionBy("range").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    newer = cells.select("block", F.lit((1 << 63) - 1).alias("seg"), "range", F.sum("n").over(newer).alias("n")).where("n <> 0")

    def ranges_before(batches):
        place = None
        for batch in batches:
            out = []
            for b, seg, r, n, asks in zip(*(batch.column(c).to_pylist() for c in ("block", "seg", "range", "n", "asks"))):
                if b != place:
                    place, held = b, [0] * n_ranges
                if asks:
                    out.append((r, seg, sum(held[:r])))
                else:
                    held[r] += n
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["range", "seg", "n"])

    # Counted, not only made distinct: else Spark leaves out that keys are distinct already, and places each of their copies.
    pairs = asked.groupBy("range", "seg").agg(F.count("*").alias("asks")).withColumns({"block": block, "n": F.lit(0).cast("long")})
    rows = ends.select("block", "seg", "range", "n").unionByName(newer).withColumn("asks", F.lit(0).cast("long")).unionByName(pairs)
    before = rows.repartition("block").sortWithinPartitions("block", F.desc("seg"), "asks").mapInArrow(ranges_before, "range int, seg long, n long")

    def in_range(batches):
        place = None
        for batch in batches:
            out = []
            for r, key, step, seg, n in zip(*(batch.column(c).to_pylist() for c in ("range", "key", "step", "seg", "n"))):
                if r != place:
                    place, base, count, held = r, {}, [0] * n_blocks, defaultdict(lambda: ([], []))
                if step == 0:
                    base[seg] = n
                    continue
                b = bisect_right(orders, seg)
                if step == 2:
                    starts, stops = held[b] if b in held else ([], [])
                    own = len(starts) - bisect_left(starts, seg) - len(stops) + bisect_left(stops, seg)
                    out.append((key, seg, base[seg] + sum(count[b + 1 :]) + own))
                else:
                    insort(held[b][n < 0], seg)
                    count[b] += n
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["key", "hit", "n"])

    first = before.select("range", F.lit(None).cast("string").alias("key"), F.lit(0).alias("step"), "seg", "n")
    rows = first.unionByName(ends.select(*first.columns)).unionByName(asked.select(*first.columns))
    return rows.repartition("range").sortWithinPartitions("range", F.asc_nulls_first("key"), "step").mapInArrow(in_range, "key string, hit long, n long")


def read_amplification(segments: DataFrame, keys: DataFrame, ranges: int = RANGES) -> DataFrame:
    """For each key: segments whose range holds it and that a read touches, newest first, until one has it."""
    zones = zone_maps(segments).select("seg_order", "min_key", "max_key")
    newest = segments.groupBy("key").agg(F.max("seg_order").alias("hit"))
    wanted = keys.select("key").distinct()
    asked = wanted.join(newest, "key", "left").select("key", F.coalesce("hit", F.lit(ALL)).alias("hit"))
    held = _holders(asked, zones, _samples(wanted, zones, ranges))
    return held.select("key", F.col("n").alias("touched"), (F.col("hit") != ALL).alias("found"))


def prune_ratio(segments: DataFrame, keys: DataFrame, ranges: int = RANGES) -> DataFrame:
    """For each key: segments that the zone maps leave out, of all."""
    zones = zone_maps(segments).select("seg_order", "min_key", "max_key")
    total = zones.agg(F.count("*").alias("segments"))  # one row
    wanted = keys.select("key").distinct()
    held = _holders(wanted.withColumn("hit", F.lit(ALL)), zones, _samples(wanted, zones, ranges))
    return held.join(F.broadcast(total)).select("key", (F.col("segments") - F.col("n")).alias("pruned"), "segments")


def merge(segments: DataFrame, drop_tombstones: bool = False) -> DataFrame:
    """Segments as one: of each key the entry of the newest segment. Tombstones may only go if no older segment is left."""
    first = F.max_by(F.struct("seq", "op", "value"), "seg_order").alias("w")
    out = segments.groupBy("key").agg(first).select("key", "w.seq", "w.op", "w.value")
    return out.where(state.live()) if drop_tombstones else out


def oldest(segments: DataFrame, count: int = 4) -> DataFrame:
    """seg_order of the oldest segments, none if there are fewer than count."""
    order = segments.select("seg_order").distinct()
    first = order.orderBy("seg_order").limit(count)
    enough = order.agg((F.count("*") >= count).alias("enough"))
    return first.join(F.broadcast(enough)).where("enough").select("seg_order")


def compact_oldest(segments: DataFrame, count: int = 4) -> DataFrame:
    """Only the merged segment; seg_order is that of the newest input, so everything newer still shadows it."""
    picked = oldest(segments, count)
    inputs = segments.join(F.broadcast(picked), "seg_order", "left_semi")
    place = picked.agg(F.max("seg_order").alias("seg_order"))
    return merge(inputs).join(F.broadcast(place)).select("seg_order", *ENTRY)


def compacted(segments: DataFrame, count: int = 4, at_tail: bool = False) -> DataFrame:
    """All segments after one round. at_tail installs the output as the newest, which is wrong and here to be measured."""
    picked = oldest(segments, count)
    rest = segments.join(F.broadcast(picked), "seg_order", "left_anti")
    out = compact_oldest(segments, count)
    if at_tail:
        newest = segments.agg((F.max("seg_order") + 1).alias("seg_order"))
        out = out.drop("seg_order").join(F.broadcast(newest)).select("seg_order", *ENTRY)
    return rest.select("seg_order", *ENTRY).unionByName(out)


def visible(segments: DataFrame) -> DataFrame:
    """What reads see: of each key the newest segment's entry, without tombstones."""
    return merge(segments, drop_tombstones=True).select("key", "value")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows only a or only b has."""
    left = a.exceptAll(b).agg(F.count("*").alias("only_before"))
    return left.join(F.broadcast(b.exceptAll(a).agg(F.count("*").alias("only_after"))))


def order_anomaly(segments: DataFrame, count: int = 4) -> DataFrame:
    """One row: keys whose value would be stale, and deleted keys that would return, if the output went to the tail."""
    right = merge(segments).select("key", F.col("seq").alias("right_seq"), F.col("op").alias("right_op"))
    wrong = merge(compacted(segments, count, at_tail=True)).select("key", "seq", "op")
    both = right.join(wrong, "key")
    return both.agg(
        F.count("*").alias("n_keys"),
        F.count_if(F.col("seq") < F.col("right_seq")).alias("stale"),
        F.count_if((F.col("op") == "PUT") & (F.col("right_op") == "DELETE")).alias("resurrected"),
    )


def schedule(segments: DataFrame, count: int = 4) -> DataFrame:
    """Rounds of compaction if count segments are merged whenever there are as many: inputs and bytes of each round.

    After its round, a merged segment is the oldest input of the next; so round r reads the first count + r * (count - 1) segments.
    """
    zones = zone_maps(segments)
    place = zones.withColumn("place", F.row_number().over(Window.orderBy("seg_order")) - 1)  # a row for each segment
    own = F.when(F.col("place") < count, F.lit(0)).otherwise(F.floor((F.col("place") - 1) / (count - 1))).cast("long")
    full = place.withColumn("round", own).groupBy("round").agg(F.count("*").alias("n"), F.sum("row_count").alias("new_rows"), F.sum("size_bytes").alias("new_bytes"))
    return full.where(F.col("n") == F.when(F.col("round") == 0, count).otherwise(count - 1)).select("round", F.lit(count).cast("long").alias("inputs"), "new_rows", "new_bytes")


def recover(log: DataFrame, size: int, cut: int) -> DataFrame:
    """The state from segments up to cut and the log after it; equals the final state."""
    flushed = assign(log.where(F.col("seq") <= cut), size).select(*ENTRY)
    tail = state.writes(log).where(F.col("seq") > cut).select(*ENTRY)
    return state.final_state(flushed.unionByName(tail))


def manifest_order(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """File ids in table order: as the last line of the manifest that isn't blank lists them, unlisted files after them.

    manifest: line_no, value. files: file_id. Ids that can't be read and ids without a file are left out.
    """
    last = manifest.where(F.trim("value") != "").agg(F.max_by("value", "line_no").alias("value"))
    listed = last.select(F.posexplode(F.split("value", ",")).alias("pos", "id")).select(F.col("pos").cast("long"), F.expr("try_cast(trim(id) AS BIGINT)").alias("file_id"))
    listed = listed.groupBy("file_id").agg(F.min("pos").alias("pos"))
    known = files.select("file_id").distinct().join(listed, "file_id", "left")
    return known.select("file_id", F.row_number().over(Window.orderBy(F.col("pos").asc_nulls_last(), "file_id")).alias("place"))
