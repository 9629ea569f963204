"""Packing of token sequences: large pieces are matched in pairs, small ones fill the gaps that fit them best.

A plan needs only how many pieces there are of each length, at most as many numbers as a sequence has tokens. It is made
from those counts; pieces then find their places in it by their rank among pieces of their length, which is the sum of
a rank within a small bucket and the sizes of the buckets before it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm import bpe, shared, textscan

#: Pieces in a bucket, on average.
BUCKET = 5_000
#: Buckets of a length whose sizes are added up in one task.
SPAN = 4096
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(file: str, end_id: int, capacity: int):
    def run(batches):
        enc = bpe.encoder(file)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), textscan.strings(batch.column(1))
            for a, b, ids, count in enc.batches(texts):
                ids = np.insert(ids, np.cumsum(count), end_id).astype("<u4")
                count = count + 1
                k = -(-count // capacity)
                doc = np.repeat(np.arange(b - a), k)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
                head = (count - (k - 1) * capacity)[doc]
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                length = np.where(piece == 0, head, capacity)
                data, at = ids.tobytes(), ((np.cumsum(count) - count)[doc] + start) * 4
                crc = [zlib.crc32(data[x : x + n]) for x, n in zip(at.tolist(), (length * 4).tolist())]
                own = [docs[a + i] for i in doc.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, file: str, end_id: int, capacity: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece. Only documents longer than capacity are cut, and only their first piece may be shorter than it."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(shared.lean(_cut(file, end_id, capacity)), _PIECES)


class _Gaps:
    """Groups of alike bins by the room they have left: (bins, [(length, times), ...])."""

    def __init__(self, capacity: int):
        self.capacity, self.by_gap = capacity, [[] for _ in range(capacity + 1)]

    def put(self, bins: int, gap: int, holds: list[tuple[int, int]]) -> None:
        if bins:
            self.by_gap[gap].append((bins, holds))

    def tightest(self, length: int) -> int | None:
        return next((g for g in range(length, self.capacity + 1) if self.by_gap[g]), None)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of bins that hold the same lengths: (bins, [(length, times), ...])."""
    left, gaps = dict(counts), _Gaps(capacity)
    full = left.pop(capacity, 0)
    gaps.put(full, 0, [(capacity, 1)])
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for i in large:
        while left[i]:
            # the largest partner that fits; two large pieces leave room for no third
            j = next((n for n in large if n <= i and n + i <= capacity and left[n] > (n == i)), None)
            if j is None:
                gaps.put(left[i], capacity - i, [(i, 1)])
                left[i] = 0
            elif i == j:
                pairs = left[i] // 2
                gaps.put(pairs, capacity - 2 * i, [(i, 2)])
                left[i] -= 2 * pairs
            else:
                pairs = min(left[i], left[j])
                gaps.put(pairs, capacity - i - j, [(i, 1), (j, 1)])
                left[i] -= pairs
                left[j] -= pairs
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[s]
        while todo:
            g = gaps.tightest(s)
            if g is None:
                g, (bins, holds) = capacity, (-(-todo // (capacity // s)), [])
            else:
                bins, holds = gaps.by_gap[g].pop()
            each = g // s  # a bin that took one is the tightest for the next
            whole = min(bins, todo // each)
            gaps.put(whole, g - each * s, [*holds, (s, each)])
            todo -= whole * each
            bins -= whole
            if bins and todo:
                gaps.put(1, g - todo * s, [*holds, (s, todo)])
                todo, bins = 0, bins - 1
            if holds:
                gaps.put(bins, g, holds)
    return [group for gap in gaps.by_gap for group in gap]


def _slots(groups: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Ranks first to last of a length go to bins from base on, so many in each, from an offset on."""
    used: dict[int, int] = {}
    out, base = [], 0
    for bins, holds in groups:
        at = 0
        for length, times in holds:
            first = used.get(length, 0)
            used[length] = first + bins * times
            out.append((length, first, first + bins * times, base, times, at))
            at += length * times
        base += bins
    return out


def assign(found: DataFrame, capacity: int) -> DataFrame:
    """found with sequence_id and offset. found should be a written table: it is read three times."""
    spark = found.sparkSession
    n = found.count()
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(1, -(-n // BUCKET))))
    dealt = found.withColumn("_bucket", bucket)
    sizes = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_size"))
    # sums over buckets in two steps, so that no task has all buckets of a common length
    sizes = sizes.withColumn("_span", F.floor(F.col("_bucket") / SPAN))
    inside = Window.partitionBy("length", "_span").orderBy("_bucket")
    across = Window.partitionBy("length").orderBy("_span")
    spans = sizes.groupBy("length", "_span").agg(F.sum("_size").alias("_all")).select("length", "_span", (F.sum("_all").over(across) - F.col("_all")).alias("_first"))
    before = sizes.withColumn("_own", F.sum("_size").over(inside) - F.col("_size")).join(spans, ["length", "_span"]).select("length", "_bucket", (F.col("_first") + F.col("_own")).alias("_before"))
    counts = {r.length: r["count"] for r in found.groupBy("length").count().collect()}  # at most a row for each length
    slots = spark.createDataFrame(_slots(plan(counts, capacity)), "_len long, _first long, _last long, _base long, _times long, _at long")
    own = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_own", F.row_number().over(own) - 1).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_own"))
    # the table of slots follows from the counts of lengths, so capacity bounds it, not the data
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_last")))
    k = F.col("_rank") - F.col("_first")
    return placed.select(
        *found.columns,
        (F.col("_base") + F.floor(k / F.col("_times"))).cast("long").alias("sequence_id"),
        (F.col("_at") + (k % F.col("_times")) * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, file: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece with its place: sequence_id and offset.

    A null text is empty and has end_id alone. Rows are packed each for itself, repeated rows and null ids too; pieces that
    are alike in all columns take any of their places. An empty table gives no rows. Other columns are left out.
    """
    return assign(shared.keep(pieces(docs, file, end_id, capacity, id_col, text), "pieces"), capacity)
