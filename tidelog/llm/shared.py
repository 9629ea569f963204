"""Tables written between steps, in the folder that driver and executors share, and what all Python workers do alike."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch that a Python worker takes at once; a larger row is a batch of its own.
PART_BYTES = 8 << 20


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the folder of setCheckpointDir. Where both are unset, a temporary folder
    takes their place in local mode (tests), and on a cluster, whose executors would not see that, it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidelog-"))
        at = sc._jsc.sc().getCheckpointDir().get()
    return at.rstrip("/")


def parts(batch: pa.RecordBatch, limit: int = PART_BYTES):
    """The batch in halves of halves, until each has limit bytes at most or one row."""
    if batch.num_rows > 1 and batch.nbytes > limit:
        half = batch.num_rows // 2
        yield from parts(batch.slice(0, half), limit)
        yield from parts(batch.slice(half), limit)
    else:
        yield batch


@functools.cache
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda n: 0


def release() -> None:
    """Gives memory that is free in this process back to the system: workers wait for their next task beside others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    _trim()(0)


def lean(run):
    """The function over Arrow batches, with input in parts of bounded size; free memory goes back when its task ends."""

    def bounded(batches):
        try:
            yield from run(part for batch in batches for part in parts(batch))
        finally:
            release()

    return bounded


def unused(df: DataFrame, name: str) -> str:
    """A name like this that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, str]:
    """docs with a column of whole numbers that tells all rows apart and follows the ids, and its name.

    That is the id itself where no id repeats. Else rows are sorted by id and text (by its hash and length), which costs a
    shuffle of the table, numbered, and written. Null ids stay null.
    """
    own = F.col(id_col).cast("long")
    if not docs.where(own.isNotNull()).groupBy(own.alias("_id")).count().where("count > 1").limit(1).count():
        return docs, id_col
    key = unused(docs, "row")
    order = [own.asc_nulls_first(), F.xxhash64(F.col(text).cast("string")), F.length(F.col(text).cast("string"))]
    rows = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return keep(rows.withColumn(key, F.when(own.isNotNull(), F.monotonically_increasing_id())), "numbered"), key


#: Places made by this process, for clear().
MADE: list[str] = []


def fresh(spark: SparkSession, name: str) -> str:
    MADE.append(f"{folder(spark)}/tidelog-{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def keep(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Writes df as Parquet and reads it again: the lineage ends there, and lost executors cost no rerun of it."""
    path, schema = fresh(df.sparkSession, name), df.schema
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*by) if by else out).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Removes all that this process wrote between steps. Frames that were not yet written out can't be read after that."""
    while MADE:
        drop(spark, MADE.pop())
