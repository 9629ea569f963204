"""Log and segment files in their binary formats, read and written through Spark.

Log record: 00 key length, key, value length, value (a write) or 01 key length, key (a delete); lengths are unsigned, 32
bits, big-endian. Segment file: records (key length, key, value length, value; little-endian, FFFFFFFF for a tombstone) in
blocks of at least 4096 bytes, an index entry for each block (key length, largest key, offset, size) and a footer of 24
bytes (index offset, index size, magic).

Files are read with Spark's binaryFile source, so they may lie wherever Spark reads; they are written by a data source, each
under a temporary name that the commit of the whole write changes to its own. A catalogue of segment files has their ranges
of keys, and readers open only files that can hold what is wanted.
"""

from __future__ import annotations

import dataclasses
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Fixed values of the formats.
MAGIC = 0x12345678ABCDEF00
BLOCK = 4096
TOMBSTONE = 0xFFFFFFFF
FOOTER = struct.Struct("<QQQ")

_LOG_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.string()), ("d", pa.binary()), ("e", pa.binary())])
LOG_ROWS = "wal_id long, offset long, op string, key binary, value binary"
SEGMENT_ROWS = "file_id long, place long, key binary, value binary"


def encode_log(records: Iterable[tuple[str, bytes, bytes | None]]) -> bytes:
    out = []
    for op, key, value in records:
        if not key:
            raise ValueError("a key may not be empty")
        if op == "PUT":
            out.append(b"\x00" + struct.pack(">I", len(key)) + key + struct.pack(">I", len(value)) + value)
        elif op == "DELETE":
            out.append(b"\x01" + struct.pack(">I", len(key)) + key)
        else:
            raise ValueError(f"{op} is not logged")
    return b"".join(out)


def decode_log(data: bytes, strict: bool = False) -> Iterator[tuple[int, str, bytes, bytes | None]]:
    """(offset, op, key, value). A log may end inside a record's lengths; what ends or goes wrong elsewhere ends the
    replay too, and is an error if strict."""
    at, n = 0, len(data)

    def part(at: int) -> tuple[int, bytes | None]:
        if at + 4 > n:
            return n, None
        size = struct.unpack_from(">I", data, at)[0]
        if at + 4 + size > n:
            if strict:
                raise ValueError(f"log ends inside a record at {at}")
            return n, None
        return at + 4 + size, data[at + 4 : at + 4 + size]

    while at < n:
        begin, kind = at, data[at]
        if kind > 1:
            if strict:
                raise ValueError(f"unknown record type {kind} at {at}")
            return
        at, key = part(at + 1)
        if key is None:
            return
        value = None
        if kind == 0:
            at, value = part(at)
            if value is None:
                return
        yield begin, "DELETE" if kind else "PUT", key, value


def encode_segment(pairs: Iterable[tuple[bytes, bytes | None]]) -> bytes:
    """Pairs must come in ascending order of their keys; None is a tombstone, b'' a live empty value."""
    out, index, block, at, last = [], [], b"", 0, None

    def close() -> None:
        nonlocal block, at
        index.append(struct.pack("<I", len(last)) + last + struct.pack("<QQ", at, len(block)))
        out.append(block)
        at, block = at + len(block), b""

    for key, value in pairs:
        if last is not None and key <= last:
            raise ValueError("keys must ascend")
        last = key
        block += struct.pack("<I", len(key)) + key + (struct.pack("<I", TOMBSTONE) if value is None else struct.pack("<I", len(value)) + value)
        if len(block) >= BLOCK:
            close()
    if block:
        close()
    table = b"".join(index)
    return b"".join([*out, table, FOOTER.pack(at, len(table), MAGIC)])


def segment_index(data: bytes) -> list[tuple[bytes, int, int]]:
    """(largest key, offset, size) of every block. A file too short for a footer has none; a wrong footer is an error."""
    if len(data) < FOOTER.size:
        return []
    at, size, magic = FOOTER.unpack_from(data, len(data) - FOOTER.size)
    if magic != MAGIC or at + size + FOOTER.size != len(data):
        raise ValueError("not a segment file")
    out, end = [], at + size
    while at < end:
        n = struct.unpack_from("<I", data, at)[0]
        key = data[at + 4 : at + 4 + n]
        offset, length = struct.unpack_from("<QQ", data, at + 4 + n)
        out.append((key, offset, length))
        at += 20 + n
    return out


def _block(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes | None]]:
    while at < end:
        n = struct.unpack_from("<I", data, at)[0]
        key = data[at + 4 : at + 4 + n]
        at += 4 + n
        m = struct.unpack_from("<I", data, at)[0]
        at += 4
        if m == TOMBSTONE:
            yield key, None
            continue
        if at + m > end:
            raise ValueError("a block ends inside a record")
        yield key, data[at : at + m]
        at += m


def decode_segment(data: bytes) -> Iterator[tuple[bytes, bytes | None]]:
    for _, at, size in segment_index(data):
        yield from _block(data, at, at + size)


def lookup(data: bytes, key: bytes) -> tuple[bool, bytes | None]:
    """Whether the segment has the key, and its value: one block is read, the first whose largest key isn't smaller."""
    import bisect

    index = segment_index(data)
    i = bisect.bisect_left(index, key, key=lambda e: e[0])
    if i < len(index):
        for k, value in _block(data, index[i][1], index[i][1] + index[i][2]):
            if k == key:
                return True, value
    return False, None


def _number(path: str) -> int | None:
    m = re.match(r"(\d+)", path.rsplit("/", 1)[-1])
    return int(m[1]) if m else None


def _decoded(decode, names: list[str], schema: pa.Schema):
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(_number(path), *row) for row in decode(content)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), schema.types)], names)

    return run


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def read_log(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """wal_id, offset, op, key, value of all *.log files; (wal_id, offset) is their order."""
    return _files(spark, path, "*.log").mapInArrow(_decoded(lambda x: decode_log(x, strict), ["wal_id", "offset", "op", "key", "value"], _LOG_SCHEMA), LOG_ROWS)


def stream_log(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """The same rows as a stream: each log file once, as it comes. A file should be whole when it gets its name."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.log").load(path)
    return files.select("path", "content").mapInArrow(_decoded(lambda x: decode_log(x, strict), ["wal_id", "offset", "op", "key", "value"], _LOG_SCHEMA), LOG_ROWS)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """file_id, place, key, value of all *.sst files; a null value is a tombstone."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.binary()), ("d", pa.binary())])
    rows = lambda x: ((i, *row) for i, row in enumerate(decode_segment(x)))
    return _files(spark, path, "*.sst").mapInArrow(_decoded(rows, ["file_id", "place", "key", "value"], schema), SEGMENT_ROWS)


def as_log(rows: DataFrame) -> DataFrame:
    """Rows of read_log as a change log: seq orders files, then records."""
    return rows.select((F.col("wal_id") * (1 << 40) + F.col("offset")).alias("seq"), "op", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def read_manifest(spark: SparkSession, file: str) -> DataFrame:
    """line_no, value. A file that isn't there gives no rows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "line_no long, value string")
    text = spark.read.format("binaryFile").load(file).select(F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line_no", "value"))
    return text.select(F.col("line_no").cast("long"), "value")


@dataclasses.dataclass
class _Written(WriterCommitMessage):
    temporary: str | None
    name: str | None


class _FileWriter(DataSourceArrowWriter):
    """Each task writes one file under a temporary name; the commit gives files their numbers, in the order of partitions."""

    def __init__(self, path: str, suffix: str, first: int, encode):
        self.path, self.suffix, self.first, self.encode = path, suffix, first, encode

    def write(self, batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        data = self.encode(batches)
        if data is None:
            return _Written(None, None)
        fs, base = _file_system(self.path)
        fs.create_dir(base, recursive=True)
        number = self.first + context.partitionId()
        temporary = f"{base}/_{number:06d}-{context.taskAttemptId()}.tmp"
        with fs.open_output_stream(temporary) as out:
            out.write(data)
        return _Written(temporary, f"{base}/{number:06d}{self.suffix}")

    def commit(self, messages):
        fs, _ = _file_system(self.path)
        for m in messages:
            if m is not None and m.temporary:
                fs.move(m.temporary, m.name)

    def abort(self, messages):
        fs, _ = _file_system(self.path)
        for m in messages:
            if m is not None and m.temporary:
                fs.delete_file(m.temporary)


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _columns(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _encode_log_rows(batches):
    return encode_log(_columns(batches)) or None


def _encode_segment_rows(batches):
    return encode_segment(_columns(batches)) or None


class LogFiles(DataSource):
    """df.write.format("tidelog_log"): op, key, value (binary), in the order of each partition."""

    @classmethod
    def name(cls):
        return "tidelog_log"

    def writer(self, schema, overwrite):
        return _FileWriter(self.options["path"], "wal.log", int(self.options.get("first", 1)), _encode_log_rows)


class SegmentFiles(DataSource):
    """df.write.format("tidelog_segments"): key, value (binary); partitions must be sorted by key, each key once."""

    @classmethod
    def name(cls):
        return "tidelog_segments"

    def writer(self, schema, overwrite):
        return _FileWriter(self.options["path"], ".sst", int(self.options.get("first", 1)), _encode_segment_rows)


def _register(spark: SparkSession, *sources: type[DataSource]) -> None:
    for source in sources or (LogFiles, SegmentFiles):
        spark.dataSource.register(source)


#: Bytes of keys and values that a file should have, about: a task holds one.
FILE_BYTES = 64 << 20


def _count_of_files(rows: DataFrame) -> int:
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 8
    return max(1, -(-(rows.agg(F.sum(size)).first()[0] or 0) // FILE_BYTES))


def write_log(log: DataFrame, path: str, files: int | None = None) -> None:
    """A change log as log files: ranges of seq, each in order. As many files as its size asks for, unless files is given."""
    _register(log.sparkSession, LogFiles)
    own = log.where(F.col("op") != "GET")
    own = own.repartitionByRange(files or _count_of_files(own), "seq").sortWithinPartitions("seq")
    own.select("op", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value")).write.format("tidelog_log").mode("append").save(path)


def write_segments(entries: DataFrame, path: str, files: int | None = None, first: int | None = None) -> None:
    """Entries (key, value, each key once) as segment files: ranges of keys, each sorted. Numbers follow those that are there."""
    spark = entries.sparkSession
    _register(spark, SegmentFiles)
    first = first or next_file_id(spark, path)
    own = entries.repartitionByRange(files or _count_of_files(entries), "key").sortWithinPartitions("key")
    own.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value")).write.format("tidelog_segments").option("first", first).mode("append").save(path)


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it isn't there."""
    at, fs = _folder(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def next_file_id(spark: SparkSession, path: str) -> int:
    """One more than the largest number that a file of the folder has."""
    return max([0, *(n for x in names(spark, path) if x.endswith(".sst") and (n := _number(x)) is not None)]) + 1


def put_text(spark: SparkSession, file: str, text: str) -> None:
    """The file with this text, all at once: written beside it, then renamed, so a reader sees the old text or the new."""
    at, fs = _folder(spark, file)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{file}.tmp-{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(beside, at, how)


def append_manifest(spark: SparkSession, file: str, ids: list[int]) -> None:
    """Adds a line with the ids of all files, oldest first. The last line counts."""
    before = "\n".join(r.value for r in sorted(read_manifest(spark, file).collect()) if r.value.strip())
    put_text(spark, file, (before + "\n" if before else "") + ",".join(map(str, ids)) + "\n")


def remove_files(spark: SparkSession, path: str, pattern: str) -> int:
    """Deletes the files of a folder whose names the pattern (a regular expression) matches, such as logs whose records
    were flushed; how many."""
    gone = [x for x in names(spark, path) if re.fullmatch(pattern, x)]
    for x in gone:
        at, fs = _folder(spark, f"{path}/{x}")
        fs.delete(at, False)
    return len(gone)


_CATALOG = "file_id long, path string, min_key binary, max_key binary, blocks int, size_bytes long"


def _described(batches):
    schema = pa.schema([("file_id", pa.int64()), ("path", pa.string()), ("min_key", pa.binary()), ("max_key", pa.binary()), ("blocks", pa.int32()), ("size_bytes", pa.int64())])
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            index = segment_index(content)
            if index:  # files too short for a footer, and empty ones, hold nothing
                first = next(_block(content, index[0][1], index[0][1] + index[0][2]))[0]
                rows.append((_number(path), path, first, index[-1][0], len(index), len(content)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, schema.types)], schema=schema)


def segment_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A row for each segment file with entries: file_id, path, min_key, max_key, blocks, size_bytes. A wrong footer is an error."""
    return _files(spark, path, "*.sst").mapInArrow(_described, _CATALOG)


def _looked_up(wanted: list[bytes]):
    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(_number(path), k, found[1]) for k in wanted if (found := lookup(content, k))[0]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.binary(), pa.binary()))], ["file_id", "key", "value"])

    return run


def find(spark: SparkSession, path: str, keys: list[str], catalog: DataFrame | None = None) -> DataFrame:
    """file_id, key, value of the wanted keys in segment files; a null value is a tombstone. Keys are a query's arguments.

    Only files whose range holds a key are opened, and of these one block for each key is read.
    catalog: what segment_catalog gave, written by who has it; else it is made.
    """
    wanted = sorted(k.encode() for k in set(keys))
    known = catalog if catalog is not None else segment_catalog(spark, path)
    reach = F.exists(F.array(*[F.lit(k) for k in wanted]), lambda k: (k >= F.col("min_key")) & (k <= F.col("max_key")))
    paths = [r.path for r in known.where(reach).select("path").collect()] if wanted else []
    if not paths:
        return spark.createDataFrame([], "file_id long, key binary, value binary")
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(_looked_up(wanted), "file_id long, key binary, value binary")
