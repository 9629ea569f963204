"""A content-addressed store of token ids.

A rolling hash over ids cuts each document's stream into chunks, so equal passages give equal chunks wherever they
stand. A chunk is stored once, under the digest of its bytes. A document's recipe lists its chunks' digests and has
the Merkle root over them; a partition of recipes has the Merkle root over theirs, and the store the one over those of
its partitions. Readers go the same way up: they hash every chunk, put a recipe's root together from what they found,
and hold the recipes of each partition, and the partitions, against the manifest. So a changed, lost or foreign chunk,
recipe or partition is found.

Files: chunks (kind=0: digest, ids little-endian, 2 bytes each where the vocabulary allows, else 4), recipes in
ascending order of doc_id (start, n_tokens, digests, root), manifest (a row for each partition of recipes: how many
recipes and ids, root) and root (one row: partitions, recipes, ids, root).
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, shared, textscan

DIGEST = 16
WINDOW = 16
MEAN_BITS = 9
MIN_CHUNK, MAX_CHUNK = 128, 4096
#: Chunks that a task remembers; beyond that it forgets them all and may send one again.
MAX_SEEN = 500_000
_RAW = "kind int, doc_id long, n_tokens long, digest binary, body binary"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


class Merkle:
    """A Merkle tree of which only the open nodes are held, one for each level. A node without a partner moves up as it is."""

    def __init__(self):
        self.open: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        level = 0
        while self.open and self.open[-1][0] == level:
            leaf = digest(self.open.pop()[1] + leaf)
            level += 1
        self.open.append((level, leaf))

    def root(self) -> bytes:
        """Without a leaf: the digest of nothing."""
        if not self.open:
            return digest(b"")
        out = self.open[-1][1]
        for _, left in reversed(self.open[:-1]):
            out = digest(left + out)
        return out


def merkle(leaves: list[bytes]) -> bytes:
    """The root over digests."""
    tree = Merkle()
    for x in leaves:
        tree.add(x)
    return tree.root()


def cuts(ids: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """For each document at[i]:at[i+1], the places where its chunks end. A cut depends on the WINDOW ids before it alone."""
    values = textscan.mix(ids.astype(np.uint64) + np.uint64(1))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    rolled = textscan.mix(run[WINDOW:] - run[:-WINDOW]) if len(ids) >= WINDOW else np.empty(0, np.uint64)
    places = np.flatnonzero((rolled >> np.uint64(64 - MEAN_BITS)) == 0) + WINDOW
    edges = np.searchsorted(places, at)
    places = places.tolist()
    out = []
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        own, last = [], a
        for p in [*places[edges[i] : edges[i + 1]], b]:
            if p - a < WINDOW and p != b:
                continue
            while p - last > MAX_CHUNK:
                last += MAX_CHUNK
                own.append(last)
            if p > last and (p == b or p - last >= MIN_CHUNK):
                own.append(p)
                last = p
        out.append(own)
    return out


def _encode(file: str, end_id: int, dtype: str):
    def run(batches):
        enc, seen = bpe.encoder(file), set()  # a task sends a chunk once, however many of its documents have it
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), textscan.strings(batch.column(1))
            for a, b, ids, count in enc.batches(texts):
                rows = []
                if len(seen) > MAX_SEEN:
                    seen.clear()
                ends = np.cumsum(count)
                ids = np.insert(ids, ends, end_id)
                count = count + 1
                at = np.concatenate([[0], np.cumsum(count)])
                data = ids.astype(dtype)
                for i, own in enumerate(cuts(ids, at)):
                    last, names = int(at[i]), []
                    for p in own:
                        body = data[last:p].tobytes()
                        names.append(name := digest(body))
                        last = p
                        if name not in seen:
                            seen.add(name)
                            rows.append((0, None, None, name, body))
                    rows.append((1, docs[a + i], int(count[i]), merkle(names), b"".join(names)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["kind", "doc_id", "n_tokens", "digest", "body"])

    return run


def _first_of_each(batches):
    """Of sorted rows, each chunk once; recipes all."""
    last = None
    for batch in batches:
        kind, names = batch.column(0).to_pylist(), batch.column(3).to_pylist()
        keep = []
        for k, name in zip(kind, names):
            keep.append(k == 1 or name != last)
            last = name if k == 0 else last
        yield batch.filter(pa.array(keep, pa.bool_()))


def _order(batches):
    """Adds each recipe's place and the ids before it, within the partition."""
    place = start = 0
    for batch in batches:
        n = np.asarray(batch.column(1))
        before = start + np.cumsum(n) - n
        arrays = [*batch.columns, pa.array(before, pa.int64()), pa.array(np.arange(place, place + len(n)), pa.int64())]
        place, start = place + len(n), start + int(n.sum())
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "root", "digests", "part", "local_start", "place"])


def write(docs: DataFrame, path: str, file: str, end_id: int, id_col: str = "doc_id", text: str = "text") -> None:
    """Encodes docs and writes the store to path, which must be one that all executors reach.

    A null text is empty and has end_id alone. Rows with a null id come first; rows with one id keep a recipe each,
    ordered by their roots. An empty table gives a store without recipes. Other columns are not stored.
    """
    spark = docs.sparkSession
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(shared.lean(_encode(file, end_id, f"<u{_width(file, end_id)}")), _RAW)
    # each distinct chunk meets its copies in one place; recipes spread by their roots and ids
    dealt = raw.repartition(F.xxhash64("digest", "doc_id")).sortWithinPartitions("kind", "digest")
    dealt.mapInArrow(shared.lean(_first_of_each), _RAW).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/raw")
    recipes = spark.read.schema(_RAW).parquet(f"{path}/raw").where("kind = 1").select("doc_id", "n_tokens", F.col("digest").alias("root"), F.col("body").alias("digests"))
    ordered = recipes.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("root")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root").withColumn("part", F.spark_partition_id())
    ordered.mapInArrow(shared.lean(_order), "doc_id long, n_tokens long, root binary, digests binary, part int, local_start long, place long").write.option("compression", "zstd").partitionBy("part").parquet(f"{path}/recipes")
    _roots(spark, path).write.parquet(f"{path}/manifest")
    spark.createDataFrame([_whole(_manifest(spark, path))], _ROOT).write.parquet(f"{path}/root")


_PART = "part int, docs long, tokens long, root binary"
_ROOT = "parts long, docs long, tokens long, root binary"


def _roots(spark: SparkSession, path: str) -> DataFrame:
    """A row for each partition of recipes, from the recipes."""
    own = _recipes(spark, path).select("part", "place", "n_tokens", "root")
    return own.repartition("part").sortWithinPartitions("part", "place").mapInArrow(shared.lean(_roots_by_part), _PART)


def _roots_by_part(batches):
    """Of rows sorted by part and place; a lost place, and so a lost recipe, changes the root."""
    now, tree, docs, tokens = None, None, 0, 0

    def row():
        return pa.RecordBatch.from_pydict({"part": [now], "docs": [docs], "tokens": [tokens], "root": [tree.root()]}, pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("root", pa.binary())]))

    for batch in batches:
        for part, place, n, root in zip(*(c.to_pylist() for c in batch.columns)):
            if part != now:
                if now is not None:
                    yield row()
                now, tree, docs, tokens = part, Merkle(), 0, 0
            tree.add(digest(root + place.to_bytes(8, "little") + n.to_bytes(8, "little")))
            docs, tokens = docs + 1, tokens + n
    if now is not None:
        yield row()


def _manifest(spark: SparkSession, path: str) -> list:
    """The manifest's rows in order. There are as many as partitions, which the session's settings bound."""
    return sorted(tuple(r) for r in spark.read.schema(_PART).parquet(f"{path}/manifest").collect())


def _whole(manifest: list) -> tuple:
    return len(manifest), sum(r[1] for r in manifest), sum(r[2] for r in manifest), merkle([bytes(r[3]) for r in manifest])


def verify(spark: SparkSession, path: str) -> None:
    """An error if the recipes are not those of the manifest, or the manifest is not that of the root. Chunks are checked as they are read."""
    manifest = _manifest(spark, path)
    root = spark.read.schema(_ROOT).parquet(f"{path}/root").first()
    if root is None or tuple(root) != _whole(manifest):
        raise ValueError(f"{path}: the manifest does not have the store's root")
    found = sorted(tuple(r) for r in _roots(spark, path).collect())
    if found != manifest:
        wrong = sorted({r[0] for r in set(found) ^ set(manifest)})
        raise ValueError(f"{path}: recipes of partitions {wrong[:20]} are not those of the manifest")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, n_tokens long, root binary, digests binary, local_start long, place long, part int").parquet(f"{path}/recipes")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_RAW).parquet(f"{path}/raw").where("kind = 0").select("digest", "body")


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, root, digests, and uid (a recipe's own number). Starts come from the manifest: a row for each partition."""
    base, upto = [], 0
    for part, _, tokens, _ in _manifest(spark, path):
        base.append((part, upto))
        upto += tokens
    before = F.broadcast(spark.createDataFrame(base, "part int, _base long"))
    own = _recipes(spark, path).join(before, "part")
    return own.select("doc_id", (F.col("_base") + F.col("local_start")).alias("start"), "n_tokens", "root", "digests", (F.col("part").cast("long") * (1 << 40) + F.col("place")).alias("uid"))


def _checked(width: int):
    def run(batches):
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            ids = [np.frombuffer(x, f"<u{width}").astype("<u4").tobytes() for x in bodies]
            arrays = [pa.array([digest(x) for x in bodies], pa.binary()), batch.column(0), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["found", "name", "crc", "n"])

    return run


# crc32 of a whole from the crc32 of its parts: a part's value is multiplied by x^(8 * bytes after it), modulo the polynomial


def _times(a: int, b: int) -> int:
    """The product of two reflected polynomials modulo the one of crc32."""
    out, m = 0, 1 << 31
    while m:
        if a & m:
            out ^= b
        m >>= 1
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


@functools.cache
def _shift_tables(j: int) -> np.ndarray:
    """For each byte of a crc32, its image under 2^j bytes of zeros."""
    x = 1 << 30  # x^1
    for _ in range(3 + j):
        x = _times(x, x)
    return np.array([[_times(b << (8 * k), x) for b in range(256)] for k in range(4)], np.uint32)


def shifted(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """crc32 values with so many bytes of zeros behind each, before the last xor."""
    crc = crc.astype(np.uint32, copy=True)
    for j in range(int(after.max()).bit_length() if len(after) else 0):
        hit = np.flatnonzero((after >> j) & 1)
        t, c = _shift_tables(j), crc[hit]
        crc[hit] = t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24]
    return crc


def joined_crc(crc: np.ndarray, n_bytes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """crc32 of each group of consecutive parts; starts: where groups begin."""
    total = np.add.reduceat(n_bytes, starts)
    before = np.cumsum(n_bytes)
    group_end = np.repeat(np.cumsum(total), np.diff(np.append(starts, len(crc))))
    return np.bitwise_xor.reduceat(shifted(crc, group_end - before), starts)


_READ = "uid long, ids_crc32 long, n_read long, root_read binary"


def _assembled(batches):
    """Of rows sorted by uid and seq, one row for each uid."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        uid = np.asarray(table["uid"])
        last = int(np.searchsorted(uid, uid[-1]))
        rest = table.slice(last)
        if last:
            yield _fold(table.slice(0, last))
    if rest is not None:
        yield _fold(rest)


def _fold(table):
    table = table.combine_chunks()
    uid = np.asarray(table["uid"])
    starts = np.concatenate([[0], np.flatnonzero(uid[1:] != uid[:-1]) + 1])
    n = np.asarray(table["n"])
    crc = joined_crc(np.asarray(table["crc"]).astype(np.uint32), n * 4, starts)
    found = table["found"].to_pylist()
    ends = [*starts[1:].tolist(), len(uid)]
    roots = [merkle(found[a:b]) for a, b in zip(starts.tolist(), ends)]
    return pa.RecordBatch.from_arrays([pa.array(uid[starts]), pa.array(crc.astype(np.int64)), pa.array(np.add.reduceat(n, starts)), pa.array(roots, pa.binary())], ["uid", "ids_crc32", "n_read", "root_read"])


def _listed(own: DataFrame) -> DataFrame:
    """A row for each chunk of each recipe."""
    places = F.sequence(F.lit(0), (F.length("digests") / DIGEST).cast("int") - 1)
    return own.select("uid", "digests", F.explode(places).alias("seq")).select("uid", "seq", F.col("digests").substr(F.col("seq") * DIGEST + 1, F.lit(DIGEST)).alias("name"))


def _width(file: str, end_id: int) -> int:
    return 4 if bpe.library(file).get_vocab_size() > 65536 or end_id >= 65536 else 2


def read(spark: SparkSession, path: str, file: str, end_id: int) -> DataFrame:
    """What the files hold for each document: doc_id, start, n_tokens, ids_crc32, verified.

    Recipes that are not those of the manifest are an error. Chunks are read and hashed once each; a document's crc32
    follows from those of its chunks. verified is true if the digests found, put in the recipe's order, have the recipe's
    root and as many ids as it says; a recipe of which a chunk is lost is not. An empty store gives no rows.

    A chunk that very many recipes list is a hot key of a sort-merge join, whose partitions Spark splits.
    """
    verify(spark, path)
    own = recipes(spark, path)
    chunks = _chunks(spark, path).mapInArrow(shared.lean(_checked(_width(file, end_id))), "found binary, name binary, crc long, n long")
    parts = _listed(own).join(chunks, "name").select("uid", "seq", "found", "crc", "n")
    whole = parts.repartition("uid").sortWithinPartitions("uid", "seq").mapInArrow(shared.lean(_assembled), _READ)
    return own.join(whole, "uid", "left").select(
        "doc_id", "start", "n_tokens", "ids_crc32", F.coalesce((F.col("root") == F.col("root_read")) & (F.col("n_tokens") == F.col("n_read")), F.lit(False)).alias("verified")
    )


def _hashed(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([digest(x) for x in batch.column(1).to_pylist()], pa.binary())], ["name", "body", "found"])


def _joined(batches):
    """Of rows (uid, seq, found, body) sorted by uid and seq: the bytes of each uid and the root over what was found."""
    now, bodies, tree = None, [], None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([b"".join(bodies)], pa.binary()), pa.array([tree.root()], pa.binary())], ["uid", "ids", "root_read"])

    for batch in batches:
        for uid, _, found, body in zip(*(c.to_pylist() for c in batch.columns)):
            if uid != now:
                if now is not None:
                    yield row()
                now, bodies, tree = uid, [], Merkle()
            bodies.append(body)
            tree.add(found)
    if now is not None:
        yield row()


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (as stored bytes; null if every chunk is lost) and verified, as read has it."""
    verify(spark, path)
    own = recipes(spark, path)
    chunks = _chunks(spark, path).withColumnRenamed("digest", "name").mapInArrow(shared.lean(_hashed), "name binary, body binary, found binary")
    parts = _listed(own).join(chunks, "name").select("uid", "seq", "found", "body")
    whole = parts.repartition("uid").sortWithinPartitions("uid", "seq").mapInArrow(shared.lean(_joined), "uid long, ids binary, root_read binary")
    return own.join(whole, "uid", "left").select("doc_id", "start", "n_tokens", "ids", F.coalesce(F.col("root") == F.col("root_read"), F.lit(False)).alias("verified"))


def store(docs: DataFrame, file: str, end_id: int) -> str:
    """write() to a new place in the shared folder."""
    path = shared.fresh(docs.sparkSession, "ids")
    write(docs, path, file, end_id)
    return path
