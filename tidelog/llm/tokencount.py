"""Token counts without ids: pieces are counted once for each distinct pre-token and joined to its frequencies.

Documents are taken in blocks. A block knows which of its documents hold each of its distinct pre-tokens, and how often.
It sends every distinct pre-token once, to the bucket that its hash names, where the tokenizer's model counts the pieces
of each pre-token once for all blocks. Buckets answer with counts alone, in the order that they were asked in, and these
meet the block's frequencies, which give the sums of its documents. However common a pre-token is, it arrives once for
each block, and a bucket's pre-tokens are so many by their hashes: no task grows with one key.
"""

from __future__ import annotations

import functools
import re
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import bpe, shared, textscan

BLOCK_CHARS = 4 << 20
BLOCK_DOCS = 60_000
#: Buckets of pre-tokens, at least; more where the session has more shuffle partitions.
BUCKETS = 1024
_ROWS = "bucket int, block long, body binary"
_HEAD = -1  # the bucket of a block's own row: its documents and frequencies


class Words:
    """The word pattern's pre-tokens of whole texts, as the library's normaliser and splitter give them."""

    def __init__(self, file: str):
        self.file = file
        self.special = bpe.specials(file)
        self.cut = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")

    def prepared(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Texts with what needs the library's own normaliser done, and how many special tokens were cut out of each."""
        fixed = np.zeros(len(texts), np.int64)
        cp, at = textscan.codepoints(texts)
        odd = {*np.unique(textscan.owners(at, np.flatnonzero(textscan.unusual()[cp]))).tolist(), *(i for i, x in enumerate(texts) if "<|" in x)}
        if odd:
            texts, normal = list(texts), bpe.library(self.file).normalizer.normalize_str
            for i in odd:
                parts = self.cut.split(texts[i])
                fixed[i] = len(parts) - 1
                texts[i] = "\n".join([normal(p) for p in parts])
        return texts, fixed

    def block(self, texts: list[str], seed: int = 0):
        """Distinct pre-tokens with their hashes, and for each the documents that hold it; frequencies; special tokens of each text."""
        try:
            return self._block(texts, seed)
        except textscan.HashClash:
            return self.block(texts, seed + 1)

    def _block(self, texts: list[str], seed: int):
        hashes, docs, names, fixed = [], [], [], np.zeros(len(texts), np.int64)
        for a, b in textscan.chunks(texts):
            own, fixed[a:b] = self.prepared(texts[a:b])
            cp, at = textscan.codepoints(own)
            cp = textscan.lowered(cp)
            starts, ends = textscan.word_level(cp, at)
            if not len(starts):
                continue
            h = textscan.piece_hash(textscan.sums(textscan.values_of(cp, seed)), starts, ends)
            distinct, sample, back = textscan.distinct(cp, h, starts, ends)
            joined = cp.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            names.append((distinct, [joined[x:y] for x, y in zip(starts[sample].tolist(), ends[sample].tolist())]))
            hashes.append(distinct[back])
            docs.append(a + textscan.owners(at, starts))
        if not hashes:
            empty = np.empty(0, np.int64)
            return [], empty.view(np.uint64), np.zeros(1, np.int64), empty, empty, fixed
        found = np.concatenate([x for x, _ in names])
        distinct, first = np.unique(found, return_index=True)
        every = [w for _, own in names for w in own]
        textscan.same_words(found, distinct, first, every)
        back = np.searchsorted(distinct, np.concatenate(hashes))
        pair, freq = np.unique(back * len(texts) + np.concatenate(docs), return_counts=True)
        return [every[i] for i in first.tolist()], distinct, np.searchsorted(pair, np.arange(len(distinct) + 1) * len(texts)), pair % len(texts), freq, fixed


@functools.cache
def words(file: str) -> Words:
    return Words(file)


def _blocks(batches):
    """Ids and texts of documents in blocks of bounded size; a longer text is a block of its own."""
    ids, texts, n = [], [], 0
    for batch in batches:
        for i, x in zip(batch.column(0).to_pylist(), textscan.strings(batch.column(1))):
            if texts and (n + len(x) > BLOCK_CHARS or len(texts) >= BLOCK_DOCS):
                yield ids, texts
                ids, texts, n = [], [], 0
            ids.append(i)
            texts.append(x)
            n += len(x)
    if texts:
        yield ids, texts


def _body(pack, *arrays: np.ndarray) -> bytes:
    """Arrays as bytes, each behind its size, packed."""
    return pack(b"".join(x for a in arrays for x in (struct.pack("<q", a.nbytes), a.tobytes())))


def _arrays(data: bytes, *types: str) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        n = struct.unpack_from("<q", data, at)[0]
        out.append(np.frombuffer(data, t, n // np.dtype(t).itemsize, at + 8))
        at += 8 + n
    return out


def _asked(file: str, buckets: int):
    """Of documents: each block's own row, and a row for each bucket that it asks."""

    def run(batches):
        own, number = words(file), TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(level=3).compress
        for ids, texts in _blocks(batches):
            names, hashes, at, docs, freq, fixed = own.block(texts)
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            held = np.diff(at)[order]
            slots = textscan.slices(at[:-1][order], held)
            known = np.array([i is not None for i in ids], bool)
            n_bytes = np.array([len(x.encode("utf-8", "replace")) for x in texts], "<i8")
            head = _body(pack, np.array([i or 0 for i in ids], "<i8"), known.astype("u1"), n_bytes, fixed.astype("<i8"), held.astype("<u4"), docs[slots].astype("<u2"), freq[slots].astype("<u4"))
            some, first = np.unique(bucket[order], return_index=True)
            edges = [*first.tolist(), len(order)]
            listed = [names[i] for i in order.tolist()]
            bodies = [pack("\n".join(listed[a:b]).encode("utf-8", "replace")) for a, b in zip(edges, edges[1:])]
            rows = [np.append(_HEAD, some).astype(np.int32), np.full(len(some) + 1, number)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array([head, *bodies], pa.binary())], ["bucket", "block", "body"])
            number += 1

    return run


def _answered(file: str):
    """Of rows sorted by bucket: the counts of their pre-tokens' pieces, each pre-token of a bucket counted once. Blocks' own rows pass."""

    def run(batches):
        tokenize, table = bpe.library(file).model.tokenize, bpe._visible()
        pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        last, known = _HEAD, {}
        for batch in batches:
            bodies = batch.column(2).to_pylist()
            for k, bucket in enumerate(batch.column(0).to_pylist()):
                if bucket == _HEAD:
                    continue
                if bucket != last:
                    last, known = bucket, {}
                names = unpack(bodies[k]).decode("utf-8").split("\n")
                for x in set(names).difference(known):
                    known[x] = len(tokenize(x.encode("utf-8").decode("latin-1").translate(table)))
                bodies[k] = pack(np.fromiter(map(known.__getitem__, names), "<u4", len(names)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bodies, pa.binary())], ["bucket", "block", "body"])

    return run


def _joined(limit: int):
    """Of rows sorted by block and bucket: the documents of each block with their sums."""

    def done(head: bytes, counts: list[bytes]):
        ids, known, n_bytes, fixed, held, docs, freq = _arrays(head, "<i8", "u1", "<i8", "<i8", "<u4", "<u2", "<u4")
        pieces = np.frombuffer(b"".join(counts), "<u4").astype(np.int64)
        if len(pieces) != len(held):
            raise ValueError("a block's buckets did not all answer")
        total = fixed + np.bincount(docs, freq * np.repeat(pieces, held), len(ids)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=known == 0), pa.array(n_bytes), pa.array(total), pa.array(total > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        head, counts = None, []
        for batch in batches:
            for bucket, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if bucket == _HEAD:
                    if head is not None:
                        yield done(head, counts)
                    head, counts = unpack(body), []
                else:
                    counts.append(unpack(body))
        if head is not None:
            yield done(head, counts)

    return run


def count(docs: DataFrame, file: str, limit: int = 2048, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than limit tokens) of every row.

    docs should be a scan or a written table: a block is known by its place, so a task that runs again must see its rows
    in the same order. A null text is empty: 0 bytes, 0 tokens. Rows with equal or null ids are counted each for itself. An empty table
    gives no rows. Other columns are left out.
    """
    buckets = max(BUCKETS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = own.mapInArrow(shared.lean(_asked(file, buckets)), _ROWS)
    met = rows.repartition("bucket", F.when(F.col("bucket") == _HEAD, F.col("block"))).sortWithinPartitions("bucket")
    answers = met.mapInArrow(shared.lean(_answered(file)), _ROWS)
    return answers.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(shared.lean(_joined(limit)), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
