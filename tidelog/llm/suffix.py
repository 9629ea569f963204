"""Repeated passages by longest-previous-factor arrays over suffix order.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document with a smaller id, or earlier in
the same one. To find earlier matches without one suffix array over everything, places are dealt by anchors: the k-gram
with the least hash among those of a string. Equal strings have equal anchors, so the places of an anchor's strings (a
run) meet in one task, where suffixes are put in order, to LENGTH bytes. There a place's longest previous factor is what
it has in common with the nearest smaller place before it or after it; the place is marked if that is LENGTH.

Runs with equal bytes (by 128 bits of hash, with their anchor's) are settled before any text travels: the first stays, the
others are marked. Only firsts of anchors whose runs differ are sorted. An anchor with more of them than a task should
hold is settled by digests of its strings instead, which spread over all tasks: there the longest previous factor is
LENGTH for all of a digest's places but the first. The result is the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import shared, textscan

LENGTH = 100
GRAM = 24
#: Runs of one anchor that are sorted in one task.
RUNS = 1_000
#: Up to so many crowded anchors are sent to the executors; more are joined by shuffle.
MAX_SENT_ANCHORS = 1_000_000
#: Bytes of runs that are sorted at once, about.
_SORT = 1 << 22
_FOUND = "kind int, doc_id long, at long, n int, shift int, h long, r long"
_U = np.uint64


def _values() -> np.ndarray:
    return textscan.mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))


def joined_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=at[1:])
    return np.frombuffer(b"".join(texts), np.uint8), at


def runs(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of places whose strings share an anchor: first place, how many, anchor, hash of the anchor, hash of the run's bytes, document."""
    n, w = len(data), length - gram + 1
    empty = np.empty(0, np.int64)
    if n < length:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64), empty
    c = textscan.sums(_values()[data])
    i = np.arange(n - gram + 1)
    grams = textscan.piece_hash(c, i, i + gram)
    bits = _U(max(1, int(n).bit_length()))
    low = (_U(1) << bits) - _U(1)
    least = (grams & ~low) | i.astype(np.uint64)  # of equal hashes the first
    size = 1
    while 2 * size <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
    # a string that crosses documents has no place
    ok = np.zeros(n + 1, np.int64)
    whole = np.diff(at) >= length
    np.add.at(ok, at[:-1][whole], 1)
    np.add.at(ok, at[1:][whole] - length + 1, -1)
    place = np.flatnonzero(np.cumsum(ok)[: n - length + 1] > 0)
    if not len(place):
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64), empty
    anchor = (least[place] & low).astype(np.int64)
    doc = textscan.owners(at, place)
    new = np.ones(len(place), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(place)))
    first, anchor, doc = place[head], anchor[head], doc[head]
    own = textscan.piece_hash(c, first, first + count + length - 1)
    own = textscan.mix(own ^ ((anchor - first).astype(np.uint64) << _U(32)) ^ count.astype(np.uint64))
    return first, count, anchor, grams[anchor], own, doc


def _slices(batch, ids: int, text: int):
    """Of a batch: rows with an id, by id, in slices of bounded size, as (ids, texts in UTF-8)."""
    rows = sorted((i, x) for i, x in zip(batch.column(ids).to_pylist(), (x.encode("utf-8", "replace") for x in textscan.strings(batch.column(text)))) if i is not None)
    texts = [x for _, x in rows]
    for a, b in textscan.chunks(texts):
        yield [i for i, _ in rows[a:b]], texts[a:b]


def _found(kind: int, doc, at, n, shift, h, r) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(doc), kind, np.int32)), pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(n.astype(np.int32)), pa.array(shift.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(r.view(np.int64))],
        ["kind", "doc_id", "at", "n", "shift", "h", "r"],
    )


MARK, RUN, STRING = 0, 1, 2


def _runs(batches):
    """Runs of documents. Of equal runs in a batch the first travels; the others are marks already."""
    for batch in batches:
        for ids, texts in _slices(batch, 0, 1):
            data, at = joined_bytes(texts)
            first, count, anchor, h, r, doc = runs(data, at)
            if not len(first):
                continue
            order = np.lexsort((first, r, h))  # documents stand by id, so places do too
            same = np.zeros(len(order), bool)
            hs, rs = h[order], r[order]
            same[1:] = (hs[1:] == hs[:-1]) & (rs[1:] == rs[:-1])
            own, local = np.array(ids, np.int64)[doc], first - at[doc]
            for kind, pick in ((RUN, order[~same]), (MARK, order[same])):
                if len(pick):
                    yield _found(kind, own[pick], local[pick], count[pick], (anchor - first)[pick], h[pick], r[pick])


def _firsts(batches):
    """Of runs sorted by anchor, bytes and place: marks for all but the first of equal ones; the firsts, if an anchor has several."""
    held = None  # the first run of the last anchor, until a second one comes
    last_h = last_r = None
    for batch in batches:
        kind, h, r = np.asarray(batch.column(0)), np.asarray(batch.column(5)), np.asarray(batch.column(6))
        passed = kind == MARK
        if passed.any():
            yield batch.filter(pa.array(passed))
            batch = batch.filter(pa.array(~passed))
            h, r = h[~passed], r[~passed]
        if not len(h):
            continue
        new_h, new_r = np.ones(len(h), bool), np.ones(len(h), bool)
        new_h[1:] = h[1:] != h[:-1]
        new_r[1:] = new_h[1:] | (r[1:] != r[:-1])
        if last_h is not None and h[0] == last_h:
            new_h[0], new_r[0] = False, r[0] != last_r
        if not new_r.all():
            marks = batch.filter(pa.array(~new_r))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(marks.num_rows, MARK, np.int32)), *marks.columns[1:]], marks.schema.names)
        group = np.cumsum(new_h)  # 0: the anchor goes on from the batch before
        distinct = np.bincount(group[new_r], minlength=group[-1] + 1)
        out = new_r & (distinct[group] > 1)
        if distinct[0] and held is not None:
            yield held
            held = None
        if distinct[0]:
            out |= new_r & (group == 0)
        # the last anchor may go on in the next batch
        tail = np.flatnonzero(new_r & (group == group[-1]))
        if group[-1] > 0:
            held = batch.slice(int(tail[0]), 1) if distinct[group[-1]] == 1 else None
            out[tail] = distinct[group[-1]] > 1
        if out.any():
            yield batch.filter(pa.array(out))
        last_h, last_r = h[-1], r[-1]


def _packed(batches):
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(x.encode("utf-8", "replace")) for x in textscan.strings(batch.column(1))], pa.binary())], ["doc_id", "z"])


_DEALT = "kind int, k1 long, k2 long, doc_id long, at long, n int, body binary"


def _bodies(batches):
    """Of documents with their runs: the bytes of each run under its anchor, or of a crowded anchor each string's digest."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out, size = [], 0
        for doc, z, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data = unpack(z)
            for x in own:
                h, at, n = x["h"], x["at"], x["n"]
                if x["crowded"]:
                    key = h.to_bytes(8, "little", signed=True)
                    found = b"".join(hashlib.blake2b(data[p : p + LENGTH], digest_size=16, key=key).digest() for p in range(at, at + n))
                    out += [(STRING, int(d[0]), int(d[1]), doc, at + j, 1, None) for j, d in enumerate(np.frombuffer(found, "<i8").reshape(-1, 2))]
                    size += 48 * n
                else:
                    out.append((RUN, h, 0, doc, at, n, data[at : at + n + LENGTH - 1]))
                    size += n + LENGTH
            if size > 1 << 23:
                yield _body_rows(out)
                out, size = [], 0
        if out:
            yield _body_rows(out)


def _body_rows(out):
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["kind", "k1", "k2", "doc_id", "at", "n", "body"])


def _leading(x: np.ndarray, size: int) -> np.ndarray:
    """How many leading bytes, of size, each number has in common with the one before it."""
    differ = np.zeros(len(x), np.uint64)
    differ[1:] = x[1:] ^ x[:-1]
    return size - sum(((differ >> _U(8 * k)) > 0).astype(np.int64) for k in range(size))


def suffix_order(data: np.ndarray, place: np.ndarray, group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places by group, by the length bytes of their suffixes, and by themselves; and how many bytes, up to length, each
    has in common with the one before it in that order (0 for a group's first).

    Suffixes with equal bytes are told by hash, and then compared byte by byte; one of each is sorted.
    """
    steps = range(0, length, 8)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.ndarray(len(padded) - 8, ">u8", padded, strides=(1,))
    shift = _U(8 * (-length % 8))

    def word(at: np.ndarray, w: int) -> np.ndarray:
        x = words[at + w].astype(np.uint64)
        return x >> shift if length - w < 8 else x

    h = textscan.piece_hash(textscan.sums(_values()[data]), place, place + length)
    order = np.lexsort((h, group))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (group[order][1:] != group[order][:-1])
    own = np.empty(len(order), np.int64)
    own[order] = np.cumsum(new) - 1
    one = order[new]
    if any((word(place, w) != word(place[one][own], w)).any() for w in steps):  # unequal bytes with one hash: sort them all
        one = own = np.arange(len(place))
    columns = [word(place[one], w) for w in steps]
    sort = np.lexsort((place[one], *columns[::-1], group[one]))
    same = np.zeros(len(sort), np.int64)
    open_ = np.zeros(len(sort), bool)
    open_[1:] = group[one][sort][1:] == group[one][sort][:-1]
    for w, column in zip(steps, columns):
        size = min(8, length - w)
        lead = _leading(column[sort], size)
        same += np.where(open_, lead, 0)
        open_ &= lead == size
    rank = np.empty(len(sort), np.int64)
    rank[sort] = np.arange(len(sort))
    order = np.lexsort((place, rank[own]))
    common = np.full(len(order), length, np.int64)
    head = np.ones(len(order), bool)
    head[1:] = own[order][1:] != own[order][:-1]
    common[head] = same
    return order, common


def longest_previous(place: np.ndarray, order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest previous factor of each place: what it has in common with an earlier place, at most.

    In suffix order that is with the nearest smaller place before it or after it. Each place looks at its neighbour; while
    that is not smaller, it goes on to where the neighbour looks, with the least of what the steps have in common.
    """
    found = np.zeros(len(place), np.int64)
    for way in (1, -1):
        own, near = place[order][::way], (common if way == 1 else np.append(common[1:], 0)[::-1]).copy()
        at = np.arange(len(own)) - 1
        todo = np.flatnonzero((at >= 0) & (near > 0))
        todo = todo[own[at[todo]] >= own[todo]]
        while len(todo):
            step = at[todo]
            near_next, at_next = np.minimum(near[todo], near[step]), at[step]
            near[todo], at[todo] = near_next, at_next
            todo = todo[(at_next >= 0) & (near_next > 0)]
            todo = todo[own[at[todo]] >= own[todo]]
        near[at < 0] = 0
        best = found[order[::way]]
        found[order[::way]] = np.maximum(best, near)
    return found


def repeated(data: np.ndarray, place: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which places have a longest previous factor of length in their group; others in a group are earlier if they stand earlier.

    Only places whose string's hash stands twice in the group get into suffix order: others have a shorter factor.
    """
    hit = np.zeros(len(place), bool)
    h = textscan.piece_hash(textscan.sums(_values()[data]), place, place + length)
    order = np.lexsort((h, group))
    tied = np.zeros(len(place) + 1, bool)
    tied[1:-1] = (h[order][1:] == h[order][:-1]) & (group[order][1:] == group[order][:-1])
    left = np.sort(order[tied[1:] | tied[:-1]])
    if len(left):
        hit[left] = longest_previous(left, *suffix_order(data, place[left], group[left], length)) >= length
    return hit


_MARKS = "doc_id long, at long, n int"


def _stretches(doc, at, n, hit) -> pa.RecordBatch | None:
    """Marks for the places hit, as stretches of consecutive ones. doc, at, n: of each run."""
    run = np.repeat(np.arange(len(n)), n)
    place = at[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    run, place = run[hit], place[hit]
    if not len(run):
        return None
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(run))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(doc[run[head]]), pa.array(place[head]), pa.array(count)], ["doc_id", "at", "n"])


def _solve(table: pa.Table):
    table = table.combine_chunks()
    n = np.asarray(table["n"]).astype(np.int64)
    data, at = joined_bytes(table["body"].to_pylist())
    h = np.asarray(table["k1"])
    group = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]]))
    return _stretches(np.asarray(table["doc_id"]), np.asarray(table["at"]), n, repeated(data, textscan.slices(at[:-1], n), np.repeat(group, n)))


def _settled(batches):
    """Marks from runs sorted by anchor and place, and then from strings sorted by digest and place."""
    rest, size, last = [], 0, None
    for batch in batches:
        strings = int(np.searchsorted(np.asarray(batch.column(0)), STRING))
        if strings:
            rest.append(batch.slice(0, strings))
            size += rest[-1].nbytes
        if size >= _SORT and strings == batch.num_rows:
            table = pa.Table.from_batches(rest)
            h = np.asarray(table["k1"])
            cut = int(np.argmax(h == h[-1]))
            if cut and (found := _solve(table.slice(0, cut))) is not None:
                yield found
            rest = table.slice(cut).to_batches()
            size = sum(b.nbytes for b in rest) if cut else 0  # a group is whole before it is solved
        if strings < batch.num_rows:
            batch = batch.slice(strings)
            d1, d2 = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            same = np.zeros(len(d1), bool)
            same[1:] = (d1[1:] == d1[:-1]) & (d2[1:] == d2[:-1])
            same[0] = last == (d1[0], d2[0])
            last = (d1[-1], d2[-1])
            if same.any():
                yield batch.filter(pa.array(same)).select(["doc_id", "at", "n"])
    if rest and (found := _solve(pa.Table.from_batches(rest))) is not None:
        yield found


def marks(docs: DataFrame, limit: int = RUNS) -> DataFrame:
    """doc_id, at, n: places at, at + 1, ... whose strings of LENGTH bytes also start earlier. docs: doc_id, text; ids differ."""
    own = docs.where("doc_id IS NOT NULL")
    rows = own.mapInArrow(shared.lean(_runs), _FOUND)
    key = F.when(F.col("kind") == RUN, F.col("h")).otherwise(F.xxhash64("doc_id", "at"))
    dealt = rows.repartition(key).sortWithinPartitions("kind", "h", "r", "doc_id", "at")
    found = shared.keep(dealt.mapInArrow(shared.lean(_firsts), _FOUND), "runs")
    apart = found.where(F.col("kind") == RUN).select("doc_id", "at", "n", "h")
    crowds = shared.keep(apart.groupBy("h").count().where(F.col("count") > limit).select("h", F.lit(True).alias("crowded")), "crowded")
    few = F.broadcast(crowds) if crowds.count() <= MAX_SENT_ANCHORS else crowds
    own_runs = apart.join(few, "h", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    wanted = own_runs.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n", "h", "crowded")).alias("runs"))
    bodies = own.mapInArrow(shared.lean(_packed), "doc_id long, z binary").join(wanted, "doc_id").mapInArrow(shared.lean(_bodies), _DEALT)
    met = bodies.repartition("k1", "k2").sortWithinPartitions("kind", "k1", "k2", "doc_id", "at").mapInArrow(shared.lean(_settled), _MARKS)
    return found.where(F.col("kind") == MARK).select("doc_id", "at", "n").unionByName(met)


def cover(size: int, found: list[tuple[int, int]], length: int = LENGTH) -> np.ndarray:
    """Which bytes the marks' strings cover."""
    edge = np.zeros(size + 1, np.int32)
    for at, n in found:
        edge[at] += 1
        edge[min(at + n + length - 1, size)] -= 1
    return np.cumsum(edge[:-1]) > 0


def _digests(batches):
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out = []
        for doc, z, own in zip(*(batch.column(k).to_pylist() for k in range(3))):
            data = unpack(z)
            gone = cover(len(data), [(x["at"], x["n"]) for x in own or ()])
            spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if spans else data
            out.append((doc, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _plain(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def _per_document(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("marks"))


def removed(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    A null text is empty. Rows with one id are documents of their own; which of them counts as earlier follows a hash of
    the text. Rows with a null id match nothing and lose nothing. An empty table gives no rows. Other columns are left out.
    """
    docs, key = shared.numbered(docs, id_col, text)
    own = _plain(docs, key, text)
    found = _per_document(marks(own))
    if key == id_col:
        whole = own.mapInArrow(shared.lean(_packed), "doc_id long, z binary").join(found, "doc_id", "left")
        return whole.mapInArrow(shared.lean(_digests), _DIGESTS)
    names = docs.select(F.col(key).alias("row"), F.col(id_col).cast("long").alias("doc_id")).where("row IS NOT NULL")
    whole = own.mapInArrow(shared.lean(_packed), "doc_id long, z binary").join(found, "doc_id", "left").mapInArrow(shared.lean(_digests), _DIGESTS)
    return whole.withColumnRenamed("doc_id", "row").join(names, "row", "left").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


_DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def strip_text(text: str, found: list[tuple[int, int]]) -> str:
    """The text without what marks cover; a character that is covered in part stays."""
    data = text.encode("utf-8", "replace")
    gone = cover(len(data), found)
    raw = np.frombuffer(data, np.uint8)
    begins = np.flatnonzero((raw & 0xC0) != 0x80)
    whole = np.logical_and.reduceat(gone, begins) if len(begins) else gone
    return raw[~np.repeat(whole, np.diff(np.append(begins, len(raw))))].tobytes().decode("utf-8") if len(begins) else text


def _stripped(batches):
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        texts = [None if z is None else unpack(z).decode("utf-8") for z in batch.column(1).to_pylist()]
        texts = [x if x is None or not own else strip_text(x, [(m["at"], m["n"]) for m in own]) for x, own in zip(texts, batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["meta", "text"])


def _packed_with_meta(batches):
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        z = [None if x is None else pack(x.encode("utf-8", "replace")) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary())], ["id", "meta", "z"])


def strip(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with the texts that are left and their lengths, all other columns as they were.

    A null text stays null, and one of which nothing is left becomes empty. Rows with a null id stay as they are. Rows with
    one id are documents of their own, as in removed. An empty table gives no rows. Other columns may have any names.
    """
    docs, key = shared.numbered(names := docs, id_col, text)
    found = _per_document(marks(_plain(docs, key, text)))
    # texts are packed before they travel
    rows = docs.select(F.col(key).cast("long").alias("id"), F.struct(*[docs[c] for c in names.columns if c != text] or [F.lit(0).alias("none")]).alias("meta"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([rows.schema["id"], rows.schema["meta"], T.StructField("z", T.BinaryType())])
    kept = rows.mapInArrow(shared.lean(_packed_with_meta), schema).join(found, F.col("id") == F.col("doc_id"), "left").select("meta", "z", "marks")
    out = kept.mapInArrow(shared.lean(_stripped), T.StructType([rows.schema["meta"], T.StructField("text", T.StringType())]))
    columns = {text: F.col("text").alias(text)}
    if length_col in names.columns:
        columns[length_col] = F.length("text").cast(names.schema[length_col].dataType).alias(length_col)
    return out.select(*[columns[c] if c in columns else F.col("meta")[c].alias(c) for c in names.columns])
