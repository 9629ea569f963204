"""Near duplicates by SimHash: fingerprints over word shingles, found with BK-trees.

Distinct fingerprints are dealt to shards so that any two within the radius share one: the 64 bits are cut into blocks,
and fingerprints that differ in at most r bits agree in all but r of them. Each shard is a BK-tree, where a child hangs
from its parent by the number of bits in which they differ, and a search follows only edges within the radius. Trees of
a task are built and searched together as arrays. A shard returns a star for each of its groups, not its pairs, and the
stars are joined to components. For links by similarity these are only candidates: within each, texts are linked by the
exact similarity of their shingles.

Trees are not broadcast: they grow with the corpus. Fingerprints travel to their shards instead. A shard or a group of
candidates with more members than a task should hold (one text may have any number of near copies) is first thinned out
by pivots, as crowds.py says, and only what they leave meets in blocks.
"""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import components, crowds, shared, textscan

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints of a sketch, for links by similarity instead of bits.
LANES = 4
#: Of pairs that are just similar enough, the shares that the tables and the radius of a sketch should find as candidates.
RECALL, WITHIN = 0.999, 0.999
#: Shingles of a group of candidates whose texts meet in a task; a larger group has pivots and blocks.
BLOCK = 1 << 17
#: Fingerprints of a shard that are searched in a task; a larger shard has pivots and blocks.
CROWD = 1 << 16
#: Shards that large are found from one in so many representatives, by hash; all members of a shard so found are dealt anew.
ONE_IN = 64
#: Up to so many ids to remove are sent to the executors; more are joined by shuffle.
MAX_SENT_IDS = 1_000_000
#: Fingerprints that a shard holds by chance, at most, before bits are cut into more blocks.
SHARD = 256
_ROWS = 1 << 17
#: Pairs of a seeker and a node that a search holds at once.
_FRONT = 1 << 17


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of a shorter text its words as one shingle; of none nothing."""
    own = text.encode("utf-8", "replace").lower().split()  # ASCII letters and white space alone
    if not own:
        return np.empty(0, "<u8")
    joined = b" ".join(own)
    digest = xxhash.xxh64_intdigest
    if len(own) <= words:
        return np.array([digest(joined, SEED)], "<u8")
    n = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(n + 1) - 1
    starts = (ends - n)[: len(own) - words + 1].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())], "<u8")


def majority(h: np.ndarray) -> np.ndarray:
    """A bit is 1 if set in over half of h."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[i : i + (1 << 16)])
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(h), bitorder="little").view("<u8")


def fingerprint(text: str, words: int = SHINGLE) -> int:
    return int(majority(shingle_hashes(text, words))[0])


def _sketch(h: np.ndarray) -> bytes:
    return b"".join(majority(textscan.mix(h + np.uint64(j) * np.uint64(0xA0761D6478BD642F)) if j else h).tobytes() for j in range(LANES))


def sketch(text: str, words: int) -> bytes:
    """LANES fingerprints, from as many hashes of each distinct shingle: similarity is between sets."""
    return _sketch(np.unique(shingle_hashes(text, words)))


def _fingerprints(words: int):
    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(x, words) for x in textscan.strings(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = SHINGLE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (64 bits as a long) of every row; a null text is empty and has fingerprint 0."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(shared.lean(_fingerprints(words)), "doc_id long, fp long")


def masks(n: int, radius: int = RADIUS) -> list[int]:
    """Bits on which two fingerprints within the radius agree, for at least one of the masks; more blocks for more fingerprints."""
    for blocks in range(radius + 1, 2 * radius + 1):
        edges = [round(64 * i / blocks) for i in range(blocks + 1)]
        parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
        found = [sum(c) for c in itertools.combinations(parts, blocks - radius)]
        if n >> min(m.bit_count() for m in found) <= SHARD:
            break
    return found


class Forest:
    """BK-trees over fp (a word or a row of words each), one for each group. Items of a group must stand together; the first is its root."""

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        n = len(fp)
        self.fp = fp.reshape(n, -1)
        self.most = 64 * self.fp.shape[1] + 1  # more than any distance
        first = np.ones(n, bool)
        first[1:] = group[1:] != group[:-1]
        self.root = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        self.parent, self.edge = np.full(n, -1), np.full(n, self.most)
        self.rounds: list[np.ndarray] = []  # items by depth
        item = np.flatnonzero(~first)
        at = self.root[item]
        while len(item):
            d = self._distance(item, at)
            order = np.argsort(at * self.most + d, kind="stable")
            item, at, d = item[order], at[order], d[order]
            head = np.ones(len(item), bool)
            head[1:] = (at[1:] != at[:-1]) | (d[1:] != d[:-1])
            child = item[head]
            self.parent[child], self.edge[child] = at[head], d[head]
            self.rounds.append(child)
            at = child[np.cumsum(head) - 1][~head]
            item = item[~head]
        kids = np.flatnonzero(self.parent >= 0)
        key = self.parent[kids] * self.most + self.edge[kids]
        order = np.argsort(key)
        self.kids, self.key = kids[order], key[order]

    def _distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fp[a] ^ self.fp[b]).sum(1, dtype=np.int64)

    def groups(self, radius: int) -> np.ndarray:
        """The smallest item linked to each item through items of its tree.

        Tree edges within the radius link at once. A search skips a subtree whose items are all linked to the seeker.
        """
        n = len(self.fp)
        label = np.arange(n)
        for child in self.rounds:
            near = child[self.edge[child] <= radius]
            label[near] = label[self.parent[near]]
        # a few seekers go first: what they link lets the many after them skip whole subtrees
        a, step = 0, 1024
        while a < n:
            links = self._search(np.arange(a, min(a + step, n)), label, radius)
            if links:
                label = _merged(label, links)
            a, step = a + step, step * 4
        return label

    def _search(self, seekers: np.ndarray, label: np.ndarray, radius: int) -> set[tuple[int, int]]:
        low, high = label.copy(), label.copy()
        for child in reversed(self.rounds):
            np.minimum.at(low, self.parent[child], low[child])
            np.maximum.at(high, self.parent[child], high[child])
        links: set[tuple[int, int]] = set()
        # what is to be done: seekers, and the slices of kids that each one goes on to; their nodes are laid out only then
        todo = [(seekers[a : a + _FRONT], self.root[seekers[a : a + _FRONT]], None) for a in range(0, len(seekers), _FRONT)]
        while todo:
            seeker, node, count = todo.pop()
            if count is not None:
                seeker, node = np.repeat(seeker, count), self.kids[textscan.slices(node, count)]
            done = (low[node] == high[node]) & (low[node] == label[seeker])
            seeker, node = seeker[~done], node[~done]
            if not len(seeker):
                continue
            d = self._distance(seeker, node)
            hit = (d <= radius) & (label[seeker] != label[node])
            if hit.any():
                pairs = np.unique(label[seeker[hit]] * len(label) + label[node[hit]])
                links.update(zip((pairs // len(label)).tolist(), (pairs % len(label)).tolist()))
            lo = np.searchsorted(self.key, node * self.most + np.maximum(d - radius, 0))
            count = np.searchsorted(self.key, node * self.most + np.minimum(d + radius, self.most - 1), "right") - lo
            some = count > 0
            seeker, lo, count = seeker[some], lo[some], count[some]
            upto = np.cumsum(count)
            cut = [0, *np.searchsorted(upto, np.arange(_FRONT, upto[-1] if len(upto) else 0, _FRONT)).tolist(), len(count)]
            todo += [(seeker[a:b], lo[a:b], count[a:b]) for a, b in itertools.pairwise(cut) if b > a]
        return links


def _merged(label: np.ndarray, links: set[tuple[int, int]]) -> np.ndarray:
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    again = np.arange(len(label))
    again[np.fromiter(up, np.int64, len(up))] = [top(x) for x in list(up)]
    return again[label]


def _stars(radius: int):
    """Of rows (mask, bits, i, j, rep, words of the fingerprint) sorted by task and rep: each row that isn't the first of its group, with that first."""

    def shard(table):
        return [np.asarray(table[c]) for c in _SHARD]

    def solve(table):
        rep = np.asarray(table["rep"])
        fp = np.stack([np.asarray(c) for c in table.columns[5:]], axis=1).view(np.uint64)
        new = np.ones(len(fp), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in shard(table)], axis=0)
        label = Forest(fp, np.cumsum(new)).groups(radius)
        tied = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(rep[tied]), pa.array(rep[label[tied]])], ["u", "v"])

    def run(batches):
        rest, size = [], 0
        for batch in batches:
            rest.append(batch)
            size += batch.num_rows
            if size < _ROWS:
                continue
            table = pa.Table.from_batches(rest).combine_chunks()
            cut = int(np.argmax(np.all([c == c[-1] for c in shard(table)], axis=0)))
            if cut:
                yield solve(table.slice(0, cut).combine_chunks())
            rest = table.slice(cut).to_batches()
            size = len(table) - cut
        if size:
            yield solve(pa.Table.from_batches(rest).combine_chunks())

    return run


_SHARD = ["mask", "bits", "i", "j"]


def _differ(words: list[str]) -> Column:
    """Bits in which a member differs from its pivot."""
    return sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"pivot.{w}"))) for w in words[1:]), F.bit_count(F.col(words[0]).bitwiseXOR(F.col(f"pivot.{words[0]}"))))


def _starred(dealt: DataFrame, words: list[str], radius: int, crowd: int = CROWD, one_in: int = ONE_IN) -> DataFrame:
    """Edges (u, v) that leave the components of each shard's links. dealt: mask, bits, rep and the words of a fingerprint."""
    key = ["mask", "bits"]
    some = dealt.where(F.pmod(F.xxhash64("rep"), F.lit(one_in)) == 0)
    hot = shared.keep(some.groupBy(*key).count().where(F.col("count") * one_in >= crowd).select(*key), "hot")
    plain, edges = dealt, None
    if hot.limit(1).count():
        few = crowds.sent(hot)
        plain = dealt.join(few, key, "left_anti")
        members = dealt.join(few, key, "left_semi").withColumn("weight", F.lit(1).cast("long"))
        near = lambda df: df.withColumns({"near": _differ(words) <= radius, "tied": F.col("pivot.rep")})
        edges, again = crowds.settle(members, key, words, near, crowd)
    zero = F.lit(0).cast("int")
    met = plain.select(*key, zero.alias("i"), zero.alias("j"), "rep", *words)
    if edges is not None:
        met = met.unionByName(again)
    met = met.repartition(*_SHARD).sortWithinPartitions(*_SHARD, "rep").mapInArrow(shared.lean(_stars(radius)), "u long, v long")
    return met if edges is None else met.unionByName(edges)


def links(fps: DataFrame, radius: int = RADIUS, crowd: int = CROWD, one_in: int = ONE_IN) -> DataFrame:
    """Edges (u, v) between representatives that leave the components of all links within the radius. fps: fp, rep."""
    found = masks(fps.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in found]
    shards = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(signed)]))
    dealt = fps.select("fp", "rep", shards.alias("s")).select("s.mask", "s.bits", "rep", "fp")
    return _starred(dealt, ["fp"], radius, crowd, one_in)


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach, for every row.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows with one id keep a row each. A row with
    a null id has a fingerprint, links nothing, and gets the component of its fingerprint where another row has it, else
    null. An empty table gives no rows. Other columns are left out.
    """
    own = shared.keep(fingerprints(docs, words, id_col, text), "fingerprints")
    fps = shared.keep(own.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    tied = components.components(links(fps, radius)).withColumnsRenamed({"u": "rep", "v": "_least"})
    # written, so that Spark can split the rows of a fingerprint that very many documents have
    found = shared.keep(fps.join(tied, "rep", "left").select("fp", F.coalesce("_least", "rep").alias("component_id")), "found")
    return own.join(found, "fp", "left").select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


def differing(similarity: float) -> float:
    """The share of bits in which texts of that Jaccard similarity differ, from the angle between their sets."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tables(n: int, similarity: float) -> list[np.ndarray]:
    """Places of a sketch's bits that make the key of each table: enough bits that n sketches leave about 64 to a shard,
    and enough tables that a pair just similar enough shares a shard with probability RECALL."""
    bits = max(8, math.ceil(math.log2(max(n, 1) / 64 + 1)))
    alike = (1 - differing(similarity)) ** bits
    rng = np.random.default_rng(SEED)
    return [np.sort(rng.choice(64 * LANES, bits, replace=False)) for _ in range(math.ceil(math.log(1 - RECALL) / math.log1p(-alike)))]


def radius_for(similarity: float) -> int:
    """Bits in which a pair just similar enough differs at most, with probability WITHIN."""
    p, n = differing(similarity), 64 * LANES
    return math.ceil(NormalDist(n * p, math.sqrt(n * p * (1 - p))).inv_cdf(WITHIN))


_WORDS = [f"w{j}" for j in range(LANES)]
_SKETCHED = f"doc_id long, known long, size long, own binary, {', '.join(f'{w} long' for w in _WORDS)}"


def _sketches(words: int):
    def run(batches):
        for batch in batches:
            size, own, prints = [], [], []
            for x in textscan.strings(batch.column(1)):
                h = np.unique(shingle_hashes(x, words))
                size.append(len(h))
                own.append(xxhash.xxh3_128_digest(h.tobytes()))
                prints.append(_sketch(h))
            lanes = np.frombuffer(b"".join(prints), "<i8").reshape(-1, LANES)
            columns = [batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(own, pa.binary()), *(pa.array(np.ascontiguousarray(c)) for c in lanes.T)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "known", "size", "own", *_WORDS])

    return run


def _dealt(places: list[np.ndarray]):
    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 1 << 14):
                batch = whole.slice(a, 1 << 14)
                lanes = np.stack([np.asarray(c) for c in batch.columns[1:]], axis=1)
                bits = np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little")
                for t, own in enumerate(places):
                    key = bits[:, own].astype(np.int64) @ (1 << np.arange(len(own)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(key), *batch.columns], ["mask", "bits", "rep", *_WORDS])

    return run


def linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The smallest place that links reach from each of the sorted sets; sets of at least that Jaccard similarity are linked."""
    n = np.array([len(x) for x in sets])
    label = np.arange(len(sets))
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(label, n)
    order = np.argsort(shingle, kind="stable")
    holders, first = owner[order], np.concatenate([[0], np.cumsum(np.bincount(shingle))])
    for i, own in enumerate(np.split(shingle, np.cumsum(n)[:-1])):
        both = np.bincount(holders[textscan.slices(first[own], first[own + 1] - first[own])], minlength=len(sets))
        near = np.unique(label[both >= similarity * (n[i] + n - both) - 1e-9])
        if len(near) > 1:
            label[np.isin(label, near)] = near[0]
            if not label.any():
                break
    return label


def _packed(batches):
    """Of (label, rep, weight, text): the text packed."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = pa.array([pack(x.encode("utf-8", "surrogatepass")) for x in textscan.strings(batch.column(3))], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], texts], ["label", "rep", "weight", "body"])


_MEMBER = "label long, rep long, weight long, body binary"


def _shingles(body: bytes, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(zstandard.ZstdDecompressor().decompress(body).decode("utf-8", "surrogatepass"), words))


def _as_similar(words: int, similarity: float):
    """Of (label, rep, body, the pivot's rep and body): whether the two are as similar as that."""

    def run(batches):
        pivot, own = None, None
        for batch in batches:
            near = []
            for body, rep, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if rep != pivot:
                    pivot, own = rep, _shingles(other, words)
                h = _shingles(body, words)
                both = len(np.intersect1d(h, own, assume_unique=True))
                near.append(both >= similarity * (len(h) + len(own) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(near, pa.bool_())], ["label", "rep", "tied", "near"])

    return run


def _confirmed(words: int, similarity: float):
    """Of rows (label, i, j, rep, body) sorted by these: stars of texts that are as similar as that."""

    def solve(found: dict[int, bytes]):
        reps = np.array(list(found), np.int64)
        label = linked([_shingles(x, words) for x in found.values()], similarity)
        tied = np.flatnonzero(label != np.arange(len(reps)))
        return pa.RecordBatch.from_arrays([pa.array(reps[tied]), pa.array(reps[label[tied]])], ["u", "v"])

    def run(batches):
        now, found = None, {}
        for batch in batches:
            for *key, rep, body in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    if len(found) > 1:
                        yield solve(found)
                    now, found = key, {}
                found[rep] = body
        if len(found) > 1:
            yield solve(found)

    return run


def _exact(candidates: DataFrame, distinct: DataFrame, plain: DataFrame, words: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that leave the components of all pairs of that similarity within the components of the candidates.

    A group's texts meet in one task. A group of over block shingles has pivots, and what they leave meets in blocks.
    """
    tied = components.components(candidates)
    grouped = tied.select(F.col("u").alias("rep"), F.col("v").alias("label")).unionByName(tied.select(F.col("v").alias("rep"), F.col("v").alias("label")).distinct())
    wanted = shared.keep(grouped.join(distinct.select("rep", "known", F.col("size").alias("weight")), "rep"), "groups")
    large = shared.keep(wanted.groupBy("label").agg(F.sum("weight").alias("weight")).where(F.col("weight") > block).select("label"), "large")
    few = F.broadcast(wanted) if wanted.count() <= MAX_SENT_IDS else wanted
    texts = plain.join(few, (F.col("doc_id") == F.col("rep")) & (plain["known"] == few["known"])).select("label", "rep", "weight", "text")
    # a text that stands in several rows of one id is taken once, as a group's tasks hold each member once
    members = texts.mapInArrow(shared.lean(_packed), _MEMBER)
    zero = F.lit(0).cast("int")
    if large.limit(1).count():
        members = shared.keep(members, "members")
        met = members.join(crowds.sent(large), "label", "left_anti")
        crowd = members.join(crowds.sent(large), "label", "left_semi").dropDuplicates(["label", "rep"])

        def near(df: DataFrame) -> DataFrame:
            sides = df.select("label", "rep", "body", F.col("pivot.rep").alias("tied"), F.col("pivot.body").alias("other"))
            return sides.mapInArrow(shared.lean(_as_similar(words, similarity)), "label long, rep long, tied long, near boolean")

        edges, again = crowds.settle(crowd, ["label"], ["body"], near, block)
        met = met.select("label", zero.alias("i"), zero.alias("j"), "rep", "body").unionByName(again)
    else:
        met, edges = members.select("label", zero.alias("i"), zero.alias("j"), "rep", "body"), None
    found = met.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "rep").mapInArrow(shared.lean(_confirmed(words, similarity)), "u long, v long")
    return found if edges is None else found.unionByName(edges)


def _plain(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return plain.withColumn("known", F.xxhash64("text"))


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text: str = "text", crowd: int = CROWD, one_in: int = ONE_IN, block: int = BLOCK) -> DataFrame:
    """doc_id, known (a hash of the text), own (a digest of its set of shingles) and component_id of every row, linked
    where word shingles have the similarity.

    Candidates come from the same trees, over 64 * LANES bits. At such distances no cut of the bits leaves a common part,
    so shards come from tables of sampled bits, as many as RECALL asks for. Links are confirmed by the shingles
    themselves. Nulls, empty texts and repeated ids are as in near_duplicates.
    """
    plain = _plain(docs, id_col, text)
    own = shared.keep(plain.select("doc_id", "text", "known").mapInArrow(shared.lean(_sketches(words)), _SKETCHED), "sketches")
    least = F.min(F.struct("doc_id", "known", "size", *_WORDS)).alias("least")
    distinct = shared.keep(own.where("doc_id IS NOT NULL").groupBy("own").agg(least).select("own", F.col("least.doc_id").alias("rep"), "least.known", "least.size", *[f"least.{w}" for w in _WORDS]), "distinct")
    places = tables(distinct.count(), similarity)
    dealt = distinct.select("rep", *_WORDS).mapInArrow(shared.lean(_dealt(places)), f"mask int, bits long, rep long, {', '.join(f'{w} long' for w in _WORDS)}")
    candidates = shared.keep(_starred(dealt, _WORDS, radius_for(similarity), crowd, one_in), "candidates")
    edges = shared.keep(_exact(candidates, distinct, plain, words, similarity, block), "edges")
    tied = components.components(edges).withColumnsRenamed({"u": "rep", "v": "_least"})
    found = shared.keep(distinct.join(tied, "rep", "left").select("own", F.coalesce("_least", "rep").alias("component_id")), "found")
    return own.join(found, "own", "left").select("doc_id", "known", "own", "component_id")


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are the smallest doc_id of their component of similar texts, unchanged.

    A null text is empty, and all empty texts are copies. Rows with a null id stay. Rows with one id are documents of their
    own; which of them counts as smaller follows a hash of the text. An empty table gives no rows. Other columns may have
    any names.
    """
    docs, own = shared.numbered(names := docs, id_col, text)
    found = similar(docs, words, similarity, own, text)
    key = shared.unused(docs, "key")
    gone = shared.keep(found.where("doc_id IS NOT NULL AND doc_id <> component_id").select(F.col("doc_id").alias(key)), "gone")
    few = F.broadcast(gone) if gone.count() <= MAX_SENT_IDS else gone
    return docs.join(few, F.col(own).cast("long") == F.col(key), "left_anti").select(*names.columns)
