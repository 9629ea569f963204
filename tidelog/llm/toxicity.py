"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Each class has a model of the next letter of a word after the letters before it. Its counts are discounted, and what
that frees goes to a Kneser-Ney model over both classes with the same context, so rare expressions are smoothed by what
all texts share and only what a class says more often than the other counts. Lower orders, down to SHORTEST, use
continuation counts (how many different letters stand before), except at the start of a word. A word's ratio is the
difference of its log-likelihoods under both models; what exceeds MARGIN is evidence, as smaller ratios come by chance.
A text's evidence is divided by its length in words, and a logistic function, fitted on labelled rows that were kept out of
the counts, makes a score of it.

Nothing here is collected but the rows of that function. Every distinct word of the corpus is asked about once. Its windows
(a letter with those before it) go to the bucket of their last letters, where all n-grams that decide on them meet, counted
ones as well, and where the two models are made. Buckets answer with ratios; words with evidence are a written table.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import shared, textscan
from tidelog.llm.tokencount import _HEAD, _ROWS, BUCKETS, _arrays, _body

ORDER, SHORTEST = 6, 4
DISCOUNT = 1.5
#: A smaller ratio of a word is no evidence.
MARGIN = 3.5
#: Labelled documents that the logistic function is fitted on, at most; those with the smallest hashes of their ids. All others are counted.
MAX_CALIBRATION = 20_000
#: Words of a block that asks about its windows.
BLOCK_WORDS = 1 << 15
#: Up to so many labels are sent to the executors; more are joined by shuffle.
MAX_SENT_LABELS = 2_000_000
#: Up to so many words with evidence are sent to the executors, 12 bytes each; more are joined by shuffle.
MAX_SENT_WORDS = 2_000_000
#: Bits of the map that screens a document's words for that join: 2 MB sent, and 64 MB of set bits in the driver at most.
BITS = 24
_FIRST, _LAST = 1, 2  # symbols for a word's start and end
_SYMBOLS = 1 << 10  # below the shortest order all symbols are alike


def words_of(texts: list[str]):
    """Letters of all texts in small form, as (code points, starts, ends, documents, hashes) of words."""
    cp, at = textscan.codepoints(texts)
    cp = textscan.lowered(cp)
    if not len(cp):
        empty = np.empty(0, np.int64)
        return cp, empty, empty, empty, np.empty(0, np.uint64)
    letter = textscan.classes()[cp] == textscan.LETTER
    first = textscan._flags(len(cp), at)
    begins, stops = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1] | first[1 : len(cp)]
    stops[:-1] &= ~letter[1:] | first[1 : len(cp)]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return cp, starts, ends, textscan.owners(at, starts), textscan.piece_hash(textscan.sums(textscan.values_of(cp)), starts, ends)


def _text(cp: np.ndarray) -> str:
    return cp.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _word_counts(batches):
    """Of (text, label; null where it isn't counted): each word of a batch with its counts in ordinary and in toxic texts."""
    for batch in batches:
        texts = textscan.strings(batch.column(0))
        label = np.array([-1 if x is None else int(bool(x)) for x in batch.column(1).to_pylist()])
        for a, b in textscan.chunks(texts):
            cp, starts, ends, docs, hashes = words_of(texts[a:b])
            distinct, sample, back = np.unique(hashes, return_index=True, return_inverse=True)
            own, joined = label[a:b][docs], _text(cp)
            names = [joined[x:y] for x, y in zip(starts[sample].tolist(), ends[sample].tolist())]
            n = [np.bincount(back[own == k], minlength=len(distinct)).astype(np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n[0]), pa.array(n[1])], ["word", "ordinary", "toxic"])


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For every letter and end of every word its window: it and up to ORDER - 1 symbols before it, as a row that ends with
    it (0 before a word's start). And the word of each."""
    cp, at = textscan.codepoints(words)
    n = np.diff(at)
    owner = np.repeat(np.arange(len(words)), n + 1)
    begin = ORDER * np.arange(len(words)) + at[:-1] + np.arange(len(words))  # ORDER - 1 empty places and one for the end, behind each other
    line = np.zeros(len(cp) + (ORDER + 1) * len(words), np.uint32)
    line[begin + ORDER - 1] = _FIRST
    line[textscan.slices(begin + ORDER, n)] = cp
    line[begin + ORDER + n] = _LAST
    end = textscan.slices(begin + ORDER, n + 1)
    return np.lib.stride_tricks.sliding_window_view(line, ORDER)[end - ORDER + 1] if len(end) else np.empty((0, ORDER), np.uint32), owner


def key_of(rows: np.ndarray) -> np.ndarray:
    """A hash of the SHORTEST - 1 symbols before the last: all n-grams of these orders that decide on a window share them."""
    out = np.zeros(len(rows), np.uint64)
    for c in range(ORDER - SHORTEST, ORDER - 1):
        out = textscan.mix(out + rows[:, c].astype(np.uint64) + np.uint64(1))
    return out


def _hashes(rows: np.ndarray) -> list[np.ndarray]:
    """Hashes of the last k symbols of every row, for each k."""
    out = [np.zeros(len(rows), np.uint64)]
    for c in range(rows.shape[1] - 1, -1, -1):
        out.append(textscan.mix(out[-1] * np.uint64(0x9E3779B97F4A7C15) + rows[:, c].astype(np.uint64) + np.uint64(1)))
    return out


def _find(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in the sorted known, -1 where it isn't there."""
    if not len(known):
        return np.full(len(wanted), -1)
    i = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[i] == wanted, i, -1)


def ratios(rows: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """log P(symbol | toxic) - log P(symbol | ordinary) for every window, from the counts of all of them.

    The windows must be all that share the symbols of key_of, so that no n-gram is missed. A symbol is told from the
    longest context that was ever counted; without any, the ratio is 0.
    """
    gram, ctx = _hashes(rows), _hashes(rows[:, :-1])
    size = (rows != 0).sum(1)
    counted = ordinary + toxic > 0
    n = np.stack([ordinary, toxic, ordinary + toxic]).astype(np.float64)
    out, open_ = np.zeros(len(rows)), np.ones(len(rows), bool)
    levels: dict[int, tuple] = {}
    longer = None
    for k in range(ORDER, 1, -1):  # counts: whole windows as they are, shorter ones by how many go on to the left
        whole = np.flatnonzero((size == k) & counted)
        row, a = whole, n[:, whole]
        if longer is not None and k >= SHORTEST:
            row, a = np.concatenate([row, longer[0]]), np.concatenate([a, (longer[1] > 0).astype(np.float64)], axis=1)
        name, first, back = np.unique(gram[k][row], return_index=True, return_inverse=True)
        a = np.stack([np.bincount(back, x, len(name)) for x in a])
        longer = row[first], a
        levels[k] = name, row[first], a
    below: tuple | None = None
    for k in range(2, ORDER + 1):
        name, row, a = levels[k]
        context, c = np.unique(ctx[k - 1][row], return_inverse=True)
        total = np.stack([np.bincount(c, x, len(context)) for x in a])
        free = np.stack([np.bincount(c, np.minimum(x, DISCOUNT), len(context)) for x in a])
        with np.errstate(divide="ignore", invalid="ignore"):
            free = np.where(total > 0, free / total, 1.0)
            seen = np.where(total[:, c] > 0, np.maximum(a - DISCOUNT, 0) / total[:, c], 0.0)
        tail = np.full(len(row), 1 / _SYMBOLS)
        if below is not None and k > SHORTEST:
            i = _find(below[0], gram[k - 1][row])
            tail = np.where(i >= 0, below[1][i], tail)
        both = seen[2] + free[2, c] * tail
        each = seen[:2] + free[:2, c] * both
        levels[k] = name, np.log(each[1]) - np.log(each[0]), context, np.log(free[1]) - np.log(free[0])
        below = name, both
    for k in range(ORDER, 1, -1):
        name, ratio, context, unseen = levels[k]
        todo = np.flatnonzero(open_ & ((size == k) | ((size > k) & (k >= SHORTEST))))
        i = _find(context, ctx[k - 1][todo])
        todo, i = todo[i >= 0], i[i >= 0]
        j = _find(name, gram[k][todo])
        out[todo] = np.where(j >= 0, ratio[j] if len(ratio) else 0.0, unseen[i])
        open_[todo] = False
    return out


def _blocks(batches):
    """Words with their counts, in blocks of bounded size."""
    held, n = [], 0
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK_WORDS):
            part = batch.slice(a, BLOCK_WORDS)
            if n + part.num_rows > BLOCK_WORDS:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _asked(buckets: int):
    """Of (word, ordinary, toxic): a row with the words, and a row for each bucket with their distinct windows and counts."""

    def run(batches):
        pack, number = zstandard.ZstdCompressor(level=3).compress, TaskContext.get().partitionId() << 32
        for table in _blocks(batches):
            words, o, t = table["word"].to_pylist(), np.asarray(table["ordinary"]), np.asarray(table["toxic"])
            every, owner = windows(words)
            # many words begin or end alike: each window is asked about once, with the counts of all its words
            _, first, back = np.unique(_hashes(every)[ORDER], return_index=True, return_inverse=True)
            rows = every[first]
            n = [np.bincount(back, x[owner], len(rows)).astype("<i8") for x in (o, t)]
            bucket = (key_of(rows) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            some, begin = np.unique(bucket[order], return_index=True)
            bodies = [_body(pack, np.frombuffer("\n".join(words).encode(), "u1"), np.bincount(owner, minlength=len(words)).astype("<u4"), place[back].astype("<u4"))]
            edges = [*begin.tolist(), len(order)]
            for x, y in zip(edges, edges[1:]):
                own = order[x:y]
                bodies.append(_body(pack, rows[own].astype("<u4"), n[0][own], n[1][own]))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(_HEAD, some).astype(np.int32)), pa.array(np.full(len(some) + 1, number)), pa.array(bodies, pa.binary())], ["bucket", "block", "body"])
            number += 1

    return run


def _answered(batches):
    """Of rows sorted by bucket: the ratios of its windows, from the counts of all rows of the bucket. Rows with words pass."""
    pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress

    def solve(bucket, held):
        rows, o, t = (np.concatenate(x) for x in zip(*(_arrays(unpack(body), "<u4", "<i8", "<i8") for _, body in held)))
        found = ratios(rows.reshape(-1, ORDER), o, t).astype("<f4")
        sizes = [len(_arrays(unpack(body), "<u4")[0]) // ORDER for _, body in held]
        bodies = [pack(x.tobytes()) for x in np.split(found, np.cumsum(sizes)[:-1])]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(held), bucket, np.int32)), pa.array([b for b, _ in held], pa.int64()), pa.array(bodies, pa.binary())], ["bucket", "block", "body"])

    now, held = None, []
    for batch in batches:
        heads = np.asarray(batch.column(0)) == _HEAD
        if heads.any():
            yield batch.filter(pa.array(heads))
        for bucket, block, body in zip(*(c.to_pylist() for c in batch.filter(pa.array(~heads)).columns)):
            if bucket != now and held:
                yield solve(now, held)
                held = []
            now = bucket
            held.append((block, body))
    if held:
        yield solve(now, held)


def _evidence(margin: float):
    """Of rows sorted by block and bucket: words whose ratio exceeds margin, and by how much."""

    def done(head: bytes, answers: list[bytes]):
        words, size, place = _arrays(head, "u1", "<u4", "<u4")
        words, ratio = words.tobytes().decode().split("\n"), np.frombuffer(b"".join(answers), "<f4")
        if len(ratio) != len(np.unique(place)):
            raise ValueError("a block's buckets did not all answer")
        total = np.bincount(np.repeat(np.arange(len(words)), size), ratio[place], len(words)) - margin
        loud = np.flatnonzero(total > 0)
        return pa.RecordBatch.from_arrays([pa.array([words[i] for i in loud.tolist()], pa.string()), pa.array(total[loud])], ["word", "excess"])

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        head, answers = None, []
        for batch in batches:
            for bucket, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if bucket == _HEAD:
                    if head is not None:
                        yield done(head, answers)
                    head, answers = unpack(body), []
                else:
                    answers.append(unpack(body))
        if head is not None:
            yield done(head, answers)

    return run


def evidence(vocabulary: DataFrame, margin: float = MARGIN) -> DataFrame:
    """word, excess of the words whose log-likelihood ratio exceeds margin. vocabulary: word, ordinary, toxic; words differ."""
    buckets = max(BUCKETS, 4 * int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = vocabulary.select("word", "ordinary", "toxic").mapInArrow(shared.lean(_asked(buckets)), _ROWS)
    met = rows.repartition("bucket", F.when(F.col("bucket") == _HEAD, F.col("block"))).sortWithinPartitions("bucket")
    answers = met.mapInArrow(shared.lean(_answered), _ROWS)
    return answers.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(shared.lean(_evidence(margin)), "word string, excess double")


def _word_hash(words: list[str]) -> np.ndarray:
    cp, at = textscan.codepoints(words)
    return textscan.piece_hash(textscan.sums(textscan.values_of(cp)), at[:-1], at[1:]) if len(words) else np.empty(0, np.uint64)


_FEATURE = "doc_id long, label int, x double"


def _summed(sent):
    """Of (doc_id, label, text): evidence for each word of the text, by the words that were sent."""

    def run(batches):
        known, value = sent.value
        for batch in batches:
            texts, x = textscan.strings(batch.column(2)), np.zeros(batch.num_rows)
            for a, b in textscan.chunks(texts):
                _, starts, _, docs, hashes = words_of(texts[a:b])
                if len(starts) and len(known):
                    i = _find(known, hashes)
                    loud = np.where(i >= 0, value[i], 0.0)
                    x[a:b] = np.bincount(docs, loud, b - a) / np.maximum(np.bincount(docs, minlength=b - a), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x)], ["doc_id", "label", "x"])

    return run


def _screened(sent):
    """Of (doc_id, label, text): a row for each text with its number of words, and one for each word that the map has.

    A text's own row has a word that is none, another for each, so that a join by words spreads these rows.
    """

    def run(batches):
        bits = np.unpackbits(np.frombuffer(sent.value, np.uint8), bitorder="little").view(bool)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts, ids, labels = textscan.strings(batch.column(2)), batch.column(0), batch.column(1)
            for a, b in textscan.chunks(texts):
                cp, starts, ends, docs, hashes = words_of(texts[a:b])
                n = np.bincount(docs, minlength=b - a)
                hit = np.flatnonzero(bits[(hashes >> np.uint64(64 - BITS)).astype(np.int64)])
                pair, first, freq = np.unique(np.stack([docs[hit].astype(np.uint64), hashes[hit]]), axis=1, return_index=True, return_counts=True)
                joined, own = _text(cp), hit[first]
                names = [joined[x:y] for x, y in zip(starts[own].tolist(), ends[own].tolist())]
                rows = np.concatenate([np.arange(b - a), pair[0].astype(np.int64)])
                none = [f"\n{number + i}" for i in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number + rows), ids.take(pa.array(a + rows)), labels.take(pa.array(a + rows)), pa.array([*n.tolist(), *[None] * len(own)], pa.int64()), pa.array([*none, *names], pa.string()), pa.array([*[None] * len(none), *freq.tolist()], pa.int64())],
                    ["row", "doc_id", "label", "n", "word", "freq"],
                )
                number += b - a

    return run


def features(docs: DataFrame, words: DataFrame, most: int = MAX_SENT_WORDS) -> DataFrame:
    """doc_id, label, x: a text's evidence for each of its words. docs: doc_id, label, text. words: word, excess, a written table."""
    spark = docs.sparkSession
    if words.count() <= most:
        table = words.toArrow()
        hashes = _word_hash(table["word"].to_pylist())
        order = np.argsort(hashes)
        sent = spark.sparkContext.broadcast((hashes[order], np.asarray(table["excess"])[order].astype(np.float32)))
        return docs.select("doc_id", "label", "text").mapInArrow(shared.lean(_summed(sent)), _FEATURE)
    bits = words.mapInArrow(shared.lean(_bits), "bit int").distinct().toArrow()["bit"]  # at most a row for each bit
    map_ = np.zeros(1 << BITS, bool)
    map_[np.asarray(bits)] = True
    sent = spark.sparkContext.broadcast(np.packbits(map_, bitorder="little").tobytes())
    rows = docs.select("doc_id", "label", "text").mapInArrow(shared.lean(_screened(sent)), "row long, doc_id long, label int, n long, word string, freq long")
    found = rows.join(words, "word", "left").withColumn("loud", F.coalesce(F.col("freq") * F.col("excess"), F.lit(0.0)))
    sums = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("label").alias("label"), F.max("n").alias("n"), F.sum("loud").alias("loud"))
    return sums.select("doc_id", "label", (F.col("loud") / F.greatest("n", F.lit(1))).alias("x"))


def _bits(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array((_word_hash(batch.column(0).to_pylist()) >> np.uint64(64 - BITS)).astype(np.int32))], ["bit"])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
    return w


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


#: Evidence for a word is about 0.1 in a toxic text; its logarithm is taken of 1 and so many times it.
_SCALE = 1000.0


class Model:
    """words: word, excess, a written table. weights: of 1 and of log1p(_SCALE * x)."""

    def __init__(self, words: DataFrame, weights: list[float]):
        self.words, self.weights = words, weights


def fit(docs: DataFrame, labels: DataFrame, margin: float = MARGIN, most: int = MAX_SENT_WORDS) -> Model | None:
    """docs: doc_id, text. labels: doc_id, label (0 or 1). At most MAX_CALIBRATION documents of fold 1 fit the logistic function, the others the models.

    Counts cover all other labelled rows given; words of all docs are asked about, so docs should hold all that is to be
    scored. Of several labels of a document the largest counts. None without any counted text.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    one = shared.keep(own.groupBy("doc_id").agg(F.max("label").alias("label")), "labels")
    few = shared.keep(one.where(fold() == 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_CALIBRATION), "calibration")
    small = one.count() <= MAX_SENT_LABELS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = one.join(F.broadcast(few.select("doc_id")), "doc_id", "left_anti")  # MAX_CALIBRATION rows
    every = texts.join(F.broadcast(counted) if small else counted, "doc_id", "left").select("text", "label")
    words = every.mapInArrow(shared.lean(_word_counts), "word string, ordinary long, toxic long").groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    vocabulary = shared.keep(words, "vocabulary")
    if not vocabulary.where("ordinary > 0 OR toxic > 0").limit(1).count():
        return None
    loud = shared.keep(evidence(vocabulary, margin), "evidence")
    rows = features(texts.join(F.broadcast(few), "doc_id"), loud, most).toArrow()
    y = np.asarray(rows["label"]).astype(float) if rows.num_rows else np.empty(0)
    if 0 < y.sum() < len(y):
        x = np.log1p(_SCALE * np.asarray(rows["x"]))
        return Model(loud, logistic(np.stack([np.ones(len(x)), x], axis=1), y).tolist())
    return Model(loud, [-2.0, 1.0])  # nothing to fit on


def score(docs: DataFrame, model: Model | None, most: int = MAX_SENT_WORDS) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row.

    A null or empty text has the score of a text without any evidence. A row with a null id is scored and never held
    out. Repeated rows are scored each for itself; an empty table gives no rows; other columns are left out. Without
    any labelled text there is no model, and every score is 0.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("int").alias("label"), F.col("text").cast("string").alias("text"))
    held = F.coalesce(fold() == 0, F.lit(False)).alias("held_out")
    if model is None:
        return own.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    a, b = model.weights
    z = F.lit(a) + F.lit(b) * F.log1p(F.lit(_SCALE) * F.col("x"))
    found = features(own, model.words, most).select("doc_id", held, (1 / (1 + F.exp(-z))).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
