"""Benchmark passages in documents, also with other numbers, names or units, by templates.

Texts become tokens: words in small form, numbers, names (capitalised inside a sentence, however many words) and units
(after a number). In a template, the last three are typed placeholders. Windows of a template are hashed and joined to
those of the benchmark. Matches of a document and an item that lie on one diagonal are one occurrence. It counts if its
slots are filled consistently, both ways: wherever the item repeats a value the document repeats one too, and where the
item's values differ the document's do. What share of the item's windows the consistent occurrences cover decides.

What is a name is told from capitals, which copies may change: windows are also indexed with names as words in small
form. A window of mostly placeholders says little as a template. Items with such windows are also looked for by their real
values, and items with no others by templates with at least LEAST_WORDS words.

Documents are screened by a bit map of the benchmark's windows, of fixed size, so only windows that may match travel.
False bits cost a little shuffle and nothing else.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm import shared, textscan

WINDOW = 8
#: Shorter items are one window of their length, down to this. Still shorter ones must be a whole document.
SHORTEST = 4
#: Words (not placeholders) that a window of WINDOW tokens has at least; shorter windows in proportion.
LITERAL = 5
#: Words that a template of mostly placeholders has at least.
LEAST_WORDS = 2
#: Forms of a window: a template; the values themselves; a template of mostly placeholders; a template where names are words.
TEMPLATE, VALUES, LOOSE, BLIND = range(4)
COVERAGE = 0.5
CONSISTENT = 0.75
BITS = 23
#: Units of measure and money.
UNITS = set("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonnes lb lbs pound pounds oz ounce ounces ml l litre litres liter liters gallon gallons second seconds sec minute minutes min hour hours h day days week weeks month months year years percent dollar dollars cent cents euro euros usd eur gbp degrees celsius fahrenheit watt watts kw kwh volt volts hz mph kmh meter meters metre metres kilometer kilometers kilometre kilometres".split())
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x5EED000000000001, 0x5EED000000000002, 0x5EED000000000003))


@functools.cache
def _case() -> np.ndarray:
    """1 for capital, 2 for small letters."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        x = chr(i)
        out[i] = 1 if x.isupper() else 2 if x.islower() else 0
    return out


@functools.cache
def _unit_hashes() -> np.ndarray:
    cp, at = textscan.codepoints(sorted(UNITS))
    return np.sort(textscan.piece_hash(textscan.sums(textscan.values_of(cp)), at[:-1], at[1:]))


class _Line:
    """Tokens of all texts in one form."""

    def __init__(self, doc: np.ndarray, token: np.ndarray, value: np.ndarray, slot: np.ndarray, texts: int):
        self.doc, self.value, self.slot = doc, value, slot
        self.sums = textscan.sums(token) if len(token) else np.zeros(1, np.uint64)
        self.words = np.concatenate([[0], np.cumsum(~slot)])
        self.first = np.searchsorted(doc, np.arange(texts + 1))
        self.sizes = np.diff(self.first)


class Template:
    """Tokens of a batch of texts, by form."""

    def __init__(self, texts: list[str]):
        cp, at = textscan.codepoints(texts)
        n = len(cp)
        cls = textscan.classes()[cp]
        if n > 2:  # a point or comma between digits belongs to the number
            inner = (cls[1:-1] != textscan.NUMBER) & ((cp[1:-1] == 0x2E) | (cp[1:-1] == 0x2C)) & (cls[:-2] == textscan.NUMBER) & (cls[2:] == textscan.NUMBER)
            edge = textscan._flags(n, at)[1 : n - 1] | textscan._flags(n, at)[2:n]
            cls[1:-1][inner & ~edge] = textscan.NUMBER
        bound = textscan._flags(n, at)
        if n:
            bound[1:n] |= cls[1:] != cls[:-1]
        places = np.flatnonzero(bound)
        starts, ends = places[:-1], places[1:]
        shown = cls[starts] <= textscan.NUMBER
        starts, ends = starts[shown], ends[shown]
        self.doc = textscan.owners(at, starts)
        small = textscan.lowered(cp)
        self.value = textscan.piece_hash(textscan.sums(textscan.values_of(small)), starts, ends) if len(starts) else np.empty(0, np.uint64)
        number = cls[starts] == textscan.NUMBER
        stop = np.concatenate([[0], np.cumsum((cp == 0x2E) | (cp == 0x21) | (cp == 0x3F) | (cp == 0x3A))])
        opens = np.ones(len(starts), bool)
        if len(starts) > 1:
            opens[1:] = (self.doc[1:] != self.doc[:-1]) | (stop[starts[1:]] > stop[ends[:-1]])
        case = _case()
        second = case[cp[np.minimum(starts + 1, max(n - 1, 0))]] if n else np.empty(0, np.uint8)
        name = ~number & ~opens & (ends - starts > 1) & (case[cp[starts]] == 1) & (second == 2)
        after = np.zeros(len(starts), bool)
        if len(starts) > 1:
            after[1:] = number[:-1] & (self.doc[1:] == self.doc[:-1])
        unit = ~number & after & np.isin(self.value, _unit_hashes())
        plain = np.where(number, _NUMBER, np.where(unit, _UNIT, self.value))
        name &= ~unit
        joined = np.zeros(len(name), bool)  # a name of several words is one token, if nothing but space is between them
        if len(name) > 1:
            marks = np.concatenate([[0], np.cumsum(cls != textscan.SPACE)])
            joined[1:] = name[1:] & name[:-1] & (self.doc[1:] == self.doc[:-1]) & (marks[starts[1:]] == marks[ends[:-1]])
        head = np.flatnonzero(~joined)
        tail = np.append(head[1:], len(name))
        long = textscan.piece_hash(textscan.sums(self.value), head, tail) if len(head) else self.value
        value = np.where(tail - head > 1, long, self.value[head])
        token = np.where(name, _NAME, plain)[head]
        #: By form: document, hash, value and kind of each token. The first two forms differ in what counts as a slot.
        names = _Line(self.doc[head], token, value, (number | name | unit)[head], len(texts))
        words = _Line(self.doc, plain, self.value, number | unit, len(texts))
        exact = _Line(self.doc, self.value, self.value, np.zeros(len(self.value), bool), len(texts))
        self.lines = {TEMPLATE: names, LOOSE: names, BLIND: words, VALUES: exact}

    def windows(self, n: int, form: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of n tokens begin, and their hashes."""
        own = self.lines[form]
        if len(own.doc) < n:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        begin = np.arange(len(own.doc) - n + 1)
        fits = own.doc[begin] == own.doc[begin + n - 1]
        if n < SHORTEST:
            fits &= own.sizes[own.doc[begin]] == n
        words, least = own.words[begin + n] - own.words[begin], -(-n * LITERAL // WINDOW)
        if form in (TEMPLATE, BLIND):
            fits &= words >= least
        elif form == LOOSE:
            fits &= (words >= LEAST_WORDS) & (words < least)
        begin = begin[fits]
        return begin, textscan.piece_hash(own.sums, begin, begin + n) ^ np.uint64(form * 0x9E3779B97F4A7C15 & (1 << 64) - 1)

    def slots(self, begin: int, n: int, form: int) -> list[int]:
        own = self.lines[form]
        return own.value[begin : begin + n][own.slot[begin : begin + n]].view(np.int64).tolist()


_WINDOWS = "id long, h long, at int, n int, form int, slots array<long>, total int"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int32()]
    columns = list(zip(*found)) if found else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["id", "h", "at", "n", "form", "slots", "total"])


def _benchmark_windows(batches):
    """All windows of the items in each form that they need; an item shorter than WINDOW is one window."""
    for batch in batches:
        ids, t = batch.column(0).to_pylist(), Template(textscan.strings(batch.column(1)))
        out = []
        for n in range(1, WINDOW + 1):
            strict = np.zeros(len(ids), np.int64)
            for form in (TEMPLATE, VALUES, LOOSE, BLIND):
                if n < SHORTEST and form != VALUES:
                    continue
                line = t.lines[form]
                begin, h = t.windows(n, form)
                own = line.sizes[line.doc[begin]]
                fits = own >= n if n == WINDOW else own == n
                if form == TEMPLATE:
                    strict = np.bincount(line.doc[begin[fits]], minlength=len(ids))
                elif form == VALUES:  # an item with a window that no template has is also looked for by its real values
                    sizes = t.lines[TEMPLATE].sizes
                    fits &= ((sizes < n) | (strict < np.maximum(sizes - WINDOW + 1, 1)))[line.doc[begin]]
                elif form == LOOSE:
                    fits &= (strict == 0)[line.doc[begin]]
                begin, h = begin[fits], h[fits].view(np.int64)
                total = np.bincount(line.doc[begin], minlength=len(ids))
                out += [(ids[d], x, b - int(line.first[d]), n, form, t.slots(b, n, form), int(total[d])) for d, x, b in zip(line.doc[begin].tolist(), h.tolist(), begin.tolist())]
        yield _rows(out)


def _document_windows(sent, kinds: list[tuple[int, int]]):
    def run(batches):
        bits = np.unpackbits(np.frombuffer(sent.value, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), textscan.strings(batch.column(1))
            for a, b in textscan.chunks(texts):
                t, out = Template(texts[a:b]), []
                for n, form in kinds:
                    begin, h = t.windows(n, form)
                    hit = bits[(h & np.uint64((1 << BITS) - 1)).astype(np.int64)]
                    begin, h = begin[hit], h[hit].view(np.int64)
                    line = t.lines[form]
                    out += [(ids[a + d], x, p - int(line.first[d]), n, form, t.slots(p, n, form), 0) for d, x, p in zip(line.doc[begin].tolist(), h.tolist(), begin.tolist())]
                if out:
                    yield _rows(out)

    return run


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item: str = "item_id", coverage: float = COVERAGE, consistent: float = CONSISTENT) -> DataFrame:
    """doc_id, item_id, windows (of the item that the document has), coverage (their share) and consistency, for contaminated pairs.

    consistency is the share of the item's slot values that each have one value in an occurrence, and of the occurrence's
    that each have one in the item, on average; occurrences below consistent are left out, one without slots is consistent. Each form of windows counts for itself, and the one with
    the largest coverage is shown. Null and empty texts match nothing, and an item of fewer than SHORTEST tokens is found
    only where it is all of a document, as words that few are in many. Rows with one id are one document or item; rows with a null id are left out.
    An empty table gives no rows. Other columns are left out.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("long"), F.col("text").cast("string")).distinct().mapInArrow(shared.lean(_benchmark_windows), _WINDOWS)
    items = shared.keep(items.withColumnsRenamed({"id": "item_id", "at": "item_at", "slots": "item_slots"}), "items")
    # at most a row for each bit, however large the benchmark
    marks = items.select(F.col("h").bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias("bit")).distinct().toArrow()["bit"]
    kinds = sorted((r.n, r.form) for r in items.select("n", "form").distinct().collect())
    map_ = np.zeros(1 << BITS, bool)
    map_[np.asarray(marks)] = True
    sent = spark.sparkContext.broadcast(np.packbits(map_, bitorder="little").tobytes())
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = own.mapInArrow(shared.lean(_document_windows(sent, kinds)), _WINDOWS).drop("total").withColumnsRenamed({"id": "doc_id"})
    # a window that very many documents have is a hot key of this join, whose partitions Spark splits
    met = shared.keep(found.join(items, ["h", "n", "form"]).withColumn("diagonal", F.col("at") - F.col("item_at")).drop("h"), "met")
    occurrence = ["doc_id", "item_id", "form", "diagonal"]
    pairs = met.select(*occurrence, F.explode(F.arrays_zip("item_slots", "slots")).alias("s")).select(*occurrence, "s.item_slots", "s.slots").distinct()
    sides = pairs.withColumns({"of_item": F.count("*").over(Window.partitionBy(*occurrence, "item_slots")), "of_text": F.count("*").over(Window.partitionBy(*occurrence, "slots"))})
    share = lambda n: F.sum((F.col(n) == 1).cast("double")) / F.sum(1 / F.col(n))  # noqa: E731  single values, of all values
    kept = sides.groupBy(*occurrence).agg(((share("of_item") + share("of_text")) / 2).alias("consistency"))
    good = met.join(kept, occurrence, "left").withColumn("consistency", F.coalesce("consistency", F.lit(1.0))).where(F.col("consistency") >= consistent - 1e-9)
    sums = good.groupBy("doc_id", "item_id", "form").agg(F.countDistinct("item_at").alias("windows"), F.max("total").alias("total"), F.max("consistency").alias("consistency"))
    best = F.max(F.struct((F.col("windows") / F.col("total")).alias("coverage"), "windows", "consistency")).alias("best")
    return sums.groupBy("doc_id", "item_id").agg(best).where(F.col("best.coverage") >= coverage).select("doc_id", "item_id", "best.windows", "best.coverage", "best.consistency")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that hold no item, unchanged.

    Rows with a null id and null or empty texts stay. Rows with one id are documents of their own. An empty table gives no
    rows, an empty benchmark all. Other columns may have any names.
    """
    docs, own = shared.numbered(names := docs, id_col, text)
    key = shared.unused(docs, "found")
    found = matches(docs, benchmark, own, text).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(found, F.col(own).cast("long") == F.col(key), "left_anti").select(*names.columns)
