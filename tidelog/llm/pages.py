"""Main text of web pages by differencing pages with near URLs.

A page is cut into text lines, one for each block element, and each line knows where it stands: in the marked article,
in marked furniture (menus, footers, adverts, forms and so on), in a block whose name only hints at furniture, or in
neither. Pages of a host are sorted by URL path; a page's lines are aligned with those of the pages before and after it by
longest common subsequence, and lines that they share are furniture too. Where nearly all is shared, more pages near it are
asked, as two pages may be near copies.

Markup decides where it speaks, differencing where it doesn't: on all lines of pages without an article, and on an
article's lines in blocks of doubtful names. An article's other lines are never deleted for being shared, as two pages may
quote one passage.
"""

from __future__ import annotations

import bisect
import html
import itertools
import re
from collections import Counter, deque
from urllib.parse import urlsplit

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import shared

#: Pages of a range of the sorted paths; a range also gets the pages within reach before and after it.
RANGE = 512
#: Pages of a part in which paths are sorted to find the ranges.
SORTED = 16_384
#: If more of a page's unmarked text is shared with a neighbour, that one may be a near copy, and other pages are asked as well.
COPY = 0.8
#: Pages before and after a page that may be asked.
REACH = 4

# Names of elements and words of their class, id or role.
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
MAIN = {"article", "main"}
FURNITURE = set("nav footer aside form header menu dialog head title".split())
HINTS = set("ad ads advert adverts advertisement banner sponsored sponsor promo cookie cookies consent gdpr notice newsletter subscribe popup modal sidebar menu navbar nav navigation breadcrumb breadcrumbs share sharing social related recommended comment comments respond disqus footer pagination widget toolbar masthead".split())
#: Words that say nothing of what a block holds, beside a hint.
PLAIN = set("area article articles bar block body bottom box btn button buttons card cards cell center col column container content feed foot form global grid group head heading holder icon icons img inline inner item items label left line link links list lists main middle mini module nav outer page panel post posts primary region right row secondary section signup site slot small stories story tab tabs text thread title top unit up wrap wrapper zone".split())
ROLES = set("navigation banner complementary contentinfo search form dialog alert menu menubar toolbar".split())
OPEN_END = set("p li dt dd tr td th".split())  # a next one ends them
VOID = set("area base br col embed hr img input link meta param source track wbr".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|math|iframe|object|select|button|canvas|audio|video)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_HINTED = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


def _kind(name: str, attributes: str, in_main: bool) -> str:
    """f for furniture, h for a block whose name has a word of furniture among others (social-history), else nothing."""
    if name in FURNITURE:
        return "" if name == "header" and in_main else "f"  # an article's own header has its title
    if not attributes or name in MAIN or name in ("body", "html"):
        return ""
    found = ""
    for kind, *values in _HINTED.findall(attributes):
        kind, value = kind.lower(), next((v for v in values if v), "")
        low = value.lower()
        if kind == "role" and low in ROLES or kind == "hidden" and not low or kind == "aria-hidden" and low == "true":
            return "f"
        if kind in ("class", "id"):
            for word in value.split():
                parts = {x for x in re.split("[-_]+|(?<=[a-z])(?=[A-Z])|[0-9]+", word) if x}
                parts = {x.lower() for x in parts}
                if parts & HINTS and not word.lower().startswith(("has-", "no-", "with-")):
                    if parts <= HINTS | PLAIN:
                        return "f"
                    found = "h"
    return found


def _ends(tags: list[tuple[bool, str]]) -> tuple[list[int], list[bool]]:
    """For each opening tag the place of the tag that ends its element, and whether it is its own closing tag.

    tags: (closing, name) of blocks. A closing tag ends the last open element of its name and all that were opened in it.
    """
    end, own = [len(tags)] * len(tags), [False] * len(tags)
    opened: list[int] = []
    by: dict[str, int] = {}
    for i, (closing, name) in enumerate(tags):
        if not closing:
            opened.append(i)
            by[name] = by.get(name, 0) + 1
        elif by.get(name):
            while True:
                j = opened.pop()
                by[tags[j][1]] -= 1
                end[j] = i
                if tags[j][1] == name:
                    own[j] = True
                    break
    return end, own


def lines(page: str) -> list[tuple[str, str]]:
    """(zone, text) of the page's blocks in order: zone a in an article, f in furniture, u in neither; for blocks of doubtful
    names h in an article and g elsewhere."""
    found = [m for m in _TOKEN.finditer(page)]
    blocks = [(k, bool(m[2]), m[3].lower(), m[4]) for k, m in enumerate(found) if m[3] and m[3].lower() in BLOCKS and not (m[3].lower() in VOID or not m[2] and m[4].endswith("/"))]
    end, own = _ends([(c, n) for _, c, n, _ in blocks])
    mains = [i for i, (_, c, n, _) in enumerate(blocks) if n in MAIN and not c]

    def until(i: int) -> int:
        """Where furniture that begins at i ends. What was never closed ends with what is around it, or where an article begins."""
        name = blocks[i][2]
        if own[i]:
            return end[i]
        if name in OPEN_END:
            after = next((j for j in range(i + 1, end[i]) if not blocks[j][1] and (blocks[j][2] == name or name == "p")), end[i])
            return after
        k = bisect.bisect_right(mains, i)
        return min(end[i], mains[k]) if k < len(mains) else end[i]

    at = {k: i for i, (k, *_) in enumerate(blocks)}
    out: list[tuple[str, str]] = []
    held: list[str] = []
    main = furniture = hinted = -1  # the block up to which each lasts
    last = 0
    zone = "u"

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((zone, text))

    for k, m in enumerate(found):
        if m.start() > last:
            held.append(page[last : m.start()])
        last = m.end()
        if k not in at:
            if m[3] and m[3].lower() in BLOCKS:
                flush()
            elif m[3] and m[3].lower() == "br":
                held.append(" ")
            continue
        flush()
        i = at[k]
        _, closing, name, attributes = blocks[i]
        if i >= furniture and not closing:
            kind = _kind(name, attributes, i < main)
            if kind == "f":
                furniture = until(i)
            else:
                if kind == "h":
                    hinted = max(hinted, until(i))
                if name in MAIN:
                    main = max(main, end[i])
        zone = "f" if i < furniture else ("h" if i < main else "g") if i < hinted else "a" if i < main else "u"
    held.append(page[last:])
    flush()
    return out


def common(a: list[str], b: list[str]) -> list[int]:
    """Places in a of a longest common subsequence with b, by bit vectors over b."""
    if not a or not b:
        return []
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, [full]
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)

    def length(i: int, j: int) -> int:
        return j - (rows[i] & ((1 << j) - 1)).bit_count()

    i, j, found = len(a), len(b), []
    while i and j:
        n = length(i, j)
        if length(i - 1, j) == n:
            i -= 1
        elif length(i, j - 1) == n:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append(i)
    return found[::-1]


def main_text(own: list[tuple[str, str]], before: list[list[tuple[str, str]]], after: list[list[tuple[str, str]]] = ()) -> str:
    """The page's main text, told from the lines of the pages before and after it, nearest first.

    Pages with the same unmarked lines are copies and tell nothing; the next ones are asked. Lines shared with the nearest
    page on a side are furniture. If that is over COPY of the text, it may be a near copy or a page of little but
    furniture; then only lines that over half of the pages within reach have, and two at least, are furniture.
    """
    marked = any(z == "a" for z, _ in own)
    asked = "h" if marked else "ug"
    loose = [x for z, x in own if z in asked]
    shared: set[int] = set()
    if loose:
        sides = [[y for other in side if (y := [x for z, x in other if z in "ugh"]) != loose] for side in (before, after)]
        total = COPY * sum(map(len, loose))
        unsure = False
        for side in sides:
            found = common(loose, side[0]) if side else []
            if marked or sum(len(loose[i]) for i in found) <= total:  # a doubtful block of an article may be shared as a whole
                shared.update(found)
            else:
                unsure = True
        if unsure:
            others = set(map(tuple, sides[0] + sides[1]))  # copies of each other speak once
            votes = Counter(i for other in others for i in common(loose, list(other)))
            shared.update(i for i, n in votes.items() if n > 1 and 2 * n > len(others))
    place = itertools.count()
    kept = [x for z, x in own if (z in asked and next(place) not in shared) or (marked and z == "a")]
    return "\n".join(kept)


def place(url: str) -> tuple[str, str, str]:
    """Host, path without its last part, last part. Queries and fragments don't count."""
    try:
        parts = urlsplit(url.strip())
    except ValueError:
        return "", "", url
    head, _, leaf = parts.path.rstrip("/").rpartition("/")
    return (parts.netloc.rpartition("@")[2].lower().removeprefix("www."), head, leaf)


_KEY = "host string, head string, n int, leaf string, id long, known long"
_ORDER = ["host", "head", "n", "leaf", "id", "known"]
_CUT = f"span long, own boolean, {_KEY}, url string, body binary"


def _key(url: str | None, page_id: int | None, known: int) -> tuple:
    host, head, leaf = place(url or "")
    return host, head, len(leaf), leaf, _LEAST if page_id is None else page_id, known


_LEAST = -(1 << 63)  # a null id


def _keys(batches):
    """Of (page_id, url, known): the pages' places in the order of paths. known tells rows of one id and path apart."""
    for batch in batches:
        found = [_key(u, i, k) for i, u, k in zip(*(c.to_pylist() for c in batch.columns))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 6, _TYPES)], _ORDER)


_TYPES = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()]


def _edges(size: int, reach: int):
    """Of sorted keys: the first and the last reach keys of every size rows; equal keys stay together."""

    def run(batches):
        held: list[tuple] = []

        def edges(keys):
            found = [(k, True) for k in keys[:reach]] + [(k, False) for k in keys[-reach:]]
            columns = [pa.array(c, t) for c, t in zip(zip(*(k for k, _ in found)), _TYPES)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([first for _, first in found]), pa.array([keys[0] == k for k, _ in found])], [*_ORDER, "first", "opens"])

        for batch in batches:
            for key in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= size and key != held[-1]:
                    yield edges(held)
                    held = []
                held.append(key)
        if held:
            yield edges(held)

    return run


def _cut(sent):
    """Of (page_id, url, html, known): rows of lines, one for the page's own range and one for each range that it is at the edge of."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        opens, also = sent.value
        for batch in batches:
            rows = []
            for i, url, page, known in zip(*(c.to_pylist() for c in batch.columns)):
                own = lines(page or "")
                body = pack("\n".join(["".join(z for z, _ in own), *(x for _, x in own)]).encode("utf-8", "replace"))
                key = _key(url, i, known)
                span = bisect.bisect_right(opens, key) - 1
                rows += [(x, x == span, *key, url, body) for x in (span, *also.get(key, ()))]
            types = [pa.int64(), pa.bool_(), *_TYPES, pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 10, types)], ["span", "own", *_ORDER, "url", "body"])

    return run


def _ranges(keys: DataFrame, reach: int) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """The first key of every range, and for keys at an edge the other ranges that need them."""
    parts = max(1, -(-keys.count() // SORTED))
    found = keys.mapInArrow(shared.lean(_keys), _KEY).repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER)
    rows = found.mapInArrow(shared.lean(_edges(RANGE, reach)), f"{_KEY}, first boolean, opens boolean").toArrow()
    columns = [rows[c].to_pylist() for c in [*_ORDER, "first", "opens"]]
    edges = list(zip(zip(*columns[:6]), columns[6], columns[7]))
    opens = sorted({k for k, _, o in edges if o})
    also: dict[tuple, set[int]] = {}
    near = sorted({k for k, *_ in edges})
    for span in range(len(opens)):
        at = bisect.bisect_left(near, opens[span])
        for k in near[max(0, at - reach) : at]:  # the last keys before the range
            also.setdefault(k, set()).add(span)
        if span + 1 < len(opens):
            at = bisect.bisect_left(near, opens[span + 1])
            for k in near[at : at + reach]:  # the first keys after it
                also.setdefault(k, set()).add(span)
    return opens, {k: sorted(x) for k, x in also.items()}


def _differenced(batches):
    """Of pages sorted by range and path: each own page's text, told from the pages before and after it."""
    unpack = zstandard.ZstdDecompressor().decompress

    def pages():
        for batch in batches:
            for span, own, host, page_id, url, body in zip(*(c.to_pylist() for c in batch.columns)):
                zones, *texts = unpack(body).decode().split("\n")
                yield (span, host), None if page_id == _LEAST else page_id, url, list(zip(zones, texts)), own

    def rows():
        near: deque = deque()  # a page with up to REACH pages on both sides
        at = 0
        for page in itertools.chain(pages(), [None] * REACH):
            near.append(page)
            if len(near) > REACH:
                if near[at]:
                    yield near[at], [x for x in list(near)[:at][::-1]], [x for x in list(near)[at + 1 :]]
                if at == REACH:
                    near.popleft()
                else:
                    at += 1

    held: list[tuple] = []
    size = 0

    def batch():
        ids, urls, texts = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    for now, *sides in rows():
        if not now[4]:
            continue
        near = [[x[3] for x in side if x and x[0] == now[0]] for side in sides]
        held.append((now[1], now[2], text := main_text(now[3], *near)))
        size += len(text)
        if size > 1 << 23:
            yield batch()
            held.clear()
            size = 0
    if held:
        yield batch()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (lines joined by line ends, empty if there are none) and n_chars of every page.

    A null or empty html has no text; a null or odd url is of the empty host. Rows with equal or null ids are pages each
    for itself, and so may be each other's neighbour. An empty table gives no rows. Other columns are left out.
    """
    known = F.xxhash64(F.col("html").cast("string")).alias("known")
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), known)
    sent = pages.sparkSession.sparkContext.broadcast(_ranges(plain.select("page_id", "url", "known"), REACH))
    near = plain.mapInArrow(shared.lean(_cut(sent)), _CUT).repartition("span").sortWithinPartitions("span", *_ORDER)
    found = near.select("span", "own", "host", "id", "url", "body").mapInArrow(shared.lean(_differenced), "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
