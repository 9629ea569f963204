"""Toxicity, dialogues, pages, decontamination and the pipeline."""

import html
import math
import random
import re
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tests.conftest import SF, SMALL, same_rows
from tidelog.llm import bpe, chat, decontam, pages, quality, queries, toxicity


def test_toxicity_held_out(spark):
    rows = queries.QUERIES["op3_toxicity"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    own = rows.join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in own)
    assert sum(r.predicted == r.toxic for r in own) >= 0.9 * len(own)


def plain_ratios(counts):
    """The two Kneser-Ney models by their definition: counts of n-grams in dictionaries, for every window of every word."""
    n, low, d = toxicity.ORDER, toxicity.SHORTEST, toxicity.DISCOUNT
    seen = {k: {} for k in range(2, n + 1)}  # order -> n-gram -> counts in ordinary, toxic and all texts
    spelled = {w: "\1" + w + "\2" for w in counts}
    cut = lambda s, i: s[max(0, i + 1 - n) : i + 1]
    for w, (o, t) in counts.items():
        for i in range(1, len(spelled[w])):
            own = seen[len(x := cut(spelled[w], i))].setdefault(x, [0, 0, 0])
            for c, v in enumerate((o, t, o + t)):
                own[c] += v
    for k in range(2, n + 1):
        seen[k] = {g: c for g, c in seen[k].items() if c[2]}
    for k in range(n - 1, low - 1, -1):
        for g, c in seen[k + 1].items():
            own = seen[k].setdefault(g[1:], [0, 0, 0])
            for j in range(3):
                own[j] += c[j] > 0
    by = {}
    for k in seen:
        for g, c in seen[k].items():
            by.setdefault(g[:-1], []).append(c)

    def parts(g, j):
        """What is left of the n-gram's count, and what its context frees, both for one of the context's counts."""
        total = sum(c[j] for c in by.get(g[:-1], []))
        if not total:
            return 0.0, 1.0
        return max(seen[len(g)].get(g, [0, 0, 0])[j] - d, 0) / total, sum(min(c[j], d) for c in by[g[:-1]]) / total

    def both(g):
        left, free = parts(g, 2)
        return left + free * (both(g[1:]) if len(g) > low else 1 / toxicity._SYMBOLS)

    def ratio(x):
        while x[:-1] not in by:
            if len(x) <= low:
                return 0.0
            x = x[1:]
        (o, fo), (t, ft) = parts(x, 0), parts(x, 1)
        return math.log(t + ft * both(x)) - math.log(o + fo * both(x))

    return {w: [ratio(cut(x, i)) for i in range(1, len(x))] for w, x in spelled.items()}


@pytest.mark.parametrize("seed, letters", [(0, "ab"), (1, "abcdé"), (2, "a")])
def test_ratios_are_those_of_the_definition(seed, letters):
    r = random.Random(seed)
    words = {"".join(r.choice(letters) for _ in range(r.randint(1, 9))): (r.choice([0, 1, 2, 5, 30]), r.choice([0, 0, 1, 3, 20])) for _ in range(150)}
    rows, owner = toxicity.windows(list(words))
    o, t = (np.array([c[k] for c in words.values()])[owner] for k in (0, 1))
    want = plain_ratios(words)
    assert np.allclose(toxicity.ratios(rows, o, t), [x for w in words for x in want[w]], atol=1e-9)
    key, apart = toxicity.key_of(rows), np.zeros(len(rows))
    for k in np.unique(key):  # a bucket knows all that decides on its windows
        apart[key == k] = toxicity.ratios(rows[key == k], o[key == k], t[key == k])
    assert np.allclose(apart, [x for w in words for x in want[w]], atol=1e-9)


def test_words_with_evidence(spark):
    words = {"the": (900, 100), "idiot": (0, 20), "lovely": (30, 3), "idle": (9, 1), "idiots": (0, 0), "zzz": (0, 0)}
    want = {w: sum(x) for w, x in plain_ratios(words).items()}
    rows = spark.createDataFrame([(w, *n) for w, n in words.items()], "word string, ordinary long, toxic long")
    for margin in (-100.0, 1.0):
        got = {r.word: r.excess + margin for r in toxicity.evidence(rows, margin).collect()}
        assert got == pytest.approx({w: x for w, x in want.items() if x > margin}, abs=1e-4)
    assert want["idiot"] > 2 and want["idiots"] > 1 and abs(want["the"]) < 1 and want["lovely"] < 1


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (8, None), (7, 0), (9, 1), (77, 1)], "doc_id long, label int")
    model = toxicity.fit(odd, labels)
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(none, model).count() == 0
    assert toxicity.fit(none, labels) is None and toxicity.score(odd, None).where("score = 0").count() == odd.count()


def test_words_that_are_sent_and_words_that_are_joined_score_alike(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    found = [sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 6), r.predicted, r.held_out) for r in toxicity.score(docs, toxicity.fit(docs, labels, margin=0.5, most=n), most=n).collect()) for n in (10**6, 0)]
    assert found[0] == found[1] and len({x[2] for x in found[0]}) > 10


def test_labels_beyond_calibration_are_counted(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_CALIBRATION", 4)
    first = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = [(i, "what a lovely day" if k % 2 else "you are a grumblefrotz") for k, i in enumerate(first)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1 - k % 2) for k, i in enumerate(first)], "doc_id long, label int"))
    assert {r.word for r in model.words.collect()} >= {"grumblefrotz"} and "lovely" not in {r.word for r in model.words.collect()}


def test_rotation_oracle(spark, duck):
    same_rows(queries.QUERIES["op7_perspective_rotation"](spark, SF).toPandas(), duck.execute(chat.ORACLE).df())


@pytest.mark.parametrize("small", [True, False])
def test_rotation_of_odd_dialogues(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr(chat, "PART_TURNS", 2)
        monkeypatch.setattr(chat, "PART_ROWS", 4)
    turns = [("c", i, who, f"say {i}") for i, who in enumerate(["system", "ann", "bob", "cy", "ann", "bob", None])] + [("c", 3, "ann", None), ("c", None, "bob", "early"), (None, 0, "ann", "x"), ("s", 0, "system", "alone")]
    turns += [("t", 1, "ann", f"tie {i}") for i in range(9)] + [("c", 3, "ann", None)]
    rows = chat.rotate(spark.createDataFrame([(*t, "clash", 1) for t in turns], "conv_id string, turn int, role string, text string, mask string, part int")).collect()
    for conv in ("c", "t", None):
        own = [t for t in turns if t[0] == conv]
        for person in {t[2] or "unknown" for t in own} - {"system"}:
            parts = sorted((r for r in rows if r.conv_id == conv and r.perspective == person), key=lambda r: r.part)
            assert [r.part for r in parts] == list(range(len(parts))) and sum(r.n_turns for r in parts) == len(own)
            whole = "".join(r.text for r in parts)
            assert all(whole[r.start : r.start + len(r.text)] == r.text for r in parts)
            said = sorted(r.text[m.begin : m.end] for r in parts for m in r.mask)
            assert said == sorted((t[3] or "") + chat.END for t in own if (t[2] or "unknown") == person)
            assert whole.count("<|turn|>assistant\n") == len(said)
    assert not [r for r in rows if r.conv_id == "s"]
    assert chat.rotate(spark.createDataFrame([], "conv_id string, turn int, role string, text string")).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_common_lines(seed):
    r = random.Random(seed)
    a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    found = pages.common(a, b)
    rest = iter(b)
    assert len(found) == table[-1][-1] and all(a[i] in rest for i in found)


def test_articles(spark):
    own = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in own.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want[r.page_id] = "\n".join(x for x in blocks if x)
    got = {r.page_id: (r.text, r.n_chars) for r in queries.QUERIES["op8_page_differencing"](spark, SF).collect()}
    assert got == {i: (x, len(x)) for i, x in want.items()}


def test_unmarked_pages_are_differenced(spark):
    page = lambda i: f"<body><div>Welcome to our site</div><p>Text {i} is&nbsp;&lt;here&gt;\n and <b>now</b><p>Second {i}</p><div>All rights reserved</div></body>"
    rows = [(i, f"http://a.org/x/{i}?q=1", page(i)) for i in range(6)] + [(9, "http://b.org/1", page(9)), (10, None, None), (11, "::::", ""), (12, "http://c.org/", page(3)), (13, "http://c.org/#x", page(3)), (None, "http://d.org", "<p>x<script>if (a<b) '</p>'</script><!-- <p>no --> y")]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, host string, bucket int")).collect()}
    for i in range(6):
        assert got[i] == f"Text {i} is <here> and now\nSecond {i}"
    assert got[9].startswith("Welcome") and got[10] == got[11] == "" and got[None] == "x y"
    assert "Text 3" in got[12] and "Text 3" in got[13]  # copies tell nothing about each other
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_of_large_hosts_meet_their_nearest(spark, monkeypatch):
    monkeypatch.setattr(pages, "RANGE", 50)
    monkeypatch.setattr(pages, "SORTED", 400)
    page = lambda s, i: f"<body><div>Menu of section {s}</div><p>Text {s} {i} of its own<p>More of {s} {i}</div><div>Notice of section {s}</div></body>"
    rows = [(100 * s + i, f"http://a.org/{s}/{i}", page(s, i)) for s in range(300) for i in range(3)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()}
    assert got == {100 * s + i: f"Text {s} {i} of its own\nMore of {s} {i}" for s in range(300) for i in range(3)}


def test_pages_of_little_but_furniture(spark):
    menu = [f"Menu entry number {k} of this site" for k in range(30)]
    block = lambda x: "".join(f"<div>{line}</div>" for line in x)
    page = lambda x: f"<body>{block(menu)}{block(x)}<div>All rights reserved</div></body>"
    text = [f"Long sentence {k} that only this page and its near copy have, with many words in it" for k in range(60)]
    rows = [(i, f"http://a.org/x/{i}", page([f"Text {i} is here"])) for i in range(6)]
    rows += [(20 + i, f"http://b.org/x/{i}", page([f"Text {i} is here"])) for i in (0, 1, 4, 5)]
    rows += [(20 + i, f"http://b.org/x/{i}", page([*text, f"Edition {i}"])) for i in (2, 3)]
    rows += [(40 + i, f"http://c.org/x/{i}", page(["The same", "everywhere"] if i < 3 else [f"Text {i}"])) for i in range(5)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in range(6)} == {i: f"Text {i} is here" for i in range(6)}
    assert {i: got[20 + i] for i in (2, 3)} == {i: "\n".join([*text, f"Edition {i}"]) for i in (2, 3)}
    assert [got[40 + i] for i in range(5)] == ["The same\neverywhere"] * 3 + ["Text 3", "Text 4"]


def test_furniture():
    page = "<header>top</header><nav><ul><li>menu</ul></nav><div class='site-ads x'>buy</div><main><header><h1>Title</h1></header>One<br>two<aside>no</aside><form>mail <input></form><p hidden>no<p>Three &am &amp</main><div id=comments>me too</div><footer>end"
    assert pages.main_text(pages.lines(page), []) == "Title\nOne two\nThree &am &"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<aside><h3>Related</h3><article><p>Teaser</p></article></aside><article><p>Own</p></article>", "Own"),
        ("<nav><article><p>Card</p></article></nav><p>x</p><article><p>Own</p></article><footer>f</footer>", "Own"),
        ("<aside><h3>never closed</h3><article><p>Own</p></article>", "Own"),
        ("<nav>menu<article><p>Own</p></article><footer>f</footer>", "Own"),
        ("<article><div class='social-history'><p>Kept</p></div><div class=share-list>no</div><p>End</p></article>", "Kept\nEnd"),
        ("<article><p>A</p><div class='commentList'>no<div>no</div></div><p class=ads>no<p>B</p></article>", "A\nB"),
        ("<article><p>A</p></article><div><div>tail</div></div><article><p>B</p></article>", "A\nB"),
        ("<article><li class=ad>no<li>yes<ul><li class=ad>no<li>yes</ul></article>", "yes\nyes"),
    ],
)
def test_where_furniture_ends(page, text):
    assert pages.main_text(pages.lines(page), []) == text


def test_doubtful_blocks_of_an_article_are_differenced():
    page = lambda i: pages.lines(f"<article><p>Text {i}</p><div class='share-price'><p>Buy our shares</p><p>Price {i}</p></div></article>")
    assert pages.main_text(page(1), [page(0)], [page(2)]) == "Text 1\nPrice 1"
    assert pages.main_text(page(1), [], []) == "Text 1\nBuy our shares\nPrice 1"


@pytest.mark.parametrize("size", [5, 64, 512])
def test_pairing_and_differencing_of_a_whole_table(spark, size, monkeypatch):
    """Against the definition: pages of a host in the order of their paths, each differenced with its neighbours there."""
    r = random.Random(11)
    rows = []
    for i in range(400):
        host = r.choice(["big.example"] * 6 + ["a.example", "www.b.example", "B.example"])
        section = r.randrange(60)
        own = "".join(f"<p>{r.choice('abc')} {i if r.random() < 0.8 else section} {k}</p>" for k in range(r.randint(0, 5)))
        menu = "".join(f"<li>{host[-9:]} {section} item {k}</li>" for k in range(4))
        body = f"<div><ul>{menu}</ul>{own}<div>note of {section}</div></div>"
        rows.append((i if i % 50 else None, f"http://{host}/s{section}/p{r.randrange(9)}?x={i}" if i % 70 else None, f"<article>{own}</article>" if i % 9 == 0 else body))
    rows += rows[:5]
    monkeypatch.setattr(pages, "RANGE", size)
    monkeypatch.setattr(pages, "SORTED", 90)
    got = sorted((x.page_id is None, x.page_id or 0, x.url or "", x.text) for x in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect())
    known = {x.html: x.known for x in spark.createDataFrame(rows, "page_id long, url string, html string").select("html", F.xxhash64("html").alias("known")).collect()}
    order = sorted(rows, key=lambda x: pages._key(x[1], x[0], known[x[2]]))
    cut = [pages.lines(x[2]) for x in order]
    host = [pages.place(x[1] or "")[0] for x in order]
    want = []
    for i, x in enumerate(order):
        near = lambda js: [cut[j] for j in js if 0 <= j < len(order) and host[j] == host[i]]  # noqa: B023, E731
        before, after = near(range(i - 1, i - 1 - pages.REACH, -1)), near(range(i + 1, i + 1 + pages.REACH))
        want.append((x[0] is None, x[0] or 0, x[1] or "", pages.main_text(cut[i], before, after)))
    assert got == sorted(want) and any("item" not in x[3] for x in want)


def test_decontamination_finds_exact_and_changed_copies(spark):
    item = "Every day Tom buys 3 apples and 5 pears, so after 3 days he has spent 12 dollars on fruit."
    texts = [
        item,
        "Yes: " + item.replace("Tom", "Ann").replace("3", "7").replace("5", "9").replace("12", "31") + " Then she slept.",
        item.replace("3 days", "8 days").replace("3", "4", 1).upper(),
        "Every day we see other people buy things and pay for them with money.",
        None,
        "",
    ]
    docs = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)] + [(None, item, "clash"), (0, item, "clash")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(5, item), (6, "tiny one"), (7, None), (None, item), (8, "short but whole item here"), (5, item)], "item_id long, text string")
    rows = decontam.matches(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} >= {(0, 5), (1, 5)} and not {r.doc_id for r in rows} & {3, 4, 5, None}
    assert decontam.clean(docs, bench).count() == docs.count() - sum(1 for r in docs.collect() if r.doc_id in {x.doc_id for x in rows})
    assert decontam.matches(docs.limit(0), bench).count() == 0 and decontam.matches(docs, bench.limit(0)).count() == 0


def test_items_of_mostly_placeholders_are_found(spark):
    items = ["What is 12 + 35?", "12 14 16 18 20 22 24 26 28 30", "1 apple 2 pears 3 figs 4 plums 5 nuts 6 dates 7 limes 8 kiwis", "So Ann Bob Cy Dan Eve Fay Gus Hal Ida Jon 1990", "9 + 3"]
    texts = [f"Some words before it. {x} Some words after it." for x in items[:4]] + [items[4], "Before: What is 7 + 9? After.", "it was 12 and 35", "the sum 9 + 3 among others"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = decontam.matches(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 0)]


def test_names_do_not_depend_on_case_and_line_ends(spark):
    counted = "Every day Tom buys 3 apples and 5 pears, so after 3 days he has spent 12 dollars on fruit."
    named = "the Visit of Anna to old Berlin was when young Peter and his Uncle met the great Doctor near our River"
    texts = [counted.replace("3 days", "8 days").replace("3", "4", 1).upper(), named.lower(), named.upper(), named.replace(" ", "\n"), named.replace("Anna", "Maria").replace(" ", "\n")]
    docs = spark.createDataFrame([(i, f"so it is said {x}") for i, x in enumerate(texts)], "doc_id long, text string")
    rows = decontam.matches(docs, spark.createDataFrame([(5, counted), (6, named)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(0, 5), (1, 6), (2, 6), (3, 6), (4, 6)]


def test_slots_must_be_consistent(spark):
    item = "first we add 4 to x and then we take 4 from y until both of them are 4 again and 4 more"
    mixed = "first we add 1 to x and then we take 2 from y until both of them are 3 again and 5 more"
    same = item.replace("4", "8")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, mixed), (2, same)], "doc_id long, text string")
    assert {r.doc_id for r in decontam.matches(docs, bench).collect()} == {2}


def test_names_of_several_words_and_both_ways(spark):
    item = "on that day the mayor Anna Maria Berg walked with Peter to the old bridge over the river near Bonn and met Anna Maria Berg there"
    texts = [item.replace("Anna Maria Berg", "Otto").replace("Bonn", "New York City"), item.replace("Peter", "Anna Maria Berg").replace("Bonn", "Anna Maria Berg")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = decontam.matches(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), coverage=0.9).collect()
    assert [r.doc_id for r in rows] == [0]  # in the other, three of the item's values have become one


def plain_forms(text):
    """A text's tokens in each form by the definition: (canonical, value, is a slot)."""
    found = [(m.start(), m.end(), m[0]) for m in regex.finditer(r"\p{N}+(?:[.,]\p{N}+)*|\p{L}+", text)]
    plain, names = [], []
    for i, (a, b, x) in enumerate(found):
        between = text[found[i - 1][1] : a] if i else "."
        low, number = x.lower(), not x[0].isalpha()
        unit = not number and i and not found[i - 1][2][0].isalpha() and low in decontam.UNITS
        name = not number and not unit and i and not re.search("[.!?:]", between) and len(x) > 1 and x[0].isupper() and x[1].islower()
        plain.append(("#" if number else "%" if unit else low, low, number or unit))
        if name and names and names[-1][0] == "@" and names[-1][3] == i - 1 and not between.strip():
            names[-1] = ("@", f"{names[-1][1]} {low}", True, i)
        else:
            names.append(("@", low, True, i) if name else (*plain[-1], i))
    return {decontam.TEMPLATE: [x[:3] for x in names], decontam.LOOSE: [x[:3] for x in names], decontam.BLIND: plain, decontam.VALUES: [(v, v, False) for _, v, _ in plain]}


def plain_windows(forms, form, n):
    line = forms[form]
    for i in range(len(line) - n + 1):
        own = line[i : i + n]
        words, least = sum(not x[2] for x in own), -(-n * decontam.LITERAL // decontam.WINDOW)
        if n < decontam.SHORTEST and len(line) != n:
            continue
        if form in (decontam.TEMPLATE, decontam.BLIND) and words < least or form == decontam.LOOSE and not decontam.LEAST_WORDS <= words < least:
            continue
        yield i, tuple(x[0] for x in own), [x[1] for x in own if x[2]]


def plain_matches(docs, items):
    """Every document against every item, window by window."""
    w, out = decontam.WINDOW, {}
    for j, item in items:
        forms = plain_forms(item)
        wanted = []
        for n in range(1, w + 1):
            strict = 0
            for form in (decontam.TEMPLATE, decontam.VALUES, decontam.LOOSE, decontam.BLIND):
                size, merged = len(forms[form]), len(forms[decontam.TEMPLATE])
                if n < decontam.SHORTEST and form != decontam.VALUES or not (size >= n if n == w else size == n):
                    continue
                own = list(plain_windows(forms, form, n))
                if form == decontam.TEMPLATE:
                    strict = len(own)
                if form == decontam.VALUES and not (merged < n or strict < max(merged - w + 1, 1)) or form == decontam.LOOSE and strict:
                    continue
                wanted.append((n, form, own))
        for i, text in docs:
            other, best = plain_forms(text), {}
            for n, form, own in wanted:
                places = {}
                for at, key, slots in plain_windows(other, form, n):
                    places.setdefault(key, []).append((at, slots))
                for at, key, slots in own:
                    for p, filled in places.get(key, []):
                        best.setdefault((form, p - at), []).append((at, n, slots, filled, len(own)))
            cover = {}
            for (form, _), hits in best.items():
                pairs = {x for *_, a, b, _ in hits for x in zip(a, b)}
                sides = []
                for k in (0, 1):
                    values = [x[k] for x in pairs]
                    sides.append(sum(values.count(v) == 1 for v in set(values)) / len(set(values)) if values else 1.0)
                if sum(sides) / 2 >= decontam.CONSISTENT - 1e-9:
                    for at, _, _, _, total in hits:
                        cover.setdefault(form, (set(), []))[0].add(at)
                        cover[form][1].append(total)
            share = max([len(x) / max(t) for x, t in cover.values()], default=0)
            if share >= decontam.COVERAGE:
                out[i, j] = round(share, 9)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_templates_are_those_of_the_definition(spark, seed):
    r = random.Random(seed)
    words = "the of and buys sells sees apples trains day old river near walks".split()
    names, units = ["Ann", "Bob", "Anna Maria", "New York", "Eve"], ["kg", "dollars", "km"]

    def sentence(k):
        return " ".join(r.choice([r.choice(words), r.choice(words), r.choice(words), r.choice(names), f"{r.randint(1, 9)} {r.choice(units)}", str(r.randint(1, 2000))]) + r.choice(["", "", "", ",", ". ", ":"]) for _ in range(k))

    items = [(k, sentence(r.choice([2, 4, 6, 9, 15, 25]))) for k in range(15)]
    docs = []
    for i in range(60):
        text = r.choice(items)[1]
        for _ in range(r.randint(0, 4)):
            text = text.replace(r.choice(names), r.choice(names)).replace(str(r.randint(1, 9)), str(r.randint(1, 9)))
        docs.append((i, r.choice(["", sentence(8) + " "]) + r.choice([text, text.lower(), text.upper(), text[: len(text) * 2 // 3], sentence(20)]) + r.choice(["", " " + sentence(8)])))
    got = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = plain_matches(docs, items)
    assert {(x.doc_id, x.item_id): round(x.coverage, 9) for x in got} == want and len(want) > 15


def test_decontamination_of_documents(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    norm = lambda x: " " + " ".join(re.findall(r"\w+", x.lower())) + " "
    texts, items = [(r.doc_id, norm(r.text)) for r in docs.collect()], [(r.item_id, norm(r.text)) for r in bench.collect()]
    want = {(d, i) for i, x in items for d, y in texts if x in y}
    assert {(r.doc_id, r.item_id) for r in decontam.matches(docs, bench).collect()} == want and want
