"""Near duplicates and repeated passages against brute force."""

import hashlib
import random
import re
import subprocess
import sys

import numpy as np
import pytest
import xxhash

from tests.conftest import SMALL
from tidelog.llm import components, simhash, suffix


def plain_fingerprint(text, k=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_shared(text, k=5):
    """The set of a text's word shingles, in small letters."""
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def closed(ids, adjacent):
    label = np.array(ids)
    while True:
        again = np.array([label[n].min() for n in adjacent])
        if (again == label).all():
            return label
        label = again


def test_components_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    fps = np.array([plain_fingerprint(x) for _, x in rows], np.uint64)
    label = closed([i for i, _ in rows], [np.flatnonzero(np.bitwise_count(fps ^ f) <= 4) for f in fps])
    want = {i: (format(int(f), "016x"), int(c)) for (i, _), f, c in zip(rows, fps, label)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()} == want


@pytest.mark.parametrize("seed, spread", [(0, 3), (1, 6), (2, 64)])
def test_forest(seed, spread):
    r = np.random.default_rng(seed)
    fp = np.repeat(r.integers(0, 1 << 63, 12).astype(np.uint64), 40)
    for _ in range(spread):
        fp ^= np.where(r.random(len(fp)) < 0.8, np.uint64(1) << r.integers(0, 64, len(fp)).astype(np.uint64), np.uint64(0))
    group = np.sort(r.integers(0, 3, len(fp)))
    near = (np.bitwise_count(fp[:, None] ^ fp[None]) <= 4) & (group[:, None] == group[None])
    assert (simhash.Forest(fp, group).groups(4) == closed(np.arange(len(fp)), [np.flatnonzero(x) for x in near])).all()


@pytest.mark.parametrize("n", [10, 10**6, 10**9, 10**12])
def test_masks_lose_no_link(n):
    found = simhash.masks(n)
    r = random.Random(n)
    for _ in range(300):
        flips = sum(1 << b for b in r.sample(range(64), 4))
        assert any(not m & flips for m in found)


def test_component_steps(spark):
    r = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 140)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)] + [(5, 5), (900, 1), (1, 900)]
    want = {}
    for a, b in edges:
        x, y = want.get(a, {a}), want.get(b, {b})
        both = x | y
        for v in both:
            want[v] = both
    got = {row.u: row.v for row in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: min(s) for v, s in want.items() if v != min(s)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows_near(odd, none):
    assert simhash.near_duplicates(none).count() == 0
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    found = {(r.doc_id, r.component_id) for r in rows}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (None, 1), (None, 3)} <= found
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.select("doc_id").collect()) == [0, 0, 1, 3, 6, 7, 8, 9]
    assert kept.where("doc_id = 9").first().text == "other text under one id"


def test_similar_texts_are_linked_and_others_are_not(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(150):
        own = [r.choice(words) for _ in range(300)]
        close = [w if k % 60 else "changed" for k, w in enumerate(own)]  # 5 of 300 words: similarity about 0.85
        rows += [(10 * i, " ".join(own)), (10 * i + 1, " ".join(close).upper()), (10 * i + 2, " ".join(own[150:] + [r.choice(words) for _ in range(150)]))]
    got = {x.doc_id: x.component_id for x in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[10 * i + 1] == 10 * i for i in range(150)) >= 148
    assert all(got[10 * i + 2] == 10 * i + 2 and got[10 * i] == 10 * i for i in range(150))


@pytest.mark.parametrize("small", [{}, {"block": 1000}, {"crowd": 4, "one_in": 1, "block": 500}])
def test_links_have_the_similarity(spark, small):
    r = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    shingles = lambda x: {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
    rows, near = [], {}
    for i in range(120):
        own = [r.choice(words) for _ in range(400)]
        close = list(own)
        for k in r.sample(range(5, 395), 4 + i % 17):
            close[k] = "changed"
        a, b = shingles(own), shingles(close)
        near[i] = len(a & b) / len(a | b)
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(close))]
    base = [r.choice(words) for _ in range(600)]
    rows += [(1000 + i, " ".join(base[20 * i : 20 * i + 400])) for i in range(7)]  # each is similar to the next, the first and the last are not
    got = {x.doc_id: x.component_id for x in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"), **small).collect()}
    assert min(near.values()) < 0.65 and max(near.values()) >= 0.88 and sum(0.7 <= x < 0.8 for x in near.values()) > 20
    assert {i: got[2 * i + 1] == 2 * i for i in near} == {i: x >= 0.8 for i, x in near.items()}
    assert {got[1000 + i] for i in range(7)} == {1000}


@pytest.mark.parametrize("crowd", [4, 40])
def test_crowded_shards_lose_no_link(spark, crowd):
    r = np.random.default_rng(5)
    fp = np.concatenate([np.repeat(r.integers(0, 1 << 63, 3).astype(np.uint64), [400, 150, 50]), r.integers(0, 1 << 63, 200).astype(np.uint64)])
    for _ in range(6):
        fp ^= np.where(r.random(len(fp)) < 0.7, np.uint64(1) << r.integers(0, 12, len(fp)).astype(np.uint64), np.uint64(0))
    fp = np.unique(fp)
    want = closed(np.arange(len(fp)), [np.flatnonzero(np.bitwise_count(fp ^ f) <= 4) for f in fp])
    rows = spark.createDataFrame([(int(f.view(np.int64)), i) for i, f in enumerate(fp)], "fp long, rep long")
    got = {row.u: row.v for row in components.components(simhash.links(rows, 4, crowd=crowd, one_in=1)).collect()}
    assert [got.get(i, i) for i in range(len(fp))] == want.tolist()


def test_a_large_group_of_near_copies_fits_a_worker():
    """20,000 sketches 40 of 256 bits from one centre, searched in a process of their own."""
    code = """
import resource, numpy as np
from tidelog.llm import simhash
r = np.random.default_rng(1)
centre = r.integers(0, 2, 256)
bits = np.repeat(centre[None], 20000, 0)
for row in bits:
    row[r.choice(256, 40, replace=False)] ^= 1
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
label = simhash.Forest(np.packbits(bits.astype(np.uint8), axis=1).view(np.uint64), np.zeros(20000)).groups(simhash.radius_for(0.8))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, len(np.unique(label)))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300)
    grown, groups = map(int, out.stdout.split())
    assert grown < 200 and groups < 100


def test_clashing_names_near(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, 2, 3), (2, "a b c", 1, 2, 3), (3, "d e f", 1, 2, 3)], "doc_id long, text string, _keep int, key int, KNOWN int")
    kept = simhash.keep_first(docs.unionByName(docs.where("doc_id = 3")))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_tables_follow_the_input():
    assert len(simhash.tables(10, 0.8)[0]) < len(simhash.tables(10**9, 0.8)[0])
    assert len(simhash.tables(10**9, 0.8)) > len(simhash.tables(10**9, 0.9))


def plain_removed(rows, length=100):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                gone[p : p + length] = True
            seen.add(s)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out[i] = (len(data), int(gone.sum()), sum(1 for j in range(len(gone)) if gone[j] and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed, length, letters", [(0, 100, 2), (1, 13, 2), (2, 8, 3), (3, 5, 1), (4, 20, 1)])
def test_longest_previous_factors(seed, length, letters):
    r = np.random.default_rng(seed)
    data = r.integers(97, 97 + letters, 700).astype(np.uint8)
    data[300:450] = data[20:170]
    place = np.sort(r.choice(len(data) - length + 1, 400, replace=False))
    group = np.sort(r.integers(0, 3, len(place)))
    order, common = suffix.suffix_order(data, place, group, length)
    text = data.tobytes()
    keys = [(group[i], text[place[i] : place[i] + length], place[i]) for i in range(len(place))]
    assert [keys[i] for i in order] == sorted(keys)

    def prefix(i, j):
        return next((k for k in range(length) if text[place[i] + k] != text[place[j] + k]), length)

    want = [max([0, *(prefix(i, j) for j in range(i) if group[i] == group[j])]) for i in range(len(place))]
    assert suffix.longest_previous(place, order, common).tolist() == want
    assert suffix.repeated(data, place, group, length).tolist() == [x == length for x in want]


def passages(seed, n=200):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(40)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    common = [text(60) for _ in range(5)]
    rows = []
    for i in range(n):
        x = text(r.randint(0, 80))
        for _ in range(r.randint(0, 2)):
            p, a = r.choice(common), r.randint(0, 50)
            x += p[a : a + r.randint(50, 250)] + text(r.randint(0, 9))
        x = "ab " * r.randint(10, 200) if i % 37 == 0 else "a" * r.randint(90, 300) if i % 41 == 0 else x
        rows.append((i * 3 - 50, x))
    return rows


@pytest.mark.parametrize("limit", [suffix.RUNS, 2])
def test_removed_passages(spark, limit, monkeypatch):
    rows = passages(3)
    marks = suffix.marks
    monkeypatch.setattr(suffix, "marks", lambda docs: marks(docs, limit))
    got = suffix.removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == plain_removed(rows)


def test_removed_passages_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = plain_removed([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.removed(docs).collect()} == want


def test_odd_rows_repeats(odd, none):
    assert suffix.removed(none).count() == 0 and suffix.strip(none).count() == 0
    got = {(r.doc_id, r.n_bytes): r for r in suffix.removed(odd).where("doc_id IS NOT NULL").collect()}
    assert {i for i, _ in got} == set(range(1, 10))
    assert [r.n_removed == r.n_bytes for (i, _), r in got.items() if i == 2] == [True]
    left = suffix.strip(odd)
    assert left.columns == odd.columns and left.schema["n_chars"].dataType == odd.schema["n_chars"].dataType
    by = {r.doc_id: r.text for r in left.where("doc_id IS NOT NULL").collect()}
    assert by[2] == "" and by[3] is None and by[4] == "" and by[6] == "a" and len(by) == 9


def test_a_character_covered_in_part_stays():
    assert suffix.strip_text("ä" * 60, [(1, 1)]) == "ä" * 11  # bytes 1 to 100 cover 49 whole characters


def test_runs_hold_every_place():
    data, at = suffix.joined_bytes([x.encode() for _, x in passages(9, 40)])
    first, count, anchor, *_ = suffix.runs(data, at)
    places = np.concatenate([np.arange(a, a + n) for a, n in zip(first, count)])
    assert places.tolist() == [p for a, b in zip(at[:-1], at[1:]) for p in range(a, b - 99)]
    assert ((anchor >= first + count - 1) & (anchor + suffix.GRAM <= first + suffix.LENGTH)).all()
