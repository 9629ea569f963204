"""Every stage of the pipeline against brute force, each on what the one before it kept."""

import zlib

import numpy as np
import pytest

from tests.conftest import SMALL
from tests.llm.test_duplicates import plain_shared
from tests.llm.test_quality import base
from tests.llm.test_text import plain_matches
from tidelog.llm import bpe, quality, shared


@pytest.fixture(scope="module")
def kept(spark):
    """What came into each stage and what came out of it, by stage."""
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        into, docs = docs, shared.keep(stage(spark, docs, SMALL), name)
        out[name] = into, docs
    return out


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def test_columns_and_order(kept):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == list(kept) and len(names) == 5
    assert all(kept[n][1].columns == kept[names[0]][0].columns for n in names[:-1])


def test_good_documents(kept):
    into, out = kept["quality_rules"]
    judged = {r.doc_id: r for r in quality.judge(into).collect()}
    had, have = texts(into), texts(out)
    assert set(have) == {i for i, r in judged.items() if r.kept} and all(have[i] == had[i] for i in have)
    assert all(judged[i].base_failed == base(x)[-1] and not (judged[i].base_failed and i in have) for i, x in had.items())


def test_one_of_each_group_stays(kept):
    into, out = kept["simhash_near_dedup"]
    had, have = texts(into), texts(out)
    ids = sorted(had)
    sets = [plain_shared(had[i]) for i in ids]
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, i in enumerate(ids):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both >= 0.8 * (len(sets[x]) + len(sets[y]) - both) - 1e-9:
                a, b = top(i), top(ids[y])
                up[max(a, b)] = min(a, b)
    assert set(have) == {i for i in ids if top(i) == i} and len(have) < len(had)


def test_repeats_are_gone(kept):
    into, out = kept["suffix_array_dedup"]
    had, have = texts(into), texts(out)
    seen, want = set(), {}
    for i in sorted(had):
        data = had[i].encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            if (s := data[p : p + 100]) in seen:
                gone[p : p + 100] = True
            seen.add(s)
        at, chars = 0, []
        for c in had[i]:
            n = len(c.encode())
            if not gone[at : at + n].all():
                chars.append(c)
            at += n
        want[i] = "".join(chars)
    assert have == want and have != had
    assert all(r.n_chars == len(r.text) for r in out.select("n_chars", "text").collect())


def test_no_benchmark_is_left(spark, kept):
    into, out = kept["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    had, have = texts(into), texts(out)
    found = {i for i, _ in plain_matches(sorted(had.items()), items)}
    assert set(have) == set(had) - found and all(have[i] == had[i] for i in have)


def test_all_tokens_are_packed(kept):
    into, out = kept["best_fit_packing"]
    rows = sorted(out.collect(), key=lambda r: (r.doc_id, r.piece))
    whole = bpe.library(bpe.path("byte_bpe_50k.json"))
    own = texts(into)
    cut = {}
    for r in rows:
        cut.setdefault(r.doc_id, []).append(r)
    assert set(cut) == set(own)
    for i, x in own.items():
        ids = np.array([*whole.encode(x, add_special_tokens=False).ids, 2], "<u4")
        assert [(r.start, r.length) for r in cut[i]] == [(r.start, min(1024, len(ids) - r.start)) for r in cut[i]] or cut[i][0].length < 1024
        assert sum(r.length for r in cut[i]) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in cut[i])
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in bins.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and x[-1][0] + x[-1][1] <= 1024


def test_run_is_all_stages(spark, kept):
    import corpus_pipeline

    out = kept["best_fit_packing"][1]
    assert corpus_pipeline.run(spark, SMALL).select("doc_id", "piece", "length", "ids_crc32").exceptAll(out.select("doc_id", "piece", "length", "ids_crc32")).count() == 0


def test_odd_rows(spark, odd, none, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            docs = shared.keep(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() >= 0


def test_names_that_the_stages_use(spark, tmp_path):
    """Columns of the input with such names go through unchanged."""
    import corpus_pipeline

    spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(3).write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["_found", "_keep", "_print", "_id", "_text", "found", "key", "row", "rep", "known", "own", "whole", "meta", "rest", "marks", "kept", "words", "_place_"]
    start = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    docs = start.selectExpr("*", *[f"doc_id AS `{n}`" for n in names])
    docs = docs.unionByName(docs.limit(5).selectExpr(*[f"concat(text, ' another text under the same id') AS text" if c == "text" else f"`{c}`" for c in docs.columns]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.keep(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == [*start.columns, *names]
        assert docs.where(" OR ".join(f"`{n}` <> doc_id" for n in names)).count() == 0
