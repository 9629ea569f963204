"""Token counts, the id store and packing against the tokenizers library."""

import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidelog.llm import bpe, idstore, packing, shared, textscan, tokencount

BYTE, WORD = bpe.path("byte_bpe_50k.json"), bpe.path("word_bpe_49k.json")


def strange_texts(n, seed):
    r = random.Random(seed)
    alphabet = [*"abstmdrevl'' \n\t  .,!12é½ÑÉ中　\xa0\x1c'İΣẞ<|>", "'s", "'re", " 's", "<|endoftext|>", "<|STARTOFTEXT|>", "\n\n", "  ", "ﬀ", "😀", "́", "aaa " * 300]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(n)]


def byte_ids(texts):
    return [np.array([*e.ids, 2], "<u4") for e in bpe.library(BYTE).encode_batch_fast(texts, add_special_tokens=False)]


def test_encoder_gives_the_librarys_ids():
    texts = strange_texts(3000, 1)
    ids, count = bpe.Encoder(BYTE, cached=500).encode(texts)
    want = [e.ids for e in bpe.library(BYTE).encode_batch_fast(texts, add_special_tokens=False)]
    assert np.split(ids, np.cumsum(count)[:-1])[17].tolist() == want[17]
    assert ids.tolist() == [i for x in want for i in x]


def test_counts(spark):
    texts = strange_texts(2000, 2)
    want = [len(e.ids) for e in bpe.library(WORD).encode_batch_fast(texts, add_special_tokens=False)]
    rows = tokencount.count(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), WORD, limit=100).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {i: (len(x.encode()), n, n > 100) for i, (x, n) in enumerate(zip(texts, want))}


def test_pre_tokens_with_one_hash_are_told_apart(monkeypatch):
    texts, own = ["aa bb aa cc", "dd bb", ""], textscan.piece_hash
    want = tokencount.words(WORD).block(texts)
    calls = []

    def clash(c, starts, ends):
        calls.append(1)
        h = own(c, starts, ends)
        return h & np.uint64(1) if len(calls) == 1 else h

    monkeypatch.setattr(textscan, "piece_hash", clash)
    got = tokencount.words(WORD).block(texts)
    assert len(calls) == 2 and sorted(got[0]) == sorted(want[0]) == ["aa", "bb", "cc", "dd"]
    assert {w: got[4][a:b].tolist() for w, a, b in zip(got[0], got[2], got[2][1:])} == {"aa": [2], "bb": [1, 1], "cc": [1], "dd": [1]}


@pytest.mark.parametrize("chars, buckets", [(50, 1), (1 << 22, 7), (300, 1 << 16)])
def test_any_blocks_and_buckets_give_the_same(spark, chars, buckets, monkeypatch):
    texts = strange_texts(300, 5) + ["the " * 3000, "the" * 9000]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    monkeypatch.setattr(tokencount, "BLOCK_CHARS", chars)
    monkeypatch.setattr(tokencount, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 3)}))}))
    rows = pa.Table.from_batches(tokencount._asked(WORD, buckets)([batch]))
    rows = pa.Table.from_batches(tokencount._answered(WORD)(rows.sort_by("bucket").to_batches(max_chunksize=50)))
    found = pa.Table.from_batches(tokencount._joined(100)(rows.sort_by([("block", "ascending"), ("bucket", "ascending")]).to_batches(max_chunksize=50)))
    want = [len(e.ids) for e in bpe.library(WORD).encode_batch_fast(texts, add_special_tokens=False)]
    assert dict(zip(found["doc_id"].to_pylist(), found["n_tokens"].to_pylist())) == dict(enumerate(want))


def test_counts_of_odd_rows(spark, odd, none):
    assert tokencount.count(none, WORD).count() == 0
    rows = tokencount.count(odd, WORD).collect()
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(bpe.library(WORD).encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows) == want


def test_store_round_trip(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    path = idstore.store(docs, BYTE, 2)
    pdf = docs.select("doc_id", "text").toPandas().sort_values("doc_id")
    want, start = {}, 0
    for i, ids in zip(pdf.doc_id, byte_ids(pdf.text.tolist())):
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()), True)
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32, r.verified) for r in idstore.read(spark, path, BYTE, 2).collect()} == want
    chunks = idstore._chunks(spark, path)
    assert chunks.count() == chunks.select("digest").distinct().count()
    rows = idstore.reconstruct(spark, path).collect()
    assert all(r.verified for r in rows)
    whole = {r.doc_id: bytes(r.ids) for r in rows}
    assert all(zlib.crc32(np.frombuffer(whole[i], "<u2").astype("<u4").tobytes()) == want[i][2] for i in want)


@pytest.mark.parametrize("fault", ["none", "chunk changed", "chunk lost", "recipe lost", "recipe foreign", "partition lost", "manifest row lost", "root changed"])
def test_a_changed_or_lost_part_is_found(spark, tmp_path, fault):
    docs = spark.createDataFrame([(i, f"some text {i} " * 400) for i in range(40)], "doc_id long, text string")
    path, other = idstore.store(docs, BYTE, 2), f"file://{tmp_path}/store"
    tables = {t: spark.read.parquet(f"{path}/{t}") for t in ("recipes", "manifest", "root")}
    tables["raw"] = spark.read.schema(idstore._RAW).parquet(f"{path}/raw")
    raw, recipes, manifest = tables["raw"], tables["recipes"], tables["manifest"]
    name = F.col("digest") == F.lit(bytes(raw.where("kind = 0").orderBy("digest").first().digest))
    part = manifest.orderBy("part").first().part
    tables |= {
        "chunk changed": {"raw": raw.withColumn("body", F.when((F.col("kind") == 0) & name, F.lit(b"\1\0")).otherwise(F.col("body")))},
        "chunk lost": {"raw": raw.where(~((F.col("kind") == 0) & name))},
        "recipe lost": {"recipes": recipes.where("doc_id <> 7")},
        "recipe foreign": {"recipes": recipes.withColumn("doc_id", F.col("doc_id")).withColumn("root", F.when(F.col("doc_id") == 7, F.lit(bytes(16))).otherwise(F.col("root")))},
        "partition lost": {"recipes": recipes.where(F.col("part") != part)},
        "manifest row lost": {"manifest": manifest.where(F.col("part") != part)},
        "root changed": {"root": tables["root"].withColumn("docs", F.col("docs") + 1)},
        "none": {},
    }[fault]
    for t in ("raw", "recipes", "manifest", "root"):
        by = {"raw": ["kind"], "recipes": ["part"]}.get(t)
        (tables[t].write.partitionBy(*by) if by else tables[t].write).parquet(f"{other}/{t}")
    if fault.startswith(("none", "chunk")):
        for rows in (idstore.read(spark, other, BYTE, 2).collect(), idstore.reconstruct(spark, other).collect()):
            assert len(rows) == 40 and all(r.verified for r in rows) == (fault == "none")
    else:
        with pytest.raises(ValueError):
            idstore.read(spark, other, BYTE, 2)
        with pytest.raises(ValueError):
            idstore.reconstruct(spark, other)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 7, 8, 31])
def test_merkle_root(n):
    leaves = [bytes([i]) * 16 for i in range(n)]
    level = leaves or [idstore.digest(b"")]
    while len(level) > 1:
        level = [idstore.digest(level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    assert idstore.merkle(leaves) == level[0]


def test_store_of_odd_rows(spark, odd, none):
    assert idstore.read(spark, idstore.store(none, BYTE, 2), BYTE, 2).count() == 0
    rows = idstore.read(spark, idstore.store(odd, BYTE, 2), BYTE, 2).collect()
    assert len(rows) == odd.count() and all(r.verified for r in rows)
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


@pytest.mark.parametrize("seed", range(3))
def test_joined_crc(seed):
    r = random.Random(seed)
    parts = [r.randbytes(r.choice([0, 4, 400, 9000])) for _ in range(40)]
    starts = np.array(sorted({0, *r.sample(range(1, 40), 9)}))
    crc = idstore.joined_crc(np.array([zlib.crc32(p) for p in parts], np.uint32), np.array([len(p) for p in parts]), starts)
    ends = [*starts[1:], 40]
    assert crc.tolist() == [zlib.crc32(b"".join(parts[a:b])) for a, b in zip(starts, ends)]


def test_cuts_follow_content():
    r = np.random.default_rng(0)
    shared_ids = r.integers(0, 50000, 20_000)
    a, b = np.concatenate([r.integers(0, 50000, 777), shared_ids]), np.concatenate([r.integers(0, 50000, 3210), shared_ids])

    def chunks(x):
        own = idstore.cuts(x, np.array([0, len(x)]))[0]
        return {x[i:j].tobytes() for i, j in zip([0, *own], own)}

    assert len(chunks(a) & chunks(b)) > 0.7 * len(chunks(a))


def check_packing(rows, capacity):
    pdf = pd.DataFrame([r.asDict() for r in rows]).sort_values(["sequence_id", "offset"])
    own = pdf.groupby("sequence_id")
    assert (pdf.offset == own.length.cumsum() - pdf.length).all() and own.length.sum().max() <= capacity
    return pdf


def test_packing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    pdf = check_packing(packing.pack(docs, BYTE, 2, 1024).collect(), 1024)
    texts = docs.select("doc_id", "text").toPandas()
    want = dict(zip(texts.doc_id, byte_ids(texts.text.tolist())))
    for i, own in pdf.sort_values(["doc_id", "piece"]).groupby("doc_id"):
        assert own.piece.tolist() == list(range(len(own))) and own.length.sum() == len(want[i])
        assert (own.length.iloc[1:] == 1024).all()
        assert [zlib.crc32(want[i][a : a + n].tobytes()) for a, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    assert pdf.sequence_id.nunique() <= 1.01 * pdf.length.sum() / 1024 + 1


def test_small_buckets_and_spans_pack_as_well(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = packing.pack(docs, BYTE, 2, 64).select("sequence_id").distinct().count()
    monkeypatch.setattr(packing, "BUCKET", 3)
    monkeypatch.setattr(packing, "SPAN", 2)
    pdf = check_packing(packing.pack(docs, BYTE, 2, 64).collect(), 64)
    assert pdf.sequence_id.nunique() == want


def test_packing_of_odd_rows(spark, odd, none):
    assert packing.pack(none, BYTE, 2, 64).count() == 0
    pdf = check_packing(packing.pack(odd, BYTE, 2, 64).collect(), 64)
    assert (pdf.piece == 0).sum() == odd.count()


@pytest.mark.parametrize("seed", range(20))
def test_plans_hold_every_piece_and_are_tight(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 2, 3, 10, 64])
    counts = {n: r.randrange(30) for n in r.sample(range(1, capacity + 1), r.randint(1, capacity))}
    groups = packing.plan(counts, capacity)
    held: dict[int, int] = {}
    for bins, holds in groups:
        assert bins > 0 and sum(n * t for n, t in holds) <= capacity
        for n, t in holds:
            held[n] = held.get(n, 0) + bins * t
    assert held == {n: c for n, c in counts.items() if c}
    total = sum(bins for bins, _ in groups)
    large = sum(c for n, c in counts.items() if 2 * n > capacity)
    best = max(large, -(-sum(n * c for n, c in counts.items()) // capacity))
    assert best <= total <= 1.25 * best + 2
    spots = packing._slots(groups)
    for n in held:
        own = sorted((a, b) for m, a, b, *_ in spots if m == n)
        assert own[0][0] == 0 and all(x[1] == y[0] for x, y in zip(own, own[1:])) and own[-1][1] == held[n]


def test_chunks_cover_all_texts():
    texts = ["x" * n for n in (0, 5, 100, 3, 0, 7)]
    assert [i for a, b in textscan.chunks(texts, 10) for i in range(a, b)] == list(range(6))


def test_shared_folder_is_the_sessions(spark):
    assert shared.folder(spark) == spark.conf.get("spark.checkpoint.dir")
