import re

from tests.conftest import SF, SMALL, same_rows
from tidelog.llm import quality, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    words = WORD.findall(text or "")
    rows = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen, covered = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered.update(i + k for i in places for k in range(3))
    n, rep = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(rows) - len(set(rows)), rep, n < 50 or 100 * rep > 50 * n


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_counts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.judge(docs.select("doc_id", "text", "lang")).collect():
        assert tuple(r[c] for c in NAMES) == base(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_odd_rows(odd, none):
    assert quality.judge(none).count() == 0
    rows = quality.judge(odd.withColumn("whole", odd.text)).select("whole", *NAMES, "kept").collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert tuple(r[c] for c in NAMES) == base(r.whole)
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)


def test_oracle(spark, duck):
    same_rows(queries.QUERIES["op4_quality_rules"](spark, SF).toPandas(), duck.execute(quality.ORACLE).df())


def test_labels_agree(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    own = quality.judge(docs).join(labels, "doc_id").where("NOT base_failed")
    n = {(r.quality, r.kept): r["count"] for r in own.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.02 * n[0, False]


def test_unequal_windows_with_one_hash(spark):
    """Windows of long texts fall back to sorting words; both ways must agree."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([("a b c d a b c x a b c d",), ("x y z",), ("x x x x x",), ("a",)], "text string").withColumn("words", F.split("text", " ")).withColumn("n_words", F.size("words").cast("long"))
    plain = [r.n_repeat_words for r in quality._with_repeats(docs).collect()]
    bits, quality._IDX = quality._IDX, 1  # every text counts as too long to pack
    try:
        assert [r.n_repeat_words for r in quality._with_repeats(docs).collect()] == plain == [base(x)[4] for x in ("a b c d a b c x a b c d", "x y z", "x x x x x", "a")]
    finally:
        quality._IDX = bits
