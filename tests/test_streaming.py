import pytest

from tidelog.operators import segments
from tidelog.store import Store
from tidelog.streaming import apply

SCHEMA = "seq long, op string, key string, value string"


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_restart_duplicates_and_disorder(spark, tmp_path):
    src, out, check = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "check")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run():
        stream = apply.last_writes(spark.readStream.schema(SCHEMA).parquet(src))
        save = lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")
        stream.writeStream.outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()

    put(spark, src, [(5, "PUT", "a", "new"), (2, "PUT", "a", "old"), (3, "PUT", "b", "")])
    run()
    put(spark, src, [(4, "PUT", "a", "late"), (5, "PUT", "a", "new"), (6, "DELETE", "b", None), (7, "GET", "a", None)])
    run()
    rows = spark.read.parquet(out).collect()
    last = {}
    for r in sorted(rows, key=lambda r: r.seq):
        last[r.key] = (r.seq, r.op, r.value)
    assert last == {"a": (5, "PUT", "new"), "b": (6, "DELETE", None)}
    assert len(rows) == 3  # the late and the repeated write changed nothing


def batches(spark, n=5):
    for i in range(n):
        yield i, spark.createDataFrame([(10 * i + 1, "PUT", f"k{i}", f"v{i}"), (10 * i + 2, "DELETE" if i == 4 else "PUT", "k0", None if i == 4 else f"w{i}")], SCHEMA)


@pytest.mark.parametrize("compaction", [True, False])
def test_segment_sink(spark, tmp_path, compaction):
    sink = apply.SegmentSink(str(tmp_path / "segs"), threshold=2, enable_compaction=compaction)
    for i, batch in batches(spark):
        sink(batch, i)
    got = {r.key: r.value for r in segments.visible(sink.read(spark)).collect()}
    assert got == {f"k{i}": f"v{i}" for i in range(1, 5)}
    assert len(sink.manifest(spark)) == sink.read(spark).select("seg_order").distinct().count() == (1 if compaction else 5)
    assert sorted(x.name for x in (tmp_path / "segs").iterdir() if x.is_dir()) == sorted(sink.manifest(spark))  # vacuumed


def test_only_the_oldest_segments_are_merged(spark, tmp_path):
    sink = apply.SegmentSink(str(tmp_path / "segs"), threshold=4)
    for i, batch in batches(spark, 4):
        sink(batch, i)
    assert sink.manifest(spark) == ["m000000000-00000_000000003-00000"]
    for i, batch in list(batches(spark, 5))[4:]:
        sink(batch, i)
        sink(batch, i)  # delivered again
    assert sink.manifest(spark) == ["m000000000-00000_000000003-00000", "b000000004-00000"]
    for i, batch in list(batches(spark, 4))[2:]:
        sink(batch, i)  # delivered again after its merge
    assert {r.key: r.value for r in segments.visible(sink.read(spark)).collect()} == {f"k{i}": f"v{i}" for i in range(1, 5)}


def test_flush_by_size(spark, tmp_path):
    sink = apply.SegmentSink(str(tmp_path / "segs"), enable_compaction=False, flush_bytes=1000)
    rows = [(i, "PUT" if i % 7 else "DELETE", f"k{i % 60:03d}", f"value {i}" if i % 7 else None) for i in range(1, 400)]
    sink(spark.createDataFrame(rows, SCHEMA), 0)
    assert len(sink.manifest(spark)) > 3
    want = {}
    for _, op, k, v in rows:
        want[k] = v if op == "PUT" else None
    assert {r.key: r.value for r in segments.visible(sink.read(spark)).collect()} == {k: v for k, v in want.items() if v}


def test_garbage_goes(spark, tmp_path):
    sink = apply.SegmentSink(str(tmp_path / "segs"))
    for i, batch in batches(spark, 1):
        sink(batch, i)
    (tmp_path / "segs" / "b000000099-00000").mkdir()  # of a batch that broke off
    assert sink.vacuum(spark) == ["b000000099-00000"]


def test_store(spark, tmp_path):
    own = Store(spark, str(tmp_path / "store"), threshold=3)
    assert own.get("k") is None and own.metrics().first().segments == 0
    own.put("k", "a")
    own.put("k", "")
    assert own.get("k") == ""
    own.delete("k")
    own.delete("never")
    assert own.get("k") is None
    number = own.apply(spark.createDataFrame([(1, "PUT", "x", "1"), (2, "PUT", "x", "2"), (3, "PUT", "y", "3")], SCHEMA))
    own.apply(spark.createDataFrame([(1, "PUT", "x", "1"), (2, "PUT", "x", "2"), (3, "PUT", "y", "3")], SCHEMA), number)  # given again
    old = spark.createDataFrame(own.state().collect(), "key string, value string")
    own.put("x", "new")
    keys = spark.createDataFrame([("x",), ("y",), ("k",)], "key string")
    rows = lambda df: {(r.key, r.value, r.found) for r in df.collect()}
    assert rows(own.get_many(keys)) == {("x", "new", True), ("y", "3", True), ("k", None, False)}
    assert rows(own.get_many(keys, "local", old)) == {("x", "2", True), ("y", "3", True), ("k", None, False)}
    with pytest.raises(ValueError):
        own.get_many(keys, "quorum")
    for bad in ((1, "PUT", "", "v"), (1, "PUT", "k", None), (1, "GET", "k", None)):
        with pytest.raises(ValueError):
            own.apply(spark.createDataFrame([bad], SCHEMA))
    row = own.metrics().first()
    assert row.live == 2 and row.segments == len(own.sink.manifest(spark)) < 3
    own.clear()
    assert own.get("x") is None and own.metrics().first().entries == 0
    own.put("x", "after")
    assert own.get("x") == "after"
