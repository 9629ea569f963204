import json
import struct

import pytest
from pyspark.sql import functions as F

from tidelog.functions import expressions as E
from tidelog.plans import report
from tidelog.sources import binary, files

RECORDS = [("PUT", b"a", b"1"), ("PUT", "ключ".encode(), b""), ("DELETE", b"a", None)]


def test_log_bytes():
    data = binary.encode_log(RECORDS[:1])
    assert data == b"\x00\x00\x00\x00\x01a\x00\x00\x00\x011"
    data = binary.encode_log(RECORDS)
    assert [r[1:] for r in binary.decode_log(data, strict=True)] == RECORDS


@pytest.mark.parametrize("cut", range(1, 12))
def test_a_torn_log_keeps_its_prefix(cut):
    whole = binary.encode_log(RECORDS)
    last = binary.encode_log([("PUT", b"key", b"value")])
    assert [r[1:] for r in binary.decode_log(whole + last[:cut])] == RECORDS


def test_an_unknown_record_is_an_error_if_strict():
    data = binary.encode_log(RECORDS) + b"\x07"
    assert len(list(binary.decode_log(data))) == 3
    with pytest.raises(ValueError):
        list(binary.decode_log(data, strict=True))


def test_segment_bytes():
    pairs = [(f"k{i:05d}".encode(), None if i % 7 == 0 else b"" if i % 5 == 0 else b"v" * (i % 90)) for i in range(2000)]
    data = binary.encode_segment(pairs)
    assert struct.unpack("<Q", data[-8:])[0] == 0x12345678ABCDEF00
    assert list(binary.decode_segment(data)) == pairs
    assert len(binary.segment_index(data)) > 5
    assert binary.lookup(data, b"k00007") == (True, None)
    assert binary.lookup(data, b"k00005") == (True, b"")
    assert binary.lookup(data, b"nope") == (False, None) and binary.lookup(data, b"zzz") == (False, None)
    with pytest.raises(ValueError):
        list(binary.decode_segment(data[:-1] + b"\x00"))
    with pytest.raises(ValueError):
        binary.encode_segment([(b"b", b""), (b"a", b"")])
    assert binary.segment_index(b"short") == []


def test_manifest(spark, tmp_path):
    (tmp_path / "manifest.log").write_text("1,2\n3,1,2\n\n")
    rows = binary.read_manifest(spark, str(tmp_path / "manifest.log")).collect()
    assert [r.value for r in sorted(rows)] == ["1,2", "3,1,2", "", ""]
    assert binary.read_manifest(spark, str(tmp_path / "none")).count() == 0


def test_files(spark, tmp_path):
    for node, n in (("node_0", 3), ("node_1", 5)):
        (tmp_path / node).mkdir()
        (tmp_path / node / "a.sst").write_bytes(b"x" * n)
    got = {r.node: (r.files, r.bytes) for r in files.file_stats(spark, str(tmp_path), "*.sst").collect()}
    assert got == {"node_0": (1, 3), "node_1": (1, 5), None: (2, 8)}
    (tmp_path / "log.txt").write_text("Compaction done\nx\ncompaction compaction\nT|a=1|b=2\n")
    assert files.count_in_log(spark, str(tmp_path / "log.txt")).first().n == 3
    row = files.fields(spark.read.text(str(tmp_path / "log.txt")), "T", ["a", "b", "c"]).collect()
    assert [tuple(r) for r in row] == [("1", "2", None)]


def test_metrics_json(spark, tmp_path):
    node = {"node_id": 1, "raft": {"current_term": 4, "is_leader": True}, "lsm": {"get_total": 9}}
    (tmp_path / "m.json").write_text(json.dumps({"timestamp": "2026-05-05T14:05:03.123456789Z", "nodes": [node, {"node_id": 2}]}, indent=1))
    rows = files.node_metrics(files.read_json(spark, str(tmp_path / "m.json"), files.METRICS)).orderBy("node").collect()
    assert (rows[0].node, rows[0].term, rows[0].is_leader, rows[0].get_total) == (1, 4, True, 9)
    assert rows[1].is_leader is False


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.5), ('q"x,y', None)], "name string, ms double")
    assert report.markdown(df).splitlines()[2] == "| a\\|b | 1.5000 |"
    assert [r.value for r in report.csv_lines(df).collect()] == ["a|b,1.5000", '"q""x,y",']
    report.to_csv(df, str(tmp_path / "c"))
    report.to_tsv(df, str(tmp_path / "t"))
    report.to_json(df, str(tmp_path / "j"))
    assert files.read_csv(spark, str(tmp_path / "c"), "name string, ms double").count() == 2
    assert report.append_rows(df, df.drop("ms")).count() == 4


def test_duration_text(spark):
    cases = [(0, "0s"), (1, "1ns"), (1500, "1.5µs"), (2_000_000, "2ms"), (1_500_000_000, "1.5s"), (61_000_000_000, "1m1s"), (3_600_000_000_000, "1h0m0s"), (3_723_000_000_001, "1h2m3.000000001s"), (-5, "-5ns"), (100_000_000_000, "1m40s"), ((1 << 63) - 1, "2562047h47m16.854775807s"), (-(1 << 63), "-2562047h47m16.854775808s")]
    rows = spark.createDataFrame(cases, "ns long, text string")
    assert [r.shown for r in rows.select(E.duration_text(F.col("ns")).alias("shown")).collect()] == [t for _, t in cases]


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    rows = spark.createDataFrame([(b"b", b"1"), (b"a", b"2")], "key binary, value binary")
    binary._register(spark)
    with pytest.raises(Exception):  # keys must ascend
        rows.coalesce(1).write.format("tidelog_segments").mode("append").option("first", 1).save(str(tmp_path))
    assert not [x for x in tmp_path.iterdir() if x.suffix == ".sst"]


def test_find_opens_only_files_in_range(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.createDataFrame([(f"k{i:04d}", None if i % 9 == 0 else f"v{i}") for i in range(900)], "key string, value string")
    binary.write_segments(rows, path, files=5)
    binary.write_segments(spark.createDataFrame([("k0010", "newer")], "key string, value string"), path)
    assert binary.next_file_id(spark, path) > 5
    catalog = binary.segment_catalog(spark, path).cache()
    assert catalog.count() == len([x for x in tmp_path.iterdir() if x.suffix == ".sst"])
    got = {(r.key.decode(), r.value and r.value.decode()) for r in binary.find(spark, path, ["k0010", "k0009", "nope", "k0899"], catalog).collect()}
    assert got == {("k0010", "v10"), ("k0010", "newer"), ("k0009", None), ("k0899", "v899")}
    for x in tmp_path.iterdir():  # a file out of range may be broken: nobody looks
        if x.name.startswith("000005"):
            x.write_bytes(b"broken")
    assert binary.find(spark, path, ["k0010"], catalog).count() == 2
    assert binary.find(spark, path, [], catalog).count() == 0


def test_manifest_lines_are_added(spark, tmp_path):
    file = f"file://{tmp_path}/manifest.log"
    for ids in ([1], [1, 2], [3, 1]):
        binary.append_manifest(spark, file, ids)
    assert (tmp_path / "manifest.log").read_text() == "1\n1,2\n3,1\n"
    assert binary.remove_files(spark, f"file://{tmp_path}", r"manifest\.log") == 1 and not list(tmp_path.glob("manifest*"))


def test_human_bytes(spark):
    sizes = [0, 1023, 1024, 1280, 1536, 1048576, 3580568, 1 << 40]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in sizes], "s long").select(E.human_bytes(F.col("s"))).collect()]
    assert got == ["0 B", "1023 B", "1.0 KiB (1024 B)", "1.2 KiB (1280 B)", "1.5 KiB (1536 B)", "1.0 MiB (1048576 B)", "3.4 MiB (3580568 B)", "1.0 TiB (1099511627776 B)"]
