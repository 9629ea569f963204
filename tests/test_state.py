"""Scenarios of commands: unique values for every write, so a stale read shows."""

import random

import pytest

from tidelog.operators import segments, state, workload


def log(spark, *commands):
    rows = [(i + 1, *c, None) if len(c) == 2 else (i + 1, *c) for i, c in enumerate(commands)]
    return spark.createDataFrame(rows, "seq long, op string, key string, value string")


def as_dict(df):
    return {r.key: r.value for r in df.collect()}


@pytest.mark.parametrize(
    "commands, expected",
    [
        ([("PUT", "k", "v1")], {"k": "v1"}),
        ([("PUT", "k", "old"), ("PUT", "k", "new")], {"k": "new"}),
        ([("PUT", "k", "v"), ("DELETE", "k")], {}),
        ([("DELETE", "k")], {}),
        ([("PUT", "k", "v"), ("DELETE", "k"), ("PUT", "k", "again")], {"k": "again"}),
        ([("PUT", "k", "")], {"k": ""}),
        ([("PUT", "key_10", "a"), ("PUT", "key_9", "b"), ("PUT", "ключ", "c")], {"key_10": "a", "key_9": "b", "ключ": "c"}),
        ([("GET", "k")], {}),
    ],
)
def test_final_state(spark, commands, expected):
    assert as_dict(state.final_state(log(spark, *commands))) == expected


def test_reads_see_all_earlier_writes_and_no_later_one(spark):
    own = log(spark, ("GET", "k"), ("PUT", "k", "a"), ("GET", "k"), ("DELETE", "k"), ("GET", "k"), ("PUT", "k", ""), ("GET", "k"))
    seen = {r.seq: (r.value, r.found) for r in state.linear_reads(own).collect()}
    assert seen == {1: (None, False), 3: ("a", True), 5: (None, False), 7: ("", True)}


def test_read_modes(spark):
    own = log(spark, ("PUT", "k", "a"), ("PUT", "k", "b"))
    keys = spark.createDataFrame([("k",), ("x",)], "key string")
    rows = lambda df: {(r.key, r.value, r.found) for r in df.collect()}
    assert rows(state.read(own, keys)) == {("k", "b", True), ("x", None, False)}
    assert rows(state.read(own, keys, "local", state.as_of(own, 1))) == {("k", "a", True), ("x", None, False)}
    with pytest.raises(ValueError):
        state.read(own, keys, "quorum")


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_spans_of_a_hot_key_give_the_same(spark, span):
    own = random_log(spark, 120, 2).cache()
    rows = [r for r in own.orderBy("seq").collect()]
    state_now, versions, reads = {}, {}, {}
    for r in rows:
        if r.op == "GET":
            reads[r.seq] = (state_now.get(r.key), r.key in state_now)
            continue
        versions.setdefault(r.key, []).append(r.seq)
        if r.op == "PUT":
            state_now[r.key] = r.value
        else:
            state_now.pop(r.key, None)
    assert {r.seq: (r.value, r.found) for r in state.linear_reads(own, span).collect()} == reads
    want = {(k, v, s, (seqs + [None])[v]) for k, seqs in versions.items() for v, s in enumerate(seqs, 1)}
    assert {(r.key, r.version, r.from_seq, r.to_seq) for r in state.history(own, span).collect()} == want


def random_log(spark, n=400, keys=30, seed=5):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        op = r.choice(["PUT", "PUT", "DELETE", "GET"])
        rows.append((i + 1, op, f"key_{r.randrange(keys)}", (f"v{i}" if r.random() > 0.1 else "") if op == "PUT" else None))
    return spark.createDataFrame(rows, "seq long, op string, key string, value string").repartition(3)


def test_compaction_recovery_and_replay_leave_the_state(spark):
    own = random_log(spark)
    want = as_dict(state.final_state(own))
    segs = segments.assign(own, 40)
    assert as_dict(segments.visible(segs)) == want
    once = segments.compacted(segs, 4)
    assert as_dict(segments.visible(once)) == want
    assert as_dict(segments.visible(segments.compacted(once, 4))) == want
    assert as_dict(segments.recover(own, 40, 200)) == want
    assert as_dict(state.final_state(own.union(own))) == want  # delivered twice
    assert segments.compact_oldest(segs.where("seg_order < 3"), 4).count() == 0


def test_output_at_the_tail_would_be_wrong(spark):
    row = segments.order_anomaly(segments.assign(random_log(spark), 40), 4).first()
    assert row.stale > 0


def test_flush_boundaries_follow_bytes(spark):
    own = log(spark, *[("PUT", f"k{i:02d}", "x" * 97) for i in range(30)])
    got = segments.flush_boundaries(own, 1000).groupBy("seg_order").count().orderBy("seg_order").collect()
    assert [r["count"] for r in got] == [10, 10, 10]
    same = log(spark, *[("PUT", "k", "x" * 97) for _ in range(30)])
    assert segments.flush_boundaries(same, 1000).select("seg_order").distinct().count() == 1


def test_workload(spark):
    rows = workload.tasks(spark, 2000, 0.4, 0.2, 50, 8, seed=1)
    n = {r.operation: r["count"] for r in rows.groupBy("operation").count().collect()}
    assert 700 < n["put"] < 900 and 300 < n["delete"] < 500
    assert rows.select("value").distinct().count() == 1
    with pytest.raises(ValueError):
        workload.tasks(spark, 10, 0.9, 0.2, 5, 8, 1)
    with pytest.raises(Exception, match="unknown workload"):
        workload.with_ratios(spark.createDataFrame([("nope",)], "workload string")).collect()


def test_quantitative_recovery(spark):
    own = [("PUT", f"mix_{i:04d}", "v1") for i in range(1000)] + [("PUT", f"mix_{i:04d}", "v2") for i in range(500)] + [("DELETE", f"mix_{i:04d}") for i in range(500, 750)]
    found = as_dict(segments.recover(log(spark, *own), 100, 1300))
    assert sum(v == "v2" for v in found.values()) == 500 and sum(v == "v1" for v in found.values()) == 250


def test_what_stood_behind_a_conflict_is_gone(spark):
    rows = [(i, 1, "k", "PUT") for i in range(1, 11)] + [(6, 2, "k", "DELETE"), (7, 2, "k", "DELETE")]
    for span in (1, 3, 1000):
        got = sorted((r.seq, r.term) for r in state.resolve_terms(spark.createDataFrame(rows, "seq long, term long, key string, op string"), span).collect())
        assert got == [(i, 1) for i in range(1, 6)] + [(6, 2), (7, 2)]


@pytest.mark.parametrize("bad", [{"total": -1}, {"concurrency": 0}, {"read_mode": "quorum"}, {"prefill": -1}, {"warmup": -1}, {"timeout": 0}, {"write_ratio": 1.1}, {"delete_ratio": -0.1}, {"keyspace": 0}, {"value_size": 0}])
def test_validation(bad):
    own = {"total": 0, "write_ratio": 0.5, "delete_ratio": 0.5, "keyspace": 1, "value_size": 1}
    workload.validate(**own)
    with pytest.raises(ValueError):
        workload.validate(**(own | bad))


@pytest.mark.parametrize("ranges", [1, 2, 50])
def test_any_ranges_of_keys_give_the_same(spark, ranges):
    own = random_log(spark, 300, 25)
    segs, keys = segments.assign(own, 30), own.select("key").union(spark.createDataFrame([("a",), ("zzz",)], "key string"))
    zones = [(r.min_key, r.max_key, r.seg_order) for r in segments.zone_maps(segs).collect()]
    hits = {}
    for r in segs.collect():
        hits[r.key] = max(hits.get(r.key, -1), r.seg_order)
    wanted = {r.key for r in keys.collect()}
    touched = {k: (sum(a <= k <= b and s >= hits.get(k, -1) for a, b, s in zones), k in hits) for k in wanted}
    assert {r.key: (r.touched, r.found) for r in segments.read_amplification(segs, keys, ranges).collect()} == touched
    assert {r.key: r.pruned for r in segments.prune_ratio(segs, keys, ranges).collect()} == {k: sum(not a <= k <= b for a, b, _ in zones) for k in wanted}


def most_rows(df):
    """The rows of df, and the most rows that any step of its last run put out."""
    got, plans, most = df.collect(), [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        plan = plans.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            plans.append(plan.plan())
        made = plan.metrics().get("numOutputRows")
        most = max(most, made.get().value() if made.isDefined() else 0)
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    return got, most


@pytest.mark.parametrize("query", ["prune_ratio", "read_amplification"])
def test_keys_and_segments_are_counted_not_paired(spark, query):
    """Every segment's range holds nearly every key, so pairs would be 90,000."""
    n = 300
    own = [(s, f"k{x:03}", s, "PUT", "v") for s in range(n) for x in (s % 3, s, 299 - s % 5)]
    segs = spark.createDataFrame(sorted(set(own)), "seg_order long, key string, seq long, op string, value string")
    wanted = [None, "a", "k0005", "zzz", *(f"k{x:03}" for x in range(n))]
    zones, hits = {}, {}
    for s, key, *_ in own:
        a, b = zones.get(s, (key, key))
        zones[s], hits[key] = (min(a, key), max(b, key)), max(hits.get(key, -1), s)
    held = {k: [s for s, (a, b) in zones.items() if k is not None and a <= k <= b] for k in wanted}
    got, most = most_rows(getattr(segments, query)(segs, spark.createDataFrame([(k,) for k in wanted], "key string"), 8))
    if query == "prune_ratio":
        assert {r.key: (r.pruned, r.segments) for r in got} == {k: (n - len(held[k]), n) for k in wanted}
    else:
        assert {r.key: (r.touched, r.found) for r in got} == {k: (sum(s >= hits.get(k, -1) for s in held[k]), k in hits) for k in wanted}
    assert len(got) == len(wanted) and sum(map(len, held.values())) > 80_000 and most < 10 * n
