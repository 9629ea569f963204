import math
import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import expressions as E
from tidelog.operators import stats


@pytest.mark.parametrize("n", [1, 2, 10, 99, 100, 101, 1000])
def test_nearest_rank(spark, n):
    xs = random.Random(n).sample(range(10 * n), n)
    row = stats.latency(spark.createDataFrame([("g", x) for x in xs], "g string, latency_ns long"), "g").first()
    for name, p in stats.PERCENTILES.items():
        assert row[f"{name}_ns"] == sorted(xs)[max(0, math.ceil(n * p) - 1)]
    assert row.avg_ns == sum(xs) // n and row.max_ns == max(xs)


def test_percentiles_of_groups_with_ties_nulls_and_large_values(spark):
    r = random.Random(3)
    rows = [(g, r.choice([None, r.randrange(5), r.randrange(10**6), r.randrange(10**15)])) for g in ("a", "b", None) for _ in range(400)] + [("empty", None), ("neg", -5), ("neg", -700), ("neg", 3)]
    got = {x.g: x for x in stats.latency(spark.createDataFrame(rows, "g string, latency_ns long"), "g").collect()}
    for g in ("a", "b", None, "empty", "neg"):
        xs = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g].n == len(xs) and got[g].max_ns == max(xs, default=0)
        for name, p in stats.PERCENTILES.items():
            assert got[g][f"{name}_ns"] == (xs[max(0, math.ceil(len(xs) * p) - 1)] if xs else 0)


def test_quorum_of_the_current_term(spark):
    rows = [("a", 5, 2, 2), ("a", 4, 2, 2), ("a", 1, 1, 2), ("b", 5, 1, 2), ("b", 4, 1, 2), ("b", 9, 2, 2)]
    df = spark.createDataFrame(rows, "c string, match_index long, t long, now long")
    assert {r.c: r.commit_index for r in stats.quorum_index(df, ["c"]).collect()} == {"a": 4, "b": 5}
    assert {r.c: r.commit_index for r in stats.quorum_index(df, ["c"], term="t", current="now").collect()} == {"a": 4, "b": None}


def test_what_cannot_be_read_is_a_mismatch(spark):
    bodies = ["", "x", "[]", '"x"', '{"value":5}', '{"value":', '{"other":1}', '{"value":null}', "{}", '{"value":""}']
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    flags = E.matches(F.lit(200), F.col("body"), F.lit(None).cast("string"), F.lit(""))
    assert [r[0] for r in df.select(flags["success"]).collect()] == [False] * 6 + [True] * 4


def test_no_latencies_give_zeros(spark):
    row = stats.latency(spark.createDataFrame([], "latency_ns long")).first()
    assert tuple(row) == (0,) * 7


def test_deltas_of_a_reset_counter(spark):
    rows = spark.createDataFrame([("n", 1, 5), ("n", 2, 9), ("n", 3, 2), ("n", 4, 3)], "node string, t int, c long")
    assert stats.counter_deltas(rows, "node", "t", ["c"]).first().c_delta == 5
    assert stats.before_after(rows.where("t = 2"), rows.where("t = 3"), ["node"], ["c"]).first().c_delta == 0


@pytest.mark.parametrize("nodes, leader, term", [([(0, 3, False), (1, 5, True), (2, 4, False)], 1, 5), ([(0, 3, True), (1, 7, False)], 0, 7), ([(0, 9, False), (1, 2, True)], 1, 2), ([(0, 2, False)], -1, 2)])
def test_leader(spark, nodes, leader, term):
    df = spark.createDataFrame([("c", *n) for n in nodes], "cluster string, node long, term long, is_leader boolean")
    row = stats.leader(df, ["cluster"]).first()
    assert (row.leader, row.term) == (leader, term)


def test_errors(spark):
    cases = [("net/http: Client.Timeout exceeded", "timeout"), ("context deadline exceeded", "timeout"), ("connection refused", "connection_refused"), ("NOT LEADER", "not_leader"), ("request timeout", "request_timeout"), ("eof", "other"), (None, None)]
    df = spark.createDataFrame(cases, "m string, e string")
    assert df.where(~E.network_error(F.col("m")).eqNullSafe(F.col("e"))).count() == 0
    rows = spark.createDataFrame([(500, "not leader", "not_leader"), (503, "", "http_503"), (0, None, "other")], "s int, b string, e string")
    assert rows.where(E.http_failure(F.col("s"), F.col("b")) != F.col("e")).count() == 0


def test_flags_may_overlap(spark):
    df = spark.createDataFrame([(500, "Leadership changed before commit", None), (200, "not json", None), (200, '{"value":"x"}', None), (503, "", None), (0, None, "i/o timeout")], "http_status int, body string, network_error string")
    flags = df.select(*[c.alias(n) for n, c in E.matches(F.col("http_status"), F.col("body"), F.col("network_error"), F.lit("x")).items()]).toPandas()
    assert flags.loc[0, ["leadership_changed", "http_500"]].all()
    assert flags.loc[1, "result_mismatch"] and flags.loc[2, "success"] and flags.loc[3, "http_503"] and flags.loc[4, "request_timeout"]


def test_small_expressions(spark):
    row = spark.range(1).select(
        E.workload_name(F.lit(0.5), F.lit(True)).alias("w"), E.path_escape(F.lit("a b/c")).alias("p"), E.first_text(F.lit(""), F.lit(None).cast("string")).alias("m"), E.get_qps(F.lit(0.0), F.lit(10), F.lit(4.0)).alias("q")
    ).first()
    assert tuple(row) == ("read_write_50_50", "a%20b%2Fc", "unknown", 2.5)
