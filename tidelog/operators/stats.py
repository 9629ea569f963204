"""Request reports, exact latency percentiles, counters and experiment summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.functions import expressions as E

PERCENTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}


def _bucket(x: Column) -> Column:
    """A whole number that never falls as x grows, and that few distinct values share: length in bits, and the first nine."""
    size = F.length(F.bin(F.abs(x)))
    own = size * 512 + F.expr("shiftright(abs(_x), greatest(length(bin(abs(_x))) - 9, 0))") % 512
    return F.when(x < 0, -own).otherwise(own)


def latency(requests: DataFrame, *by: str, x: str = "latency_ns", percentiles: dict[str, float] = PERCENTILES) -> DataFrame:
    """count, avg (whole, as the sum divided), percentiles and max for each group; 0 for a group without values.

    A percentile is the value at rank ceil(n * p), exactly; no interpolation. Values are counted first, then their
    buckets; ranks are looked for among the buckets of a group (some tens of thousands at most), and then among the
    values of one bucket. So a group may have any number of rows and of values, and no task holds them all.
    """
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    counts = requests.select(key.alias("_by"), F.col(x).cast("long").alias("_x")).groupBy("_by", "_x").agg(F.count("*").alias("_n"))
    known = counts.where("_x IS NOT NULL").withColumn("_b", _bucket(F.col("_x")))
    buckets = known.groupBy("_by", "_b").agg(F.sum("_n").alias("_n"))
    rank = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("p")) for n, p in percentiles.items()]))
    totals = counts.groupBy("_by").agg(F.coalesce(F.sum(F.when(F.col("_x").isNotNull(), F.col("_n"))), F.lit(0)).alias("n"), F.sum(F.col("_x") * F.col("_n")).alias("_sum"), F.max("_x").alias("_max"))
    inside = Window.partitionBy("_by").orderBy("_b")
    placed = buckets.withColumn("_to", F.sum("_n").over(inside)).join(totals.select("_by", "n", rank.alias("_r")), "_by")
    wanted = placed.withColumn("_rank", F.greatest(F.ceil(F.col("n") * F.col("_r.p")), F.lit(1))).where((F.col("_rank") <= F.col("_to")) & (F.col("_rank") > F.col("_to") - F.col("_n")))
    wanted = wanted.select("_by", "_b", F.col("_r.name").alias("_name"), (F.col("_rank") - F.col("_to") + F.col("_n")).alias("_rank"))
    within = known.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_by", "_b").orderBy("_x")))
    found = within.join(wanted, ["_by", "_b"]).where((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n")))
    each = found.groupBy("_by").agg(*[F.max(F.when(F.col("_name") == n, F.col("_x"))).alias(f"{n}_ns") for n in percentiles])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    if not by:  # a row even without any request
        totals = totals.unionByName(requests.sparkSession.sql("SELECT struct(0 AS all) AS _by, 0L AS n, CAST(NULL AS LONG) AS _sum, CAST(NULL AS LONG) AS _max")).groupBy("_by").agg(F.sum("n").alias("n"), F.max("_sum").alias("_sum"), F.max("_max").alias("_max"))
    out = totals.join(each, "_by", "left")
    return out.select(*[F.col("_by")[c].alias(c) for c in by], "n", zero(F.expr("CASE WHEN n > 0 THEN _sum DIV n END")).alias("avg_ns"), *[zero(F.col(f"{n}_ns")).alias(f"{n}_ns") for n in percentiles], zero(F.col("_max")).alias("max_ns"))


def classified(requests: DataFrame) -> DataFrame:
    """Adds success, found, not_found and error_type."""
    op, status, body, error = (F.col(c) for c in ("operation", "http_status", "body", "network_error"))
    own = (op == "get") & error.isNull()
    return requests.withColumns(
        {"success": E.success(op, status, error), "found": own & (status == 200), "not_found": own & (status == 404), "error_type": E.error_type(op, status, body, error)}
    )


def slower_than(requests: DataFrame, ns: int = 5_000_000_000) -> DataFrame:
    """Requests that would have timed out."""
    return requests.where(F.col("latency_ns") > ns)


def report(requests: DataFrame, seconds: float) -> DataFrame:
    """Counts, rates and latencies for each operation and for all (operation is 'all'): requests are counted once for each
    operation, and a roll-up adds these few rows."""
    per = classified(requests).groupBy("operation").agg(
        F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.count_if("found").alias("found"), F.count_if("not_found").alias("not_found"), F.max("latency_ns").alias("max_ns")
    )
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "succeeded", "found", "not_found")]
    both = per.rollup("operation").agg(*sums, F.max("max_ns").alias("max_ns"), F.grouping("operation").alias("_all"))
    rates = [E.ratio(F.col("succeeded"), F.col("total")).alias("success_rate"), (F.col("succeeded") / F.lit(float(seconds))).alias("success_qps")]
    name = F.when(F.col("_all") == 1, "all").otherwise(F.col("operation")).alias("operation")
    return both.select(name, "total", "succeeded", (F.col("total") - F.col("succeeded")).alias("failed"), "found", "not_found", *rates, "max_ns")


def error_histogram(requests: DataFrame) -> DataFrame:
    """error_type, n: the known types even with no error, and whatever else came."""
    seen = classified(requests).where("error_type IS NOT NULL").groupBy("error_type").agg(F.count("*").alias("n"))
    known = requests.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in E.ERROR_TYPES])).alias("error_type"))
    return known.join(seen, "error_type", "full").select("error_type", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def verified(requests: DataFrame, expected: DataFrame) -> DataFrame:
    """Reads with their flags against expected (key, expected)."""
    reads = requests.where(F.col("operation") == "get").join(expected, "key", "left")
    return reads.withColumns(E.matches(F.col("http_status"), F.col("body"), F.col("network_error"), F.col("expected")))


def match_rollup(flags: DataFrame) -> DataFrame:
    names = ["success", "result_mismatch", "not_leader", "request_timeout", "leadership_changed", "http_500", "http_503", "other_error"]
    return flags.agg(F.count("*").alias("total"), *[F.count_if(n).alias(f"n_{n}") for n in names])


def store_errors(messages: DataFrame, column: str = "message") -> DataFrame:
    low = F.lower(column)
    wanted = {"not_leader": "not leader", "request_timeout": "request timeout", "leadership_changed": "leadership changed before commit"}
    return messages.agg(*[F.count_if(low.contains(x)).alias(n) for n, x in wanted.items()])


def timeline(requests: DataFrame, ts: str = "ts", unit: str = "day", seconds: float = 86400.0) -> DataFrame:
    return requests.groupBy(F.date_trunc(unit, ts).alias("bucket")).agg(F.count("*").alias("n"), (F.count("*") / F.lit(seconds)).alias("qps"))


def counter_deltas(snapshots: DataFrame, by: str, order: str, counters: list[str]) -> DataFrame:
    """What counters gained from one snapshot of a group to the next, summed; resets gain nothing."""
    own = Window.partitionBy(by).orderBy(order)
    steps = snapshots.select(by, *[F.coalesce(E.delta(F.lag(c).over(own), F.col(c)), F.lit(0)).alias(c) for c in counters])
    return steps.groupBy(by).agg(*[F.sum(c).alias(f"{c}_delta") for c in counters])


def before_after(before: DataFrame, after: DataFrame, by: list[str], counters: list[str]) -> DataFrame:
    old = before.select(*by, *[F.col(c).alias(f"_{c}") for c in counters])
    return after.join(old, by).select(*by, *[E.delta(F.col(f"_{c}"), F.col(c)).alias(f"{c}_delta") for c in counters])


def rollup(nodes: DataFrame, by: list[str], sums: list[str], maxima: list[str], flags: list[str], ratios: dict[str, tuple[str, str]], last: dict[str, str] | None = None) -> DataFrame:
    """A cluster's figures from those of its nodes: sums, maxima, whether all flags are set, ratios of sums, and the last
    value of a column by another (last: {column: order})."""
    out = [F.sum(c).alias(c) for c in sums] + [F.max(c).alias(c) for c in maxima] + [F.bool_and(c).alias(c) for c in flags]
    out += [E.ratio(F.sum(a), F.sum(b)).alias(n) for n, (a, b) in ratios.items()]
    out += [F.max_by(c, order).alias(c) for c, order in (last or {}).items()]
    return nodes.groupBy(*by).agg(*out)


def leader(nodes: DataFrame, by: list[str]) -> DataFrame:
    """leader and term as a gateway sees them: nodes in order; a claim sets both, a later higher term raises the term."""
    own = F.array_sort(F.collect_list(F.struct(F.col("node").cast("long").alias("node"), F.col("term").cast("long").alias("term"), F.col("is_leader").alias("is_leader"))))
    start = F.struct(F.lit(-1).cast("long").alias("leader"), F.lit(0).cast("long").alias("term"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(F.when(x["is_leader"], x["node"]).otherwise(acc["leader"]).alias("leader"), F.when(x["is_leader"], x["term"]).otherwise(F.greatest(acc["term"], x["term"])).alias("term"))

    return nodes.groupBy(*by).agg(F.aggregate(own, start, step).alias("s")).select(*by, "s.leader", "s.term")


def quorum_index(nodes: DataFrame, by: list[str], index: str = "match_index", term: str | None = None, current: str | None = None) -> DataFrame:
    """The highest index that more than half of a group's nodes have. Groups are clusters, a few nodes each.

    With term (of the leader's entry at the node's index) and current (the leader's term): an index counts only if its
    entry is of the current term. Terms don't fall along a log, so below it there is none either, and the result is null.
    """
    own = F.struct(F.col(index).alias("i"), *([F.col(term).alias("t")] if term else []))
    have = F.sort_array(F.collect_list(own), asc=False)
    half = F.get(have, F.floor(F.count("*") / 2).cast("int"))
    found = F.when(half["t"] == F.max(current), half["i"]) if term else half["i"]
    return nodes.groupBy(*by).agg(found.alias("commit_index"))


def experiment_summary(runs: DataFrame, by: str = "scenario", x: str = "ms", ok: str = "pass") -> DataFrame:
    return runs.groupBy(by).agg(F.count("*").alias("runs"), F.count_if(ok).alias("passed"), F.avg(x).alias("avg_ms"), F.min(x).alias("min_ms"), F.max(x).alias("max_ms"), F.bool_and(ok).alias("all_passed"))


def matrix(spark, **dimensions: list) -> DataFrame:
    """Every combination of a few settings; sizes are those of the lists given, not of data."""
    out = spark.range(1)
    for name, values in dimensions.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.drop("id")


def hottest(log: DataFrame, n: int = 20) -> DataFrame:
    return log.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(n)


def verify_keys(expected: DataFrame, state: DataFrame) -> DataFrame:
    """One row: of expected (key, expected; null for a deleted key), how many the state confirms."""
    both = expected.join(state.select("key", "value"), "key", "left")
    return both.agg(F.count("*").alias("checked"), F.count_if(F.col("expected").eqNullSafe(F.col("value"))).alias("verified"))
