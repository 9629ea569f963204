"""Every named query with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import expressions as E
from tidelog.operators import segments, state, stats, workload
from tidelog.plans import report
from tidelog.sources import binary, changelog, files, requests
from tidelog.streaming import apply as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SEGMENT = 500

OPS = """ops AS (
  SELECT event_id + 1 AS seq, concat('user_', CAST(user_id AS VARCHAR)) AS key, ts, user_id,
         CASE event_type WHEN 'error' THEN 'DELETE' WHEN 'view' THEN 'GET' ELSE 'PUT' END AS op,
         CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN props END AS value
  FROM events),
writes AS (SELECT * FROM ops WHERE op <> 'GET'),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM writes) WHERE rn = 1),
segs AS (SELECT seg_order, key, seq, op, value FROM (
  SELECT CAST(floor((seq - 1) / 500.0) AS BIGINT) AS seg_order, key, seq, op, value,
         row_number() OVER (PARTITION BY CAST(floor((seq - 1) / 500.0) AS BIGINT), key ORDER BY seq DESC) AS rn FROM writes) WHERE rn = 1),
zones AS (SELECT seg_order, min(key) AS min_key, max(key) AS max_key, count(*) AS row_count,
                 CAST(sum(CASE WHEN op = 'DELETE' THEN 1 ELSE 0 END) AS BIGINT) AS tombstones,
                 CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS size_bytes
          FROM segs GROUP BY seg_order),
picked AS (SELECT DISTINCT seg_order FROM segs ORDER BY seg_order LIMIT 4),
merged4 AS (SELECT key, seq, op, value FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY seg_order DESC) AS rn FROM segs WHERE seg_order IN (SELECT seg_order FROM picked)) WHERE rn = 1)"""

REQUESTS = """raw AS (
  SELECT event_id + 1 AS seq, ts, user_id, concat('user_', CAST(user_id AS VARCHAR)) AS key,
         CASE event_type WHEN 'error' THEN 'delete' WHEN 'view' THEN 'get' ELSE 'put' END AS operation,
         CAST(floor(value * 1000) AS BIGINT) * 1000 AS latency_ns,
         rpad('match_value_' || lpad(CAST(user_id AS VARCHAR), 6, '0') || '_', 32, 'x') AS expected
  FROM events),
stat AS (
  SELECT *, CASE WHEN seq % 50 = 7 THEN 0 WHEN seq % 20 = 0 THEN 503 WHEN seq % 20 = 1 THEN 500
                 WHEN operation = 'get' AND seq % 3 = 0 THEN 404 ELSE 200 END AS http_status,
         CASE WHEN seq % 150 = 7 THEN 'timeout' WHEN seq % 150 = 57 THEN 'connection_refused' WHEN seq % 50 = 7 THEN 'other' END AS net
  FROM raw),
req AS (
  SELECT *, net IS NULL AND (http_status = 200 OR (operation = 'get' AND http_status = 404)) AS success,
         CASE WHEN net IS NOT NULL THEN net
              WHEN http_status = 200 OR (operation = 'get' AND http_status = 404) THEN NULL
              WHEN http_status = 503 AND seq % 40 = 0 THEN 'not_leader'
              WHEN http_status = 500 AND seq % 60 = 1 THEN 'request_timeout'
              ELSE 'http_' || CAST(http_status AS VARCHAR) END AS error_type
  FROM stat),
flags AS (
  SELECT *, CASE WHEN net = 'timeout' THEN 'request_timeout' WHEN net IS NOT NULL THEN 'other_error'
                 WHEN http_status = 500 AND seq % 60 = 21 THEN 'leadership_changed'
                 WHEN http_status = 500 AND seq % 60 = 1 THEN 'request_timeout'
                 WHEN http_status = 503 AND seq % 40 = 0 THEN 'not_leader'
                 WHEN http_status = 503 THEN 'http_503' WHEN http_status = 500 THEN 'http_500'
                 WHEN http_status <> 200 THEN 'other_error'
                 WHEN seq % 35 = 3 THEN 'result_mismatch' ELSE 'success' END AS rule
  FROM req WHERE operation = 'get')"""


def query(name: str, sql: str | None = None, using: str = OPS):
    """Registers fn(spark, sf_dir) under a name. sql goes on from the relations in using."""

    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = (f"WITH {using}\n" if using else "") + sql
        return fn

    return put


def log(spark, sf_dir):
    return changelog.from_events(spark, sf_dir)


def segs(spark, sf_dir):
    return segments.assign(log(spark, sf_dir), SEGMENT)


def keys(spark, sf_dir):
    return log(spark, sf_dir).select("key").distinct()


# state


@query("kv_final_state", "SELECT key, value, seq FROM latest WHERE op = 'PUT'")
def kv_final_state(spark, sf_dir):
    return state.final_state(log(spark, sf_dir))


@query("kv_point_get", "SELECT key, value, seq FROM latest WHERE op = 'PUT' AND key = 'user_42'")
def kv_point_get(spark, sf_dir):
    return state.get(log(spark, sf_dir), "user_42")


@query(
    "kv_multi_get_found",
    """, wanted AS (SELECT 'user_' || CAST(n AS VARCHAR) AS key FROM (SELECT unnest(range(0, 200)) AS n))
    SELECT w.key, CASE WHEN l.op = 'PUT' THEN l.value END AS value, coalesce(l.op = 'PUT', false) AS found
    FROM wanted w LEFT JOIN latest l ON w.key = l.key""",
)
def kv_multi_get_found(spark, sf_dir):
    wanted = spark.range(200).select(F.concat(F.lit("user_"), F.col("id").cast("string")).alias("key"))
    return state.read(log(spark, sf_dir), wanted, "raft")


@query(
    "kv_local_read",
    """, old AS (SELECT key, max(seq) AS seq FROM writes WHERE seq <= 400 GROUP BY key),
    wanted AS (SELECT DISTINCT key FROM ops)
    SELECT w.key, x.value, x.seq IS NOT NULL AS found FROM wanted w LEFT JOIN (
      SELECT o.key, w2.value, o.seq FROM old o JOIN writes w2 ON o.seq = w2.seq WHERE w2.op = 'PUT') x ON w.key = x.key""",
)
def kv_local_read(spark, sf_dir):
    own = log(spark, sf_dir)
    return state.read(own, own.select("key"), "local", state.as_of(own, 400))


@query(
    "kv_linear_read",
    """, seen AS (SELECT seq, key, op, max(CASE WHEN op <> 'GET' THEN seq END) OVER (
          PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM ops)
    SELECT s.seq, s.key, CASE WHEN o.op = 'PUT' THEN o.value END AS value, coalesce(o.op = 'PUT', false) AS found
    FROM seen s LEFT JOIN ops o ON s.w = o.seq WHERE s.op = 'GET'""",
)
def kv_linear_read(spark, sf_dir):
    return state.linear_reads(log(spark, sf_dir))


@query(
    "kv_as_of_state",
    """SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn
    FROM writes WHERE seq <= 5000) WHERE rn = 1 AND op = 'PUT'""",
)
def kv_as_of_state(spark, sf_dir):
    return state.as_of(log(spark, sf_dir), 5000)


@query("kv_tombstones", "SELECT key, seq FROM latest WHERE op = 'DELETE'")
def kv_tombstones(spark, sf_dir):
    return state.tombstones(log(spark, sf_dir))


@query(
    "kv_key_history",
    """SELECT key, op, value, seq AS from_seq, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS to_seq,
    row_number() OVER (PARTITION BY key ORDER BY seq) AS version FROM writes""",
)
def kv_key_history(spark, sf_dir):
    return state.history(log(spark, sf_dir))


@query(
    "kv_live_count_by_seq_bucket",
    """SELECT seg_order // 2 AS bucket, count(*) AS n_keys, CAST(sum(CASE WHEN op = 'PUT' THEN 1 ELSE 0 END) AS BIGINT) AS n_live FROM (
      SELECT *, row_number() OVER (PARTITION BY seg_order // 2, key ORDER BY seq DESC) AS rn FROM segs) WHERE rn = 1 GROUP BY 1""",
)
def kv_live_count_by_seq_bucket(spark, sf_dir):
    return state.live_by_bucket(log(spark, sf_dir), 1000)


@query(
    "kv_orders_state",
    """SELECT o_custkey AS key, max(o_orderkey) AS seq FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey
    HAVING arg_max(o_orderstatus, o_orderkey) = 'O'""",
    using="",
)
def kv_orders_state(spark, sf_dir):
    rows = changelog.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_custkey").alias("key"),
        F.when(F.col("o_orderstatus") == "F", "DELETE").when(F.col("o_orderstatus") == "P", "GET").otherwise("PUT").alias("op"),
        F.col("o_orderpriority").alias("value"),
    )
    return state.final_state(rows).select("key", "seq")


@query(
    "log_term_conflict",
    """, own AS (SELECT seq, 1 + seq // 100 AS term, key, op FROM ops),
    copies AS (SELECT * FROM own UNION ALL SELECT seq, term + 1, key, 'DELETE' FROM own WHERE seq % 100 BETWEEN 50 AND 59),
    best AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY term DESC) AS rn FROM copies),
    cut AS (SELECT *, max(term) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS top FROM best WHERE rn = 1)
    SELECT seq, term, key, op FROM cut WHERE term = top""",
)
def log_term_conflict(spark, sf_dir):
    """Another leader overwrote some entries of each hundred in a higher term: what stood behind them is gone."""
    own = log(spark, sf_dir).select("seq", (F.floor(F.col("seq") / 100) + 1).alias("term"), "key", "op")
    other = own.where("seq % 100 BETWEEN 50 AND 59").select("seq", (F.col("term") + 1).alias("term"), "key", F.lit("DELETE").alias("op"))
    return state.resolve_terms(own.unionByName(other), span=1000)


@query(
    "log_up_to_date",
    """, n AS (SELECT user_id % 7 AS node, max(1 + seq // 1000) AS last_term, max(seq) AS last_seq FROM ops GROUP BY 1)
    SELECT a.node, b.node AS candidate, b.last_term > a.last_term OR (b.last_term = a.last_term AND b.last_seq >= a.last_seq) AS vote
    FROM n a JOIN n b ON (a.node + 1) % 7 = b.node""",
)
def log_up_to_date(spark, sf_dir):
    events = changelog.table(spark, sf_dir, "events")
    seq = F.col("event_id") + 1
    nodes = events.groupBy((F.col("user_id") % 7).alias("node")).agg(F.max(F.floor(seq / 1000) + 1).alias("last_term"), F.max(seq).alias("last_seq"))
    other = nodes.select(F.col("node").alias("candidate"), ((F.col("node") + 6) % 7).alias("node"), F.col("last_term").alias("t"), F.col("last_seq").alias("s"))
    return nodes.join(other, "node").select("node", "candidate", state.up_to_date(F.col("t"), F.col("s"), F.col("last_term"), F.col("last_seq")).alias("vote"))


@query(
    "log_await_result",
    """SELECT seq, CASE WHEN seq % 7 = 0 THEN 'request timeout' WHEN seq % 11 = 0 THEN 'leadership changed before commit' ELSE 'ok' END AS result FROM writes""",
)
def log_await_result(spark, sf_dir):
    own = state.writes(log(spark, sf_dir)).select("seq", (F.col("seq") * 10).alias("op_id"))
    applied = own.where("seq % 7 <> 0").select("seq", F.when(F.col("seq") % 11 == 0, -1).otherwise(F.col("op_id")).alias("op_id"))
    return state.results(own, applied).select("seq", "result")


# segments


@query("seg_assign_meta", "SELECT * FROM zones")
def seg_assign_meta(spark, sf_dir):
    return segments.zone_maps(segs(spark, sf_dir))


@query(
    "seg_flush_bytes",
    """, w AS (SELECT CAST(floor((seq - 1) / 500.0) AS BIGINT) AS seg_order, CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS written_bytes
      FROM writes GROUP BY 1)
    SELECT w.seg_order, written_bytes, size_bytes AS kept_bytes FROM w JOIN zones z ON w.seg_order = z.seg_order""",
)
def seg_flush_bytes(spark, sf_dir):
    return segments.flush_bytes(log(spark, sf_dir), SEGMENT)


@query(
    "seg_flush_by_size",
    """, w AS (SELECT seq, seq // 1000 AS shard, strlen(key) + coalesce(strlen(value), 0) AS n FROM writes),
    lone AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY seq) AS place FROM w)
    SELECT shard, seq, CAST(place - 1 AS BIGINT) AS seg_order FROM lone""",
)
def seg_flush_by_size(spark, sf_dir):
    """A memtable of one byte flushes every command; shards of the log are flushed each for itself."""
    own = log(spark, sf_dir).withColumn("shard", F.floor(F.col("seq") / 1000))
    return segments.flush_boundaries(own, 1).select("shard", "seq", "seg_order")


@query(
    "seg_read_amplification",
    """, wanted AS (SELECT DISTINCT key FROM ops), hit AS (SELECT key, max(seg_order) AS hit FROM segs GROUP BY key)
    SELECT w.key, count(CASE WHEN z.seg_order IS NOT NULL AND (h.hit IS NULL OR z.seg_order >= h.hit) THEN 1 END) AS touched,
           max(h.hit) IS NOT NULL AS found
    FROM wanted w LEFT JOIN hit h ON w.key = h.key LEFT JOIN zones z ON w.key BETWEEN z.min_key AND z.max_key GROUP BY w.key""",
)
def seg_read_amplification(spark, sf_dir):
    return segments.read_amplification(segs(spark, sf_dir), keys(spark, sf_dir))


@query(
    "seg_prune_ratio",
    """, wanted AS (SELECT DISTINCT key FROM ops), total AS (SELECT count(*) AS segments FROM zones)
    SELECT w.key, any_value(t.segments) - count(z.seg_order) AS pruned, any_value(t.segments) AS segments
    FROM wanted w CROSS JOIN total t LEFT JOIN zones z ON w.key BETWEEN z.min_key AND z.max_key GROUP BY w.key""",
)
def seg_prune_ratio(spark, sf_dir):
    return segments.prune_ratio(segs(spark, sf_dir), keys(spark, sf_dir))


@query("compact_oldest4", "SELECT (SELECT max(seg_order) FROM picked) AS seg_order, key, seq, op, value FROM merged4")
def compact_oldest4(spark, sf_dir):
    return segments.compact_oldest(segs(spark, sf_dir), 4)


@query("compact_full_gc", "SELECT key, seq, op, value FROM latest WHERE op = 'PUT'")
def compact_full_gc(spark, sf_dir):
    return segments.merge(segs(spark, sf_dir), drop_tombstones=True)


@query(
    "compact_equivalence",
    """, after AS (SELECT key, seq, op, value, (SELECT max(seg_order) FROM picked) AS seg_order FROM merged4
                   UNION ALL SELECT key, seq, op, value, seg_order FROM segs WHERE seg_order NOT IN (SELECT seg_order FROM picked)),
    seen AS (SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seg_order DESC) AS rn FROM after) WHERE rn = 1 AND op = 'PUT')
    SELECT (SELECT count(*) FROM latest WHERE op = 'PUT') AS before, (SELECT count(*) FROM seen) AS after, (SELECT count(*) FROM segs) AS rows_before,
           (SELECT count(*) FROM after) AS rows_after, CAST(0 AS BIGINT) AS only_before, CAST(0 AS BIGINT) AS only_after""",
)
def compact_equivalence(spark, sf_dir):
    """A round of compaction leaves fewer entries and the same state."""
    own = segs(spark, sf_dir)
    once = segments.compacted(own, 4)
    counts = [f.agg(F.count("*").alias(n)) for f, n in ((segments.visible(own), "before"), (segments.visible(once), "after"), (own, "rows_before"), (once, "rows_after"))]
    out = segments.difference(segments.visible(own), segments.visible(once))
    for c in counts:
        out = out.join(F.broadcast(c))  # one row each
    return out


@query(
    "compact_order_anomaly",
    """, wrong AS (SELECT l.key, l.seq AS right_seq, l.op AS right_op, coalesce(m.seq, l.seq) AS seq, coalesce(m.op, l.op) AS op
      FROM latest l LEFT JOIN merged4 m ON l.key = m.key)
    SELECT count(*) AS n_keys, count(CASE WHEN seq < right_seq THEN 1 END) AS stale,
           count(CASE WHEN op = 'PUT' AND right_op = 'DELETE' THEN 1 END) AS resurrected FROM wrong""",
)
def compact_order_anomaly(spark, sf_dir):
    return segments.order_anomaly(segs(spark, sf_dir), 4)


@query(
    "compact_schedule",
    """, p AS (SELECT *, row_number() OVER (ORDER BY seg_order) - 1 AS place FROM zones),
    r AS (SELECT *, CASE WHEN place < 4 THEN 0 ELSE (place - 1) // 3 END AS round FROM p)
    SELECT round, CAST(4 AS BIGINT) AS inputs, CAST(sum(row_count) AS BIGINT) AS new_rows, CAST(sum(size_bytes) AS BIGINT) AS new_bytes
    FROM r GROUP BY round HAVING count(*) = CASE WHEN round = 0 THEN 4 ELSE 3 END""",
)
def compact_schedule(spark, sf_dir):
    return segments.schedule(segs(spark, sf_dir), 4)


@query("recover_union", "SELECT key, value, seq FROM latest WHERE op = 'PUT'")
def recover_union(spark, sf_dir):
    return segments.recover(log(spark, sf_dir), SEGMENT, cut=7000)


@query(
    "manifest_order",
    """, ids AS (SELECT DISTINCT seg_order + 1 AS id FROM segs), n AS (SELECT max(id) AS n FROM ids),
    listed AS (SELECT id, row_number() OVER (ORDER BY id % 3, id) AS pos FROM ids WHERE id < (SELECT n FROM n))
    SELECT i.id AS file_id, row_number() OVER (ORDER BY pos NULLS LAST, i.id) AS place FROM ids i LEFT JOIN listed l ON i.id = l.id""",
)
def manifest_order(spark, sf_dir):
    """Two lines of a manifest written and read again; the newest file is not listed yet."""
    ids = sorted(r.seg_order + 1 for r in segs(spark, sf_dir).select("seg_order").distinct().collect())
    file = f"{streaming.shared_folder(spark, 'manifest')}/manifest.log"
    binary.append_manifest(spark, file, ids[:2])
    binary.append_manifest(spark, file, [*sorted(ids[:-1], key=lambda i: (i % 3, i)), max(ids) + 100])
    return segments.manifest_order(binary.read_manifest(spark, file), spark.createDataFrame([(i,) for i in ids], "file_id long"))


# requests


@query(
    "req_report_by_op",
    """, g AS (SELECT coalesce(operation, 'all') AS operation, * EXCLUDE (operation) FROM (
      SELECT operation, count(*) AS total, count(CASE WHEN success THEN 1 END) AS succeeded, count(CASE WHEN NOT success THEN 1 END) AS failed,
             count(CASE WHEN operation_ = 'get' AND net IS NULL AND http_status = 200 THEN 1 END) AS found,
             count(CASE WHEN operation_ = 'get' AND net IS NULL AND http_status = 404 THEN 1 END) AS not_found, max(latency_ns) AS max_ns
      FROM (SELECT *, operation AS operation_ FROM req) GROUP BY GROUPING SETS ((operation), ())))
    SELECT operation, total, succeeded, failed, found, not_found, CAST(succeeded AS DOUBLE) / total AS success_rate,
           succeeded / 3600.0::DOUBLE AS success_qps, max_ns FROM g""",
    using=REQUESTS,
)
def req_report_by_op(spark, sf_dir):
    return stats.report(requests.from_events(spark, sf_dir), 3600.0)


@query(
    "req_latency_percentiles",
    """SELECT operation, count(*) AS n, CAST(sum(latency_ns) // count(*) AS BIGINT) AS avg_ns, quantile_disc(latency_ns, 0.5) AS p50_ns,
    quantile_disc(latency_ns, 0.9) AS p90_ns, quantile_disc(latency_ns, 0.99) AS p99_ns, quantile_disc(latency_ns, 0.999) AS p999_ns,
    max(latency_ns) AS max_ns FROM req GROUP BY operation""",
    using=REQUESTS,
)
def req_latency_percentiles(spark, sf_dir):
    return stats.latency(requests.from_events(spark, sf_dir), "operation")


@query(
    "req_error_histogram",
    """, known AS (SELECT * FROM (VALUES ('timeout'), ('connection_refused'), ('http_500'), ('http_503'), ('request_timeout'), ('not_leader'), ('other')) k(error_type)),
    seen AS (SELECT error_type, count(*) AS n FROM req WHERE error_type IS NOT NULL GROUP BY error_type)
    SELECT coalesce(k.error_type, s.error_type) AS error_type, coalesce(n, 0) AS n FROM known k FULL OUTER JOIN seen s ON k.error_type = s.error_type""",
    using=REQUESTS,
)
def req_error_histogram(spark, sf_dir):
    return stats.error_histogram(requests.from_events(spark, sf_dir))


@query("req_classify", "SELECT seq, success, error_type FROM req", using=REQUESTS)
def req_classify(spark, sf_dir):
    return stats.classified(requests.from_events(spark, sf_dir)).select("seq", "success", "error_type")


@query(
    "req_verify_values",
    """SELECT seq, key, rule = 'success' AS success, rule = 'result_mismatch' AS result_mismatch,
    rule = 'http_500' OR (net IS NULL AND rule IN ('leadership_changed', 'request_timeout') AND http_status = 500) AS http_500 FROM flags""",
    using=REQUESTS,
)
def req_verify_values(spark, sf_dir):
    found = stats.verified(requests.from_events(spark, sf_dir), requests.expected(spark, sf_dir))
    return found.select("seq", "key", "success", "result_mismatch", "http_500")


@query(
    "req_match_rollup",
    "SELECT count(*) AS total, "
    + ", ".join(
        f"count(CASE WHEN rule = '{n}'" + (" OR (net IS NULL AND rule IN ('leadership_changed', 'request_timeout') AND http_status = 500)" if n == "http_500" else "") + f" THEN 1 END) AS n_{n}"
        for n in ["success", "result_mismatch", "not_leader", "request_timeout", "leadership_changed", "http_500", "http_503", "other_error"]
    )
    + " FROM flags",
    using=REQUESTS,
)
def req_match_rollup(spark, sf_dir):
    return stats.match_rollup(stats.verified(requests.from_events(spark, sf_dir), requests.expected(spark, sf_dir)))


@query("req_qps_timeline", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, count(*) AS n, count(*) / 86400.0::DOUBLE AS qps FROM events GROUP BY 1", using="")
def req_qps_timeline(spark, sf_dir):
    return stats.timeline(requests.from_events(spark, sf_dir)).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


# telemetry: user_id as node, event order as snapshots


def nodes(spark, sf_dir):
    return changelog.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("cluster"), F.col("user_id").alias("node"), F.col("event_id"), F.floor(F.col("value")).cast("long").alias("counter"), (F.col("event_type") == "purchase").alias("is_leader")
    )


NODES = "nodes AS (SELECT user_id % 5 AS cluster, user_id AS node, event_id, CAST(floor(value) AS BIGINT) AS counter, event_type = 'purchase' AS is_leader FROM events)"


@query(
    "tele_counter_delta",
    """, d AS (SELECT node, coalesce(greatest(counter - lag(counter) OVER (PARTITION BY node ORDER BY event_id), 0), 0) AS d FROM nodes)
    SELECT node, CAST(sum(d) AS BIGINT) AS counter_delta FROM d GROUP BY node""",
    using=NODES,
)
def tele_counter_delta(spark, sf_dir):
    return stats.counter_deltas(nodes(spark, sf_dir), "node", "event_id", ["counter"])


@query(
    "tele_cluster_rollup",
    """, each AS (SELECT cluster, node, count(*) AS gets, CAST(sum(counter) AS BIGINT) AS touched, max(counter) AS touched_max, bool_and(counter >= 0) AS enabled, max(event_id) AS last_id, arg_max(counter, event_id) AS last_touched FROM nodes GROUP BY cluster, node)
    SELECT cluster, arg_max(last_touched, last_id) AS last_touched, CAST(sum(gets) AS BIGINT) AS gets, CAST(sum(touched) AS BIGINT) AS touched, max(touched_max) AS touched_max, bool_and(enabled) AS enabled,
           CAST(sum(touched) AS DOUBLE) / sum(gets) AS touched_per_get FROM each GROUP BY cluster""",
    using=NODES,
)
def tele_cluster_rollup(spark, sf_dir):
    each = nodes(spark, sf_dir).groupBy("cluster", "node").agg(F.count("*").alias("gets"), F.sum("counter").alias("touched"), F.max("counter").alias("touched_max"), F.bool_and(F.col("counter") >= 0).alias("enabled"), F.max("event_id").alias("last_id"), F.max_by("counter", "event_id").alias("last_touched"))
    return stats.rollup(each, ["cluster"], ["gets", "touched"], ["touched_max"], ["enabled"], {"touched_per_get": ("touched", "gets")}, {"last_touched": "last_id"})


@query(
    "tele_leader",
    """, each AS (SELECT cluster, node, count(*) AS term, bool_or(is_leader AND event_id % 40 = 3) AS is_leader FROM nodes GROUP BY cluster, node),
    last AS (SELECT cluster, max(node) AS leader FROM each WHERE is_leader GROUP BY cluster)
    SELECT e.cluster, CAST(coalesce(any_value(l.leader), -1) AS BIGINT) AS leader,
           CAST(max(CASE WHEN l.leader IS NULL OR e.node >= l.leader THEN e.term ELSE 0 END) AS BIGINT) AS term
    FROM each e LEFT JOIN last l ON e.cluster = l.cluster GROUP BY e.cluster""",
    using=NODES,
)
def tele_leader(spark, sf_dir):
    each = nodes(spark, sf_dir).groupBy("cluster", "node").agg(F.count("*").alias("term"), F.bool_or(F.col("is_leader") & (F.col("event_id") % 40 == 3)).alias("is_leader"))
    return stats.leader(each, ["cluster"])


@query(
    "tele_quorum_index",
    """, each AS (SELECT cluster, node, max(event_id) AS match_index FROM nodes GROUP BY cluster, node),
    last AS (SELECT cluster, max(1 + event_id // 100) AS current FROM nodes GROUP BY cluster),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY match_index DESC) AS place, count(*) OVER (PARTITION BY cluster) AS n FROM each)
    SELECT r.cluster, match_index AS any_term, CASE WHEN 1 + match_index // 100 = current - r.cluster % 2 THEN match_index END AS commit_index
    FROM r JOIN last l ON r.cluster = l.cluster WHERE place = n // 2 + 1""",
    using=NODES,
)
def tele_quorum_index(spark, sf_dir):
    """Terms change every hundred entries; every second cluster's leader is still in the term before the last."""
    own = nodes(spark, sf_dir)
    term = lambda c: F.floor(c / 100) + 1
    each = own.groupBy("cluster", "node").agg(F.max("event_id").alias("match_index")).withColumn("match_term", term(F.col("match_index")))
    last = own.groupBy("cluster").agg((F.max(term(F.col("event_id"))) - F.first(F.col("cluster") % 2)).alias("current"))
    plain = stats.quorum_index(each, ["cluster"]).withColumnRenamed("commit_index", "any_term")
    return plain.join(stats.quorum_index(each.join(last, "cluster"), ["cluster"], term="match_term", current="current"), "cluster")


@query(
    "tele_store_errors",
    """SELECT count(CASE WHEN net IS NULL AND http_status = 503 AND seq % 40 = 0 THEN 1 END) AS not_leader,
    count(CASE WHEN net IS NULL AND http_status = 500 AND seq % 60 = 1 THEN 1 END) AS request_timeout,
    count(CASE WHEN net IS NULL AND http_status = 500 AND seq % 60 = 21 THEN 1 END) AS leadership_changed FROM req""",
    using=REQUESTS,
)
def tele_store_errors(spark, sf_dir):
    return stats.store_errors(requests.from_events(spark, sf_dir), "body")


# experiments, workloads, formatting


@query(
    "exp_matrix",
    """SELECT mode, w.workload, concurrency, seed, w.write_ratio, w.delete_ratio, w.prefill
    FROM (VALUES ('on'), ('off')) m(mode) CROSS JOIN (VALUES ('write_100', 1.0::DOUBLE, 0.0::DOUBLE, false), ('mixed_50_50', 0.5, 0.0, true), ('delete_mixed', 0.4, 0.2, true)) w(workload, write_ratio, delete_ratio, prefill)
    CROSS JOIN (VALUES (CAST(10 AS BIGINT)), (30)) c(concurrency) CROSS JOIN (VALUES (CAST(1 AS BIGINT)), (2), (3)) s(seed)""",
    using="",
)
def exp_matrix(spark, sf_dir):
    cases = stats.matrix(spark, mode=["on", "off"], workload=["write_100", "mixed_50_50", "delete_mixed"], concurrency=[10, 30], seed=[1, 2, 3])
    return workload.with_ratios(cases.withColumns({"concurrency": F.col("concurrency").cast("long"), "seed": F.col("seed").cast("long")}))


@query(
    "exp_group_summary",
    """SELECT event_type AS scenario, count(*) AS runs, count(CASE WHEN value >= 1 THEN 1 END) AS passed, round(CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(*), 6) AS avg_ms, min(value) AS min_ms, max(value) AS max_ms, bool_and(value >= 1) AS all_passed
    FROM events GROUP BY event_type""",
    using="",
)
def exp_group_summary(spark, sf_dir):
    runs = changelog.table(spark, sf_dir, "events").select(F.col("event_type").alias("scenario"), F.col("value").alias("ms"), (F.col("value") >= 1).alias("pass"))
    return stats.experiment_summary(runs).withColumn("avg_ms", F.round("avg_ms", 6))


@query(
    "gen_key_value",
    "SELECT 'match_key_' || lpad(CAST(i AS VARCHAR), 6, '0') AS key, rpad('match_value_' || lpad(CAST(i AS VARCHAR), 6, '0') || '_', 24, 'x') AS value FROM (SELECT unnest(range(0, 1000)) AS i)",
    using="",
)
def gen_key_value(spark, sf_dir):
    return spark.range(1000).select(E.match_key(F.col("id")).alias("key"), E.match_value(F.col("id"), 24).alias("value"))


@query("gen_prefill", "SELECT 'key_' || CAST(i AS VARCHAR) AS key, repeat('v', 8) AS value FROM (SELECT unnest(range(0, 500)) AS i)", using="")
def gen_prefill(spark, sf_dir):
    return workload.prefill(spark, 500, 8)


@query(
    "fmt_bytes",
    """, d AS (SELECT size, CASE WHEN size >= 1073741824 THEN 3 WHEN size >= 1048576 THEN 2 WHEN size >= 1024 THEN 1 ELSE 0 END AS e,
                      CASE WHEN size >= 1073741824 THEN 1073741824 WHEN size >= 1048576 THEN 1048576 ELSE 1024 END AS div FROM sizes),
    t AS (SELECT *, size * 10 // div + CASE WHEN (size * 10 % div) * 2 > div OR ((size * 10 % div) * 2 = div AND (size * 10 // div) % 2 = 1) THEN 1 ELSE 0 END AS tenths FROM d)
    SELECT size, CASE WHEN e = 0 THEN CAST(size AS VARCHAR) || ' B'
      ELSE CAST(tenths // 10 AS VARCHAR) || '.' || CAST(tenths % 10 AS VARCHAR) || ' ' || substr('KMG', e, 1) || 'iB (' || CAST(size AS VARCHAR) || ' B)' END AS shown FROM t""",
    using="sizes AS (SELECT DISTINCT (event_id * event_id * 37) % 5000000000 AS size FROM events)",
)
def fmt_bytes(spark, sf_dir):
    sizes = changelog.table(spark, sf_dir, "events").select(((F.col("event_id") * F.col("event_id") * 37) % 5000000000).alias("size")).distinct()
    return sizes.select("size", E.human_bytes(F.col("size")).alias("shown"))


@query("topk_hot_keys", "SELECT key, count(*) AS n FROM ops GROUP BY key ORDER BY n DESC, key LIMIT 20")
def topk_hot_keys(spark, sf_dir):
    return stats.hottest(log(spark, sf_dir), 20)


@query("verify_keys", "SELECT count(*) AS checked, count(*) AS verified FROM latest")
def verify_keys(spark, sf_dir):
    own = log(spark, sf_dir)
    wanted = state.latest(own).select("key", F.when(state.live(), F.col("value")).alias("expected"))
    return stats.verify_keys(wanted, segments.recover(own, SEGMENT, cut=3000))


# streaming


@query("stream_final_state", "SELECT key, value, seq FROM latest WHERE op = 'PUT'")
def stream_final_state(spark, sf_dir):
    return streaming.replay_final_state(spark, sf_dir)


@query("stream_foreach_segments", "SELECT key, value FROM latest WHERE op = 'PUT'")
def stream_foreach_segments(spark, sf_dir):
    return streaming.replay_segments(spark, sf_dir)


# binary files


@query("src_wal_roundtrip", "SELECT key, value FROM latest WHERE op = 'PUT'")
def src_wal_roundtrip(spark, sf_dir):
    path = streaming.shared_folder(spark, "log-files")
    binary.write_log(log(spark, sf_dir), path)
    return state.final_state(binary.as_log(binary.read_log(spark, path, strict=True))).drop("seq")


@query("src_sst_roundtrip", "SELECT key, CASE WHEN op = 'PUT' THEN value END AS value FROM latest")
def src_sst_roundtrip(spark, sf_dir):
    path = streaming.shared_folder(spark, "segment-files")
    binary.write_segments(state.latest(log(spark, sf_dir)).select("key", F.when(state.live(), F.col("value")).alias("value")), path)
    return binary.read_segments(spark, path).select(F.col("key").cast("string"), F.col("value").cast("string"))


@query(
    "sst_point_get",
    """, wanted AS (SELECT 'user_' || CAST(n AS VARCHAR) AS key FROM (SELECT unnest([3, 42, 77, 100000]) AS n))
    SELECT key, value, true AS found FROM (SELECT key, CASE WHEN op = 'PUT' THEN value END AS value FROM latest) WHERE key IN (SELECT key FROM wanted)""",
)
def sst_point_get(spark, sf_dir):
    """Point reads of segment files: only files whose range holds a key are opened, and one block of each."""
    path = streaming.shared_folder(spark, "segment-files")
    binary.write_segments(state.latest(log(spark, sf_dir)).select("key", F.when(state.live(), F.col("value")).alias("value")), path, files=8)
    found = binary.find(spark, path, ["user_3", "user_42", "user_77", "user_100000"])
    return found.select(F.col("key").cast("string"), F.col("value").cast("string"), F.lit(True).alias("found"))


@query(
    "sst_catalog",
    """, e AS (SELECT key, CASE WHEN op = 'PUT' THEN value END AS value FROM latest)
    SELECT min(key) AS first, max(key) AS last, CAST(sum(8 + strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS record_bytes FROM e""",
)
def sst_catalog(spark, sf_dir):
    """Ranges of segment files from their footers, and the bytes of their records: a file without footer and index."""
    path = streaming.shared_folder(spark, "segment-files")
    binary.write_segments(state.latest(log(spark, sf_dir)).select("key", F.when(state.live(), F.col("value")).alias("value")), path, files=1)
    known = binary.segment_catalog(spark, path)
    rows = binary.read_segments(spark, path)
    bytes_ = rows.agg(F.sum(8 + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).alias("record_bytes"))
    return known.agg(F.min("min_key").cast("string").alias("first"), F.max("max_key").cast("string").alias("last")).join(F.broadcast(bytes_))


@query("wal_purge", "SELECT count(*) AS records, CAST(0 AS BIGINT) AS logs_left, CAST(1 AS BIGINT) AS next_id FROM writes")
def wal_purge(spark, sf_dir):
    """Logs are written, replayed and removed once their records are in segments."""
    path = streaming.shared_folder(spark, "log-files")
    binary.write_log(log(spark, sf_dir), path, files=3)
    n = binary.read_log(spark, path, strict=True).count()
    binary.remove_files(spark, path, r"\d+wal\.log")
    return spark.createDataFrame([(n, sum(x.endswith(".log") for x in binary.names(spark, path)), binary.next_file_id(spark, path))], "records long, logs_left long, next_id long")


@query("stream_restart", "SELECT key, value, seq FROM latest WHERE op = 'PUT'")
def stream_restart(spark, sf_dir):
    """The stream stops after half of the events and goes on from its checkpoint, with some delivered twice."""
    return streaming.replay_with_restart(spark, sf_dir)


@query(
    "stream_sink_catalog",
    """, last AS (SELECT * FROM latest WHERE op = 'PUT') SELECT count(*) AS n_keys, CAST(1 AS BIGINT) AS unlisted_never, true AS below_threshold FROM last""",
)
def stream_sink_catalog(spark, sf_dir):
    """Flushes by size, merges of the oldest four, and nothing left that the manifest doesn't list."""
    sink = streaming.replay_flushes(spark, sf_dir, flush_bytes=1 << 14)
    listed = sink.manifest(spark)
    left = set(x for x in binary.names(spark, sink.folder) if x != "manifest" and not x.startswith(".")) - set(listed)
    return segments.visible(sink.read(spark)).agg(F.count("*").alias("n_keys")).select("n_keys", F.lit(1 - len(left)).cast("long").alias("unlisted_never"), F.lit(len(listed) < sink.threshold).alias("below_threshold"))


# reports: written and read again

REPORT = "operation string, total long, succeeded long, failed long, found long, not_found long, success_rate double, success_qps double, max_ns long"
REPORT_SQL = """, g AS (SELECT operation, count(*) AS total, count(CASE WHEN success THEN 1 END) AS succeeded, max(latency_ns) AS max_ns FROM req GROUP BY operation),
    r AS (SELECT * FROM g UNION ALL SELECT 'all', CAST(sum(total) AS BIGINT), CAST(sum(succeeded) AS BIGINT), max(max_ns) FROM g)"""


def _report(spark, sf_dir):
    return stats.report(requests.from_events(spark, sf_dir), 3600.0)


@query("report_json", REPORT_SQL + " SELECT operation, total, succeeded, max_ns FROM r", using=REQUESTS)
def report_json(spark, sf_dir):
    path = streaming.shared_folder(spark, "report")
    report.to_json(_report(spark, sf_dir).repartition("operation"), path)
    return spark.read.schema(REPORT).json(path).select("operation", "total", "succeeded", "max_ns")


@query("report_csv", REPORT_SQL + " SELECT operation, total, succeeded, max_ns FROM r", using=REQUESTS)
def report_csv(spark, sf_dir):
    path = streaming.shared_folder(spark, "report")
    report.to_csv(_report(spark, sf_dir), path)
    return files.read_csv(spark, path, REPORT).select("operation", "total", "succeeded", "max_ns")


@query("report_tsv", REPORT_SQL + " SELECT operation, total, succeeded, max_ns FROM r", using=REQUESTS)
def report_tsv(spark, sf_dir):
    path = streaming.shared_folder(spark, "report")
    report.to_tsv(_report(spark, sf_dir), path)
    return files.read_csv(spark, path, REPORT, sep="\t").select("operation", "total", "succeeded", "max_ns")


@query("report_markdown", REPORT_SQL + " SELECT '| ' || operation || ' | ' || total || ' | ' || printf('%.4f', succeeded / total) || ' |' AS value FROM r", using=REQUESTS)
def report_markdown(spark, sf_dir):
    return report.markdown_lines(_report(spark, sf_dir).select("operation", "total", "success_rate"))


@query(
    "report_console",
    REPORT_SQL + """, l AS (SELECT operation, 'total' AS name, CAST(total AS VARCHAR) AS t FROM r UNION ALL SELECT operation, 'max_ns', CAST(max_ns AS VARCHAR) FROM r)
    SELECT rpad(operation, 10, ' ') || rpad(name, 16, ' ') || lpad(t, 20, ' ') AS value FROM l""",
    using=REQUESTS,
)
def report_console(spark, sf_dir):
    return report.console_lines(_report(spark, sf_dir).select("operation", "total", "max_ns"))


@query(
    "report_rows",
    """, k AS (SELECT operation, count(*) AS total FROM req GROUP BY operation)
    SELECT operation, total, CASE WHEN operation = 'get' THEN (SELECT count(*) FROM req WHERE operation = 'get' AND net IS NULL AND http_status = 200) END AS found FROM k""",
    using=REQUESTS,
)
def report_rows(spark, sf_dir):
    """One-row reports of runs as one table; a run without reads has no such figure."""
    own = requests.from_events(spark, sf_dir)
    rows = [stats.report(own.where(F.col("operation") == op), 1.0).where("operation <> 'all'") for op in ("get", "put", "delete")]
    return report.append_rows(rows[0].select("operation", "total", "found"), *[r.select("operation", "total") for r in rows[1:]])


@query(
    "csv_lines",
    """SELECT event_id || ',' || CASE WHEN event_id % 3 = 0 THEN '"a ""quoted"", text"' WHEN event_id % 3 = 1 THEN 'plain' ELSE '' END || ',' || printf('%.4f', value) AS value FROM events""",
    using="",
)
def csv_lines(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, 'a "quoted", text').when(F.col("event_id") % 3 == 1, "plain")
    return report.csv_lines(changelog.table(spark, sf_dir, "events").select("event_id", text.alias("text"), "value"))


@query(
    "log_fields",
    """SELECT CAST(user_id AS VARCHAR) AS "user", event_type AS kind, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) END AS id FROM events WHERE event_id % 5 <> 0""",
    using="",
)
def log_fields(spark, sf_dir):
    """Prefixed lines of a log file, among others, as columns."""
    path = streaming.shared_folder(spark, "lines")
    e = changelog.table(spark, sf_dir, "events")
    line = F.concat(F.lit("12:00 RESULT|user="), "user_id", F.lit("|kind="), "event_type", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("|id="), "event_id")).otherwise(""))
    e.select(F.when(F.col("event_id") % 5 == 0, "other line").otherwise(line).alias("value")).write.text(path)
    return files.fields(spark.read.text(path), "RESULT", ["user", "kind", "id"])


@query("log_word_count", "SELECT CAST(sum(CASE WHEN event_id % 4 = 0 THEN 2 WHEN event_id % 4 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM events", using="")
def log_word_count(spark, sf_dir):
    path = streaming.shared_folder(spark, "lines")
    kind = F.col("event_id") % 4
    lines = F.when(kind == 0, "Compaction begins: compaction of 4").when(kind == 1, "COMPACTION ended").otherwise("put")
    changelog.table(spark, sf_dir, "events").select(lines.alias("value")).write.text(path)
    return files.count_in_log(spark, path)


@query(
    "file_figures",
    """, n AS (SELECT 'node_' || CAST(user_id % 3 AS VARCHAR) AS node, CAST(sum(strlen(event_type) + 1) AS BIGINT) AS bytes FROM events GROUP BY 1)
    SELECT node, CAST(1 AS BIGINT) AS files, bytes FROM n UNION ALL SELECT NULL, count(*), CAST(sum(bytes) AS BIGINT) FROM n""",
    using="x AS (SELECT 1)",
)
def file_figures(spark, sf_dir):
    """Files of each node by suffix, and of all nodes."""
    path = streaming.shared_folder(spark, "files")
    rows = changelog.table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("n"), F.col("event_type").alias("value"))
    for i in range(3):
        rows.where(F.col("n") == i).select("value").coalesce(1).write.text(f"{path}/node_{i}")
    return files.file_stats(spark, path, "*.txt")


@query(
    "metrics_snapshots",
    """, m AS (SELECT user_id % 5 AS node, event_id < 5000 AS early, count(*) AS gets FROM events GROUP BY 1, 2)
    SELECT a.node, CAST(greatest(b.gets * 2 - a.gets, 0) AS BIGINT) AS get_total_delta FROM m a JOIN m b ON a.node = b.node WHERE a.early AND NOT b.early""",
    using="x AS (SELECT 1)",
)
def metrics_snapshots(spark, sf_dir):
    """Two metrics documents written as JSON and read again; what each node's counters gained."""
    e = changelog.table(spark, sf_dir, "events")
    each = e.groupBy((F.col("event_id") < 5000).alias("early"), (F.col("user_id") % 5).alias("node")).agg(F.count("*").alias("gets"))
    node = F.struct(F.col("node").alias("node_id"), F.struct(F.when(F.col("early"), F.col("gets")).otherwise(F.col("gets") * 2).alias("get_total")).alias("lsm"))
    docs = each.groupBy("early").agg(F.collect_list(node).alias("nodes")).select(F.when(F.col("early"), "2026-01-01T00:00:00Z").otherwise("2026-01-01T01:00:00Z").alias("timestamp"), "nodes")
    path = streaming.shared_folder(spark, "metrics")
    docs.repartition("timestamp").write.json(path)
    rows = files.node_metrics(spark.read.schema(files.METRICS).json(path)).select("ts", "node", "get_total")
    first = F.col("ts") == F.to_timestamp(F.lit("2026-01-01T00:00:00Z"))
    return stats.before_after(rows.where(first), rows.where(~first), ["node"], ["get_total"])


@query("req_slow", "SELECT seq, latency_ns / 1e6 AS ms FROM req WHERE latency_ns > 50000000", using=REQUESTS)
def req_slow(spark, sf_dir):
    return stats.slower_than(requests.from_events(spark, sf_dir), 50_000_000).select("seq", E.ms(F.col("latency_ns")).alias("ms"))


@query(
    "fmt_text",
    """SELECT event_id, 'a%20' || CAST(event_id AS VARCHAR) || '%2F%3F' AS path, CASE WHEN event_id % 2 = 0 THEN 'x\\|y<br>z' ELSE 'plain' END AS cell,
    CASE event_id % 3 WHEN 0 THEN 'raft' WHEN 1 THEN 'local' ELSE 'unknown' END AS read_mode FROM events""",
    using="",
)
def fmt_text(spark, sf_dir):
    i = F.col("event_id")
    e = changelog.table(spark, sf_dir, "events")
    cell = F.when(i % 2 == 0, "x|y\r\nz").otherwise("plain")
    mode = E.first_text(F.when(i % 3 == 0, "raft").otherwise(""), F.when(i % 3 == 1, "local"))
    return e.select("event_id", E.path_escape(F.concat(F.lit("a "), i.cast("string"), F.lit("/?"))).alias("path"), E.markdown_escape(cell).alias("cell"), mode.alias("read_mode"))


@query(
    "fmt_duration",
    """SELECT ns, CASE WHEN ns = 0 THEN '0s' WHEN ns < 1000 THEN ns || 'ns' WHEN ns < 1000000 THEN num3 || 'µs' WHEN ns < 1000000000 THEN num6 || 'ms' ELSE
      CASE WHEN ns >= 3600000000000 THEN (ns // 3600000000000) || 'h' ELSE '' END || CASE WHEN ns >= 60000000000 THEN (ns // 60000000000 % 60) || 'm' ELSE '' END || num9 || 's' END AS shown
    FROM (SELECT ns, regexp_replace((ns // 1000) || '.' || lpad(CAST(ns % 1000 AS VARCHAR), 3, '0'), '\\.?0+$', '') AS num3,
                 regexp_replace((ns // 1000000) || '.' || lpad(CAST(ns % 1000000 AS VARCHAR), 6, '0'), '\\.?0+$', '') AS num6,
                 regexp_replace((ns % 60000000000 // 1000000000) || '.' || lpad(CAST(ns % 1000000000 AS VARCHAR), 9, '0'), '\\.?0+$', '') AS num9 FROM d)""",
    using="d AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN event_id * 1237 WHEN 2 THEN event_id * 98765 ELSE event_id * 1234567000 END AS ns FROM events)",
)
def fmt_duration(spark, sf_dir):
    i = F.col("event_id")
    ns = F.when(i % 4 == 0, i).when(i % 4 == 1, i * 1237).when(i % 4 == 2, i * 98765).otherwise(i * 1234567000)
    return changelog.table(spark, sf_dir, "events").select(ns.alias("ns")).select("ns", E.duration_text(F.col("ns")).alias("shown"))


@query(
    "exp_old_reports",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'write_only' WHEN 1 THEN 'read_only' WHEN 2 THEN 'read_write_50_50' ELSE 'custom' END AS workload,
    CASE WHEN event_id % 2 = 0 THEN value + 1 ELSE event_id / 4.0::DOUBLE END AS get_qps FROM events""",
    using="",
)
def exp_old_reports(spark, sf_dir):
    """Old reports lack names and rates: both follow from what they have."""
    i = F.col("event_id")
    e = changelog.table(spark, sf_dir, "events")
    ratio = F.when(i % 4 == 0, 1.0).when(i % 4 == 1, 0.0).when(i % 4 == 2, 0.5 + 1e-9).otherwise(0.3)
    qps = E.get_qps(F.when(i % 2 == 0, F.col("value") + 1).otherwise(0.0), i, F.lit(4.0))
    return e.select("event_id", E.workload_name(ratio, i % 4 != 0).alias("workload"), qps.alias("get_qps"))


@query("gen_tasks", "SELECT CAST(5000 AS BIGINT) AS n, CAST(5000 AS BIGINT) AS valid, true AS mixed, CAST(40 AS BIGINT) AS n_keys", using="")
def gen_tasks(spark, sf_dir):
    """A drawn workload: only what every seed must give."""
    rows = workload.tasks(spark, 5000, 0.4, 0.2, 40, 8, seed=1)
    valid = F.col("operation").isin("put", "get", "delete") & F.col("key").rlike(r"^key_\d+$") & (F.col("value") == "v" * 8)
    share = lambda op: F.count_if(F.col("operation") == op) / F.count("*")
    mixed = (F.abs(share("put") - 0.4) < 0.05) & (F.abs(share("delete") - 0.2) < 0.05)
    return rows.agg(F.count("*").alias("n"), F.count_if(valid).alias("valid"), mixed.alias("mixed"), F.countDistinct("key").alias("n_keys"))


@query("stream_wal_replay", "SELECT key, value FROM latest WHERE op = 'PUT'")
def stream_wal_replay(spark, sf_dir):
    """Log files as a stream of records, applied until they end."""
    return streaming.replay_log_files(spark, sf_dir)


@query(
    "store_reads",
    """, w1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM writes) WHERE rn = 1),
    wanted AS (SELECT 'user_' || CAST(n AS VARCHAR) AS key FROM (SELECT unnest(range(0, 300)) AS n)),
    after AS (SELECT key, CASE WHEN key = 'user_3' THEN NULL WHEN key = 'user_7' THEN 'new' WHEN op = 'PUT' THEN value END AS value,
                     CASE WHEN key = 'user_3' THEN false WHEN key = 'user_7' THEN true ELSE op = 'PUT' END AS found FROM w1)
    SELECT w.key, a.value, coalesce(a.found, w.key = 'user_7') AS found FROM wanted w LEFT JOIN after a ON w.key = a.key""",
)
def store_reads(spark, sf_dir):
    """The program's interface: the log in three batches, a delete and a put, then reads."""
    from tidelog.store import Store

    own = Store(spark, f"{streaming.shared_folder(spark, 'store')}/segments")
    rows = state.writes(log(spark, sf_dir)).select("seq", "op", "key", "value")
    for low, high in ((0, 3000), (3000, 6000), (6000, 1 << 60)):
        own.apply(rows.where((F.col("seq") > low) & (F.col("seq") <= high)))
    own.delete("user_3")
    own.put("user_7", "new")
    return own.get_many(spark.range(300).select(F.concat(F.lit("user_"), F.col("id").cast("string")).alias("key")))
