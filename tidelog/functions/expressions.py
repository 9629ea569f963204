"""Scalar expressions of the request, telemetry and report operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The error types that a histogram always shows.
ERROR_TYPES = ["timeout", "connection_refused", "http_500", "http_503", "request_timeout", "not_leader", "other"]
#: Write and delete share and prefill of the named workloads.
WORKLOADS = [("write_100", 1.0, 0.0, False), ("mixed_50_50", 0.5, 0.0, True), ("delete_mixed", 0.4, 0.2, True), ("read_100", 0.0, 0.0, True), ("read95_write5", 0.05, 0.0, True)]


def delta(before: Column, after: Column) -> Column:
    """What a counter gained; a counter that fell was reset and gains nothing."""
    return F.greatest(after - before, F.lit(0))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 where there is no whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def ms(ns: Column) -> Column:
    return ns / F.lit(1e6)


def network_error(message: Column) -> Column:
    low = F.lower(message)
    slow = low.contains("client.timeout") | low.contains("deadline exceeded")
    return (
        F.when(slow, "timeout").when(low.contains("connection refused"), "connection_refused").when(low.contains("not leader"), "not_leader").when(low.contains("request timeout"), "request_timeout").when(message.isNotNull(), "other")
    )


def http_failure(status: Column, body: Column) -> Column:
    low = F.lower(F.coalesce(body, F.lit("")))
    return F.when(low.contains("not leader"), "not_leader").when(low.contains("request timeout"), "request_timeout").when(status > 0, F.concat(F.lit("http_"), status.cast("string"))).otherwise("other")


def success(operation: Column, status: Column, error: Column) -> Column:
    """Writes need 200; reads also take 404, which is an answer."""
    return error.isNull() & ((status == 200) | ((operation == "get") & (status == 404)))


def error_type(operation: Column, status: Column, body: Column, error: Column) -> Column:
    """Null for a success."""
    return F.when(error.isNotNull(), network_error(error)).when(~success(operation, status, error), http_failure(status, body))


def json_object(body: Column) -> Column:
    """Whether the text is a JSON object whose value, if it has one, is a text; what else comes can't be read."""
    parsed = F.try_parse_json(body)
    kind = F.schema_of_variant(F.try_variant_get(parsed, "$.value", "variant"))
    return F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT") & (kind.isNull() | kind.isin("STRING", "VOID")), F.lit(False))


def matches(status: Column, body: Column, error: Column, expected: Column) -> dict[str, Column]:
    """Flags of a verified read. The first rule that fits decides; a 500 may set a second flag with it."""
    low, failed = F.lower(F.coalesce(body, F.lit(""))), F.lower(error)
    late = F.coalesce(failed.contains("timeout") | failed.contains("deadline exceeded"), F.lit(False))
    rule = (
        F.when(error.isNotNull() & late, "request_timeout")
        .when(error.isNotNull(), "other_error")
        .when(low.contains("leadership changed before commit"), "leadership_changed")
        .when(low.contains("request timeout"), "request_timeout")
        .when(low.contains("not leader"), "not_leader")
        .when(status == 503, "http_503")
        .when(status == 500, "http_500")
        .when(status != 200, "other_error")
        .when(json_object(body) & (F.coalesce(F.get_json_object(body, "$.value"), F.lit("")) == expected), "success")
        .otherwise("result_mismatch")
    )
    names = ["success", "result_mismatch", "not_leader", "request_timeout", "leadership_changed", "http_500", "http_503", "other_error"]
    flags = {n: rule == n for n in names}
    flags["http_500"] = (rule == "http_500") | (error.isNull() & rule.isin("leadership_changed", "request_timeout") & (status == 500))
    return flags


def workload_name(write_ratio: Column, prefill: Column) -> Column:
    near = lambda x: F.abs(write_ratio - F.lit(x)) < 1e-7
    return F.when(near(1.0) & ~prefill, "write_only").when(near(0.0) & prefill, "read_only").when(near(0.5) & prefill, "read_write_50_50").when(near(0.05) & prefill, "read_heavy_95_5").otherwise("custom")


def match_key(i: Column) -> Column:
    return F.format_string("match_key_%06d", i)


def match_value(i: Column, size: int) -> Column:
    """Padded with x, or cut, to size."""
    return F.rpad(F.format_string("match_value_%06d_", i), size, "x")


def human_bytes(size: Column) -> Column:
    """Bytes below 1024, else tenths of the largest binary unit with the bytes behind; ties go to the even tenth."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    shown = out
    for i, unit in enumerate("KMGTPE"):
        div = 1 << (10 * (i + 1))
        whole, rest = F.floor(size / div).cast("long"), (size % div)
        scaled = rest * 10 if i < 5 else rest.cast("decimal(38,0)") * 10
        tenth, over = F.floor(scaled / div).cast("long"), (scaled % div) * 2
        up = (over > div) | ((over == div) & (tenth % 2 == 1))
        tenths = whole * 10 + tenth + up.cast("long")
        text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}iB ("), out, F.lit(")"))
        shown = F.when(size >= div, text).otherwise(shown)
    return shown


def path_escape(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def markdown_escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\|", r"\\|"), "[\r\n]+", "<br>")


def csv_escape(text: Column) -> Column:
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty, else unknown."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit("unknown"))


def get_qps(reported: Column, successes: Column, seconds: Column) -> Column:
    """Recomputed where an old report has none."""
    return F.when(reported > 0, reported).when(seconds > 0, successes / seconds).otherwise(F.lit(0.0))


def duration_text(ns: Column) -> Column:
    """Such as 1.5s, 250ms, 1h2m3s, from whole nanoseconds."""
    ns = ns.cast("long")
    size = F.abs(ns.cast("decimal(20,0)"))  # the smallest long has no positive one

    def decimal(n: Column, digits: int) -> Column:
        unit = F.lit(10**digits).cast("decimal(20,0)")
        whole = F.floor(n / unit).cast("decimal(20,0)")
        part = F.lpad((n - whole * unit).cast("decimal(20,0)").cast("string"), digits, "0")
        return F.regexp_replace(F.concat(whole.cast("string"), F.lit("."), part), r"\.?0+$", "")

    minutes = F.floor(size / F.lit(60 * 10**9)).cast("decimal(20,0)")
    hours = F.floor(minutes / 60).cast("decimal(20,0)")
    left = lambda n, unit: F.concat((n).cast("decimal(20,0)").cast("string"), F.lit(unit))
    head = F.concat(F.when(hours > 0, left(hours, "h")).otherwise(""), F.when(minutes > 0, left(minutes - hours * 60, "m")).otherwise(""))
    long = F.concat(head, decimal((size - minutes * F.lit(60 * 10**9)).cast("decimal(20,0)"), 9), F.lit("s"))
    shown = F.when(size < 1000, F.concat(size.cast("string"), F.lit("ns"))).when(size < 10**6, F.concat(decimal(size, 3), F.lit("µs"))).when(size < 10**9, F.concat(decimal(size, 6), F.lit("ms"))).otherwise(long)
    return F.when(ns == 0, "0s").otherwise(F.concat(F.when(ns < 0, "-").otherwise(""), shown))
