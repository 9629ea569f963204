"""The state of every key, derived from the log: the highest seq wins, a tombstone hides the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Seqs that share a task where a key's commands must stand in order.
SPAN = 1 << 20


def writes(log: DataFrame) -> DataFrame:
    return log.where(F.col("op") != "GET")


def latest(log: DataFrame, *carry: str, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """The last write of each key with its op; tombstones are still there.

    One shuffle with a map-side combine. max_by keeps a null value, which last(ignorenulls) would not.
    """
    fields = ["op", "value", *carry]
    newest = F.max_by(F.struct("seq", *fields), "seq").alias("w")
    return writes(log).groupBy(*by).agg(newest).select(*by, "w.seq", *[f"w.{c}" for c in fields])


def live(op: Column | None = None) -> Column:
    """Tombstones are filtered after the latest write is chosen, never before."""
    return (F.col("op") if op is None else op) == "PUT"


def final_state(log: DataFrame) -> DataFrame:
    return latest(log).where(live()).select("key", "value", "seq")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The state after the command seq."""
    return final_state(log.where(F.col("seq") <= seq))


def get(log: DataFrame, key: str) -> DataFrame:
    """A point read: no row if the key was never written or is deleted. The key filter reaches the scan."""
    return final_state(log.where(F.col("key") == key))


def get_many(log: DataFrame, keys: DataFrame) -> DataFrame:
    """key, value, found for every wanted key. Only wanted keys are reduced."""
    wanted = keys.select("key").distinct()
    state = final_state(log.join(wanted, "key", "left_semi"))
    return wanted.join(state, "key", "left").select("key", "value", F.col("seq").isNotNull().alias("found"))


def read(log: DataFrame, keys: DataFrame, read_mode: str = "raft", snapshot: DataFrame | None = None) -> DataFrame:
    """raft reads through the log; local reads a committed snapshot (key, value, seq), which may be behind."""
    if read_mode == "raft":
        return get_many(log, keys)
    if read_mode == "local":
        if snapshot is None:
            raise ValueError("a local read needs a snapshot")
        wanted = keys.select("key").distinct()
        return wanted.join(snapshot, "key", "left").select("key", "value", F.col("seq").isNotNull().alias("found"))
    raise ValueError(f"read_mode must be raft or local, not {read_mode!r}")


def linear_reads(log: DataFrame, span: int = SPAN) -> DataFrame:
    """What every GET of the log sees: the last write of its key with a smaller seq.

    A key's commands are taken in spans of seq, so a hot key is spread over tasks; each span knows the last write before it.
    """
    own = log.withColumn("span", F.floor(F.col("seq") / span))
    write = F.when(F.col("op") != "GET", F.struct("seq", "op", "value"))
    inside = Window.partitionBy("key", "span").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # a row for each span
    before = own.groupBy("key", "span").agg(F.max(write).alias("e")).select("key", "span", F.last("e", ignorenulls=True).over(upto).alias("before"))
    seen = own.withColumn("w", F.last(write, ignorenulls=True).over(inside)).where(F.col("op") == "GET")
    seen = seen.join(before, ["key", "span"]).withColumn("w", F.coalesce("w", "before"))
    found = F.coalesce(live(F.col("w.op")), F.lit(False))
    return seen.select("seq", "key", F.when(found, F.col("w.value")).alias("value"), found.alias("found"))


def tombstones(log: DataFrame) -> DataFrame:
    return latest(log).where(F.col("op") == "DELETE").select("key", "seq")


def history(log: DataFrame, span: int = SPAN) -> DataFrame:
    """Every version of every key with the seqs from and to which it held (to is null while it holds), by spans like linear_reads."""
    own = writes(log).withColumn("span", F.floor(F.col("seq") / span))
    inside, across = Window.partitionBy("key", "span").orderBy("seq"), Window.partitionBy("key").orderBy("span")
    ends = own.groupBy("key", "span").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    ends = ends.select("key", "span", F.lead("first").over(across).alias("next"), (F.sum("n").over(across) - F.col("n")).alias("before"))
    each = own.withColumns({"to": F.lead("seq").over(inside), "place": F.row_number().over(inside)}).join(ends, ["key", "span"])
    return each.select("key", "op", "value", F.col("seq").alias("from_seq"), F.coalesce("to", "next").alias("to_seq"), (F.col("before") + F.col("place")).alias("version"))


def live_by_bucket(log: DataFrame, size: int) -> DataFrame:
    """Keys written in each range of seqs, and how many of them its last write leaves alive."""
    bucket = F.floor((F.col("seq") - 1) / size)
    last = latest(log.withColumn("bucket", bucket), by=("bucket", "key"))
    return last.groupBy("bucket").agg(F.count("*").alias("n_keys"), F.count_if(live()).alias("n_live"))


def resolve_terms(log: DataFrame, span: int = SPAN) -> DataFrame:
    """The log that is left of diverging copies: of each seq the entry with the highest term, cut off behind conflicts.

    An entry with a lower term than one before it stood in a copy that was cut there, so it is gone. The highest term
    before an entry comes from spans of seq, like in linear_reads: a row for each span meets in one task.
    """
    fields = [c for c in log.columns if c not in ("seq", "term")]
    best = log.groupBy("seq").agg(F.max_by(F.struct("term", *fields), "term").alias("e"))
    best = best.select("seq", F.col("e.term").alias("term"), "e", F.floor(F.col("seq") / span).alias("span"))
    upto = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    before = best.groupBy("span").agg(F.max("term").alias("top")).select("span", F.max("top").over(upto).alias("before"))
    inside = F.max("term").over(Window.partitionBy("span").orderBy("seq"))
    kept = best.withColumn("inside", inside).join(before, "span").where(F.col("term") >= F.greatest("inside", F.coalesce("before", "inside")))
    return kept.select("seq", "term", *[f"e.{c}" for c in fields])


def up_to_date(last_term: Column, last_seq: Column, own_term: Column, own_seq: Column) -> Column:
    """Whether a log that ends with (last_term, last_seq) is at least as new as the own one: terms first, then length."""
    return F.struct(last_term.alias("t"), last_seq.alias("s")) >= F.struct(own_term.alias("t"), own_seq.alias("s"))


def results(commands: DataFrame, applied: DataFrame) -> DataFrame:
    """Commands with what became of them at their seq: applied, or taken by another op (leadership changed)."""
    got = applied.select("seq", F.col("op_id").alias("applied_id"))
    state = F.when(F.col("applied_id").isNull(), "request timeout").when(F.col("applied_id") != F.col("op_id"), "leadership changed before commit").otherwise("ok")
    return commands.join(got, "seq", "left").select(*commands.columns, state.alias("result"))
