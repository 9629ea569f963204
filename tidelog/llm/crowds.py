"""Groups too large for one task, whose members are to be linked: what a few pivots link needn't meet again.

Each round takes a member of every group as its pivot, one that no pivot before it is near to, and compares all members
to it. Members that pivots tie together, directly or through others, are the group's main part. It is connected already,
so only the rest has to meet anything: the rest in blocks, each with every block of the whole group. No link is lost, and
a group of copies, all near its pivots, costs as many comparisons as it has members, not as it has pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import shared

#: Pivots of a group.
ROUNDS = 4
#: Up to so many rows, one for each group, are sent to the executors; more are joined by shuffle.
MAX_SENT = 100_000


def sent(few: DataFrame) -> DataFrame:
    """A written table of one row for each group, to be broadcast if it is small."""
    return F.broadcast(few) if few.count() <= MAX_SENT else few


def settle(members: DataFrame, key: list[str], payload: list[str], near: Callable[[DataFrame], DataFrame], size: int, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) that pivots find, and the members that must still meet, as (key, i, j, rep, payload) for each task.

    members: key, rep (long, once in a group), weight (long) and payload. near gets them with a struct column pivot (rep
    and payload) and gives the members' columns with near (boolean) and tied (the pivot's rep). Tasks have a weight of about
    twice size; a member may stand in one twice.
    """
    columns = [*key, "rep", "weight", *payload]
    ties = [f"tied{k}" for k in range(rounds)]
    now = shared.keep(members.select(*columns, *[F.lit(None).cast("long").alias(t) for t in ties]), "crowds")
    for k in range(rounds):
        free = now.where(F.coalesce(*ties).isNull())
        pick = F.min_by(F.struct("rep", *payload), F.struct(F.xxhash64("rep", F.lit(k)), "rep")).alias("pivot")
        pivots = shared.keep(free.groupBy(*key).agg(pick), "pivots")
        if not pivots.limit(1).count():
            break
        met = near(now.join(sent(pivots), key))
        found = met.select(*key, "rep", F.col("tied").alias("_tied")).where(F.col("near"))
        now = shared.keep(now.join(found, [*key, "rep"], "left").select(*columns, *[F.coalesce("_tied", t).alias(t) if t == ties[k] else F.col(t) for t in ties]), "crowds")
    bits = sum((F.when(F.col(t).isNotNull(), F.lit(1 << k)).otherwise(F.lit(0)) for k, t in enumerate(ties)), F.lit(0))
    known = now.withColumn("tied_to", bits)
    own = known.groupBy(*key).agg(*[F.count(t).alias(t) for t in ties], F.collect_set("tied_to").alias("sets"), F.sum("weight").alias("weight"))
    most = F.expr("array_position(array({0}), greatest({0}))".format(", ".join(ties))).cast("int")
    grown = F.aggregate(F.flatten(F.array_repeat("sets", rounds)), F.element_at(F.array(*[F.lit(1 << k) for k in range(rounds)]), most), lambda a, x: F.when(a.bitwiseAND(x) != 0, a.bitwiseOR(x)).otherwise(a))
    main = shared.keep(own.select(*key, grown.alias("main"), F.ceil(F.col("weight") / size).cast("int").alias("blocks")), "main")
    marked = shared.keep(known.join(sent(main), key).withColumn("rest", F.col("tied_to").bitwiseAND(F.col("main")) == 0).drop("tied_to", "main"), "marked")
    left = shared.keep(marked.where("rest").groupBy(*key).agg(F.ceil(F.sum("weight") / size).cast("int").alias("parts")), "rest")
    both = marked.join(sent(left), key)  # a group without a rest is done
    at = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    whole = both.select(*key, each("parts").alias("i"), at("blocks").alias("j"), "rep", *payload)
    rest = both.where("rest").select(*key, at("parts").alias("i"), each("blocks").alias("j"), "rep", *payload)
    edges = marked.select("rep", F.explode(F.array_compact(F.array(*ties))).alias("v")).select(F.col("rep").alias("u"), "v").where("u <> v")
    return edges, whole.unionByName(rest)
