"""Connected components over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import shared


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20))).alias("s")).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is tied to the smallest vertex around it.

    Edges go from u to a smaller v, so only where u is the vertex can its smallest neighbour be smaller than itself. A
    vertex with very many neighbours is one of few smaller ones, v, where only its own smallest neighbour is asked for:
    a join of written tables, whose large partitions Spark splits.
    """
    least = shared.keep(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    own = least.select(F.col("u").alias("v"), "m")
    return edges.join(own, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are tied to the smallest of them. Edges go from u to a smaller v."""
    least = shared.keep(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    down = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each vertex but the smallest of its component, with that smallest one. edges: u, v (long), any direction.

    Large-star and small-star steps, each a few shuffles of edges; each round's edges are written, so a lost executor
    costs no earlier round. Nothing is collected but counts and checksums.
    """
    one_way = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = shared.keep(one_way, "edges")
    last = _state(now)
    while last[0]:
        after = shared.keep(_small_star(_large_star(now)), "edges")
        shared.drop(now.sparkSession, now.inputFiles()[0].rsplit("/", 1)[0])
        now, state = after, _state(after)
        if state == last:
            break
        last = state
    return now
