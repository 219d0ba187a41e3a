"""Connected components of a graph in a DataFrame, by alternating large-star and small-star steps.

Every round rewires the edges to smaller neighbours; the number of rounds grows with the logarithm
of the number of nodes.  Minima are combined before the shuffle and the joins are between tables
just read, so that Spark can split a hub's partition.  Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.base import durable, release


EDGES = 100_000  # written by one task


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node and component (the smallest node reachable) for every node of an edge between two nodes."""
    pair = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct()
    pair = durable(pair)
    state = _state(pair)

    def kept(df: DataFrame) -> DataFrame:  # in as few files as there are edges for
        return durable(df.coalesce(1 + state[0] // EDGES))

    while state[0]:
        both = pair.select(F.col("lo").alias("u"), F.least("hi", "lo").alias("v")).unionAll(pair.select("hi", "lo"))
        least_low, old = kept(both.groupBy("u").agg(F.min("v").alias("m"))), pair
        moved = pair.join(least_low, pair["lo"] == least_low["u"]).select("hi", F.col("m").alias("lo"))
        large = kept(moved.filter("hi <> lo").distinct())
        least = kept(large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")))
        moved = large.join(least, large["hi"] == least["u"]).select("hi", "lo", "m")
        tied = moved.select("hi", F.col("m").alias("lo")).unionAll(moved.select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        pair = kept(tied.filter("hi <> lo").distinct())
        release(least_low, large, least, old)
        before, state = state, _state(pair)
        if state == before:
            break
    roots = pair.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    return pair.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(roots).distinct()
