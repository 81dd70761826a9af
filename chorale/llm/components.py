"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component, the smallest node it reaches, from edges (a, b).

    Alternates two star steps: each node points its larger neighbours, then
    its smaller ones, at its smallest neighbour.  Either keeps the components,
    and the edges end as stars around the smallest node, in a number of rounds
    that grows with the logarithm of the longest path.  Each round is written
    to the checkpoint folder, so lost executors cost no more than a round.
    Nulls and loops are dropped; nodes without an edge are not returned.

    The centre of a star is a hot key of the edges.  What joins them by that
    key has one row per node and is dealt by two columns first, so that both
    sides of the join are plain exchanges, whose skewed parts are split.
    """
    state = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    was = state(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")).repartition("u", "low")
        # large star: (u, v) with v > u becomes (v, low(u))
        large = now.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v").distinct()
        # small star: (u, v) with v < u becomes (v, low) and (u, low)
        down = large.groupBy("u").agg(F.min("v").alias("low")).repartition("u", "low")
        joined = large.join(down, "u")
        small = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v").unionByName(down.select("u", F.col("low").alias("v"))).distinct()
        after = cut(small)
        before, was, now = was, state(after), after
        if was == before:  # the rows are distinct: as many of the same hashes
            break
    else:
        raise RuntimeError("components: no end of the star steps")
    tree = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return tree.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
