"""Connected components of an edge table, by alternating large-star and small-star rounds.

Nothing of the graph reaches the driver but a row count and a checksum for each round. Every group is
reduced to its minimum before the shuffle, and the joins are on tables just read, so that adaptive
execution can split a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import stash, unstash


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node with a link to another; root is the smallest node reachable, itself left out."""
    s, d = F.col(src), F.col(dst)
    cur = stash(edges.where(s != d).select(F.greatest(s, d).alias("u"), F.least(s, d).alias("v")).distinct(), "edges")
    state = _state(cur)
    while state[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stash(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        after = stash(small, "small-star")
        unstash(large)
        unstash(cur)
        cur, before, state = after, state, _state(after)
        if state == before:
            break
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
