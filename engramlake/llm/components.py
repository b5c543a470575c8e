"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a shuffle by node with map-side minima; no component is ever gathered in a task.
A hub's edges are joined to its one-row minimum, which adaptive execution splits where skewed.
A graph of at most `FEW` edges, counted before each step, is one partition instead: its steps are windows without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engramlake.llm.common import observed

#: Edges (of two short keys each) up to which a graph is handled as one partition.
FEW = 50_000


def _pairs(edges: DataFrame, *pairs: tuple[Column, Column]) -> DataFrame:
    each = F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in pairs])
    return edges.select(F.inline(each))


def _few_star(edges: DataFrame, small: bool) -> DataFrame:
    """As `_star`, for edges of one partition."""
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    both = _pairs(edges, (a, b), (b, a))
    both = both.filter(b < a) if small else both
    met = both.withColumn("m", F.least(a, F.min("b").over(W.partitionBy("a"))))
    out = _pairs(met, (b, m), (a, m)) if small else met.filter(b > a).select(b.alias("a"), m.alias("b"))
    return out.filter("a <> b").distinct()


def _star(edges: DataFrame, small: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if small:
        both = both.filter("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = both.join(least, "a")
    if small:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    else:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def _settled(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, with their number and a sum of their hashes."""
    return observed(edges, "cc", F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the edges (columns a, b of one ordered type); the root is the least node.

    The steps converge in about the logarithm of the longest path; if `rounds` of them do not, that is an error.
    """
    now, state = _settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    for _ in range(rounds if state[0] else 0):
        last = state
        if state[0] <= FEW:
            now = now.coalesce(1)
            for _ in range(2):
                now = _few_star(_few_star(now, False), True)
            now, state = _settled(now)
        else:
            now, state = _settled(_star(_star(now, False), True))
        if state == last:
            break
    else:
        if state[0]:
            raise RuntimeError(f"connected components did not converge in {rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
