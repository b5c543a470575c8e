"""Graph operators over an edge table (src, dst, link_type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engramlake.operators.steps import settled

#: Nodes of a frontier (a slug each) up to which it is broadcast to the edges.
MOST_FRONTIER = 100_000


def out_links(edges: DataFrame, slug: str) -> DataFrame:
    return edges.filter(F.col("src") == slug)


def in_links(edges: DataFrame, slug: str) -> DataFrame:
    return edges.filter(F.col("dst") == slug)


def backlinks(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("slug")).agg(F.count(F.lit(1)).alias("backlinks"))


def traverse(edges: DataFrame, start: str, depth: int = 5, direction: str = "out") -> DataFrame:
    """(slug, depth) of all nodes within `depth` (at most 10) of a node: frontier joins, each node at its first depth."""
    spark = edges.sparkSession
    ahead = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"))
    steps = {"out": ahead, "in": back, "both": ahead.unionByName(back)}[direction]
    seen = spark.createDataFrame([(start, 0)], "slug string, depth int")
    front, n = seen, 1
    for d in range(1, min(depth, 10) + 1):
        few = F.broadcast(front) if n <= MOST_FRONTIER else front
        met = steps.join(few.select(F.col("slug").alias("at")), "at").select(F.col("to").alias("slug")).distinct()
        front = settled(met.join(seen.select("slug"), "slug", "left_anti").select("slug", F.lit(d).alias("depth")))
        if not (n := front.count()):
            break
        seen = seen.unionByName(front)
    return seen


def subtree(edges: DataFrame, root: str, link_type: str, depth: int = 5) -> DataFrame:
    """Nodes that reach the root by links of a type, without the root."""
    return traverse(edges.filter(F.col("link_type") == link_type), root, depth, "in").filter(F.col("depth") > 0)


def endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with the titles of both ends (nodes: slug, title)."""
    a = nodes.select(F.col("slug").alias("src"), F.col("title").alias("src_title"))
    b = nodes.select(F.col("slug").alias("dst"), F.col("title").alias("dst_title"))
    return edges.join(a, "src").join(b, "dst")


def bundles(pages: DataFrame, edges: DataFrame, timeline: DataFrame, limit: int = 20) -> DataFrame:
    """Of each page (slug) its links, its first backlinks and its newest timeline entries, each a list in one text; at most `limit` of the latter two.

    The heads are cut by rank before any list is made, so a page that everything links to makes a short one.
    """
    out = edges.groupBy(F.col("src").alias("slug")).agg(F.array_sort(F.collect_list(F.struct("dst", "link_type"))).alias("l"))
    out = out.select("slug", F.array_join(F.transform("l", lambda x: F.concat_ws(" ", x["dst"], x["link_type"])), ",").alias("links"))
    back = edges.select(F.col("dst").alias("slug"), "src").withColumn("n", F.row_number().over(W.partitionBy("slug").orderBy("src"))).filter(F.col("n") <= limit)
    back = back.groupBy("slug").agg(F.array_join(F.array_sort(F.collect_list("src")), ",").alias("backlinks"))
    last = timeline.withColumn("n", F.row_number().over(W.partitionBy("slug").orderBy(F.desc("date"), "entry_id"))).filter(F.col("n") <= limit)
    rows = F.array_sort(F.collect_list(F.struct("n", F.concat_ws(" ", "date", "summary").alias("e"))))
    last = last.groupBy("slug").agg(F.array_join(rows["e"], ",").alias("timeline"))
    x = pages.select("slug").join(out, "slug", "left").join(back, "slug", "left").join(last, "slug", "left")
    return x.fillna("", ["links", "backlinks", "timeline"])
