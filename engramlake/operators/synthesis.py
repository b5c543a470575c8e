"""Answers from memory: scopes, citations, keys of cached answers, injected context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.operators.steps import settled

RECALL_LEAST, RECALL_TOP, RECALL_CHARS = 0.5, 3, 3000


def citations(answers: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, answer, cited): marks `[n]` without a reference (refs: id, ref) are taken out; those with one are listed in order."""
    have = refs.groupBy("id").agg(F.collect_set(F.col("ref").cast("string")).alias("_have"))
    x = answers.join(have, "id", "left").withColumn("_have", F.coalesce("_have", F.array().cast("array<string>")))
    marks = F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), 1))
    x = x.withColumn("_bad", F.array_except(marks, F.col("_have"))).withColumn("_good", F.array_intersect(marks, F.col("_have")))
    clean = F.aggregate("_bad", F.col("answer"), lambda t, n: F.replace(t, F.concat(F.lit("["), n, F.lit("]")), F.lit("")))
    cited = F.array_sort(F.transform("_good", lambda n: n.cast("int")))
    return x.select("id", clean.alias("answer"), cited.alias("cited"))


def cache_key(rows: DataFrame, keys: list[str], slug: str, date: str) -> DataFrame:
    """SHA-256 of each group's sorted `slug:date` list: an answer is reused while it is the same."""
    items = F.array_sort(F.collect_list(F.concat_ws(":", slug, date)))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(items, "\n"), 256).alias("input_hash"))


def injected(hits: DataFrame, least: float = RECALL_LEAST, top: int = RECALL_TOP, chars: int = RECALL_CHARS) -> DataFrame:
    """The few best hits (slug, title, score, snippet) that are good enough, as lines of one text; no row if none is."""
    best = hits.filter(F.col("score") >= least).orderBy(F.desc("score"), "slug").limit(top)
    line = F.rtrim(F.concat(F.lit("- ["), "slug", F.lit("] "), F.when(F.coalesce("title", F.lit("")) != "", F.concat("title", F.lit(": "))).otherwise(""), F.coalesce("snippet", F.lit(""))))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "slug", line.alias("line"))))
    x = best.agg(F.count(F.lit(1)).alias("hits"), F.array_join(rows["line"], "\n").alias("text"))
    return x.filter("hits > 0").select("hits", F.substring("text", 1, chars).alias("text"))


def ordered_chain(edges: DataFrame, starts: DataFrame, most: int = 50) -> DataFrame:
    """(start, slug, place) along links of each start (slug), the least target at a fork; a chain ends where it meets itself.

    All chains advance by one join a step, and stop with the longest.
    """
    step = edges.groupBy("src").agg(F.min("dst").alias("dst"))
    front = starts.select(F.col("slug").alias("start"), "slug", F.array("slug").alias("path"))
    out = front
    for _ in range(most):
        met = front.join(step, F.col("slug") == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
        front = settled(met.select("start", F.col("dst").alias("slug"), F.array_append("path", F.col("dst")).alias("path")))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out.select("start", "slug", F.size("path").alias("place"))
