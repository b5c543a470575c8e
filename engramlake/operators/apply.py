"""Applying signals to pages: candidates, snapshots to compare, merges, and what expires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engramlake.operators.similar import most_like


def candidates(signals: DataFrame, pool: DataFrame, k: int = 5) -> DataFrame:
    """The k pages whose titles are most like each signal (signals: id, what; pool: slug, title), and like it at all.

    Texts meet once each, however many rows have them (`most_like`).
    """
    heads = pool.filter("title IS NOT NULL").groupBy("title").agg(F.min("slug").alias("head"))
    whats = signals.select(F.col("what").alias("text")).filter("text IS NOT NULL")
    like = most_like(whats, heads.withColumnRenamed("title", "text"), k).select(F.col("a").alias("what"), F.col("b").alias("title"), "score")
    # the k best pages are of the k titles that are best by score and first slug
    first = W.partitionBy("title").orderBy("slug")
    few = pool.select("slug", "title").withColumn("_p", F.row_number().over(first)).filter(F.col("_p") <= k).drop("_p")
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "slug"))
    met = signals.select("id", "what").join(like, "what").join(few, "title")
    return met.withColumn("place", rank).filter(F.col("place") <= k).select("id", "slug", "score", "place")


def cas(attempts: DataFrame, pages: DataFrame) -> DataFrame:
    """apply, retry or dead for each attempt (slug, seen, tries) by the hash that its page has now (slug, hash)."""
    x = attempts.join(pages.select("slug", F.col("hash").alias("_now")), "slug", "left")
    same = F.col("seen").eqNullSafe(F.col("_now"))
    return x.withColumn("step", F.when(same, "apply").when(F.col("tries") < 1, "retry").otherwise("dead")).drop("_now")


def merged(old: DataFrame, new: DataFrame, keys: list[str], *, soft: list[str]) -> DataFrame:
    """Rows of both by their keys; a soft column keeps its old value where the new one is null."""
    a, b = old.withColumn("_o", F.lit(1)), new.withColumn("_n", F.lit(1))
    x = a.alias("a").join(b.alias("b"), keys, "full")
    rest = [c for c in old.columns if c not in keys]
    both = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"))
    hard = lambda c: F.when(F.col("b._n").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return x.select(*keys, *[(both(c) if c in soft else hard(c)).alias(c) for c in rest])


def suggestions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Suggestions (keys, reason, status): pending ones are refreshed, resolved ones stay as they are."""
    x = old.alias("a").join(new.alias("b"), keys, "full")
    done = F.col("a.status").isNotNull() & (F.col("a.status") != "pending")
    reason = F.when(done, F.col("a.reason")).otherwise(F.coalesce("b.reason", "a.reason"))
    return x.select(*keys, reason.alias("reason"), F.when(done, F.col("a.status")).otherwise("pending").alias("status"))


def rechunked(old: DataFrame, new: DataFrame) -> DataFrame:
    """keep (the text, and so its embedding, is the same), embed or delete for each chunk (doc_id, chunk_index, chunk_text)."""
    keys = ["doc_id", "chunk_index"]
    a, b = old.select(*keys, F.sha2("chunk_text", 256).alias("was")), new.select(*keys, F.sha2("chunk_text", 256).alias("now"))
    step = F.when(F.col("now").isNull(), "delete").when(F.col("was").eqNullSafe(F.col("now")), "keep").otherwise("embed")
    return a.join(b, keys, "full").select(*keys, step.alias("step"))


def merged_maps(a: Column, b: Column) -> Column:
    """A map with the other's entries put over it."""
    keep = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_concat(keep, b))


def expiring(payloads: DataFrame, applied: DataFrame, now_s: int, ttl_s: int) -> DataFrame:
    """id, expires_s, due: payloads whose revision was applied get a time to live from when that was."""
    x = payloads.join(applied.select("id", "applied_s"), "id", "left_outer")
    end = F.col("applied_s") + ttl_s
    return x.select("id", end.alias("expires_s"), F.coalesce(end <= now_s, F.lit(False)).alias("due"))


def matched(output: DataFrame, golden: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one matches of outputs and golden rows with equal keys (id on either side), in the order of ids."""
    w = W.partitionBy(*keys).orderBy("id")
    a = output.select(*keys, "id", F.row_number().over(w).alias("_k")).withColumnRenamed("id", "output_id")
    b = golden.select(*keys, "id", F.row_number().over(w).alias("_k")).withColumnRenamed("id", "golden_id")
    x = a.join(b, [*keys, "_k"], "full").drop("_k")
    kind = F.when(F.col("golden_id").isNull(), "extra").when(F.col("output_id").isNull(), "missed").otherwise("matched")
    return x.select("output_id", "golden_id", kind.alias("kind"))
