"""Runs and their state: what is due, what may be committed, which sessions to distill, what to alert on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SILENCE_S, RETRY_S, RETRIES = 30 * 60, 5 * 60, 3
FAILURES, PARTIALS = 3, 5


def effective(derived: DataFrame, overrides: DataFrame) -> DataFrame:
    """Schedules (source, every_s, enabled) with what the overrides say in place of what was derived."""
    x = derived.alias("a").join(overrides.alias("b"), "source", "full")
    pick = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c)
    return x.select("source", pick("every_s"), pick("enabled"))


def due(schedules: DataFrame, runs: DataFrame, now_s: int) -> DataFrame:
    """source, next_s, due: a source is due an interval after its last run (runs: source, at_s), at once if it never ran."""
    last = runs.groupBy("source").agg(F.max("at_s").alias("last_s"))
    x = schedules.join(last, "source", "left")
    at = F.coalesce(F.col("last_s") + F.col("every_s"), F.lit(now_s))
    return x.select("source", at.alias("next_s"), (F.col("enabled") & (at <= now_s)).alias("due"))


def run_result(ok: str = "ok", failed: str = "failed", fatal: str = "fatal"):
    some = F.col(failed) > 0
    return F.when(F.col(fatal), "failed").when(some & (F.col(ok) > 0), "partial").when(some, "failed").otherwise("ok")


def commits(blocks: DataFrame) -> DataFrame:
    """Whether a run's cursor may move (blocks: run, failed, pushed): nothing failed and everything was pushed."""
    x = blocks.groupBy("run").agg(F.sum(F.col("failed").cast("long")).alias("failed"), F.sum((~F.col("pushed")).cast("long")).alias("unpushed"))
    return x.withColumn("commit", (F.col("failed") == 0) & (F.col("unpushed") == 0))


def distill_step(revisions: DataFrame, payloads: DataFrame, files: DataFrame, now_s: int) -> DataFrame:
    """What a tick does with each revision (id, session, hash, state, updated_s, tries), by the payloads and the files there are.

    replay if it has a payload; missing, silence or stale by its file; backoff while a retry waits; dead after
    the last try; else distill.
    """
    x = revisions.join(payloads.select(F.col("revision_id").alias("id"), F.lit(True).alias("_has")).distinct(), "id", "left")
    x = x.join(files.select("session", F.col("hash").alias("_hash"), "changed_s"), "session", "left")
    waits = (F.col("state") == "retrying") & (F.lit(now_s) - F.col("updated_s") < RETRY_S)
    step = F.when(F.col("_has"), "replay").when(F.col("_hash").isNull(), "missing").when(F.lit(now_s) - F.col("changed_s") < SILENCE_S, "silence")
    step = step.when(F.col("_hash") != F.col("hash"), "stale").when(waits, "backoff").when(F.col("tries") >= RETRIES, "dead")
    return x.select("id", step.otherwise("distill").alias("step"))


def alerts(states: DataFrame) -> DataFrame:
    """source, reason of the sources that failed or fell short too often in a row (source, failures, partials)."""
    reason = F.when(F.col("failures") >= FAILURES, "failing").when(F.col("partials") >= PARTIALS, "partial")
    return states.select("source", reason.alias("reason")).filter("reason IS NOT NULL")
