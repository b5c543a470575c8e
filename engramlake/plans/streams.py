"""Queries that drain streams: messages come in folders, some of them later than they were sent, and each folder is drained when it is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake import views as V
from engramlake.functions import text as T
from engramlake.operators.steps import shared_path
from engramlake.queries import _GROUP
from engramlake.registry import query
from engramlake.streaming import blocks as B
from engramlake.streaming import messages as S

#: Folders in which messages come.
PARTS = 3


def drained(parts: list[DataFrame], run) -> DataFrame:
    """The result of a stream (run: of its source) over folders that come one after the other."""
    spark = parts[0].sparkSession
    source, out, check = (shared_path(spark, f"stream-{x}") for x in ("in", "out", "check"))
    for part in parts:
        part.write.mode("append").parquet(source)
        S.drain(run(spark.readStream.schema(part.schema).parquet(source)), out, check)
    return spark.read.parquet(out)


def arrivals(messages: DataFrame, key: str) -> tuple[list[DataFrame], int]:
    """The messages (at_s) in folders by the time that they were sent, every fifth a folder late, and the seconds that a folder spans."""
    lo, hi = messages.agg(F.min("at_s"), F.max("at_s")).first()
    lo, hi = lo or 0, hi or 0
    span = (hi - lo) // PARTS + 1
    late = (F.pmod(F.xxhash64(key), F.lit(5)) == 0).cast("int")
    part = F.least(F.floor((F.col("at_s") - lo) / span) + late, F.lit(PARTS - 1))
    return [messages.filter(part == k) for k in range(PARTS)], span


@query()
def stream_blocks(spark, d):
    """Blocks of all messages as a stream; `blocks_full` is its batch form, to which a test holds it. A last message, far ahead, lets the watermark pass all others."""
    m = V.stream_messages(spark, d).withColumn("tokens", F.round(T.token_estimate(F.coalesce("content", F.lit(""))), 1)).drop("content")
    parts, span = arrivals(m, "msg_id")
    last = m.agg(F.max("at_s").alias("at_s"))
    ahead = F.coalesce("at_s", F.lit(0)) + 3 * span + 2 * B.IDLE_S
    end = last.select(F.lit("~end").alias("stream"), ahead.alias("at_s"))
    empty = m.limit(0)
    end = empty.unionByName(end, allowMissingColumns=True).select(*[F.col(c).cast(m.schema[c].dataType) for c in m.columns])
    out = drained([*parts, end], lambda x: B.blocks(x, f"{2 * span} seconds"))
    return out.filter("stream <> '~end'")


@query(f"WITH {_GROUP} SELECT event_id, at_s, channel, contact FROM group_v")
def stream_deduplicated(spark, d):
    """Each event once, though every folder sends the events of the one before again."""
    m = V.group_messages(spark, d).select("event_id", "at_s", "channel", "contact")
    parts, span = arrivals(m, "event_id")
    again = [parts[0], *[b.unionByName(a) for a, b in zip(parts, parts[1:])]]

    def once(x: DataFrame) -> DataFrame:
        return S.deduplicated(x.withColumn("at", F.timestamp_seconds("at_s")), late=f"{3 * span} seconds").drop("at")

    return drained(again, once)
