"""Feeds, sessions, blocks and behavior profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engramlake.operators.cuts import cut_long
from engramlake.operators.steps import cut

GAP_S, TOKENS, MESSAGES = 30 * 60, 4000, 100


def sessions(messages: DataFrame, keys: list[str], tie: str, gap_s: int = GAP_S) -> DataFrame:
    """Sessions of each key, split where the gap to the message before is above `gap_s`."""
    w = W.partitionBy(*keys).orderBy("at_s", tie)
    new = (F.col("at_s") - F.lag("at_s").over(w) > gap_s).cast("int")
    x = messages.withColumn("session", F.sum(F.coalesce(new, F.lit(0))).over(w))
    return x.groupBy(*keys, "session").agg(
        F.min("at_s").alias("start_s"), F.max("at_s").alias("end_s"), F.count(F.lit(1)).alias("messages")
    )


def blocks(messages: DataFrame, gap_s: int = GAP_S, tokens: float = TOKENS, most: int = MESSAGES, long: bool = False) -> DataFrame:
    """Conversation blocks of streams of messages: stream, platform, channel, at_s, seq, msg_id, contact, tokens, thread, doc_token.

    A stream is cut where the platform or channel changes, around each mail, calendar entry, task and document part without a token, where a
    document's token changes, and (but in documents) at gaps above `gap_s`: windows find these. What lies between is cut at a change of thread and at the caps of
    tokens and messages, which reset at each cut: those are walked (`cut`). long: what lies between is cut by many tasks, to the same blocks (`cuts.cut_long`), in more steps.
    """
    w = W.partitionBy("stream").orderBy("at_s", "seq")
    doc = F.coalesce(F.col("channel").startswith("docs/"), F.lit(False))
    entry = F.col("channel").startswith("mail/") | F.col("channel").startswith("calendar/") | (F.col("channel") == "tasks")
    x = messages.withColumn("doc", doc).withColumn("alone", F.coalesce(entry, F.lit(False)) | (doc & F.col("doc_token").isNull()))
    same = [F.col(c).eqNullSafe(F.lag(c).over(w)) for c in ("platform", "channel")]
    token = ~F.col("doc") | F.col("doc_token").eqNullSafe(F.lag("doc_token").over(w))
    near = F.col("doc") | (F.col("at_s") - F.lag("at_s").over(w) <= gap_s)
    joins = same[0] & same[1] & token & near & ~F.col("alone") & ~F.lag("alone").over(w)
    x = x.withColumn("part", F.sum(F.coalesce(joins, F.lit(False)).cast("int") * -1 + 1).over(w))
    thread = F.when(~F.col("doc") & ~F.col("alone"), F.col("thread")).alias("thread")
    x = x.select("stream", "part", "platform", "channel", "at_s", "seq", "msg_id", "contact", "tokens", thread, "doc")
    if long:
        x = x.withColumn("key", F.struct("stream", "part"))
        loose = cut_long(x.filter(~F.col("doc")), "key", ["at_s", "seq"], "tokens", tokens, most, "thread")
        each = loose.unionByName(x.filter("doc").withColumn("block", F.lit(0).cast("long")))
    else:
        each = cut(x, ["stream", "part"], [F.asc("at_s"), F.asc("seq")], "tokens", tokens, most, "thread", "doc")
    ids = F.array_join(F.array_sort(F.collect_list("msg_id")), "|")
    return each.groupBy("stream", "part", "block").agg(
        F.first("platform").alias("platform"), F.first("channel").alias("channel"), F.count(F.lit(1)).alias("messages"),
        F.round(F.sum("tokens"), 1).alias("tokens"), F.min("at_s").alias("start_s"), F.max("at_s").alias("end_s"),
        F.min_by("thread", F.when(F.col("thread").isNotNull(), F.struct("at_s", "seq"))).alias("thread"),
        F.size(F.collect_set("contact")).alias("participants"), F.substring(F.sha2(ids, 256), 1, 16).alias("block_hash"),
    )


def coverage(timeline: DataFrame, source: str, as_of_s: int, weeks: int = 104) -> DataFrame:
    """Entries of a source by week (epoch-aligned, in ms) over the last weeks; entries whose date is not a full one are left out."""
    first = F.date_format(F.timestamp_seconds(F.lit(as_of_s - weeks * 604800)), "yyyy-MM-dd")
    x = timeline.filter((F.col("source") == source) & F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}") & (F.col("date") >= first))
    day = F.unix_date(F.try_to_date(F.substring("date", 1, 10))).cast("long")
    week = (F.floor(day / 7) * 604800000).cast("long")
    return x.groupBy(week.alias("week_ms")).agg(F.count(F.lit(1)).alias("entries"))


def behavior(dms: DataFrame, offset_hours: int = 8) -> DataFrame:
    """Mergeable counters of each channel's other side: received messages, characters, questions, reply latency, peak hours."""
    w = W.partitionBy("channel").orderBy("at_s", "turn")
    x = dms.withColumn("next_at", F.lead("at_s").over(w)).withColumn("next_way", F.lead("direction").over(w))
    got = x.filter(F.col("direction") != "sent")
    wait = F.when((F.col("next_way") == "sent") & (F.col("next_at") >= F.col("at_s")), F.col("next_at") - F.col("at_s"))
    hour = F.pmod(F.floor(F.col("at_s") / 3600) + offset_hours, F.lit(24))
    return got.groupBy("channel").agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum(F.length("content")).alias("chars"),
        F.sum(F.col("content").contains("?").cast("int")).alias("questions"),
        F.sum(wait).alias("latency_s"),
        F.count(wait).alias("latency_n"),
        *[F.sum((hour == h).cast("int")).alias(f"h{h:02d}") for h in range(24)],
    )


def profile(counters: DataFrame, key: str = "channel") -> DataFrame:
    """Ratios of the counters; the three busiest hours (most messages, then the earliest)."""
    hours = F.array(*[F.struct((-F.col(f"h{h:02d}")).alias("n"), F.lit(h).alias("h")) for h in range(24)])
    busy = F.filter(F.slice(F.array_sort(hours), 1, 3), lambda x: x["n"] < 0)
    over = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    return counters.select(
        key, over("chars", "messages").alias("mean_chars"), over("questions", "messages").alias("question_ratio"),
        over("latency_s", "latency_n").alias("mean_latency_s"),
        F.array_join(F.transform(busy, lambda x: x["h"].cast("string")), ",").alias("peak_hours"),
    )


def merge_counters(counters: DataFrame, key: str = "channel") -> DataFrame:
    """Counters of one key summed; partial counters of any split of the messages merge to the same."""
    return counters.groupBy(key).agg(*[F.sum(c).alias(c) for c in counters.columns if c != key])
