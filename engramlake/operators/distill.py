"""Long sessions distilled segment by segment: a fold that hands a state on, and a reduction of what the segments say."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a model makes of one segment, given what the segment before handed on.
Model = Callable[[str, str], dict]

_SIGNAL = pa.struct([("type", pa.string()), ("topic", pa.string()), ("what", pa.string())])
_TURNED = pa.struct([("topic", pa.string()), ("reason", pa.string())])
_SUMMARY = "session string, segment long, summary string, signals array<struct<type:string,topic:string,what:string>>, overturned array<struct<topic:string,reason:string>>, carry string"
#: Rows of summaries in a batch that leaves the fold.
BATCH = 256


def rendered(msg: Column, role: Column, content: Column, continued: Column) -> Column:
    """A message as a model reads it."""
    mark = F.when(F.coalesce(continued, F.lit(False)), " (continued)").otherwise("")
    return F.concat(F.lit("["), msg.cast("string"), mark, F.lit("] "), F.coalesce(role, F.lit("")), F.lit(": "), F.coalesce(content, F.lit("")))


def folded(lines: DataFrame, model: Model) -> DataFrame:
    """Per segment of a session (session, segment, msg, line) what the model says of its lines: summary, signals, overturned, carry.

    A session's segments come one after the other, as each call needs what the one before handed on (carry; at first an empty text). They are a
    sorted stream: a task holds one segment's lines, the state handed on and a batch of results, however long the session is. Segments are
    cut to a budget before (`transcripts.segments`), so they are bounded. Lines of one number are taken in the order of their texts, nulls first; a null line is left out.
    """
    kind = pa.schema([("session", pa.string()), ("segment", pa.int64()), ("summary", pa.string()), ("signals", pa.list_(_SIGNAL)), ("overturned", pa.list_(_TURNED)), ("carry", pa.string())])

    def rows(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in stream:
            yield from zip(*(batch.column(c).to_pylist() for c in ("session", "segment", "line")))

    def walk(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, carry = [], None, ""
        for (session, segment), part in groupby(rows(stream), key=lambda r: r[:2]):
            if not done and now is None or session != now:
                now, carry = session, ""
            said = model("\n".join(line for _, _, line in part if line is not None), carry)
            carry = said.get("carry") or ""
            done.append({"session": session, "segment": segment, "summary": said.get("summary"), "signals": said.get("signals") or [], "overturned": said.get("overturned") or [], "carry": carry})
            if len(done) == BATCH:
                yield pa.RecordBatch.from_pylist(done, schema=kind)
                done = []
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=kind)

    x = lines.select(F.col("session").cast("string").alias("session"), F.col("segment").cast("long").alias("segment"), "msg", "line")
    return x.repartition("session").sortWithinPartitions("session", "segment", "msg", "line").select("session", "segment", "line").mapInArrow(walk, _SUMMARY)


def reduced(summaries: DataFrame, slug: Callable[[Column], Column]) -> DataFrame:
    """The signals that a session ends with: session, type, topic, what, segment.

    Of signals of one type and topic (by the topic's slug) the last one stands; a topic that any segment has overturned is in none. Signals meet by session and topic, and
    overturned topics are an anti-join, so a long session is not gathered. A null topic has no slug and stays out.
    """
    at = F.posexplode("signals").alias("place", "s")
    said = summaries.select("session", "segment", at).select("session", "segment", "place", "s.*").withColumn("slug", slug(F.col("topic"))).filter("slug IS NOT NULL")
    turned = summaries.select("session", F.explode("overturned").alias("o")).select("session", slug(F.col("o.topic")).alias("slug")).distinct()
    last = said.groupBy("session", "type", "slug").agg(F.max_by(F.struct("topic", "what", "segment"), F.struct("segment", "place")).alias("s"))
    left = last.join(turned, (last["session"].eqNullSafe(turned["session"])) & (last["slug"] == turned["slug"]), "left_anti")
    return left.select("session", "type", "s.*")
