"""Payloads of direct talks, calendars, tasks, document blocks and links, and what a model answered, as columns."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Kinds of document blocks and the heading level of each (0: text).
BLOCKS = {"2": 0, "3": 1, "4": 2, "5": 3, "12": 0, "13": 0, "14": 0, "15": 0, "17": 0}
#: Fixed value: what a place is called in the text of a calendar entry.
PLACE = "地点: "
WINDOW_DAYS = (30, 90)


def direct(items: DataFrame, me: str) -> DataFrame:
    """Direct messages (chat_id, sender_id, create_time in ms as text, content): channel, contact, at_s, direction, content."""
    direction = F.when(F.col("sender_id") == me, "sent").otherwise("received")
    at = F.floor(F.col("create_time").try_cast("long") / 1000)
    return items.select(F.concat(F.lit("dm/"), "chat_id").alias("channel"), F.col("sender_id").alias("contact"), at.alias("at_s"), direction.alias("direction"), "content")


def start_of(cursor_ms: Column, override_ms: int | None, now_ms: int, lookback_days: int) -> Column:
    """Where a source starts to read: its cursor, an earlier override, or so many days ago if it has neither."""
    begin = F.coalesce(cursor_ms, F.lit(now_ms - lookback_days * 86_400_000))
    return begin if override_ms is None else F.when(cursor_ms.isNull() | (F.lit(override_ms) < cursor_ms), F.lit(override_ms)).otherwise(begin)


def windowed(messages: DataFrame, cursors: DataFrame, now_s: int, overlap_s: int = 2) -> DataFrame:
    """Messages from a bit before their channel's cursor up to now; all up to now of a channel without one."""
    x = messages.join(cursors.select("channel", "cursor_s"), "channel", "left")
    return x.filter((F.col("at_s") <= now_s) & (F.col("cursor_s").isNull() | (F.col("at_s") >= F.col("cursor_s") - overlap_s))).drop("cursor_s")


def calendar(events: DataFrame, now_s: int, sync: bool = False) -> DataFrame:
    """Calendar entries (event_id, calendar_id, summary, description, place, start_s, start_date, organizer) as messages: channel, contact, at, content.

    Without a sync token only those from 30 days ago to 90 days ahead; an entry without a start counts as now.
    """
    second = F.coalesce(F.col("start_s"), F.unix_date(F.try_to_date("start_date")).cast("long") * 86400, F.lit(now_s))
    at = F.when(F.col("start_s").isNull() & F.col("start_date").isNotNull(), F.col("start_date")).otherwise(
        F.date_format(F.timestamp_seconds(F.coalesce("start_s", F.lit(now_s))), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    )
    some = lambda c, head="": F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c))
    text = F.concat_ws("\n", some(F.col("summary")), some(F.col("description")), some(F.col("place"), PLACE))
    x = events if sync else events.filter(second.between(now_s - WINDOW_DAYS[0] * 86400, now_s + WINDOW_DAYS[1] * 86400))
    return x.select("event_id", F.concat(F.lit("calendar/"), "calendar_id").alias("channel"), F.coalesce("organizer", F.lit("unknown")).alias("contact"), at.alias("at"), text.alias("content"))


def tasks(items: DataFrame, since_s: int | None = None) -> DataFrame:
    """Tasks (guid, summary, description, members: array of (id, role), priority, completed_at, updated_s) as messages, those updated since then."""
    x = items if since_s is None else items.filter(F.col("updated_s") >= since_s)
    of = lambda role: F.transform(F.filter("members", lambda m: m["role"] == role), lambda m: m["id"])
    some = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    return x.select(
        "guid", F.concat_ws("\n", some("summary"), some("description")).alias("content"), F.when(F.coalesce("completed_at", F.lit("")) != "", "completed").otherwise("open").alias("status"),
        of("assignee").alias("assignees"), of("follower").alias("followers"), F.when(F.coalesce("priority", F.lit("")) != "", F.col("priority")).otherwise("none").alias("priority"),
    )


def block_text(blocks: Column) -> Column:
    """The text of a document's blocks (kind, text), one line for each that has any; kinds that are not known have none."""
    known = F.array(*map(F.lit, BLOCKS))
    return F.array_join(F.transform(F.filter(blocks, lambda b: F.array_contains(known, b["kind"]) & (F.coalesce(b["text"], F.lit("")) != "")), lambda b: b["text"]), "\n")


def structured_text(meta: Column, content: Column) -> Column:
    """The canonical text of a calendar entry or task: its known fields (a map), a line each, an empty line, and its content."""
    names = {"event_id": "Event", "task_id": "Task", "location": "Location", "status": "Status", "priority": "Priority", "due_date": "Due", "attendees": "Attendees", "assignees": "Assignees"}
    value = lambda k: F.try_element_at(meta, F.lit(k))
    lines = F.array_compact(F.array(*[F.when(F.coalesce(value(k), F.lit("")) != "", F.concat(F.lit(f"{n}: "), value(k))) for k, n in names.items()]))
    body = F.regexp_replace(F.coalesce(content, F.lit("")), r"^\s+|\s+$", "")
    return F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n\n"), body)).otherwise(body)


def topic_slug(topic: Column) -> Column:
    """A topic in lower case, without signs, its blanks and underscores as single dashes."""
    x = F.regexp_replace(F.regexp_replace(F.lower(topic), r"^\s+|\s+$", ""), r"[^\p{L}\p{N}\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[\s_]+", "-"), "-+", "-"), "^-|-$", "")


def knowledge_slug(topic: Column) -> Column:
    """Letters a to z, digits and ideographs, joined by dashes, at most 80 characters; the hexadecimal of a 31-fold sum of the characters, if that leaves nothing.

    The sum runs over UTF-16 units in 32 bits; here over code points, which is the same below U+10000.
    """
    x = F.regexp_replace(F.regexp_replace(F.lower(topic), "[^a-z0-9一-鿿㐀-䶿]+", "-"), "^-+|-+$", "")
    codes = F.transform(F.filter(F.split(topic, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda t, c: F.pmod(t * 31 + c, F.lit(1 << 32)))
    return F.when(x != "", F.substring(x, 1, 80)).otherwise(F.lpad(F.lower(F.hex(total)), 12, "0"))


def iso_time(x: Column) -> Column:
    """A date as its first instant, a time as it is, null for null; anything else is null with `bad_time`."""
    day = x.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(x).isNotNull()
    time = x.rlike(r"^\d{4}-\d{2}-\d{2}T") & x.try_cast("timestamp").isNotNull()
    return F.when(day, F.concat(x, F.lit("T00:00:00.000Z"))).when(time, x)


def bad_time(x: Column) -> Column:
    return x.isNotNull() & iso_time(x).isNull()


def _compact(v):
    if isinstance(v, dict):
        v = {k: c for k, x in v.items() if (c := _compact(x)) is not None}
    elif isinstance(v, list):
        v = [c for x in v if (c := _compact(x)) is not None]
    return None if v is None or v == {} or v == [] else v


def _salvaged(text: str) -> str | None:
    """The first JSON object or array in a text: what a decoder reads from its first brace on."""
    at = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if at < 0:
        return None
    try:
        return text[at : json.JSONDecoder().raw_decode(text, at)[1]]
    except ValueError:
        return None


def _mapped(df: DataFrame, column: str, out: str, f) -> DataFrame:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            values = [None if v is None else f(v) for v in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.string())], [*batch.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, StringType())]))


def compacted(df: DataFrame, column: str, out: str = "compact") -> DataFrame:
    """A JSON column without nulls and empty lists and objects at any depth; null where nothing is left or it is no JSON."""

    def one(text: str) -> str | None:
        try:
            v = _compact(json.loads(text))
        except ValueError:
            return None
        return None if v is None else json.dumps(v, ensure_ascii=False, separators=(",", ":"))

    return _mapped(df, column, out, one)


def salvaged(df: DataFrame, column: str, out: str = "json") -> DataFrame:
    """The JSON in what a model answered, with fences or talk around it; null if there is none."""
    return _mapped(df, column, out, _salvaged)
