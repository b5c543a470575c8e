"""Chat platform payloads: messages, calendar, tasks, mail cursors, documents and what to do with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.operators.steps import settled

#: What stands for a content without text.
IMAGE, FILE, CARD = "[图片]", "[文件]", "[卡片消息]"
#: Seconds that a window reaches back before its cursor, so that late messages are read again.
OVERLAP_S = 2


def scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Items of paged responses, one JSON document a file: the pages' items in one frame."""
    pages = spark.read.schema(f"code int, data struct<items array<{schema}>, has_more boolean>").option("multiLine", "true").json(path)
    return pages.filter("code = 0").select(F.inline("data.items"))


def decoded(kind: Column, raw: Column) -> Column:
    """The text of a message's content by its kind; content that is no JSON stands for itself."""
    v = F.try_parse_json(raw)
    get = lambda p: F.try_variant_get(v, p, "string")
    nodes = F.flatten(F.try_variant_get(v, "$.content", "array<array<struct<text string>>>"))
    texts = F.filter(F.transform(nodes, lambda n: n["text"]), lambda t: F.coalesce(t, F.lit("")) != "")
    title = F.coalesce(get("$.title"), F.lit(""))
    post = F.array_join(F.concat(F.filter(F.array(title), lambda t: t != ""), F.coalesce(texts, F.array().cast("array<string>"))), " ")
    named = F.coalesce(F.concat(F.lit("[文件: "), get("$.file_name"), F.lit("]")), F.lit(FILE))
    card = F.coalesce(get("$.config.wide_screen_mode.header.title.content"), F.lit(CARD))
    text = F.when(kind == "text", F.coalesce(get("$.text"), F.lit(""))).when(kind == "post", post).when(kind == "image", IMAGE)
    text = text.when(kind == "file", named).when(kind == "interactive", card).otherwise(raw)
    return F.when(F.coalesce(raw, F.lit("")) == "", "").when(v.isNull(), raw).otherwise(text)


def attachment(kind: Column, raw: Column) -> Column:
    """(id, type, name) of the image or file that a message carries, else null."""
    v = F.try_parse_json(raw)
    get = lambda p: F.try_variant_get(v, p, "string")
    one = lambda i, n: F.when(i.isNotNull(), F.struct(i.alias("id"), kind.alias("type"), n.alias("name")))
    none = F.lit(None).cast("string")
    return F.when(kind == "image", one(get("$.image_key"), none)).when(kind == "file", one(get("$.file_key"), get("$.file_name")))


def since(messages: DataFrame, cursors: DataFrame, overlap_s: int = OVERLAP_S) -> DataFrame:
    """Messages from a bit before their channel's cursor on; all of a channel without one."""
    x = messages.join(cursors.select("channel", "cursor_s"), "channel", "left")
    return x.filter(F.col("cursor_s").isNull() | (F.col("at_s") >= F.col("cursor_s") - overlap_s)).drop("cursor_s")


def clamped_cursor(items: DataFrame, keys: list[str], ok: str, at: str) -> DataFrame:
    """The newest time read, but below the oldest that failed, so that a failure is read again; null if there is none."""
    newest, oldest = F.max(F.when(F.col(ok), F.col(at))), F.min(F.when(~F.col(ok), F.col(at)))
    x = items.groupBy(*keys).agg(newest.alias("newest"), oldest.alias("oldest"))
    return x.select(*keys, F.when(F.col("newest").isNotNull(), F.least("newest", F.col("oldest") - 1)).alias("cursor"))


def parsed_time(x: Column) -> Column:
    """Epoch seconds of a time given as seconds, milliseconds, or a date with a time (`+08:00` if it names no zone)."""
    digits = F.regexp_replace(x, r"\D", "")
    zone = x.rlike(r"(Z|[+-]\d\d:\d\d)$")
    text = F.when(zone, x).otherwise(F.concat(x, F.lit("+08:00")))
    number = digits.try_cast("long")
    return F.when(x.rlike(r"^\d{13}$"), F.floor(number / 1000)).when(x.rlike(r"^\d{10}$"), number).otherwise(
        F.unix_seconds(text.try_cast("timestamp"))
    )


def walk(folders: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(token, level) of all folders below the roots (folders: token, parent), each at its first level, at most `depth` down."""
    seen = roots.select("token", F.lit(0).alias("level"))
    front = seen
    for k in range(1, depth + 1):
        met = folders.join(front.select(F.col("token").alias("parent")), "parent").select("token").distinct()
        front = settled(met.join(seen, "token", "left_anti").select("token", F.lit(k).alias("level")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def trigger(editor: Column, modified_s: Column, folder: Column, me: str, now_s: int, days: int | None, important: list[str]) -> Column:
    """Why a document is worth reading in full: T1 edited by its reader, T2 recent, T4 in an important folder; else null."""
    t = F.when(editor == me, "T1")
    if days is not None:
        t = t.when(F.lit(now_s) - modified_s <= days * 86400, "T2")
    return t.when(folder.isin(*important), "T4")


def decision(kind: Column, level: Column, same: Column, why: Column) -> Column:
    """What to do with a document, by the card there is (level null: none; same: not modified since) and its trigger."""
    want = why.isNotNull()
    full = F.when(same, "skip_save").otherwise("needs_body_check")
    pointer = F.when(want, "queue_for_upgrade").otherwise(F.when(same, "skip_save").otherwise("save_pointer"))
    new = F.when(want, "queue_for_upgrade").otherwise("save_pointer")
    return F.when(kind != "docx", "save_pointer").when(level.isNull(), new).when(level == "pointer", pointer).otherwise(full)


def body_hash(x: Column) -> Column:
    """SHA-256 of a text without its carriage returns and trailing blanks."""
    lines = F.regexp_replace(F.regexp_replace(x, "\r\n", "\n"), "(?m)[ \t]+$", "")
    return F.sha2(F.regexp_replace(lines, r"^\s+|\s+$", ""), 256)


def headings(blocks: Column) -> Column:
    """(level, title) of the headings among blocks (type, text)."""
    kept = F.filter(blocks, lambda b: b["type"].isin("heading1", "heading2", "heading3") & (F.trim(b["text"]) != ""))
    return F.transform(kept, lambda b: F.struct(F.substring(b["type"], 8, 1).cast("int").alias("level"), F.trim(b["text"]).alias("title")))


def upgrade_batch(queue: DataFrame, run: int, bootstrap_runs: int, bootstrap: int, batch: int) -> DataFrame:
    """The documents first asked for, each once, as many as this run takes (queue: token, asked)."""
    n = bootstrap if run < bootstrap_runs else batch
    return queue.groupBy("token").agg(F.min("asked").alias("asked")).orderBy("asked", "token").limit(n)
