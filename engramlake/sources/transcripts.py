"""Agent transcripts: JSON lines in three dialects become messages.

A frame of lines has file, line (its number) and text. All dialects return file, line, session,
contact, direction, at (the time as written) and content; lines that do not parse, or that lack
what a message needs, give no message and are counted by `bad_lines`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engramlake.operators.cuts import cut_long
from engramlake.operators.steps import cut

#: How texts start that a tool and not the user wrote.
SYSTEM_TAGS = ("<environment_context", "<permissions", "<collaboration_mode", "<skills_instructions")
#: Characters of a user text that tell it from others in dialect B.
SAME_TEXT = 200

_PARTS = "array<struct<type string, text string>>"


def scan(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """The lines of all files under a folder, numbered from 1.

    Each file is one row of the scan (Spark's binary reader) and becomes its lines there, so that numbers
    need no shuffle; a transcript is a file of a few MB.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    texts = files.select(F.col("path").alias("file"), "modificationTime", F.split(F.col("content").cast("string"), "\n").alias("all"))
    each = texts.select("file", "modificationTime", F.posexplode("all").alias("at", "text"))
    return each.filter(F.col("text").rlike(r"\S")).select("file", "modificationTime", (F.col("at") + 1).cast("long").alias("line"), "text")


def snapshots(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """Bytes, lines and SHA-256 of each file, with its modification time: what the revision ledger compares."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    lines = F.size(F.filter(F.split(F.col("content").cast("string"), "\n"), lambda x: x != ""))
    return files.select(F.col("path").alias("file"), "modificationTime", F.col("length").alias("bytes"), lines.alias("lines"), F.sha2("content", 256).alias("hash"))


def _parsed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("v", F.try_parse_json("text"))


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", path, kind)


def _is(path: str, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(_get(path, "variant")).startswith(kind), F.lit(False))


def _joined(path: str, kinds: tuple[str, ...]) -> Column:
    """The texts of the parts of these kinds, an empty line between them."""
    parts = F.filter(_get(path, _PARTS), lambda p: p["type"].isin(*kinds) & (F.coalesce(p["text"], F.lit("")) != ""))
    return F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n")


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _messages(rows: DataFrame, session: Column, role: Column, content: Column, *more: str) -> DataFrame:
    x = rows.withColumn("_role", role).withColumn("content", content).filter("content IS NOT NULL")
    contact = F.when(F.col("_role") == "user", "user").otherwise("assistant")
    way = F.when(F.col("_role") == "user", "sent").otherwise("received")
    return x.select("file", "line", session.alias("session"), contact.alias("contact"), way.alias("direction"), _get("$.timestamp").alias("at"), "content", *more)


def dialect_a(lines: DataFrame) -> DataFrame:
    """user and assistant records; content is a text, or blocks of which those of text count."""
    x = _parsed(lines).filter(_get("$.type").isin("user", "assistant") & _get("$.uuid").isNotNull() & _get("$.timestamp").isNotNull())
    blocks = _joined("$.message.content", ("text",))
    text = F.when(_is("$.message.content", "STRING"), _get("$.message.content")).when(
        _is("$.message.content", "ARRAY") & (_stripped(blocks) != ""), blocks
    )
    return _messages(x, F.coalesce(_get("$.sessionId"), F.col("file")), _get("$.message.role"), text)


def dialect_b(lines: DataFrame) -> DataFrame:
    """Response items and user events; what a tool wrote for the user is left out, and of user texts with one start the first stays."""
    x = _parsed(lines)
    item, event = _get("$.type") == "response_item", (_get("$.type") == "event_msg") & (_get("$.payload.type") == "user_message")
    role = F.when(event, "user").otherwise(_get("$.payload.role"))
    text = F.when(event, _get("$.payload.message")).when(role == "user", _joined("$.payload.content", ("input_text", "text"))).otherwise(
        _joined("$.payload.content", ("output_text",))
    )
    x = x.filter((item & role.isin("user", "assistant")) | event)
    got = _messages(x, F.col("file"), role, text).filter(_stripped(F.col("content")) != "")
    system = F.lit(False)
    for tag in SYSTEM_TAGS:
        system = system | _stripped(F.col("content")).startswith(tag)
    mine, theirs = got.filter((F.col("contact") == "user") & ~system), got.filter("contact <> 'user'")
    first = W.partitionBy(F.lower(F.substring(_stripped(F.col("content")), 1, SAME_TEXT))).orderBy("file", "line")
    return mine.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").unionByName(theirs)


def dialect_c(lines: DataFrame) -> DataFrame:
    """Message records of agents; the agent is named by the folder above `sessions`, and trajectory files are left out."""
    agent = F.regexp_extract("file", r"([^/\\]+)[/\\]sessions[/\\]", 1)
    x = _parsed(lines.filter(~F.col("file").endswith(".trajectory.jsonl")))
    x = x.filter((_get("$.type") == "message") & _get("$.message.role").isin("user", "assistant"))
    x = x.withColumn("agent", F.when(agent != "", agent).otherwise("unknown"))
    got = _messages(x, F.regexp_extract("file", r"([^/\\]+)\.jsonl$", 1), _get("$.message.role"), _joined("$.message.content", ("text",)), "agent")
    return got.filter(_stripped(F.col("content")) != "")


def bad_lines(lines: DataFrame) -> DataFrame:
    """file, line and reason of the lines that are no JSON object."""
    x = _parsed(lines)
    reason = F.when(F.col("v").isNull(), "invalid").when(~F.schema_of_variant("v").startswith("OBJECT"), "no object")
    return x.select("file", "line", reason.alias("reason")).filter("reason IS NOT NULL")


def revisions(seen: DataFrame, ledger: DataFrame) -> DataFrame:
    """new, revised or unchanged for each file, by the hashes that the ledger has for it."""
    known = ledger.select("file", F.lit(True).alias("_file")).distinct()
    same = ledger.select("file", "hash", F.lit(True).alias("_same")).distinct()
    x = seen.join(known, "file", "left").join(same, ["file", "hash"], "left")
    state = F.when(F.col("_same"), "unchanged").when(F.col("_file"), "revised").otherwise("new")
    return x.select("file", "hash", state.alias("state"))


def segments(messages: DataFrame, budget: float, long: bool = False) -> DataFrame:
    """Sessions packed into segments (from 1) of at most `budget` tokens: session, msg, segment, tokens.

    Messages (session, msg, tokens) are walked in order, as each cut depends on the one
    before; a message above the budget stands alone and is cut by `oversized`. long: sessions of any length are cut by many tasks, to the same segments (`cuts.cut_long`), in more steps.
    """
    x = messages.select("session", "msg", "tokens")
    x = cut_long(x, "session", ["msg"], "tokens", budget, name="segment") if long else cut(x, ["session"], [F.asc("msg")], "tokens", budget, name="segment")
    return x.withColumn("segment", F.col("segment") + 1)


def oversized(messages: DataFrame, budget: int, chars_per_token: int = 4) -> DataFrame:
    """Pieces `msg.k` of the messages above the budget, each of the characters that fill it (session, msg, tokens, content)."""
    n = budget * chars_per_token
    big = messages.filter(F.col("tokens") > budget)
    at = F.explode(F.sequence(F.lit(0), F.ceil(F.length("content") / n).cast("int") - 1)).alias("k")
    x = big.filter(F.length("content") > 0).select("session", "msg", "content", at)
    piece = F.substr("content", F.col("k") * n + 1, F.lit(n))
    return x.select("session", F.concat(F.col("msg").cast("string"), F.lit("."), (F.col("k") + 1).cast("string")).alias("piece"), piece.alias("content"))
