"""Adapter views: the memory store's tables, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Page types and storage tiers, in the order in which ids take them.
TYPES = ("decision", "task", "knowledge", "preference", "reference")
TIERS = ("hot", "warm", "cold")
#: The clock of every query that needs one.
AS_OF = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as wiki pages."""
    d = table(spark, sf_dir, "documents")
    hours = F.col("doc_id").cast("long") * 3600
    return d.select(
        "doc_id",
        F.concat(F.lit("knowledge/doc-"), F.col("doc_id").cast("string")).alias("slug"),
        _pick(TYPES, F.col("doc_id")).alias("type"),
        F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"),
        F.col("text").alias("body"),
        (F.lit(1704067200) + hours).alias("created_s"),
        _pick(TIERS, F.col("doc_id")).alias("tier"),
        F.col("lang").alias("platform"),
        F.col("source").alias("channel"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as a directed graph of entity pages: src, dst, link_type."""

    def edges(name: str, a: str, ka: str, b: str, kb: str, kind: str) -> DataFrame:
        of = lambda p, k: F.concat(F.lit(f"{p}/"), F.col(k).cast("string"))
        return table(spark, sf_dir, name).select(of(a, ka).alias("src"), of(b, kb).alias("dst"), F.lit(kind).alias("link_type"))

    return (
        edges("customer", "customer", "c_custkey", "nation", "c_nationkey", "part_of")
        .unionByName(edges("nation", "nation", "n_nationkey", "region", "n_regionkey", "part_of"))
        .unionByName(edges("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "part_of"))
        .unionByName(edges("orders", "order", "o_orderkey", "customer", "o_custkey", "mentions"))
    )


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dated entries of customer pages."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")).alias("slug"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("date"),
        F.col("o_orderpriority").alias("summary"),
        F.col("o_orderstatus").alias("source"),
        F.col("o_orderkey").alias("entry_id"),
    )


def group_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of group channels."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("at_s"),
        F.concat(F.lit("group/"), F.col("event_type")).alias("channel"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("contact"),
        F.col("value"),
    )


def direct_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as direct messages; each turn follows the one before by (turn * 7 + conv) mod 45 minutes."""
    c = table(spark, sf_dir, "conversations")
    at = F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 2700 + (F.col("turn") * 7 + F.col("conv_id")) % 45 * 60
    return c.select(
        F.concat(F.lit("dm/"), F.col("conv_id").cast("string")).alias("channel"),
        "turn",
        F.when(F.col("role") == "user", "sent").otherwise("received").alias("direction"),
        F.col("text").alias("content"),
        at.alias("at_s"),
    )


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as contributions to pages: one per labelled document."""
    x = table(spark, sf_dir, "labels")
    return x.select(
        F.col("doc_id").alias("contribution_id"),
        F.concat(F.lit("knowledge/doc-"), (F.col("doc_id") % 50).cast("string")).alias("page"),
        F.when(F.col("quality") == 1, "user_confirmed").otherwise("assistant_claimed").alias("authority"),
        _pick(TYPES, F.col("doc_id")).alias("signal_type"),
        F.concat(F.lit("what "), F.col("doc_id").cast("string")).alias("what"),
        (F.lit(1704067200) + F.col("doc_id") * 60).alias("created_s"),
        (F.col("doc_id") % 7).alias("revision"),
        F.concat(F.lit("family-"), F.floor(F.col("doc_id") / 7).cast("string")).alias("family"),
        (F.col("toxic") == 0).alias("active"),
    )


def _people(*keys: Column) -> Column:
    who = lambda k: F.struct(F.concat(F.lit("u"), k.cast("string")).alias("id"), F.concat(F.lit("Name "), k.cast("string")).alias("name"))
    return F.array(*map(who, keys))


#: Values that the derived sources take in turn.
SOURCE_TYPES = ("email", "dm", "group", "document")


def sourced_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with where they come from: platform, source_type, channel, channel_name, author, participants and, for most, a timestamp."""
    i = F.col("doc_id")
    source = F.struct(
        F.col("platform"), _pick(SOURCE_TYPES, i).alias("source_type"), F.col("channel"),
        F.concat(F.lit("room-"), (i % 10).cast("string")).alias("channel_name"), _people(i % 7)[0].alias("author"),
        _people(i % 11, i % 13).alias("participants"), F.when(i % 5 != 0, F.col("created_s") + 3600).alias("timestamp_s"),
    )
    return pages(spark, sf_dir).withColumn("source", source)


def sourced_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions with where they come from."""
    i = F.col("contribution_id")
    source = F.struct(
        F.when(F.col("authority") == "user_confirmed", "en").otherwise("de").alias("platform"), _pick(SOURCE_TYPES, i).alias("source_type"),
        F.concat(F.lit("src"), (i % 20).cast("string")).alias("channel"), F.concat(F.lit("room-"), (i % 10).cast("string")).alias("channel_name"),
        _people(i % 7)[0].alias("author"), _people(i % 17).alias("participants"),
    )
    return contributions(spark, sf_dir).withColumn("source", source)


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of the entity pages and those of contributions to the pages that they are about."""
    c = contributions(spark, sf_dir)
    of = c.select(F.concat(F.lit("signal/"), F.col("contribution_id").cast("string")).alias("src"), F.col("page").alias("dst"), F.lit("mentions").alias("link_type"))
    return links(spark, sf_dir).unionByName(of)


def stream_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of messages: a stream for each direct talk, some of its turns in threads, and one of files: mail, document parts, entries, tasks."""
    c, d = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "documents")
    text = lambda *x: F.concat(*[v.cast("string") for v in x])
    dm = direct_messages(spark, sf_dir).withColumn("conv_id", F.substring_index("channel", "/", -1).cast("long"))
    talk = dm.select(
        F.col("channel").alias("stream"), F.lit("im").alias("platform"), "channel", "at_s", F.col("turn").cast("long").alias("seq"),
        text(F.lit("m"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("msg_id"), F.col("direction").alias("contact"), "content",
        F.when(F.col("conv_id") % 3 == 0, text(F.lit("t"), F.floor(F.col("turn") / 4))).alias("thread"), F.lit(None).cast("string").alias("doc_token"),
    )
    i = F.col("doc_id")
    kind = F.when(i % 4 == 0, "mail/in").when(i % 4 == 1, "docs/space").when(i % 4 == 2, "calendar/main").otherwise("tasks")
    files = d.select(
        F.concat(F.lit("files/"), (F.floor(i / 64)).cast("string")).alias("stream"), F.lit("files").alias("platform"), kind.alias("channel"),
        (F.lit(1704067200) + i * 600).alias("at_s"), i.cast("long").alias("seq"), text(F.lit("d"), i).alias("msg_id"), F.col("source").alias("contact"),
        F.col("text").alias("content"), F.lit(None).cast("string").alias("thread"), F.when(i % 16 != 1, text(F.lit("tok"), F.floor(i / 8))).alias("doc_token"),
    )
    return talk.unionByName(files)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small table of readings, whose entries stand in for those of a whole one; one is not read alone as it is in a pair."""
    said = [("王", "wang"), ("建", "jian"), ("都", "du"), ("都", "dou"), ("李", "li"), ("明", "ming"), ("单", "dan"), ("单于", "chan yu"), ("于", "yu"), ("欧阳", "ou yang"), ("重庆", "chong qing"), ("重", "zhong")]
    return spark.createDataFrame(said, "text string, reading string")


#: Kinds of signals, in the order in which ids take them.
KINDS = ("entity", "decision", "task", "discovery", "knowledge", "preference", "reference", "timeline", "link")


def typed_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions as signals of all kinds, many of them on one page, some of them on pages that are not there."""
    i = F.col("contribution_id")
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (i % 9 + 1).cast("int"))
    facets = {
        "entity": F.when(i % 4 == 0, "project").otherwise("person"), "task": F.when(i % 2 == 0, "done").otherwise("open"), "discovery": F.when(i % 2 == 0, "risk").otherwise("insight"),
        "knowledge": text("topic", i % 3), "preference": F.when(i % 2 == 0, "style").otherwise("tool"), "reference": text("https://x.example/", i % 40), "link": F.when(i % 2 == 0, "part_of").otherwise("owns"),
    }
    facet = F.lit(None).cast("string")
    for k, v in facets.items():
        facet = F.when(kind == k, v).otherwise(facet)
    plan = F.when(i % 10 == 3, text("计划", i % 4)).when(i % 10 == 5, F.lit("计划")).otherwise(text("Plan A", i % 40))
    ends = F.array(text("people/p", i % 23), text("people/p", i * 7 % 31), text("decisions/plan-a", i % 40))
    return contributions(spark, sf_dir).select(
        i.cast("long").alias("seq"), kind.alias("kind"), F.when(kind == "entity", text("people/p", i % 23)).alias("slug"),
        F.when(kind == "entity", text("Name ", i % 23)).when(kind == "timeline", text("Entry ", i % 40)).when(kind != "link", plan).alias("title"),
        F.when(i % 4 != 1, text("because ", i)).alias("detail"), facet.alias("facet"), F.when(i % 3 == 0, "speculative").otherwise("direct").alias("confidence"),
        F.when(kind == "link", F.slice(ends, 1, 2)).when(i % 6 != 5, ends).alias("entities"),
        F.when(i % 5 != 0, F.array(text("A", i % 3), text("B", i % 4))).alias("aliases"), F.when(i % 3 == 0, F.array(F.lit("x"), F.lit("y"))).alias("alternatives"),
        F.date_format(F.timestamp_seconds("created_s"), "yyyy-MM-dd").alias("date"), F.when(i % 8 != 0, F.col("authority")).alias("platform"), text("h", F.floor(i / 300)).alias("source_hash"),
    )


def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that the store has before `typed_signals` come: of every seventh signal, its own or an older one, some edited by users."""
    from engramlake.operators.store import slugs

    x = typed_signals(spark, sf_dir).filter("seq % 7 = 0")
    x = x.withColumn("page", slugs(x)).filter("page IS NOT NULL")
    one = x.groupBy("page").agg(F.min_by(F.struct("seq", "source_hash"), "seq").alias("s")).select("page", "s.*")
    return one.select(
        F.col("page").alias("slug"), F.when(F.col("seq") % 2 == 0, F.col("source_hash")).otherwise("old").alias("source_hash"), (F.col("seq") % 14 == 0).alias("edited"),
        F.array(F.lit("Old"), F.lit("A1")).alias("aliases"), F.when(F.col("seq") % 3 == 0, "before").alias("first_seen"),
    )
