"""Row rules and small ledgers: noise gates, block scores, transitions, plans, diffs, wikilinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engramlake.functions import messages as M
from engramlake.functions import text as T

#: Relations that a wikilink may name; any other is typed `custom`.
RELATIONS = (
    "works_on", "works_at", "reports_to", "collaborates", "depends_on", "mentions", "approves", "uses", "part_of", "precedes", "next",
    "escalates_to", "custom",
)
BACKOFF_S, BACKOFF_MOST_S = 300, 21600
#: Words of system notices, of red packets, of decisions and of tasks; patterns of automatic mail.
SYSTEM_WORDS = ("加入群聊", "退出群聊", "撤回了一条消息", "修改群名为", "邀请", "移出了群聊", "你已添加")
RED_PACKETS = ("[红包]", "[转账]", "收到红包", "收到转账")
DECISION_WORDS = ("确定", "同意", "方案", "决定", "批准", "通过", "采用")
TASK_WORDS = ("负责", "deadline", "截止", "完成时间", "交付", "你来", "你做", "分配给")
MAIL_SKIPS = r"(?i)auto[- ]?reply|out of office|自动回复|会议取消|会议已取消"
#: Fixed value: the ranges of emoji.
EMOJI = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}"
    r"\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{FE0F}]"
)
#: Scores of sources and of interactions.
SOURCE_SCORES = {
    "email": 0.9, "document": 0.9, "calendar": 0.8, "task": 0.8, "structured": 0.8, "dm": 0.7, "group": 0.6, "agent_session": 0.6, "chat": 0.5,
}
TAG_SCORES = {"sent": 0.6, "reply": 0.5, "dm": 0.6}
ADMIT, DROP, SHORT = 0.85, 0.15, 20
#: The states of a session revision and those that each may become.
TRANSITIONS = {
    "discovered": ("distilled", "retrying"), "distilled": ("applying", "retrying"), "applying": ("done", "retrying"),
    "retrying": ("distilled", "dead_letter"), "done": (), "dead_letter": (),
}


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def emoji_only(content: Column) -> Column:
    """Nothing but emoji and white space, and not nothing at all."""
    bare = F.regexp_replace(F.regexp_replace(content, EMOJI, ""), r"\s+", "")
    return (bare == "") & (F.trim(F.regexp_replace(content, r"\s+", " ")) != "")


def noise(channel: Column, contents: Column) -> Column:
    """skip, escalate or evaluate for a block of messages (an array of contents), before any model is asked. Null contents are empty."""
    contents = F.transform(contents, lambda c: F.coalesce(c, F.lit("")))
    text = F.array_join(contents, " ")
    channel = F.coalesce(channel, F.lit(""))
    mail = F.when(text.rlike(MAIL_SKIPS), "skip").when(_any(text, DECISION_WORDS), "escalate").otherwise("evaluate")
    through = channel.startswith("docs/") | channel.startswith("calendar/") | (channel == "tasks")
    skip = _any(text, SYSTEM_WORDS) | _any(text, RED_PACKETS) | F.forall(contents, emoji_only)
    return (
        F.when(channel.startswith("mail/"), mail).when(through, "evaluate").when(skip, "skip")
        .when(_any(text, DECISION_WORDS) | _any(text, TASK_WORDS), "escalate").otherwise("evaluate")
    )


def interaction_tags(source_type: Column, sent: Column, sent_in_thread: Column) -> Column:
    """Array of sent, reply and dm: a block holds a sent message; it is mail and one sent is in a thread; it is a direct talk."""
    none = F.lit(None).cast("string")
    return F.array_compact(F.array(
        F.when(sent, "sent").otherwise(none), F.when((source_type == "email") & sent_in_thread, "reply").otherwise(none),
        F.when(source_type == "dm", "dm").otherwise(none),
    ))


def block_score(text: Column, source_type: Column, tags: Column) -> Column:
    """Struct of the combined score of a block's canonical text (weights 1, 1, 1.5, 3, 1), its parts, and its decision."""
    known = F.create_map(*[F.lit(x) for kv in SOURCE_SCORES.items() for x in kv])
    each = F.create_map(*[F.lit(x) for kv in TAG_SCORES.items() for x in kv])
    parts = F.struct(T.token_estimate(text).alias("tokens"), F.size(M.entities(text)).alias("entities"), T.word_ratio(text).alias("words"))

    def scored(p: Column) -> Column:
        return F.struct(p.alias("p"), T.token_score(p["tokens"]).alias("token"), T.ratio_score(p["words"]).alias("ratio"))

    def judged(x: Column) -> Column:
        p, token, ratio = x["p"], x["token"], x["ratio"]
        source = F.coalesce(F.try_element_at(known, source_type), F.lit(0.5))
        interaction = F.when(F.size(tags) == 0, 0.5).otherwise(
            F.least(F.lit(1.0), F.aggregate(tags, F.lit(0.0), lambda t, x: t + F.coalesce(F.try_element_at(each, x), F.lit(0.0))))
        )
        density = F.when(p["tokens"] == 0, 0.0).otherwise(F.least(F.lit(1.0), p["entities"] / (p["tokens"] / 100)))
        combined = (token + ratio + 1.5 * source + 3 * interaction + density) / 7.5
        kept = source_type.isin("email", "document", "structured")
        short = (p["tokens"] < SHORT) & (p["entities"] == 0) & (F.size(tags) == 0) & ~kept
        decision = F.when(short | (combined <= DROP), "drop").when(combined >= ADMIT, "admit").otherwise("evaluate")
        return F.struct(
            token.alias("token"), ratio.alias("ratio"), source.alias("source"), interaction.alias("interaction"), density.alias("density"),
            combined.alias("combined"), decision.alias("decision"), short.alias("short"),
        )

    # lambda variables keep what is taken from the text from being made for each use
    return F.transform(F.transform(F.array(parts), scored), judged)[0]


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def transitions(rows: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """How often each state follows each other one, by key, and whether it may. States that are not known may follow nothing."""
    was = F.lag(state).over(W.partitionBy(key).orderBy(order))
    x = rows.select(F.col(state).alias("state"), was.alias("was")).filter(F.col("was").isNotNull())
    may = [(F.col("was") == a) & F.col("state").isin(*to) for a, to in TRANSITIONS.items() if to]
    x = x.groupBy("was", "state").agg(F.count(F.lit(1)).alias("n"))
    return x.withColumn("allowed", F.coalesce(reduce(lambda a, b: a | b, may), F.lit(False)))


def backoff(failures: Column) -> Column:
    return F.least(F.lit(BACKOFF_S) * F.pow(F.lit(2.0), failures), F.lit(float(BACKOFF_MOST_S))).cast("long")


def first_rows(rows: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key, with their place."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= k)


def planned_action(admitted: Column, action: Column, target: Column, pool: Column) -> Column:
    """Struct (action, target, reason) of a decided action on a candidate pool (an array of slugs).

    A signal that is not admitted does nothing. UPDATE, SUPERSEDE and LINK_EXISTING need a target from the pool, or become NEW.
    """
    none = F.lit(None).cast("string")
    bound = action.isin("UPDATE", "SUPERSEDE", "LINK_EXISTING")
    inside = F.coalesce(F.array_contains(pool, target), F.lit(False))
    says = lambda a, t, why: F.struct(a.alias("action"), t.alias("target"), F.lit(why).alias("reason"))
    return (
        F.when(~admitted, says(F.lit("NOOP"), none, "not admitted")).when(bound & ~inside, says(F.lit("NEW"), none, "target not in pool"))
        .when(action == "NOOP", says(action, none, "decided")).otherwise(says(action, F.when(bound, target).otherwise(none), "decided"))
    )


def changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed, changed or same, for every key of either side."""
    a = old.select(F.col(key), F.col(value).alias("_was"), F.lit(True).alias("_old"))
    b = new.select(F.col(key), F.col(value).alias("_now"), F.lit(True).alias("_new"))
    x = a.join(b, key, "full")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
    return x.select(key, kind.when(F.col("_was").eqNullSafe(F.col("_now")), "same").otherwise("changed").alias("change"))


def url_kind(pages: DataFrame) -> DataFrame:
    """Host and language section of each URL, and the kind of document it stands for."""
    host, section = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.regexp_extract("url", "^[a-z]+://[^/?#]*/([a-z][a-z])/", 1)
    x = pages.select("page_id", host.alias("host"), section.alias("section"))
    kind = F.when(F.col("section") == "", "reject").when(F.col("host").like("%.example.net"), "wiki_node").otherwise("docx")
    return x.withColumn("kind", kind)


def wikilinks(pages: DataFrame) -> DataFrame:
    """(slug, rel, target) of the links `[[target]]` and `[[rel:target]]` in page bodies. White space around both is dropped,
    links without a target are left out, an unknown relation is `custom`."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    each = pages.select("slug", F.explode(F.regexp_extract_all("body", F.lit(r"\[\[([^\]]+)\]\]"), 1)).alias("l"))
    named = F.col("l").contains(":")
    rel = strip(F.substring_index("l", ":", 1))
    rel = F.when(~named, "mentions").when(rel.isin(*RELATIONS), rel).otherwise("custom")
    target = F.when(named, F.substr("l", F.instr("l", ":") + 1, F.length("l"))).otherwise(F.col("l"))
    return each.select("slug", rel.alias("rel"), strip(target).alias("target")).filter("target <> ''").distinct()


def session_context(pages: DataFrame, as_of_s: int, days: int = 7) -> DataFrame:
    """The lists of a session's opening digest: section, place, slug, title. Pages: slug, type, title, updated_s, status.

    Of projects and decisions the newest five, those of the last days (three of the decisions); of the newest fifty tasks the open ones (five);
    of the newest ten preferences three; the newest five persons. Each section is a top-k by its own order.
    """
    lists = (("project", 5, 5), ("decision", 5, 3), ("task", 50, 5), ("preference", 10, 3), ("person", 5, 5))
    w = W.partitionBy("type").orderBy(F.desc("updated_s"), "slug")
    x = pages.filter(F.col("type").isin(*[t for t, _, _ in lists])).withColumn("_k", F.row_number().over(w)).filter("_k <= 50")
    fetched = reduce(lambda a, b: a | b, [(F.col("type") == t) & (F.col("_k") <= n) for t, n, _ in lists])
    recent = ~F.col("type").isin("project", "decision") | (F.col("updated_s") >= as_of_s - days * 86400)
    opened = (F.col("type") != "task") | F.coalesce(F.col("status") == "open", F.lit(False))
    x = x.filter(fetched & recent & opened).withColumn("place", F.row_number().over(W.partitionBy("type").orderBy("_k")))
    shown = reduce(lambda a, b: a | b, [(F.col("type") == t) & (F.col("place") <= n) for t, _, n in lists])
    return x.filter(shown).select(F.col("type").alias("section"), "place", "slug", "title")
