"""Ledgers and upserts: latest revisions, contributions, page merges, tier rotation, quality metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engramlake.functions import messages as M
from engramlake.operators.readings import person_slugs
from engramlake.operators.steps import positions, settled

#: Days after which a hot page expires by type, and the types that are never compressed.
HALFLIFE = {"decision": 365, "task": 30, "knowledge": 180, "preference": 90, "reference": 365}
#: Pages that one warm page takes in.
MEMBERS = 200
COLD_DAYS = {"task": 365, "preference": 365, "knowledge": 730}


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the order given."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows with those of the new ones that share a key in their place."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def status(new: DataFrame, known: DataFrame, key: str, value: str) -> DataFrame:
    """new, modified or unchanged, by a checkpoint of (key, value)."""
    k = known.select(F.col(key), F.col(value).alias("_was"))
    x = new.join(k, key, "left")
    s = F.when(F.col("_was").isNull(), "new").when(F.col("_was") == F.col(value), "unchanged").otherwise("modified")
    return x.withColumn("status", s).drop("_was")


def active_contributions(contribs: DataFrame) -> DataFrame:
    """Of each family the newest revision that is active."""
    return latest(contribs.filter("active"), ["family"], F.desc("revision"), F.desc("contribution_id"))


def rematerialize(contribs: DataFrame) -> DataFrame:
    """The body of each page from its active contributions, in order of creation."""
    line = F.concat(
        F.lit("- **["), F.col("signal_type"), F.lit("]** "), F.col("what"),
        F.when(F.col("authority") != "user_confirmed", F.concat(F.lit(" _("), F.col("authority"), F.lit(")_"))).otherwise(""),
    )
    rows = F.array_sort(F.collect_list(F.struct("created_s", "contribution_id", line.alias("line"))))
    return contribs.groupBy("page").agg(F.count(F.lit(1)).alias("parts"), F.array_join(rows["line"], "\n").alias("body"))


def primary(contribs: DataFrame) -> DataFrame:
    """The contribution that a page cites first: a confirmed one, else the earliest."""
    order = F.struct(F.col("authority") != "user_confirmed", F.col("created_s"), F.col("contribution_id"))
    return contribs.groupBy("page").agg(F.min_by("contribution_id", order).alias("primary_id"))


def running_budget(rows: DataFrame, group: list[str], order: list[Column], cost: Column, budget: int, salts: int = 64) -> DataFrame:
    """The prefix of each group that fits a budget, and always its first row. Costs are not negative; a null one is nothing.

    A group is first cut in `salts` parts, of which each keeps its rows up to the one that alone goes beyond the budget: of a large
    group, only about so many budgets of rows meet, and their running sums are those of all rows as far as the budget goes.
    """
    names = rows.columns

    def running(x: DataFrame, keys: list) -> DataFrame:
        w = W.partitionBy(*keys).orderBy(*order)
        return x.withColumn("spent", F.sum(cost).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("place", F.row_number().over(w))

    part = running(rows, [*group, F.pmod(F.xxhash64(*names), F.lit(salts))])
    part = part.filter(F.coalesce(F.col("spent") - F.coalesce(cost, F.lit(0)), F.lit(0)) <= budget).select(*names)
    return running(part, group).filter((F.col("spent") <= budget) | (F.col("place") == 1))


def titles(pages: DataFrame) -> DataFrame:
    """The distinct titles of a type: type, title, pages (how many have it) and head, the least slug of them."""
    return pages.groupBy("type", "title").agg(F.count(F.lit(1)).alias("pages"), F.min("slug").alias("head"))


def near_titles(pages: DataFrame) -> DataFrame:
    """Pairs of unlike titles of a type (4 characters or more) that are alike in any case: an edit distance of at most 1, or 2 from 8 on.

    Titles are compared once, however many pages have them; `titles` tells who they are, and each side comes with its head. A title of
    length n is cut into three parts; a longer one of length m within two edits has one of them unchanged, `off` places on: the edits before it are |off| at least, those
    after it |off - (m - n)|, so both come to two at most. Hashes of those parts are the join keys, with numbers for titles; the distance is then verified.

    Every join is merged, so none is held by the driver: Spark takes the size of the titles' compressed table for the size of the 27 keys and more that a title has.
    """
    x = titles(pages.filter(F.length("title") >= 4)).select("type", "title", "head", F.lower("title").alias("t"))
    x = settled(x.withColumn("n", F.length("t")).withColumn("id", F.monotonically_increasing_id()))
    cut = lambda n, i: F.floor(i * n / 3).cast("int")
    size = cut(F.col("n"), F.col("i") + 1) - cut(F.col("n"), F.col("i"))
    thirds = F.explode(F.array(*map(F.lit, range(3)))).alias("i")
    key = lambda at: F.xxhash64("type", "n", "i", F.substr("t", at + 1, size)).alias("key")
    own = x.select("*", thirds).select(key(cut(F.col("n"), F.col("i"))), F.col("id").alias("id_a"))
    shifts = [(d, off) for d in range(3) for off in range(-2, 3) if abs(off) + abs(off - d) <= 2]
    other = x.withColumnRenamed("n", "m").select("*", F.inline(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(off).alias("off")) for d, off in shifts])))
    # a title shorter than four characters is no side, and a part of no characters no key that is missed
    other = other.withColumn("n", F.col("m") - F.col("d")).filter("n >= 4").select("*", thirds).withColumn("at", F.col("off") + cut(F.col("n"), F.col("i")))
    other = other.filter((F.col("at") >= 0) & (F.col("at") + size <= F.col("m"))).select(key(F.col("at")), F.col("id").alias("id_b"))
    met = own.join(other.hint("merge"), "key").filter(F.col("id_a") != F.col("id_b"))
    met = met.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
    side = lambda s: x.select(F.col("id").alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("type", "title", "t", "head")])
    # a hash may stand for two types or parts
    pair = met.join(side("a").hint("merge"), "id_a").join(side("b").hint("merge"), "id_b").filter((F.col("type_a") == F.col("type_b")) & (F.col("title_a") != F.col("title_b")))
    most = F.when(F.least(F.length("t_a"), F.length("t_b")) >= 8, 2).otherwise(1)
    pair = pair.filter(F.levenshtein("t_a", "t_b") <= most)
    first = F.col("title_a") < F.col("title_b")
    sides = [F.when(first == low, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(f"{c}_{p}") for c in ("title", "head") for p, low in (("a", True), ("b", False))]
    return pair.select(F.col("type_a").alias("type"), *sides).select("type", "title_a", "title_b", "head_a", "head_b")


def merge_suggestions(pages: DataFrame, person: str = "person", readings: DataFrame | None = None) -> DataFrame:
    """type, from, into, reason: pages that may be one. The first reason that a pair has counts, and `into` is its lesser slug.

    same_name: a page with the head of its title; levenshtein: the heads of near titles; pinyin: persons with the least slug whose name has
    the same canonical slug, which names in CJK characters have through the readings (text, reading).
    """
    named = pages.filter("title <> ''")
    least = lambda x, y: (F.greatest(x, y).alias("from"), F.least(x, y).alias("into"))
    heads = titles(named).filter("pages > 1").select("type", "title", "head")
    same = named.join(heads.hint("merge"), ["type", "title"]).filter(F.col("slug") != F.col("head")).select("type", *least(F.col("slug"), F.col("head")), F.lit(0).alias("r"))
    near = near_titles(named).select("type", *least(F.col("head_a"), F.col("head_b")), F.lit(1).alias("r"))
    people = named.filter(F.col("type") == person)
    slugs = person_slugs(people.select(F.col("title").alias("name")), readings).select(F.col("name").alias("title"), F.col("slug").alias("name"))
    people = people.join(slugs.hint("merge"), "title").filter("name IS NOT NULL")
    firsts = people.groupBy("name").agg(F.min("slug").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    alike = people.join(firsts.hint("merge"), "name").filter(F.col("slug") != F.col("head")).select("type", *least(F.col("slug"), F.col("head")), F.lit(2).alias("r"))
    every = same.unionByName(near).unionByName(alike).groupBy("type", "from", "into").agg(F.min("r").alias("r"))
    reason = F.element_at(F.array(*map(F.lit, ("same_name", "levenshtein", "pinyin"))), F.col("r") + 1)
    return every.select("type", "from", "into", reason.alias("reason"))


def warm_members(pages: DataFrame, mentions: DataFrame, as_of_s: int, most: int = MEMBERS) -> DataFrame:
    """Expired hot pages and the warm page (entity, type, part) that takes the place of each, to which it points from then on.

    Pages (slug, type, title, body, tier, created_s, edited) whose type may be compressed and that nobody edited are grouped by their primary
    mention (mentions: slug, to; the least `to`, or none) and type, and a group is cut into parts of `most` pages in the order of their times. Only slugs and times are ranked, over
    range partitions, so a group of any size, such as that of the pages without a mention, is spread. Other expired pages only change their tier (`only_tier`).
    """
    primary = mentions.groupBy("slug").agg(F.min("to").alias("entity"))
    x = expired(pages, as_of_s).filter(F.col("type").isin(*COLD_DAYS) & ~F.coalesce(F.col("edited"), F.lit(False))).join(primary, "slug", "left")
    group = F.struct(F.coalesce("entity", F.lit("__none__")).alias("entity"), "type").alias("group")
    ranked = positions(x.select(group, "created_s", "slug"), "group", "created_s", "slug")
    return ranked.select("slug", "group.*", F.floor(F.col("pos") / most).alias("part"))


def hot_to_warm(pages: DataFrame, mentions: DataFrame, as_of_s: int, most: int = MEMBERS) -> DataFrame:
    """The warm pages that take the place of expired hot ones: entity, type, part, members, content, created_s; one holds `most` pages at most (`warm_members`)."""
    of = warm_members(pages, mentions, as_of_s, most)
    x = pages.select("slug", "title", "body", "created_s").join(of, "slug")
    text = F.concat(F.lit("### "), "title", F.lit("\n\n"), "body")
    rows = F.array_sort(F.collect_list(F.struct("created_s", "slug", text.alias("text"))))
    return x.groupBy("entity", "type", "part").agg(
        F.count(F.lit(1)).alias("members"), F.array_join(rows["text"], "\n\n").alias("content"), F.min("created_s").alias("created_s")
    )


def only_tier(pages: DataFrame, as_of_s: int) -> DataFrame:
    """The expired hot pages that become warm as they are."""
    return expired(pages, as_of_s).filter(~F.col("type").isin(*COLD_DAYS) | F.coalesce(F.col("edited"), F.lit(False)))


def expired(pages: DataFrame, as_of_s: int) -> DataFrame:
    """Hot pages whose time by type is over."""
    days = F.create_map(*[F.lit(x) for kv in HALFLIFE.items() for x in kv])
    return pages.filter((F.col("tier") == "hot") & (F.col("created_s") + 86400 * F.try_element_at(days, F.col("type")) <= as_of_s))


def metric_stats(runs: DataFrame) -> DataFrame:
    """Mean and population variance of miss and noise rates over runs (run, matched, missed, extra); rates over nothing are 0."""
    over = lambda n, of: F.when(of > 0, n / of).otherwise(F.lit(0.0))
    miss = over(F.col("missed"), F.col("matched") + F.col("missed"))
    noise = over(F.col("extra"), F.col("matched") + F.col("extra"))
    x = runs.select(miss.alias("miss"), noise.alias("noise"))
    return x.agg(*[F.round(f(c), 6).alias(f"{c}_{name}") for c in ("miss", "noise") for name, f in (("mean", F.mean), ("variance", F.var_pop))])


def duplicate_rate(groups: DataFrame) -> DataFrame:
    """Pages beyond the first of their group over all pages (groups: pages)."""
    n = F.sum("pages")
    return groups.agg(F.when(n > 0, F.round(F.sum(F.greatest(F.col("pages") - 1, F.lit(0))) / n, 6)).otherwise(F.lit(0.0)).alias("dup_rate"))


def quality_metrics(golden: DataFrame, output: DataFrame) -> DataFrame:
    """Miss rate and noise rate of an output against what should be there (key columns: session, item)."""
    hit = golden.join(output.withColumn("found", F.lit(1)), ["session", "item"], "full")
    hit = hit.select("wanted", "found")
    miss = F.sum(F.when(F.col("wanted").isNotNull() & F.col("found").isNull(), 1).otherwise(0))
    noise = F.sum(F.when(F.col("wanted").isNull() & F.col("found").isNotNull(), 1).otherwise(0))
    return hit.agg(
        F.round(miss / F.count("wanted"), 6).alias("miss_rate"), F.round(noise / F.count("found"), 6).alias("noise_rate")
    )


def resolve(names: DataFrame, handles: DataFrame, cache: DataFrame) -> DataFrame:
    """Slug of each key by the first step of a ladder that knows it: a handle, then the cache, then the key itself."""
    h, c = handles.select("key", F.col("slug").alias("_h")), cache.select("key", F.col("slug").alias("_c"))
    x = names.join(h, "key", "left").join(c, "key", "left")
    step = F.when(F.col("_h").isNotNull(), "handle").when(F.col("_c").isNotNull(), "cache").otherwise("new")
    return x.select("key", F.coalesce("_h", "_c", F.concat(F.lit("person/"), "key")).alias("slug"), step.alias("step"))


def fingerprints(chunks: DataFrame, provider: str, model: str, dims: int) -> DataFrame:
    """Chunks by the embedding that they have (`provider:model:dims`), and whether it is the one in use: others must not be mixed with it."""
    want = f"{provider}:{model}:{dims}"
    return chunks.groupBy("have").agg(F.count(F.lit(1)).alias("chunks")).withColumn("usable", F.col("have") == want)


def derived_parts(pages: DataFrame, contribs: DataFrame) -> DataFrame:
    """What a page derives from its active contributions: how many, the tags of their types, the first day and the primary one's authority. None: orphaned."""
    live = contribs.filter("active")
    day = F.min(F.date_format(F.timestamp_seconds("created_s"), "yyyy-MM-dd"))
    first = F.min_by("authority", F.struct(F.col("authority") != "user_confirmed", F.col("created_s"), F.col("contribution_id")))
    of = live.groupBy(F.col("page").alias("slug")).agg(
        F.count(F.lit(1)).alias("active"), F.array_join(F.array_sort(F.collect_set("signal_type")), ",").alias("tags"), day.alias("first_day"), first.alias("source")
    )
    x = pages.select("slug").join(of, "slug", "left")
    return x.select("slug", F.col("active").isNull().alias("orphaned"), F.coalesce("active", F.lit(0)).alias("active"), "tags", "first_day", "source")
