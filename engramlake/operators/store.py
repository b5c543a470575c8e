"""Typed signals written to the store: one pass that fans out to pages, chunks, tags, links and timeline entries, each with its own rule on conflicts.

Signals are rows of one order (seq): kind, slug (of an entity), title, detail, facet (an entity's type, a task's status, a discovery's type, knowledge's topic, a preference's
category, a reference's address, a link's type), confidence, entities (slugs; of a link its two ends), aliases, alternatives, date, platform, source_hash.

Signals act as if one after the other. A page that has the signal's hash already, or that a user has edited (preferences and references overwrite that), is left alone; a written page has the signal's hash and is
not edited any more. So whether a signal writes depends on the hash of the signal before it on its page alone, which is a window. Links and entries need their pages, from the store or from
an earlier signal; a signal whose link finds no page stops there: its further links, and its entries, are not made.

A null list is empty, a null title gives the hash of nothing as its slug's name, a null detail leaves its section out; equal seq are ordered by kind and title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engramlake.functions import text as T
from engramlake.operators import retrieval as R
from engramlake.operators.steps import settled

#: The folder of each kind's pages, and the days after which one fades (null: never).
FOLDERS = {"decision": "decisions", "task": "tasks", "discovery": "discoveries", "preference": "preferences", "reference": "references"}
HALFLIFE_DAYS = {"entity": None, "decision": 90, "task": 90, "discovery": 90, "knowledge": 365, "preference": 90, "reference": None}
#: Kinds that name their facet as a tag, that link to their entities, and that overwrite what a user has edited.
TAGGED, LINKING, FORCED = ("discovery", "knowledge", "preference"), ("decision", "discovery", "knowledge", "preference", "reference"), ("preference", "reference")

_LIST = "array<string>"


def slugs(signals: DataFrame) -> Column:
    """The slug of a signal's page; null for links and timeline entries."""
    folder = F.create_map(*[F.lit(x) for pair in FOLDERS.items() for x in pair])[F.col("kind")]
    # a lambda variable keeps the title from being worked out for each use
    name = F.transform(F.array(F.coalesce("title", F.lit(""))), T.slugify)[0]
    topic = F.concat(F.lit("knowledge/"), "facet", F.lit("/"), F.substring(F.sha2(F.coalesce("title", F.lit("")), 256), 1, 12))
    return F.when(F.col("kind") == "entity", F.col("slug")).when(F.col("kind") == "knowledge", topic).otherwise(F.concat(folder, F.lit("/"), name))


def _bullets(items: Column, empty: str = "") -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(empty)


def body(aliases: Column) -> Column:
    """The text of a signal's page."""
    kind, title = F.col("kind"), F.concat(F.lit("# "), F.coalesce("title", F.lit("")))

    def part(head: str, content: Column, there: Column) -> Column:
        return F.when(there, F.concat(F.lit(f"## {head}\n\n"), content))

    detail, said = F.coalesce("detail", F.lit("")), F.coalesce("detail", F.lit("")) != ""
    some = F.size("alternatives") > 0
    is_ = lambda *kinds: kind.isin(*kinds)
    aside = F.when(is_("discovery", "preference") & said, F.concat(F.lit("## Detail\n\n"), detail))
    return F.concat_ws(
        "\n\n", F.when(kind != "entity", title), part("Aliases", _bullets(aliases), is_("entity") & (F.size(aliases) > 0)), part("Context", detail, is_("entity")),
        part("Reasoning", detail, is_("decision") & said), part("Alternatives", _bullets(F.col("alternatives")), is_("decision") & some), aside,
        part("Related Entities", _bullets(F.col("entities"), "- (none)"), is_("knowledge")),
        F.when(is_("reference"), F.concat(F.lit("URL: "), F.coalesce("facet", F.lit("")))), part("Summary", detail, is_("reference")),
    )


def steps(signals: DataFrame, pages: DataFrame) -> DataFrame:
    """Page signals with page (their slug), was (the page of the store, if any) and step: speculative, skip or write."""
    lists = {c: F.coalesce(c, F.array().cast(_LIST)) for c in ("entities", "aliases", "alternatives")}
    x = signals.filter(~F.col("kind").isin("timeline", "link")).withColumns(lists).withColumn("page", slugs(signals))
    have = pages.select(F.col("slug").alias("page"), F.struct("source_hash", "edited", F.coalesce("aliases", F.array().cast(_LIST)).alias("aliases"), "first_seen").alias("was"))
    x = x.join(have, "page", "left").withColumn("vague", (F.col("kind") == "knowledge") & F.coalesce(F.col("confidence") == "speculative", F.lit(False)))
    order = W.partitionBy("page", "vague").orderBy("seq", "kind", "title")
    first = F.row_number().over(order) == 1
    before = F.when(first, F.col("was.source_hash")).otherwise(F.lag("source_hash").over(order))
    same = ~(first & F.col("was").isNull()) & before.eqNullSafe(F.col("source_hash"))
    kept = F.coalesce(F.col("was.edited"), F.lit(False)) & ~F.col("kind").isin(*FORCED)
    return x.withColumn("step", F.when(F.col("vague"), "speculative").when(same | kept, "skip").otherwise("write")).drop("vague")


def _aliases(wrote: DataFrame) -> DataFrame:
    """page, names: the aliases that a person's page ends with. A signal without aliases drops those before it; each alias stands where it came first."""
    order = W.partitionBy("page").orderBy(F.desc("seq"), F.desc("kind"), F.desc("title"))
    bare = F.when(F.size("aliases") == 0, 1).otherwise(0)
    # signals after the last one without aliases
    x = wrote.filter("kind = 'entity' AND facet = 'person'").withColumn("_cut", F.sum(bare).over(order)).filter("_cut = 0")
    every = wrote.filter("kind = 'entity' AND facet = 'person'").groupBy("page").agg(F.min(F.size("aliases")).alias("least"), F.first("was").alias("was"))
    old = every.filter("least > 0").select("page", F.posexplode("was.aliases").alias("at", "name"), F.lit(None).cast("long").alias("seq"))
    new = x.select("page", F.posexplode("aliases").alias("at", "name"), "seq")
    place = F.struct("seq", "at")
    each = old.unionByName(new).groupBy("page", "name").agg(F.min(place).alias("place"))
    rows = F.array_sort(F.collect_list(F.struct("place", "name")))
    return each.groupBy("page").agg(rows["name"].alias("names"))


def written_pages(wrote: DataFrame) -> DataFrame:
    """The pages that the signals leave: slug, type, title, body, source_hash, first_seen, halflife_days and whether it expires now."""
    seen = F.when(F.col("kind") == "entity", F.concat_ws(":", "platform", "source_hash"))
    last = F.max_by(F.struct(*[c for c in wrote.columns if c != "was"]), F.struct("seq", "kind", "title")).alias("s")
    x = wrote.groupBy("page").agg(last, F.min_by(seen, F.struct("seq", "kind", "title")).alias("seen"), F.first("was").alias("was"))
    x = x.select("s.*", F.coalesce("was.first_seen", "seen").alias("first_seen")).join(_aliases(wrote), "page", "left")
    names = F.when((F.col("facet") == "person") & (F.size("aliases") > 0), F.col("names"))
    kind = F.col("kind")
    days = F.create_map(*[F.lit(v).cast("int") if k % 2 else F.lit(v) for pair in HALFLIFE_DAYS.items() for k, v in enumerate(pair)])
    type_ = F.when(kind == "entity", F.col("facet")).when(kind == "discovery", F.concat(F.lit("discovery-"), "facet")).otherwise(kind)
    title = F.when(kind == "knowledge", F.substring("title", 1, 80)).otherwise(F.col("title"))
    return x.select(
        F.col("page").alias("slug"), type_.alias("type"), title.alias("title"), body(F.coalesce(names, F.array().cast(_LIST))).alias("body"), "source_hash",
        F.when(kind == "entity", F.col("first_seen")).alias("first_seen"), days[kind].alias("halflife_days"), ((kind == "task") & F.coalesce(F.col("facet") == "done", F.lit(False))).alias("expires_now"),
    )


def _targets(signals: DataFrame, wrote: DataFrame, pages: DataFrame) -> DataFrame:
    """The slugs that signals refer to, in order, and whether a page is there for each when the signal comes."""
    born = pages.select("slug", F.lit(None).cast("long").alias("born")).unionByName(wrote.groupBy(F.col("page").alias("slug")).agg(F.min("seq").alias("born")))
    born = born.groupBy("slug").agg(F.min(F.coalesce("born", F.lit(-(2**62)))).alias("born"))
    more = signals.filter(F.col("kind").isin("timeline", "link")).withColumn("page", F.lit(None).cast("string"))
    columns = ["seq", "kind", "page", "title", "detail", "facet", "entities", "date", "platform", "source_hash"]
    every = wrote.filter(F.col("kind").isin(*LINKING)).select(*columns).unionByName(more.select(*columns))
    every = every.select("*", F.posexplode_outer("entities").alias("place", "target")).drop("entities")
    return every.join(born.withColumnRenamed("slug", "target"), "target", "left").withColumn("there", F.coalesce(F.col("born") <= F.col("seq"), F.lit(False))).drop("born")


def store(signals: DataFrame, pages: DataFrame, links: DataFrame, entries: DataFrame) -> dict[str, DataFrame]:
    """What signals make of a store (pages: slug, source_hash, edited, aliases, first_seen; links: src, dst, link_type, provenance, source_hash; entries: slug, date, summary, provenance).

    pages, chunks, tags, links and entries hold the rows that are written (they replace those of their key); outcome has a row for each signal: written, skipped and failed parts.
    """
    stepped = settled(steps(signals, pages))
    wrote = stepped.filter("step = 'write'")
    made = written_pages(wrote)
    tags = F.when(F.col("kind").isin(*TAGGED), F.array("kind", "facet")).otherwise(F.array("kind"))
    tagged = wrote.select(F.col("page").alias("slug"), F.explode(tags).alias("tag")).filter("tag IS NOT NULL").distinct()

    aims = _targets(signals, wrote, pages)
    gap = F.min(F.when(~F.col("there"), F.col("place"))).over(W.partitionBy("seq", "kind", "title"))
    aims = aims.filter("place IS NOT NULL").withColumn("gap", gap)
    order = F.struct("seq", "place")
    mention = aims.filter(F.col("kind").isin(*LINKING) & (F.col("gap").isNull() | (F.col("place") < F.col("gap"))))
    mention = mention.select(F.col("page").alias("src"), F.col("target").alias("dst"), F.lit("mentions").alias("link_type"), F.concat(F.lit("Referenced in "), "kind").alias("context"), "platform", "source_hash", order.alias("order"))
    ends = aims.filter("kind = 'link' AND gap IS NULL").groupBy("seq", "title").agg(F.min_by("target", "place").alias("src"), F.max_by("target", "place").alias("dst"), *[F.first(c).alias(c) for c in ("facet", "detail", "platform", "source_hash")])
    linked = ends.select("src", "dst", F.col("facet").alias("link_type"), F.coalesce("detail", F.lit("")).alias("context"), "platform", "source_hash", F.struct("seq", F.lit(0).alias("place")).alias("order"))
    kept = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("order"))).alias(c)
    keys = ["src", "dst", "link_type"]
    new = mention.unionByName(linked).groupBy(*keys).agg(F.max_by("context", "order").alias("context"), kept("platform"), kept("source_hash"))
    old = links.select(*keys, F.col("provenance").alias("_p"), F.col("source_hash").alias("_h"))
    new_links = new.join(old, keys, "left").select(*keys, "context", F.coalesce("platform", "_p").alias("provenance"), F.coalesce("source_hash", "_h").alias("source_hash"))

    dated = aims.filter("kind = 'timeline' AND there OR kind = 'decision' AND gap IS NULL")
    decided = F.col("kind") == "decision"
    dated = dated.select(
        F.col("target").alias("slug"), "date", F.when(decided, F.concat(F.lit("Decision: "), "title")).otherwise(F.col("title")).alias("summary"),
        F.when(decided, F.coalesce("detail", F.lit(""))).otherwise("").alias("detail"), F.coalesce("platform", F.lit("")).alias("source"), F.concat_ws(":", "platform", "source_hash").alias("provenance"), order.alias("order"),
    )
    keys = ["slug", "date", "summary"]
    new = dated.groupBy(*keys).agg(F.max_by("detail", "order").alias("detail"), F.max_by("source", "order").alias("source"), kept("provenance"))
    new_entries = new.join(entries.select(*keys, F.col("provenance").alias("_p")), keys, "left").withColumn("provenance", F.coalesce("provenance", "_p")).drop("_p")

    whole = F.when(F.col("kind") == "timeline", F.count(F.when(F.col("there"), 1))).otherwise(F.when(F.max("gap").isNull(), 1).otherwise(0))
    lost = F.when(F.col("kind") == "timeline", F.count(F.when(~F.col("there"), 1))).otherwise(F.when(F.max("gap").isNull(), 0).otherwise(1))
    ends = aims.groupBy("seq", "kind", "title").agg(whole.alias("written"), lost.alias("failed"))
    each = signals.select("seq", "kind", "title").join(stepped.select("seq", "kind", F.col("title").alias("_t"), "step"), ["seq", "kind"], "left").filter(F.col("title").eqNullSafe(F.col("_t")) | F.col("step").isNull()).drop("_t")
    at = ends.select(F.col("seq").alias("_s"), F.col("kind").alias("_k"), F.col("title").alias("_t"), "written", "failed")
    each = each.join(at, (F.col("seq") == F.col("_s")) & (F.col("kind") == F.col("_k")) & F.col("title").eqNullSafe(F.col("_t")), "left")
    skip = F.coalesce(F.col("step") != "write", F.lit(False))
    alone = F.when(F.col("kind").isin("timeline", "link"), 0).otherwise(1)
    outcome = each.select("seq", "kind", F.when(skip, 0).otherwise(F.coalesce("written", alone)).cast("long").alias("written"), skip.cast("long").alias("skipped"), F.when(skip, 0).otherwise(F.coalesce("failed", F.lit(0))).cast("long").alias("failed"))
    return {"pages": made, "chunks": R.chunks(made, "slug"), "tags": tagged, "links": new_links, "entries": new_entries, "outcome": outcome}
