"""Pages merged into others in one call, and what a canonical page derives from its contributions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.operators.identity import named_in
from engramlake.operators.records import repointed
from engramlake.operators.steps import settled

_LIST = "array<string>"


def settled_moves(moves: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(was, now) with chains of moves followed to their ends, and the moves that are refused (was, now, reason).

    A move of a page into itself, of or into a page that is not there, or in a ring is refused; of several moves of one page the first in order of `now` counts, the others are refused.
    Each round doubles the length of the chains that are followed, so what does not come to its end in the logarithm of the moves is in a ring or leads into one.
    """
    there = pages.select(F.col("slug"))
    x = moves.select("was", "now").distinct()
    x = x.join(there.select(F.col("slug").alias("was"), F.lit(True).alias("_a")), "was", "left").join(there.select(F.col("slug").alias("now"), F.lit(True).alias("_b")), "now", "left")
    first = x.filter("_a AND _b AND was <> now").groupBy("was").agg(F.min("now").alias("_first"))
    x = x.join(first, "was", "left")
    reason = F.when(F.col("was") == F.col("now"), "itself").when(F.col("_a").isNull() | F.col("_b").isNull(), "no page").when(F.col("_first") != F.col("now"), "moved elsewhere")
    x = settled(x.select("was", "now", reason.alias("reason")))
    now, bad = x.filter("reason IS NULL").select("was", "now"), x.filter("reason IS NOT NULL")
    one = now
    for _ in range(one.count().bit_length() + 1):
        step = now.select(F.col("was").alias("now"), F.col("now").alias("_next"))
        now = settled(now.join(step, "now", "left").select("was", F.coalesce("_next", "now").alias("now"), F.col("_next").isNotNull().alias("_more")))
        more = now.filter("_more AND was <> now")
        if more.isEmpty():
            break
        now = now.select("was", "now")
    # what still leads to a page that moves is in a ring, or leads into one
    rings = now.join(one.select(F.col("was").alias("now")), "now", "left_semi").select("was")
    bad = bad.unionByName(one.join(rings, "was", "left_semi").withColumn("reason", F.lit("ring")))
    return settled(now.select("was", "now").join(rings, "was", "left_anti")), bad


def merged(tables: Mapping[str, DataFrame], moves: DataFrame) -> dict[str, DataFrame]:
    """The store after pages are merged into others (moves: was, now).

    tables: pages (slug, body, aliases), links (src, dst, link_type ...), entries (slug, date, summary ...), tags (slug, tag), handles (kind, value, slug), cache (external_id,
    display_name). Links, entries and tags of a page that goes are put on the page that stays, unless it has one of that key; links of a page to itself go. Its body goes behind that of the page that stays, under a
    head of its own, in the order of slugs; aliases are those of the page that stays, then of those that go, each followed by its slug. Handles and the cache are pointed on, and the slug becomes a handle. refused: the moves
    that were not made, and why. A page that takes in others gathers their bodies, as a page is one row.
    """
    pages = tables["pages"]
    now, bad = settled_moves(moves, pages)
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    none = F.array().cast(_LIST)
    gone = pages.join(now.select(F.col("was").alias("slug"), "now"), "slug").select("now", "slug", strip(F.coalesce("body", F.lit(""))).alias("body"), F.coalesce("aliases", none).alias("aliases"))
    rows = F.array_sort(F.collect_list(F.struct("slug", "body", "aliases")))
    taken = gone.groupBy(F.col("now").alias("slug")).agg(rows.alias("_in"))
    said = F.transform(F.filter("_in", lambda r: r["body"] != ""), lambda r: F.concat(F.lit("## Merged from "), r["slug"], F.lit("\n\n"), r["body"]))
    body = F.when(F.size(said) > 0, F.concat_ws("\n\n", F.array(F.regexp_replace(F.coalesce("body", F.lit("")), r"\s+$", "")), said)).otherwise(F.col("body"))
    names = F.array_distinct(F.concat(F.coalesce("aliases", none), F.flatten(F.transform("_in", lambda r: F.concat(r["aliases"], F.array(r["slug"]))))))
    stay = pages.join(now.select(F.col("was").alias("slug")), "slug", "left_anti").join(taken, "slug", "left")
    some = F.col("_in").isNotNull()
    kept = stay.withColumns({"body": F.when(some, body).otherwise(F.col("body")), "aliases": F.when(some, names).otherwise(F.col("aliases"))}).drop("_in")
    to = lambda x, c: x.join(now.select(F.col("was").alias(c), F.col("now").alias("_now")), c, "left").withColumn(c, F.coalesce("_now", c)).drop("_now")
    own = now.select(F.lit("slug").alias("kind"), F.col("was").alias("value"), F.col("now").alias("slug"))
    handles = to(tables["handles"], "slug").select("kind", "value", "slug")
    handles = handles.unionByName(own.join(handles, ["kind", "value"], "left_anti"))
    return {
        "pages": kept.select(*pages.columns), "links": repointed(tables["links"], ["src", "dst"], now, ["src", "dst", "link_type"]), "entries": repointed(tables["entries"], ["slug"], now, ["slug", "date", "summary"]),
        "tags": repointed(tables["tags"], ["slug"], now, ["slug", "tag"]), "handles": handles, "cache": to(tables["cache"], "display_name").select(*tables["cache"].columns), "refused": bad,
    }


def rebuilt(pages: DataFrame, contribs: DataFrame, links: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links and timeline of pages (slug, title) after they are derived anew from active contributions (contribution_id, page, active, what, why, entities, day, at_s).

    Links (src, dst, link_type, auto) and entries (slug, date, summary, detail, auto) that were derived (auto) from pages of `pages` go; those that users made stay, and one of the same key is
    overwritten. A page links to each page whose slug or title an entity of its contributions names, but itself; an entry has the contribution's day, its first 200 characters and its reason, and of one
    day and summary the last contribution stands.
    """
    live = contribs.filter("active").join(pages.select(F.col("slug").alias("page")), "page", "left_semi")
    mine = pages.select("slug")
    names = live.select(F.col("page").alias("own"), F.explode("entities").alias("name")).withColumn("name", F.regexp_replace("name", r"^\s+|\s+$", "")).filter("name <> ''")
    named = named_in(names.select(F.col("own").alias("id"), "name", "own").distinct(), pages.select("slug", "title"))
    new = named.select(F.col("id").alias("src"), F.col("slug").alias("dst"), F.lit("mentions").alias("link_type"), F.lit(True).alias("auto"))
    kept = links.join(mine.select(F.col("slug").alias("src"), F.lit(True).alias("_own")), "src", "left").filter(~(F.coalesce("_own", F.lit(False)) & F.col("auto"))).drop("_own")
    keys = ["src", "dst", "link_type"]
    out_links = kept.join(new, keys, "left_anti").select(*keys, "auto").unionByName(new)
    order = F.struct("at_s", "contribution_id")
    summary = F.substring("what", 1, 200)
    made = live.groupBy(F.col("page").alias("slug"), F.col("day").alias("date"), summary.alias("summary")).agg(F.max_by(F.coalesce("why", F.lit("")), order).alias("detail")).withColumn("auto", F.lit(True))
    old = entries.join(mine.withColumn("_own", F.lit(True)), "slug", "left").filter(~(F.coalesce("_own", F.lit(False)) & F.col("auto"))).drop("_own")
    keys = ["slug", "date", "summary"]
    return out_links, old.join(made, keys, "left_anti").select(*keys, "detail", "auto").unionByName(made.select(*keys, "detail", "auto"))
