"""Identities: handles, slugs that move, entities that names may bind to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.functions import messages as M
from engramlake.operators.readings import person_slugs


def rewritten(rows: DataFrame, key: str, column: str, moves: DataFrame) -> DataFrame:
    """An array of slugs with those that moved replaced (moves: was, now), each slug once, in order of first place.

    The key names the rows; a row whose array is empty stays. The moves are joined, so they may be many.
    """
    slugs = rows.select(key, F.posexplode(column).alias("_at", "was")).join(moves.select("was", "now"), "was", "left")
    now = slugs.groupBy(key, F.coalesce("now", "was").alias("slug")).agg(F.min("_at").alias("at"))
    lists = now.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "slug")))["slug"].alias("_now"))
    out = rows.join(lists, key, "left")
    return out.withColumn(column, F.coalesce("_now", F.array().cast("array<string>"))).drop("_now")


def rename(rows: DataFrame, column: str, moves: DataFrame) -> DataFrame:
    """A column of slugs with those that moved replaced."""
    x = rows.join(moves.select(F.col("was").alias(column), "now"), column, "left")
    return x.select(*[F.coalesce("now", column).alias(c) if c == column else F.col(f"`{c}`") for c in rows.columns])


def aliases(kept: DataFrame, gone: DataFrame) -> DataFrame:
    """slug, aliases: of each page those it had and those of the pages merged into it (gone: into, slug, aliases)."""
    old = kept.select("slug", F.explode("aliases").alias("a"))
    new = gone.select(F.col("into").alias("slug"), F.explode(F.array_append("aliases", F.col("slug"))).alias("a"))
    return old.unionByName(new).groupBy("slug").agg(F.array_sort(F.collect_set("a")).alias("aliases"))


def bindings(names: DataFrame, pages: DataFrame) -> DataFrame:
    """How a name binds (names: name, type; pages: slug, type, title): bind if one page of its type and none of another has it."""
    of = pages.groupBy(F.lower("title").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("type").alias("kinds"), F.min("type").alias("t"), F.min("slug").alias("slug"))
    x = names.withColumn("k", F.lower("name")).join(of, "k", "left")
    one = (F.col("n") == 1) & (F.col("kinds") == 1) & (F.col("t") == F.col("type"))
    step = F.when(F.col("n").isNull(), "new").when(one, "bind").otherwise("suggest")
    return x.select("name", "type", step.alias("step"), F.when(one, F.col("slug")).alias("slug"))


def requested(keys: DataFrame, cache: DataFrame, now_s: int, ttl_s: int) -> DataFrame:
    """name and status of each key asked for (cache: key, name, at_s): resolved, stale, failed (no name) or unresolved."""
    x = keys.select("key").distinct().join(cache.select("key", "name", "at_s"), "key", "left")
    status = F.when(F.col("at_s").isNull(), "unresolved").when(F.col("name").isNull(), "failed")
    return x.select("key", "name", status.when(F.lit(now_s) - F.col("at_s") > ttl_s, "stale").otherwise("resolved").alias("status"))


def taken(new: DataFrame, handles: DataFrame) -> DataFrame:
    """New handles (kind, value, slug) with whether another page has them already."""
    mine = handles.select("kind", "value", F.col("slug").alias("_owner"))
    x = new.join(mine, ["kind", "value"], "left")
    step = F.when(F.col("_owner").isNull(), "add").when(F.col("_owner") == F.col("slug"), "keep").otherwise("conflict")
    return x.select("kind", "value", "slug", step.alias("step"))


def named_in(names: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, slug): pages whose slug or title is a name (names: id, name, own), but not the page the name stands in.

    Two equi joins, each name once, in place of one join with an OR.
    """
    by_slug = names.join(pages.select("slug"), F.col("name") == F.col("slug")).select("id", "own", "slug")
    titles = pages.select("slug", F.lower("title").alias("_t"))
    by_title = names.join(titles, F.lower("name") == F.col("_t")).select("id", "own", "slug")
    return by_slug.unionByName(by_title).filter(F.col("slug") != F.col("own")).select("id", "slug").distinct()


def ladder(names: DataFrame, handles: DataFrame, cache: DataFrame, readings: DataFrame | None = None) -> DataFrame:
    """slug and step of each person named (slug: as proposed, name), by the first rung that knows them.

    handle: the name is a handle (value, slug); slug and name: the cache (external_id, display_name: the slug, slug_hint: the name) has the proposed slug,
    or the name; canonical: the slug that the name makes (through the readings, if it has CJK characters), unless another name has it (collision: the proposal stays) or it makes none (kept).
    """
    h = handles.groupBy(F.col("value").alias("name")).agg(F.min("slug").alias("_h"))
    live = cache.filter("display_name <> ''")
    by_slug = live.groupBy(F.col("external_id").alias("slug")).agg(F.min("display_name").alias("_s"))
    by_name = live.groupBy(F.col("slug_hint").alias("name")).agg(F.min("display_name").alias("_n"))
    owners = live.groupBy(F.col("display_name").alias("_own")).agg(F.min("slug_hint").alias("_lo"), F.max("slug_hint").alias("_hi"))
    own = person_slugs(names, readings).withColumnRenamed("slug", "_own")
    x = names.join(h, "name", "left").join(by_slug, "slug", "left").join(by_name, "name", "left").join(own, "name", "left").join(owners, "_own", "left")
    taken = F.col("_lo").isNotNull() & ((F.col("_lo") != F.col("name")) | (F.col("_hi") != F.col("name"))) & ~F.coalesce(F.col("_own").startswith("person/ou_"), F.lit(False))
    step = (
        F.when(F.col("_h").isNotNull(), "handle").when(F.col("_s").isNotNull(), "slug").when(F.col("_n").isNotNull(), "name")
        .when(F.col("_own").isNull(), "kept").when(taken, "collision").otherwise("canonical")
    )
    to = F.coalesce("_h", "_s", "_n", F.when(step == "canonical", F.col("_own")), "slug")
    return x.select("slug", "name", to.alias("canonical"), step.alias("step"))


def without_handles(handles: DataFrame, gone: DataFrame) -> DataFrame:
    """Handles (kind, value, slug) after some (kind, value) are removed."""
    return handles.join(gone.select("kind", "value"), ["kind", "value"], "left_anti")
