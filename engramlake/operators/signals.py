"""Signals on their way to pages: checks, evidence, provenance, pages and what they replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Message numbers by which claims and messages meet.
STRETCH = 64


def checked(rows: DataFrame, schema: str, raw: str = "raw") -> DataFrame:
    """Rows with their JSON parsed as `signal`, and why one is refused: invalid, no topic, or an end before its start."""
    x = rows.withColumn("signal", F.from_json(raw, schema))
    bad = F.when(F.try_parse_json(raw).isNull(), "invalid").when(F.coalesce(F.trim("signal.topic"), F.lit("")) == "", "no topic")
    return x.withColumn("error", bad.when(F.col("signal.invalid_at") < F.col("signal.valid_at"), "dates"))


def new_pages(signals: DataFrame, pages: DataFrame) -> DataFrame:
    """What each signal (slug, source_hash) does to its page (slug, source_hash, edited): create, skip or write."""
    have = pages.select("slug", F.col("source_hash").alias("_was"), F.col("edited").alias("_edited"), F.lit(True).alias("_page"))
    x = signals.join(have, "slug", "left")
    skip = F.coalesce("_edited", F.lit(False)) | F.col("_was").eqNullSafe(F.col("source_hash"))
    return x.select("slug", F.when(F.col("_page").isNull(), "create").when(skip, "skip").otherwise("write").alias("step"))


def provenance(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Of each block its first author, its distinct authors and messages, and its time span (contact, event_id, at_s)."""
    return messages.groupBy(*keys).agg(
        F.min_by("contact", F.struct("at_s", "event_id")).alias("first_contact"), F.count_distinct("contact").alias("contacts"),
        F.count_distinct("event_id").alias("messages"), F.min("at_s").alias("start_s"), F.max("at_s").alias("end_s"),
    )


def evidence(claims: DataFrame, messages: DataFrame) -> DataFrame:
    """Claims (id, session, first, last, quote) with whether their messages exist and one has the quote (messages: session, msg, content).

    They meet by session and by stretches of `STRETCH` message numbers, so a claim meets only messages about its own.
    """
    at = lambda c: F.floor(F.col(c) / STRETCH)
    near = claims.withColumn("stretch", F.explode(F.sequence(at("first"), F.greatest(at("first"), at("last")))))
    x = near.join(messages.withColumn("stretch", at("msg")), ["session", "stretch"]).filter(F.col("msg").between(F.col("first"), F.col("last")))
    found = x.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("content").contains(F.col("quote"))).alias("quoted"))
    y = claims.join(found, "id", "left")
    whole = F.coalesce(F.col("n") == F.col("last") - F.col("first") + 1, F.lit(False))
    return y.select("id", whole.alias("in_bounds"), F.coalesce("quoted", F.lit(False)).alias("quoted"))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not overturned."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def grounded(rows: DataFrame, least: int, hashes: DataFrame) -> DataFrame:
    """Whether a profile is made anew (key, n, input_hash): it has enough messages and other ones than before."""
    x = rows.join(hashes.select("key", F.col("input_hash").alias("_was")), "key", "left")
    step = F.when(F.col("n") < least, "too few").when(F.col("_was").eqNullSafe(F.col("input_hash")), "unchanged").otherwise("profile")
    return x.select("key", step.alias("step"))


def chain_order(candidates: DataFrame, chain: DataFrame) -> DataFrame:
    """Candidates (slug, place) put in the order of the chain that has most of them (start, slug, place), the rest after it."""
    met = candidates.select("slug").join(chain.select("start", "slug", F.col("place").alias("at")), "slug")
    best = met.groupBy("start").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "start").limit(1)
    order = met.join(F.broadcast(best.select("start")), "start").select("slug", "at")
    return candidates.join(order, "slug", "left").select("slug", F.coalesce(F.col("at"), 1000000 + F.col("place")).alias("rank"))


def rendered_chat(author: Column, at: Column, content: Column) -> Column:
    return F.concat(F.lit("["), at, F.lit("] "), author, F.lit(": "), content)


def action_items(items: DataFrame, handles: DataFrame, me: str) -> DataFrame:
    """Action items of documents (doc_id, text, owner_raw) as task pages: slug (by a hash of the text, not its place), the page of the owner
    whose handle (value, slug) was named, and whether that is me, so that the task is linked to me as well."""
    owner = handles.select(F.col("value").alias("owner_raw"), F.col("slug").alias("owner"))
    slug = F.concat(F.lit("tasks/doc-"), F.col("doc_id").cast("string"), F.lit("-"), F.substring(F.sha2("text", 256), 1, 8))
    x = items.select("doc_id", "text", "owner_raw", slug.alias("slug")).join(owner, "owner_raw", "left")
    return x.withColumn("mine", F.coalesce(F.col("owner") == me, F.lit(False)))


def profilable(rows: DataFrame, least: int, hashes: DataFrame, deny: list[str], allowed: DataFrame | None = None) -> DataFrame:
    """As `grounded`, but of persons on no deny list and, if there is an allow list (key), on that."""
    x = grounded(rows, least, hashes)
    step = F.when(F.col("key").isin(*deny), "denied") if deny else F.when(F.lit(False), "")
    if allowed is not None:
        x = x.join(allowed.select("key", F.lit(True).alias("_ok")), "key", "left")
        step = step.when(F.col("_ok").isNull(), "not allowed")
    return x.select("key", step.otherwise(F.col("step")).alias("step"))


def document_texts(messages: DataFrame, keys: list[str]) -> DataFrame:
    """The text of each document (keys) from its parts (at_s, seq, content): each stripped, in order, an empty line between them; a null part is empty. A document's text is one row, so its parts are gathered."""
    parts = F.array_sort(F.collect_list(F.struct("at_s", "seq", F.regexp_replace(F.coalesce("content", F.lit("")), r"^\s+|\s+$", "").alias("text"))))
    return messages.groupBy(*keys).agg(F.array_join(parts["text"], "\n\n").alias("text"))


#: The axes of a trait and their levels.
AXES, LEVELS = ("D", "I", "S", "C"), ("low", "medium", "high")


def grounded_traits(profiles: DataFrame, evidence: DataFrame) -> DataFrame:
    """What stands of the dimensions that a model gave (profiles: key, insufficient, dimensions: axis, level, evidence_refs): key, place, axis, level, evidence_refs, evidence_count.

    A dimension with an unknown axis or level goes, and so do all of a profile that is said to be insufficient; of a dimension's references those stay, in order, that are evidence of its
    key (evidence: key, slug). References meet evidence as rows, so a person with much evidence is not gathered.
    """
    each = profiles.filter(~F.coalesce("insufficient", F.lit(False))).select("key", F.posexplode("dimensions").alias("place", "d")).select("key", "place", "d.*")
    each = each.filter(F.col("axis").isin(*AXES) & F.col("level").isin(*LEVELS))
    refs = each.select("key", "place", "axis", "level", F.posexplode_outer("evidence_refs").alias("at", "slug"))
    known = evidence.select("key", "slug", F.lit(True).alias("_known")).distinct()
    found = F.when(F.col("_known"), F.struct("at", "slug"))
    met = refs.join(known, ["key", "slug"], "left").groupBy("key", "place", "axis", "level").agg(F.array_sort(F.collect_list(found)).alias("f"))
    return met.select("key", "place", "axis", "level", F.col("f.slug").alias("evidence_refs"), F.size("f").alias("evidence_count"))
