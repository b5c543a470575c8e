"""Records as users list, merge and stamp them: provenance, sources that fail alone, feeds with names, upserts and cascades, sortings, bundles."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.operators.steps import settled

#: The sortings of pages.
SORTS = ("updated_at", "created_at", "title", "backlinks", "signal_time")


def provenance(parts: list[DataFrame], channel: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """One list of signals (kind, slug, summary, channel, at) of pages, entries and links; bounds compare texts, and one without a time is kept."""
    x = reduce(DataFrame.unionByName, parts)
    if channel:
        x = x.filter(F.col("channel") == channel)
    for bound, test in ((since, lambda v: F.col("at") >= v), (until, lambda v: F.col("at") <= v)):
        if bound:
            x = x.filter(F.col("at").isNull() | (F.col("at") == "") | test(bound))
    return x


def collected(spark: SparkSession, readers: Mapping[str, Callable[[], DataFrame]], columns: str) -> tuple[DataFrame, DataFrame]:
    """The messages of all sources that can be read, with their source, and the state of each source: source, ok, reason, messages, cursor_s.

    Each source is read and settled by itself, so one that fails, when it is planned or when it is read, takes no other with it, and its cursor stays where it was (null here).
    """
    good, bad = [], []
    for name, read in readers.items():
        try:
            good.append(settled(read().select("at_s", "channel", "contact", "content").withColumn("source", F.lit(name))))
        except Exception as e:  # noqa: BLE001  (a reader may fail in any way)
            bad.append((name, False, type(e).__name__))
    every = reduce(DataFrame.unionByName, good) if good else spark.createDataFrame([], columns)
    names = spark.createDataFrame([(n, True, None) for n in readers if n not in {b[0] for b in bad}] + bad, "source string, ok boolean, reason string")
    n = every.groupBy("source").agg(F.count(F.lit(1)).alias("messages"), F.max("at_s").alias("cursor_s"))
    return every, names.join(n, "source", "left").withColumn("messages", F.coalesce("messages", F.lit(0).cast("long")))


def named_channels(feed: DataFrame, cache: DataFrame) -> DataFrame:
    """A feed with the name of each channel and how that is known: mail, resolved, failed (asked for in vain) or unresolved."""
    known = cache.select(F.col("external_id").alias("channel"), F.col("display_name").alias("channel_name"), "resolved_at")
    x = feed.join(known, "channel", "left")
    status = F.when(F.col("channel").startswith("mail/"), "mail").when(F.col("channel_name").isNotNull(), "resolved")
    return x.withColumn("channel_name_status", status.when(F.col("resolved_at").isNotNull(), "failed").otherwise("unresolved")).drop("resolved_at")


def resolved(suggestions: DataFrame, decided: DataFrame) -> DataFrame:
    """Suggestions (id, status) after decisions (id, decision): only pending ones change."""
    x = suggestions.join(decided.select("id", "decision"), "id", "left")
    new = F.when((F.col("status") == "pending") & F.col("decision").isNotNull(), F.col("decision")).otherwise(F.col("status"))
    return x.withColumn("status", new).drop("decision")


def pending(suggestions: DataFrame, entity_type: str | None = None) -> DataFrame:
    """Pending suggestions, oldest first."""
    x = suggestions.filter("status = 'pending'")
    return (x.filter(F.col("entity_type") == entity_type) if entity_type else x).orderBy("created_s", "id")


def enriched(messages: DataFrame, unresolved: Column, cache: DataFrame, backend: DataFrame) -> DataFrame:
    """Messages whose unresolved contacts have the name that the cache, or else the backend, knows, with its hint in brackets.

    Each side is one row per external_id (display_name, slug_hint); a cached row without a name does not count.
    """
    label = F.concat("display_name", F.when(F.coalesce("slug_hint", F.lit("")) != "", F.concat(F.lit(" ("), "slug_hint", F.lit(")"))).otherwise(""))
    side = lambda df, name: df.filter("display_name <> ''").select(F.col("external_id").alias("contact"), label.alias(name))
    ids = messages.filter(unresolved).select("contact").distinct()
    names = ids.join(side(cache, "_c"), "contact", "left").join(side(backend, "_b"), "contact", "left")
    names = names.select("contact", F.coalesce("_c", "_b").alias("_name")).filter("_name IS NOT NULL")
    return messages.join(names, "contact", "left").withColumn("contact", F.coalesce("_name", "contact")).drop("_name")


def stamped(signals: Column, canonical: Column) -> Column:
    """Signals (an array) with the canonical source of their block; of their own they keep external_id, message_id, url and quote, where they have them."""

    def stamp(s: Column) -> Column:
        own = {c: F.coalesce(s["source"][c], canonical[c]) for c in ("external_id", "message_id", "url")}
        own["quote"] = F.when(F.coalesce(s["source"]["quote"], F.lit("")) != "", s["source"]["quote"]).otherwise(canonical["quote"])
        return s.withField("source", reduce(lambda r, kv: r.withField(*kv), own.items(), canonical))

    return F.transform(signals, stamp)


def first_values(messages: DataFrame, key: list[str], order: list[str], meta: str, fields: Mapping[str, list[str]]) -> DataFrame:
    """For each block the first value of its messages' metadata (a map) under any of the keys of a field; in a message, earlier keys come first."""
    none = F.lit(None).cast("string")

    def of(keys: list[str]) -> Column:
        value = lambda k: F.when(F.coalesce(F.try_element_at(meta, F.lit(k)), F.lit("")) != "", F.try_element_at(meta, F.lit(k))).otherwise(none)
        return F.coalesce(*map(value, keys))

    at = F.struct(*order)
    first = lambda v: F.min_by(v, F.when(v.isNotNull(), at))
    return messages.groupBy(*key).agg(*[first(of(keys)).alias(name) for name, keys in fields.items()])


def put_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pages after an upsert by slug (slug, type, title, halflife_days, expires_s). New rows also have now_s and expiry: a time, 0 for never, or null.

    A new page expires when it is told to, or after its halflife, or never. A page that was there takes all but its expiry.
    """
    told = F.when(F.col("expiry") > 0, F.col("expiry")).when(F.col("expiry").isNull(), F.col("now_s") + F.col("halflife_days") * 86400)
    kept = old.select("slug", F.col("expires_s").alias("_was"), F.lit(True).alias("_old"))
    fresh = new.join(kept, "slug", "left").withColumn("expires_s", F.when(F.col("_old"), F.col("_was")).otherwise(told))
    return old.join(new.select("slug"), "slug", "left_anti").unionByName(fresh.select(*old.columns))


def without_pages(tables: Mapping[str, tuple[DataFrame, list[str]]], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables after pages (slug) are deleted: rows of which any of the named columns is one of them go as well."""
    out = {}
    for name, (rows, columns) in tables.items():
        for c in columns:
            rows = rows.join(gone.select(F.col("slug").alias(c)), c, "left_anti")
        out[name] = rows
    return out


def repointed(rows: DataFrame, columns: list[str], moves: DataFrame, unique: list[str]) -> DataFrame:
    """Rows whose slugs (columns) moved (moves: was, now), once for each unique key: one that was there before comes first. Links to oneself go."""
    x = rows.withColumn("_moved", F.lit(0))
    for c in columns:
        m = moves.select(F.col("was").alias(c), F.col("now").alias("_now"))
        x = x.join(m, c, "left").withColumn("_moved", F.when(F.col("_now").isNotNull(), 1).otherwise(F.col("_moved"))).withColumn(c, F.coalesce("_now", c)).drop("_now")
    if len(columns) == 2:
        x = x.filter(F.col(columns[0]) != F.col(columns[1]))
    rest = [c for c in rows.columns if c not in unique]
    if not rest:
        return x.select(*unique).distinct()
    first = x.groupBy(*unique).agg(F.min(F.struct("_moved", *rest)).alias("_f"))
    return first.select(*[F.col(c) if c in unique else F.col(f"_f.{c}").alias(c) for c in rows.columns])


def folded(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """Bodies (slug, body) of pages after merges: those of the pages that moved are put behind that of the page that stays, by slug."""
    x = pages.join(moves.withColumnRenamed("was", "slug"), "slug", "left")
    rows = F.array_sort(F.collect_list(F.struct(F.col("now").isNotNull().alias("moved"), "slug", "body")))
    return x.groupBy(F.coalesce("now", "slug").alias("page")).agg(F.array_join(F.filter(rows["body"], lambda b: b != ""), "\n\n").alias("body"))


def sorted_pages(pages: DataFrame, by: str, links: DataFrame | None = None, descending: bool = True, limit: int = 20) -> DataFrame:
    """The first pages by one of `SORTS` (another one is updated_at); ties by slug. Only a top-k leaves each task."""
    x, key = pages, F.col("created_s")
    if by == "title":
        key = F.col("title")
    elif by == "backlinks" and links is not None:
        n = links.groupBy(F.col("dst").alias("slug")).agg(F.count(F.lit(1)).alias("_n"))
        x, key = pages.join(n, "slug", "left"), F.coalesce("_n", F.lit(0))
    elif by == "signal_time":
        key = F.coalesce("source.timestamp_s", "created_s")
    elif by == "updated_at":
        key = F.col("updated_s")
    return x.withColumn("key", key).orderBy(F.desc("key") if descending else F.asc("key"), "slug").limit(limit).select(*pages.columns, "key")


def profile(slug: str, pages: DataFrame, links: DataFrame, timeline: DataFrame) -> DataFrame:
    """Of one entity the pages that link to it, by type (part = type), and its timeline (part = timeline): part, slug, text."""
    back = links.filter(F.col("dst") == slug).select(F.col("src").alias("slug")).join(pages.select("slug", "type", "title"), "slug")
    dated = timeline.filter(F.col("slug") == slug).select(F.lit("timeline").alias("part"), F.col("date").alias("slug"), F.col("summary").alias("text"))
    return back.select(F.col("type").alias("part"), "slug", F.col("title").alias("text")).unionByName(dated)


def redacted(rows: DataFrame, fields: list[str], redact: Callable[[Column], Column]) -> DataFrame:
    """Rows with the named text fields redacted, also those within a struct (`struct.field`); all others, such as names, slugs and hashes, stay."""
    for f in fields:
        top, _, inner = f.partition(".")
        rows = rows.withColumn(top, F.col(top).withField(inner, redact(F.col(f))) if inner else redact(F.col(top)))
    return rows


def due_links(references: DataFrame, as_of_s: int, days: int = 30) -> DataFrame:
    """References (slug, url, checked_s) whose link is to be checked: they have one, and it was not checked for `days`."""
    return references.filter((F.coalesce("url", F.lit("")) != "") & (F.col("checked_s").isNull() | (F.col("checked_s") <= as_of_s - days * 86400)))


def candidates(files: DataFrame, nodes: DataFrame, wiki: str) -> DataFrame:
    """Documents to look at, from drive files (token, name, url, owner_id, created_time, modified_time) and wiki nodes (node_token, obj_token,
    title, url, owner, obj_create_time, obj_edit_time); their times are epoch seconds as text, given back as ISO times."""
    iso = lambda c: F.date_format(F.timestamp_seconds(F.col(c).try_cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    a = files.select(
        F.col("token").alias("doc_token"), F.col("name").alias("title"), "url", F.col("owner_id").alias("last_editor_id"),
        iso("created_time").alias("created_at"), iso("modified_time").alias("modified_at"),
    )
    b = nodes.select(
        F.col("obj_token").alias("doc_token"), "title", F.coalesce("url", F.concat(F.lit(wiki), "node_token")).alias("url"),
        F.coalesce("owner", F.lit("")).alias("last_editor_id"), iso("obj_create_time").alias("created_at"), iso("obj_edit_time").alias("modified_at"),
    )
    return a.unionByName(b)


def accepted(rates: DataFrame, drop: float = 0.8) -> DataFrame:
    """Whether held-out rates pass against a baseline (kind: baseline or holdout, miss, noise): the noise fell by `drop`, and no more is missed."""
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    was, now = of("baseline", "noise"), of("holdout", "noise")
    x = rates.agg(F.when(was == 0, 0.0).otherwise((was - now) / was).alias("fell"), (of("holdout", "miss") <= of("baseline", "miss")).alias("miss_kept"))
    return x.select(F.round("fell", 6).alias("noise_drop"), "miss_kept", ((F.col("fell") >= drop) & F.col("miss_kept")).alias("passed"))


def upserted_entries(old: DataFrame, new: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Timeline entries (slug, date, summary, detail, source) after an upsert by slug, date and summary, and the new ones whose page is not there.

    A new detail and source replace the old ones, unless they are null.
    """
    known = new.join(pages.select("slug"), "slug", "left_semi")
    keys = ["slug", "date", "summary"]
    x = old.alias("a").join(known.alias("b"), keys, "full")
    out = x.select(*keys, *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in ("detail", "source")])
    return out, new.join(pages.select("slug"), "slug", "left_anti")


def imported_links(files: DataFrame, links: DataFrame, link_type: str) -> DataFrame:
    """slug, target: the links that a vault's pages (slug, named: array, body) name in their head or body and that the store does not have yet.

    Only links of the vault's own type count as had; those that others made are left alone.
    """
    inner = F.regexp_extract_all("body", F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), 1)
    every = F.array_union(F.coalesce("named", F.array().cast("array<string>")), F.transform(F.coalesce(inner, F.array().cast("array<string>")), lambda t: F.trim(t)))
    x = files.select("slug", F.explode(every).alias("target")).filter("target <> ''")
    have = links.filter(F.col("link_type") == link_type).select(F.col("src").alias("slug"), F.col("dst").alias("target"))
    return x.join(have, ["slug", "target"], "left_anti")


def stamped_expiry(payloads: DataFrame, ledger: DataFrame, states: list[str], at_s: int, ttl_s: int) -> DataFrame:
    """Payloads (id, revision, expires_s) with an expiry from now on where they have none and a revision of theirs is in one of the states (ledger: revision, state)."""
    done = ledger.filter(F.col("state").isin(*states)).select("revision", F.lit(True).alias("_done")).distinct()
    x = payloads.join(done, "revision", "left")
    return x.withColumn("expires_s", F.coalesce("expires_s", F.when(F.col("_done"), F.lit(at_s + ttl_s)))).drop("_done")


def upserted_tags(old: DataFrame, new: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags (slug, tag) with new ones put in, each once, and the new ones whose page is not there. Null tags are left out."""
    each = new.select("slug", "tag").filter("tag IS NOT NULL").distinct()
    known = pages.select("slug")
    return old.select("slug", "tag").unionByName(each.join(known, "slug", "left_semi")).distinct(), each.join(known, "slug", "left_anti")


def listed_sessions(sessions: DataFrame, source: str | None = None, state: str | None = None, limit: int = 50) -> DataFrame:
    """Sessions (session, source, state, newest_s, tries) of a source, in a state, or all; the newest first, ties by session. Only a top-k leaves each task."""
    for column, value in (("source", source), ("state", state)):
        if value is not None:
            sessions = sessions.filter(F.col(column) == value)
    return sessions.orderBy(F.desc("newest_s"), "session").limit(limit)
