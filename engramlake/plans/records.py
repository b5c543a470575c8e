"""Queries over records: provenance, collecting, feeds, suggestions, contacts, stamps, upserts, cascades, merges, sortings, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake import views as V
from engramlake.functions import text as T
from engramlake.operators import graph as G
from engramlake.operators import ledger as L
from engramlake.operators import records as C
from engramlake.plans.memory import _LIVE, _SOURCED
from engramlake.queries import _CONTRIB, _DM, _GROUP, _LINKS, _PAGES, _TIMELINE, AS_OF_S
from engramlake.registry import query


def _id(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


# provenance and collecting


@query(f"""WITH {_PAGES}, x AS (SELECT type AS kind, slug, title AS summary, channel, CASE WHEN doc_id % 5 <> 0 THEN strftime(to_timestamp(created_s) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') END AS "at" FROM pages_v
UNION ALL SELECT 'timeline', 'customer/' || o_custkey, o_orderpriority, 'src' || o_custkey % 20, strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d') FROM orders
UNION ALL SELECT 'link', NULL, 'order/' || o_orderkey || ' → customer/' || o_custkey || ' (mentions)', 'src' || o_orderkey % 20, strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d') FROM orders)
SELECT * FROM x WHERE channel = 'src3' AND ("at" IS NULL OR "at" = '' OR ("at" >= '1997-03-01' AND "at" <= '2024-01-20'))""")
def provenance_union(spark, d):
    at = F.when(F.col("doc_id") % 5 != 0, F.date_format(F.timestamp_seconds("created_s"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    pages = V.pages(spark, d).select(F.col("type").alias("kind"), "slug", F.col("title").alias("summary"), "channel", at.alias("at"))
    o = V.table(spark, d, "orders").withColumn("at", F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd"))
    of = lambda c: F.concat(F.lit("src"), (F.col(c) % 20).cast("string")).alias("channel")
    entries = o.select(F.lit("timeline").alias("kind"), _id("customer/", "o_custkey").alias("slug"), F.col("o_orderpriority").alias("summary"), of("o_custkey"), "at")
    text = F.concat(_id("order/", "o_orderkey"), F.lit(" → "), _id("customer/", "o_custkey"), F.lit(" (mentions)"))
    links = o.select(F.lit("link").alias("kind"), F.lit(None).cast("string").alias("slug"), text.alias("summary"), of("o_orderkey"), "at")
    return C.provenance([pages, entries, links], "src3", "1997-03-01", "2024-01-20")


@query(f"""WITH {_GROUP}, {_DM} SELECT 'direct' AS source, true AS ok, NULL::VARCHAR AS reason, count(*) AS messages, max(at_s)::BIGINT AS cursor_s FROM dm_v
UNION ALL SELECT 'group', true, NULL, count(*), max(at_s)::BIGINT FROM group_v UNION ALL SELECT 'mail', false, 'AnalysisException', 0, NULL""")
def collect_union(spark, d):
    def group():
        return V.group_messages(spark, d).withColumn("content", F.col("value").cast("string"))

    def direct():
        return V.direct_messages(spark, d).withColumn("contact", F.col("direction"))

    readers = {"group": group, "direct": direct, "mail": lambda: V.table(spark, d, "no_such_mail")}
    return C.collected(spark, readers, "at_s long, channel string, contact string, content string, source string")[1]


@query("SELECT 'group/' || event_type AS target FROM events UNION SELECT 'group/' || n_name FROM nation")
def chat_targets(spark, d):
    live = V.group_messages(spark, d).select(F.col("channel").alias("target"))
    return live.unionByName(V.table(spark, d, "nation").select(_id("group/", "n_name").alias("target"))).distinct()


@query(f"""WITH {_PAGES}, s AS (SELECT strftime(to_timestamp(created_s) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, CASE WHEN doc_id % 9 = 0 THEN 'mail/in' ELSE channel END AS channel FROM pages_v),
days AS (SELECT DISTINCT day FROM s ORDER BY day DESC LIMIT 5), c AS (SELECT 'src' || n_nationkey AS channel, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS channel_name FROM nation WHERE n_nationkey % 3 < 2)
SELECT day, s.channel, channel_name, CASE WHEN starts_with(s.channel, 'mail/') THEN 'mail' WHEN channel_name IS NOT NULL THEN 'resolved' WHEN c.channel IS NOT NULL THEN 'failed' ELSE 'unresolved' END AS channel_name_status, count(*) AS signals
FROM s JOIN days USING (day) LEFT JOIN c ON c.channel = s.channel WHERE s.channel IS NOT NULL GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY day, s.channel, channel_name, c.channel"))
def feed_named(spark, d):
    day = F.date_format(F.timestamp_seconds("created_s"), "yyyy-MM-dd")
    s = V.pages(spark, d).select(day.alias("day"), F.when(F.col("doc_id") % 9 == 0, "mail/in").otherwise(F.col("channel")).alias("channel")).filter("channel IS NOT NULL")
    days = s.select("day").distinct().orderBy(F.desc("day")).limit(5)
    k = F.col("n_nationkey")
    cache = V.table(spark, d, "nation").filter(k % 3 < 2).select(_id("src", "n_nationkey").alias("external_id"), F.when(k % 3 == 0, F.col("n_name")).alias("display_name"), F.lit(1).alias("resolved_at"))
    feed = s.join(F.broadcast(days), "day").groupBy("day", "channel").agg(F.count(F.lit(1)).alias("signals"))
    return C.named_channels(feed, cache)


# suggestions, contacts


_SUGGESTED = """s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'person' ELSE 'tool' END AS entity_type, ['pending','accepted','dismissed'][c_custkey % 4 % 3 + 1] AS status, 100000 - c_custkey AS created_s FROM customer),
r AS (SELECT id, entity_type, CASE WHEN status = 'pending' AND s_suppkey IS NOT NULL THEN CASE WHEN s_suppkey % 2 = 0 THEN 'accepted' ELSE 'dismissed' END ELSE status END AS status, created_s FROM s LEFT JOIN supplier ON s_suppkey = id)"""


@query(f"WITH {_SUGGESTED} SELECT id, entity_type, status FROM r")
def suggestions_resolved(spark, d):
    return _suggested(spark, d).select("id", "entity_type", "status")


@query(f"WITH {_SUGGESTED} SELECT id, created_s FROM r WHERE status = 'pending' AND entity_type = 'person' ORDER BY created_s, id")
def suggestions_pending(spark, d):
    return C.pending(_suggested(spark, d), "person").select("id", "created_s")


def _suggested(spark, d):
    k = F.col("c_custkey")
    status = F.element_at(F.array(F.lit("pending"), F.lit("accepted"), F.lit("dismissed")), (k % 4 % 3 + 1).cast("int"))
    s = V.table(spark, d, "customer").select(k.alias("id"), F.when(k % 3 == 0, "person").otherwise("tool").alias("entity_type"), status.alias("status"), (F.lit(100000) - k).alias("created_s"))
    j = F.col("s_suppkey")
    return C.resolved(s, V.table(spark, d, "supplier").select(j.alias("id"), F.when(j % 2 == 0, "accepted").otherwise("dismissed").alias("decision")))


@query(f"""WITH {_GROUP}, c AS (SELECT 'user-' || c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'h' || c_custkey END AS hint FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 4 <> 0),
b AS (SELECT 'user-' || s_suppkey AS id, s_name AS name FROM supplier), n AS (SELECT event_id, contact, c.name || CASE WHEN c.hint IS NOT NULL THEN ' (' || c.hint || ')' ELSE '' END AS c, b.name AS b FROM group_v LEFT JOIN c ON c.id = contact LEFT JOIN b ON b.id = contact)
SELECT event_id, CASE WHEN right(contact, 1) = '9' THEN contact ELSE coalesce(c, b, contact) END AS contact FROM n""")
def enrich_contacts(spark, d):
    k = F.col("c_custkey")
    cache = V.table(spark, d, "customer").filter(k % 2 == 0).select(_id("user-", "c_custkey").alias("external_id"), F.when(k % 4 != 0, F.col("c_name")).alias("display_name"), F.when(k % 3 == 0, _id("h", "c_custkey")).alias("slug_hint"))
    back = V.table(spark, d, "supplier").select(_id("user-", "s_suppkey").alias("external_id"), F.col("s_name").alias("display_name"), F.lit(None).cast("string").alias("slug_hint"))
    return C.enriched(V.group_messages(spark, d), ~F.col("contact").endswith("9"), cache, back).select("event_id", "contact")


# provenance of blocks


@query("""WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'r' || conv_id END AS chat_name, CASE WHEN turn % 4 = 2 THEN 'c' || turn ELSE '' END AS channel_name, CASE WHEN turn % 5 = 3 THEN 's' || turn END AS session_id, 't' || turn AS thread_id FROM conversations),
a AS (SELECT conv_id, turn, coalesce(nullif(channel_name, ''), chat_name) AS n, coalesce(session_id, thread_id) AS c FROM m)
SELECT conv_id, arg_min(n, turn) FILTER (n IS NOT NULL) AS channel_name, arg_min(c, turn) AS conversation_id FROM a GROUP BY conv_id""")
def source_refs(spark, d):
    t = F.col("turn")
    pairs = {"chat_name": F.when(t % 3 == 1, _id("r", "conv_id")), "channel_name": F.when(t % 4 == 2, _id("c", "turn")).otherwise(""), "session_id": F.when(t % 5 == 3, _id("s", "turn")), "thread_id": _id("t", "turn")}
    meta = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])
    m = V.table(spark, d, "conversations").select("conv_id", "turn", meta.alias("meta"))
    fields = {"channel_name": ["channel_name", "chat_name", "conversation_name", "contact_name"], "conversation_id": ["conversation_id", "chat_id", "session_id", "thread_id"]}
    return C.first_values(m, ["conv_id"], ["turn"], "meta", fields)


@query(f"""WITH {_CONTRIB} SELECT contribution_id, what, 'chat' AS platform, coalesce(CASE WHEN contribution_id % 2 = 0 THEN 'own' || contribution_id END, page) AS external_id,
 CASE WHEN contribution_id % 3 = 0 THEN 'said ' || what ELSE '' END AS quote FROM contrib_v""")
def stamp_source(spark, d):
    i = F.col("contribution_id")
    none = F.lit(None).cast("string")
    c = V.contributions(spark, d)
    own = F.struct(none.alias("platform"), F.when(i % 2 == 0, _id("own", "contribution_id")).alias("external_id"), none.alias("message_id"), none.alias("url"), F.when(i % 3 == 0, F.concat(F.lit("said "), "what")).alias("quote"))
    canonical = F.struct(F.lit("chat").alias("platform"), F.col("page").alias("external_id"), none.alias("message_id"), none.alias("url"), F.lit("").alias("quote"))
    x = c.select("contribution_id", F.explode(C.stamped(F.array(F.struct("what", own.alias("source"))), canonical)).alias("s"))
    return x.select("contribution_id", "s.what", "s.source.platform", "s.source.external_id", "s.source.quote")


# documents and references


@query("""SELECT 'f' || page_id AS doc_token, 'page ' || page_id AS title, url, 'u' || page_id % 5 AS last_editor_id, strftime(to_timestamp(1700000000 + page_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') AS created_at,
 strftime(to_timestamp(1700000000 + page_id * 7) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') AS modified_at FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT 'o' || page_id, 'node ' || page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE 'https://example.org/wiki/n' || page_id END, CASE WHEN page_id % 5 = 1 THEN '' ELSE 'u' || page_id % 5 END,
 CASE WHEN page_id % 11 <> 0 THEN strftime(to_timestamp(1700000000 + page_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') END, strftime(to_timestamp(1700000000 + page_id * 7) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') FROM pages WHERE page_id % 2 = 1""")
def doc_candidates(spark, d):
    i = F.col("page_id")
    p = V.table(spark, d, "pages")
    sec = lambda k: (F.lit(1700000000) + i * k).cast("string")
    files = p.filter(i % 2 == 0).select(_id("f", "page_id").alias("token"), _id("page ", "page_id").alias("name"), "url", F.concat(F.lit("u"), (i % 5).cast("string")).alias("owner_id"), sec(1).alias("created_time"), sec(7).alias("modified_time"))
    nodes = p.filter(i % 2 == 1).select(
        _id("n", "page_id").alias("node_token"), _id("o", "page_id").alias("obj_token"), _id("node ", "page_id").alias("title"), F.when(i % 3 == 0, F.col("url")).alias("url"),
        F.when(i % 5 != 1, F.concat(F.lit("u"), (i % 5).cast("string"))).alias("owner"), F.when(i % 11 != 0, sec(1)).otherwise("soon").alias("obj_create_time"), sec(7).alias("obj_edit_time"),
    )
    return C.candidates(files, nodes, "https://example.org/wiki/")


@query(f"""WITH r AS (SELECT page_id, CASE WHEN page_id % 7 <> 0 THEN url END AS url, CASE WHEN page_id % 3 <> 0 THEN {AS_OF_S} - page_id * 20000 END AS checked_s FROM pages)
SELECT page_id, url FROM r WHERE url IS NOT NULL AND url <> '' AND (checked_s IS NULL OR checked_s <= {AS_OF_S} - 30 * 86400)""")
def deadlink_due(spark, d):
    i = F.col("page_id")
    r = V.table(spark, d, "pages").select("page_id", F.when(i % 7 != 0, F.col("url")).alias("url"), F.when(i % 3 != 0, F.lit(AS_OF_S) - i * 20000).alias("checked_s"))
    return C.due_links(r, AS_OF_S).select("page_id", "url")


_PII = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '1[3-9]\\d{{9}}', '[PHONE]', 'g'), '\\d{{17}}[\\dXx]', '[ID]', 'g'), '\\d{{16,19}}', '[CARD]', 'g'), '\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}', '[IP]', 'g')"


@query(f"SELECT doc_id, 'call 13912345678 of ' || source AS name, {_PII.format('text')} AS context, {_PII.format('left(text, 200)')} AS quote, 'raw 13912345678' AS raw_hash FROM documents")
def redact_fields(spark, d):
    source = F.struct(F.substring("text", 1, 200).alias("quote"), F.lit("raw 13912345678").alias("raw_hash"))
    x = V.table(spark, d, "documents").select("doc_id", F.concat(F.lit("call 13912345678 of "), "source").alias("name"), F.col("text").alias("context"), source.alias("source"))
    return C.redacted(x, ["context", "source.quote"], T.redact).select("doc_id", "name", "context", "source.*")


# upserts, cascades, merges


_PUT = """old AS (SELECT c_custkey, 'c/' || c_custkey AS slug, 'person' AS type, 'Old ' || c_custkey AS title, 30::BIGINT AS halflife_days, (500000 + c_custkey)::BIGINT AS expires_s FROM customer WHERE c_custkey % 3 <> 0),
new AS (SELECT 'c/' || c_custkey AS slug, 'task' AS type, 'New ' || c_custkey AS title, CASE WHEN c_custkey % 5 <> 0 THEN 10::BIGINT END AS halflife_days, CASE c_custkey % 4 WHEN 0 THEN 777 WHEN 2 THEN 0 END::BIGINT AS expiry FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 9 = 0)"""


@query(f"""WITH {_PUT} SELECT slug, type, title, halflife_days, expires_s FROM old WHERE slug NOT IN (SELECT slug FROM new)
UNION ALL SELECT n.slug, n.type, n.title, n.halflife_days, CASE WHEN o.slug IS NOT NULL THEN o.expires_s WHEN expiry > 0 THEN expiry WHEN expiry IS NULL THEN 1000000 + n.halflife_days * 86400 END FROM new n LEFT JOIN old o USING (slug)""")
def page_put(spark, d):
    k = F.col("c_custkey")
    c = V.table(spark, d, "customer")
    slug = _id("c/", "c_custkey").alias("slug")
    old = c.filter(k % 3 != 0).select(slug, F.lit("person").alias("type"), _id("Old ", "c_custkey").alias("title"), F.lit(30).cast("long").alias("halflife_days"), (k + 500000).cast("long").alias("expires_s"))
    expiry = F.when(k % 4 == 0, 777).when(k % 4 == 2, 0).cast("long").alias("expiry")
    new = c.filter((k % 2 == 0) | (k % 9 == 0)).select(slug, F.lit("task").alias("type"), _id("New ", "c_custkey").alias("title"), F.when(k % 5 != 0, 10).cast("long").alias("halflife_days"), F.lit(1000000).cast("long").alias("now_s"), expiry)
    return C.put_pages(old, new)


_GONE = "gone AS (SELECT 'customer/' || c_custkey AS slug FROM customer WHERE c_nationkey = 3)"


@query(f"""WITH {_LINKS}, {_TIMELINE}, {_GONE} SELECT 'links' AS part, count(*) AS n FROM links_v WHERE src NOT IN (SELECT slug FROM gone) AND dst NOT IN (SELECT slug FROM gone)
UNION ALL SELECT 'timeline', count(*) FROM timeline_v WHERE slug NOT IN (SELECT slug FROM gone) UNION ALL SELECT 'tags', count(*) FROM customer WHERE 'customer/' || c_custkey NOT IN (SELECT slug FROM gone)""")
def delete_pages(spark, d):
    c = V.table(spark, d, "customer").withColumn("slug", _id("customer/", "c_custkey"))
    tables = {"links": (V.links(spark, d), ["src", "dst"]), "timeline": (V.timeline(spark, d), ["slug"]), "tags": (c.select("slug", F.col("c_mktsegment").alias("tag")), ["slug"])}
    left = C.without_pages(tables, c.filter("c_nationkey = 3").select("slug"))
    n = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("part"), "n") for k, x in left.items()]
    return n[0].unionByName(n[1]).unionByName(n[2])


_MOVES = "moves AS (SELECT 'customer/' || c_custkey AS was, 'customer/' || (c_custkey - 1) AS now FROM customer WHERE c_custkey % 4 = 0)"


@query(f"""WITH {_TIMELINE}, {_MOVES}, r AS (SELECT coalesce(now, slug) AS slug, date, summary, CASE WHEN now IS NULL THEN 0 ELSE 1 END AS moved, source, entry_id FROM timeline_v LEFT JOIN moves ON was = slug),
k AS (SELECT *, row_number() OVER (PARTITION BY slug, date, summary ORDER BY moved, source, entry_id) AS n FROM r) SELECT slug, date, summary, source, entry_id FROM k WHERE n = 1""")
def merge_timeline(spark, d):
    return C.repointed(V.timeline(spark, d).select("slug", "date", "summary", "source", "entry_id"), ["slug"], _moves(spark, d), ["slug", "date", "summary"])


@query(f"""WITH {_LINKS}, {_MOVES} SELECT DISTINCT coalesce(a.now, src) AS src, coalesce(b.now, dst) AS dst, link_type FROM links_v LEFT JOIN moves a ON a.was = src LEFT JOIN moves b ON b.was = dst WHERE coalesce(a.now, src) <> coalesce(b.now, dst)""")
def merge_links(spark, d):
    return C.repointed(V.links(spark, d), ["src", "dst"], _moves(spark, d), ["src", "dst", "link_type"])


@query(f"""WITH {_MOVES}, p AS (SELECT 'customer/' || c_custkey AS slug, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS body FROM customer)
SELECT coalesce(now, slug) AS page, coalesce(string_agg(body, chr(10) || chr(10) ORDER BY now IS NOT NULL, slug) FILTER (body <> ''), '') AS body FROM p LEFT JOIN moves ON was = slug GROUP BY coalesce(now, slug)""")
def merge_bodies(spark, d):
    k = F.col("c_custkey")
    p = V.table(spark, d, "customer").select(_id("customer/", "c_custkey").alias("slug"), F.when(k % 5 == 0, "").otherwise(F.col("c_mktsegment")).alias("body"))
    return C.folded(p, _moves(spark, d))


def _moves(spark, d):
    k = F.col("c_custkey")
    return V.table(spark, d, "customer").filter(k % 4 == 0).select(_id("customer/", "c_custkey").alias("was"), F.concat(F.lit("customer/"), (k - 1).cast("string")).alias("now"))


# sortings, profiles, rates


@query(f"""WITH {_PAGES}, {_CONTRIB}, n AS (SELECT page, count(*) AS n FROM contrib_v GROUP BY page) SELECT slug, coalesce(n, 0) AS key FROM pages_v LEFT JOIN n ON page = slug ORDER BY key DESC, slug LIMIT 30""")
def page_sort_backlinks(spark, d):
    links = V.contributions(spark, d).select(F.col("page").alias("dst"))
    return C.sorted_pages(V.pages(spark, d), "backlinks", links, limit=30).select("slug", "key")


@query(f"WITH {_PAGES} SELECT slug, title AS key FROM pages_v ORDER BY title, slug LIMIT 30")
def page_sort_title(spark, d):
    return C.sorted_pages(V.pages(spark, d), "title", descending=False, limit=30).select("slug", "key")


@query(f"WITH {_PAGES}, {_SOURCED} SELECT slug, seen_s AS key FROM sourced ORDER BY seen_s DESC, slug LIMIT 30")
def page_sort_signal(spark, d):
    return C.sorted_pages(V.sourced_pages(spark, d), "signal_time", limit=30).select("slug", "key")


@query(f"""WITH {_LINKS}, {_TIMELINE} SELECT 'order' AS part, src AS slug, o_orderstatus AS text FROM links_v JOIN orders ON 'order/' || o_orderkey = src WHERE dst = 'customer/7'
UNION ALL SELECT 'timeline', date, summary FROM timeline_v WHERE slug = 'customer/7'""")
def profile_lists(spark, d):
    pages = V.table(spark, d, "orders").select(_id("order/", "o_orderkey").alias("slug"), F.lit("order").alias("type"), F.col("o_orderstatus").alias("title"))
    return C.profile("customer/7", pages, V.links(spark, d), V.timeline(spark, d))


@query(f"""WITH {_TIMELINE} SELECT slug, string_agg(date || ' ' || summary, chr(10) ORDER BY date, entry_id) AS entries FROM timeline_v GROUP BY slug""")
def timeline_lists(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("date", "entry_id", F.concat_ws(" ", "date", "summary").alias("line"))))
    return V.timeline(spark, d).groupBy("slug").agg(F.array_join(rows["line"], "\n").alias("entries"))


@query(f"""WITH {_PAGES}, k AS (SELECT type, {"CASE WHEN length(k) >= 3 THEN k WHEN k = '' THEN left(sha256(title), 12) ELSE k || '-' || left(sha256(title), 12) END"} AS topic FROM (SELECT type, title, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS k FROM pages_v)),
n AS (SELECT type, topic FROM k) SELECT type, topic, count(*) AS n FROM n GROUP BY type, topic HAVING count(*) > 1""")
def payload_topics(spark, d):
    from engramlake.operators import rules

    return rules.repeated(V.pages(spark, d).withColumn("topic", T.slugify(F.col("title"))), ["type", "topic"])


@query("""WITH r AS (SELECT doc_id % 5 = 0 AS held, quality, toxic FROM labels), x AS (SELECT CASE WHEN held THEN 'holdout' ELSE 'baseline' END AS kind, count(*) FILTER (quality = 1 AND toxic <> 0) / greatest(count(*) FILTER (quality = 1), 1)::DOUBLE AS miss,
 count(*) FILTER (quality <> 1 AND toxic = 0) / greatest(count(*) FILTER (toxic = 0), 1)::DOUBLE AS noise FROM r GROUP BY held),
y AS (SELECT max(noise) FILTER (kind = 'baseline') AS n0, max(noise) FILTER (kind = 'holdout') AS n1, max(miss) FILTER (kind = 'holdout') <= max(miss) FILTER (kind = 'baseline') AS miss_kept FROM x)
SELECT round(CASE WHEN n0 = 0 THEN 0 ELSE (n0 - n1) / n0 END, 6)::DOUBLE AS noise_drop, miss_kept, CASE WHEN n0 = 0 THEN 0 ELSE (n0 - n1) / n0 END >= 0.8::DOUBLE AND miss_kept AS passed FROM y""")
def eval_acceptance(spark, d):
    n = lambda test: F.sum(F.when(test, 1.0).otherwise(0.0))
    good, kept = F.col("quality") == 1, F.col("toxic") == 0
    x = V.table(spark, d, "labels").groupBy(F.when(F.col("doc_id") % 5 == 0, "holdout").otherwise("baseline").alias("kind"))
    return C.accepted(x.agg((n(good & ~kept) / F.greatest(n(good), F.lit(1.0))).alias("miss"), (n(~good & kept) / F.greatest(n(kept), F.lit(1.0))).alias("noise")))


# handles, ladders, entries, vault links, stamps


_PEOPLE = """n AS (SELECT 'model/' || c_custkey AS slug, CASE c_custkey % 8 WHEN 0 THEN c_name WHEN 1 THEN 'Ann Li ' || chr((65 + c_custkey % 26)::INTEGER) WHEN 2 THEN 'user ou_a' || c_custkey WHEN 3 THEN '王' WHEN 4 THEN 'Bo Ek' WHEN 5 THEN 'bo  ek' WHEN 6 THEN 'Cy' ELSE 'Dee Dee' END AS name FROM customer),
h AS (SELECT name, min('handle/' || c_custkey) AS h FROM (SELECT c_name AS name, c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY name),
c AS (SELECT 'model/' || s_suppkey AS ext, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'cached/' || s_suppkey END AS disp, 'hint ' || s_suppkey AS hint FROM supplier WHERE s_suppkey % 5 = 0
 UNION ALL SELECT 'x/1', 'person/cy-one', 'Cy' UNION ALL SELECT 'x/2', 'person/bo-ek', 'Bo Ek'),
l AS (SELECT * FROM c WHERE disp <> ''), s AS (SELECT ext AS slug, min(disp) AS s FROM l GROUP BY ext), k AS (SELECT hint AS name, min(disp) AS k FROM l GROUP BY hint), o AS (SELECT disp AS own, min(hint) AS lo, max(hint) AS hi FROM l GROUP BY disp),
p AS (SELECT slug, name, CASE WHEN regexp_matches(name, '^user ou_[a-zA-Z0-9]+$') THEN 'person/' || lower(split_part(name, ' ', 2)) WHEN regexp_matches(name, '^[a-zA-Z\\s\\-\\x27]+$') THEN 'person/' || regexp_replace(replace(lower(trim(name)), chr(39), '-'), '\\s+', '-', 'g') END AS own FROM n),
j AS (SELECT p.*, h, s.s, k.k, lo, hi FROM p LEFT JOIN h USING (name) LEFT JOIN s USING (slug) LEFT JOIN k USING (name) LEFT JOIN o USING (own)),
z AS (SELECT *, CASE WHEN h IS NOT NULL THEN 'handle' WHEN s IS NOT NULL THEN 'slug' WHEN k IS NOT NULL THEN 'name' WHEN own IS NULL THEN 'kept' WHEN lo IS NOT NULL AND (lo <> name OR hi <> name) AND NOT starts_with(own, 'person/ou_') THEN 'collision' ELSE 'canonical' END AS step FROM j)"""


@query(f"WITH {_PEOPLE} SELECT slug, name, coalesce(h, s, k, CASE WHEN step = 'canonical' THEN own END, slug) AS canonical, step FROM z")
def identity_ladder(spark, d):
    from engramlake.operators import identity as I

    k = F.col("c_custkey")
    c = V.table(spark, d, "customer")
    ann = F.concat(F.lit("Ann Li "), F.char((k % 26 + 65).cast("long")))
    name = F.when(k % 8 == 0, F.col("c_name")).when(k % 8 == 1, ann).when(k % 8 == 2, _id("user ou_a", "c_custkey")).when(k % 8 == 3, "王").when(k % 8 == 4, "Bo Ek").when(k % 8 == 5, "bo  ek").when(k % 8 == 6, "Cy").otherwise("Dee Dee")
    handles = c.filter(k % 3 == 0).select(F.col("c_name").alias("value"), _id("handle/", "c_custkey").alias("slug"))
    j = F.col("s_suppkey")
    cache = V.table(spark, d, "supplier").filter(j % 5 == 0).select(_id("model/", "s_suppkey").alias("external_id"), F.when(j % 4 != 0, _id("cached/", "s_suppkey")).alias("display_name"), _id("hint ", "s_suppkey").alias("slug_hint"))
    more = spark.createDataFrame([("x/1", "person/cy-one", "Cy"), ("x/2", "person/bo-ek", "Bo Ek")], cache.schema)
    return I.ladder(c.select(_id("model/", "c_custkey").alias("slug"), name.alias("name")), handles, cache.unionByName(more))


@query("SELECT 'name' AS kind, c_name AS value, 'p/' || c_custkey AS slug FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def handles_left(spark, d):
    from engramlake.operators import identity as I

    c = V.table(spark, d, "customer")
    handles = c.select(F.lit("name").alias("kind"), F.col("c_name").alias("value"), _id("p/", "c_custkey").alias("slug"))
    gone = c.join(V.table(spark, d, "supplier"), F.col("c_custkey") == F.col("s_suppkey"), "left_semi").select(F.lit("name").alias("kind"), F.col("c_name").alias("value"))
    return I.without_handles(handles, gone)


_ENTRIES = """o AS (SELECT 'customer/' || o_custkey AS slug, o_orderkey::VARCHAR AS date, o_orderstatus AS summary, 'old ' || o_orderkey AS detail, 'crm' AS source FROM orders WHERE o_orderkey % 3 <> 0),
n AS (SELECT CASE WHEN o_orderkey % 10 = 7 THEN 'nobody/' || o_custkey ELSE 'customer/' || o_custkey END AS slug, o_orderkey::VARCHAR AS date, o_orderstatus AS summary, CASE WHEN o_orderkey % 4 <> 0 THEN 'new ' || o_orderkey END AS detail, CASE WHEN o_orderkey % 5 = 0 THEN 'mail' END AS source FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 10 = 7),
k AS (SELECT n.* FROM n WHERE slug IN (SELECT 'customer/' || c_custkey FROM customer))"""


@query(f"WITH {_ENTRIES} SELECT slug, date, summary, coalesce(k.detail, o.detail) AS detail, coalesce(k.source, o.source) AS source FROM o FULL JOIN k USING (slug, date, summary)")
def timeline_upsert(spark, d):
    return _entries(spark, d)[0]


@query(f"WITH {_ENTRIES} SELECT slug, date FROM n WHERE slug NOT IN (SELECT 'customer/' || c_custkey FROM customer)")
def timeline_orphans(spark, d):
    return _entries(spark, d)[1].select("slug", "date")


def _entries(spark, d):
    k = F.col("o_orderkey")
    o = V.table(spark, d, "orders")
    row = lambda slug, detail, source: [slug.alias("slug"), k.cast("string").alias("date"), F.col("o_orderstatus").alias("summary"), detail.alias("detail"), source.alias("source")]
    own = _id("customer/", "o_custkey")
    old = o.filter(k % 3 != 0).select(*row(own, _id("old ", "o_orderkey"), F.lit("crm")))
    new = o.filter((k % 2 == 0) | (k % 10 == 7)).select(*row(F.when(k % 10 == 7, _id("nobody/", "o_custkey")).otherwise(own), F.when(k % 4 != 0, _id("new ", "o_orderkey")), F.when(k % 5 == 0, "mail")))
    return C.upserted_entries(old, new, V.table(spark, d, "customer").select(_id("customer/", "c_custkey").alias("slug")))


@query(rf"""WITH {_PAGES}, f AS (SELECT slug, doc_id, list_distinct(list_concat(CASE WHEN doc_id % 2 = 0 THEN [type, channel] ELSE [] END, list_transform(regexp_extract_all('see [[' || coalesce(tier, '') || '|here]] [[ ' || type || ' ]] [[]] ' || coalesce(body, ''), '\[\[([^\]|]+)(?:\|[^\]]*)?\]\]', 1), lambda t: trim(t)))) AS l FROM pages_v),
x AS (SELECT slug, unnest(l) AS target FROM f) SELECT slug, target FROM x WHERE target <> '' AND NOT EXISTS (SELECT 1 FROM pages_v h WHERE h.doc_id % 3 = 0 AND h.slug = x.slug AND h.tier = x.target)""")
def vault_links(spark, d):
    p = V.pages(spark, d)
    body = F.concat(F.lit("see [["), F.coalesce("tier", F.lit("")), F.lit("|here]] [[ "), "type", F.lit(" ]] [[]] "), F.coalesce("body", F.lit("")))
    files = p.select("slug", F.when(F.col("doc_id") % 2 == 0, F.array("type", "channel")).alias("named"), body.alias("body"))
    have = p.filter("doc_id % 3 = 0").select(F.col("slug").alias("src"), F.col("tier").alias("dst"), F.lit("vault").alias("link_type"))
    other = p.select(F.col("slug").alias("src"), F.col("type").alias("dst"), F.lit("mentions").alias("link_type"))
    return C.imported_links(files, have.unionByName(other), "vault")


@query("""WITH p AS (SELECT event_id AS id, 'r' || user_id AS revision, CASE WHEN event_id % 6 = 0 THEN event_id END AS expires_s FROM events), s AS (SELECT DISTINCT 'r' || c_custkey AS revision FROM customer WHERE c_custkey % 3 IN (0, 2))
SELECT id, coalesce(expires_s, CASE WHEN s.revision IS NOT NULL THEN 1706745600 + 2592000 END) AS expires_s FROM p LEFT JOIN s USING (revision)""")
def ttl_stamp(spark, d):
    i, k = F.col("event_id"), F.col("c_custkey")
    p = V.table(spark, d, "events").select(i.alias("id"), _id("r", "user_id").alias("revision"), F.when(i % 6 == 0, i).alias("expires_s"))
    ledger = V.table(spark, d, "customer").select(_id("r", "c_custkey").alias("revision"), F.element_at(F.array(F.lit("done"), F.lit("retrying"), F.lit("dead_letter")), (k % 3 + 1).cast("int")).alias("state"))
    return C.stamped_expiry(p, ledger, ["done", "dead_letter"], AS_OF_S, 2592000).select("id", "expires_s")


@query("""WITH c AS (SELECT event_id, ['dm/','group/','mail/','docs/','doc/','calendar/','task/','agent/','tasks','x/'][event_id % 10 + 1] AS p, CASE WHEN user_id % 7 = 0 THEN 'agent' ELSE 'chat' END AS platform, CASE WHEN event_id % 13 = 0 THEN 'document' END AS fallback FROM events)
SELECT event_id, CASE WHEN platform = 'agent' THEN 'agent_session' WHEN fallback IS NOT NULL THEN fallback WHEN p = 'dm/' THEN 'dm' WHEN p = 'group/' THEN 'group' WHEN p = 'mail/' THEN 'email' WHEN p IN ('docs/', 'doc/') THEN 'document' WHEN p = 'calendar/' THEN 'calendar'
 WHEN p IN ('task/', 'tasks') THEN 'task' WHEN p = 'agent/' THEN 'agent_session' ELSE 'chat' END AS source_type FROM c""")
def block_source_type(spark, d):
    from engramlake.functions import messages as M

    i = F.col("event_id")
    names = F.array(*map(F.lit, ("dm/", "group/", "mail/", "docs/", "doc/", "calendar/", "task/", "agent/", "tasks", "x/")))
    channel = F.element_at(names, (i % 10 + 1).cast("int"))
    channel = F.when(channel == "tasks", channel).otherwise(F.concat(channel, "event_type"))
    return V.table(spark, d, "events").select("event_id", M.block_source_type(channel, F.when(i % 13 == 0, "document"), F.when(F.col("user_id") % 7 == 0, "agent").otherwise("chat")).alias("source_type"))


# sortings and lists


@query(f"WITH {_PAGES} SELECT slug, created_s + doc_id * 7919 % 100000 AS key FROM pages_v ORDER BY key DESC, slug LIMIT 20")
def page_sort_updated(spark, d):
    p = V.pages(spark, d).withColumn("updated_s", F.col("created_s") + F.col("doc_id") * 7919 % 100000)
    return C.sorted_pages(p, "updated_at").select("slug", "key")


_SESSIONS = """s AS (SELECT 'conv-' || conv_id AS session, 'a' || conv_id % 3 AS source, CASE WHEN count(*) % 3 = 0 THEN 'failed' WHEN count(*) % 3 = 1 THEN 'distilled' ELSE 'pending' END AS state,
  1704067200 + conv_id * 3600 + max(turn) * 60 AS newest_s, count(*) FILTER (role = 'assistant') % 4 AS tries FROM conversations GROUP BY conv_id)"""


def _sessions(spark, d):
    k, n = F.col("conv_id"), F.count(F.lit(1))
    state = F.when(n % 3 == 0, "failed").when(n % 3 == 1, "distilled").otherwise("pending")
    x = V.table(spark, d, "conversations").groupBy("conv_id").agg(state.alias("state"), F.max("turn").alias("last"), (F.count(F.when(F.col("role") == "assistant", 1)) % 4).alias("tries"))
    return x.select(_id("conv-", "conv_id").alias("session"), F.concat(F.lit("a"), (k % 3).cast("string")).alias("source"), "state", (1704067200 + k * 3600 + F.col("last") * 60).alias("newest_s"), "tries")


@query(f"WITH {_SESSIONS} SELECT * FROM s WHERE source = 'a1' AND state = 'failed' ORDER BY newest_s DESC, session LIMIT 50")
def sessions_failed(spark, d):
    return C.listed_sessions(_sessions(spark, d), "a1", "failed")


@query(f"WITH {_SESSIONS} SELECT * FROM s ORDER BY newest_s DESC, session LIMIT 50")
def sessions_newest(spark, d):
    return C.listed_sessions(_sessions(spark, d))
