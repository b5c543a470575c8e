"""Queries over structured sources, canonical texts, slugs, fingerprints, gates and bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake import views as V
from engramlake.functions import messages as M
from engramlake.functions import text as T
from engramlake.operators import graph as G
from engramlake.operators import ledger as L
from engramlake.operators import signals as N
from engramlake.queries import _CONTRIB, _DM, _GROUP, _LINKS, _PAGES, _TIMELINE, AS_OF_S
from engramlake.registry import query
from engramlake.sources import structured as S


def _id(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


@query("""WITH i AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'me' ELSE 'p' || conv_id % 9 END AS sender, CASE WHEN turn % 10 = 9 THEN 'soon' ELSE (1704067200123 + conv_id * 60000 + turn)::VARCHAR END AS t, text FROM conversations)
SELECT 'dm/' || conv_id AS channel, sender AS contact, try_cast(t AS BIGINT) // 1000 AS at_s, CASE WHEN sender = 'me' THEN 'sent' ELSE 'received' END AS direction, text AS content FROM i""")
def dm_scan(spark, d):
    who = F.when(F.col("role") == "user", "me").otherwise(F.concat(F.lit("p"), (F.col("conv_id") % 9).cast("string")))
    at = F.when(F.col("turn") % 10 == 9, "soon").otherwise((F.lit(1704067200123) + F.col("conv_id") * 60000 + F.col("turn")).cast("string"))
    return S.direct(V.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("chat_id"), who.alias("sender_id"), at.alias("create_time"), F.col("text").alias("content")), "me")


@query(f"""WITH {_GROUP}, c AS (SELECT channel, (min(at_s) + 864000)::BIGINT AS cursor_s FROM group_v WHERE channel <> 'group/error' GROUP BY channel)
SELECT event_id, channel, at_s FROM group_v LEFT JOIN c USING (channel) WHERE at_s <= 1706000000 AND (cursor_s IS NULL OR at_s >= cursor_s - 2)""")
def chat_window(spark, d):
    m = V.group_messages(spark, d)
    cursors = m.filter("channel <> 'group/error'").groupBy("channel").agg((F.min("at_s") + 864000).alias("cursor_s"))
    return S.windowed(m, cursors, 1706000000).select("event_id", "channel", "at_s")


@query("""WITH c AS (SELECT conv_id, CASE WHEN conv_id % 3 <> 0 THEN 1700000000000 + conv_id * 1000000 END AS cursor FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN cursor IS NULL OR 1700010000000 < cursor THEN 1700010000000 ELSE cursor END AS start_ms, coalesce(cursor, 1706745600000 - 30 * 86400000::BIGINT) AS plain_ms FROM c""")
def start_times(spark, d):
    c = V.table(spark, d, "conversations").select("conv_id").distinct().withColumn("cursor", F.when(F.col("conv_id") % 3 != 0, F.lit(1700000000000) + F.col("conv_id") * 1000000))
    return c.select("conv_id", S.start_of(F.col("cursor"), 1700010000000, 1706745600000, 30).alias("start_ms"), S.start_of(F.col("cursor"), None, 1706745600000, 30).alias("plain_ms"))


@query(r"""WITH e AS (SELECT o_orderkey AS event_id, 'c' || o_custkey % 5 AS calendar_id, o_orderpriority AS summary, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS description, CASE WHEN o_orderkey % 4 = 0 THEN 'room ' || o_custkey END AS place,
 CASE WHEN o_orderkey % 5 < 3 THEN epoch(o_orderdate::TIMESTAMP)::BIGINT END AS s, CASE WHEN o_orderkey % 5 = 3 THEN strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 7 <> 0 THEN 'u' || o_custkey END AS organizer FROM orders),
t AS (SELECT *, coalesce(s, epoch(try_cast(day AS DATE))::BIGINT, 855000000) AS at_s FROM e)
SELECT event_id, 'calendar/' || calendar_id AS channel, coalesce(organizer, 'unknown') AS contact, CASE WHEN s IS NULL AND day IS NOT NULL THEN day ELSE strftime(to_timestamp(coalesce(s, 855000000)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') END AS "at",
 concat_ws(chr(10), nullif(summary, ''), nullif(description, ''), '地点: ' || nullif(place, '')) AS content FROM t WHERE at_s BETWEEN 855000000 - 30 * 86400 AND 855000000 + 90 * 86400""")
def calendar_window(spark, d):
    k = F.col("o_orderkey")
    e = V.table(spark, d, "orders").select(
        k.alias("event_id"), F.concat(F.lit("c"), (F.col("o_custkey") % 5).cast("string")).alias("calendar_id"), F.col("o_orderpriority").alias("summary"), F.when(k % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("description"),
        F.when(k % 4 == 0, _id("room ", "o_custkey")).alias("place"), F.when(k % 5 < 3, F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("start_s"),
        F.when(k % 5 == 3, F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd")).alias("start_date"), F.when(k % 7 != 0, _id("u", "o_custkey")).alias("organizer"),
    )
    return S.calendar(e, 855000000)


@query("""WITH t AS (SELECT event_id, event_type AS summary, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'note ' || user_id END AS description, CASE WHEN event_id % 4 = 0 THEN '1700000000' ELSE '' END AS done, CASE WHEN event_id % 5 = 0 THEN 'high' END AS priority, 1700000000 + event_id AS updated_s,
 [struct_pack(id := 'u' || user_id, role := 'assignee'), struct_pack(id := 'u' || user_id % 7, role := CASE WHEN event_id % 2 = 0 THEN 'follower' ELSE 'assignee' END)] AS members FROM events)
SELECT 'g' || event_id AS guid, concat_ws(chr(10), nullif(summary, ''), nullif(description, '')) AS content, CASE WHEN coalesce(done, '') <> '' THEN 'completed' ELSE 'open' END AS status,
 list_transform(list_filter(members, lambda m: m.role = 'assignee'), lambda m: m.id) AS assignees, list_transform(list_filter(members, lambda m: m.role = 'follower'), lambda m: m.id) AS followers, coalesce(priority, 'none') AS priority FROM t WHERE updated_s >= 1700000050""")
def tasks_since(spark, d):
    i = F.col("event_id")
    who = lambda k, role: F.struct(F.concat(F.lit("u"), k.cast("string")).alias("id"), role.alias("role"))
    members = F.array(who(F.col("user_id"), F.lit("assignee")), who(F.col("user_id") % 7, F.when(i % 2 == 0, "follower").otherwise("assignee")))
    t = V.table(spark, d, "events").select(
        _id("g", "event_id").alias("guid"), F.col("event_type").alias("summary"), F.when(i % 3 != 0, _id("note ", "user_id")).alias("description"), members.alias("members"), F.when(i % 5 == 0, "high").alias("priority"),
        F.when(i % 4 == 0, "1700000000").otherwise("").alias("completed_at"), (i + 1700000000).alias("updated_s"),
    )
    return S.tasks(t, 1700000050)


@query("""WITH b AS (SELECT event_id, unnest([struct_pack(i := 1, kind := ['2','3','12','99','17'][event_id % 5 + 1], text := event_type), struct_pack(i := 2, kind := '14', text := CASE WHEN event_id % 3 = 0 THEN '' ELSE 'code ' || user_id END), struct_pack(i := 3, kind := '5', text := NULL)]) AS b FROM events)
SELECT event_id, coalesce(string_agg(b.text, chr(10) ORDER BY b.i) FILTER (b.kind IN ('2', '3', '4', '5', '12', '13', '14', '15', '17') AND b.text <> ''), '') AS text FROM b GROUP BY event_id""")
def doc_text(spark, d):
    i = F.col("event_id")
    kinds = F.array(*map(F.lit, ("2", "3", "12", "99", "17")))
    b = lambda kind, text: F.struct(kind.alias("kind"), text.alias("text"))
    blocks = F.array(b(F.element_at(kinds, (i % 5 + 1).cast("int")), F.col("event_type")), b(F.lit("14"), F.when(i % 3 == 0, "").otherwise(_id("code ", "user_id"))), b(F.lit("5"), F.lit(None).cast("string")))
    return V.table(spark, d, "events").select("event_id", S.block_text(blocks).alias("text"))


@query(r"""SELECT event_id, concat_ws(chr(10), 'Event: e' || event_id, CASE WHEN event_id % 2 = 0 THEN 'Location: hall' END, CASE WHEN event_id % 3 <> 0 THEN 'Status: ' || event_type END, CASE WHEN event_id % 5 = 0 THEN 'Attendees: a, b' END) || chr(10) || chr(10) || event_type || ' at ' || user_id AS text FROM events""")
def canon_structured(spark, d):
    i = F.col("event_id")
    pairs = {"event_id": _id("e", "event_id"), "location": F.when(i % 2 == 0, "hall").otherwise(""), "status": F.when(i % 3 != 0, F.col("event_type")), "attendees": F.when(i % 5 == 0, "a, b"), "other": F.lit("x")}
    meta = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])
    return V.table(spark, d, "events").select("event_id", S.structured_text(meta, F.concat(F.lit("  "), "event_type", F.lit(" at "), F.col("user_id").cast("string"), F.lit("\n"))).alias("text"))


@query(rf"""WITH {_PAGES}, t AS (SELECT slug, CASE WHEN doc_id % 10 = 0 THEN '!? Ünï_code -- ' || title ELSE title END AS t FROM pages_v)
SELECT slug, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(t), '^\s+|\s+$', '', 'g'), '[^\p{{L}}\p{{N}}\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS topic FROM t""")
def topic_slugs(spark, d):
    t = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("!? Ünï_code -- "), "title")).otherwise(F.col("title"))
    return V.pages(spark, d).select("slug", S.topic_slug(t).alias("topic"))


@query(rf"""WITH {_PAGES}, t AS (SELECT slug, CASE WHEN doc_id % 10 = 0 THEN 'мир ' || '!' ELSE left(title, 30) END AS t FROM pages_v), k AS (SELECT slug, t, regexp_replace(regexp_replace(lower(t), '[^a-z0-9一-鿿㐀-䶿]+', '-', 'g'), '^-+|-+$', '', 'g') AS k FROM t)
SELECT slug, CASE WHEN k <> '' THEN left(k, 80) ELSE lpad(lower(hex(list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(t, ''), lambda c: ord(c)::HUGEINT)), lambda a, c: (a * 31 + c) % 4294967296)::BIGINT)), 12, '0') END AS topic FROM k""".replace("lower(hex(", "lower(printf('%x', ").replace(")::BIGINT)), 12", ")::BIGINT)), 12"))
def knowledge_slugs(spark, d):
    t = F.when(F.col("doc_id") % 10 == 0, "мир !").otherwise(F.substring("title", 1, 30))
    return V.pages(spark, d).withColumn("t", t).select("slug", S.knowledge_slug(F.col("t")).alias("topic"))


@query("""WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '2024-02-03' WHEN 1 THEN '2024-02-30' WHEN 2 THEN '2024-02-03T04:05:06Z' WHEN 3 THEN 'soon' WHEN 4 THEN '2024-13-01T00:00:00Z' END AS t FROM events)
SELECT event_id, CASE WHEN regexp_full_match(t, '\\d{4}-\\d{2}-\\d{2}') AND try_cast(t AS DATE) IS NOT NULL THEN t || 'T00:00:00.000Z' WHEN regexp_matches(t, '^\\d{4}-\\d{2}-\\d{2}T') AND try_cast(replace(t, 'Z', '') AS TIMESTAMP) IS NOT NULL THEN t END AS "at",
 t IS NOT NULL AND NOT coalesce((regexp_full_match(t, '\\d{4}-\\d{2}-\\d{2}') AND try_cast(t AS DATE) IS NOT NULL) OR (regexp_matches(t, '^\\d{4}-\\d{2}-\\d{2}T') AND try_cast(replace(t, 'Z', '') AS TIMESTAMP) IS NOT NULL), false) AS bad FROM t""".replace("\\\\", "\\"))
def coerced_times(spark, d):
    i = F.col("event_id") % 6
    t = F.when(i == 0, "2024-02-03").when(i == 1, "2024-02-30").when(i == 2, "2024-02-03T04:05:06Z").when(i == 3, "soon").when(i == 4, "2024-13-01T00:00:00Z")
    x = V.table(spark, d, "events").select("event_id", t.alias("t"))
    return x.select("event_id", S.iso_time(F.col("t")).alias("at"), S.bad_time(F.col("t")).alias("bad"))


@query("""WITH r AS (SELECT doc_id, to_json(struct_pack(topic := source, n := doc_id, tags := CASE WHEN doc_id % 2 = 0 THEN ['}', lang] ELSE [']'] END)) AS j FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE json_extract_string(j, '$.topic') END AS topic, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE json_extract_string(j, '$.tags[0]') END AS tag FROM r""")
def salvage_json(spark, d):
    i = F.col("doc_id")
    tags = F.when(i % 2 == 0, F.array(F.lit("}"), F.col("lang"))).otherwise(F.array(F.lit("]")))
    j = F.to_json(F.struct(F.col("source").alias("topic"), i.alias("n"), tags.alias("tags")))
    raw = F.when(i % 4 == 0, F.concat(F.lit("```json\n"), j, F.lit("\n```"))).when(i % 4 == 1, F.concat(F.lit("Here it is: "), j, F.lit(" {done}"))).when(i % 4 == 2, j).otherwise(F.concat(F.lit("cut "), F.substring(j, 1, 12)))
    x = S.salvaged(V.table(spark, d, "documents").select("doc_id", raw.alias("raw")), "raw")
    return x.select("doc_id", F.get_json_object("json", "$.topic").alias("topic"), F.get_json_object("json", "$.tags[0]").alias("tag"))


@query("""SELECT doc_id, CASE WHEN lang IS NULL AND source IS NULL THEN '{"n":' || doc_id || '}' ELSE '{' || concat_ws(',', '"n":' || doc_id, CASE WHEN lang IS NOT NULL OR source IS NOT NULL THEN '"source":{' || concat_ws(',', CASE WHEN lang IS NOT NULL THEN '"platform":"' || lang || '"' END, CASE WHEN source IS NOT NULL THEN '"channel":"' || source || '"' END) || '}' END) || '}' END AS compact FROM documents""")
def compact_refs(spark, d):
    raw = F.to_json(F.struct(F.col("doc_id").alias("n"), F.struct(F.col("lang").alias("platform"), F.col("source").alias("channel"), F.lit(None).cast("string").alias("url")).alias("source"), F.array().cast("array<string>").alias("tags"), F.array(F.lit(None).cast("string")).alias("more")), {"ignoreNullFields": "false"})
    return S.compacted(V.table(spark, d, "documents").select("doc_id", raw.alias("raw")), "raw").select("doc_id", "compact")


def _hints_sql() -> str:
    from engramlake.plans.memory import _entity_sql

    first = {k: v.removeprefix("list_distinct(").removesuffix(")") for k, v in _entity_sql("text").items()}
    lists = ", ".join(f"{v} AS {k}" for k, v in first.items())
    once = ", ".join(f"list_filter({k}, lambda x, i: list_position({k}, x) = i) AS {k}" for k in first)
    line = ", ".join(f"CASE WHEN len({k}) > 0 THEN '- {k}s: ' || array_to_string({k}[1:5], ', ') || CASE WHEN len({k}) > 5 THEN ' (+' || (len({k}) - 5) || ' more)' ELSE '' END END" for k in first)
    return f"WITH a AS (SELECT doc_id, {lists} FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)), o AS (SELECT doc_id, {once} FROM a) SELECT doc_id, concat_ws(chr(10), {line}) AS hints FROM o"


@query(_hints_sql())
def entity_hints(spark, d):
    return V.table(spark, d, "documents").select("doc_id", M.entity_hints(F.coalesce("text", F.lit(""))).alias("hints"))


@query("""WITH f AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'local:small:64' ELSE 'local:base:64' END AS have FROM documents) SELECT have, count(*) AS chunks, have = 'local:base:64' AS usable FROM f GROUP BY have""")
def embedding_fingerprints(spark, d):
    have = F.when(F.col("doc_id") % 3 == 0, "local:small:64").otherwise("local:base:64")
    return L.fingerprints(V.table(spark, d, "documents").select(have.alias("have")), "local", "base", 64)


@query(f"""WITH {_GROUP}, g AS (SELECT contact AS key, count(*) AS n, sha256(contact || ':' || count(*)) AS h FROM group_v GROUP BY contact)
SELECT key, CASE WHEN key IN ('user-2', 'user-7') THEN 'denied' WHEN right(key, 1) IN ('8', '9') THEN 'not allowed' WHEN n < 70 THEN 'too few' WHEN right(key, 1) IN ('1', '3') THEN 'unchanged' ELSE 'profile' END AS step FROM g""")
def profile_allow(spark, d):
    g = V.group_messages(spark, d).groupBy(F.col("contact").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("input_hash", F.sha2(F.concat_ws(":", "key", "n"), 256))
    allowed = g.filter(~F.substring("key", -1, 1).isin("8", "9")).select("key")
    return N.profilable(g, 70, g.filter(F.substring("key", -1, 1).isin("1", "3")), ["user-2", "user-7"], allowed)


@query(f"""WITH {_LINKS}, {_TIMELINE}, c AS (SELECT 'customer/' || c_custkey AS slug FROM customer), o AS (SELECT src AS slug, string_agg(dst || ' ' || link_type, ',' ORDER BY dst, link_type) AS links FROM links_v GROUP BY src),
b AS (SELECT dst AS slug, src, row_number() OVER (PARTITION BY dst ORDER BY src) AS n FROM links_v), b2 AS (SELECT slug, string_agg(src, ',' ORDER BY src) AS backlinks FROM b WHERE n <= 20 GROUP BY slug),
t AS (SELECT slug, date || ' ' || summary AS e, row_number() OVER (PARTITION BY slug ORDER BY date DESC, entry_id) AS n FROM timeline_v), t2 AS (SELECT slug, string_agg(e, ',' ORDER BY n) AS timeline FROM t WHERE n <= 20 GROUP BY slug)
SELECT slug, coalesce(links, '') AS links, coalesce(backlinks, '') AS backlinks, coalesce(timeline, '') AS timeline FROM c LEFT JOIN o USING (slug) LEFT JOIN b2 USING (slug) LEFT JOIN t2 USING (slug)""")
def page_bundles(spark, d):
    pages = V.table(spark, d, "customer").select(_id("customer/", "c_custkey").alias("slug"))
    return G.bundles(pages, V.links(spark, d), V.timeline(spark, d), 20)


@query(f"""WITH {_PAGES}, {_CONTRIB}, a AS (SELECT page, count(*) AS n, string_agg(DISTINCT signal_type, ',' ORDER BY signal_type) AS tags, min(strftime(to_timestamp(created_s) AT TIME ZONE 'UTC', '%Y-%m-%d')) AS first_day FROM contrib_v WHERE active GROUP BY page),
s AS (SELECT page, authority, row_number() OVER (PARTITION BY page ORDER BY authority <> 'user_confirmed', created_s, contribution_id) AS k FROM contrib_v WHERE active)
SELECT p.slug, a.n IS NULL AS orphaned, coalesce(a.n, 0) AS active, a.tags, a.first_day, s.authority AS source FROM pages_v p LEFT JOIN a ON a.page = p.slug LEFT JOIN s ON s.page = p.slug AND s.k = 1""")
def rematerialize_parts(spark, d):
    return L.derived_parts(V.pages(spark, d), V.contributions(spark, d))


@query(f"""WITH {_GROUP}, n AS (SELECT max(at_s) AS now FROM group_v) SELECT channel, count(*) AS runs, sum(CASE WHEN value > 100 THEN 1 ELSE 0 END)::BIGINT AS failed, round(sum(value), 2)::DOUBLE AS total FROM group_v, n WHERE at_s > now - 86400 GROUP BY channel""")
def run_stats_24h(spark, d):
    m = V.group_messages(spark, d)
    now = m.agg(F.max("at_s")).first()[0]
    x = m.filter(F.col("at_s") > now - 86400).groupBy("channel")
    return x.agg(F.count(F.lit(1)).alias("runs"), F.sum(F.when(F.col("value") > 100, 1).otherwise(0)).alias("failed"), F.round(F.sum("value"), 2).alias("total"))
