"""The queries over the memory store's operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engramlake import registry
from engramlake import views as V
from engramlake.functions import text as T
from engramlake.operators import activity as A
from engramlake.operators import graph as G
from engramlake.operators import ledger as L
from engramlake.operators import retrieval as R
from engramlake.registry import query as _query

AS_OF_S = 1706745600

_PAGES = """pages_v AS (SELECT doc_id, 'knowledge/doc-' || doc_id AS slug,
  ['decision','task','knowledge','preference','reference'][doc_id % 5 + 1] AS type, left(split_part(text, chr(10), 1), 80) AS title,
  text AS body, 1704067200 + doc_id * 3600 AS created_s, ['hot','warm','cold'][doc_id % 3 + 1] AS tier, lang AS platform, source AS channel
  FROM documents)"""
_LINKS = """links_v AS (SELECT 'customer/' || c_custkey AS src, 'nation/' || c_nationkey AS dst, 'part_of' AS link_type FROM customer
  UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey, 'part_of' FROM nation
  UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 'part_of' FROM supplier
  UNION ALL SELECT 'order/' || o_orderkey, 'customer/' || o_custkey, 'mentions' FROM orders)"""
_TIMELINE = """timeline_v AS (SELECT 'customer/' || o_custkey AS slug, strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d') AS date,
  o_orderpriority AS summary, o_orderstatus AS source, o_orderkey AS entry_id FROM orders)"""
_GROUP = """group_v AS (SELECT event_id, floor(epoch(ts::TIMESTAMP))::BIGINT AS at_s, 'group/' || event_type AS channel, 'user-' || user_id AS contact, value FROM events)"""
_DM = """dm_v AS (SELECT 'dm/' || conv_id AS channel, turn, CASE WHEN role = 'user' THEN 'sent' ELSE 'received' END AS direction, text AS content,
  1704067200 + conv_id * 3600 + turn * 2700 + (turn * 7 + conv_id) % 45 * 60 AS at_s FROM conversations)"""
_CONTRIB = """contrib_v AS (SELECT doc_id AS contribution_id, 'knowledge/doc-' || (doc_id % 50) AS page,
  CASE WHEN quality = 1 THEN 'user_confirmed' ELSE 'assistant_claimed' END AS authority,
  ['decision','task','knowledge','preference','reference'][doc_id % 5 + 1] AS signal_type, 'what ' || doc_id AS what,
  1704067200 + doc_id * 60 AS created_s, doc_id % 7 AS revision, 'family-' || (doc_id // 7) AS family, toxic = 0 AS active FROM labels)"""


def _grams(x: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _similarity(a: str, b: str) -> str:
    x, y = _grams(a), _grams(b)
    both = f"len(list_intersect({x}, {y}))"
    whole = f"(len({x}) + len({y}) - {both})"
    return f"CASE WHEN {whole} > 0 THEN {both} / {whole}::DOUBLE ELSE 0.0 END"


_CHUNKS = r"""chunk_v AS (SELECT doc_id, i::INTEGER AS chunk_index, array_to_string(w[i * 250 + 1:i * 250 + 300], ' ') AS chunk_text,
  len(w[i * 250 + 1:i * 250 + 300])::INTEGER AS token_count
  FROM (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) <= 300 THEN 1 ELSE 1 + ceil((len(w) - 300) / 250.0)::BIGINT END)) AS i
        FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)))"""


def _all() -> None:
    from engramlake.plans import distill, documents, feeds, ingest, knowledge, memory, merging, records, reports, store, streams, upkeep  # noqa: F401  (they enter their queries)


def queries() -> dict[str, registry.Query]:
    _all()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(registry.SQL)


# retrieval


@_query(f"WITH {_CHUNKS}, s AS (SELECT doc_id, chunk_index, chunk_text, round({_similarity('chunk_text', chr(39) + 'the and' + chr(39))}, 6) AS score FROM chunk_v WHERE contains(lower(chunk_text), 'the') AND contains(lower(chunk_text), 'and'))"
        " SELECT doc_id, chunk_index, score FROM s ORDER BY score DESC, doc_id, chunk_index LIMIT 20")
def search_chunks(spark, d):
    return R.find_chunks(V.pages(spark, d), "the and").drop("snippet")


@_query(f"WITH {_CHUNKS} SELECT doc_id, chunk_index, chunk_text, token_count FROM chunk_v")
def chunk_documents(spark, d):
    return R.chunks(V.pages(spark, d))


@_query(f"WITH {_PAGES}, s AS (SELECT slug, type, created_s, round(greatest({_similarity('title', chr(39) + 'thing' + chr(39))}, {_similarity('body', chr(39) + 'thing' + chr(39))}), 6) AS score FROM pages_v"
        " WHERE contains(lower(title), 'thing') OR contains(lower(body), 'thing')) SELECT slug, type, score FROM s ORDER BY score DESC, created_s DESC, slug LIMIT 20")
def search_lexical(spark, d):
    return R.search_pages(V.pages(spark, d), "thing")


@_query(f"WITH {_PAGES} SELECT slug, round({_similarity('title', chr(39) + 'the and of' + chr(39))}, 6) AS score FROM pages_v")
def trgm_similarity(spark, d):
    return V.pages(spark, d).select("slug", F.round(T.similarity(F.col("title"), F.lit("the and of")), 6).alias("score"))


def _query_vector(spark, d) -> list[float]:
    row = V.table(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()
    return list(row.embedding) if row else [1.0]


@_query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0 LIMIT 1),
s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM embeddings, q)
SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 10""")
def vector_knn(spark, d):
    return R.nearest(V.table(spark, d, "embeddings"), _query_vector(spark, d))


@_query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0 LIMIT 1),
s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM embeddings, q),
v AS (SELECT 'knowledge/doc-' || vec_id AS slug, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS rank FROM s ORDER BY score DESC, vec_id LIMIT 50),
c AS (SELECT 'knowledge/doc-' || doc_id AS slug, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents WHERE contains(lower(text), 'thing') ORDER BY n_chars DESC, doc_id LIMIT 50)
SELECT slug, round(max(1.0::DOUBLE / (61 + rank)), 6) AS rrf FROM (SELECT * FROM v UNION ALL SELECT * FROM c) GROUP BY slug""")
def rrf_fuse(spark, d):
    near = R.nearest(V.table(spark, d, "embeddings"), _query_vector(spark, d), 50)
    v = R.ranks(near, F.desc("score"), F.asc("vec_id")).select(F.concat(F.lit("knowledge/doc-"), F.col("vec_id").cast("string")).alias("slug"), "rank")
    docs = V.table(spark, d, "documents").filter(F.lower("text").contains("thing")).select("doc_id", "n_chars")
    top = docs.orderBy(F.desc("n_chars"), "doc_id").limit(50)
    c = R.ranks(top, F.desc("n_chars"), F.asc("doc_id")).select(F.concat(F.lit("knowledge/doc-"), F.col("doc_id").cast("string")).alias("slug"), "rank")
    return R.fuse([v, c]).withColumn("rrf", F.round("rrf", 6))


# pages, links, timeline


@_query(f"WITH {_PAGES} SELECT slug, type, title, tier FROM pages_v WHERE slug = 'knowledge/doc-7'")
def page_get(spark, d):
    return V.pages(spark, d).filter(F.col("slug") == "knowledge/doc-7").select("slug", "type", "title", "tier")


@_query(f"WITH {_PAGES} SELECT slug, type FROM pages_v WHERE type IN ('task', 'decision')")
def page_list_types(spark, d):
    return V.pages(spark, d).filter(F.col("type").isin("task", "decision")).select("slug", "type")


@_query(f"WITH {_PAGES} SELECT slug, type, created_s FROM pages_v WHERE tier = 'hot' ORDER BY created_s DESC, slug LIMIT 50")
def page_list_sorted(spark, d):
    return V.pages(spark, d).filter("tier = 'hot'").select("slug", "type", "created_s").orderBy(F.desc("created_s"), "slug").limit(50)


@_query(f"WITH {_PAGES} SELECT slug, tier, created_s FROM pages_v WHERE tier = 'warm'")
def pages_by_tier(spark, d):
    return V.pages(spark, d).filter("tier = 'warm'").select("slug", "tier", "created_s")


@_query(f"""WITH {_PAGES} SELECT slug, CASE WHEN tier = 'hot' THEN created_s + 86400 * CASE type WHEN 'decision' THEN 365 WHEN 'task' THEN 30 WHEN 'knowledge' THEN 180
 WHEN 'preference' THEN 90 ELSE 365 END END AS expires_s FROM pages_v""")
def expires_at(spark, d):
    days = F.create_map(*[F.lit(x) for kv in L.HALFLIFE.items() for x in kv])
    return V.pages(spark, d).select("slug", F.when(F.col("tier") == "hot", F.col("created_s") + 86400 * days[F.col("type")]).alias("expires_s"))


@_query(f"""WITH {_PAGES} SELECT slug, type FROM pages_v WHERE tier = 'hot' AND created_s + 86400 * CASE type WHEN 'decision' THEN 365 WHEN 'task' THEN 30 WHEN 'knowledge' THEN 180
 WHEN 'preference' THEN 90 ELSE 365 END <= {AS_OF_S + 86400 * 80}""")
def expired_hot(spark, d):
    return L.expired(V.pages(spark, d), AS_OF_S + 86400 * 80).select("slug", "type")


@_query(f"""WITH {_PAGES} SELECT slug, type FROM pages_v WHERE tier = 'warm' AND ({AS_OF_S + 86400 * 800} - created_s) >= 86400 * CASE type WHEN 'task' THEN 365 WHEN 'preference' THEN 365 WHEN 'knowledge' THEN 730 END""")
def warm_cold_eligible(spark, d):
    days = F.create_map(*[F.lit(x) for kv in L.COLD_DAYS.items() for x in kv])
    p = V.pages(spark, d).filter("tier = 'warm'")
    return p.filter(F.lit(AS_OF_S + 86400 * 800) - F.col("created_s") >= 86400 * F.try_element_at(days, F.col("type"))).select("slug", "type")


@_query(f"WITH {_LINKS} SELECT src, dst, link_type FROM links_v WHERE src = 'customer/7'")
def links_out(spark, d):
    return G.out_links(V.links(spark, d), "customer/7")


@_query(f"WITH {_LINKS} SELECT src, dst, link_type FROM links_v WHERE dst = 'nation/3'")
def links_in(spark, d):
    return G.in_links(V.links(spark, d), "nation/3")


@_query(f"WITH {_LINKS} SELECT src, dst, link_type FROM links_v")
def links_all(spark, d):
    return V.links(spark, d)


@_query(f"""WITH {_LINKS}, n AS (SELECT 'customer/' || c_custkey AS slug, c_name AS title FROM customer UNION ALL SELECT 'nation/' || n_nationkey, n_name FROM nation)
SELECT l.src, l.dst, l.link_type, a.title AS src_title, b.title AS dst_title FROM links_v l JOIN n a ON l.src = a.slug JOIN n b ON l.dst = b.slug""")
def links_enriched(spark, d):
    of = lambda p, k, n, t: V.table(spark, d, t).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("slug"), F.col(n).alias("title"))
    nodes = of("customer/", "c_custkey", "c_name", "customer").unionByName(of("nation/", "n_nationkey", "n_name", "nation"))
    return G.endpoints(V.links(spark, d), nodes)


@_query(f"WITH {_LINKS} SELECT src, count(*) AS links, string_agg(dst, ',' ORDER BY dst) AS targets FROM links_v WHERE link_type = 'part_of' GROUP BY src")
def links_grouped(spark, d):
    x = V.links(spark, d).filter("link_type = 'part_of'").groupBy("src")
    return x.agg(F.count(F.lit(1)).alias("links"), F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("targets"))


@_query(f"WITH {_LINKS} SELECT dst AS slug, count(*) AS backlinks FROM links_v GROUP BY dst")
def page_list_backlinks(spark, d):
    return G.backlinks(V.links(spark, d))


_BFS = f"""WITH RECURSIVE {_LINKS}, s AS (SELECT src AS x, dst AS y FROM links_v WHERE link_type = 'part_of' UNION SELECT dst, src FROM links_v WHERE link_type = 'part_of'),
b AS (SELECT 'nation/3' AS slug, 0 AS depth UNION SELECT s.y, b.depth + 1 FROM b JOIN s ON b.slug = s.x WHERE b.depth < 3)
SELECT slug, min(depth)::INTEGER AS depth FROM b GROUP BY slug"""


@_query(_BFS)
def bfs_nodes(spark, d):
    return G.traverse(V.links(spark, d).filter("link_type = 'part_of'"), "nation/3", 3, "both")


@_query(f"""WITH RECURSIVE {_LINKS}, b AS (SELECT 'region/1' AS slug, 0 AS depth UNION SELECT l.src, b.depth + 1 FROM b JOIN links_v l ON b.slug = l.dst WHERE b.depth < 5 AND l.link_type = 'part_of')
SELECT slug, min(depth)::INTEGER AS depth FROM b WHERE depth > 0 GROUP BY slug""")
def subtree(spark, d):
    return G.subtree(V.links(spark, d), "region/1", "part_of")


@_query(f"""WITH {_LINKS}, e AS (SELECT src, dst FROM links_v WHERE link_type = 'part_of'),
c AS (SELECT n, count(*) AS degree FROM (SELECT src AS n FROM e UNION ALL SELECT dst FROM e) GROUP BY n HAVING count(*) >= 5)
SELECT src, dst FROM e WHERE src IN (SELECT n FROM c) AND dst IN (SELECT n FROM c)""")
def graph_view(spark, d):
    e = V.links(spark, d).filter("link_type = 'part_of'").select("src", "dst")
    ends = e.select(F.col("src").alias("n")).unionByName(e.select(F.col("dst").alias("n")))
    big = ends.groupBy("n").count().filter("count >= 5").select("n")
    return e.join(big, e.src == big.n, "left_semi").join(big, e.dst == big.n, "left_semi")


@_query(f"WITH {_TIMELINE} SELECT slug, date, summary, source, entry_id FROM timeline_v WHERE date >= '1996-01-01' AND date < '1996-07-01' AND summary ILIKE '%urgent%'")
def timeline_feed(spark, d):
    t = V.timeline(spark, d)
    return t.filter((F.col("date") >= "1996-01-01") & (F.col("date") < "1996-07-01") & F.lower("summary").contains("urgent"))


@_query(f"WITH {_TIMELINE} SELECT slug, count(*) AS entries, min(date) AS first_date, max(date) AS last_date FROM timeline_v GROUP BY slug")
def timeline_grouped(spark, d):
    return V.timeline(spark, d).groupBy("slug").agg(F.count(F.lit(1)).alias("entries"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@_query(f"WITH {_TIMELINE} SELECT DISTINCT date FROM timeline_v")
def active_days(spark, d):
    return V.timeline(spark, d).select("date").distinct()


_DAYS = f"WITH {_TIMELINE}, days AS (SELECT DISTINCT date FROM timeline_v WHERE date <= '1997-06-30' ORDER BY date DESC LIMIT 8)"


@_query(f"{_DAYS} SELECT date, source, count(*) AS signals FROM timeline_v WHERE date IN (SELECT date FROM days ORDER BY date DESC LIMIT 7) GROUP BY date, source")
def feed_by_day(spark, d):
    t = V.timeline(spark, d).filter(F.col("date") <= "1997-06-30")
    days = t.select("date").distinct().orderBy(F.desc("date")).limit(7)
    return t.join(F.broadcast(days), "date").groupBy("date", "source").agg(F.count(F.lit(1)).alias("signals"))


@_query(f"{_DAYS} SELECT min(date) AS next_cursor, count(*) AS days FROM days")
def feed_page(spark, d):
    days = V.timeline(spark, d).filter(F.col("date") <= "1997-06-30").select("date").distinct().orderBy(F.desc("date")).limit(8)
    return days.agg(F.min("date").alias("next_cursor"), F.count(F.lit(1)).alias("days"))


@_query(f"WITH {_PAGES} SELECT type, count(*) AS pages, count(platform) AS with_platform FROM pages_v GROUP BY type")
def stats(spark, d):
    return V.pages(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("pages"), F.count("platform").alias("with_platform"))


@_query(f"WITH {_PAGES} SELECT platform, count(*) AS pages, max(created_s) AS newest_s FROM pages_v GROUP BY platform")
def source_health(spark, d):
    return V.pages(spark, d).groupBy("platform").agg(F.count(F.lit(1)).alias("pages"), F.max("created_s").alias("newest_s"))


@_query(f"WITH {_PAGES} SELECT DISTINCT channel, platform FROM pages_v WHERE channel IS NOT NULL")
def distinct_channels(spark, d):
    return V.pages(spark, d).filter(F.col("channel").isNotNull()).select("channel", "platform").distinct()


# messages


@_query(f"""WITH {_GROUP}, g AS (SELECT *, CASE WHEN at_s - lag(at_s) OVER (PARTITION BY contact ORDER BY at_s, event_id) > 1800 THEN 1 ELSE 0 END AS new FROM group_v),
s AS (SELECT *, sum(new) OVER (PARTITION BY contact ORDER BY at_s, event_id) AS session FROM g)
SELECT contact, session::BIGINT AS session, min(at_s) AS start_s, max(at_s) AS end_s, count(*) AS messages FROM s GROUP BY contact, session""")
def sessionize_gap(spark, d):
    return A.sessions(V.group_messages(spark, d), ["contact"], "event_id")


@_query(f"""WITH {_DM}, x AS (SELECT *, lead(at_s) OVER w AS next_at, lead(direction) OVER w AS next_way FROM dm_v WINDOW w AS (PARTITION BY channel ORDER BY at_s, turn)),
g AS (SELECT *, CASE WHEN next_way = 'sent' AND next_at >= at_s THEN next_at - at_s END AS wait FROM x WHERE direction <> 'sent')
SELECT channel, count(*) AS messages, sum(length(content))::BIGINT AS chars, sum(CASE WHEN contains(content, '?') THEN 1 ELSE 0 END)::BIGINT AS questions,
sum(wait)::BIGINT AS latency_s, count(wait) AS latency_n FROM g GROUP BY channel""")
def behavior_dm(spark, d):
    return A.behavior(V.direct_messages(spark, d)).select("channel", "messages", "chars", "questions", "latency_s", "latency_n")


@_query(f"""WITH {_DM}, x AS (SELECT *, lead(at_s) OVER w AS next_at, lead(direction) OVER w AS next_way FROM dm_v WINDOW w AS (PARTITION BY channel ORDER BY at_s, turn)),
g AS (SELECT *, CASE WHEN next_way = 'sent' AND next_at >= at_s THEN next_at - at_s END AS wait, (at_s // 3600 + 8) % 24 AS h FROM x WHERE direction <> 'sent'),
t AS (SELECT channel, h, count(*) AS n, row_number() OVER (PARTITION BY channel ORDER BY count(*) DESC, h) AS r FROM g GROUP BY channel, h),
p AS (SELECT channel, string_agg(h::VARCHAR, ',' ORDER BY r) AS peak_hours FROM t WHERE r <= 3 GROUP BY channel)
SELECT channel, round(sum(length(content)) / count(*), 6)::DOUBLE AS mean_chars, round(sum(CASE WHEN contains(content, '?') THEN 1 ELSE 0 END) / count(*), 6)::DOUBLE AS question_ratio,
CASE WHEN count(wait) > 0 THEN round(sum(wait) / count(wait), 6)::DOUBLE END AS mean_latency_s, any_value(peak_hours) AS peak_hours FROM g JOIN p USING (channel) GROUP BY channel""")
def behavior_profile(spark, d):
    return A.profile(A.behavior(V.direct_messages(spark, d)))


@_query(f"WITH {_DM} SELECT channel, count(*) AS messages FROM dm_v WHERE direction <> 'sent' GROUP BY channel")
def behavior_merge(spark, d):
    dm = V.direct_messages(spark, d)
    half = lambda k: A.behavior(dm.filter(F.col("turn") % 2 == k))
    return A.merge_counters(half(0).unionByName(half(1))).select("channel", "messages")


@_query(f"""WITH {_GROUP}, r AS (SELECT *, row_number() OVER (PARTITION BY contact, channel ORDER BY at_s DESC, event_id DESC) AS rn FROM group_v)
SELECT contact, channel, event_id, at_s FROM r WHERE rn = 1""")
def latest_revision(spark, d):
    x = L.latest(V.group_messages(spark, d), ["contact", "channel"], F.desc("at_s"), F.desc("event_id"))
    return x.select("contact", "channel", "event_id", "at_s")


@_query(f"""WITH {_GROUP}, k AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value + 1 ELSE value END AS was FROM group_v WHERE event_id % 2 = 0)
SELECT status, count(*) AS n FROM (SELECT CASE WHEN was IS NULL THEN 'new' WHEN was = value THEN 'unchanged' ELSE 'modified' END AS status FROM group_v LEFT JOIN k USING (event_id)) GROUP BY status""")
def dedup_status(spark, d):
    x = V.group_messages(spark, d).filter("value IS NOT NULL")
    known = x.filter("event_id % 2 = 0").withColumn("value", F.when(F.col("event_id") % 3 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return L.status(x, known, "event_id", "value").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# text


@_query(f"WITH {_PAGES} SELECT slug, round(1.5 * len(regexp_extract_all(body, '[一-鿿㐀-䶿぀-ヿ가-힯]')) + 1.3 * len(regexp_extract_all(regexp_replace(body, '[一-鿿㐀-䶿぀-ヿ가-힯]', ' ', 'g'), '[^\\s]+')), 1)::DOUBLE AS tokens FROM pages_v")
def token_estimate(spark, d):
    return V.pages(spark, d).select("slug", F.round(T.token_estimate(F.col("body")), 1).cast("double").alias("tokens"))


@_query(f"""WITH {_PAGES}, w AS (SELECT slug, list_filter(regexp_split_to_array(lower(body), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM pages_v)
SELECT slug, round(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w)::DOUBLE ELSE 0 END, 6)::DOUBLE AS ratio FROM w""")
def ttr_score(spark, d):
    return V.pages(spark, d).select("slug", F.round(T.type_token_ratio(F.col("body")), 6).alias("ratio"))


@_query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '1[3-9]\d{9}', '[PHONE]', 'g'), '\d{17}[\dXx]', '[ID]', 'g'), '\d{16,19}', '[CARD]', 'g'), '\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}', '[IP]', 'g') AS text FROM documents""")
def redact(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.redact(F.col("text")).alias("text"))


@_query(f"""WITH {_PAGES}, k AS (SELECT slug, title, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS k FROM pages_v)
SELECT slug, CASE WHEN length(k) >= 3 THEN k WHEN k = '' THEN left(sha256(title), 12) ELSE k || '-' || left(sha256(title), 12) END AS topic FROM k""")
def slugify(spark, d):
    return V.pages(spark, d).select("slug", T.slugify(F.col("title")).alias("topic"))


@_query(f"WITH {_PAGES} SELECT slug, round(1 + 0.3 * exp(-greatest(({AS_OF_S} - created_s) / 86400.0, 0.0) / 90)::DOUBLE, 6)::DOUBLE AS freshness FROM pages_v")
def freshness(spark, d):
    return V.pages(spark, d).select("slug", F.round(T.freshness((F.lit(AS_OF_S) - F.col("created_s")) / 86400.0), 6).alias("freshness"))


@_query("SELECT doc_id, left(sha256(source || ':' || text), 16) AS block_hash FROM documents")
def block_hash(spark, d):
    h = F.sha2(F.concat("source", F.lit(":"), "text"), 256)
    return V.table(spark, d, "documents").select("doc_id", F.substring(h, 1, 16).alias("block_hash"))


_TITLES = """titles_v AS (SELECT type, title, lower(title) AS t, count(*) AS n, min(slug) AS head FROM named GROUP BY type, title),
near AS (SELECT a.type, a.title AS title_a, b.title AS title_b, a.head AS head_a, b.head AS head_b FROM titles_v a JOIN titles_v b ON a.type = b.type AND a.title < b.title
 AND length(a.t) >= 4 AND length(b.t) >= 4 AND abs(length(a.t) - length(b.t)) <= 2 AND levenshtein(a.t, b.t) <= CASE WHEN least(length(a.t), length(b.t)) >= 8 THEN 2 ELSE 1 END)"""


@_query(f"WITH {_PAGES}, named AS (SELECT * FROM pages_v), {_TITLES} SELECT * FROM near")
def near_dup_titles(spark, d):
    return L.near_titles(V.pages(spark, d))


# ledger


@_query(f"""WITH {_CONTRIB}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY revision DESC, contribution_id DESC) AS rn FROM contrib_v WHERE active)
SELECT family, contribution_id, revision FROM r WHERE rn = 1""")
def active_contribs(spark, d):
    return L.active_contributions(V.contributions(spark, d)).select("family", "contribution_id", "revision")


@_query(f"""WITH {_CONTRIB} SELECT page, count(*) AS parts, string_agg('- **[' || signal_type || ']** ' || what || CASE WHEN authority <> 'user_confirmed' THEN ' _(' || authority || ')_' ELSE '' END, chr(10) ORDER BY created_s, contribution_id) AS body
FROM contrib_v WHERE active GROUP BY page""")
def rematerialize(spark, d):
    return L.rematerialize(V.contributions(spark, d).filter("active"))


@_query(f"""WITH {_CONTRIB}, r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY authority <> 'user_confirmed', created_s, contribution_id) AS rn FROM contrib_v)
SELECT page, contribution_id AS primary_id FROM r WHERE rn = 1""")
def primary_source(spark, d):
    return L.primary(V.contributions(spark, d))


@_query(f"WITH {_CONTRIB} SELECT page, string_agg(what, '; ' ORDER BY contribution_id) AS summary FROM contrib_v WHERE active GROUP BY page")
def contrib_summary(spark, d):
    x = V.contributions(spark, d).filter("active").groupBy("page")
    return x.agg(F.array_join(F.array_sort(F.collect_list(F.struct("contribution_id", "what")))["what"], "; ").alias("summary"))


@_query(f"""WITH {_PAGES}, {_CONTRIB} SELECT slug FROM pages_v p WHERE EXISTS (SELECT 1 FROM contrib_v c WHERE c.page = p.slug AND c.active AND c.authority = 'user_confirmed')
OR (NOT EXISTS (SELECT 1 FROM contrib_v c WHERE c.page = p.slug AND c.active) AND p.platform = 'en')""")
def filter_multisource(spark, d):
    sure = F.max(F.col("authority") == "user_confirmed").alias("sure")
    by = V.contributions(spark, d).filter("active").groupBy(F.col("page").alias("slug")).agg(sure)
    x = V.pages(spark, d).select("slug", "platform").join(by, "slug", "left")
    return x.filter(F.col("sure") | (F.col("sure").isNull() & (F.col("platform") == "en"))).select("slug")


@_query(f"""WITH {_PAGES}, s AS (SELECT slug, channel, length(body) AS cost, created_s, sum(length(body)) OVER w AS spent, row_number() OVER w AS place FROM pages_v
 WINDOW w AS (PARTITION BY channel ORDER BY created_s DESC, slug ROWS UNBOUNDED PRECEDING))
SELECT channel, slug, spent::BIGINT AS spent, place::INTEGER AS place FROM s WHERE spent <= 12000 OR place = 1""")
def context_budget(spark, d):
    x = L.running_budget(V.pages(spark, d).withColumn("cost", F.length("body")).select("slug", "channel", "cost", "created_s"), ["channel"], [F.desc("created_s"), F.asc("slug")], F.col("cost"), 12000)
    return x.select("channel", "slug", "spent", "place")


@_query(f"""WITH {_PAGES}, h AS (SELECT slug, sha256(body) AS h, row_number() OVER (PARTITION BY sha256(body) ORDER BY created_s, slug) AS rn FROM pages_v) SELECT slug, h AS hash FROM h WHERE rn = 1""")
def dedupe_hash(spark, d):
    p = V.pages(spark, d).select("slug", "created_s", F.sha2("body", 256).alias("hash"))
    return L.latest(p, ["hash"], F.asc("created_s"), F.asc("slug")).select("slug", "hash")


@_query(f"""WITH {_PAGES}, n AS (SELECT slug, 'task' AS type FROM pages_v WHERE doc_id % 10 = 0 UNION ALL SELECT 'new/' || doc_id, 'task' FROM pages_v WHERE doc_id % 10 = 1)
SELECT slug, type FROM pages_v WHERE slug NOT IN (SELECT slug FROM n) UNION ALL SELECT slug, type FROM n""")
def page_upsert(spark, d):
    p = V.pages(spark, d)
    task = F.lit("task").alias("type")
    new = p.filter("doc_id % 10 = 0").select("slug", task).unionByName(
        p.filter("doc_id % 10 = 1").select(F.concat(F.lit("new/"), F.col("doc_id").cast("string")).alias("slug"), task))
    return L.upsert(p.select("slug", "type"), new, ["slug"])


@_query(f"WITH {_LINKS} SELECT src, dst, link_type FROM links_v WHERE src NOT IN (SELECT 'customer/' || c_custkey FROM customer WHERE c_nationkey = 3) AND dst NOT IN (SELECT 'customer/' || c_custkey FROM customer WHERE c_nationkey = 3)")
def cascade_delete(spark, d):
    gone = V.table(spark, d, "customer").filter("c_nationkey = 3").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("k"))
    e = V.links(spark, d)
    return e.join(gone, e.src == gone.k, "left_anti").join(gone, e.dst == gone.k, "left_anti")


@_query(f"""WITH {_LINKS}, r AS (SELECT CASE src WHEN 'nation/3' THEN 'nation/4' ELSE src END AS src, CASE dst WHEN 'nation/3' THEN 'nation/4' ELSE dst END AS dst, link_type FROM links_v)
SELECT DISTINCT src, dst, link_type FROM r WHERE src <> dst""")
def merge_repoint(spark, d):
    to = lambda c: F.when(F.col(c) == "nation/3", "nation/4").otherwise(F.col(c)).alias(c)
    return V.links(spark, d).select(to("src"), to("dst"), "link_type").filter("src <> dst").distinct()


_HOT = f"""hot AS (SELECT *, doc_id % 11 = 0 AS edited, CASE WHEN doc_id % 13 <> 0 THEN 'person/u' || least((doc_id % 11)::VARCHAR, (doc_id % 13)::VARCHAR) END AS entity FROM pages_v
 WHERE tier = 'hot' AND created_s + 86400 * CASE type WHEN 'decision' THEN 365 WHEN 'task' THEN 30 WHEN 'knowledge' THEN 180 WHEN 'preference' THEN 90 ELSE 365 END <= {AS_OF_S + 86400 * 100})"""


@_query(f"""WITH {_PAGES}, {_HOT} SELECT entity, type, part, count(*) AS members, sha256(string_agg('### ' || title || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY created_s, slug)) AS content, min(created_s) AS created_s
FROM (SELECT *, coalesce(entity, '__none__') AS entity_, (row_number() OVER (PARTITION BY coalesce(entity, '__none__'), type ORDER BY created_s, slug) - 1) // 5 AS part FROM hot WHERE type IN ('task', 'preference', 'knowledge') AND NOT edited) h(doc_id, slug, type, title, body, created_s, tier, platform, channel, edited, entity0, entity, part) GROUP BY entity, type, part""")
def hot_warm_groups(spark, d):
    p, m = _hot(spark, d)
    return L.hot_to_warm(p, m, AS_OF_S + 86400 * 100, 5).withColumn("content", F.sha2("content", 256))


@_query(f"""WITH {_PAGES}, {_HOT} SELECT slug, coalesce(entity, '__none__') AS entity, type, (row_number() OVER (PARTITION BY coalesce(entity, '__none__'), type ORDER BY created_s, slug) - 1) // 5 AS part
FROM hot WHERE type IN ('task', 'preference', 'knowledge') AND NOT edited""")
def warm_members(spark, d):
    p, m = _hot(spark, d)
    return L.warm_members(p, m, AS_OF_S + 86400 * 100, 5)


def _hot(spark, d):
    p = V.sourced_pages(spark, d).withColumn("edited", F.col("doc_id") % 11 == 0)
    m = p.filter("doc_id % 13 <> 0").select("slug", F.explode("source.participants.id").alias("id")).select("slug", F.concat(F.lit("person/"), "id").alias("to"))
    return p, m


@_query(f"WITH {_PAGES}, {_HOT} SELECT slug, type FROM hot WHERE type NOT IN ('task', 'preference', 'knowledge') OR edited")
def hot_only_tier(spark, d):
    return L.only_tier(_hot(spark, d)[0], AS_OF_S + 86400 * 100).select("slug", "type")


@_query("""WITH g AS (SELECT doc_id % 10 AS session, doc_id AS item, 1 AS wanted FROM labels WHERE quality = 1), o AS (SELECT doc_id % 10 AS session, doc_id AS item, 1 AS found FROM labels WHERE toxic = 0)
SELECT round(sum(CASE WHEN wanted IS NOT NULL AND found IS NULL THEN 1 ELSE 0 END) / count(wanted), 6)::DOUBLE AS miss_rate,
round(sum(CASE WHEN wanted IS NULL AND found IS NOT NULL THEN 1 ELSE 0 END) / count(found), 6)::DOUBLE AS noise_rate FROM g FULL JOIN o USING (session, item)""")
def eval_metrics(spark, d):
    x = V.table(spark, d, "labels").select((F.col("doc_id") % 10).alias("session"), F.col("doc_id").alias("item"), "quality", "toxic")
    golden = x.filter("quality = 1").select("session", "item", F.lit(1).alias("wanted"))
    return L.quality_metrics(golden, x.filter("toxic = 0").select("session", "item"))


@_query("""WITH r AS (SELECT source, count(*) FILTER (quality = 1 AND toxic = 0)::DOUBLE AS m, count(*) FILTER (quality = 1 AND toxic <> 0)::DOUBLE AS x, count(*) FILTER (quality <> 1 AND toxic = 0)::DOUBLE AS e FROM labels JOIN documents USING (doc_id) GROUP BY source),
s AS (SELECT CASE WHEN m + x > 0 THEN x / (m + x) ELSE 0 END AS miss, CASE WHEN m + e > 0 THEN e / (m + e) ELSE 0 END AS noise FROM r)
SELECT round(avg(miss), 6)::DOUBLE AS miss_mean, round(var_pop(miss), 6)::DOUBLE AS miss_variance, round(avg(noise), 6)::DOUBLE AS noise_mean, round(var_pop(noise), 6)::DOUBLE AS noise_variance FROM s""")
def eval_stats(spark, d):
    x = V.table(spark, d, "labels").join(V.table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    n = lambda test, name: F.sum(F.when(test, 1.0).otherwise(0.0)).alias(name)
    good, kept = F.col("quality") == 1, F.col("toxic") == 0
    return L.metric_stats(x.groupBy("source").agg(n(good & kept, "matched"), n(good & ~kept, "missed"), n(~good & kept, "extra")))


@_query(f"WITH {_PAGES} SELECT round(sum(n - 1) / sum(n), 6)::DOUBLE AS dup_rate FROM (SELECT count(*) AS n FROM pages_v GROUP BY type, title)")
def eval_dup_rate(spark, d):
    return L.duplicate_rate(L.titles(V.pages(spark, d)))


# rules and ledgers


@_query(f"""WITH {_PAGES}, k AS (SELECT type, substr(title, 1, 1) AS topic, count(*) AS n FROM pages_v GROUP BY 1, 2) SELECT type, topic, n FROM k WHERE n > 1""")
def payload_dups(spark, d):
    from engramlake.operators import rules

    return rules.repeated(V.pages(spark, d).withColumn("topic", F.substring("title", 1, 1)), ["type", "topic"])


@_query("""WITH f AS (SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS failures FROM events GROUP BY user_id)
SELECT user_id, failures::BIGINT AS failures, least(300 * power(2, failures), 21600)::BIGINT AS wait_s, CASE WHEN failures >= 3 THEN true ELSE false END AS alert FROM f""")
def backoff(spark, d):
    from engramlake.operators import rules

    f = V.table(spark, d, "events").groupBy("user_id").agg(F.sum((F.col("event_type") == "error").cast("long")).alias("failures"))
    return f.select("user_id", "failures", rules.backoff(F.col("failures")).alias("wait_s"), (F.col("failures") >= 3).alias("alert"))


@_query(f"""WITH {_GROUP}, r AS (SELECT channel, at_s // 86400 AS day, sum(value) AS v, count(*) AS runs FROM group_v GROUP BY 1, 2)
SELECT channel, day, runs, sum(runs) OVER (PARTITION BY channel ORDER BY day ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)::BIGINT AS two_days FROM r""")
def run_stats(spark, d):
    day = F.floor(F.col("at_s") / 86400).alias("day")
    r = V.group_messages(spark, d).groupBy("channel", day).agg(F.count(F.lit(1)).alias("runs"))
    return r.withColumn("two_days", F.sum("runs").over(W.partitionBy("channel").orderBy("day").rowsBetween(-1, 0)))


@_query("""WITH o AS (SELECT c_custkey AS k, c_acctbal AS was FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS now FROM customer WHERE c_custkey % 4 <> 0)
SELECT k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN was = now THEN 'same' ELSE 'changed' END AS change FROM o FULL JOIN n USING (k)""")
def schedule_diff(spark, d):
    from engramlake.operators import rules

    c = V.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = c.filter("k % 4 <> 0").withColumn("v", F.when(F.col("k") % 5 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return rules.changes(c.filter("k % 3 <> 0"), new, "k", "v")


@_query(f"""WITH {_PAGES}, {_CONTRIB} SELECT p.slug, p.title, count(c.contribution_id) AS signals, count(DISTINCT c.signal_type) AS kinds, max(c.created_s) AS newest_s
FROM pages_v p LEFT JOIN contrib_v c ON c.page = p.slug AND c.active GROUP BY p.slug, p.title""")
def entity_profile(spark, d):
    c = V.contributions(spark, d).filter("active").groupBy(F.col("page").alias("slug"))
    c = c.agg(F.count(F.lit(1)).alias("signals"), F.count_distinct("signal_type").alias("kinds"), F.max("created_s").alias("newest_s"))
    x = V.pages(spark, d).select("slug", "title").join(c, "slug", "left")
    return x.fillna(0, ["signals", "kinds"])


@_query(r"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*/([a-z][a-z])/', 1) AS section FROM pages)
SELECT page_id, host, section, CASE WHEN section = '' THEN 'reject' WHEN host LIKE '%.example.net' THEN 'wiki_node' ELSE 'docx' END AS kind FROM u""")
def parse_url(spark, d):
    from engramlake.operators import rules

    return rules.url_kind(V.table(spark, d, "pages"))


@_query(f"""WITH {_PAGES}, {_CONTRIB} SELECT slug, CASE WHEN created_s < {AS_OF_S} - 86400 * 20 THEN true ELSE false END AS stale, c.page IS NULL AS unsourced
FROM pages_v p LEFT JOIN (SELECT DISTINCT page FROM contrib_v WHERE active) c ON c.page = p.slug""")
def gaps(spark, d):
    c = V.contributions(spark, d).filter("active").select(F.col("page").alias("slug"), F.lit(True).alias("has")).distinct()
    stale = (F.col("created_s") < AS_OF_S - 86400 * 20).alias("stale")
    return V.pages(spark, d).join(c, "slug", "left").select("slug", stale, F.col("has").isNull().alias("unsourced"))


@_query(rf"""WITH {_PAGES}, named AS (SELECT slug, CASE type WHEN 'preference' THEN 'person' ELSE type END AS type, CASE WHEN doc_id % 20 = 3 THEN 'Ann  Li (x)' WHEN doc_id % 10 = 3 THEN 'Ann Li' ELSE title END AS title FROM pages_v WHERE doc_id % 10 = 3 OR title <> ''), {_TITLES},
b AS (SELECT slug, trim(regexp_replace(title, '[（(][^）)]*[）)]', '', 'g'), E' \t\n\r\f\v') AS bare FROM named WHERE type = 'person'),
k AS (SELECT slug, regexp_replace(replace(lower(bare), chr(39), '-'), '\s+', '-', 'g') AS name FROM b WHERE regexp_matches(bare, '^[a-zA-Z\s\-\x27]+$')),
f AS (SELECT name, min(slug) AS head FROM k GROUP BY name HAVING count(*) > 1),
e AS (SELECT n.type, n.slug AS x, t.head AS y, 0 AS r FROM named n JOIN titles_v t USING (type, title) WHERE n.slug <> t.head UNION ALL SELECT type, head_a, head_b, 1 FROM near
 UNION ALL SELECT 'person', k.slug, f.head, 2 FROM k JOIN f USING (name) WHERE k.slug <> f.head)
SELECT type, greatest(x, y) AS "from", least(x, y) AS "into", ['same_name', 'levenshtein', 'pinyin'][min(r) + 1] AS reason FROM e GROUP BY type, greatest(x, y), least(x, y)""")
def merge_suggestions(spark, d):
    i = F.col("doc_id")
    ann = F.when(i % 20 == 3, "Ann  Li (x)").otherwise("Ann Li")
    p = V.pages(spark, d).withColumn("title", F.when(i % 10 == 3, ann).otherwise(F.col("title")))
    return L.merge_suggestions(p.withColumn("type", F.when(F.col("type") == "preference", "person").otherwise(F.col("type"))))


@_query("""WITH k AS (SELECT DISTINCT user_id::VARCHAR AS key FROM events), h AS (SELECT c_custkey::VARCHAR AS key, 'customer/' || c_custkey AS slug FROM customer WHERE c_custkey % 2 = 0),
c AS (SELECT s_suppkey::VARCHAR AS key, 'supplier/' || s_suppkey AS slug FROM supplier WHERE s_suppkey % 3 = 0)
SELECT k.key, coalesce(h.slug, c.slug, 'person/' || k.key) AS slug, CASE WHEN h.slug IS NOT NULL THEN 'handle' WHEN c.slug IS NOT NULL THEN 'cache' ELSE 'new' END AS step
FROM k LEFT JOIN h USING (key) LEFT JOIN c USING (key)""")
def resolve_person(spark, d):
    def dim(name, key, prefix, n):
        x = V.table(spark, d, name).filter(F.col(key) % n == 0)
        return x.select(F.col(key).cast("string").alias("key"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("slug"))

    names = V.table(spark, d, "events").select(F.col("user_id").cast("string").alias("key")).distinct()
    return L.resolve(names, dim("customer", "c_custkey", "customer/", 2), dim("supplier", "s_suppkey", "supplier/", 3))


@_query(f"""WITH {_PAGES}, t AS (SELECT slug, unnest([channel, platform, tier]) AS tag FROM pages_v)
SELECT slug, count(*) AS n, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT DISTINCT slug, tag FROM t WHERE tag IS NOT NULL) GROUP BY slug""")
def tags_grouped(spark, d):
    tags = F.array_sort(F.array_distinct(F.array_compact(F.array("channel", "platform", "tier"))))
    x = V.pages(spark, d).select("slug", tags.alias("t"))
    return x.select("slug", F.size("t").cast("long").alias("n"), F.array_join("t", ",").alias("tags"))


@_query(f"""WITH {_PAGES}, k AS (SELECT doc_id, sha256(body) AS h FROM pages_v WHERE doc_id % 3 <> 0)
SELECT p.slug, CASE WHEN k.h IS NULL THEN 'new' WHEN k.h = sha256(p.body) THEN 'unchanged' ELSE 'revised' END AS status FROM pages_v p LEFT JOIN k USING (doc_id)""")
def ledger_status(spark, d):
    x = V.pages(spark, d).select("doc_id", "slug", F.sha2("body", 256).alias("hash"))
    y = L.status(x, x.filter("doc_id % 3 <> 0"), "doc_id", "hash")
    return y.select("slug", F.when(F.col("status") == "modified", "revised").otherwise(F.col("status")).alias("status"))


@_query(f"""WITH {_PAGES} SELECT CASE WHEN type IN ('decision', 'task') THEN 'Work' WHEN type = 'knowledge' THEN 'Knowledge' ELSE 'Other' END AS section, count(*) AS n FROM pages_v GROUP BY 1""")
def type_groups(spark, d):
    section = F.when(F.col("type").isin("decision", "task"), "Work").when(F.col("type") == "knowledge", "Knowledge").otherwise("Other")
    return V.pages(spark, d).groupBy(section.alias("section")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"""WITH {_PAGES}, {_CONTRIB}, q AS (SELECT contribution_id, family, revision, active FROM contrib_v)
SELECT family, max(revision) AS newest, sum(CASE WHEN active THEN 1 ELSE 0 END)::BIGINT AS active, count(*) AS revisions,
 max(CASE WHEN active THEN revision END) IS DISTINCT FROM max(revision) AS stale FROM q GROUP BY family""")
def rollback_guard(spark, d):
    x = V.contributions(spark, d).groupBy("family")
    live, newest = F.max(F.when(F.col("active"), F.col("revision"))), F.max("revision")
    return x.agg(newest.alias("newest"), F.sum(F.col("active").cast("long")).alias("active"), F.count(F.lit(1)).alias("revisions"), (~live.eqNullSafe(newest)).alias("stale"))
