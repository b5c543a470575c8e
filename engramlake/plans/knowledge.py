"""Queries over pages and identities: applying signals, merges, scopes, citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake import views as V
from engramlake.functions import messages as M
from engramlake.functions import text as T
from engramlake.operators import apply as P
from engramlake.operators import graph as G
from engramlake.operators import identity as I
from engramlake.operators import ledger as L
from engramlake.operators import retrieval as R
from engramlake.operators import synthesis as S
from engramlake.queries import _CHUNKS, _CONTRIB, _LINKS, _PAGES, _TIMELINE, _similarity
from engramlake.registry import query


def _s(column: str):
    return F.col(column).cast("string")


# identities


@query("""WITH s AS (SELECT user_id, event_type, CASE WHEN event_type IN ('error', 'signup') THEN 'trouble' ELSE event_type END AS slug, min(event_id) AS first FROM events GROUP BY user_id, event_type)
SELECT user_id, string_agg(slug, ',' ORDER BY first) AS slugs FROM (SELECT user_id, slug, min(first) AS first FROM s GROUP BY user_id, slug) GROUP BY user_id""")
def rewrite_slugs(spark, d):
    first = V.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"))
    lists = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_type")))["event_type"].alias("slugs"))
    moves = spark.createDataFrame([("error", "trouble"), ("signup", "trouble")], "was string, now string")
    return I.rewritten(lists, "user_id", "slugs", moves).select("user_id", F.array_join("slugs", ",").alias("slugs"))


@query(f"""WITH {_LINKS} SELECT CASE WHEN src LIKE 'nation/%' THEN 'country/' || split_part(src, '/', 2) ELSE src END AS src, dst, link_type FROM links_v""")
def rename(spark, d):
    moves = V.table(spark, d, "nation").select(F.concat(F.lit("nation/"), _s("n_nationkey")).alias("was"), F.concat(F.lit("country/"), _s("n_nationkey")).alias("now"))
    return I.rename(V.links(spark, d), "src", moves).select("src", "dst", "link_type")


@query("""WITH x AS (SELECT 'person/' || (c_custkey % 20) AS slug, c_name AS a FROM customer UNION SELECT 'person/' || (c_custkey % 20), 'old/' || (c_custkey % 40) FROM customer)
SELECT slug, string_agg(a, ',' ORDER BY a) AS aliases FROM x GROUP BY slug""")
def alias_union(spark, d):
    c = V.table(spark, d, "customer")
    slug = F.concat(F.lit("person/"), (F.col("c_custkey") % 20).cast("string"))
    kept = c.filter("c_custkey % 2 = 0").groupBy(slug.alias("slug")).agg(F.collect_set("c_name").alias("aliases"))
    gone = c.groupBy(slug.alias("into"), F.concat(F.lit("old/"), (F.col("c_custkey") % 40).cast("string")).alias("slug")).agg(F.collect_set("c_name").alias("aliases"))
    return I.aliases(kept, gone).select("slug", F.array_join("aliases", ",").alias("aliases"))


_NAMED = """p AS (SELECT 'c/' || c_custkey AS slug, CASE WHEN c_custkey % 3 = 0 THEN 'tool' ELSE 'project' END AS type, 'name ' || CASE WHEN c_custkey % 20 < 10 THEN c_custkey % 60 ELSE c_custkey END AS title FROM customer)"""


@query(f"""WITH {_NAMED}, n AS (SELECT DISTINCT 'Name ' || (s_suppkey % 120) AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'tool' ELSE 'project' END AS type FROM supplier),
g AS (SELECT title, count(*) AS k, min(type) AS t, min(slug) AS slug FROM p GROUP BY title)
SELECT name, n.type, CASE WHEN k IS NULL THEN 'new' WHEN k = 1 AND t = n.type THEN 'bind' ELSE 'suggest' END AS step, CASE WHEN k = 1 AND t = n.type THEN slug END AS slug FROM n LEFT JOIN g ON g.title = lower(n.name)""")
def resolve_entity(spark, d):
    k = F.col("c_custkey")
    pages = V.table(spark, d, "customer").select(
        F.concat(F.lit("c/"), k.cast("string")).alias("slug"), F.when(k % 3 == 0, "tool").otherwise("project").alias("type"), F.concat(F.lit("name "), F.when(k % 20 < 10, k % 60).otherwise(k).cast("string")).alias("title"))
    s = F.col("s_suppkey")
    names = V.table(spark, d, "supplier").select(F.concat(F.lit("Name "), (s % 120).cast("string")).alias("name"), F.when(s % 2 == 0, "tool").otherwise("project").alias("type")).distinct()
    return I.bindings(names, pages)


@query("""SELECT DISTINCT e.user_id::VARCHAR AS key, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS name,
CASE WHEN c_custkey IS NULL THEN 'unresolved' WHEN c_custkey % 7 = 0 THEN 'failed' WHEN c_custkey % 5 = 0 THEN 'stale' ELSE 'resolved' END AS status
FROM events e LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON c_custkey = user_id""")
def channel_names(spark, d):
    k = F.col("c_custkey")
    cache = V.table(spark, d, "customer").filter("c_custkey % 3 <> 0").select(
        k.cast("string").alias("key"), F.when(k % 7 != 0, F.col("c_name")).alias("name"), F.when(k % 5 == 0, 0).otherwise(1000000).alias("at_s"))
    return I.requested(V.table(spark, d, "events").select(_s("user_id").alias("key")), cache, 1000100, 7 * 86400)


@query("""WITH n AS (SELECT 'name' AS kind, c_name AS value, 'p/' || c_custkey AS slug, c_custkey AS k FROM customer), h AS (SELECT kind, value, CASE WHEN k % 4 = 0 THEN slug ELSE 'p/other' END AS owner FROM n WHERE k % 4 < 2)
SELECT kind, value, slug, CASE WHEN owner IS NULL THEN 'add' WHEN owner = slug THEN 'keep' ELSE 'conflict' END AS step FROM n LEFT JOIN h USING (kind, value)""")
def handles_add(spark, d):
    k = F.col("c_custkey")
    slug = F.concat(F.lit("p/"), k.cast("string"))
    new = V.table(spark, d, "customer").select(F.lit("name").alias("kind"), F.col("c_name").alias("value"), slug.alias("slug"), "c_custkey")
    have = new.filter(k % 4 < 2).withColumn("slug", F.when(k % 4 == 0, F.col("slug")).otherwise("p/other"))
    return I.taken(new.drop("c_custkey"), have)


@query("""SELECT event_id, user_id IN (3, 5) AS is_me FROM events""")
def is_me(spark, d):
    mine = spark.createDataFrame([("user-3", True), ("user-5", True)], "contact string, me boolean")
    x = V.group_messages(spark, d).join(F.broadcast(mine), "contact", "left")
    return x.select("event_id", F.coalesce("me", F.lit(False)).alias("is_me"))


@query("""WITH n AS (SELECT c_custkey AS id, 'customer/' || c_custkey AS own, CASE WHEN c_custkey % 2 = 0 THEN 'nation/' || (c_custkey % 30) ELSE n_name END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT 'nation/' || n_nationkey AS slug, n_name AS title FROM nation)
SELECT DISTINCT id, slug FROM n JOIN p ON name = slug OR lower(name) = lower(title)""")
def entity_link(spark, d):
    nation = V.table(spark, d, "nation")
    c = V.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("nation/"), (F.col("c_custkey") % 30).cast("string"))).otherwise(F.col("n_name"))
    names = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("customer/"), _s("c_custkey")).alias("own"), name.alias("name"))
    return I.named_in(names, nation.select(F.concat(F.lit("nation/"), _s("n_nationkey")).alias("slug"), F.col("n_name").alias("title")))


# applying signals


@query(f"""WITH {_PAGES}, {_CONTRIB}, s AS (SELECT contribution_id AS id, left(title, 24) AS what FROM contrib_v JOIN pages_v ON doc_id = contribution_id), w AS (SELECT DISTINCT what FROM s), t AS (SELECT slug, left(title, 40) AS title FROM pages_v), u AS (SELECT DISTINCT title FROM t),
x AS (SELECT what, title, round({_similarity('what', 'title')}, 6) AS score FROM w, u), r AS (SELECT id, slug, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, slug) AS place FROM s JOIN x USING (what) JOIN t USING (title) WHERE score > 0)
SELECT id, slug, score, place::INTEGER AS place FROM r WHERE place <= 5""")
def candidates(spark, d):
    p = V.pages(spark, d)
    said = p.select(F.col("doc_id").alias("id"), F.substring("title", 1, 24).alias("what"))
    signals = V.contributions(spark, d).select(F.col("contribution_id").alias("id")).join(said, "id")
    return P.candidates(signals, p.select("slug", F.substring("title", 1, 40).alias("title")))


@query(f"""WITH {_CONTRIB} SELECT contribution_id, CASE WHEN authority = 'user_confirmed' OR signal_type NOT IN ('decision', 'preference') THEN 'canonical' ELSE 'session_log_only' END AS place FROM contrib_v""")
def admissibility(spark, d):
    return V.contributions(spark, d).select("contribution_id", M.admissibility(F.col("signal_type"), F.col("authority")).alias("place"))


@query(f"""WITH {_PAGES}, p AS (SELECT doc_id, slug, sha256(coalesce(body, '')) AS h FROM pages_v), t AS (SELECT slug, CASE WHEN doc_id % 3 = 0 THEN h ELSE 'old' END AS seen, doc_id % 2 AS tries FROM p)
SELECT slug, CASE WHEN seen IS NOT DISTINCT FROM h THEN 'apply' WHEN tries < 1 THEN 'retry' ELSE 'dead' END AS step FROM t JOIN p USING (slug)""")
def cas_check(spark, d):
    p = V.pages(spark, d).select("doc_id", "slug", F.sha2(F.coalesce("body", F.lit("")), 256).alias("hash"))
    tries = p.select("slug", F.when(F.col("doc_id") % 3 == 0, F.col("hash")).otherwise("old").alias("seen"), (F.col("doc_id") % 2).alias("tries"))
    return P.cas(tries, p.select("slug", "hash")).select("slug", "step")


@query("""WITH o AS (SELECT c_custkey AS src, c_nationkey AS dst, 'old' AS source, 'a' AS context FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS src, c_nationkey AS dst, CASE WHEN c_custkey % 4 = 0 THEN 'new' END AS source, 'b' AS context FROM customer WHERE c_custkey % 2 = 0)
SELECT src, dst, coalesce(n.source, o.source) AS source, CASE WHEN n.context IS NOT NULL THEN n.context ELSE o.context END AS context FROM o FULL JOIN n USING (src, dst)""")
def link_upsert(spark, d):
    c, k = V.table(spark, d, "customer"), F.col("c_custkey")
    row = lambda source, context: [k.alias("src"), F.col("c_nationkey").alias("dst"), source.alias("source"), F.lit(context).alias("context")]
    old = c.filter(k % 3 != 0).select(*row(F.lit("old"), "a"))
    new = c.filter(k % 2 == 0).select(*row(F.when(k % 4 == 0, "new"), "b"))
    return P.merged(old, new, ["src", "dst"], soft=["source"])


@query("""WITH o AS (SELECT p_partkey AS k, 'old' AS reason, CASE WHEN p_partkey % 3 = 1 THEN 'accepted' ELSE 'pending' END AS status FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey AS k, 'new' AS reason FROM part WHERE p_partkey % 2 = 0)
SELECT k, CASE WHEN o.status <> 'pending' THEN o.reason ELSE coalesce(n.reason, o.reason) END AS reason, CASE WHEN o.status <> 'pending' THEN o.status ELSE 'pending' END AS status FROM o FULL JOIN n USING (k)""")
def suggestion_upsert(spark, d):
    p, k = V.table(spark, d, "part"), F.col("p_partkey")
    old = p.filter(k % 3 != 0).select(k.alias("k"), F.lit("old").alias("reason"), F.when(k % 3 == 1, "accepted").otherwise("pending").alias("status"))
    new = p.filter(k % 2 == 0).select(k.alias("k"), F.lit("new").alias("reason"))
    return P.suggestions(old, new, ["k"])


@query(f"""WITH {_CHUNKS}, o AS (SELECT doc_id, chunk_index, CASE WHEN doc_id % 3 = 2 AND chunk_index = 0 THEN 'before' ELSE chunk_text END AS t FROM chunk_v WHERE doc_id % 3 <> 1 UNION ALL SELECT -1, 0, 'x')
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.chunk_index, o.chunk_index) AS chunk_index, CASE WHEN n.doc_id IS NULL THEN 'delete' WHEN sha256(o.t) IS NOT DISTINCT FROM sha256(n.chunk_text) THEN 'keep' ELSE 'embed' END AS step
FROM chunk_v n FULL JOIN o ON n.doc_id = o.doc_id AND n.chunk_index = o.chunk_index""")
def rechunk_diff(spark, d):
    new = R.chunks(V.pages(spark, d))
    k = F.col("doc_id") % 3
    old = new.filter(k != 1).withColumn("chunk_text", F.when((k == 2) & (F.col("chunk_index") == 0), "before").otherwise(F.col("chunk_text"))).select("doc_id", "chunk_index", "chunk_text")
    return P.rechunked(old.unionByName(spark.createDataFrame([(-1, 0, "x")], "doc_id long, chunk_index int, chunk_text string")), new)


@query("""WITH m AS (SELECT c_custkey, to_json(struct_pack(a := 'old', b := c_nationkey::VARCHAR)) AS o, CASE WHEN c_custkey % 2 = 0 THEN to_json(struct_pack(a := 'new')) END AS n FROM customer), j AS (SELECT c_custkey, CASE WHEN n IS NULL THEN o ELSE json_merge_patch(o, n) END AS j FROM m)
SELECT c_custkey, 'a=' || json_extract_string(j, '$.a') || ',b=' || json_extract_string(j, '$.b') AS meta FROM j""")
def json_merge(spark, d):
    old = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), _s("c_nationkey"))
    new = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("a"), F.lit("new")))
    m = P.merged_maps(old, new)
    x = V.table(spark, d, "customer").select("c_custkey", m.alias("m"))
    return x.select("c_custkey", F.concat(F.lit("a="), F.element_at("m", "a"), F.lit(",b="), F.element_at("m", "b")).alias("meta"))


@query("""WITH a AS (SELECT event_id AS id, event_id AS applied_s FROM events WHERE event_id % 2 = 0)
SELECT e.event_id AS id, applied_s + 100 AS expires_s, coalesce(applied_s + 100 <= 500, false) AS due FROM events e LEFT JOIN a ON a.id = e.event_id""")
def ttl_sweep(spark, d):
    e = V.table(spark, d, "events").select(F.col("event_id").alias("id"))
    return P.expiring(e, e.filter("id % 2 = 0").withColumn("applied_s", F.col("id")), 500, 100)


@query("""WITH x AS (SELECT doc_id AS id, 's' || doc_id % 3 AS session, ['decision','task','knowledge'][doc_id % 7 % 3 + 1] AS type, lower('What ' || doc_id % 4) AS what, quality, toxic FROM labels),
o AS (SELECT id, session, type, what, row_number() OVER (PARTITION BY session, type, what ORDER BY id) AS n FROM x WHERE toxic = 0), g AS (SELECT id, session, type, what, row_number() OVER (PARTITION BY session, type, what ORDER BY id) AS n FROM x WHERE quality = 1)
SELECT o.id AS output_id, g.id AS golden_id, CASE WHEN g.id IS NULL THEN 'extra' WHEN o.id IS NULL THEN 'missed' ELSE 'matched' END AS kind FROM o FULL JOIN g USING (session, type, what, n)""")
def eval_match(spark, d):
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("decision", "task", "knowledge"))), (i % 7 % 3 + 1).cast("int"))
    what = F.lower(F.concat(F.lit("What "), (i % 4).cast("string")))
    session = F.concat(F.lit("s"), (i % 3).cast("string"))
    x = V.table(spark, d, "labels").select(i.alias("id"), session.alias("session"), kind.alias("type"), what.alias("what"), "quality", "toxic")
    return P.matched(x.filter("toxic = 0"), x.filter("quality = 1"), ["session", "type", "what"])


@query("""SELECT CASE WHEN doc_id % 5 = 0 THEN 'holdout' ELSE 'tune' END AS split, count(*) AS n, count(*) - count(DISTINCT doc_id) AS duplicates FROM labels GROUP BY 1""")
def eval_split(spark, d):
    split = F.when(F.col("doc_id") % 5 == 0, "holdout").otherwise("tune").alias("split")
    n = F.count(F.lit(1))
    return V.table(spark, d, "labels").groupBy(split).agg(n.alias("n"), (n - F.count_distinct("doc_id")).alias("duplicates"))


# scopes and answers


@query(r"""WITH a AS (SELECT event_id AS id, 'see [1] and [2] or [7]' AS t, CASE WHEN event_id % 2 = 0 THEN [1, 2] ELSE [1] END AS refs FROM events),
m AS (SELECT id, t, refs, list_transform(regexp_extract_all(t, '\[(\d+)\]', 1), lambda x: x::INTEGER) AS marks FROM a)
SELECT id, list_reduce(list_prepend(t, list_transform(list_filter(list_distinct(marks), lambda x: NOT list_contains(refs, x)), lambda x: '[' || x || ']')), lambda y, z: replace(y, z, '')) AS answer,
 array_to_string(list_sort(list_filter(list_distinct(marks), lambda x: list_contains(refs, x))), ',') AS cited FROM m""")
def citations(spark, d):
    e = V.table(spark, d, "events").select(F.col("event_id").alias("id"))
    refs = e.withColumn("ref", F.lit(1)).unionByName(e.filter("id % 2 = 0").withColumn("ref", F.lit(2)))
    x = S.citations(e.withColumn("answer", F.lit("see [1] and [2] or [7]")), refs)
    return x.withColumn("cited", F.array_join(F.col("cited").cast("array<string>"), ","))


@query(f"""WITH {_TIMELINE} SELECT slug, sha256(string_agg(slug || ':' || date, chr(10) ORDER BY slug || ':' || date)) AS input_hash FROM timeline_v GROUP BY slug""")
def input_hash(spark, d):
    t = V.timeline(spark, d).withColumn("of", F.col("slug"))
    return S.cache_key(t, ["slug"], "of", "date")


@query(f"""WITH {_PAGES}, h AS (SELECT slug, title, round({_similarity('title', chr(39) + 'the and of' + chr(39))}, 6) AS score FROM pages_v), b AS (SELECT * FROM h WHERE score >= 0.05::DOUBLE ORDER BY score DESC, slug LIMIT 3)
SELECT count(*) AS hits, left(string_agg(rtrim('- [' || slug || '] ' || CASE WHEN title <> '' THEN title || ': ' ELSE '' END, ' '), chr(10) ORDER BY score DESC, slug), 3000) AS text FROM b HAVING count(*) > 0""")
def inject_gate(spark, d):
    score = F.round(T.similarity(F.col("title"), F.lit("the and of")), 6)
    return S.injected(V.pages(spark, d).select("slug", "title", score.alias("score"), F.lit("").alias("snippet")), least=0.05)


_STEPS = """e AS (SELECT 's/' || p_partkey AS src, 's/' || (p_partkey + 1) AS dst FROM part WHERE p_partkey % 6 <> 0)"""


@query(f"""WITH {_STEPS} SELECT 's/' || (p_partkey - k) AS start, 's/' || p_partkey AS slug, (k + 1)::INTEGER AS place FROM (SELECT p_partkey, unnest(range(0, 6)) AS k FROM part) WHERE (p_partkey - 1) % 6 = k""")
def chain(spark, d):
    k = F.col("p_partkey")
    slug = lambda n: F.concat(F.lit("s/"), n.cast("string"))
    p = V.table(spark, d, "part")
    edges = p.filter(k % 6 != 0).select(slug(k).alias("src"), slug(k + 1).alias("dst"))
    edges = edges.join(p.select(slug(k).alias("dst")), "dst", "left_semi")
    return S.ordered_chain(edges, p.filter(k % 6 == 1).select(slug(k).alias("slug")))


@query(f"""WITH RECURSIVE {_LINKS}, s AS (SELECT * FROM links_v WHERE link_type = 'part_of'), b AS (SELECT 'region/1' AS slug, 0 AS depth UNION SELECT s.src, b.depth + 1 FROM b JOIN s ON b.slug = s.dst WHERE b.depth < 2)
SELECT src, dst, link_type FROM s WHERE src IN (SELECT slug FROM b) AND dst IN (SELECT slug FROM b)""")
def bfs_edges(spark, d):
    e = V.links(spark, d).filter("link_type = 'part_of'")
    seen = G.traverse(e, "region/1", 2, "in").select("slug")
    return e.join(seen, e.src == seen.slug, "left_semi").join(seen, e.dst == seen.slug, "left_semi")


@query(f"""WITH {_PAGES}, {_CONTRIB} SELECT p.slug, (SELECT count(*) FROM contrib_v c WHERE c.page = p.slug AND active) AS signals, length(body) AS chars FROM pages_v p WHERE type = 'decision'""")
def page_context(spark, d):
    signals = V.contributions(spark, d).filter("active").groupBy(F.col("page").alias("slug")).agg(F.count(F.lit(1)).alias("signals"))
    x = V.pages(spark, d).filter("type = 'decision'").join(signals, "slug", "left")
    return x.select("slug", F.coalesce("signals", F.lit(0)).alias("signals"), F.length("body").cast("long").alias("chars"))


@query(f"""WITH {_CONTRIB}, {_PAGES} SELECT c.page AS slug, c.signal_type, c.what, p.title FROM contrib_v c JOIN pages_v p ON p.slug = c.page WHERE c.active AND c.page = 'knowledge/doc-7' ORDER BY c.created_s DESC, c.contribution_id LIMIT 20""")
def signals_by_entity(spark, d):
    c = V.contributions(spark, d).filter("active AND page = 'knowledge/doc-7'").withColumnRenamed("page", "slug")
    x = c.join(V.pages(spark, d).select("slug", "title"), "slug").orderBy(F.desc("created_s"), "contribution_id").limit(20)
    return x.select("slug", "signal_type", "what", "title")


@query(f"""WITH {_TIMELINE}, {_LINKS} SELECT t.slug, t.date, l.dst FROM timeline_v t JOIN links_v l ON t.slug = l.src WHERE l.dst = 'nation/3' AND t.date >= '1997-01-01'""")
def scope_entity(spark, d):
    near = G.in_links(V.links(spark, d), "nation/3").select(F.col("src").alias("slug"), "dst")
    return V.timeline(spark, d).filter("date >= '1997-01-01'").join(near, "slug").select("slug", "date", "dst")


@query(f"""WITH {_CONTRIB}, r AS (SELECT page, contribution_id, created_s, row_number() OVER (PARTITION BY page ORDER BY authority <> 'user_confirmed', created_s, contribution_id) AS n FROM contrib_v WHERE active)
SELECT page AS slug, contribution_id FROM r WHERE n = 1 AND created_s >= 1704067200 + 1200 AND created_s < 1704067200 + 86400""")
def scope_time(spark, d):
    c = V.contributions(spark, d).filter("active")
    x = L.primary(c).join(c.select("contribution_id", "created_s"), F.col("primary_id") == F.col("contribution_id"))
    return x.filter("created_s >= 1704067200 + 1200 AND created_s < 1704067200 + 86400").select(F.col("page").alias("slug"), "contribution_id")


@query(f"""WITH {_PAGES} SELECT slug, type, title FROM pages_v WHERE type IN ('decision', 'preference', 'reference')""")
def entity_pages(spark, d):
    return V.pages(spark, d).filter(F.col("type").isin("decision", "preference", "reference")).select("slug", "type", "title")


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), m AS (SELECT user_id, MAP {'S': CASE WHEN user_id % 3 = 0 THEN 'high' ELSE 'low' END, 'D': CASE WHEN user_id % 2 = 0 THEN 'high' ELSE 'low' END, 'I': 'low'} AS m FROM u)
SELECT user_id, concat_ws(',', CASE WHEN m['D'] = 'high' THEN 'red' END, CASE WHEN m['I'] = 'high' THEN 'yellow' END, CASE WHEN m['S'] = 'high' THEN 'green' END, CASE WHEN m['C'] = 'high' THEN 'blue' END) AS colors FROM m""")
def four_color(spark, d):
    level = lambda n: F.when(F.col("user_id") % n == 0, "high").otherwise("low")
    x = V.table(spark, d, "events").select("user_id").distinct()
    m = F.create_map(F.lit("S"), level(3), F.lit("D"), level(2), F.lit("I"), F.lit("low"))
    return x.select("user_id", F.array_join(M.four_colors(m), ",").alias("colors"))


@query(r"""WITH t AS (SELECT n_nationkey, 'intro' || chr(10) || '## Facts' || chr(10) || n_name || chr(10) || chr(10) || '## Links' || chr(10) || 'r' || n_regionkey AS t FROM nation),
p AS (SELECT n_nationkey, unnest(string_split(chr(10) || t, chr(10) || '## ')[2:]) AS p FROM t)
SELECT n_nationkey, trim(split_part(p, chr(10), 1)) AS title, CASE WHEN contains(p, chr(10)) THEN trim(substr(p, instr(p, chr(10)) + 1), E' \n\t\r') ELSE '' END AS body FROM p""")
def parse_sections(spark, d):
    text = F.concat(F.lit("intro\n## Facts\n"), "n_name", F.lit("\n\n## Links\nr"), _s("n_regionkey"))
    return V.table(spark, d, "nation").select("n_nationkey", F.inline(M.sections(text)))
