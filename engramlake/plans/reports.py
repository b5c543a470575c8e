"""Queries over signals, scans of structured sources, and the inputs of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake import views as V
from engramlake.functions import text as T
from engramlake.operators import retrieval as R
from engramlake.operators import signals as N
from engramlake.queries import _CHUNKS, _CONTRIB, _GROUP, _PAGES, _TIMELINE
from engramlake.registry import query


@query(r"""WITH r AS (SELECT event_id, to_json(CASE WHEN event_id % 5 = 1 THEN struct_pack(valid_at := '2024-01-02') END) AS none, CASE WHEN event_id % 5 <> 1 THEN '{"topic":"' || event_type || '",' ELSE '{' END || '"valid_at":"2024-01-02"' || CASE WHEN event_id % 5 = 2 THEN ',"invalid_at":"2024-01-01"' ELSE '' END || '}' AS body FROM events),
w AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN left(body, 12) ELSE body END AS raw FROM r), p AS (SELECT event_id, json_valid(raw) AS ok, CASE WHEN json_valid(raw) THEN raw END AS j FROM w),
f AS (SELECT event_id, ok, json_extract_string(j, '$.topic') AS topic, json_extract_string(j, '$.valid_at') AS a, json_extract_string(j, '$.invalid_at') AS b FROM p)
SELECT event_id, CASE WHEN NOT ok THEN 'invalid' WHEN coalesce(trim(topic), '') = '' THEN 'no topic' WHEN b < a THEN 'dates' END AS error, topic FROM f""")
def validate_signals(spark, d):
    k = F.col("event_id") % 5
    topic = F.when(k != 1, F.col("event_type")).alias("topic")
    body = F.to_json(F.struct(topic, F.lit("2024-01-02").alias("valid_at"), F.when(k == 2, "2024-01-01").alias("invalid_at")))
    x = V.table(spark, d, "events").select("event_id", F.when(k == 0, F.substring(body, 1, 12)).otherwise(body).alias("raw"))
    y = N.checked(x, "topic string, valid_at string, invalid_at string")
    return y.select("event_id", "error", F.when(F.col("error").isNull() | (F.col("error") != "invalid"), F.col("signal.topic")).alias("topic"))


@query(f"""WITH {_PAGES}, n AS (SELECT slug, doc_id, sha256(coalesce(body, '')) AS h FROM pages_v), o AS (SELECT slug, CASE WHEN doc_id % 4 = 1 THEN h ELSE 'old' END AS h, doc_id % 6 = 3 AS edited FROM n WHERE doc_id % 4 <> 0)
SELECT n.slug, CASE WHEN o.slug IS NULL THEN 'create' WHEN o.edited OR o.h IS NOT DISTINCT FROM n.h THEN 'skip' ELSE 'write' END AS step FROM n LEFT JOIN o USING (slug)""")
def signals_to_pages(spark, d):
    p, k = V.pages(spark, d).withColumn("source_hash", F.sha2(F.coalesce("body", F.lit("")), 256)), F.col("doc_id")
    have = p.filter(k % 4 != 0).select("slug", F.when(k % 4 == 1, F.col("source_hash")).otherwise("old").alias("source_hash"), (k % 6 == 3).alias("edited"))
    return N.new_pages(p.select("slug", "source_hash"), have)


@query(f"""WITH {_GROUP} SELECT channel, at_s // 86400 AS day, arg_min(contact, (at_s, event_id)) AS first_contact, count(DISTINCT contact) AS contacts, count(DISTINCT event_id) AS messages, min(at_s) AS start_s, max(at_s) AS end_s FROM group_v GROUP BY 1, 2""")
def block_provenance(spark, d):
    m = V.group_messages(spark, d).withColumn("day", F.floor(F.col("at_s") / 86400))
    return N.provenance(m, ["channel", "day"])


@query("""WITH m AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations), c AS (SELECT conv_id AS id, min(turn) AS "first", CASE WHEN conv_id % 2 = 0 THEN min(turn) + 1 ELSE min(turn) + 50 END AS "last" FROM m GROUP BY conv_id),
e AS (SELECT id, "first", "last", count(m.turn) AS n, bool_or(contains(m.t, 'the')) AS q FROM c LEFT JOIN m ON m.conv_id = id AND m.turn BETWEEN "first" AND "last" GROUP BY id, "first", "last")
SELECT id, n = "last" - "first" + 1 AS in_bounds, coalesce(q, false) AS quoted FROM e""")
def evidence_check(spark, d):
    m = V.table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("msg"), F.coalesce("text", F.lit("")).alias("content"))
    first = m.groupBy("session").agg(F.min("msg").alias("first"))
    last = F.col("first") + F.when(F.col("session") % 2 == 0, 1).otherwise(50)
    return N.evidence(first.select(F.col("session").alias("id"), "session", "first", last.alias("last"), F.lit("the").alias("quote")), m)


@query(f"""WITH {_PAGES} SELECT slug, type FROM pages_v p WHERE NOT EXISTS (SELECT 1 FROM pages_v g WHERE g.doc_id % 10 = 0 AND g.title = p.title)""")
def strip_overturned(spark, d):
    p = V.pages(spark, d)
    return N.without(p, p.filter("doc_id % 10 = 0"), "title").select("slug", "type")


@query(f"""WITH {_GROUP}, g AS (SELECT contact AS key, count(*) AS n FROM group_v GROUP BY contact) SELECT key, CASE WHEN n < 70 THEN 'too few' WHEN right(key, 1) IN ('1', '3') THEN 'unchanged' ELSE 'profile' END AS step FROM g""")
def profile_gate(spark, d):
    g = V.group_messages(spark, d).groupBy(F.col("contact").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("input_hash", F.sha2(F.concat_ws(":", "key", "n"), 256))
    return N.grounded(g, 70, g.filter(F.substring("key", -1, 1).isin("1", "3")))


@query("""SELECT 's/' || p_partkey AS slug, CASE WHEN p_partkey BETWEEN 1 AND 6 THEN p_partkey ELSE 1000000 + p_partkey END AS rank FROM part""")
def chain_rank(spark, d):
    k = F.col("p_partkey")
    slug = F.concat(F.lit("s/"), k.cast("string")).alias("slug")
    p = V.table(spark, d, "part")
    chain = p.filter(k > 0).select(F.concat(F.lit("c/"), F.floor((k - 1) / 6).cast("string")).alias("start"), slug, (F.pmod(k - 1, F.lit(6)) + 1).alias("place"))
    return N.chain_order(p.select(slug, k.alias("place")), chain)


@query("""SELECT o_orderkey AS id, strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d') AS day, o_orderstatus AS status, 'customer/' || o_custkey AS organizer FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-05-01'""")
def calendar_scan(spark, d):
    o = V.table(spark, d, "orders").filter("o_orderdate >= TIMESTAMP_NTZ '1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP_NTZ '1997-05-01 00:00:00'")
    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd")
    return o.select(F.col("o_orderkey").alias("id"), day.alias("day"), F.col("o_orderstatus").alias("status"), F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")).alias("organizer"))


@query("""SELECT user_id, string_agg(CASE WHEN r = 0 THEN m END, ',' ORDER BY m) AS assignees, string_agg(CASE WHEN r = 1 THEN m END, ',' ORDER BY m) AS followers
FROM (SELECT DISTINCT user_id, event_type AS m, length(event_type) % 2 AS r FROM events) GROUP BY user_id""")
def tasks_scan(spark, d):
    member = F.struct(F.col("event_type").alias("id"), F.when(F.length("event_type") % 2 == 0, "assignee").otherwise("follower").alias("role"))
    x = V.table(spark, d, "events").groupBy("user_id").agg(F.collect_set(member).alias("m"))
    of = lambda role: F.array_join(F.array_sort(F.transform(F.filter("m", lambda y: y["role"] == role), lambda y: y["id"])), ",")
    some = lambda c: F.when(c != "", c)
    return x.select("user_id", some(of("assignee")).alias("assignees"), some(of("follower")).alias("followers"))


@query(f"""WITH {_CHUNKS} SELECT c.doc_id, c.chunk_index, c.token_count FROM chunk_v c WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = c.doc_id AND c.chunk_index = 0)
ORDER BY c.doc_id, c.chunk_index LIMIT 256""")
def stale_chunks(spark, d):
    done = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_index"))
    return R.stale(R.chunks(V.pages(spark, d)), done).select("doc_id", "chunk_index", "token_count")


@query(f"WITH {_CHUNKS} SELECT chunk_index, chunk_text FROM chunk_v WHERE doc_id = 7")
def chunks_of_page(spark, d):
    return R.chunks(V.pages(spark, d).filter("doc_id = 7")).select("chunk_index", "chunk_text")


@query("""WITH m AS (SELECT doc_id, text, instr(lower(text), 'the') AS p FROM documents), w AS (SELECT *, greatest(p - 40, 1) AS lo, least(p + 43, length(text) + 1) AS hi FROM m)
SELECT doc_id, CASE WHEN p > 0 THEN CASE WHEN lo > 1 THEN '...' ELSE '' END || substr(text, lo, p - lo) || '**' || substr(text, p, 3) || '**' || substr(text, p + 3, hi - p - 3) || CASE WHEN hi <= length(text) THEN '...' ELSE '' END END AS snippet FROM w""")
def snippet(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), "the").alias("snippet"))


@query(f"""WITH {_GROUP} SELECT event_id, '[' || at_s || '] ' || contact || ': ' || channel AS line FROM group_v""")
def canon_chat(spark, d):
    return V.group_messages(spark, d).select("event_id", N.rendered_chat(F.col("contact"), F.col("at_s").cast("string"), F.col("channel")).alias("line"))


@query(f"""WITH {_GROUP} SELECT contact, count(*) AS messages, arg_min(channel, (at_s, event_id)) AS first_channel, sum(CASE WHEN value > 100 THEN 1 ELSE 0 END)::BIGINT AS large FROM group_v GROUP BY contact""")
def behavior_group(spark, d):
    large = F.sum(F.when(F.col("value") > 100, 1).otherwise(0))
    first = F.min_by("channel", F.struct("at_s", "event_id"))
    return V.group_messages(spark, d).groupBy("contact").agg(F.count(F.lit(1)).alias("messages"), first.alias("first_channel"), large.alias("large"))


@query(f"""WITH {_TIMELINE}, {_CONTRIB} SELECT 'timeline' AS part, slug, count(*) AS n FROM timeline_v WHERE date = '1997-03-03' GROUP BY slug
UNION ALL SELECT 'signal', page, count(*) FROM contrib_v WHERE active AND created_s >= 1704067200 AND created_s < 1704067200 + 3600 GROUP BY page""")
def daily_report_inputs(spark, d):
    n = F.count(F.lit(1)).alias("n")
    a = V.timeline(spark, d).filter("date = '1997-03-03'").groupBy("slug").agg(n).select(F.lit("timeline").alias("part"), "slug", "n")
    c = V.contributions(spark, d).filter("active AND created_s >= 1704067200 AND created_s < 1704067200 + 3600")
    return a.unionByName(c.groupBy(F.col("page").alias("slug")).agg(n).select(F.lit("signal").alias("part"), "slug", "n"))


@query(f"""WITH {_PAGES}, m AS (SELECT slug, to_json(struct_pack("source" := struct_pack(f := CASE WHEN doc_id % 2 = 0 THEN platform END), first_seen := struct_pack(f := channel))) AS meta FROM pages_v)
SELECT slug, coalesce(json_extract_string(meta, '$.source.f'), json_extract_string(meta, '$.first_seen.f')) AS source FROM m""")
def source_fields(spark, d):
    k = F.col("doc_id") % 2 == 0
    meta = F.to_json(F.struct(F.struct(F.when(k, F.col("platform")).alias("f")).alias("source"), F.struct(F.col("channel").alias("f")).alias("first_seen")))
    field = F.coalesce(F.get_json_object("meta", "$.source.f"), F.get_json_object("meta", "$.first_seen.f"))
    return V.pages(spark, d).withColumn("meta", meta).select("slug", field.alias("source"))


@query("""WITH i AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), h AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey < 5)
SELECT doc_id, 'tasks/doc-' || doc_id || '-' || left(sha256(line), 8) AS slug, 'customer/' || c_custkey AS owner, coalesce(c_custkey = 3, false) AS mine FROM i LEFT JOIN h ON c_custkey = doc_id % 7 WHERE length(line) >= 20""")
def action_items(spark, d):
    lines = F.explode(F.array_distinct(F.split("text", "\n"))).alias("text")
    items = V.table(spark, d, "documents").select("doc_id", F.concat(F.lit("u"), (F.col("doc_id") % 7).cast("string")).alias("owner_raw"), lines)
    c = V.table(spark, d, "customer").filter("c_custkey < 5").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("value"), F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("slug"))
    return N.action_items(items.filter(F.length("text") >= 20), c, "customer/3").select("doc_id", "slug", "owner", "mine")


@query(f"WITH {_PAGES} SELECT count(*) AS pages, sum(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS shared FROM pages_v")
def shadow_leak(spark, d):
    p = V.pages(spark, d)
    shadow = p.filter("doc_id % 3 = 0").select("slug", F.lit(1).alias("both"))
    return p.select("slug").join(shadow, "slug", "left").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.coalesce("both", F.lit(0))).alias("shared"))


@query("""WITH x AS (SELECT 'tok' || doc_id // 8 AS doc_token, doc_id, text FROM documents WHERE doc_id % 16 <> 1)
SELECT doc_token, sha256(string_agg(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), repeat(chr(10), 2) ORDER BY doc_id)) AS hash FROM x GROUP BY doc_token""".replace("\\\\", "\\"))
def canon_document(spark, d):
    m = V.stream_messages(spark, d).filter("platform = 'files' AND doc_token IS NOT NULL")
    return N.document_texts(m, ["doc_token"]).select("doc_token", F.sha2("text", 256).alias("hash"))


@query("""WITH p AS (SELECT 'customer/' || c_custkey AS key, c_custkey % 11 = 0 AS insufficient, unnest(range(0, 3)) AS place, c_custkey FROM customer),
d AS (SELECT *, ['D', 'I', 'X', 'S', 'C'][(c_custkey + place) % 5 + 1] AS axis, ['low', 'medium', 'high', 'huge'][(c_custkey * 3 + place) % 4 + 1] AS level, CASE WHEN place = 2 THEN [] ELSE [o || place, o || (c_custkey % 97), o || '-1'] END AS refs FROM (SELECT *, 'order/' AS o FROM p)),
e AS (SELECT 'customer/' || o_custkey AS key, list(DISTINCT 'order/' || o_orderkey % 100) AS slugs FROM orders GROUP BY o_custkey),
k AS (SELECT d.*, list_filter(refs, lambda r: list_contains(coalesce(slugs, []), r)) AS kept FROM d LEFT JOIN e USING (key))
SELECT key, place::INTEGER AS place, axis, level, array_to_string(kept, ',') AS refs, len(kept)::INTEGER AS evidence_count FROM k WHERE NOT insufficient AND axis IN ('D', 'I', 'S', 'C') AND level IN ('low', 'medium', 'high')""")
def profile_grounding(spark, d):
    k = F.col("c_custkey")
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    refs = lambda j: F.array() if j == 2 else F.array(text("order/", F.lit(j)), text("order/", k % 97), F.lit("order/-1"))
    dims = F.array(*[F.struct(pick(("D", "I", "X", "S", "C"), k + j).alias("axis"), pick(("low", "medium", "high", "huge"), k * 3 + j).alias("level"), refs(j).cast("array<string>").alias("evidence_refs")) for j in range(3)])
    profiles = V.table(spark, d, "customer").select(text("customer/", k).alias("key"), (k % 11 == 0).alias("insufficient"), dims.alias("dimensions"))
    evidence = V.table(spark, d, "orders").select(text("customer/", F.col("o_custkey")).alias("key"), text("order/", F.col("o_orderkey") % 100).alias("slug"))
    x = N.grounded_traits(profiles, evidence)
    return x.select("key", "place", "axis", "level", F.array_join("evidence_refs", ",").alias("refs"), "evidence_count")
