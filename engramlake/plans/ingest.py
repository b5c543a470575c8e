"""Queries over sources: transcripts, chat payloads, documents, vaults. Payloads are rendered from the driver's tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake import views as V
from engramlake.functions import messages as M
from engramlake.functions import text as T
from engramlake.operators.steps import digested
from engramlake.queries import _GROUP, _LINKS, _PAGES
from engramlake.registry import query
from engramlake.sources import chat, transcripts, vault

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_SQL_FILE = "'agents/a' || (conv_id % 3) || '/sessions/conv-' || conv_id || '.jsonl'"


def _file():
    conv = F.col("conv_id").cast("string")
    return F.concat(F.lit("agents/a"), (F.col("conv_id") % 3).cast("string"), F.lit("/sessions/conv-"), conv, F.lit(".jsonl"))


def _at():
    return F.col("turn").cast("string").alias("timestamp")


def _lines(spark, d, record) -> DataFrame:
    """Conversations as lines of transcripts, each eleventh cut off."""
    c = V.table(spark, d, "conversations")
    text = F.to_json(record)
    cut = F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, F.substring(text, 1, 10)).otherwise(text)
    return c.select(_file().alias("file"), F.col("turn").alias("line"), cut.alias("text"))


_WHOLE = "text IS NOT NULL AND (conv_id + turn) % 11 <> 0"
_MESSAGE = f"{_SQL_FILE} AS file, turn AS line, CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS contact, CASE role WHEN 'user' THEN 'sent' ELSE 'received' END AS direction"


@query(f"""SELECT {_SQL_FILE} AS file, turn AS line, 'invalid' AS reason FROM conversations WHERE (conv_id + turn) % 11 = 0""")
def scan_transcripts(spark, d):
    return transcripts.bad_lines(_lines(spark, d, F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message"))))


@query(f"""SELECT {_MESSAGE}, 'conv-' || conv_id AS session, turn::VARCHAR AS "at", text AS content FROM conversations WHERE {_WHOLE} AND role IN ('user', 'assistant')""")
def parse_dialect_a(spark, d):
    head = [F.col("role").alias("type"), F.lit("u").alias("uuid"), _at(), F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("sessionId")]
    return transcripts.dialect_a(_lines(spark, d, F.struct(*head, F.struct("role", F.col("text").alias("content")).alias("message"))))


@query(f"""WITH m AS (SELECT {_MESSAGE}, turn::VARCHAR AS "at", text AS content, {_STRIP.format('text')} AS t FROM conversations WHERE {_WHOLE} AND role IN ('user', 'assistant')),
r AS (SELECT *, row_number() OVER (PARTITION BY contact, lower(left(t, 200)) ORDER BY file, line) AS n FROM m WHERE t <> '')
SELECT file, line, contact, direction, file AS session, "at", content FROM r WHERE contact = 'assistant' OR n = 1""")
def parse_dialect_b(spark, d):
    kind = F.when(F.col("role") == "user", "input_text").otherwise("output_text").alias("type")
    payload = F.struct("role", F.array(F.struct(kind, "text")).alias("content")).alias("payload")
    return transcripts.dialect_b(_lines(spark, d, F.struct(F.lit("response_item").alias("type"), _at(), payload)))


@query(f"""SELECT {_MESSAGE}, 'conv-' || conv_id AS session, turn::VARCHAR AS "at", text AS content, 'a' || (conv_id % 3) AS agent FROM conversations
WHERE {_WHOLE} AND role IN ('user', 'assistant') AND {_STRIP.format('text')} <> ''""")
def parse_dialect_c(spark, d):
    message = F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text"), F.struct(F.lit("toolCall").alias("type"), F.lit("x").alias("text"))).alias("content"))
    return transcripts.dialect_c(_lines(spark, d, F.struct(F.lit("message").alias("type"), _at(), message.alias("message"))))


@query(f"""WITH h AS (SELECT conv_id, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS h FROM conversations GROUP BY conv_id),
k AS (SELECT conv_id, CASE WHEN conv_id % 4 = 1 THEN 'older' ELSE h END AS h FROM h WHERE conv_id % 4 <> 0)
SELECT {_SQL_FILE.replace('conv_id', 'h.conv_id')} AS file, CASE WHEN k.h = h.h THEN 'unchanged' WHEN k.h IS NOT NULL THEN 'revised' ELSE 'new' END AS state FROM h LEFT JOIN k ON k.conv_id = h.conv_id""")
def session_revisions(spark, d):
    x = digested(V.table(spark, d, "conversations"), ["conv_id"], [F.asc("turn")], "text")
    seen = x.select("conv_id", _file().alias("file"), "hash")
    ledger = seen.filter("conv_id % 4 <> 0").select("file", F.when(F.col("conv_id") % 4 == 1, "older").otherwise(F.col("hash")).alias("hash"))
    return transcripts.revisions(seen, ledger).select("file", "state")


@query(f"""SELECT 'conv-' || conv_id AS session, turn || '.' || (k + 1) AS piece, substr(text, (k * 400 + 1)::BIGINT, 400) AS content
FROM (SELECT *, unnest(range(0, ceil(length(text) / 400.0)::BIGINT)) AS k FROM conversations WHERE length(text) > 400)""")
def segment_pieces(spark, d):
    c = V.table(spark, d, "conversations")
    x = c.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("session"), F.col("turn").alias("msg"), F.col("text").alias("content"))
    return transcripts.oversized(x.withColumn("tokens", F.length("content") / 4), 100)


@query()
def segments(spark, d):
    """Sessions packed to 400 tokens; each cut depends on the one before, so SQL has no equal."""
    return _segments(spark, d, False)


@query()
def segments_long(spark, d):
    """As `segments`, a test holds them to be equal, but a session of any length is cut by many tasks."""
    return _segments(spark, d, True)


def _segments(spark, d, long):
    c = V.table(spark, d, "conversations")
    tokens = T.token_estimate(F.coalesce("text", F.lit("")))
    x = c.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("session"), F.col("turn").alias("msg"), tokens.alias("tokens"))
    return transcripts.segments(x, 400.0, long)


_KIND = "['text','post','image','file','interactive','other'][event_id % 6 + 1]"


_RAW = """raw AS (SELECT event_id, ['text','post','image','file','interactive','other'][event_id % 6 + 1] AS kind, CASE event_id % 6 WHEN 1 THEN to_json(struct_pack(title := event_type, content := [[struct_pack(text := 'a')], [struct_pack(text := ''), struct_pack(text := 'b')]]))::VARCHAR
 WHEN 2 THEN to_json(struct_pack(image_key := 'k' || event_id))::VARCHAR WHEN 3 THEN CASE WHEN event_id % 4 = 1 THEN to_json(struct_pack(file_key := 'f' || event_id))::VARCHAR ELSE to_json(struct_pack(file_key := 'f' || event_id, file_name := event_type))::VARCHAR END
 WHEN 4 THEN '{"config": {}}' ELSE CASE WHEN event_id % 7 = 0 THEN 'no json ' || event_type ELSE to_json(struct_pack(text := event_type))::VARCHAR END END AS raw FROM events),
parsed AS (SELECT *, CASE WHEN json_valid(raw) THEN raw END AS j FROM raw)"""


@query(f"""WITH {_RAW} SELECT event_id, kind, CASE WHEN coalesce(raw, '') = '' THEN '' WHEN j IS NULL THEN raw WHEN kind = 'text' THEN coalesce(json_extract_string(j, '$.text'), '')
 WHEN kind = 'post' THEN array_to_string(list_filter(list_prepend(coalesce(json_extract_string(j, '$.title'), ''), json_extract_string(j, '$.content[*][*].text')), lambda t: t <> ''), ' ')
 WHEN kind = 'image' THEN '[图片]' WHEN kind = 'file' THEN coalesce('[文件: ' || json_extract_string(j, '$.file_name') || ']', '[文件]')
 WHEN kind = 'interactive' THEN coalesce(json_extract_string(j, '$.config.wide_screen_mode.header.title.content'), '[卡片消息]') ELSE raw END AS content,
 CASE kind WHEN 'image' THEN json_extract_string(j, '$.image_key') WHEN 'file' THEN json_extract_string(j, '$.file_key') END AS attachment FROM parsed""")
def decode_message(spark, d):
    e = V.table(spark, d, "events")
    kinds = F.array(*map(F.lit, ("text", "post", "image", "file", "interactive", "other")))
    i = F.col("event_id")
    n = (i % 6).cast("int")
    part = lambda t: F.struct(F.lit(t).alias("text"))
    key = lambda p: F.concat(F.lit(p), i.cast("string"))
    raw = (
        F.when(n == 1, F.to_json(F.struct(F.col("event_type").alias("title"), F.array(F.array(part("a")), F.array(part(""), part("b"))).alias("content"))))
        .when(n == 2, F.to_json(F.struct(key("k").alias("image_key"))))
        .when(n == 3, F.to_json(F.struct(key("f").alias("file_key"), F.when(i % 4 != 1, F.col("event_type")).alias("file_name"))))
        .when(n == 4, F.lit('{"config": {}}'))
        .otherwise(F.when(i % 7 == 0, F.concat(F.lit("no json "), "event_type")).otherwise(F.to_json(F.struct(F.col("event_type").alias("text")))))
    )
    x = e.select("event_id", F.element_at(kinds, n + 1).alias("kind"), raw.alias("raw"))
    got = chat.attachment(F.col("kind"), F.col("raw"))["id"]
    return x.select("event_id", "kind", chat.decoded(F.col("kind"), F.col("raw")).alias("content"), got.alias("attachment"))


@query(f"""WITH {_GROUP}, c AS (SELECT channel, (min(at_s) + 864000)::BIGINT AS cursor_s FROM group_v WHERE channel <> 'group/error' GROUP BY channel)
SELECT event_id, channel, at_s FROM group_v LEFT JOIN c USING (channel) WHERE cursor_s IS NULL OR at_s >= cursor_s - 2""")
def chat_scan(spark, d):
    m = V.group_messages(spark, d)
    cursors = m.filter("channel <> 'group/error'").groupBy("channel").agg((F.min("at_s") + 864000).alias("cursor_s"))
    return chat.since(m, cursors).select("event_id", "channel", "at_s")


@query(f"""WITH {_GROUP}, c AS (SELECT contact, max(CASE WHEN event_id % 17 <> 0 THEN at_s END) AS newest, min(CASE WHEN event_id % 17 = 0 THEN at_s END) AS oldest FROM group_v GROUP BY contact)
SELECT contact, CASE WHEN newest IS NOT NULL THEN least(newest, coalesce(oldest - 1, newest)) END AS cursor FROM c""")
def mail_cursor(spark, d):
    return chat.clamped_cursor(V.group_messages(spark, d).withColumn("ok", F.col("event_id") % 17 != 0), ["contact"], "ok", "at_s")


@query(rf"""WITH {_GROUP}, t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN at_s::VARCHAR WHEN 1 THEN at_s || '123' WHEN 2 THEN strftime(to_timestamp(at_s) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') WHEN 3 THEN 'soon' ELSE strftime(to_timestamp(at_s) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || 'Z' END AS t FROM group_v)
SELECT event_id, CASE WHEN regexp_full_match(t, '\d{{13}}') THEN t::BIGINT // 1000 WHEN regexp_full_match(t, '\d{{10}}') THEN t::BIGINT
 WHEN regexp_full_match(t, '\d{{4}}-\d\d-\d\d[ T]\d\d:\d\d:\d\dZ') THEN epoch(replace(left(t, 19), 'T', ' ')::TIMESTAMP)::BIGINT WHEN regexp_full_match(t, '\d{{4}}-\d\d-\d\d[ T]\d\d:\d\d:\d\d') THEN epoch(replace(t, 'T', ' ')::TIMESTAMP)::BIGINT - 28800 END AS seconds FROM t""")
def parse_times(spark, d):
    m = V.group_messages(spark, d)
    n, at = F.col("event_id") % 5, F.col("at_s").cast("string")
    iso = F.date_format(F.timestamp_seconds("at_s"), "yyyy-MM-dd HH:mm:ss")
    zulu = F.date_format(F.timestamp_seconds("at_s"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.when(n == 0, at).when(n == 1, F.concat(at, F.lit("123"))).when(n == 2, iso).when(n == 3, "soon").otherwise(zulu)
    x = m.select("event_id", text.alias("t"))
    return x.select("event_id", chat.parsed_time(F.col("t")).alias("seconds"))


@query(f"""WITH {_LINKS}, f AS (SELECT src AS token, dst AS parent FROM links_v WHERE link_type = 'part_of')
SELECT token, 1 AS level FROM f WHERE parent = 'region/2' UNION ALL SELECT a.token, 2 FROM f a JOIN f b ON a.parent = b.token WHERE b.parent = 'region/2' UNION ALL SELECT 'region/2', 0""")
def doc_walk(spark, d):
    folders = V.links(spark, d).filter("link_type = 'part_of'").select(F.col("src").alias("token"), F.col("dst").alias("parent"))
    return chat.walk(folders, spark.createDataFrame([("region/2",)], "token string"), 2)


_DOC = "doc_id % 8 <> 7 AS docx, CASE WHEN doc_id % 3 = 1 THEN 'pointer' WHEN doc_id % 3 = 2 THEN 'full' END AS level, doc_id % 5 < 2 AS same, CASE WHEN doc_id % 13 = 0 THEN 'T1' WHEN created_s >= 1704067200 + 86400 THEN 'T2' WHEN channel = 'web' THEN 'T4' END AS why"


@query(f"""WITH {_PAGES}, x AS (SELECT slug, {_DOC} FROM pages_v)
SELECT slug, why AS "trigger", CASE WHEN NOT docx THEN 'save_pointer' WHEN level IS NULL THEN CASE WHEN why IS NULL THEN 'save_pointer' ELSE 'queue_for_upgrade' END
 WHEN level = 'pointer' THEN CASE WHEN why IS NOT NULL THEN 'queue_for_upgrade' WHEN same THEN 'skip_save' ELSE 'save_pointer' END
 WHEN same THEN 'skip_save' ELSE 'needs_body_check' END AS action FROM x""")
def doc_decide(spark, d):
    k = F.col("doc_id")
    why = chat.trigger(F.when(k % 13 == 0, "me").otherwise("you"), F.col("created_s"), F.col("channel"), "me", 1704067200 + 86400 * 31, 30, ["web"])
    level = F.when(k % 3 == 1, "pointer").when(k % 3 == 2, "full")
    action = chat.decision(F.when(k % 8 != 7, "docx").otherwise("sheet"), level, k % 5 < 2, why)
    return V.pages(spark, d).select("slug", why.alias("trigger"), action.alias("action"))


@query("""WITH q AS (SELECT event_type || '-' || user_id AS token, min(event_id) AS asked FROM events GROUP BY 1) SELECT token, asked FROM q ORDER BY asked, token LIMIT 20""")
def upgrade_batch(spark, d):
    q = V.table(spark, d, "events").select(F.concat("event_type", F.lit("-"), F.col("user_id").cast("string")).alias("token"), F.col("event_id").alias("asked"))
    return chat.upgrade_batch(q, 1, 3, 20, 5)


@query("""WITH b AS (SELECT user_id, event_id, unnest([struct_pack(type := ['heading1','heading2','heading3','text','code','heading4'][event_id % 6 + 1], text := ' ' || event_type), struct_pack(type := 'heading2', text := CASE WHEN event_id % 4 = 0 THEN '  ' ELSE 'part ' || user_id END)]) AS b FROM events)
SELECT user_id, event_id, right(b.type, 1)::INTEGER AS level, trim(b.text) AS title FROM b WHERE b.type IN ('heading1', 'heading2', 'heading3') AND trim(b.text) <> ''""")
def doc_toc(spark, d):
    i = F.col("event_id")
    kinds = F.array(*map(F.lit, ("heading1", "heading2", "heading3", "text", "code", "heading4")))
    one = F.struct(F.element_at(kinds, (i % 6 + 1).cast("int")).alias("type"), F.concat(F.lit(" "), "event_type").alias("text"))
    two = F.struct(F.lit("heading2").alias("type"), F.when(i % 4 == 0, "  ").otherwise(F.concat(F.lit("part "), F.col("user_id").cast("string"))).alias("text"))
    x = V.table(spark, d, "events").select("user_id", "event_id", chat.headings(F.array(one, two)).alias("h"))
    return x.select("user_id", "event_id", F.inline("h"))


@query(f"""WITH {_PAGES} SELECT slug, sha256({_STRIP.format("regexp_replace(body, '(?m)[ ' || chr(9) || ']+$', '', 'g')")}) AS hash FROM pages_v""")
def body_hash(spark, d):
    return V.pages(spark, d).select("slug", chat.body_hash(F.col("body")).alias("hash"))


@query("SELECT event_type AS status, count(*) AS n, sum(CASE WHEN value > 100 THEN 1 ELSE 0 END)::BIGINT AS failed FROM events GROUP BY event_type")
def doc_status(spark, d):
    return V.table(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("value") > 100, 1).otherwise(0)).alias("failed"))


# vaults


_MD = "'---' || chr(10) || 'title: ' || replace(title, chr(13), '') || chr(10) || 'type: ' || type || chr(10) || '---' || chr(10)"


def _rendered(spark, d) -> DataFrame:
    p = V.pages(spark, d)
    tags = p.filter("channel IS NOT NULL").select("slug", F.col("channel").alias("tag"))
    links = p.filter("doc_id > 0").select(F.col("slug").alias("src"), F.concat(F.lit("knowledge/doc-"), (F.col("doc_id") - 1).cast("string")).alias("dst"), F.lit("mentions").alias("link_type"))
    return vault.rendered(p, tags, links)


_RENDERED = f"""r AS (SELECT doc_id, slug, '---' || chr(10) || 'title: ' || coalesce(title, '') || chr(10) || 'type: ' || type || chr(10) || 'tags: [' || coalesce(channel, '') || ']' || chr(10) || '---' || chr(10)
 || coalesce(body, '') || CASE WHEN doc_id > 0 THEN chr(10) || '[[mentions:knowledge/doc-' || (doc_id - 1) || ']]' ELSE '' END AS content FROM pages_v)"""


@query(f"WITH {_PAGES}, {_RENDERED} SELECT slug, content FROM r")
def vault_render(spark, d):
    return _rendered(spark, d)


@query(f"""WITH {_PAGES}, {_RENDERED}, k AS (SELECT slug, CASE WHEN doc_id % 4 = 1 THEN 'older' ELSE sha256(content) END AS h FROM r WHERE doc_id % 4 <> 0 UNION ALL SELECT 'gone/page', 'x')
SELECT coalesce(r.slug, k.slug) AS slug, CASE WHEN r.slug IS NULL THEN 'remove' WHEN k.h IS NOT DISTINCT FROM sha256(r.content) THEN 'skip' ELSE 'write' END AS step FROM r FULL JOIN k ON r.slug = k.slug""")
def vault_export_diff(spark, d):
    r = _rendered(spark, d)
    k = F.regexp_extract("slug", r"(\d+)$", 1).cast("long") % 4
    known = r.filter(k != 0).select("slug", F.when(k == 1, "older").otherwise(F.sha2("content", 256)).alias("hash"))
    return vault.export_plan(r, known.unionByName(spark.createDataFrame([("gone/page", "x")], "slug string, hash string")))


@query(f"""WITH {_PAGES} SELECT slug, CASE doc_id % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'skip' WHEN 2 THEN 'update' WHEN 3 THEN 'conflict' ELSE 'skip' END AS step FROM pages_v""")
def vault_import_plan(spark, d):
    p = V.pages(spark, d)
    k = F.col("doc_id") % 5
    files = p.select("slug", F.lit("f").alias("hash"))
    store = p.filter(k != 0).select("slug", F.when(k == 1, "f").when(k == 2, "s").when(k == 3, "t").otherwise("u").alias("hash"))
    manifest = p.filter(k > 1).select("slug", F.when(k == 2, "s").when(k == 3, "r").otherwise("f").alias("hash"))
    return vault.import_plan(files, store, manifest)


@query(f"""WITH {_PAGES} SELECT slug, type, {_STRIP.format("regexp_replace(title, chr(13), '', 'g')")} AS title, coalesce(body, '') AS body FROM (SELECT slug, type, coalesce(title, '') AS title, body FROM pages_v)""")
def parse_frontmatter(spark, d):
    p = V.pages(spark, d).withColumn("title", F.coalesce("title", F.lit("")))
    head = F.concat(F.lit("---\ntitle: "), F.regexp_replace("title", "\r", ""), F.lit("\ntype: "), "type", F.lit("\n---\n"), F.coalesce("body", F.lit("")))
    x = p.select("slug", head.alias("content")).withColumn("f", vault.fields(F.col("content")))
    return x.select("slug", F.element_at("f", "type").alias("type"), F.regexp_replace(F.element_at("f", "title"), r"^\s+|\s+$", "").alias("title"), vault.body(F.col("content")).alias("body"))


# messages


@query(r"""SELECT doc_id, list_distinct(regexp_extract_all(text, '#[\w一-鿿]+')) AS hashtags, list_distinct(regexp_extract_all(text, 'https?://[^\s<>\]）》]+')) AS urls FROM documents""")
def entity_lists(spark, d):
    e = M.entities(F.col("text"))
    of = lambda kind: F.transform(F.filter("e", lambda x: x["type"] == kind), lambda x: x["value"])
    return V.table(spark, d, "documents").select("doc_id", e.alias("e")).select("doc_id", of("hashtag").alias("hashtags"), of("url").alias("urls"))


@query("""SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'agent_session' WHEN event_type = 'error' THEN 'email' WHEN event_type = 'signup' THEN 'dm' WHEN event_type = 'purchase' THEN 'structured' ELSE 'chat' END AS source_type FROM events""")
def source_type(spark, d):
    prefix = F.when(F.col("event_type") == "error", "mail/").when(F.col("event_type") == "signup", "dm/").when(F.col("event_type") == "purchase", "calendar/").otherwise("group/")
    platform = F.when(F.col("user_id") % 7 == 0, "agent").otherwise("chat")
    return V.table(spark, d, "events").select("event_id", M.source_type(F.concat(prefix, "event_type"), platform).alias("source_type"))


@query(f"""WITH {_GROUP} SELECT event_id, sha256('chat:' || channel || ':' || CASE WHEN event_id % 2 = 0 THEN 'm' || event_id ELSE contact || ':0' END || ':' || at_s) AS hash FROM group_v""")
def dedup_hash(spark, d):
    m = V.group_messages(spark, d)
    mid = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("m"), F.col("event_id").cast("string")))
    return m.select("event_id", M.identity_hash(F.lit("chat"), F.col("channel"), F.col("at_s").cast("string"), mid, F.concat("contact", F.lit(":0"))).alias("hash"))


@query("SELECT doc_id, (contains(lower(text), 'grep')::INT + contains(lower(text), 'runbook')::INT + contains(lower(text), 'playbook')::INT) >= 2 AS playbook FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def playbook_classify(spark, d):
    return V.table(spark, d, "documents").select("doc_id", M.is_playbook(F.coalesce("text", F.lit(""))).alias("playbook"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN lower(c_name) WHEN 1 THEN c_name || ' x' ELSE c_name || '  x' END AS handle FROM customer""")
def handle_norm(spark, d):
    k = F.col("c_custkey") % 3
    kind = F.when(k == 0, "email").when(k == 1, "name").otherwise("slug")
    raw = F.when(k == 0, F.concat(F.lit(" "), "c_name")).otherwise(F.concat("c_name", F.lit("  x ")))
    return V.table(spark, d, "customer").select("c_custkey", M.handle(kind, raw).alias("handle"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '1[3-9]\d{9}')) AS n, CASE WHEN regexp_matches(text, '1[3-9]\d{9}') THEN length(regexp_extract(text, '(?s)^(.*?)1[3-9]\d{9}', 1))::INTEGER END AS first_at FROM documents""")
def redaction_map(spark, d):
    x = V.table(spark, d, "documents")
    m = M.redactions(F.col("text"), "phone", r"1[3-9]\d{9}")
    return x.select("doc_id", m.alias("m")).select("doc_id", F.size("m").cast("long").alias("n"), F.get("m", F.lit(0))["position"].alias("first_at"))
