"""Queries of search with filters, query rewriting, block building, noise and scores, links, states and digests, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake import views as V
from engramlake.functions import messages as M
from engramlake.functions import text as T
from engramlake.operators import activity as A
from engramlake.operators import filters, rules, search
from engramlake.operators.filters import MemoryFilter
from engramlake.queries import _CONTRIB, _LINKS, _PAGES, _TIMELINE, AS_OF_S, _query_vector, _similarity
from engramlake.registry import query

_SOURCED = """sourced AS (SELECT *, ['email','dm','group','document'][doc_id % 4 + 1] AS source_type, 'room-' || doc_id % 10 AS channel_name,
  'u' || doc_id % 7 AS author_id, 'Name ' || doc_id % 7 AS author_name, ['u' || doc_id % 11, 'u' || doc_id % 13, 'Name ' || doc_id % 11, 'Name ' || doc_id % 13] AS people,
  CASE WHEN doc_id % 5 <> 0 THEN created_s + 3600 ELSE created_s END AS seen_s FROM pages_v)"""
_LIVE = """signals_v AS (SELECT *, CASE WHEN authority = 'user_confirmed' THEN 'en' ELSE 'de' END AS platform,
  ['email','dm','group','document'][contribution_id % 4 + 1] AS source_type, 'src' || contribution_id % 20 AS channel, 'room-' || contribution_id % 10 AS channel_name,
  'u' || contribution_id % 7 AS author_id, 'Name ' || contribution_id % 7 AS author_name, ['u' || contribution_id % 17, 'Name ' || contribution_id % 17] AS people
  FROM contrib_v WHERE active)"""


def _seen_sql(tests: list[str], rest: str = "true") -> str:
    """CTE `seen`: the pages that pass; each test is put to the active contributions of a page, or to the page if it has none."""
    cols = "".join(f", bool_or(coalesce({t}, false)) AS m{k}" for k, t in enumerate(tests))
    each = "".join(f" AND CASE WHEN l.page IS NOT NULL THEN m{k} ELSE coalesce({t.replace('@', 'p.')}, false) END" for k, t in enumerate(tests))
    cols, live = cols.replace("@", ""), f"live AS (SELECT page{cols} FROM signals_v GROUP BY page)".replace("@", "")
    return f"{_PAGES}, {_CONTRIB}, {_SOURCED}, {_LIVE}, {live}, seen AS (SELECT p.* FROM sourced p LEFT JOIN live l ON l.page = p.slug WHERE {rest}{each})"


_CUT = r"""cut AS (SELECT slug, created_s, i::INTEGER AS chunk_index, array_to_string(w[i * 250 + 1:i * 250 + 300], ' ') AS chunk_text
  FROM (SELECT slug, created_s, w, unnest(range(0, CASE WHEN len(w) <= 300 THEN 1 ELSE 1 + ceil((len(w) - 300) / 250.0)::BIGINT END)) AS i
        FROM (SELECT slug, created_s, list_filter(regexp_split_to_array(body, '\s+'), lambda x: x <> '') AS w FROM seen)))"""


def _hybrid_sql(seen: str, limit: int, most: int, post: str = "true") -> str:
    return f"""WITH {_LINKS}, {seen}, {_CUT}, q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0 LIMIT 1),
lex AS (SELECT slug, row_number() OVER (ORDER BY score DESC, created_s DESC, slug, chunk_index) - 1 AS rank FROM
 (SELECT slug, created_s, chunk_index, round({_similarity('chunk_text', "'thing'")}, 6) AS score FROM cut WHERE contains(lower(chunk_text), 'thing'))),
near AS (SELECT slug, row_number() OVER (ORDER BY score DESC, slug) - 1 AS rank FROM
 (SELECT slug, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM embeddings JOIN seen ON vec_id = doc_id, q)),
fused AS (SELECT slug, max(1.0::DOUBLE / (61 + rank)) AS rrf FROM (SELECT * FROM lex WHERE rank < {most} UNION ALL SELECT * FROM near WHERE rank < {most}) GROUP BY slug),
back AS (SELECT dst, count(*) AS n FROM (SELECT dst FROM links_v UNION ALL SELECT page FROM contrib_v) GROUP BY dst)
SELECT p.slug, p.type, p.title, round(rrf * 2 * CASE tier WHEN 'warm' THEN 0.8::DOUBLE WHEN 'cold' THEN 0.6::DOUBLE ELSE 1 END * (1 + 0.05::DOUBLE * ln(1 + coalesce(n, 0)))
 * (1 + 0.3::DOUBLE * exp(-greatest(({AS_OF_S} - created_s) / 86400.0::DOUBLE, 0) / 90)), 6)::DOUBLE AS score
FROM fused JOIN pages_v p USING (slug) LEFT JOIN back b ON b.dst = p.slug WHERE {post} ORDER BY score DESC, slug LIMIT {limit}"""


def _hybrid(spark, d, f: MemoryFilter):
    vectors = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    pages, signals = V.sourced_pages(spark, d), V.sourced_contributions(spark, d)
    return search.hybrid(pages, signals, vectors, V.page_links(spark, d), "What is the thing", _query_vector(spark, d), AS_OF_S, f)


@query(_hybrid_sql(_seen_sql([]), 20, 50))
def hybrid_search(spark, d):
    return _hybrid(spark, d, MemoryFilter())


@query(_hybrid_sql(_seen_sql(["@platform IN ('en', 'de')", "@source_type = 'dm'"], "type IN ('task', 'decision', 'knowledge')"), 5, 20))
def hybrid_by_source(spark, d):
    return _hybrid(spark, d, MemoryFilter(platform=["en", "de"], source_type="dm", types=("task", "decision", "knowledge"), limit=5))


_BY_PERSON = _seen_sql(
    ["(list_contains(@people, 'Name 3') OR @author_name = 'Name 3' OR @author_id = 'Name 3')"],
    "type <> 'reference' AND seen_s >= epoch(TIMESTAMP '2024-01-02') AND seen_s < epoch(TIMESTAMP '2024-02-08')",
)


@query(_hybrid_sql(_BY_PERSON, 10, 30, "p.type <> 'reference'"))
def hybrid_by_person(spark, d):
    return _hybrid(spark, d, MemoryFilter(participant="Name 3", exclude_types=("reference",), since="2024-01-02", until="2024-02-07", limit=10))


def _filtered(spark, d, f: MemoryFilter):
    return filters.matching(V.sourced_pages(spark, d), V.sourced_contributions(spark, d), f).select("slug")


@query(f"WITH {_seen_sql(['@channel = ' + chr(39) + 'src3' + chr(39), '@channel_name = ' + chr(39) + 'room-3' + chr(39)])} SELECT slug FROM seen")
def filter_channel(spark, d):
    return _filtered(spark, d, MemoryFilter(channel="src3", channel_name="room-3"))


@query(f"WITH {_seen_sql(['(list_contains(@people, ' + chr(39) + 'u5' + chr(39) + ') OR @author_id = ' + chr(39) + 'u5' + chr(39) + ')'])} SELECT slug FROM seen")
def filter_participant(spark, d):
    return _filtered(spark, d, MemoryFilter(participant="u5"))


@query(f"WITH {_seen_sql([], 'seen_s >= epoch(TIMESTAMP ' + chr(39) + '2024-01-03 06:30:00' + chr(39) + ') AND seen_s <= epoch(TIMESTAMP ' + chr(39) + '2024-01-20 12:00:00' + chr(39) + ')')} SELECT slug FROM seen")
def filter_time(spark, d):
    return _filtered(spark, d, MemoryFilter(since="2024-01-03T06:30:00", until="2024-01-20T12:00:00+00:00"))


_STOPS = ", ".join(f"'{w}'" for w in search.STOPWORDS)


@query(rf"""WITH {_PAGES}, w AS (SELECT slug, list_filter(string_split(trim(regexp_replace(title, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM pages_v),
b AS (SELECT slug, CASE WHEN len(list_filter(w, lambda x: NOT list_contains([{_STOPS}], lower(x)))) > 0 THEN list_filter(w, lambda x: NOT list_contains([{_STOPS}], lower(x))) ELSE w END AS w FROM w),
g AS (SELECT slug, flatten(list_transform(w, lambda x: CASE lower(x) WHEN 'thing' THEN [x, 'object', 'Item'] WHEN 'system' THEN [x, 'platform'] ELSE [x] END)) AS w FROM b),
l AS (SELECT slug, w, list_transform(w, lambda x: lower(x)) AS l FROM g)
SELECT slug, array_to_string(list_filter(w, lambda x, i: list_position(l, lower(x)) = i), ' ') AS query FROM l""")
def rewrite_queries(spark, d):
    return V.pages(spark, d).select("slug", search.rewritten(F.col("title"), {"thing": ["object", "Item"], "system": ["platform"]}).alias("query"))


# messages and blocks


@query()
def blocks_full(spark, d):
    """Blocks of every stream; each cut depends on the one before, so the test walks the messages instead of SQL."""
    return A.blocks(_tokens(spark, d))


@query()
def blocks_long(spark, d):
    """As `blocks_full`, a test holds them to be equal, but what lies between gaps, of any length, is cut by many tasks."""
    return A.blocks(_tokens(spark, d), long=True)


def _tokens(spark, d):
    return V.stream_messages(spark, d).withColumn("tokens", F.coalesce(F.round(T.token_estimate(F.col("content")), 1), F.lit(0.0)))


_NOISY = """noisy AS (SELECT doc_id, ['mail/in', 'docs/x', 'tasks', 'group/a', 'group/b', 'dm/c', 'calendar/y'][doc_id % 7 + 1] AS channel,
 [coalesce(text, ''), ['[红包] 恭喜', '撤回了一条消息', '我们决定采用', '😀 ☀️', 'Out of Office', '会议已取消', 'the Deadline is set', 'deadline', ''][doc_id % 9 + 1]] AS said,
 doc_id % 3 = 0 AS short FROM documents), blocks_v AS (SELECT doc_id, channel, CASE WHEN short THEN said[2:2] ELSE said END AS contents, array_to_string(CASE WHEN short THEN said[2:2] ELSE said END, ' ') AS t FROM noisy)"""


def _has(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


_EMOJI_ONLY = f"len(list_filter(contents, lambda c: NOT (regexp_replace(regexp_replace(c, '{rules.EMOJI}', '', 'g'), '\\s+', '', 'g') = '' AND regexp_replace(c, '\\s+', '', 'g') <> ''))) = 0"


@query(f"""WITH {_NOISY} SELECT doc_id, CASE
 WHEN starts_with(channel, 'mail/') THEN CASE WHEN regexp_matches(t, '{rules.MAIL_SKIPS}') THEN 'skip' WHEN {_has(rules.DECISION_WORDS)} THEN 'escalate' ELSE 'evaluate' END
 WHEN starts_with(channel, 'docs/') OR starts_with(channel, 'calendar/') OR channel = 'tasks' THEN 'evaluate'
 WHEN {_has(rules.SYSTEM_WORDS)} OR {_has(rules.RED_PACKETS)} OR {_EMOJI_ONLY} THEN 'skip'
 WHEN {_has(rules.DECISION_WORDS)} OR {_has(rules.TASK_WORDS)} THEN 'escalate' ELSE 'evaluate' END AS verdict FROM blocks_v""")
def noise_l1(spark, d):
    i = F.col("doc_id")
    at = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (i % n + 1).cast("int"))
    channel = at(("mail/in", "docs/x", "tasks", "group/a", "group/b", "dm/c", "calendar/y"), 7)
    more = at(("[红包] 恭喜", "撤回了一条消息", "我们决定采用", "😀 ☀️", "Out of Office", "会议已取消", "the Deadline is set", "deadline", ""), 9)
    contents = F.when(i % 3 == 0, F.array(more)).otherwise(F.array(F.col("text"), more))
    return V.table(spark, d, "documents").select("doc_id", rules.noise(channel, contents).alias("verdict"))


def _entity_sql(text: str) -> dict[str, str]:
    """List of the distinct values of each kind of entity. SQL's patterns have no look-behind: what may not stand before a handle is matched, not kept."""
    bare = f"regexp_replace({text}, '{M.ENTITIES['url']}', ' ', 'g')"
    out = {k: f"list_distinct(regexp_extract_all({bare if k == 'email' else text}, '{p}'))" for k, p in M.ENTITIES.items() if k != "handle"}
    out["handle"] = f"list_distinct(regexp_extract_all({text}, '(?:^|[^\\w.+-])(@[\\w.-]{{2,}})', 1))"
    return {k: out[k] for k in M.ENTITIES}


@query("WITH e AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, len({v}) AS n FROM documents WHERE text IS NOT NULL" for k, v in _entity_sql("text").items()) + ") SELECT doc_id, type, n FROM e WHERE n > 0")
def quick_entities(spark, d):
    x = V.table(spark, d, "documents").select("doc_id", F.inline(M.entities(F.col("text"))))
    return x.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))


_CANON = """canon_v AS (SELECT doc_id, coalesce(text, '') AS t, ['mail/in', 'docs/x', 'tasks', 'group/a', 'dm/c'][doc_id % 5 + 1] AS channel, doc_id % 2 = 0 AS sent, doc_id % 4 = 0 AS threaded FROM documents)"""
_ENTITIES = " + ".join(f"len({v})" for v in _entity_sql("t").values())


@query(rf"""WITH {_CANON}, a AS (SELECT doc_id, sent, threaded, CASE WHEN starts_with(channel, 'mail/') THEN 'email' WHEN starts_with(channel, 'dm/') THEN 'dm' WHEN starts_with(channel, 'docs/') THEN 'document' WHEN channel = 'tasks' THEN 'structured' ELSE 'chat' END AS kind,
 (1.5 * len(regexp_extract_all(t, '[一-鿿㐀-䶿぀-ヿ가-힯]')) + 1.3 * len(regexp_extract_all(regexp_replace(t, '[一-鿿㐀-䶿぀-ヿ가-힯]', ' ', 'g'), '[^\s]+')))::DOUBLE AS t, {_ENTITIES} AS e,
 list_concat(regexp_extract_all(t, '[一-鿿㐀-䶿]'), list_filter(list_transform(regexp_extract_all(t, '[^\s]+'), lambda x: lower(regexp_replace(x, '[一-鿿㐀-䶿]', '', 'g'))), lambda x: x <> '')) AS w FROM canon_v),
b AS (SELECT doc_id, kind, t, e, sent OR kind = 'dm' AS tagged, CASE WHEN NOT (sent OR kind = 'dm') THEN 0.5::DOUBLE
 ELSE least(1, (CASE WHEN sent THEN 0.6 ELSE 0 END + CASE WHEN kind = 'email' AND sent AND threaded THEN 0.5 ELSE 0 END + CASE WHEN kind = 'dm' THEN 0.6 ELSE 0 END)::DOUBLE) END AS i,
 CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w)::DOUBLE ELSE 0 END AS u,
 CASE kind WHEN 'email' THEN 0.9 WHEN 'document' THEN 0.9 WHEN 'structured' THEN 0.8 WHEN 'dm' THEN 0.7 ELSE 0.5 END::DOUBLE AS s FROM a),
c AS (SELECT *, (CASE WHEN t < 50 THEN t / 50 WHEN t <= 500 THEN 1 WHEN t <= 3000 THEN 1 - (t - 500) / 5000 ELSE 0.5::DOUBLE END
 + CASE WHEN u > 0.6::DOUBLE THEN 1 WHEN u <= 0 THEN 0 WHEN u < 0.2::DOUBLE THEN 0.1::DOUBLE ELSE (u - 0.2::DOUBLE) / 0.4::DOUBLE END
 + 1.5::DOUBLE * s + 3 * i + CASE WHEN t = 0 THEN 0 ELSE least(1, e / (t / 100)) END) / 7.5::DOUBLE AS score FROM b)
SELECT doc_id, round(score, 4)::DOUBLE AS score, CASE WHEN t < 20 AND e = 0 AND NOT tagged AND kind NOT IN ('email', 'document', 'structured') THEN 'drop' WHEN score <= 0.15::DOUBLE THEN 'drop'
 WHEN score >= 0.85::DOUBLE THEN 'admit' ELSE 'evaluate' END AS decision FROM c""")
def block_score(spark, d):
    i = F.col("doc_id")
    channel = F.element_at(F.array(*map(F.lit, ("mail/in", "docs/x", "tasks", "group/a", "dm/c"))), (i % 5 + 1).cast("int"))
    kind = M.source_type(channel, F.lit("chat"))
    x = V.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), kind.alias("kind"), (i % 2 == 0).alias("sent"), (i % 4 == 0).alias("threaded"))
    x = x.withColumn("tags", rules.interaction_tags(F.col("kind"), F.col("sent"), F.col("sent") & F.col("threaded")))
    x = x.withColumn("s", rules.block_score(F.col("t"), F.col("kind"), F.col("tags")))
    return x.select("doc_id", F.round("s.combined", 4).alias("score"), F.col("s.decision").alias("decision"))


# mail, links, people


_MAILS = r"""mails AS (SELECT doc_id, 'user-' || doc_id % 7 AS contact, (1704067200 + doc_id * 60)::VARCHAR AS sent, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'About ' || source || chr(10) || chr(10) END || coalesce(text, '') || chr(10)
 || CASE doc_id % 4 WHEN 0 THEN 'On some fine day, Ann wrote:' || chr(10) || 'old' WHEN 1 THEN '>>> deep' || chr(10) || '>>>> deeper' WHEN 2 THEN '--- Original Message ---' || chr(10) || 'x' ELSE 'click to Unsubscribe' || chr(10) || 'y' END AS c,
 CASE WHEN doc_id % 2 = 0 THEN ['ann@x.org', 'bob@x.org'] END AS "to" FROM documents),
parts AS (SELECT *, CASE WHEN instr(c, chr(10) || chr(10)) > 1 THEN left(c, instr(c, chr(10) || chr(10)) - 1) ELSE '' END AS subject,
 CASE WHEN instr(c, chr(10) || chr(10)) > 1 THEN substr(c, instr(c, chr(10) || chr(10)) + 2) ELSE c END AS b FROM mails)"""


def _body_sql(x: str) -> str:
    for p in M.MAIL_TAILS:
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    foot = " OR ".join(f"contains(lower(y), '{f}')" for f in M.FOOTERS)
    lines = f"string_split({x}, chr(10))"
    at = f"list_position(list_transform({lines}, lambda y: {foot}), true)"
    return f"regexp_replace(array_to_string(CASE WHEN {at} > 0 THEN ({lines})[1:{at} - 1] ELSE {lines} END, chr(10)), '\\s+$', '')"


@query(f"""WITH {_MAILS} SELECT doc_id, '---' || chr(10) || 'From: ' || contact || chr(10) || CASE WHEN subject <> '' THEN 'Subject: ' || subject || chr(10) ELSE '' END || 'Date: ' || sent || chr(10)
 || CASE WHEN "to" IS NOT NULL THEN 'To: ' || array_to_string("to", ', ') || chr(10) ELSE '' END || '---' || chr(10) || {_body_sql('b')} AS mail FROM parts""")
def canon_email(spark, d):
    i = F.col("doc_id")
    head = F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("About "), F.col("source"), F.lit("\n\n")))
    tail = F.when(i % 4 == 0, "On some fine day, Ann wrote:\nold").when(i % 4 == 1, ">>> deep\n>>>> deeper").when(i % 4 == 2, "--- Original Message ---\nx").otherwise("click to Unsubscribe\ny")
    content = F.concat(head, F.coalesce("text", F.lit("")), F.lit("\n"), tail)
    to = F.when(i % 2 == 0, F.array(F.lit("ann@x.org"), F.lit("bob@x.org")))
    at = (F.lit(1704067200) + i * 60).cast("string")
    mail = M.mail_text(F.concat(F.lit("user-"), (i % 7).cast("string")), at, content, to, F.lit(None).cast("array<string>"))
    return V.table(spark, d, "documents").select("doc_id", mail.alias("mail"))


_RELATIONS = ", ".join(f"'{r}'" for r in rules.RELATIONS)


@query(rf"""WITH {_PAGES}, w AS (SELECT slug, unnest(regexp_extract_all('see [[ part_of : ' || channel || ' ]] and [[' || type || ']] [[depends_on:' || tier || ']] [[odd rel:x]] [[uses: ]] [[ ]] ' || body, '\[\[([^\]]+)\]\]', 1)) AS l FROM pages_v),
p AS (SELECT slug, contains(l, ':') AS named, trim(split_part(l, ':', 1), E' \t\n\r\f\v') AS rel, trim(CASE WHEN contains(l, ':') THEN substr(l, instr(l, ':') + 1) ELSE l END, E' \t\n\r\f\v') AS target FROM w)
SELECT DISTINCT slug, CASE WHEN NOT named THEN 'mentions' WHEN rel IN ({_RELATIONS}) THEN rel ELSE 'custom' END AS rel, target FROM p WHERE target <> ''""")
def wikilinks(spark, d):
    body = F.concat(F.lit("see [[ part_of : "), "channel", F.lit(" ]] and [["), "type", F.lit("]] [[depends_on:"), "tier", F.lit("]] [[odd rel:x]] [[uses: ]] [[ ]] "), "body")
    return rules.wikilinks(V.pages(spark, d).select("slug", body.alias("body")))


_NAMES = """names AS (SELECT c_custkey, [' Ann O''Neil ', 'user (ou_AB' || c_custkey || ')', '用户 ou_x' || c_custkey, 'Jo-Ann  Li (ou_q1)', 'ou_Z' || c_custkey, '王建', '(x)', c_name, 'Feishu User ou_m' || c_custkey][c_custkey % 9 + 1] AS name FROM customer)"""


@query(rf"""WITH {_NAMES}, c AS (SELECT c_custkey, trim(name) AS n, lower(regexp_extract(trim(name), '\b(ou_[a-zA-Z0-9]+)\b', 1)) AS oid FROM names),
l AS (SELECT *, regexp_replace(regexp_replace(n, '(?i)[（(][^）)]*ou_[a-zA-Z0-9]+[^）)]*[）)]', '', 'g'), '(?i)\bou_[a-zA-Z0-9]+\b', '', 'g') AS label, trim(regexp_replace(n, '[（(][^）)]*[）)]', '', 'g')) AS bare FROM c)
SELECT c_custkey, 'person/' || CASE WHEN oid <> '' AND NOT regexp_matches(label, '[一-鿿]') AND trim(regexp_replace(lower(label), '[^a-z]+', ' ', 'g')) IN ('', 'user', 'feishu user') THEN oid
 WHEN regexp_matches(bare, '^ou_[a-zA-Z0-9]+$') THEN lower(bare) WHEN regexp_matches(bare, '^[a-zA-Z\s\-'']+$') THEN regexp_replace(replace(lower(bare), '''', '-'), '\s+', '-', 'g') END AS slug FROM l""")
def person_slugs(spark, d):
    k = F.col("c_custkey").cast("string")
    names = F.array(
        F.lit(" Ann O'Neil "), F.concat(F.lit("user (ou_AB"), k, F.lit(")")), F.concat(F.lit("用户 ou_x"), k), F.lit("Jo-Ann  Li (ou_q1)"), F.concat(F.lit("ou_Z"), k),
        F.lit("王建"), F.lit("(x)"), F.col("c_name"), F.concat(F.lit("Feishu User ou_m"), k),
    )
    name = F.element_at(names, (F.col("c_custkey") % 9 + 1).cast("int"))
    return V.table(spark, d, "customer").select("c_custkey", M.person_slug(name).alias("slug"))


# coverage, states, digests, plans


@query(f"""WITH {_TIMELINE} SELECT (floor(epoch(strptime(left(date, 10), '%Y-%m-%d')) / 604800) * 604800 * 1000)::BIGINT AS week_ms, count(*) AS entries FROM timeline_v
WHERE source = 'O' AND regexp_matches(date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') AND date >= '1996-08-02' GROUP BY 1""")
def coverage_weekly(spark, d):
    return A.coverage(V.timeline(spark, d), "O", 901843200)


_STATES = """s AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'discovered' WHEN 'view' THEN 'distilled' WHEN 'click' THEN 'applying' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'retrying' ELSE event_type END AS state FROM events),
t AS (SELECT state, lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM s),
a(was, state) AS (VALUES ('discovered','distilled'), ('discovered','retrying'), ('distilled','applying'), ('distilled','retrying'), ('applying','done'), ('applying','retrying'), ('retrying','distilled'), ('retrying','dead_letter'))"""


@query(f"WITH {_STATES} SELECT t.was, t.state, count(*) AS n, a.was IS NOT NULL AS allowed FROM t LEFT JOIN a USING (was, state) WHERE t.was IS NOT NULL GROUP BY t.was, t.state, a.was")
def state_transitions(spark, d):
    names = {"signup": "discovered", "view": "distilled", "click": "applying", "purchase": "done", "error": "retrying"}
    state = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("event_type")), F.col("event_type"))
    return rules.transitions(V.table(spark, d, "events").withColumn("state", state), "user_id", "event_id", "state")


_DIGEST = f"""digest AS (SELECT slug, title, ['project','decision','task','preference','person','reference'][doc_id % 6 + 1] AS type, created_s AS updated_s, CASE WHEN doc_id % 4 < 2 THEN 'open' WHEN doc_id % 4 = 2 THEN 'done' END AS status FROM pages_v),
k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY updated_s DESC, slug) AS k FROM digest),
f AS (SELECT * FROM k WHERE CASE type WHEN 'project' THEN k <= 5 AND updated_s >= {AS_OF_S} - 7 * 86400 WHEN 'decision' THEN k <= 5 AND updated_s >= {AS_OF_S} - 7 * 86400
 WHEN 'task' THEN k <= 50 AND status = 'open' WHEN 'preference' THEN k <= 10 WHEN 'person' THEN k <= 5 ELSE false END),
p AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY k) AS place FROM f)"""


@query(f"WITH {_PAGES}, {_DIGEST} SELECT type AS section, place::INTEGER AS place, slug, title FROM p WHERE place <= CASE type WHEN 'decision' THEN 3 WHEN 'preference' THEN 3 ELSE 5 END")
def session_context(spark, d):
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("project", "decision", "task", "preference", "person", "reference"))), (i % 6 + 1).cast("int"))
    status = F.when(i % 4 < 2, "open").when(i % 4 == 2, "done")
    p = V.pages(spark, d).select("slug", "title", kind.alias("type"), F.col("created_s").alias("updated_s"), status.alias("status"))
    return rules.session_context(p, AS_OF_S)


_PLAN = f"""plan AS (SELECT contribution_id, signal_type, authority, what, CASE WHEN authority = 'assistant_proposed' THEN false WHEN authority = 'user_confirmed' THEN true ELSE signal_type NOT IN ('decision', 'preference') END AS ok,
 ['UPDATE','NOOP','NEW','SUPERSEDE','LINK_EXISTING'][contribution_id % 5 + 1] AS decided, page AS target, [page, 'knowledge/doc-1'] AS a, ['knowledge/doc-' || contribution_id % 40] AS b, contribution_id % 2 = 0 AS wide FROM contrib_v)"""


@query(f"""WITH {_CONTRIB}, {_PLAN}, x AS (SELECT contribution_id, ok, decided, target, decided IN ('UPDATE', 'SUPERSEDE', 'LINK_EXISTING') AS bound, list_contains(CASE WHEN wide THEN a ELSE b END, target) AS inside FROM plan)
SELECT contribution_id, CASE WHEN NOT ok THEN 'NOOP' WHEN bound AND NOT inside THEN 'NEW' ELSE decided END AS action, CASE WHEN ok AND bound AND inside THEN target END AS target,
 CASE WHEN NOT ok THEN 'not admitted' WHEN bound AND NOT inside THEN 'target not in pool' ELSE 'decided' END AS reason FROM x""")
def plan_actions(spark, d):
    i = F.col("contribution_id")
    decided = F.element_at(F.array(*map(F.lit, ("UPDATE", "NOOP", "NEW", "SUPERSEDE", "LINK_EXISTING"))), (i % 5 + 1).cast("int"))
    pool = F.when(i % 2 == 0, F.array("page", F.lit("knowledge/doc-1"))).otherwise(F.array(F.concat(F.lit("knowledge/doc-"), (i % 40).cast("string"))))
    ok = M.admissibility(F.col("signal_type"), F.col("authority")) == "canonical"
    x = V.contributions(spark, d).select("contribution_id", rules.planned_action(ok, decided, F.col("page"), pool).alias("p"))
    return x.select("contribution_id", "p.*")


_READ = """rd(text, reading) AS (VALUES ('王', 'wang'), ('建', 'jian'), ('都', 'dou'), ('李', 'li'), ('明', 'ming'), ('单', 'dan'), ('单于', 'chan yu'), ('于', 'yu'), ('欧阳', 'ou yang'), ('重庆', 'chong qing'), ('重', 'zhong')),
nm AS (SELECT c_custkey, ['王建都', ' 李明 (x)', '单于明', '单明', '欧阳 A' || c_custkey, '欧明', '重庆明', '重', '王 B李', c_name][c_custkey % 10 + 1] AS name FROM customer),
bn AS (SELECT DISTINCT name, trim(regexp_replace(trim(name), '[（(][^）)]*[）)]', '', 'g')) AS t FROM nm),
hit AS (SELECT name, i, max(length(text)) AS n FROM (SELECT name, t, unnest(range(1, length(t) + 1)) AS i FROM bn) JOIN rd ON starts_with(substr(t, i), text) GROUP BY name, i),
fold AS (SELECT name, t, 1::BIGINT AS at_, ''::VARCHAR AS said, false AS bad FROM bn UNION ALL
  SELECT f.name, f.t, f.at_ + coalesce(h.n, 1), f.said || CASE WHEN h.n IS NOT NULL THEN ' ' || (SELECT reading FROM rd WHERE rd.text = substr(f.t, f.at_, h.n)) WHEN substr(f.t, f.at_, 1) = ' ' THEN '' ELSE ' ' || lower(substr(f.t, f.at_, 1)) END,
    f.bad OR (h.n IS NULL AND regexp_matches(substr(f.t, f.at_, 1), '[一-鿿]')) FROM fold f LEFT JOIN hit h ON h.name = f.name AND h.i = f.at_ WHERE f.at_ <= length(f.t)),
sl AS (SELECT name, CASE WHEN bad THEN NULL WHEN NOT regexp_matches(t, '[一-鿿]') THEN NULL ELSE 'person/' || regexp_replace(trim(said), ' ', '-') END AS s0 FROM fold WHERE at_ > length(t)),
slugs AS (SELECT name, split_part(s0, '-', 1) || CASE WHEN contains(s0, '-') THEN '-' || replace(split_part(s0, '-', 2), ' ', '') ELSE '' END AS slug FROM sl)"""


def _cjk_names(spark, d):
    k = F.col("c_custkey")
    names = F.array(*map(F.lit, ("王建都", " 李明 (x)", "单于明", "单明")), F.concat(F.lit("欧阳 A"), k.cast("string")), *map(F.lit, ("欧明", "重庆明", "重", "王 B李")), F.col("c_name"))
    return V.table(spark, d, "customer").select(k, F.element_at(names, (k % 10 + 1).cast("int")).alias("name"))


@query(f"WITH RECURSIVE {_READ} SELECT c_custkey, name, slug FROM nm LEFT JOIN slugs USING (name)")
def person_readings(spark, d):
    from engramlake.operators import readings as N

    x = _cjk_names(spark, d)
    return x.join(N.person_slugs(x, V.readings(spark, d)), "name", "left").select("c_custkey", "name", "slug")


@query(f"""WITH RECURSIVE {_READ}, o AS (SELECT 'm/' || c_custkey AS slug, name, slugs.slug AS own FROM nm LEFT JOIN slugs USING (name))
SELECT slug, name, CASE WHEN own IS NULL OR own = 'person/li-ming' THEN slug ELSE own END AS canonical, CASE WHEN own IS NULL THEN 'kept' WHEN own = 'person/li-ming' THEN 'collision' ELSE 'canonical' END AS step FROM o""")
def identity_readings(spark, d):
    from engramlake.operators import identity as I

    names = _cjk_names(spark, d).select(F.concat(F.lit("m/"), F.col("c_custkey").cast("string")).alias("slug"), "name")
    handles = spark.createDataFrame([], "value string, slug string")
    cache = spark.createDataFrame([("x/1", "person/li-ming", "Li Ming")], "external_id string, display_name string, slug_hint string")
    return I.ladder(names, handles, cache, V.readings(spark, d))


@query(f"WITH {_PAGES}, s AS (SELECT slug, type, created_s, round(greatest({_similarity('title', chr(39) + 'heit ung' + chr(39))}, {_similarity('body', chr(39) + 'heit ung' + chr(39))}), 6) AS score FROM pages_v"
       " WHERE contains(lower(title), 'heit') AND contains(lower(title), 'ung') OR contains(lower(body), 'heit') AND contains(lower(body), 'ung')) SELECT slug, type, score FROM s ORDER BY score DESC, created_s DESC, slug LIMIT 20")
def search_indexed(spark, d):
    from engramlake.operators import postings as X
    from engramlake.operators import retrieval as R
    from engramlake.operators.steps import shared_path

    pages, path = V.pages(spark, d), shared_path(spark, "postings")
    X.build(pages, path)
    return R.search_pages(X.having(pages, path, ["heit", "ung"]), "heit ung")


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0 LIMIT 1), s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM embeddings, q)
SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 10""")
def vector_lists(spark, d):
    """All lists of an inverted file are read, so the result is exact; a test measures the recall of fewer."""
    from engramlake.operators import vectors as X
    from engramlake.operators.steps import shared_path

    vectors, path = V.table(spark, d, "embeddings"), shared_path(spark, "vectors")
    X.build(vectors, path)
    return X.probed(spark, path, _query_vector(spark, d), probes=X.LISTS)
