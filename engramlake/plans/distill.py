"""Queries over distilling by segments, rollback, redaction and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake import views as V
from engramlake.functions import privacy as Y
from engramlake.functions import text as T
from engramlake.operators import distill as D
from engramlake.operators import similar as R
from engramlake.operators import undo as U
from engramlake.queries import _CONTRIB, _similarity
from engramlake.registry import query

# segments


def _model(text: str, carry: str) -> dict:
    """A stand-in for a model: the topic is the first word's head, every other segment takes back the topic that was handed on."""
    head = text.split(": ", 1)[1][:2].lower()
    turned = [{"topic": carry.split(">")[0], "reason": "later"}] if carry and len(text) % 3 == 0 else []
    return {"summary": text[:20], "signals": [{"type": "knowledge", "topic": head, "what": f"{text[-12:]}|{carry}"}], "overturned": turned, "carry": f"{head}>{carry}"[:30]}


_FOLD = r"""m AS (SELECT 'conv-' || conv_id AS session, turn // 3 AS segment, string_agg('[' || turn || CASE WHEN turn % 5 = 4 THEN ' (continued)' ELSE '' END || '] ' || coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1, 2),
o AS (SELECT *, lower(substr(t, position(': ' IN t) + 2, 2)) AS head, row_number() OVER (PARTITION BY session ORDER BY segment) AS n FROM m),
f AS (SELECT session, segment, n, t, head, '' AS was, left(head || '>', 30) AS carry FROM o WHERE n = 1
      UNION ALL SELECT o.session, o.segment, o.n, o.t, o.head, f.carry, left(o.head || '>' || f.carry, 30) FROM f JOIN o ON o.session = f.session AND o.n = f.n + 1),
s AS (SELECT session, segment, left(t, 20) AS summary, head, right(t, 12) || '|' || was AS what, CASE WHEN was <> '' AND length(t) % 3 = 0 THEN split_part(was, '>', 1) END AS turned, carry FROM f)"""


def _summaries(spark, d):
    c, turn = V.table(spark, d, "conversations"), F.col("turn")
    line = D.rendered(turn, F.col("role"), F.col("text"), turn % 5 == 4)
    session = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))
    return D.folded(c.select(session.alias("session"), F.floor(turn / 3).alias("segment"), turn.alias("msg"), line.alias("line")), _model)


@query(f"WITH RECURSIVE {_FOLD} SELECT session, segment, summary, head AS topic, what, turned, carry FROM s")
def fold_segments(spark, d):
    s = F.col("signals")[0]
    return _summaries(spark, d).select("session", "segment", "summary", s["topic"].alias("topic"), s["what"].alias("what"), F.get("overturned", F.lit(0))["topic"].alias("turned"), "carry")


@query(f"""WITH RECURSIVE {_FOLD}, x AS (SELECT *, row_number() OVER (PARTITION BY session, head ORDER BY segment DESC) AS back FROM s)
SELECT session, 'knowledge' AS type, head AS topic, what, segment FROM x WHERE back = 1 AND NOT EXISTS (SELECT 1 FROM s WHERE s.session = x.session AND s.turned = x.head)""")
def reduce_segments(spark, d):
    return D.reduced(_summaries(spark, d), F.lower)


# rollback

_JOURNAL = f"""{_CONTRIB}, c AS (SELECT contribution_id, contribution_id * 7 % 61 AS attempt, CASE WHEN contribution_id % 37 <> 0 THEN 'page-' || contribution_id % 53 END AS page, active FROM contrib_v),
j AS (SELECT contribution_id AS seq, contribution_id * 7 % 61 AS attempt, 'row-' || contribution_id % 41 AS "row", CASE WHEN contribution_id % 4 <> 0 THEN 'v' || contribution_id END AS before FROM contrib_v),
want AS (SELECT DISTINCT attempt FROM c WHERE attempt % 3 = 1 OR attempt >= 55),
mine AS (SELECT DISTINCT attempt, page FROM c JOIN want USING (attempt) WHERE page IS NOT NULL),
held AS (SELECT DISTINCT m.attempt FROM mine m JOIN c ON c.page = m.page AND c.active AND c.attempt > m.attempt WHERE c.attempt NOT IN (SELECT attempt FROM want)
         UNION SELECT m.attempt FROM held h JOIN c ON c.attempt = h.attempt AND c.active JOIN mine m ON m.page = c.page AND m.attempt < h.attempt),
st AS (SELECT attempt, attempt IN (SELECT attempt FROM held) AS refused FROM want), gone AS (SELECT attempt FROM st WHERE NOT refused)"""


def _rolled(spark, d):
    c = V.contributions(spark, d)
    i = F.col("contribution_id")
    attempt = (i * 7 % 61).alias("attempt")
    text = lambda p, k: F.concat(F.lit(p), k.cast("string"))
    contribs = c.select(i, attempt, F.when(i % 37 != 0, text("page-", i % 53)).alias("page"), "active")
    journal = c.select(i.alias("seq"), attempt, text("row-", i % 41).alias("row"), F.when(i % 4 != 0, text("v", i)).alias("before"))
    return U.rolled_back(contribs, journal, contribs.filter("attempt % 3 = 1 OR attempt >= 55"))


@query(f"WITH RECURSIVE {_JOURNAL} SELECT attempt, CASE WHEN refused THEN 'refused' ELSE 'undone' END AS status, CASE WHEN refused THEN 0 ELSE (SELECT count(*) FROM c WHERE c.attempt = st.attempt AND c.active) END::BIGINT AS deactivated FROM st")
def rollback_attempts(spark, d):
    return _rolled(spark, d)["attempts"]


@query(f"""WITH RECURSIVE {_JOURNAL}, r AS (SELECT "row", max(seq) FILTER (attempt NOT IN (SELECT attempt FROM gone)) AS since FROM j GROUP BY "row"),
x AS (SELECT j.*, since IS NULL OR seq > since AS free FROM j JOIN r USING ("row") WHERE attempt IN (SELECT attempt FROM gone))
SELECT "row", (SELECT y.before FROM x y WHERE y."row" = x."row" AND y.free ORDER BY y.seq LIMIT 1) AS value, count(*) FILTER (free) AS undone, count(*) FILTER (NOT free) AS refused FROM x GROUP BY "row" """)
def rollback_rows(spark, d):
    return _rolled(spark, d)["rows"]


@query(f"""WITH RECURSIVE {_JOURNAL} SELECT page, count(*) FILTER (active AND attempt NOT IN (SELECT attempt FROM gone)) AS active, count(*) FILTER (active AND attempt NOT IN (SELECT attempt FROM gone)) = 0 AS orphaned
FROM c WHERE page IN (SELECT page FROM c WHERE attempt IN (SELECT attempt FROM gone)) GROUP BY page""")
def rollback_pages(spark, d):
    return _rolled(spark, d)["pages"]


# redaction

#: Words that are blocked besides personal data; one of them stands in a mark.
_BLOCKED = ("phone", "the", "für")


def _passes() -> str:
    """SQL of the passes one after the other: t, the text before each, and its records."""
    out, parts = [], []
    for k, (kind, pattern, mark) in enumerate(Y.patterns(_BLOCKED)):
        before = "SELECT doc_id, text AS t FROM documents" if k == 0 else f"SELECT doc_id, left_ AS t FROM p{k - 1}"
        pattern = pattern.replace(Y.EDGE, r"\b").replace("(?iu)", "(?i)")
        cut = f"regexp_split_to_array(t, '{pattern}')"
        out.append(f"p{k} AS (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS found, {cut} AS rest, array_to_string({cut}, '{mark}') AS left_ FROM ({before}))")
        sizes = lambda xs, n: f"coalesce(list_sum(list_transform({xs}[:{n}], lambda y: length(y))), 0)"
        parts.append(f"""SELECT doc_id, {k} AS pass, '{kind}' AS kind, found[i] AS original, '{mark}' AS replacement, ({sizes('rest', 'i')} + {sizes('found', 'i - 1')})::INTEGER AS position, ({sizes('rest', 'i')} + (i - 1) * {len(mark)})::INTEGER AS at_
          FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM p{k})""")
    return ", ".join(out) + ", records AS (" + " UNION ALL ".join(parts) + ")"


def _redacted(spark, d):
    return V.table(spark, d, "documents").select("doc_id", Y.redacted(F.col("text"), "text", _BLOCKED).alias("r")).select("doc_id", "r.*")


@query(f"WITH {_passes()} SELECT doc_id, 'text' AS field, pass::INTEGER AS pass, kind, original, replacement, position, at_ FROM records")
def redaction_records(spark, d):
    return _redacted(spark, d).select("doc_id", F.explode("records").alias("r")).select("doc_id", "r.field", "r.pass", "r.kind", "r.original", "r.replacement", "r.position", F.col("r.at").alias("at_"))


@query(f"WITH {_passes()} SELECT doc_id, left_ AS text FROM p{len(Y.patterns(_BLOCKED)) - 1}")
def redacted_texts(spark, d):
    return _redacted(spark, d).select("doc_id", "text")


@query("SELECT doc_id, text FROM documents")
def redaction_restored(spark, d):
    return _redacted(spark, d).select("doc_id", Y.restored(F.col("text"), F.col("records"), len(Y.patterns(_BLOCKED))).alias("text"))


# matching

_MATCH = f"""x AS (SELECT l.doc_id AS id, 's' || l.doc_id % 3 AS session, ['decision','task','knowledge'][l.doc_id % 7 % 3 + 1] AS type, coalesce(left(split_part(d.text, chr(10), 1), 24), '') AS what, quality, toxic FROM labels l JOIN documents d USING (doc_id)),
p AS (SELECT DISTINCT o.what AS a, g.what AS b FROM x o JOIN x g USING (session, type) WHERE o.toxic = 0 AND g.quality = 1),
e AS (SELECT a, b FROM p WHERE a = b OR {_similarity('a', 'b')} >= 0.25::DOUBLE)"""


@query(f"""WITH RECURSIVE {_MATCH}, o AS (SELECT id, session, type, what, row_number() OVER (ORDER BY id) AS n FROM x WHERE toxic = 0),
c AS (SELECT o.n, o.id, list(g.id ORDER BY g.id) FILTER (e.a IS NOT NULL) AS may FROM o LEFT JOIN x g ON g.session = o.session AND g.type = o.type AND g.quality = 1 LEFT JOIN e ON e.a = o.what AND e.b = g.what GROUP BY o.n, o.id),
w AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS id, NULL::BIGINT AS got, []::BIGINT[] AS taken
      UNION ALL SELECT n, id, got, CASE WHEN got IS NULL THEN taken ELSE list_append(taken, got) END FROM (SELECT c.n, c.id, list_filter(coalesce(c.may, []), lambda y: NOT list_contains(w.taken, y))[1] AS got, w.taken FROM w JOIN c ON c.n = w.n + 1))
SELECT id AS output_id, got AS golden_id, CASE WHEN got IS NULL THEN 'extra' ELSE 'matched' END AS kind FROM w WHERE n > 0
UNION ALL SELECT NULL, id, 'missed' FROM x WHERE quality = 1 AND id NOT IN (SELECT got FROM w WHERE got IS NOT NULL)""")
def eval_match_similar(spark, d):
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("decision", "task", "knowledge"))), (i % 7 % 3 + 1).cast("int"))
    what = F.coalesce(F.substring(F.substring_index("text", "\n", 1), 1, 24), F.lit("")).alias("text")
    x = V.table(spark, d, "labels").join(V.table(spark, d, "documents").select("doc_id", what), "doc_id")
    x = x.select(i.alias("id"), F.concat(F.lit("s"), (i % 3).cast("string")).alias("session"), kind.alias("type"), "text", "quality", "toxic")
    return R.matched(x.filter("toxic = 0"), x.filter("quality = 1"), ["session", "type"], 0.25)
