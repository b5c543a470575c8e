"""Queries over signals that are written to the store: what each of its tables gets, and what became of each signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake import views as V
from engramlake.operators import store as S
from engramlake.queries import _CONTRIB
from engramlake.registry import query

_KEBAB = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"


def _slug(x: str) -> str:
    kebab, mark = _KEBAB.format(x=x), f"left(sha256({x}), 12)"
    return f"CASE WHEN length({kebab}) >= 3 THEN {kebab} WHEN {kebab} = '' THEN {mark} ELSE {kebab} || '-' || {mark} END"


_SIGNALS = f"""{_CONTRIB}, sig0 AS (SELECT contribution_id AS i, authority, created_s, ['entity','decision','task','discovery','knowledge','preference','reference','timeline','link'][contribution_id % 9 + 1] AS kind FROM contrib_v),
sig1 AS (SELECT i AS seq, kind, CASE WHEN kind = 'entity' THEN 'Name ' || i % 23 WHEN kind = 'timeline' THEN 'Entry ' || i % 40 WHEN kind = 'link' THEN NULL
    WHEN i % 10 = 3 THEN '计划' || i % 4 WHEN i % 10 = 5 THEN '计划' ELSE 'Plan A' || i % 40 END AS title,
  CASE WHEN i % 4 <> 1 THEN 'because ' || i END AS detail,
  CASE kind WHEN 'entity' THEN CASE WHEN i % 4 = 0 THEN 'project' ELSE 'person' END WHEN 'task' THEN CASE WHEN i % 2 = 0 THEN 'done' ELSE 'open' END
    WHEN 'discovery' THEN CASE WHEN i % 2 = 0 THEN 'risk' ELSE 'insight' END WHEN 'knowledge' THEN 'topic' || i % 3 WHEN 'preference' THEN CASE WHEN i % 2 = 0 THEN 'style' ELSE 'tool' END
    WHEN 'reference' THEN 'https://x.example/' || i % 40 WHEN 'link' THEN CASE WHEN i % 2 = 0 THEN 'part_of' ELSE 'owns' END END AS facet,
  i % 3 = 0 AS speculative, ['people/p' || i % 23, 'people/p' || i * 7 % 31, 'decisions/plan-a' || i % 40] AS ends,
  CASE WHEN i % 5 <> 0 THEN ['A' || i % 3, 'B' || i % 4] ELSE [] END AS aliases, strftime(to_timestamp(created_s) AT TIME ZONE 'UTC', '%Y-%m-%d') AS date,
  CASE WHEN i % 8 <> 0 THEN authority END AS platform, 'h' || i // 300 AS source_hash FROM sig0),
sig AS (SELECT *, CASE WHEN kind = 'link' THEN ends[:2] WHEN seq % 6 <> 5 THEN ends ELSE [] END AS entities,
  CASE kind WHEN 'entity' THEN 'people/p' || seq % 23 WHEN 'knowledge' THEN 'knowledge/' || facet || '/' || left(sha256(title), 12) WHEN 'decision' THEN 'decisions/' || {_slug("title")} WHEN 'task' THEN 'tasks/' || {_slug("title")}
    WHEN 'discovery' THEN 'discoveries/' || {_slug("title")} WHEN 'preference' THEN 'preferences/' || {_slug("title")} WHEN 'reference' THEN 'references/' || {_slug("title")} END AS page FROM sig1),
had AS (SELECT page, CASE WHEN seq % 2 = 0 THEN source_hash ELSE 'old' END AS was, seq % 14 = 0 AS edited, CASE WHEN seq % 3 = 0 THEN 'before' END AS seen
  FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY seq) AS n FROM sig WHERE seq % 7 = 0 AND page IS NOT NULL) WHERE n = 1),
st0 AS (SELECT s.*, h.page IS NOT NULL AS old, h.was, h.edited, h.seen, kind = 'knowledge' AND speculative AS vague FROM sig s LEFT JOIN had h USING (page) WHERE page IS NOT NULL),
st1 AS (SELECT *, row_number() OVER o AS n, lag(source_hash) OVER o AS before FROM st0 WINDOW o AS (PARTITION BY page, vague ORDER BY seq)),
st AS (SELECT *, CASE WHEN vague THEN 'speculative' WHEN edited AND kind NOT IN ('preference', 'reference') THEN 'skip'
  WHEN CASE WHEN n = 1 THEN old AND was = source_hash ELSE before = source_hash END THEN 'skip' ELSE 'write' END AS step FROM st1),
wrote AS (SELECT * FROM st WHERE step = 'write'),
born AS (SELECT page, min(seq) AS born FROM (SELECT page, -1 AS seq FROM had UNION ALL SELECT page, seq FROM wrote) GROUP BY page),
aim0 AS (SELECT seq, kind, page, title, detail, facet, date, platform, source_hash, unnest(entities) AS target, generate_subscripts(entities, 1) AS place
  FROM (SELECT seq, kind, page, title, detail, facet, date, platform, source_hash, entities FROM wrote WHERE kind IN ('decision', 'discovery', 'knowledge', 'preference', 'reference')
        UNION ALL SELECT seq, kind, NULL, title, detail, facet, date, platform, source_hash, entities FROM sig WHERE kind IN ('timeline', 'link'))),
aim AS (SELECT a.*, coalesce(b.born <= a.seq, false) AS there, min(CASE WHEN NOT coalesce(b.born <= a.seq, false) THEN place END) OVER (PARTITION BY seq) AS gap FROM aim0 a LEFT JOIN born b ON b.page = a.target)"""


def _stored(spark, d) -> dict:
    pages = V.stored_pages(spark, d)
    links = pages.select(F.col("slug").alias("src"), F.lit("people/p1").alias("dst"), F.lit("mentions").alias("link_type"), F.lit("early").alias("provenance"), F.lit("h-").alias("source_hash"))
    entries = pages.select("slug", F.lit("2024-01-01").alias("date"), F.lit("Decision: Plan A1").alias("summary"), F.lit("early").alias("provenance"))
    return S.store(V.typed_signals(spark, d), pages, links, entries)


_PAGES = f"""WITH {_SIGNALS},
l AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY seq DESC) AS back, first_value(coalesce(platform || ':', '') || source_hash) OVER (PARTITION BY page ORDER BY seq) AS first,
  sum(CASE WHEN kind = 'entity' AND facet = 'person' AND len(aliases) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page, facet = 'person' ORDER BY seq DESC) AS cut,
  min(len(aliases)) OVER (PARTITION BY page, facet = 'person') AS least FROM wrote),
al AS (SELECT page, name, min(spot) AS spot FROM (
    SELECT page, unnest(aliases) AS name, seq * 10 + generate_subscripts(aliases, 1) AS spot FROM l WHERE kind = 'entity' AND facet = 'person' AND cut = 0
    UNION ALL SELECT page, unnest(['Old', 'A1']), generate_subscripts(['Old', 'A1'], 1) - 100 FROM l WHERE kind = 'entity' AND facet = 'person' AND least > 0 AND old) GROUP BY page, name),
an AS (SELECT page, string_agg('- ' || name, chr(10) ORDER BY spot) AS names FROM al GROUP BY page),
made AS (SELECT page AS slug, CASE kind WHEN 'entity' THEN facet WHEN 'discovery' THEN 'discovery-' || facet ELSE kind END AS type, CASE WHEN kind = 'knowledge' THEN left(title, 80) ELSE title END AS title,
  CASE kind WHEN 'entity' THEN CASE WHEN facet = 'person' AND len(aliases) > 0 THEN '## Aliases' || repeat(chr(10), 2) || names || repeat(chr(10), 2) ELSE '' END || '## Context' || repeat(chr(10), 2) || coalesce(detail, '')
    WHEN 'decision' THEN '# ' || title || CASE WHEN detail <> '' THEN repeat(chr(10), 2) || '## Reasoning' || repeat(chr(10), 2) || detail ELSE '' END || CASE WHEN seq % 3 = 0 THEN repeat(chr(10), 2) || '## Alternatives' || repeat(chr(10), 2) || '- x' || chr(10) || '- y' ELSE '' END
    WHEN 'task' THEN '# ' || title
    WHEN 'knowledge' THEN '# ' || title || repeat(chr(10), 2) || '## Related Entities' || repeat(chr(10), 2) || CASE WHEN len(entities) > 0 THEN '- ' || array_to_string(entities, chr(10) || '- ') ELSE '- (none)' END
    WHEN 'reference' THEN '# ' || title || repeat(chr(10), 2) || 'URL: ' || facet || repeat(chr(10), 2) || '## Summary' || repeat(chr(10), 2) || coalesce(detail, '')
    ELSE '# ' || title || CASE WHEN detail <> '' THEN repeat(chr(10), 2) || '## Detail' || repeat(chr(10), 2) || detail ELSE '' END END AS body,
  source_hash, CASE WHEN kind = 'entity' THEN coalesce(seen, first) END AS first_seen, CASE kind WHEN 'entity' THEN NULL WHEN 'reference' THEN NULL WHEN 'knowledge' THEN 365 ELSE 90 END::INTEGER AS halflife_days,
  kind = 'task' AND facet = 'done' AS expires_now FROM l LEFT JOIN an USING (page) WHERE back = 1)"""


@query(f"{_PAGES} SELECT * FROM made")
def store_pages(spark, d):
    return _stored(spark, d)["pages"]


@query(rf"""{_PAGES}, w AS (SELECT slug, list_filter(regexp_split_to_array(body, '\s+'), lambda x: x <> '') AS w FROM made)
SELECT slug, i::INTEGER AS chunk_index, array_to_string(w[i * 250 + 1:i * 250 + 300], ' ') AS chunk_text, len(w[i * 250 + 1:i * 250 + 300])::INTEGER AS token_count
FROM (SELECT slug, w, unnest(range(0, CASE WHEN len(w) <= 300 THEN 1 ELSE 1 + ceil((len(w) - 300) / 250.0)::BIGINT END)) AS i FROM w)""")
def store_chunks(spark, d):
    return _stored(spark, d)["chunks"]


@query(f"WITH {_SIGNALS} SELECT DISTINCT page AS slug, unnest(CASE WHEN kind IN ('discovery', 'knowledge', 'preference') THEN [kind, facet] ELSE [kind] END) AS tag FROM wrote")
def store_tags(spark, d):
    return _stored(spark, d)["tags"]


@query(f"""WITH {_SIGNALS}, x AS (SELECT page AS src, target AS dst, 'mentions' AS link_type, 'Referenced in ' || kind AS context, platform, source_hash, seq * 10 + place AS o FROM aim WHERE kind NOT IN ('timeline', 'link') AND (gap IS NULL OR place < gap)
  UNION ALL SELECT min_by(target, place), max_by(target, place), any_value(facet), coalesce(any_value(detail), ''), any_value(platform), any_value(source_hash), seq * 10 FROM aim WHERE kind = 'link' AND gap IS NULL GROUP BY seq)
SELECT src, dst, link_type, arg_max(context, o) AS context, coalesce(arg_max(platform, o) FILTER (platform IS NOT NULL), CASE WHEN dst = 'people/p1' AND link_type = 'mentions' AND src IN (SELECT page FROM had) THEN 'early' END) AS provenance,
  arg_max(source_hash, o) AS source_hash FROM x GROUP BY src, dst, link_type""")
def store_links(spark, d):
    return _stored(spark, d)["links"]


@query(f"""WITH {_SIGNALS}, x AS (SELECT target AS slug, date, CASE WHEN kind = 'decision' THEN 'Decision: ' || title ELSE title END AS summary, CASE WHEN kind = 'decision' THEN coalesce(detail, '') ELSE '' END AS detail,
  coalesce(platform, '') AS source, coalesce(platform || ':', '') || source_hash AS provenance, seq * 10 + place AS o FROM aim WHERE kind = 'timeline' AND there OR kind = 'decision' AND gap IS NULL)
SELECT slug, date, summary, arg_max(detail, o) AS detail, arg_max(source, o) AS source, arg_max(provenance, o) AS provenance FROM x GROUP BY slug, date, summary""")
def store_entries(spark, d):
    return _stored(spark, d)["entries"]


@query(f"""WITH {_SIGNALS}, e AS (SELECT seq, any_value(kind) AS kind, count(*) FILTER (there) AS yes, count(*) FILTER (NOT there) AS nay, max(gap) AS gap FROM aim GROUP BY seq)
SELECT s.seq, s.kind, CASE WHEN st.step <> 'write' THEN 0 WHEN s.kind = 'timeline' THEN coalesce(e.yes, 0) WHEN e.seq IS NULL THEN CASE WHEN s.kind = 'link' THEN 0 ELSE 1 END WHEN e.gap IS NULL THEN 1 ELSE 0 END::BIGINT AS written,
  CASE WHEN st.step <> 'write' THEN 1 ELSE 0 END::BIGINT AS skipped, CASE WHEN st.step <> 'write' THEN 0 WHEN s.kind = 'timeline' THEN coalesce(e.nay, 0) WHEN e.gap IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS failed
FROM sig s LEFT JOIN st USING (seq) LEFT JOIN e USING (seq)""")
def store_outcome(spark, d):
    return _stored(spark, d)["outcome"]
