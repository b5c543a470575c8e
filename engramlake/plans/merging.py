"""Queries over merged pages and rebuilt derivatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake import views as V
from engramlake.operators import merging as M
from engramlake.queries import _CONTRIB, _PAGES
from engramlake.registry import query

# merges: of every sixth customer page into an earlier one, some of which moves itself, and some moves that can't be made

_MOVED = """pg AS (SELECT 'customer/' || c_custkey AS slug, CASE WHEN c_custkey % 5 = 0 THEN ' ' WHEN c_custkey % 5 = 1 THEN NULL ELSE c_mktsegment || chr(10) END AS body, CASE WHEN c_custkey % 4 <> 0 THEN [c_name, 'alias ' || c_custkey % 9] END AS aliases FROM customer),
mv AS (SELECT 'customer/' || c_custkey AS was, 'customer/' || CASE WHEN c_custkey % 30 = 0 THEN c_custkey WHEN c_custkey % 30 = 6 THEN -1 ELSE c_custkey - c_custkey % 24 + 1 END AS now FROM customer WHERE c_custkey % 6 = 0
  UNION ALL SELECT 'customer/1', 'customer/2' UNION ALL SELECT 'customer/3', 'customer/4' UNION ALL SELECT 'customer/4', 'customer/3'),
ok0 AS (SELECT was, min(now) AS now FROM mv WHERE was <> now AND was IN (SELECT slug FROM pg) AND now IN (SELECT slug FROM pg) GROUP BY was),
walk AS (SELECT was, now, 1 AS n FROM ok0 UNION ALL SELECT w.was, o.now, w.n + 1 FROM walk w JOIN ok0 o ON o.was = w.now WHERE w.n < 20),
moves AS (SELECT was, arg_max(now, n) AS now FROM walk GROUP BY was HAVING max(n) < 20)"""


def _merged(spark, d):
    c, k = V.table(spark, d, "customer"), F.col("c_custkey")
    slug = lambda x: F.concat(F.lit("customer/"), x.cast("string"))
    body = F.when(k % 5 == 0, " ").when(k % 5 == 1, F.lit(None)).otherwise(F.concat("c_mktsegment", F.lit("\n")))
    pages = c.select(slug(k).alias("slug"), body.alias("body"), F.when(k % 4 != 0, F.array("c_name", F.concat(F.lit("alias "), (k % 9).cast("string")))).alias("aliases"))
    to = F.when(k % 30 == 0, k).when(k % 30 == 6, F.lit(-1)).otherwise(k - k % 24 + 1)
    more = spark.createDataFrame([("customer/1", "customer/2"), ("customer/3", "customer/4"), ("customer/4", "customer/3")], "was string, now string")
    moves = c.filter(k % 6 == 0).select(slug(k).alias("was"), slug(to).alias("now")).unionByName(more)
    tags = c.select(slug(k).alias("slug"), F.explode(F.array("c_mktsegment", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))).alias("tag"))
    handles = c.select(F.lit("name").alias("kind"), F.col("c_name").alias("value"), slug(k).alias("slug"))
    cache = c.select(k.cast("string").alias("external_id"), slug(k).alias("display_name"))
    return M.merged({"pages": pages, "links": V.links(spark, d), "entries": V.timeline(spark, d), "tags": tags, "handles": handles, "cache": cache}, moves)


@query(rf"""WITH RECURSIVE {_MOVED}, g AS (SELECT m.now AS slug, string_agg('## Merged from ' || p.slug || repeat(chr(10), 2) || trim(p.body, ' ' || chr(10)), repeat(chr(10), 2) ORDER BY p.slug) FILTER (trim(coalesce(p.body, ''), ' ' || chr(10)) <> '') AS more,
  flatten(list(list_append(coalesce(p.aliases, []), p.slug) ORDER BY p.slug)) AS names FROM pg p JOIN moves m ON m.was = p.slug GROUP BY m.now)
SELECT p.slug, CASE WHEN g.more IS NOT NULL THEN rtrim(coalesce(p.body, ''), ' ' || chr(10)) || repeat(chr(10), 2) || g.more ELSE p.body END AS body,
  array_to_string(CASE WHEN g.slug IS NULL THEN p.aliases ELSE list_filter(list_concat(coalesce(p.aliases, []), g.names), lambda x, i: list_position(list_concat(coalesce(p.aliases, []), g.names), x) = i) END, '|') AS aliases
FROM pg p LEFT JOIN g USING (slug) WHERE p.slug NOT IN (SELECT was FROM moves)""")
def merged_pages(spark, d):
    return _merged(spark, d)["pages"].select("slug", "body", F.array_join("aliases", "|").alias("aliases"))


@query(f"""WITH RECURSIVE {_MOVED}, t AS (SELECT 'customer/' || c_custkey AS slug, unnest([c_mktsegment, 'n' || c_nationkey]) AS tag FROM customer) SELECT DISTINCT coalesce(m.now, slug) AS slug, tag FROM t LEFT JOIN moves m ON m.was = slug""")
def merged_tags(spark, d):
    return _merged(spark, d)["tags"]


@query(f"""WITH RECURSIVE {_MOVED} SELECT 'name' AS kind, c_name AS value, coalesce(m.now, 'customer/' || c_custkey) AS slug FROM customer LEFT JOIN moves m ON m.was = 'customer/' || c_custkey UNION ALL SELECT 'slug', was, now FROM moves""")
def merged_handles(spark, d):
    return _merged(spark, d)["handles"]


@query(f"""WITH RECURSIVE {_MOVED}, r AS (SELECT coalesce(m.now, 'customer/' || o_custkey) AS slug, strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d') AS date, o_orderpriority AS summary, CASE WHEN m.now IS NULL THEN 0 ELSE 1 END AS moved, o_orderstatus AS source, o_orderkey AS entry_id
  FROM orders LEFT JOIN moves m ON m.was = 'customer/' || o_custkey), k AS (SELECT *, row_number() OVER (PARTITION BY slug, date, summary ORDER BY moved, source, entry_id) AS n FROM r) SELECT slug, date, summary, source, entry_id FROM k WHERE n = 1""")
def merged_entries(spark, d):
    return _merged(spark, d)["entries"]


@query(f"""WITH RECURSIVE {_MOVED}, t AS (SELECT DISTINCT was, now, was IN (SELECT slug FROM pg) AND now IN (SELECT slug FROM pg) AS there FROM mv)
SELECT was, now, CASE WHEN was = now THEN 'itself' WHEN NOT there THEN 'no page' WHEN now <> (SELECT now FROM ok0 WHERE ok0.was = t.was) THEN 'moved elsewhere' ELSE 'ring' END AS reason FROM t
WHERE was = now OR NOT there OR now <> (SELECT now FROM ok0 WHERE ok0.was = t.was) OR was NOT IN (SELECT was FROM moves)""")
def merges_refused(spark, d):
    return _merged(spark, d)["refused"]


# derivatives of contributions

_DERIVED = f"""{_PAGES}, {_CONTRIB}, cb AS (SELECT *, CASE WHEN contribution_id % 3 <> 0 THEN 'why ' || contribution_id % 5 END AS why, ['knowledge/doc-' || contribution_id % 60, ' ' || 'KNOWLEDGE/x ', 'no page'] AS entities,
  strftime(to_timestamp(created_s) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, 'what ' || contribution_id % 6 AS said FROM contrib_v WHERE active AND page IN (SELECT slug FROM pages_v)),
ol AS (SELECT 'knowledge/doc-' || doc_id AS src, 'knowledge/doc-' || doc_id % 60 AS dst, 'mentions' AS link_type, doc_id % 2 = 0 AS auto FROM documents),
oe AS (SELECT 'knowledge/doc-' || doc_id AS slug, '2024-01-01' AS date, 'what ' || doc_id % 6 AS summary, 'old' AS detail, doc_id % 2 = 0 AS auto FROM documents)"""


def _rebuilt(spark, d):
    i, k = F.col("contribution_id"), F.col("doc_id")
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    day = F.date_format(F.timestamp_seconds("created_s"), "yyyy-MM-dd").alias("day")
    entities = F.array(text("knowledge/doc-", i % 60), F.lit(" KNOWLEDGE/x "), F.lit("no page")).alias("entities")
    c = V.contributions(spark, d).select(i, "page", "active", text("what ", i % 6).alias("what"), F.when(i % 3 != 0, text("why ", i % 5)).alias("why"), entities, day, F.col("created_s").alias("at_s"))
    p = V.pages(spark, d)
    links = p.select(F.col("slug").alias("src"), text("knowledge/doc-", k % 60).alias("dst"), F.lit("mentions").alias("link_type"), (k % 2 == 0).alias("auto"))
    entries = p.select("slug", F.lit("2024-01-01").alias("date"), text("what ", k % 6).alias("summary"), F.lit("old").alias("detail"), (k % 2 == 0).alias("auto"))
    return M.rebuilt(p.select("slug", "title"), c, links, entries)


@query(f"""WITH {_DERIVED}, e AS (SELECT DISTINCT page AS src, trim(unnest(entities)) AS name FROM cb), n AS (SELECT DISTINCT e.src, p.slug AS dst FROM e JOIN pages_v p ON p.slug = e.name OR lower(p.title) = lower(e.name) WHERE p.slug <> e.src)
SELECT src, dst, 'mentions' AS link_type, true AS auto FROM n UNION ALL SELECT src, dst, link_type, auto FROM ol WHERE NOT auto AND NOT EXISTS (SELECT 1 FROM n WHERE n.src = ol.src AND n.dst = ol.dst)""")
def rebuilt_links(spark, d):
    return _rebuilt(spark, d)[0]


@query(f"""WITH {_DERIVED}, n AS (SELECT page AS slug, day AS date, left(said, 200) AS summary, arg_max(coalesce(why, ''), created_s * 100000 + contribution_id) AS detail FROM cb GROUP BY ALL)
SELECT slug, date, summary, detail, true AS auto FROM n UNION ALL SELECT * FROM oe WHERE NOT auto AND NOT EXISTS (SELECT 1 FROM n WHERE n.slug = oe.slug AND n.date = oe.date AND n.summary = oe.summary)""")
def rebuilt_entries(spark, d):
    return _rebuilt(spark, d)[1]
