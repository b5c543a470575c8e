"""Queries over documents to be read, and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake import views as V
from engramlake.operators import records as C
from engramlake.queries import _CONTRIB, _LINKS, _PAGES
from engramlake.registry import query
from engramlake.sources import chat
from engramlake.sources import documents as D

_VALUE = """v AS (SELECT page_id, CASE page_id % 10 WHEN 0 THEN ' https://a.feishu.cn/docx/Tok' || page_id || '?x=1 ' WHEN 1 THEN 'https://a.feishu.net/wiki/W' || page_id || '#h' WHEN 2 THEN 'http://feishu.cn/docs/old' WHEN 3 THEN 'feishu.cn/sheets/s' || page_id
  WHEN 4 THEN left(sha256(page_id::VARCHAR), 24) WHEN 5 THEN left(sha256(page_id::VARCHAR), 12) WHEN 6 THEN NULL WHEN 7 THEN 'https://feishu.cn/docx/' WHEN 8 THEN 'https://feishu.cn/wiki/x/docx/' || page_id ELSE url END AS value FROM pages)"""


@query(rf"""WITH {_VALUE}, x AS (SELECT page_id, trim(coalesce(value, '')) AS x FROM v), t AS (SELECT *, regexp_extract(x, 'feishu\.[a-z]+/docx/([^/?#]+)', 1) AS docx, regexp_extract(x, 'feishu\.[a-z]+/wiki/([^/?#]+)', 1) AS wiki, regexp_matches(x, '^[A-Za-z0-9]{{20,}}$') AS raw FROM x)
SELECT page_id, CASE WHEN raw OR docx <> '' THEN 'docx' WHEN wiki <> '' THEN 'wiki_node' ELSE 'reject' END AS kind, CASE WHEN raw THEN x WHEN docx <> '' THEN docx WHEN wiki <> '' THEN wiki END AS token,
  CASE WHEN raw OR docx <> '' OR wiki <> '' THEN NULL WHEN regexp_matches(x, 'feishu\.[a-z]+/(docs|sheets|base|mindnotes|file|slides)/') THEN 'UNSUPPORTED_DOC_TYPE' ELSE 'INVALID_URL' END AS code FROM t""")
def doc_addresses(spark, d):
    i = F.col("page_id")
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    token = F.sha2(i.cast("string"), 256)
    forms = [text(" https://a.feishu.cn/docx/Tok", i, "?x=1 "), text("https://a.feishu.net/wiki/W", i, "#h"), F.lit("http://feishu.cn/docs/old"), text("feishu.cn/sheets/s", i), F.substring(token, 1, 24), F.substring(token, 1, 12), F.lit(None), F.lit("https://feishu.cn/docx/"), text("https://feishu.cn/wiki/x/docx/", i)]
    value = F.col("url")
    for k, form in enumerate(forms):
        value = F.when(i % 10 == k, form).otherwise(value)
    return V.table(spark, d, "pages").select(i, D.address(value).alias("a")).select("page_id", "a.*")


# walks: customers are documents in the folders of nations and regions; suppliers are nodes of wiki spaces

_WALKS = f"""{_LINKS}, fo AS (SELECT 'region/2' AS token, 'My Space/' AS path, 0 AS walk UNION ALL SELECT 'nation/' || n_nationkey, 'My Space/' || n_name || '/', 0 FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'nation/' || n_nationkey, n_name || '/', 1 FROM nation WHERE n_nationkey % 3 = 0),
c AS (SELECT walk AS w, 'tok' || c_custkey % 900 AS doc_token, c_name AS title, CASE walk WHEN 0 THEN 'my_space' ELSE 'folder' END AS origin, path AS parent_path, 'u/' || c_custkey AS url, c_mktsegment AS owner, c_custkey::BIGINT AS modified_s FROM customer JOIN fo ON token = 'nation/' || c_nationkey WHERE c_custkey % 5 <> 0
 UNION ALL SELECT 2, CASE WHEN s_suppkey % 17 <> 0 THEN 'tok' || s_suppkey * 7 % 1200 END, s_name, 'wiki', 'Wiki/' || n_name || '/', 'w/' || s_suppkey, NULL, s_suppkey::BIGINT FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 4 <> 1 AND n_nationkey % 5 <> 2)"""


@query(f"""WITH {_WALKS}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_token ORDER BY w, parent_path, title, origin, url, owner NULLS FIRST, modified_s) AS n FROM c WHERE doc_token IS NOT NULL)
SELECT doc_token, title, origin, parent_path, url, owner, modified_s FROM k WHERE n = 1""")
def doc_candidates_united(spark, d):
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    nation, k = V.table(spark, d, "nation"), F.col("c_custkey")
    tree = V.links(spark, d).filter("link_type = 'part_of'").select(F.col("src").alias("token"), F.col("dst").alias("parent"))
    names = nation.select(text("nation/", F.col("n_nationkey")).alias("token"), "n_name")
    mine = chat.walk(tree.filter("token LIKE 'nation/%'"), spark.createDataFrame([("region/2",)], "token string"), 1).join(names, "token", "left")
    mine = mine.select("token", F.concat(F.lit("My Space/"), F.coalesce(F.concat("n_name", F.lit("/")), F.lit(""))).alias("path"))
    listed = nation.filter("n_nationkey % 3 = 0").select(text("nation/", F.col("n_nationkey")).alias("token"), F.concat("n_name", F.lit("/")).alias("path"))
    kind = F.when(k % 5 == 0, "sheet").otherwise("docx")
    files = V.table(spark, d, "customer").select(text("tok", k % 900).alias("token"), F.col("c_name").alias("name"), kind.alias("type"), text("nation/", F.col("c_nationkey")).alias("folder"), text("u/", k).alias("url"), F.col("c_mktsegment").alias("owner"), k.cast("long").alias("modified_s"))
    s = F.col("s_suppkey")
    nodes = V.table(spark, d, "supplier").select(
        F.col("s_nationkey").alias("space_id"), F.when(s % 17 != 0, text("tok", s * 7 % 1200)).alias("obj_token"), F.when(s % 4 == 1, "bitable").otherwise("docx").alias("obj_type"), F.col("s_name").alias("title"),
        text("w/", s).alias("url"), F.lit(None).cast("string").alias("owner"), s.cast("long").alias("modified_s"),
    )
    spaces = nation.select(F.col("n_nationkey").alias("space_id"), F.col("n_name").alias("name"))
    wiki = D.in_wiki(nodes, spaces, spaces.filter("space_id % 5 = 2"))
    return D.united([D.in_folders(files, mine, "my_space"), D.in_folders(files, listed, "folder"), wiki])


# tags

_TAGS = f"""{_PAGES}, {_CONTRIB}, ot AS (SELECT slug, platform AS tag FROM pages_v WHERE platform IS NOT NULL), nt AS (SELECT page AS slug, signal_type AS tag FROM contrib_v UNION ALL SELECT 'gone/' || contribution_id % 3, 'en' FROM contrib_v UNION ALL SELECT page, 'en' FROM contrib_v)"""


def _tagged(spark, d):
    p, c = V.pages(spark, d), V.contributions(spark, d)
    old = p.filter("platform IS NOT NULL").select("slug", F.col("platform").alias("tag"))
    gone = c.select(F.concat(F.lit("gone/"), (F.col("contribution_id") % 3).cast("string")).alias("slug"), F.lit("en").alias("tag"))
    new = c.select(F.col("page").alias("slug"), F.col("signal_type").alias("tag")).unionByName(gone).unionByName(c.select(F.col("page").alias("slug"), F.lit("en").alias("tag")))
    return C.upserted_tags(old, new, p)


@query(f"WITH {_TAGS} SELECT slug, tag FROM ot UNION SELECT slug, tag FROM nt WHERE slug IN (SELECT slug FROM pages_v)")
def tag_upsert(spark, d):
    return _tagged(spark, d)[0]


@query(f"WITH {_TAGS} SELECT DISTINCT slug, tag FROM nt WHERE slug NOT IN (SELECT slug FROM pages_v)")
def tag_orphans(spark, d):
    return _tagged(spark, d)[1]
