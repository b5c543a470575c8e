"""Queries over runs and their state."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake import views as V
from engramlake.functions import messages as M
from engramlake.operators import schedule as D
from engramlake.queries import _GROUP, _PAGES
from engramlake.registry import query

_NOW = 1704067200 + 86400 * 40
_STATE = """st AS (SELECT user_id::VARCHAR AS source, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS failures, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS partials FROM events GROUP BY user_id)"""


@query("""SELECT c_custkey AS source, CASE WHEN c_custkey % 5 = 0 THEN 60 WHEN c_custkey % 2 = 0 THEN 600 END::INTEGER AS every_s, CASE WHEN c_custkey % 5 = 0 THEN false ELSE true END AS enabled FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 5 = 0""")
def schedule_effective(spark, d):
    c, k = V.table(spark, d, "customer"), F.col("c_custkey")
    derived = c.filter(k % 2 == 0).select(k.alias("source"), F.lit(600).alias("every_s"), F.lit(True).alias("enabled"))
    over = c.filter(k % 5 == 0).select(k.alias("source"), F.lit(60).alias("every_s"), F.lit(False).alias("enabled"))
    return D.effective(derived, over)


@query(f"""WITH {_GROUP}, r AS (SELECT contact, max(at_s) AS last_s FROM group_v GROUP BY contact), s AS (SELECT 'user-' || c_custkey AS source, c_custkey % 2 = 0 AS enabled, (86400 * 11)::BIGINT AS every_s FROM customer)
SELECT source, coalesce(last_s + every_s, {_NOW}) AS next_s, enabled AND coalesce(last_s + every_s, {_NOW}) <= {_NOW} AS due FROM s LEFT JOIN r ON contact = source""")
def due_sources(spark, d):
    c = V.table(spark, d, "customer")
    s = c.select(F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("source"), (F.col("c_custkey") % 2 == 0).alias("enabled"), F.lit(86400 * 11).cast("long").alias("every_s"))
    return D.due(s, V.group_messages(spark, d).select(F.col("contact").alias("source"), "at_s"), _NOW)


@query("""SELECT user_id AS run, sum(CASE WHEN event_id % 40 = 0 THEN 1 ELSE 0 END)::BIGINT AS failed, sum(CASE WHEN event_id % 50 = 1 THEN 1 ELSE 0 END)::BIGINT AS unpushed, bool_and(event_id % 40 <> 0 AND event_id % 50 <> 1) AS commit FROM events GROUP BY user_id""")
def commit_gate(spark, d):
    k = F.col("event_id")
    return D.commits(V.table(spark, d, "events").select(F.col("user_id").alias("run"), (k % 40 == 0).alias("failed"), (k % 50 != 1).alias("pushed")))


@query(f"""WITH {_GROUP} SELECT event_id, at_s FROM group_v WHERE at_s >= 1704067200 + 864000 ORDER BY at_s, event_id LIMIT 100""")
def since_limit(spark, d):
    return V.group_messages(spark, d).filter(F.col("at_s") >= 1704067200 + 864000).select("event_id", "at_s").orderBy("at_s", "event_id").limit(100)


@query(f"""WITH {_PAGES} SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'replay' WHEN doc_id % 6 = 0 THEN 'missing' WHEN created_s > {_NOW} - 1800 THEN 'silence' WHEN doc_id % 5 = 0 THEN 'stale'
 WHEN doc_id % 4 = 0 THEN 'backoff' WHEN doc_id % 3 = 0 THEN 'dead' ELSE 'distill' END AS step FROM pages_v""")
def distill_decide(spark, d):
    p, k = V.pages(spark, d), F.col("doc_id")
    revisions = p.select(
        k.alias("id"), F.col("slug").alias("session"), F.lit("h").alias("hash"), F.when(k % 4 == 0, "retrying").otherwise("discovered").alias("state"),
        F.lit(_NOW - 60).alias("updated_s"), F.when(k % 3 == 0, 3).otherwise(0).alias("tries"))
    payloads = p.filter(k % 7 == 0).select(k.alias("revision_id"))
    files = p.filter(k % 6 != 0).select(F.col("slug").alias("session"), F.when(k % 5 == 0, "g").otherwise("h").alias("hash"), F.col("created_s").alias("changed_s"))
    return D.distill_step(revisions, payloads, files, _NOW)


def _states(spark, d):
    n = lambda kind: F.sum((F.col("event_type") == kind).cast("long"))
    return V.table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("source")).agg(n("error").alias("failures"), n("view").alias("partials"))


@query(f"WITH {_STATE} SELECT source, CASE WHEN failures >= 3 THEN 'failing' ELSE 'partial' END AS reason FROM st WHERE failures >= 3 OR partials >= 5")
def alerts(spark, d):
    return D.alerts(_states(spark, d))


@query(f"WITH {_GROUP} SELECT max(at_s) AS last_s, min(at_s) + 600 AS next_s, count(DISTINCT channel) AS sources FROM group_v")
def daemon_status(spark, d):
    return V.group_messages(spark, d).agg(F.max("at_s").alias("last_s"), (F.min("at_s") + 600).alias("next_s"), F.count_distinct("channel").alias("sources"))


@query("SELECT event_id, CASE WHEN value >= 85 THEN 'admit' WHEN value <= 15 THEN 'drop' ELSE 'evaluate' END AS step FROM events")
def noise_gate(spark, d):
    return V.table(spark, d, "events").select("event_id", M.gate(F.col("value"), 85, 15).alias("step"))


@query("SELECT conv_id, count(*) AS turns, max(turn) AS newest FROM conversations WHERE role = 'user' GROUP BY conv_id ORDER BY newest DESC, conv_id LIMIT 50")
def session_list(spark, d):
    x = V.table(spark, d, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max("turn").alias("newest"))
    return x.orderBy(F.desc("newest"), "conv_id").limit(50)


@query(f"""WITH {_GROUP}, r AS (SELECT channel, count(*) AS n FROM group_v GROUP BY channel HAVING count(*) >= 20)
SELECT channel, event_id FROM (SELECT channel, event_id, row_number() OVER (PARTITION BY channel ORDER BY at_s, event_id) AS k FROM group_v WHERE channel IN (SELECT channel FROM r)) WHERE k <= 50""")
def infer_inputs(spark, d):
    from engramlake.operators import rules

    m = V.group_messages(spark, d)
    enough = m.groupBy("channel").agg(F.count(F.lit(1)).alias("n")).filter("n >= 20").select("channel")
    return rules.first_rows(m.join(enough, "channel", "left_semi"), ["channel"], 50, F.asc("at_s"), F.asc("event_id")).select("channel", "event_id")
