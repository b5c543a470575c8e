"""The thin queries opN_<name> over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm.common import durable, shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (length(text) - length(regexp_replace(text, '\p{L}+', '', 'g')))::BIGINT AS n_letters,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN covered c USING (doc_id)),
f AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
             + CASE WHEN n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
             + CASE WHEN word_chars > 25 * n_words OR word_chars < 2 * n_words THEN 16 ELSE 0 END
             + CASE WHEN 2 * n_letters < word_chars THEN 32 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""


@_query(_QUALITY_SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engramlake.llm import quality

    book = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")), "v1")
    base = F.col("failed").bitwiseAND(F.lit(quality.mask("base"))) != 0
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "failed",
    )


_LINES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM documents),
l AS (SELECT r, source, i, l, trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
      FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
c AS (SELECT source, t, count(DISTINCT text) AS n FROM (SELECT l.source, l.t, d.text FROM l JOIN d USING (r)) WHERE t <> '' GROUP BY source, t),
h AS (SELECT source, count(DISTINCT text) + max(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS total FROM documents GROUP BY source),
b AS (SELECT c.source, c.t FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source WHERE n >= 2 AND n > 0.02::DOUBLE * total),
m AS (SELECT l.*, b.t IS NOT NULL AS gone FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.t = b.t),
p AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_gone, sum(length(l)) AS chars,
             coalesce(sum(length(l)) FILTER (gone), 0) AS gone_chars,
             coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '') AS stays FROM m GROUP BY r),
v AS (SELECT d.doc_id, d.text, p.*, coalesce(n_gone > 0, false) AS dropping FROM d LEFT JOIN p USING (r))
SELECT doc_id, CASE WHEN dropping THEN stays ELSE text END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines,
       CASE WHEN dropping THEN n_gone ELSE 0 END::BIGINT AS n_dropped,
       CASE WHEN dropping THEN gone_chars ELSE 0 END::BIGINT AS dropped_chars
FROM v
"""


@_query(_LINES_SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engramlake.llm import linededup

    docs = table(spark, sf_dir, "documents")
    return linededup.dedup_lines(docs, F.col("source")).select("doc_id", "line_report.*")


@_query()
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engramlake.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents"))


def _remainder(n: int) -> Column:
    """crc32 of the document's id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


@_query()
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engramlake.llm import decontam

    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engramlake.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(_remainder(5) == 0, F.lit(True))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held)
    out = toxicity.score(docs, model)
    return out.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages"
    )


_URLS_SQL = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT page_id, host, path, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
      regexp_matches(host || path, '^(?s:[^/]*cheap-pills[^/]*/.*|[^/]*casino[^/]*/.*|[^/]*free-money[^/]*/.*|ads\.[^/]*/.*|[^/]*\.ads\.[^/]*/.*|tracker\.[^/]*/.*|[^/]*/wp-login[^/]*|[^/]*/cgi-bin/.*|.*/calendar/[^/]{4}/[^/]{2}/.*)$') AS junk
      FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
       WHEN rule IS NOT NULL OR junk THEN 'block' ELSE 'allow' END AS verdict, junk FROM r
"""


@_query(_URLS_SQL)
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engramlake.llm import urlfilter

    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


@_query()
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engramlake.llm import neardup

    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


@_query()
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engramlake.llm import chat

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit(f"{chat.END}{chat.START}assistant ok")
    odd = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    return chat.digest(chat.format_turns(turns.unionByName(odd)))


@_query()
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engramlake.llm import langid

    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(_remainder(4) == 2, F.lit(True))
    out = langid.predict(docs, langid.learn(docs, ~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


_WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""


@_query(_WARC_SQL)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engramlake.llm import warc

    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), path)
    found = durable(warc.read(spark, path, payloads=False).drop("payload").withColumn("payload", F.lit(None).cast("binary")), "warc-records")
    captures = warc.assemble(found).withColumnRenamed("capture_id", "page_id")
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _crc32(text: str) -> str:
    """SQL for the CRC-32 of an ASCII text, bit by bit: -1 stands for a shift."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: list_concat([unicode(c)::BIGINT], list_transform(range(8), lambda k: -1::BIGINT))))"
    step = "CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda a, x: {step}), 4294967295)"


_FIELDS = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR"]


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}))::VARCHAR || ':' || {c} END" for c in [*_FIELDS, text]) + ")"


#: Trees as (tree, level, i, node); a leaf's path as the other nodes of its run, level by level.
_MERKLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf("text")} AS leaf,
    CASE WHEN {_crc32("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS now FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM d),
t AS (SELECT s, 0 AS level, i, leaf AS node, count(*) OVER (PARTITION BY s) AS n FROM l
      UNION ALL
      SELECT s, level + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), any_value((n + 2) // 3) FROM t WHERE n > 1 GROUP BY s, level, i // 3),
u AS (SELECT 0 AS level, s AS i, node, count(*) OVER () AS n FROM t WHERE n = 1
      UNION ALL
      SELECT level + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), any_value((n + 2) // 3) FROM u WHERE n > 1 GROUP BY level, i // 3),
a AS (SELECT s, level, i // 3 AS run, list(i ORDER BY i) AS seats, list(node ORDER BY i) AS nodes FROM t WHERE n > 1 GROUP BY s, level, i // 3),
b AS (SELECT level, i // 3 AS run, list(i ORDER BY i) AS seats, list(node ORDER BY i) AS nodes FROM u WHERE n > 1 GROUP BY level, i // 3),
p AS (SELECT l.s, l.i, 0 AS part, a.level, a.seats, a.nodes, (l.i // (3 ** a.level)::BIGINT)::BIGINT AS k FROM l JOIN a ON a.s = l.s AND a.run = l.i // (3 ** (a.level + 1))::BIGINT
      UNION ALL
      SELECT l.s, l.i, 1, b.level, b.seats, b.nodes, (l.s // (3 ** b.level)::BIGINT)::BIGINT FROM l JOIN b ON b.run = l.s // (3 ** (b.level + 1))::BIGINT),
q AS (SELECT s, i, part, level, coalesce(array_to_string(nodes[:list_position(seats, k) - 1], ''), '') AS x, coalesce(array_to_string(nodes[list_position(seats, k) + 1:], ''), '') AS y FROM p),
w AS (SELECT s, i, list({{'x': x, 'y': y}} ORDER BY part, level) AS path FROM q GROUP BY s, i),
r AS (SELECT l.doc_id, l.leaf, l.now, l.s, coalesce(path, []) AS path FROM l LEFT JOIN w USING (s, i)),
f AS (SELECT *, list_reduce(list_prepend({{'x': now, 'y': ''}}, path), lambda c, e: {{'x': sha256(e.x || c.x || e.y), 'y': ''}}).x AS folded_root,
             sha256(coalesce(array_to_string(list_transform(path, lambda e: e.x || e.y), ''), '')) AS proof_sha256 FROM r)
SELECT f.doc_id, f.leaf, t.node AS subroot, u.node AS root, f.proof_sha256, f.folded_root, f.folded_root = u.node AS verified
FROM f JOIN t ON t.s = f.s AND t.n = 1, u WHERE u.n = 1
"""


@_query(_MERKLE_SQL)
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engramlake.llm import merkle

    docs = table(spark, sf_dir, "documents")
    return merkle.audit(docs, _remainder(2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))


#: e: the edits of a turn from state i to state j, with the insertions that may follow; states are 0 (nothing), 1 (s), 2 (u), 3 (a).
_REPAIR_SQL = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS lot FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN lot = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE lot <> 0),
o AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
r AS (SELECT c, conv_id, turn, i, role, text, role[:1] AS initial, bare = '' AS blank, bare <> '' AND nth > 1 AS again,
             bare <> '' AND nth = 1 AND bare[-1:] NOT IN ('.', '!', '?') AS cut FROM o),
n AS (SELECT c, any_value(conv_id) AS conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated FROM r GROUP BY c),
x AS (SELECT c, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT c, lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS pair FROM r) GROUP BY c),
step(initial, i, j) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
ins(i, j, cost, audit) AS (VALUES (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')),
e AS (SELECT t.initial, t.i, ins.j, t.cost + ins.cost AS cost, t.edit || ins.audit AS audit, t.edit <> 'D' AS stays
      FROM (SELECT initial, i, j, 0 AS cost, 'K' AS edit FROM step UNION ALL SELECT NULL, i, j, 3, 'R' FROM step WHERE initial <> 's'
            UNION ALL SELECT NULL, k, k, 4, 'D' FROM range(4) g(k)) t JOIN ins ON ins.i = t.j),
w AS (SELECT c, 0::BIGINT AS i, ins.j AS state, {{'cost': ins.cost::BIGINT, 'audit': ins.audit}} AS way FROM n, ins WHERE ins.i = 0
      UNION ALL
      SELECT w.c, w.i + 1, e.j, min({{'cost': w.way.cost + e.cost + CASE WHEN e.stays AND r.cut THEN 3 ELSE 0 END, 'audit': w.way.audit || e.audit}})
      FROM w JOIN r ON r.c = w.c AND r.i = w.i + 1 JOIN e ON e.i = w.state AND (e.initial IS NULL OR e.initial = r.initial) AND NOT (e.stays AND (r.blank OR r.again))
      GROUP BY w.c, w.i, e.j),
best AS (SELECT n.c, min(way) AS way FROM w JOIN n ON n.c = w.c AND n.n = w.i WHERE state IN (0, 3) GROUP BY n.c),
p AS (SELECT c, unnest(list_prepend(regexp_extract(way.audit, '^I*'), regexp_extract_all(way.audit, '[KRD]I*'))) AS edits,
             generate_subscripts(list_prepend('', regexp_extract_all(way.audit, '[KRD]I*')), 1) - 1 AS i FROM best),
q AS (SELECT c, i, unnest(string_split(edits, '')) AS edit, generate_subscripts(string_split(edits, ''), 1) AS k FROM p WHERE edits <> ''),
s AS (SELECT q.c, q.edit, r.role, CASE WHEN q.edit <> 'I' THEN r.text ELSE '' END AS text, row_number() OVER (PARTITION BY q.c ORDER BY q.i, q.k) AS seat,
             max(CASE WHEN q.edit = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY q.c) AS opened
      FROM q LEFT JOIN r ON r.c = q.c AND r.i = q.i WHERE q.edit <> 'D'),
h AS (SELECT c, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (seat - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY seat)) AS repaired_sha256 FROM s GROUP BY c),
g AS (SELECT n.conv_id, n.gaps, n.blank, n.duplicate, n.truncated, x.illegal, best.way.cost AS cost, best.way.audit AS audit, h.repaired_sha256
      FROM n JOIN x USING (c) JOIN best USING (c) LEFT JOIN h USING (c))
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id
"""


@_query(_REPAIR_SQL)
def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engramlake.llm import repair

    return repair.report(table(spark, sf_dir, "conversations"))


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _license_sql() -> str:
    from engramlake.llm import licenses as lic

    known = [(label, True, text) for label, text in lic.PHRASES] + [(label, False, text) for label, text in lic.NOTICES]
    values = ",\n    ".join(f"({k}, '{label}', {exact}, '{text.lower()}')" for k, (label, exact, text) in enumerate(known))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
known(notice, label, exact, text) AS (VALUES
    {values}),
k AS (SELECT notice, label, exact, len(w) AS words, t, w[t + 1:t + {lic.K}] AS g FROM (SELECT *, unnest(range(0, len(w) - {lic.K - 1})) AS t FROM (SELECT *, regexp_extract_all(text, '{_WORD}') AS w FROM known))),
g AS (SELECT r, p, w[p + 1:p + {lic.K}] AS g FROM (SELECT r, w, unnest(range(0, len(w) - {lic.K - 1})) AS p FROM d WHERE len(w) >= {lic.K})),
h AS (SELECT r, notice, label, exact, words, t, p, p - t AS diagonal FROM g JOIN k USING (g)),
v AS (SELECT r, notice, label, exact, words, diagonal, count(*) AS votes, min(p) AS lo, max(p) + {lic.K} AS hi, list(t) AS ts FROM h GROUP BY ALL),
i AS (SELECT *, sum(CASE WHEN NOT exact AND diagonal - before <= {lic.SLACK} THEN 0 ELSE 1 END) OVER (PARTITION BY r, notice ORDER BY diagonal) AS island
      FROM (SELECT *, lag(diagonal) OVER (PARTITION BY r, notice ORDER BY diagonal) AS before FROM v)),
m AS (SELECT r, notice, label, exact, words, island, min(lo) AS lo, max(hi) AS hi, max(CASE WHEN exact AND votes = words - {lic.K - 1} THEN 1 ELSE 0 END) = 1 AS base,
             len(list_distinct(flatten(list_transform(flatten(list(ts)), lambda t: range(t, t + {lic.K}))))) AS covered FROM i GROUP BY r, notice, label, exact, words, island),
s AS (SELECT *, covered::DOUBLE / greatest(words, hi - lo) AS cover, NOT exact AND covered::DOUBLE / greatest(words, hi - lo) >= {lic.COVER} AS sure FROM m),
o AS (SELECT *, coalesce(max(hi) OVER (PARTITION BY r, sure ORDER BY lo, hi, notice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM s),
n AS (SELECT *, sum(CASE WHEN lo >= upto THEN 1 ELSE 0 END) OVER (PARTITION BY r, sure ORDER BY lo, hi, notice) AS knot FROM o),
f AS (SELECT *, base OR sure AND cover = max(cover) OVER (PARTITION BY r, sure, knot) AS found FROM n),
a AS (SELECT r, count(*) FILTER (base) AS n_base, min(lo) FILTER (base) AS first_word, max(lo) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (found) AS labels, max(cover) AS score FROM f GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN a USING (r)
"""


@_query(_license_sql())
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engramlake.llm import licenses

    return licenses.scan(table(spark, sf_dir, "documents"), licenses.notices(spark))
