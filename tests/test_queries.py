"""Every query against its SQL on the smallest tables, and small cases of the operators."""

import hashlib
import os
import random
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from engramlake import queries as own
from engramlake.functions import text as T
from engramlake.operators import activity as A
from engramlake.operators import filters
from engramlake.operators import graph as G
from engramlake.operators import ledger as L
from engramlake.operators import retrieval as R
from engramlake.operators import search

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "customer supplier nation region part orders events documents embeddings pages labels conversations".split()


def plain(rows):
    return sorted(tuple("NULL" if v is None else repr(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = Path(DATA, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = own.queries()[name](spark, DATA)
    cur = duck.execute(own.oracle_sql()[name])
    columns = [x[0] for x in cur.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain(got.select(*columns).collect()) == plain(cur.fetchall())


def test_the_flagship_ranks_and_limits(spark):
    rows = own.queries()["hybrid_search"](spark, DATA).collect()
    assert 0 < len(rows) <= 20
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)


def test_entry_has_every_query():
    import __spark_entry__ as entry

    assert set(own.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_trigram_similarity(spark):
    row = spark.range(1).select(T.similarity(F.lit("word"), F.lit("two words")).alias("s"), T.similarity(F.lit(""), F.lit("")).alias("z")).first()
    assert round(row.s, 6) == round(4 / 11, 6) and row.z == 0


def test_similarity_of_a_batch_equals_that_of_rows(spark):
    texts = ["two words", "", None, "Ünï-code  ÉTÉ 42!", "word", "a", "...", "the and the AND", "x" * 300 + " word"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for q in ("word", "the and été", "", "?"):
        got = {r.i: r.s for r in R.scored(df, {"t": "s"}, q, 40).collect()}
        want = {r.i: r.s for r in df.select("i", F.coalesce(T.similarity(F.coalesce("t", F.lit("")), F.lit(q)), F.lit(0.0)).alias("s")).collect()}
        assert got == pytest.approx(want)


def test_chunks_cover_every_word(spark):
    words = [f"w{i}" for i in range(801)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "")], "doc_id long, body string")
    rows = R.chunks(df).orderBy("doc_id", "chunk_index").collect()
    assert {w for r in rows for w in r.chunk_text.split()} == set(words)
    assert [r.token_count for r in rows] == [300, 300, 300, 51, 0]


def test_fusion_pools(spark):
    leg = spark.createDataFrame([("a", 0), ("b", 1)], "slug string, rank int")
    by = {p: {r.slug: r.rrf for r in R.fuse([leg, leg], p).collect()} for p in ("max", "sum")}
    assert by["max"]["a"] == pytest.approx(1 / 61) and by["sum"]["b"] == pytest.approx(2 / 62)


def test_traverse_survives_cycles(spark):
    e = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("c", "a", "t"), ("c", "d", "t")], "src string, dst string, link_type string")
    assert {(r.slug, r.depth) for r in G.traverse(e, "a", 5).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {r.slug for r in G.traverse(e, "a", 1, "in").collect()} == {"a", "c"}


def test_a_gap_of_exactly_half_an_hour_keeps_the_session(spark):
    m = spark.createDataFrame([("c", 0, 1), ("c", 1800, 2), ("c", 3601, 3)], "contact string, at_s long, event_id long")
    assert A.sessions(m, ["contact"], "event_id").count() == 2


def walked_blocks(messages, gap, most_tokens, most):
    """The blocks of one stream, message by message: lists of message ids with the thread."""
    out, now, tokens, thread, token, last = [], [], 0, None, None, None

    def close():
        nonlocal now, tokens, thread
        if now:
            out.append(([m["msg_id"] for m in now], thread))
        now, tokens, thread = [], 0, None

    for m in messages:
        channel = m["channel"]
        if now and (m["platform"], channel) != (now[0]["platform"], now[0]["channel"]):
            close()
            token = None
        if channel.startswith(("mail/", "calendar/")) or channel == "tasks" or (channel.startswith("docs/") and not m["doc_token"]):
            close()
            out.append(([m["msg_id"]], None))
            token = None
        elif channel.startswith("docs/"):
            if now and m["doc_token"] != token:
                close()
            token = m["doc_token"]
            now.append(m)
        else:
            late = bool(now) and m["at_s"] - last > gap
            if now and ((thread is not None and m["thread"] != thread) or late or tokens + m["tokens"] > most_tokens or len(now) >= most):
                close()
            now.append(m)
            tokens += m["tokens"]
            thread = thread or m["thread"]
        last = m["at_s"]
    close()
    return out


def test_blocks_equal_a_walk(spark):
    r = random.Random(8)
    rows = []
    for s in range(6):
        at = 0
        for k in range(400):
            at += r.choice([0, 5, 60, 600, 1800, 1801, 4000])
            channel = r.choice(["dm/a"] * 12 + ["group/b"] * 3 + ["mail/x", "tasks", "calendar/y", "docs/d", "docs/d", "docs/e"])
            thread = r.choice([None, None, "t1", "t2"]) if s % 2 else None
            token = r.choice([None, "k1", "k1", "k2"]) if channel.startswith("docs/") else None
            rows.append((f"s{s}", "im", channel, at, k, f"m{s}-{k}", f"u{k % 3}", float(r.randrange(1, 300)), thread, token))
    rows += [("long", "im", "dm/z", t, t, f"z{t}", "u", 1.0, None, None) for t in range(250)]
    kind = "stream string, platform string, channel string, at_s long, seq long, msg_id string, contact string, tokens double, thread string, doc_token string"
    names = [x.split()[0] for x in kind.split(", ")]
    got = A.blocks(spark.createDataFrame(rows, kind), tokens=900.0, most=100).collect()
    assert len({(x.stream, x.part, x.block) for x in got}) == len(got)
    for s in {x[0] for x in rows}:
        want = walked_blocks([dict(zip(names, x)) for x in rows if x[0] == s], 1800, 900.0, 100)
        mine = Counter((x.messages, x.block_hash, x.thread) for x in got if x.stream == s)
        assert mine == Counter((len(ids), hashlib.sha256("|".join(sorted(ids)).encode()).hexdigest()[:16], t) for ids, t in want)


def test_filter_bounds_and_times():
    assert [filters.clamped(x) for x in (None, 0, -3, 7.9, 500, float("nan"))] == [20, 20, 20, 7, 50, 20]
    assert [filters.candidates(x) for x in (1, 10, 50)] == [20, 30, 50]
    assert filters.seconds("2024-01-02") == (1704153600, True) and filters.seconds("2024-01-02T00:00:00+08:00") == (1704124800, False)
    assert filters.since("2h", 10_000) == 2800 and filters.since("7d", 700_000) == 95_200 and filters.since("1970-01-02", 5) == 86400
    assert [filters.valid_slug(x) for x in ("a/b", "", "a//b", "../b", "a b", "x")] == [True, False, False, False, False, True]


def test_queries_are_rewritten_alike_in_python_and_spark(spark):
    queries = ["What is the Plan for  review", "the and", "  ", "GPT gpt thing thing", "plan"]
    more = {"plan": ["Roadmap", "review"]}
    df = spark.createDataFrame([(q,) for q in queries], "q string")
    got = [r[0] for r in df.select(search.rewritten(F.col("q"), more)).collect()]
    assert got == ["Plan Roadmap review", "the and", "", "GPT thing", "plan Roadmap review"]
    assert [search.rewritten_query(q, more) for q in queries] == [x or q for x, q in zip(got, queries)]


def test_multi_source_truth_comes_before_the_page(spark):
    source = "source struct<platform:string,source_type:string,channel:string,channel_name:string,author:struct<id:string,name:string>,participants:array<struct<id:string,name:string>>,timestamp_s:long>"
    of = lambda p: (p, None, "c", None, None, None, None)
    pages = spark.createDataFrame([("a", "t", 0, of("en")), ("b", "t", 5, of("en")), ("c", "t", 9, of("de"))], f"slug string, type string, created_s long, {source}")
    signals = spark.createDataFrame([("a", True, of("de")), ("b", False, of("de")), ("c", True, of("en")), ("c", True, of("de"))], f"page string, active boolean, {source}")
    seen = lambda **f: {r.slug for r in filters.matching(pages, signals, filters.MemoryFilter(**f)).collect()}
    assert seen(platform="en") == {"b", "c"} and seen(platform=["de"]) == {"a", "c"} and seen(participant="x") == set()
    assert seen() == {"a", "b", "c"} and seen(since="1970-01-01T00:00:05") == {"b", "c"} and seen(until="1970-01-01") == {"a", "b", "c"}


def test_near_titles_equal_brute_force(spark):
    titles = ["quarterly plan", "quarterly plans", "quartely plan", "quarterly plan", "Quarterly plan", "abcd", "abce", "abxe", "xquarterly plany", "tuarterlyp lan"]
    df = spark.createDataFrame([(f"s{i}", "task", t) for i, t in enumerate(titles)], "slug string, type string, title string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {
        (min(a, b), max(a, b)) for i, a in enumerate(titles) for b in titles[i:]
        if a != b and distance(a.lower(), b.lower()) <= (2 if min(len(a), len(b)) >= 8 else 1)
    }
    assert {(r.title_a, r.title_b) for r in L.near_titles(df).collect()} == want
    heads = {r.title: (r.pages, r["head"]) for r in L.titles(df).collect()}
    assert heads["quarterly plan"] == (2, "s0") and all(r.head_a == heads[r.title_a][1] for r in L.near_titles(df).collect())


def test_budget_keeps_a_prefix_and_the_first_row(spark):
    df = spark.createDataFrame([(1, 1, 50), (1, 2, 60), (1, 3, 1), (2, 1, 500)], "g int, o int, c int")
    got = {(r.g, r.o) for r in L.running_budget(df, ["g"], [F.asc("o")], F.col("c"), 100).collect()}
    assert got == {(1, 1), (2, 1)}
    r = random.Random(4)
    rows = [(i % 3, i, r.randrange(40)) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, o int, c int")
    got = {(x.g, x.o, x.spent, x.place) for x in L.running_budget(df, ["g"], [F.desc("o")], F.col("c"), 500, 7).collect()}
    want = set()
    for g in range(3):
        total = 0
        for k, (_, o, c) in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: -x[1])):
            total += c
            if total <= 500 or not k:
                want.add((g, o, total, k + 1))
    assert got == want
