"""Small cases of records, structured sources and walks, against plain programs."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from engramlake.functions import messages as M
from engramlake.operators import ledger as L
from engramlake.operators import records as C
from engramlake.operators import rules
from engramlake.operators.steps import cut, digested
from engramlake.sources import structured as S


def test_digests_equal_a_joined_hash(spark):
    r = random.Random(1)
    rows = [(k, i, None if i % 7 == 3 else "ü" * r.randrange(5)) for k in (1, 2, None) for i in range(40)] + [(9, 0, None)]
    df = spark.createDataFrame(rows, "k long, i long, t string").repartition(5)
    got = {x.k: x.hash for x in digested(df, ["k"], [F.asc("i")], "t").collect()}
    want = {k: hashlib.sha256("\n".join(t or "" for kk, _, t in rows if kk == k).encode()).hexdigest() for k in (1, 2, None, 9)}
    assert got == want and digested(df.limit(0), ["k"], [F.asc("i")], "t").count() == 0


def test_cuts_equal_a_walk(spark):
    r = random.Random(2)
    rows = [(k, i, float(r.randrange(1, 50))) for k in "ab" for i in range(300)]
    got = {(x.k, x.i): x.block for x in cut(spark.createDataFrame(rows, "k string, i long, s double").repartition(7), ["k"], [F.asc("i")], "s", 100.0, 4).collect()}
    for k in "ab":
        part, total, n = 0, 0.0, 0
        for _, i, s in (x for x in rows if x[0] == k):
            if n and (total + s > 100 or n >= 4):
                part, total, n = part + 1, 0.0, 0
            total, n = total + s, n + 1
            assert got[k, i] == part


def test_json_is_salvaged_and_compacted(spark):
    raw = ['```json\n{"a": "}", "b": [1, {"c": null}]}\n```', 'so: [1, 2] or {"x": 1}', "no json", '{"a": ', None, "{}", '{"a":{"b":[]},"c":[null,[],0,""]}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i long, t string")
    got = {x.i: x.json for x in S.salvaged(df, "t").collect()}
    assert [None if got[i] is None else json.loads(got[i]) for i in range(7)] == [{"a": "}", "b": [1, {"c": None}]}, [1, 2], None, None, None, {}, json.loads(raw[6])]
    small = {x.i: x.compact for x in S.compacted(df, "t").collect()}
    assert small[6] == '{"c":[0,""]}' and small[5] is None and small[2] is None and small[4] is None


def test_a_failed_source_takes_no_other_with_it(spark):
    good = spark.createDataFrame([(5, "c", "u", "x")], "at_s long, channel string, contact string, content string")

    def bad():
        raise OSError("gone")

    every, states = C.collected(spark, {"a": lambda: good, "b": bad}, good.schema.simpleString())
    assert every.count() == 1
    assert {(r.source, r.ok, r.reason, r.messages, r.cursor_s) for r in states.collect()} == {("a", True, None, 1, 5), ("b", False, "OSError", 0, None)}


def test_merges_keep_what_was_there_first(spark):
    moves = spark.createDataFrame([("old", "new")], "was string, now string")
    rows = spark.createDataFrame([("old", "d1", "from old"), ("new", "d1", "from new"), ("old", "d2", "z")], "slug string, date string, detail string")
    assert {tuple(r) for r in C.repointed(rows, ["slug"], moves, ["slug", "date"]).collect()} == {("new", "d1", "from new"), ("new", "d2", "z")}
    links = spark.createDataFrame([("old", "new", "x"), ("a", "old", "x"), ("a", "new", "x")], "src string, dst string, kind string")
    assert [tuple(r) for r in C.repointed(links, ["src", "dst"], moves, ["src", "dst", "kind"]).collect()] == [("a", "new", "x")]


def test_merge_reasons_come_in_order(spark):
    pages = [("p/1", "person", "Ann Li"), ("p/2", "person", "Ann Li"), ("p/3", "person", "Ann Lee"), ("p/4", "person", "ann  li (x)"), ("t/1", "tool", "Ann Li"), ("p/5", "person", "ANN LI")]
    df = spark.createDataFrame(pages, "slug string, type string, title string")
    got = {(r["from"], r["into"]): r.reason for r in L.merge_suggestions(df).collect()}
    assert got == {("p/2", "p/1"): "same_name", ("p/5", "p/1"): "levenshtein", ("p/4", "p/1"): "pinyin"}


def test_noise_and_scores_of_single_cases(spark):
    rows = [("mail/a", ["Out of Office"]), ("mail/a", ["我们决定"]), ("docs/a", ["[红包]"]), ("g", ["😀", " ☀️ "]), ("g", ["😀", "x"]), ("g", ["负责"]), ("g", [None])]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i long, c string, t array<string>")
    got = {r.i: r.v for r in df.select("i", rules.noise(F.col("c"), F.col("t")).alias("v")).collect()}
    assert [got[i] for i in range(7)] == ["skip", "escalate", "evaluate", "skip", "evaluate", "escalate", "evaluate"]
    one = lambda t, kind, tags: spark.range(1).select(rules.block_score(F.lit(t), F.lit(kind), F.lit(tags) if tags else F.array().cast("array<string>")).alias("s")).first().s
    assert one("hi", "chat", []).decision == "drop" and one("hi", "email", []).decision == "evaluate" and one("see http://a.b/c now", "chat", []).short is False
    assert one("word " * 80, "dm", ["sent", "dm"]).interaction == 1.0


def test_names_become_slugs(spark):
    names = {"Alice Smith": "person/alice-smith", "user (ou_AB1)": "person/ou_ab1", "ou_X9": "person/ou_x9", "O'Neil": "person/o-neil", "王建": None, "(x)": None, "Ann (ou_1)": "person/ann", "Анна": None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.s for r in df.select("n", M.person_slug(F.col("n")).alias("s")).collect()} == names


def test_names_are_read_by_the_longest_entry(spark):
    from engramlake.operators import ledger as L
    from engramlake.operators import readings as N

    table = spark.createDataFrame([("王", "wang"), ("建", "jian"), ("单", "shan"), ("单", "dan"), ("单于", "chan yu"), ("于", "yu"), ("夏侯惇", "xia hou dun"), ("", "x")], "text string, reading string")
    want = {
        "王建": "person/wang-jian", " 王 建 (x)": "person/wang-jian", "单于王": "person/chan-yuwang", "单王": "person/dan-wang", "于": "person/yu", "夏侯惇": "person/xia-houdun", "王B": "person/wang-b",
        "夏": None, "王未": None, "Ann Li": "person/ann-li", "ou_A1": "person/ou_a1", "用户 ou_x": None, "": None, "мир": None, None: None,
    }
    names = spark.createDataFrame([(n,) for n in want] * 2, "name string")
    assert {r.name: r.slug for r in N.person_slugs(names, table).collect()} == {n: s for n, s in want.items() if n is not None}
    assert {r.name: r.slug for r in N.person_slugs(names).collect()}["王建"] is None
    pages = spark.createDataFrame([("p/2", "person", "王建"), ("p/1", "person", "王 建"), ("p/3", "person", "王未"), ("p/4", "person", "Wang-jian")], "slug string, type string, title string")
    assert {tuple(r) for r in L.merge_suggestions(pages, readings=table).collect()} >= {("person", "p/2", "p/1", "pinyin"), ("person", "p/4", "p/1", "pinyin")}
    assert N.person_slugs(names.limit(0), table).count() == 0
