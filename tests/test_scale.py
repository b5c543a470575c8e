"""Operators at sizes and on inputs at which an earlier form was wrong, failed or did far more work."""

import random
import re
import tracemalloc
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engramlake.functions import messages, privacy, text
from engramlake.operators import apply as P
from engramlake.operators import ledger, postings, rules, similar
from engramlake.streaming import blocks


def grams(x):
    return {f"  {w} "[i : i + 3] for w in re.findall(r"\w+", x.lower()) for i in range(len(w) + 1)}


def test_candidates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 16)
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randrange(1, 6)))
    titles = [" ".join(word() for _ in range(r.randrange(1, 6))) for _ in range(150)] + ["!!", None, "写 报告 𝒳y", "!!"]
    pool = [(f"p{i}", t) for i, t in enumerate(titles + titles[:40])]
    signals = [(i, t[: r.randrange(1, 20)]) for i, t in enumerate(t for t in titles if t)] + [(900, None), (901, "!!")]
    want = set()
    for i, what in signals:
        x = grams(what or "")
        score = lambda t: round(len(x & grams(t)) / max(1, len(x | grams(t))), 6)  # noqa: B023, E731
        best = sorted(((-score(t), s) for s, t in pool if t is not None and score(t) > 0))[:5]
        want |= {(i, s, -v, k + 1) for k, (v, s) in enumerate(best)}
    got = P.candidates(spark.createDataFrame(signals, "id int, what string"), spark.createDataFrame(pool, "slug string, title string"))
    assert {tuple(x) for x in got.select("id", "slug", "score", "place").collect()} == want



def test_candidates_use_whole_texts_in_bounded_memory(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_GRAMS", 300, raising=False)
    same = " ".join(f"w{i}" for i in range(200))
    pool = [(f"p{i}", f"{same} tail{i} {'x' * i}") for i in range(30)]
    got = P.candidates(spark.createDataFrame([(1, pool[17][1]), (2, "tail4")], "id int, what string"), spark.createDataFrame(pool, "slug string, title string")).collect()
    assert {r.slug: r.score for r in got if r.id == 1 and r.place == 1} == {"p17": 1.0} and len(got) == 10
    tail = grams("tail4")
    best = max((round(len(tail & grams(t)) / len(tail | grams(t)), 6), s) for s, t in pool)
    assert [(r.score, r.slug) for r in got if r.id == 2 and r.place == 1] == [best]
    # what a block costs grows with the block, not with the trigrams of all texts that are sought
    r = np.random.default_rng(5)
    rows = [np.unique(r.integers(0, 4000, 600)) for _ in range(3000)]
    lists = lambda x: (np.concatenate(x), np.array([len(v) for v in x]))
    sought, some = similar._Sought([f"s{i}" for i in range(len(rows))], *lists(rows), 5), rows[:40]
    tracemalloc.start()
    sought.meet(pa.array([f"s{i}" for i in range(len(some))]), *lists(some))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x[0] for x in sought.names[:40]] == [f"s{i}" for i in range(40)] and peak < 20e6


def test_best_so_far_spares_most_pairs(monkeypatch):
    for name, value in (("LAYER", 256), ("LIST_GRAMS", 500), ("SPARED", 40)):
        monkeypatch.setattr(similar, name, value, raising=False)
    r = np.random.default_rng(8)
    draw = lambda: np.unique((400 * r.random(r.integers(2, 40)) ** 2).astype(np.int64))
    rows = [draw() for _ in range(2000)]
    rows += [np.unique(np.append(rows[i][1:], 500 + i % 7)) for i in range(500)]
    sides = [rows[i] for i in range(0, 2500, 25)] + [np.array([999])]
    lists = lambda x: (np.concatenate(x), np.array([len(v) for v in x]))
    sought, counted, every = similar._Sought([f"s{i}" for i in range(len(sides))], *lists(sides), 3), [], similar._Counted.shared

    def shared(self, code, owner, others):
        counted.append(others * len(self.sizes))
        return every(self, code, owner, others)

    monkeypatch.setattr(similar._Counted, "shared", shared)
    for at in range(0, len(rows), 500):
        sought.meet(pa.array([f"{i:04}" for i in range(at, at + 500)]), *lists(rows[at : at + 500]))
    for i, x in enumerate(sides):
        both = np.array([len(np.intersect1d(x, y)) for y in rows])
        size = np.array([len(x) + len(y) for y in rows]) - both
        score = (2 * similar.UNIT * both + size) // (2 * size)
        want = [j for j in np.argsort(-score, kind="stable")[:3].tolist() if score[j]]
        assert sought.best[i].tolist() == [*score[want].tolist(), 0, 0, 0][:3] and sought.names[i, : len(want)].tolist() == [f"{j:04}" for j in want]
    assert sum(counted) <= 500 * len(sides)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_redaction_looks_for_a_word_before_its_edges_and_walks_marks_once(spark):
    long = "the phone of ſ The other für Für theſe 13812345678 at 1.2.3.4, THE end; " * 300
    x = spark.createDataFrame([(0, long), (1, None), (2, ""), (3, "no sign")], "id int, text string").coalesce(1)
    r = x.select("id", "text", privacy.redacted(F.col("text"), "text", ("phone", "the", "für")).alias("r"))
    assert "slice(" not in _plan(r) and "(?iu)(?=the)" in _plan(r)
    rows = r.select("id", "text", "r", privacy.restored(F.col("r.text"), F.col("r.records"), 7).alias("back")).collect()
    assert all(x.back == x.text for x in rows)
    marks = {x.id: x.r.records for x in rows}
    assert len(marks[0]) == 300 * 8 and not marks[1] and not marks[2] and not marks[3]
    words = [x for x in marks[0] if x["pass"] == 5]
    assert [x.original for x in words[:3]] == ["the", "The", "THE"] and words[0].position == words[0].at == 0


def test_entity_hints_seek_each_kind_once(spark):
    x = spark.createDataFrame([("a@b.co+x@d.com https://u.v/q@z.zz #tag @me_2 123456789012 " * 7,), ("none",), (None,)], "t string")
    got = x.select(messages.entity_hints(F.col("t")).alias("hints"))
    assert _plan(got).count("regexp_extract_all(") == len(messages.ENTITIES)
    lines = [r.hints for r in got.collect()]
    assert lines[0].split("\n")[:4] == ["- urls: https://u.v/q@z.zz", "- emails: a@b.co, +x@d.com", "- handles: @me_2", "- hashtags: #tag"] and lines[1] == ""


def test_block_score_takes_the_words_once(spark):
    x = spark.createDataFrame([("Ein 报告 wort Wort wort 中x",)], "t string")
    got = x.select(rules.block_score(F.col("t"), F.lit("dm"), F.array(F.lit("dm"))).alias("s"))
    assert _plan(got).count("array_distinct(") - _plan(got).count("array_distinct(regexp_extract_all(") == 1
    assert x.select(text.word_ratio(F.col("t")).alias("r")).first().r == 6 / 8


def test_matches_settle_however_long_the_chain(spark):
    """Outputs of two classes by turns want the rows of one: rounds of proposals moved one place each, and gave up after 200."""
    out = [("s", i, "ship the release now" if i % 2 else "ship the releases now") for i in range(700)] + [("t", 1000, "else")]
    gold = [("s", i, "ship the release") for i in range(690)] + [("s", 5000, "ship the releases"), ("u", 6000, "ship the release")]
    kind = "session string, id int, text string"
    got = similar.matched(spark.createDataFrame(out, kind), spark.createDataFrame(gold, kind), ["session"], 0.5)
    want = {(i, i, "matched") for i in range(690)} | {(690, 5000, "matched"), (None, 6000, "missed"), (1000, None, "extra")} | {(i, None, "extra") for i in range(691, 700)}
    assert {tuple(x) for x in got.select("output_id", "golden_id", "kind").collect()} == want


def test_pairs_that_are_not_similar_take_no_disk(spark):
    r = random.Random(4)
    words = ["".join(r.choice("bcdfgklmnp") for _ in range(3)) for _ in range(60)]
    rows = [(i, " ".join(r.sample(words, 6))) for i in range(1500)]
    out, gold = (spark.createDataFrame([("s", *x) for x in some], "session string, id int, text string") for some in (rows, rows[:500]))
    dirs = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: sum(f.stat().st_size for d in dirs for f in Path(d).rglob("shuffle_*"))
    before = held()
    got = similar.matched(out, gold, ["session"], 0.25).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in got} == {"matched": 500, "extra": 1000}
    # about 350,000 of 750,000 pairs share a word
    assert held() - before < 4e6


def test_similar_texts_come_in_blocks_of_parts(spark, monkeypatch):
    for name, value in (("SHARE", 16), ("LEAST_SHARE", 8), ("BLOCK", 7), ("AT_ONCE", 5)):
        monkeypatch.setattr(similar, name, value)
    r = random.Random(6)
    texts = sorted({" ".join("".join(r.choice("abc") for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(1, 4))) for _ in range(150)}) + ["!!", "??"]
    a, b = [(k, i, t) for k in "xy" for i, t in enumerate(texts) if r.random() < 0.6], [(k, i, t) for k in "yz" for i, t in enumerate(texts) if r.random() < 0.6]
    got = similar.similar(spark.createDataFrame(a, "key string, a int, text string"), spark.createDataFrame(b, "key string, b long, text string"), 0.4)
    score = lambda s, t: s == t or len(grams(s) & grams(t)) >= 0.4 * max(1, len(grams(s) | grams(t)))
    rows = [(x.key, x.a, y) for x in got.collect() for y in x.b]
    assert sorted(rows) == sorted((k, i, j) for k, i, s in a for q, j, t in b if k == q and score(s, t)) and len(rows) > 200


def test_index_has_a_page_that_comes_in_two_segments(spark, tmp_path):
    rows = [("a", "Heit", None), ("b", None, "eine Einheit"), ("c", "hei", "t")]
    pages = spark.createDataFrame(spark.sparkContext.parallelize(rows * 2, 2), "slug string, title string, body string")
    postings.build(pages, str(tmp_path / "x"))
    assert sorted(r.slug for r in postings.candidates(spark, str(tmp_path / "x"), ["heit"]).collect()) == ["a", "b"]
    assert len(list(tmp_path.glob("x/*.parquet"))) == 2


def test_a_stream_of_messages_has_one_timer(monkeypatch):
    class State:
        def __init__(self):
            self.rows, self.timers = [], []

        getListState = getValueState = lambda self, *_: self
        appendList = lambda self, rows: self.rows.extend(rows)
        registerTimer = lambda self, at: self.timers.append(at)

    state, run = State(), blocks.Blocks(60, 100.0, 10, 600)
    run.init(state)
    rows = pd.DataFrame([(k, k, f"m{k}", "im", "dm/1", "a", 1.0, None, None) for k in range(50, 0, -1)], columns=blocks._NAMES)
    list(run.handleInputRows(("s",), iter([rows]), None))
    assert len(state.rows) == 50 and state.timers == [1000]


def test_near_titles_meet_by_numbers(spark):
    r = random.Random(3)
    titles = {"".join(r.choice("abAß") for _ in range(r.randrange(3, 12))) for _ in range(250)}
    for t in list(titles)[:60]:
        at = r.randrange(len(t))
        titles |= {t[:at] + t[at + 1 :] + r.choice("ab"), t[:at] + "x" + t[at:] + "y", "y" + t[:at] + t[at + 1 :]}
    x = spark.createDataFrame([(f"s{i}", "ab"[i % 2], t) for i, t in enumerate(sorted(titles))], "slug string, type string, title string")
    got = ledger.near_titles(x)
    assert "part#" not in _plan(got)
    n = F.least(F.length(F.lower("p.title")), F.length(F.lower("q.title")))
    both = x.alias("p").join(x.alias("q"), F.expr("p.type = q.type AND p.title < q.title AND length(p.title) >= 4 AND length(q.title) >= 4"))
    want = both.filter(F.levenshtein(F.lower("p.title"), F.lower("q.title")) <= F.when(n >= 8, 2).otherwise(1)).select("p.type", "p.title", "q.title", "p.slug", "q.slug")
    rows = sorted(map(tuple, want.collect()))
    assert len(rows) > 50 and sorted(map(tuple, got.select("type", "title_a", "title_b", "head_a", "head_b").collect())) == rows


def test_titles_are_not_held_by_the_driver(spark):
    """The table of titles looks small when it is compressed, and what is made of it was broadcast."""
    pages = [(f"p/{i:03}", "person" if i % 2 else "tool", f"Ann Li {i % 100:03}") for i in range(300)]
    pages = spark.createDataFrame(pages, "slug string, type string, title string")
    got = ledger.near_titles(pages)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString() and got.count() > 300
    got = ledger.merge_suggestions(pages)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.reason: r["count"] for r in got.groupBy("reason").count().collect()}["same_name"] == 200


def test_sizes_are_those_of_the_contract_without_a_match_for_each_word(spark):
    mixing = pytest.importorskip("engramlake.llm.mixing")
    texts = [None, "", " \t\n\x0b\f\r", "one", "  two  words\n", "a\x1cb c\xa0d", "\r\nx\x0by\fz ", "\x00 \x85  "]
    x = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    got = mixing.sized(x)
    assert "regexp" not in _plan(got).lower()
    assert [r["size"] for r in got.orderBy("doc_id").collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
