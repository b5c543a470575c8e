"""Sources on files: transcripts in three dialects, chat pages, vaults."""

import json

from pyspark.sql import functions as F

from engramlake.functions import messages as M
from engramlake.operators import identity as I
from engramlake.operators import schedule as D
from engramlake.operators import synthesis as S
from engramlake.sources import chat, transcripts, vault


def lines(folder, name, records):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")


def test_dialect_a_reads_files_and_skips_bad_lines(spark, tmp_path):
    head = {"type": "user", "uuid": "u", "timestamp": "t1", "sessionId": "s1"}
    lines(tmp_path, "p/one.jsonl", [
        {**head, "message": {"role": "user", "content": "[\"not blocks\"]"}},
        "{broken", "7", {"type": "permission-mode"},
        {**head, "type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool", "x": 1}, {"type": "text", "text": "b"}]}},
        {**head, "type": "assistant", "message": {"role": "assistant", "content": [{"type": "tool"}]}},
        {**head, "uuid": None, "message": {"role": "user", "content": "no uuid"}},
    ])
    x = transcripts.scan(spark, str(tmp_path))
    got = [(r.line, r.session, r.contact, r.content) for r in transcripts.dialect_a(x).orderBy("line").collect()]
    assert got == [(1, "s1", "user", "[\"not blocks\"]"), (5, "s1", "assistant", "a\n\nb")]
    assert [(r.line, r.reason) for r in transcripts.bad_lines(x).orderBy("line").collect()] == [(2, "invalid"), (3, "no object")]
    snap = transcripts.snapshots(spark, str(tmp_path)).first()
    assert snap.lines == 7 and len(snap.hash) == 64


def test_dialect_b_keeps_a_user_text_once_and_drops_system_texts(spark):
    item = lambda role, kind, text: json.dumps({"type": "response_item", "timestamp": "t", "payload": {"role": role, "content": [{"type": kind, "text": text}]}})
    rows = [
        ("f", 1, item("user", "input_text", "Hello")), ("f", 2, json.dumps({"type": "event_msg", "timestamp": "t", "payload": {"type": "user_message", "message": "hello "}})),
        ("f", 3, item("user", "input_text", " <permissions x")), ("f", 4, item("assistant", "output_text", "hi")), ("g", 1, item("assistant", "output_text", "hi")),
        ("g", 2, item("system", "text", "no")), ("g", 3, json.dumps({"type": "session_meta", "payload": {"id": "x"}})),
    ]
    x = spark.createDataFrame(rows, "file string, line long, text string")
    assert {(r.file, r.line, r.content) for r in transcripts.dialect_b(x).collect()} == {("f", 1, "Hello"), ("f", 4, "hi"), ("g", 1, "hi")}


def test_segments_keep_order_and_budget(spark):
    m = spark.createDataFrame([("s", 1, 60.0), ("s", 2, 50.0), ("s", 3, 150.0), ("s", 4, 10.0), ("s", 5, 80.0)], "session string, msg long, tokens double")
    assert {r.msg: r.segment for r in transcripts.segments(m, 100.0).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4}


def test_chat_pages_and_contents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"code": 0, "data": {"items": [{"message_id": "m1"}, {"message_id": "m2"}], "has_more": False}}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"code": 99, "msg": "no"}))
    assert sorted(r.message_id for r in chat.scan(spark, str(tmp_path), "struct<message_id string>").collect()) == ["m1", "m2"]
    rows = [("text", '{"text":"x"}'), ("text", "not json"), ("post", '{"title":"T","content":[[{"text":"a"},{"tag":"at"}],[{"text":"b"}]]}'), ("file", "{}"), ("text", None), ("poll", '{"q":1}')]
    df = spark.createDataFrame(rows, "k string, raw string").select(chat.decoded(F.col("k"), F.col("raw")).alias("c"))
    assert [r.c for r in df.collect()] == ["x", "not json", "T a b", "[文件]", "", '{"q":1}']


def test_a_cursor_stays_below_the_oldest_failure(spark):
    df = spark.createDataFrame([("a", True, 5), ("a", False, 3), ("b", False, 9), ("c", True, 4)], "k string, ok boolean, at long")
    assert {r.k: r.cursor for r in chat.clamped_cursor(df, ["k"], "ok", "at").collect()} == {"a": 2, "b": None, "c": 4}


def test_a_vault_survives_a_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([("knowledge/a", "A: b", "task", "text\n---\nmore"), ("x/b", None, None, None)], "slug string, title string, type string, body string")
    tags = spark.createDataFrame([("knowledge/a", "t2"), ("knowledge/a", "t1")], "slug string, tag string")
    links = spark.createDataFrame([("knowledge/a", "x/b", "mentions")], "src string, dst string, link_type string")
    r = vault.rendered(pages, tags, links)
    vault.write(r, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert {(x.slug, x.content) for x in r.collect()} == {(x.slug, x.content) for x in back.collect()}
    (tmp_path / "vault" / ".hidden").mkdir(parents=True)
    for x in back.collect():
        (tmp_path / "vault" / (x.slug.replace("/", "-") + ".md")).write_text(x.content)
    (tmp_path / "vault" / ".hidden" / "c.md").write_text("no")
    (tmp_path / "vault" / "empty.md").write_text(" \n")
    found = vault.scan(spark, str(tmp_path / "vault")).withColumn("f", vault.fields(F.col("content"))).withColumn("b", vault.body(F.col("content")))
    got = {(r.f["title"], r.f["type"], r.f["tags"], r.b) for r in found.collect()}
    assert got == {("A: b", "task", "[t1, t2]", "text\n---\nmore\n[[mentions:x/b]]"), ("", "", "[]", "")}


def test_entities_of_all_kinds(spark):
    text = "mail a.b@c.org or @ann, see https://x.org/a@b.com #tag 138-1234-5678 id 123456789012"
    got = {(r.type, r.value) for r in spark.range(1).select(F.inline(M.entities(F.lit(text)))).collect()}
    assert {("email", "a.b@c.org"), ("handle", "@ann"), ("url", "https://x.org/a@b.com"), ("hashtag", "#tag"), ("ticket_id", "123456789012")} <= got
    assert ("email", "a@b.com") not in got and ("handle", "@c.org") not in got


def test_redactions_restore_the_text(spark):
    text, pattern = "call 13812345678 or 13912345678.", r"1[3-9]\d{9}"
    m = spark.range(1).select(M.redactions(F.lit(text), "phone", pattern).alias("m")).first().m
    assert [text[x.position : x.position + len(x.original)] for x in m] == ["13812345678", "13912345678"]


def test_rewritten_slugs_keep_their_order_once(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a2", "c"]), (2, [])], "id long, s array<string>")
    moves = spark.createDataFrame([("a2", "a"), ("b", "z")], "was string, now string")
    assert {r.id: r.s for r in I.rewritten(rows, "id", "s", moves).collect()} == {1: ["a", "z", "c"], 2: []}


def test_chains_end_at_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")], "src string, dst string")
    got = S.ordered_chain(e, spark.createDataFrame([("a",)], "slug string")).collect()
    assert {(r.slug, r.place) for r in got} == {("a", 1), ("b", 2), ("c", 3)}


def test_no_hit_injects_nothing(spark):
    df = spark.createDataFrame([("a", "A", 0.4, "x")], "slug string, title string, score double, snippet string")
    assert S.injected(df).count() == 0 and S.injected(df, least=0.1).first().text == "- [a] A: x"


def test_runs_are_classified(spark):
    df = spark.createDataFrame([(1, 0, False), (1, 1, False), (0, 1, False), (0, 0, True)], "ok int, failed int, fatal boolean")
    assert [r.x for r in df.select(D.run_result().alias("x")).collect()] == ["ok", "partial", "failed", "failed"]
