"""Stable snapshots, sources that fail when they are read, and the trigram index."""

import hashlib
import os
import random

from pyspark.sql import functions as F

from engramlake.operators import postings, records
from engramlake.sources import stable


def test_files_are_read_the_oldest_first_and_links_left_out(spark, tmp_path):
    want = []
    for k, text in enumerate(["a\nb\n", "", "é", "x" * (3 << 20)]):
        p = tmp_path / f"d{k % 2}" / f"{k}.jsonl"
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
        os.utime(p, ns=(10**18 - k * 10**12,) * 2)
        want.append((str(p), (10**18 - k * 10**12) // 10**6, len(text.encode()), text.count("\n") + 1, hashlib.sha256(text.encode()).hexdigest(), True, None))
    (tmp_path / "x.txt").write_text("no")
    (tmp_path / "link.jsonl").symlink_to(want[0][0])
    assert [tuple(r) for r in stable.stable_snapshots(spark, str(tmp_path), files_per_task=1).collect()] == want[::-1]
    (tmp_path / "none").mkdir()
    assert stable.stable_snapshots(spark, str(tmp_path / "none")).count() == 0


def test_a_file_that_grows_while_it_is_read_is_reported_and_not_hashed(tmp_path):
    p = tmp_path / "live.jsonl"
    p.write_text("one\n")

    def growing(path, mode):
        f = open(path, mode)
        with open(path, "a") as more:
            more.write("two\n")
        return f

    row = stable.snapshot(str(p), 5, growing)
    assert row[2:] == (None, None, None, False, "changed")
    assert stable.snapshot(str(p), 5)[2:4] == (8, 3)
    assert stable.snapshot(str(tmp_path / "gone"), 7) == (str(tmp_path / "gone"), 7, None, None, None, False, "FileNotFoundError")


def test_a_source_that_breaks_while_it_is_read_fails_alone(spark, tmp_path):
    good = spark.createDataFrame([(5, "c", "u", "x"), (9, "c", "u", "y")], "at_s long, channel string, contact string, content string")
    good.write.parquet(str(tmp_path / "broken"))
    for p in (tmp_path / "broken").glob("*.parquet"):
        data = p.read_bytes()
        p.write_bytes(data[:4] + b"\0" * (len(data) - 4))
    readers = {"good": lambda: good, "broken": lambda: spark.read.schema(good.schema).parquet(str(tmp_path / "broken")), "cast": lambda: good.withColumn("at_s", F.col("content").cast("long"))}
    every, states = records.collected(spark, readers, good.schema.simpleString())
    assert sorted(r.content for r in every.collect()) == ["x", "y"]
    found = {r.source: (r.ok, r.messages, r.cursor_s) for r in states.collect()}
    assert found == {"good": (True, 2, 9), "broken": (False, 0, None), "cast": (False, 0, None)}


def test_postings_rule_out_pages_and_lose_none(spark, tmp_path):
    r = random.Random(2)
    parts = ["Heit", "ung ", "ß", "中文字", "a", "b", " ", "zz"]
    pages = [(f"p{k}", r.choice([None, "", "Zz Heit"]), "".join(r.choice(parts) for _ in range(r.randrange(12))) if k % 9 else None) for k in range(120)]
    d = spark.createDataFrame(pages, "slug string, title string, body string")
    postings.build(d, str(tmp_path / "x"))
    for terms in (["heit"], ["heitung", "zz"], ["中文字"], ["ab"], ["nothing"], ["a", "heit"]):
        want = {s for s, t, b in pages if any(x is not None and all(w in x.lower() for w in terms) for x in (t, b))}
        assert {x.slug for x in postings.having(d, str(tmp_path / "x"), terms).collect()} == want
    assert postings.candidates(spark, str(tmp_path / "x"), ["ab"]) is None
    left = postings.candidates(spark, str(tmp_path / "x"), ["中文字"]).count()
    assert 0 < left == sum("中文字" in (b or "") for _, _, b in pages)
    postings.build(d.limit(0), str(tmp_path / "y"))
    assert postings.having(d, str(tmp_path / "y"), ["ab"]).count() == len([1 for _, _, b in pages if b and "ab" in b.lower()])


def test_probed_lists_find_nine_of_ten_neighbours(spark, tmp_path):
    from engramlake.operators import retrieval, vectors

    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame([(-1, None), (-2, [1.0]), (-3, [])], "vec_id long, embedding array<float>").select(F.col("vec_id").cast(v.schema["vec_id"].dataType), F.col("embedding").cast(v.schema["embedding"].dataType))
    path = str(tmp_path / "x")
    vectors.build(v.unionByName(odd), path, lists=16)
    assert spark.read.parquet(f"{path}/lists").count() == v.count() + 3
    queries = [r.embedding for r in v.filter("vec_id % 20 = 0").limit(12).collect()]
    found = vectors.recall(spark, path, v, queries, probes=10)
    assert found >= 0.9, found
    assert vectors.recall(spark, path, v, queries[:3], probes=16) == 1
    assert [tuple(r) for r in vectors.probed(spark, path, queries[0], 5, 16).collect()] == [tuple(r) for r in retrieval.nearest(v, queries[0], 5).collect()]
    vectors.build(v.limit(0), str(tmp_path / "y"))
    assert vectors.probed(spark, str(tmp_path / "y"), queries[0]).count() == 0
