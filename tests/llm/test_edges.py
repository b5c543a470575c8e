"""Defined results at the edges (nulls, empty and long texts, ties, repeats, empty tables, clashing columns), and results against plain programs."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engramlake.llm import decontam, langid, linededup, mixing, neardup, quality, tokens, toxicity, urlfilter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n, vocabulary=300):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


# 1


def test_items_repeat_and_share_texts_and_ids_may_be_null(spark):
    item = " ".join(words(1, 30))
    bench = spark.createDataFrame([(1, item, 0), (1, item, 0), (2, item, 1), (None, item, 2), (3, " ".join(words(2, 30)), 3)], "item_id long, text string, similarity int")
    d = docs(spark, [(None, item, "a"), (5, item, "a"), (5, item, "a"), (6, None, "a")]).withColumn("item_id", F.lit(1))
    got = Counter((r.doc_id, r.item_id) for r in decontam.contaminated(d, bench, block_chars=20).collect())
    assert got == Counter({(i, j): n * m for i, n in ((None, 1), (5, 2)) for j, m in ((1, 2), (2, 1), (None, 1))})
    left = decontam.decontaminate(d, bench)
    assert left.columns == d.columns and [r.doc_id for r in left.collect()] == [6]


# 2


def plain_segments(v, lo, hi):
    best = max(((sum(v[i:j]), -(j - i), -i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    i, j = -best[2], best[3]
    return plain_segments(v, lo, i) + [(i, j, best[0])] + plain_segments(v, j, hi)


def test_toxicity_scores_equal_a_plain_program_and_edges_hold(spark):
    r = random.Random(6)
    rows = []
    for i in range(240):
        w = words(i, 25)
        if i % 3 == 0:
            w[5:5] = [r.choice(["scum", "filth"]), r.choice(["scum", "filth"])]
        rows.append((i, " ".join(w), "a"))
    rows += [(7, rows[0][1], "a"), (None, rows[3][1], "a"), (900, None, "a"), (901, "", "a")]
    d = docs(spark, rows).withColumn("score", F.lit(9)).withColumn("label", F.lit(9))
    known = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)] * 2, "doc_id long, toxic int")
    model = toxicity.fit(d, known, F.lit(True))
    got = Counter((x.doc_id, round(x.score, 9)) for x in toxicity.score(d, model).collect())
    want = Counter()
    for i, t, _ in rows:
        w = tokens.words(pa.array([t], pa.string()), toxicity.PREFIXES)
        f = toxicity.features(w)
        v = [max(float(model.weights[b]) for b in f[:, k]) for k in range(f.shape[1])]
        each = [model.lam * s - np.log(model.k * len(v)) for _, _, s in plain_segments(v, 0, len(v))]
        sure = [e for e in each if e > -np.log(toxicity.ALPHA)]
        e = sum(sure) if sure else max(each, default=-np.inf)
        want[i, round(float(model.probability[toxicity.bin_of(e)]), 9)] += 1
    assert got == want
    assert toxicity.score(d.limit(0), model).count() == 0
    assert toxicity.fit(d.limit(0), known, F.lit(True)).probability.max() == 0


# 3


def test_targets_equal_filling_by_steps(spark):
    r = random.Random(2)
    for _ in range(3):
        sizes = {None if k == 5 else f"s{k}": r.randrange(1, 4000) for k in range(6)}
        d = docs(spark, [(k, " ".join(["w"] * n), s) for k, (s, n) in enumerate(sizes.items())])
        got = {x.source: x.target for x in mixing.targets(mixing.sized(d)).collect()}
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
        target, open_, left = {}, list(order), 1.5 * sum(sizes.values())
        while open_:
            share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            full = [s for s in open_ if share[s] >= 2 * sizes[s]]
            if not full:
                target |= share
                break
            for s in full:
                target[s] = 2.0 * sizes[s]
            left, open_ = left - sum(2.0 * sizes[s] for s in full), [s for s in open_ if s not in full]
        assert got == pytest.approx(target)


def test_slots_are_dealt_once_and_blocks_evenly(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_DOCS", 7)
    monkeypatch.setattr(mixing, "RUN", 3)
    monkeypatch.setattr(mixing, "STRETCH", 5)
    rows = [(i % 50 if i % 9 else None, " ".join(words(i, 20 + i % 90)), "ab"[i % 5 > 0]) for i in range(150)] + [(1, " ".join(words(1, 21)), "b")] * 9
    d = docs(spark, rows).withColumn("sid", F.lit("x")).withColumn("chunk", F.lit(None).cast("int")).withColumn("size", F.lit(0))
    base = mixing.sized(d)
    sources = mixing.targets(base)
    placed = mixing.chunked(mixing.unpiled(base, None), sources, 7)
    chunks = mixing.directory(placed, 16)
    counts = mixing.slot_counts(sources, chunks)
    total = counts.first()["all"]
    drawn = mixing.draws(counts, total, shard_slots=64)
    assert {x.shard: x.s for x in drawn.groupBy("shard").agg(F.sum("n").alias("s")).collect()} == {k: min(64, total - 64 * k) for k in range(-(-total // 64))}
    many = {x.sid: (x.slots, x.blocks) for x in counts.collect()}
    js = {}
    for x in mixing.slots(counts, drawn, total).collect():
        js.setdefault(x.sid, []).append(x.j)
    assert {k: sorted(v) for k, v in js.items()} == {k: list(range(n)) for k, (n, _) in many.items()}
    taken = mixing.in_chunks(mixing.slot_blocks(counts, mixing.slots(counts, drawn, total)), chunks).collect()
    of = {(x.sid, x.chunk): x for x in chunks.collect()}
    for sid, (n, blocks) in many.items():
        mine = [x for x in taken if x.sid == sid]
        assert len(mine) == n and {-(-n // blocks), n // blocks} >= set(Counter(x.block for x in mine).values())
        assert all(of[sid, x.chunk].base + x.k == x.block and 0 <= x.k < of[sid, x.chunk].blocks for x in mine)
    rows_ = mixing.mix(d, block_words=16, shard_slots=64).collect()
    assert len(rows_) == len(rows) and sorted(map(str, rows_)) == sorted(map(str, mixing.mix(d, block_words=16, shard_slots=64).collect()))
    assert all(0 <= x.taken <= 2 * x["size"] for x in rows_)


# 4


def test_long_and_repeated_urls(spark):
    far = "https://a.example.net/en/" + "x" * 100_000
    p = spark.createDataFrame([(1, far), (1, far), (None, far), (2, "https://" + "h." * 30_000 + "org/fr/")], "page_id long, url string")
    got = Counter((r.page_id, r.rule, r.verdict) for r in urlfilter.judge_urls(p).collect())
    assert got == Counter({(1, "example.net/en/", "allow"): 2, (None, "example.net/en/", "allow"): 1, (2, "org/fr/", "allow"): 1})


# 5


def test_near_duplicates_with_null_and_repeated_ids(spark):
    a, b, c = " ".join(words(1, 80)), " ".join(words(1, 80)[:78] + ["new", "end"]), " ".join(words(9, 80))
    d = docs(spark, [(4, a, "a"), (4, a, "a"), (None, b, "a"), (2, c, "a"), (2, b, "a"), (7, None, "a"), (None, None, "a"), (9, "", "a"), (8, " ", "a")])
    rows = neardup.classes(d).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in rows) == Counter({(4, 2, 4): 2, (None, 2, 4): 1, (2, 2, 4): 1, (2, 2, 1): 1, (7, 7, 1): 1, (None, None, 1): 1, (9, 9, 1): 1, (8, 8, 1): 1})
    kept = Counter((r.doc_id, r.text) for r in neardup.keep_one(d).collect())
    assert kept[2, b] == 1 and kept[2, c] == 1 and kept[4, a] == 0 and kept[None, b] == 0 and kept[7, None] == kept[None, None] == 1


def test_maps_never_exclude_a_near_pair(spark):
    r = random.Random(1)
    rows, want = [], 0
    for k in range(40):
        n = r.choice([6, 60, 70, 200, 3000])
        w = words(k, n, 10**6)
        v = list(w)
        for _ in range(r.randrange(0, 1 + n // 40)):
            v[r.randrange(n)] = "edit"
        v += ["more"] * r.randrange(0, 1 + n // 10)
        rows += [(2 * k, " ".join(w), "a"), (2 * k + 1, " ".join(v), "a")]
    sets = spark.createDataFrame([(f"{i}".encode(), t, [1]) for i, t, _ in rows], "node binary, text string, bands array<long>").mapInArrow(neardup._shingles(5), neardup._SETS)
    pairs = spark.createDataFrame([(f"{2 * k}".encode(), f"{2 * k + 1}".encode()) for k in range(40)], "a binary, b binary")
    side = lambda x: sets.select(F.col("node").alias(x), F.col("map").alias(f"map_{x}"), F.col("n").alias(f"n{x}"))
    fits = {(x.a, x.b): x.ok for x in pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", (neardup._fits("na", "nb", 0.8) & neardup._possible(0.8)).alias("ok")).collect()}
    for x in neardup.similarities(pairs, sets).collect():
        want += x.sim >= 0.8
        assert fits[x.a, x.b] or x.sim < 0.8
    assert 5 < want < 40 and not all(fits.values())


# 6


def test_quality_of_empty_tables_long_texts_and_clashing_names(spark):
    long = " ".join("".join(random.Random(i).choices("abcdefgh", k=5)) for i in range(30_000))
    d = docs(spark, [(1, long, "a"), (1, long, "a"), (None, "x", "a")]).withColumn("quality_book", F.lit(1)).withColumn("failed", F.lit(2)).withColumn("m", F.lit(3))
    kept = quality.filter_documents(d)
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [1, 1]
    book = quality.ledger(d.limit(0))
    assert quality.apply_policy(book).count() == 0 and quality.filter_documents(d.limit(0)).count() == 0


# 8


def test_languages_equal_plain_distances_and_edges_hold(spark):
    r = random.Random(3)
    make = lambda a: " ".join("".join(r.choice(a) for _ in range(r.randrange(2, 8))) for _ in range(30))
    rows = [(i, make("aeioutn" if i % 2 else "aeiouqk"), "aa" if i % 2 else "bb") for i in range(60)] + [(60, "a", None), (61, "a", None), (None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit("x"))
    p = langid.learn(d, F.col("doc_id") < 40)
    got = {x.doc_id: (x.lang_pred, round(x.score, 9)) for x in langid.predict(d, p).collect()}
    for i, t, _ in rows[:60]:
        of, gram, count = langid.gram_counts(pa.array([t]))
        mine = [g for _, g in sorted(zip((-count).tolist(), gram.tolist()))][: p.top]
        dist = []
        for grams, ranks in zip(p.grams, p.ranks):
            place = dict(zip(grams.tolist(), ranks.tolist()))
            dist.append(sum(abs(place[g] - k) if g in place else p.top for k, g in enumerate(mine)))
        best = dist.index(min(dist))
        score = 1 - dist[best] / max(2 * sorted(dist)[1], 1e-9)
        assert got[i] == (p.langs[best], round(min(max(score, 0), 1), 9))
    assert got[60] == got[61] and got[None] == ("und", 0.0) and langid.predict(d.limit(0), p).count() == 0


def test_languages_of_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    out = langid.predict(d, langid.learn(d, ~held)).join(d.filter(held & F.col("lang").isNotNull()).select("doc_id", "lang", "text"), "doc_id")
    right = out.filter("text rlike '[a-zA-Z]'").groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("r"), F.count(F.lit(1)).alias("n")).collect()
    assert len(right) >= 3 and all(x.r >= 0.9 for x in right if x.n >= 20)


# 9


def test_line_dedup_by_broadcast_and_by_shuffle(spark, monkeypatch):
    rows = [(i, f"menu\n{' '.join(words(i, 9))}\nfoot {i % 3}", None if i % 4 == 0 else "h") for i in range(60)] + [(None, None, "h"), (3, "", None)]
    got = []
    for most in (0, 10**6):
        monkeypatch.setattr(linededup, "MOST_LINES", most)
        got.append(sorted(map(str, linededup.dedup_lines(docs(spark, rows), F.col("source")).collect())))
    assert got[0] == got[1] and any("n_dropped=2" in x for x in got[0])


# 10


def test_warc_ids_repeat_and_tables_join_either_way(spark, tmp_path, monkeypatch):
    rows = [(1, "u", "x" * 200), (1, "u", "y" * 200), (1, "u", "x" * 200), (None, "u", "x" * 200), (4, "u", "x" * 200), (4, None, None), (9, "u", "z" * 40_000), (8, "u", "z" * 40_000)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    for k, most in enumerate((0, 10**6)):
        monkeypatch.setattr(warc, "MOST_SHARED", most)
        warc.write(p, str(tmp_path / f"w{k}"))
        got = Counter((r.capture_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.assemble(warc.read(spark, str(tmp_path / f"w{k}"))).collect())
        assert got == Counter({
            (1, 200, "response", None): 3, (None, 200, "revisit", 1): 1, (4, 200, "revisit", 1): 1, (4, 0, "response", None): 1,
            (8, 40_000, "response", None): 1, (9, 40_000, "revisit", 8): 1,
        })
    warc.write(p.limit(0), str(tmp_path / "none"))
    assert warc.assemble(warc.read(spark, str(tmp_path / "none"))).count() == 0


def test_piles_of_equal_rows_lie_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 100)
    same = " ".join(words(1, 21))
    rows = [(1, same, "a")] * 1500 + [(None, same, None)] * 400 + [(k, " ".join(words(k, 5 + k % 40)), "ab"[k % 2]) for k in range(150)] + [(2, None, "a")] * 200
    d = docs(spark, rows).repartition(5)
    base = mixing.sized(d)
    heaps, n = mixing.piles(base, 100)
    assert n == 2 and {(r.of, r.id): r.many for r in heaps.collect()} == {("a", 1): 1500, (None, None): 400}
    sources = mixing.targets(base)
    for few in (True, False):
        placed = mixing.chunked(mixing.unpiled(mixing.sized(d, "text"), heaps, few), sources)
        assert placed.count() == len(rows) - 200 and placed.filter(F.col("text").isNull()).count() == 0
        most = placed.filter("doc_id = 1 AND size = 21").groupBy("sid", "chunk").count().agg(F.max("count"), F.count("count")).first()
        assert most[1] >= 10 and most[0] < 300
    monkeypatch.setattr(mixing, "MOST_SOURCES", 1)
    got = mixing.mix(d).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").split())) for i, t, _ in rows)
    for s in {r.source_size for r in got}:
        mine = [r for r in got if r.source_size == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 64 * 20 and all(r.taken <= 2 * r.size for r in mine)


def test_crowded_buckets_are_settled_by_rare_shingles(spark, monkeypatch):
    """Texts that share a template, and near copies among them: classes are those of brute force, and few pairs are compared."""
    monkeypatch.setattr(neardup, "LARGE", 4)
    r = random.Random(9)
    template = [f"t{k}" for k in range(60)]
    texts = []
    for k in range(120):
        w = template + [f"u{k}x{j}" for j in range(r.randrange(20, 40))]
        texts.append(w)
        if k % 6 == 0:
            texts.append(w[:-1] + ["edit"])
    texts += [["a"] * 30 + [f"v{k}x{j}" for j in range(4)] for k in range(8)]
    grams = [Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in texts]
    sim = lambda x, y: sum((x & y).values()) / sum((x | y).values())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sim(grams[i], grams[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    met = []
    kept = neardup._rare_pairs
    monkeypatch.setattr(neardup, "_rare_pairs", lambda *a: (met.append(kept(*a)), met[-1])[1])
    d = docs(spark, [(k, " ".join(w), "a") for k, w in enumerate(texts)])
    # bands of one row, so that the template alone puts texts into a bucket
    got = {x.doc_id: x.class_id for x in neardup.classes(d, bands=16, rows=1).collect()}
    assert got == {k: find(k) for k in range(len(texts))}
    assert met and met[0].count() <= 4 * len(texts)
