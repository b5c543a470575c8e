"""The pipeline operators against brute force, round trips and held-out accuracy, and their defined edge results."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engramlake.llm import bagminhash as bmh
from engramlake.llm import chat, decontam, langid, linededup, mixing, neardup, quality, queries, tokens, toxicity, urlfilter, warc

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def docs(spark, texts, source=lambda i: "a", lang=lambda i: "en"):
    return spark.createDataFrame([(i, t, lang(i), source(i), len(t or "")) for i, t in enumerate(texts)], DOCS)


def plain(rows):
    return sorted(tuple("NULL" if v is None else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        p = Path(DATA, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    got = queries.queries()[name](spark, DATA)
    cur = con.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in cur.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain(got.select(*columns).collect()) == plain(cur.fetchall())


# words


def test_words_split_at_separators_and_hash_alike():
    w = tokens.words(pa.array(["One, two THREE", None, "", "one…two"]), (2,))
    assert w.lengths().tolist() == [3, 0, 0, 2]
    assert w.hash[0] == w.hash[3] and w.hash[1] == w.hash[4] and len(set(w.hash.tolist())) == 3
    assert w.prefix.shape == (1, 5)


def test_plain_words_of_slices_keep_what_is_beyond_ascii():
    texts = pa.array(["x" * 1000, "One, TWÖ three…four", "one"])
    for k in range(3):
        w = tokens.words(texts.slice(k), plain=True)
        assert w.lengths().tolist() == [1, 3, 1][k:]
    w = tokens.words(texts.slice(1), plain=True)
    assert w.hash[0] == w.hash[3] and w.hash[1] != tokens.words(pa.array(["twö"]), plain=True).hash[0]


# 1 decontamination


def test_alignment_equals_the_table_filled_cell_by_cell():
    r = np.random.default_rng(1)
    for _ in range(20):
        a, b = r.integers(1, 5, r.integers(3, 12)).astype(np.uint64), r.integers(1, 5, r.integers(5, 30)).astype(np.uint64)
        best = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = max(0, best[i, j] + (1 if a[i] == b[j] else -1), best[i, j + 1] - 1, best[i + 1, j] - 1)
        score, _ = decontam.align(a[None, :], b[None, :], np.array([len(b)]))
        assert score[0] == best.max()


def test_alignment_of_a_long_item_in_a_very_long_text():
    for width in (32_000, 34_000):
        b = np.arange(10, 10 + width, dtype=np.uint64)
        score, end = decontam.align(b[None, -1500:], b[None, :], np.array([width]))
        assert (score[0], end[0]) == (1500, width - 1)


def test_decontamination_finds_copies_and_edits_only(spark):
    items = [words(k, 40) for k in range(6)]
    edited = list(items[1])
    for i in (5, 13, 22, 30, 37):
        edited[i] = "changed"
    texts = [
        " ".join(words(100, 300) + items[0] + words(101, 300)), " ".join(words(102, 50) + edited),
        " ".join(words(103, 400)), " ".join(items[2][:15] + words(104, 60)), None, "", " ".join(items[3]), " ".join(items[3]),
        " ".join(words(105, 5000) + items[4][:20] + ["and", "so"] + items[4][20:]),
    ]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(6, None), (7, ""), (8, "two words"), (9, " ".join(items[3]))], "item_id long, text string")
    d = docs(spark, texts).withColumn("similarity", F.lit(1))
    got = decontam.contaminated(d, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(0, 0), (1, 1), (6, 3), (7, 3), (6, 9), (7, 9), (8, 4)}
    assert got.filter("doc_id = 0").first().doc_from == 300
    kept = decontam.decontaminate(d, bench, block_chars=300)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {2, 3, 4, 5}
    assert decontam.contaminated(d.limit(0), bench).count() == 0 and decontam.contaminated(d, bench.limit(0)).count() == 0


def test_decontamination_equals_alignment_of_all_pairs(spark):
    r = random.Random(3)
    items = [words(200 + k, m, 300) for k, m in enumerate([3, 4, 5, 7, 10, 11, 12, 20, 40, 60, 60])]
    texts = [" ".join(w + (" new" if i % 3 == 2 else "") for i, w in enumerate(items[-1])), " ".join(items[2][:2] + ["other"] + items[2][3:])]
    for k in range(300):
        edited, share = [], r.uniform(0, 0.3)
        for i, w in enumerate(items[k % len(items)]):
            kind = r.choice("rid") if r.random() < share else ""
            edited += [] if kind == "d" else [f"x{r.randrange(99)}"] if kind == "r" else [w, f"x{r.randrange(99)}"] if kind == "i" else [w]
            edited += ["ins"] * (k % 7 == 0 and i % 3 == 1)
        texts.append(" ".join(words(1000 + k, r.randrange(200), 300) + edited + words(2000 + k, r.randrange(200), 300)))
    hashes = [tokens.words(pa.array([x])).hash for x in texts]
    want = set()
    for j, item in enumerate(items):
        a = tokens.words(pa.array([" ".join(item)])).hash
        for i, b in enumerate(hashes):
            if decontam.align(a[None, :], b[None, :], np.array([len(b)]))[0][0] >= 0.6 * len(a) - 1e-9:
                want.add((i, j))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.contaminated(docs(spark, texts), bench).collect()}
    assert got == want and (0, 10) in got and (1, 2) in got


# 2 toxicity


def test_maximal_segments_equal_brute_force():
    def brute(v, lo, hi):
        """All maximal scoring segments of v[lo:hi]: the best one (shortest), then those on either side of it."""
        best = max(((sum(v[i:j]), -(j - i), -i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        i, j = -best[2], best[3]
        return brute(v, lo, i) + [(i, j, best[0])] + brute(v, j, hi)

    r = random.Random(3)
    for _ in range(200):
        v = [r.choice([-3.1, -1.3, -0.27, 0.51, 2.03, 4.7]) + r.random() / 7 for _ in range(r.randrange(1, 22))]
        got = toxicity.maximal_segments(np.array(v))
        assert [(b, e) for b, e, _ in got] == [(b, e) for b, e, _ in brute(v, 0, len(v))]


def test_toxicity_learns_and_finds_passages(spark):
    bad = ["scum", "clown", "filth", "moron"]
    r = random.Random(5)
    texts, labels = [], []
    for i in range(600):
        w = words(i, 60, 300)
        if i % 4 == 0:
            for _ in range(3):
                w.insert(r.randrange(60), r.choice(bad))
        texts.append(" ".join(w))
        labels.append((i, 1, int(i % 4 == 0)))
    d = docs(spark, texts + [None, "", "..."])
    known = spark.createDataFrame(labels + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, known, F.col("doc_id") % 5 != 0)
    out = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    held = [i for i in range(0, 600, 5)]
    assert np.mean([(out[i].score >= 0.5) == (i % 4 == 0) for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out.values()) and len(out) == 603
    assert {out[i].score for i in (600, 601, 602)} == {out[600].score} and out[600].score < 0.5
    found = out[0].passages
    assert found and any(b in texts[0].lower().encode()[found[0].begin : found[0].end].decode() for b in bad)
    none = toxicity.fit(d, known.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(d, none).collect()} == {0.0}


# 3 mixing


def test_mix_meets_targets_and_caps_and_reruns_agree(spark):
    texts = [" ".join(words(i, 1 + i * 7 % 200)) for i in range(600)] + [None, "", " ".join(words(9, 3000))]
    d = docs(spark, texts, source=lambda i: None if i % 10 == 9 else "abc"[i % 7 % 3])
    rows = mixing.mix(d).collect()
    assert len(rows) == len(texts) and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(d).collect()))
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    assert all(r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"] for r in rows)
    groups = {}
    for r in rows:
        groups.setdefault((r.source_size, r.target), []).append(r.taken)
    assert len(groups) == 4
    for (total, target), taken in groups.items():
        assert target <= 2 * total + 1e-6 and abs(sum(taken) - target) <= 0.1 * target + 130
    assert sum(t for _, t in groups) == pytest.approx(1.5 * sum(size.values()), rel=1e-9)
    assert mixing.mix(d.limit(0)).count() == 0


def test_mixed_corpus_holds_the_words_of_its_spans(spark):
    texts = [" ".join(words(i, 1 + i * 7 % 200)) for i in range(200)] + [None, "", " ".join(words(9, 1000)), "a\t b\n\nc "]
    d = docs(spark, texts, source=lambda i: None if i % 10 == 9 else "abc"[i % 7 % 3])
    rows = mixing.mixed(d, shard_slots=100).collect()
    count, streams = Counter(), {}
    for i, t in enumerate(texts):
        streams.setdefault(None if i % 10 == 9 else "abc"[i % 7 % 3], []).append(i)
    size = {k: sum(len((texts[i] or "").split()) for i in v) for k, v in streams.items()}
    for r in rows:
        parts = []
        for x in r.spans:
            at = x.at - x.start
            parts += texts[x.doc_id].split()[at : at + x.words]
            count[x.doc_id] += x.words
            assert x.doc_id in streams[r.source]
        assert r.text.split(" ") == parts and len(parts) == min(64, size[r.source] - 64 * r.block)
    assert {r.taken for r in mixing.mix(d, shard_slots=100).collect()} != {0}
    assert {r.doc_id: r.taken for r in mixing.mix(d, shard_slots=100).collect()} == {i: count[i] for i in range(len(texts))}
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r.slot)
    assert len(shards) > 1 and all(sorted(v) == list(range(len(v))) and len(v) <= 100 for v in shards.values())


# 4 URL filters


def test_globs_equal_regular_expressions():
    globs = ("a*b", "**/x?z", "*.net/**", "abc", "", "**", "?" * 70, "a**" + "q" * 66, "*ab*/c")
    text = ["ab", "a/b", "axxb", "q/r/xyz", "xyz", "/x/z", "m.net/a/b", ".net/", "abc", "", "p" * 70, "a" + "zz/" * 9 + "q" * 66, "xaby/c", "ä?/xäz"]
    met = urlfilter.run(pa.array(text), urlfilter.compile_globs(globs))

    def regex(g):
        return re.compile(b"".join({b"**": b"(?s:.*)", b"*": b"[^/]*", b"?": b"[^/]"}.get(t, re.escape(t)) for t in re.findall(rb"\*\*|.", g.encode(), re.S)))

    for i, t in enumerate(text):
        for k, g in enumerate(globs):
            assert met[i, k] == bool(regex(g).fullmatch(t.encode())), (t, g)


def test_url_rules_and_edges(spark):
    urls = ["https://EXAMPLE.net/en/a", "http://x.example.net/fr/", "https://a.b.org/fr/x?q", "https://net?x", "nothing", None, "https://badnet/", "https://x.com/a.net/"]
    p = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(p).collect()}
    assert [got[i] for i in range(8)] == [
        ("example.net/en/", "allow"), ("net/", "block"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"),
        (None, "allow"), (None, "allow"),
    ]
    assert urlfilter.judge_urls(p.limit(0)).count() == 0


# 5 near duplicates


def test_signatures_estimate_weighted_jaccard():
    a, b = Counter(words(1, 400, 60)), Counter(words(1, 300, 60) + words(2, 100, 60))
    keys = sorted(set(a) | set(b))
    code = {k: tokens.mix(np.array([i + 1], np.uint64))[0] for i, k in enumerate(keys)}
    flat = [(code[k], o, n) for o, c in enumerate((a, b)) for k, n in c.items()]
    g, o, c = (np.array(x) for x in zip(*flat))
    sig = bmh.signatures(g.astype(np.uint64), o, c, 2, 2000)
    want = sum((a & b).values()) / sum((a | b).values())
    assert abs((sig[0] == sig[1]).mean() - want) < 0.05


def test_classes_equal_brute_force(spark):
    r = random.Random(11)
    texts = []
    for k in range(12):
        base = words(1000 + k, 120)
        for _ in range(8):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = "edit%d" % r.randrange(99)
            texts.append(" ".join(w))
    texts += ["", "...", "one two", "One, two!", " ".join(words(1, 9000)), None, None]

    def shingles(t):
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter({(t,): 1})

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] is not None and texts[j] is not None and sum((sets[i] & sets[j]).values()) >= 0.8 * sum((sets[i] | sets[j]).values()):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {x.doc_id: x.class_id for x in neardup.classes(docs(spark, texts)).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    d = docs(spark, texts).withColumn("near_key", F.lit(1))
    kept = neardup.keep_one(d)
    assert kept.columns == d.columns and {x.doc_id for x in kept.collect()} == {find(i) for i in range(len(texts))}
    assert neardup.classes(d.limit(0)).count() == 0


# 6 quality rules


def test_policies_and_ablation_read_the_ledger(spark):
    letters = lambda seed, n: " ".join(w.translate(str.maketrans("0123456789", "abcdefghij")) for w in words(seed, n))
    d = docs(spark, [None, "", letters(1, 50), "a b c d e f " * 20, "# $ % & | < > " * 9 + letters(2, 12)])
    book = quality.ledger(d)
    kept = {p: {r.doc_id for r in quality.apply_policy(book, p).filter("kept").collect()} for p in ("base", "v1")}
    assert 2 in kept["v1"] and kept["v1"] <= kept["base"] and not {0, 1, 3} & kept["base"]
    by = {r.rule: r for r in quality.ablation(book).collect()}
    for name, row in by.items():
        rest = tuple(x for x in quality.POLICIES["v1"] if x != name)
        assert row.kept_without == quality.apply_policy(book, rest).filter("kept").count()
    assert quality.filter_documents(d).columns == d.columns


# 7 chat


def test_chat_round_trip(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<", "a\\<\\\\|b", "ends in <", "|x", "ü\n\n", ""]
    turns = [(c, t, ("user", "assistant", "odd\\n\nrole<|")[(c + t) % 3], odd[(c * 3 + t) % len(odd)]) for c in range(30) for t in range(c % 5 + 1)]
    rows = turns + [(None, 0, "user", None), (31, 0, None, "x"), (32, 0, "assistant", "y" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0)).repartition(7)
    out = {r.conv_id: r for r in chat.digest(chat.format_turns(df)).collect()}
    assert len(out) == 33
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        got = out[conv]
        assert (got.n_turns, got.turns_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest())
        assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {r.conv_id: r.text for r in chat.conversations(chat.format_turns(df)).collect()}
    assert all(len(whole[c]) == out[c].formatted_chars for c in whole)
    assert whole[1].count("<|im_start|>") == out[1].n_turns
    assert chat.digest(chat.format_turns(df.limit(0))).count() == 0


# 8 language


def test_gram_counts_equal_a_plain_count():
    texts = ["Ab, ba b", "éa 12 b", "", None, "..."]
    of, gram, count = langid.gram_counts(pa.array(texts, pa.string()))

    def plain_counts(t):
        runs = [f"_{w}_" for w in re.findall(r"[^\W\d_]+", (t or "").lower())]
        joined = "_".join(w.strip("_") for w in runs)
        c = Counter()
        if joined:
            s = f"_{joined}_"
            for n in (1, 2, 3):
                for i in range(len(s) - n + 1):
                    g = s[i : i + n]
                    if g.strip("_") and not (n == 3 and g[1] == "_"):
                        c[g] += 1
        return c

    for i, t in enumerate(texts):
        assert sorted(count[of == i].tolist()) == sorted(plain_counts(t).values())


def test_language_is_predicted_and_und_without_letters(spark):
    r = random.Random(2)
    make = lambda a: " ".join("".join(r.choice(a) for _ in range(r.randrange(2, 8))) for _ in range(40))
    texts = [make("aeioutn") if i % 2 else make("kqzxvwy") for i in range(200)] + [None, "", "123 ..."]
    d = docs(spark, texts, lang=lambda i: None if i >= 200 else ("aa", "kk")[(i + 1) % 2])
    p = langid.learn(d, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in langid.predict(d, p).collect()}
    assert all(got[i].lang_pred == ("aa" if i % 2 else "kk") for i in range(200))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (200, 201, 202))
    none = langid.learn(d.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.predict(d, none).collect()} == {"und"}


# 9 line dedup


def test_boilerplate_goes_and_own_lines_stay(spark):
    pages = [f"menu home\n{' '.join(words(i, 30))}\n  menu home \nfooter {i % 2}" for i in range(40)] + [None, "", "menu home"]
    d = docs(spark, pages, source=lambda i: "a" if i < 43 else "b").withColumn("line_report", F.lit(1)).withColumn("lines", F.lit(2))
    out = {r.doc_id: r.text for r in linededup.clean_documents(d).collect()}
    assert out[3] == " ".join(words(3, 30)) and out[40] is None and out[41] == "" and out[42] == ""
    assert linededup.clean_documents(d).columns == d.columns and linededup.clean_documents(d.limit(0)).count() == 0


def test_boilerplate_goes_from_thin_pages_and_copies_stay_whole(spark):
    header = " ".join(words(1, 40))
    pages = [f"{header}\n{' '.join(words(i, 4))}" for i in range(2, 32)] + [header] + ["\n".join(["one page", "copied"])] * 30
    rows = linededup.dedup_lines(docs(spark, pages), F.col("source")).select("doc_id", "line_report.*").collect()
    out = {r.doc_id: r for r in rows}
    assert all(out[i].text == " ".join(words(i + 2, 4)) and out[i].n_dropped == 1 for i in range(30))
    assert (out[30].text, out[30].n_dropped, out[30].dropped_chars) == ("", 1, len(header))
    assert all((out[i].text, out[i].n_dropped) == ("one page\ncopied", 0) for i in range(31, 61))


# 10 WARC


def test_archives_hold_any_payload(spark, tmp_path):
    html = ["x" * 200, "x" * 200, "short", "short", None, "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nb" * 9, "é" * 80, "x" * 200, "y" * 3_000_000]
    p = spark.createDataFrame([(i, f"http://e.org/{i}\r\nX: 1", h, 5) for i, h in enumerate(html)], "page_id long, url string, html string, digest long")
    warc.write(p, str(tmp_path / "w"), archive_bytes=5000)
    got = {r.capture_id: r for r in warc.assemble(warc.read(spark, str(tmp_path / "w"))).collect()}
    assert len(got) == len(html)
    for i, h in enumerate(html):
        data = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        again = i in (1, 7)
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 0) if again else ("response", None))
        assert bytes(got[i].payload) == (b"" if again else data)
        assert got[i].request.fields.startswith("GET / HTTP/1.1") and got[i].metadata.fields
    warc.write(p.limit(0), str(tmp_path / "e"))


def test_transactions_are_tied_in_either_direction(spark):
    kind = warc._RECORD
    rows = [("r1", "response", "u", [], None, None, None, 1, "d", None), ("q1", "request", "u", ["r1"], None, None, "GET", 0, "", None),
            ("r2", "response", "u", ["q2"], None, None, None, 2, "e", None), ("q2", "request", "u", [], None, None, "PUT", 0, "", None),
            ("q3", "request", "u", ["gone"], None, None, "GET", 0, "", None)]
    got = {r.record_id: r for r in warc.assemble(spark.createDataFrame(rows, kind)).collect()}
    assert set(got) == {"r1", "r2"} and got["r1"].request.fields == "GET" and got["r2"].request.fields == "PUT"


# pipeline


def test_pipeline_keeps_columns_and_drops_what_it_should(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "mix_sources"]
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    now = d
    for _, stage in cp.STAGES[:-1]:
        after = stage(spark, now, DATA)
        assert after.columns == d.columns and after.count() <= now.count()
        now = after
    rows = cp.run(spark, DATA).collect()
    left = {r.doc_id: r.text.split() for r in now.select("doc_id", "text").collect() if r.text and r.text.split()}
    assert {i for r in rows for i in r.doc_ids} <= set(left) and all(r.n_words == len(r.text.split(" ")) <= 64 for r in rows)
    assert sum(r.n_words for r in rows) == pytest.approx(1.5 * sum(map(len, left.values())), rel=0.05)
    for r in rows[:50]:
        inside = [" " + " ".join(left[i]) + " " for i in r.doc_ids]
        assert len(inside) > 1 or f" {r.text} " in inside[0]


def test_components_equal_a_union_find(spark, monkeypatch):
    from engramlake.llm import components

    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(k, k + 1) for k in range(400, 470)] + [(500, k) for k in range(501, 540)]
    root = {}

    def find(i):
        return i if root.setdefault(i, i) == i else find(root[i])

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {i: find(i) for e in edges for i in e if e[0] != e[1] or find(i) != i or any(i in x and x[0] != x[1] for x in edges)}
    df = spark.createDataFrame(edges, "a long, b long")
    for few in (0, 50_000):
        monkeypatch.setattr(components, "FEW", few)
        assert {x.node: x.root for x in components.components(df).collect()} == want
    assert components.components(df.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        components.components(df, rounds=1)
