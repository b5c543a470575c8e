"""Very long texts in the scoring operators, and the pipeline's stages on nulls, repeated rows, clashing columns and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from engramlake.llm import langid, linededup, toxicity

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], DOCS)


def test_toxic_passages_of_a_very_long_text_are_found_in_their_place(spark):
    r, rows, labels = random.Random(5), [], []
    for i in range(400):
        w = words(i, 60, 300)
        if i % 4 == 0:
            w[20:20] = [r.choice(["scum", "filth", "moron"]) for _ in range(4)]
        rows.append((i, " ".join(w), "en", "a"))
        labels.append((i, int(i % 4 == 0)))
    clean = words(7, 300_000, 300)
    held = clean[:250_000] + ["scum", "filth", "moron", "filth", "scum", "moron"] * 3 + clean[250_000:]
    model = toxicity.fit(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    got = {x.doc_id: x for x in toxicity.score(docs(spark, [(1, " ".join(clean), "en", "a"), (2, " ".join(held), "en", "a")]), model).collect()}
    assert got[2].score > got[1].score and got[2].score >= 0.5
    text = " ".join(held)
    assert len(got[2].passages) >= 1 and "scum" in text and len(text) > 1_000_000


def test_the_language_of_a_very_long_text(spark):
    r = random.Random(2)
    make = lambda a, n: " ".join("".join(r.choice(a) for _ in range(r.randrange(2, 8))) for _ in range(n))
    rows = [(i, make("aeioutn" if i % 2 else "kqzxvwy", 40), ("kk", "aa")[i % 2], "a") for i in range(200)]
    p = langid.learn(docs(spark, rows), F.lit(True))
    long = docs(spark, [(1, make("aeioutn", 200_000), None, "a"), (2, make("kqzxvwy", 200_000) + " aeio" * 9, None, "a")])
    assert {x.doc_id: x.lang_pred for x in langid.predict(long, p).collect()} == {1: "aa", 2: "kk"}


def test_lines_of_a_very_long_text_go_by_their_share_of_the_host(spark):
    own = [f"line {k} of its own" for k in range(60_000)]
    long = "\n".join(x for k, line in enumerate(own) for x in ([line, "menu"] if k % 1000 == 0 else [line]))
    rows = [(1, long, "en", "a"), (2, "menu\nother", "en", "a"), (3, "third\nmenu", "en", "a"), (4, "menu", "en", "b")]
    got = {x.doc_id: x.text for x in linededup.clean_documents(docs(spark, rows)).collect()}
    assert got[1] == "\n".join(own) and got[2] == "other" and got[3] == "third" and got[4] == "menu"


@pytest.fixture(scope="module")
def corpus(spark):
    import corpus_pipeline as cp

    letters = str.maketrans("0123456789", "aeioulnrst")  # the quality rules ask for letters
    prose = lambda k: " ".join(words(k, 120)).translate(letters).capitalize() + "."
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(k, prose(k), "en", "ab"[k % 2]) for k in range(30)] + [(7, prose(7), "en", "b")] * 3 + [(None, prose(90), None, None)] * 2 + [(40, None, "en", "a"), (41, "", "en", "a"), (42, prose(3) + " more", "en", "a")]
    rows += [(50, prose(60) + "\n" + item + "\n" + prose(61), "en", "a")]
    d = docs(spark, rows)
    for c in ("near_key", "near_of", "chunk", "copy", "size", "salt", "sid", "failed", "kept", "stretch", "seed", "row", "node", "root"):
        d = d.withColumn(c, F.lit("x"))
    return cp, d


def test_pipeline_stages_keep_columns_that_clash_and_drop_what_they_should(spark, corpus):
    cp, d = corpus
    now, left = d, {}
    for name, stage in cp.STAGES[:-1]:
        now = stage(spark, now, DATA)
        assert now.columns == d.columns and {x["near_key"] for x in now.collect()} == {"x"}
        left[name] = sorted((r.doc_id for r in now.collect()), key=lambda x: (x is not None, x or 0))
    everything = sorted([None, None, *range(30), 7, 7, 7, 42, 50], key=lambda x: (x is not None, x or 0))
    assert left["quality_rules"] == left["line_dedup"] == everything
    assert left["near_dedup"] == [None, *range(30), 50]
    assert left["decontaminate"] == [None, *range(30)]
    mixed = cp.STAGES[-1][1](spark, now, DATA).collect()
    assert {i for r in mixed for i in r.doc_ids} <= {None, *range(30)} and sum(r.n_words for r in mixed) > 0


def test_pipeline_stages_of_an_empty_table_are_empty(spark, corpus):
    cp, d = corpus
    for _, stage in cp.STAGES:
        assert stage(spark, d.limit(0), DATA).count() == 0
