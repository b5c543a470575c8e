"""License notices in texts: word k-grams joined with the places of known notices, votes on diagonals, verified spans.

A text's words are runs of ASCII letters and digits and of characters beyond ASCII; A-Z are lower-cased. Notices come as a table (label, exact, text).

1. Every run of `K` words of every text is hashed, in one pass over the texts, and the hashes are joined with the places of the notices' own runs. A text also sends
   one row that always meets a place, so that texts without a notice stay.
2. A hit of text place p and notice place t votes for the diagonal p - t, which is where the notice would begin. An exact notice stands in the text at each diagonal that
   all its places vote for.
3. Other notices may have been edited: words put in or left out move the rest of a notice to a neighbouring diagonal. Diagonals of one notice that are at most `SLACK` apart are merged.
4. A merged span is verified: its cover, the words of the notice that its hits cover in parts of the notice or of the span, whichever is longer, is `COVER` or more. Of verified spans that
   overlap in the text, those of the greatest cover stay, so that a license is not named for the wording that it shares with another.

The score is the greatest cover of any span or exact notice (0 to 1), verified or not, so texts with half of a notice rank before texts without one.
Labels are those of exact places and of verified spans.

Defined results: a null or empty text has no words, no labels and score 0; each repeated row has a result of its own; of labels that two notices give, one is named; an
empty table has no rows; extra columns are not read. Texts are read whole, in windows, and hits of one text meet in one task, where they are sorted, not collected.
A notice of fewer than `K` words is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engramlake.llm import tokens as tk

K = 3
SLACK = 3
COVER = 0.8
#: Hashes in a row that leaves the pass over the texts.
WINDOW = 1 << 13
#: Places of notices up to which they are broadcast; the join deals both sides by hash beyond it.
MOST_PLACES = 200_000
#: The hash that stands for a text itself.
_HERE = 0

#: Phrases that count wherever they stand.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Notices as they are commonly written.
NOTICES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

_WORDS = "n_words long, at long, grams array<bigint>"


def notices(spark: SparkSession) -> DataFrame:
    """The notices that the library knows: (label, exact, text)."""
    rows = [(label, True, text) for label, text in PHRASES] + [(label, False, text) for label, text in NOTICES]
    return spark.createDataFrame(rows, "label string, exact boolean, text string")


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text; its k-grams' hashes, their places in their text and their texts."""
    w = tk.words(texts, plain=True)
    gram, place = tk.gram_places(w.hash, w.first, K)
    gram[gram == _HERE] = 1
    of = w.owner()[place]
    return w.lengths(), gram.view(np.int64), place - w.first[of], of


def _scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tk.batches(stream, "text"):
        n, gram, place, of = _hashes(batch.column("text"))
        new = np.ones(len(of), dtype=bool)
        new[1:] = (of[1:] != of[:-1]) | (place[1:] % WINDOW == 0)
        at = np.flatnonzero(new)
        ends = np.append(at, len(of)).astype(np.int32)
        rows = np.concatenate([np.arange(batch.num_rows), of[at]])
        # each text itself, then its windows
        grams = pa.ListArray.from_arrays(
            np.concatenate([np.arange(batch.num_rows, dtype=np.int32), ends + batch.num_rows]), pa.array(np.concatenate([np.full(batch.num_rows, _HERE, np.int64), gram]))
        )
        keys = batch.drop_columns(["text"]).take(pa.array(rows))
        begins = np.concatenate([np.zeros(batch.num_rows, np.int64), place[at]])
        yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(n[rows]), pa.array(begins), grams], [*keys.schema.names, "n_words", "at", "grams"])


def _places(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tk.batches(stream, "text"):
        n, gram, place, of = _hashes(batch.column("text"))
        if len(n) and n.min() < K:
            raise ValueError(f"a notice needs {K} words or more")
        rest = batch.drop_columns(["text"]).take(pa.array(of))
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(n[of]), pa.array(gram), pa.array(place)], [*rest.schema.names, "words", "gram", "t"])


def places(known: DataFrame) -> DataFrame:
    """The hashed runs of every notice: (notice, label, exact, words, gram, t), and the place that stands for texts themselves."""
    text = F.coalesce(F.col("text"), F.lit(""))
    each = known.select(F.xxhash64("label", "exact", "text").alias("notice"), "label", "exact", text.alias("text")).distinct()
    out = each.mapInArrow(_places, "notice long, label string, exact boolean, words long, gram long, t long")
    here = known.sparkSession.range(1).select(F.lit(None).cast("long").alias("notice"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("exact"), F.lit(0).cast("long").alias("words"), F.lit(_HERE).cast("long").alias("gram"), F.lit(0).cast("long").alias("t"))
    return out.unionByName(here)


def votes(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Per text (row, doc_id, n_words) and notice the diagonals with their hits (places of the notice); a row without a notice for each text itself."""
    at = places(known)
    few = at.count() <= MOST_PLACES
    at = F.broadcast(at) if few else at
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = texts.mapInArrow(_scan, f"row long, doc_id long, {_WORDS}")
    grams = runs.select("row", "doc_id", "n_words", "at", F.posexplode("grams").alias("k", "gram"))
    hits = grams.join(at, "gram").select("row", "doc_id", "n_words", "notice", "label", "exact", "words", (F.col("at") + F.col("k") - F.col("t")).alias("diagonal"), "t")
    one = F.col("notice").isNull()
    return hits.repartition("row").groupBy("row", "notice", "diagonal").agg(
        F.max(F.when(one, F.col("doc_id"))).alias("doc_id"), F.max(F.when(one, F.col("n_words"))).alias("n_words"),
        F.first("label").alias("label"), F.first("exact").alias("exact"), F.first("words").alias("words"), F.array_sort(F.collect_list("t")).alias("ts"),
    )


def _covered(ts: Column) -> Column:
    """Words that runs of K words at the sorted places cover."""
    return F.aggregate(ts, F.struct(F.lit(0).cast("int").alias("n"), F.lit(-K).cast("long").alias("end")), lambda a, t: F.struct((a["n"] + K - F.greatest(F.lit(0).cast("long"), a["end"] - t)).cast("int").alias("n"), (t + K).alias("end")), lambda a: a["n"])


def spans(voted: DataFrame) -> DataFrame:
    """Merged spans: row, notice, label, lo and hi (words of the text, hi beyond the last), cover, base (an exact notice stands there), found (its label counts), and each text's own row."""
    order = W.partitionBy("row", "notice").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order)
    whole = F.size("ts") == F.col("words") - K + 1
    # an exact notice stands at one diagonal
    new = F.when((apart <= SLACK) & ~F.col("exact"), 0).otherwise(1)
    each = voted.withColumns({"island": F.sum(new).over(order), "lo": F.col("diagonal") + F.col("ts")[0], "hi": F.col("diagonal") + F.element_at("ts", -1) + K, "base": F.col("exact") & whole})
    out = each.groupBy("row", "notice", "island").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.first("exact").alias("exact"), F.first("words").alias("words"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("ts"), F.max("base").alias("base"),
    )
    cover = F.when(F.col("notice").isNull(), 0.0).otherwise(_covered(F.col("ts")) / F.greatest("words", F.col("hi") - F.col("lo")))
    out = out.withColumn("cover", cover).withColumn("sure", F.col("notice").isNotNull() & ~F.col("exact") & (F.col("cover") >= COVER))
    place = W.partitionBy("row", "sure").orderBy("lo", "hi", "notice")
    apart = F.col("lo") >= F.coalesce(F.max("hi").over(place.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = out.withColumn("knot", F.sum(F.when(apart, 1).otherwise(0)).over(place))
    best = F.max("cover").over(W.partitionBy("row", "sure", "knot"))
    return out.select("row", "notice", "doc_id", "n_words", "label", "lo", "hi", "cover", "base", (F.col("base") | (F.col("sure") & (F.col("cover") == best))).alias("found"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Per text: doc_id, n_words, places of exact notices (n_base, first_word, last_word, base_labels), all labels and the score."""
    base, found = F.col("base"), F.col("found")
    joined = lambda seen: F.array_join(F.array_sort(F.collect_set(F.when(seen, F.col("label")))), ",")
    return spans(votes(docs, known)).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("lo"))).alias("first_word"), F.max(F.when(base, F.col("lo"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(found).alias("labels"), F.max("cover").alias("score"),
    ).drop("row")
