"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Seeds. The word 3-grams (`SEED_WORDS`) of the test items are counted over the whole corpus. An
   item keeps the n-grams that occur at most `RARE` times per document, and in any case its rarest
   with their ties: `KEEP` of them, and more than a match can lose.
2. Candidates. A document meets an item if it has enough of the item's seeds. Enough is what every
   alignment at the threshold leaves: a match of an item of m words at similarity t has edits that
   cost (1 - t) m at most. A word inserted costs 1 and breaks two 3-grams, one replaced or deleted
   costs 2 and breaks three, one cut off an end costs 1 and breaks one, so 2 (1 - t) m are lost at
   most, and the rest of the kept seeds must be there. An item that could lose all its 3-grams (at 0.6: one of up to 10
   words) is met by its 2-grams instead, of which every edit breaks at most one for each unit that
   it costs. Seeds reach every match of at least two words; at a threshold of 1 / m or less, single words do not count.
3. Alignment. Around each group of seed hits on neighbouring diagonals a window of the document's
   words is aligned to the item's words (match 1, mismatch -1, gap -1, local). The best score over
   m is the similarity; `THRESHOLD` 0.6 of it is met by a copy with 20 % of its words replaced.

The corpus is read twice and never shuffled: only seed counts (at most one row per seed and task)
and the matches leave the tasks. The distinct texts of the test items are broadcast in blocks of about `BLOCK_CHARS`
characters, as many blocks as they need, so what is broadcast is bounded; a text stands for all items that have it. `decontaminate` needs
no ids at all. The counts of a block's seeds reach the driver as an Arrow table of two numbers each.

Defined results: items of fewer than `SEED_WORDS` words (null and empty ones too) match nothing;
null and empty documents match nothing; rows that repeat a document each give their matches; items
that repeat a text each match; empty tables give no matches. Extra columns are not read, and pass
through `decontaminate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm import tokens as tk

SEED_WORDS, SHORT_SEED_WORDS, RARE, KEEP, THRESHOLD, BLOCK_CHARS = 3, 2, 1e-3, 16, 0.6, 4 << 20
#: Cells of the alignment tables that are filled at once.
CELLS = 1 << 21

_FOUND = "doc_id long, of long, similarity double, score long, item_words long, doc_from long, doc_to long"


@dataclass
class Items:
    """A block of test items: keys (hashes of their texts), the words of all, the kept seeds sorted by hash, how many of them a
    match can lose, how many a document must have, and the lengths of seeds in use."""

    ids: np.ndarray
    words: np.ndarray
    first: np.ndarray
    seeds: np.ndarray
    seed_item: np.ndarray
    seed_place: np.ndarray
    lost: np.ndarray
    need: np.ndarray
    lengths: tuple[int, ...]


def _runs(hashes: np.ndarray, first: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of words of these lengths, the index of the first word of each, and its length."""
    found = [tk.gram_places(hashes, first, n) for n in lengths]
    gram, at = (np.concatenate(x) for x in zip(*found))
    return gram, at.astype(np.int64), np.repeat(lengths, [len(g) for g, _ in found])


def _items(ids: np.ndarray, texts: pa.Array, threshold: float) -> Items:
    w = tk.words(texts)
    m = w.lengths()
    lost = np.floor(2 * (1 - threshold) * m + 1e-9).astype(np.int64)
    short = (m >= SEED_WORDS) & (m - SEED_WORDS + 1 <= lost)
    lost[short] = np.floor((1 - threshold) * m[short] + 1e-9).astype(np.int64)
    lengths = (SEED_WORDS, SHORT_SEED_WORDS) if short.any() else (SEED_WORDS,)
    gram, at, length = _runs(w.hash, w.first, lengths)
    item = w.owner()[at]
    mine = (m[item] >= SEED_WORDS) & (length == np.where(short[item], SHORT_SEED_WORDS, SEED_WORDS))
    gram, at, item = gram[mine], at[mine], item[mine]
    order = np.argsort(gram, kind="stable")
    place = at[order] - w.first[item[order]]
    return Items(ids, w.hash, w.first, gram[order], item[order], place, lost, np.ones(len(ids), dtype=np.int64), lengths)


def _blocks(bench: DataFrame, text_col: str, block_chars: int, threshold: float) -> Iterator[Items]:
    base = bench.select(F.col(text_col).alias("t")).filter(F.col("t").isNotNull()).distinct()
    total = base.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for k in range(blocks):
        rows = base.withColumn("i", F.xxhash64("t")).filter(F.pmod("i", F.lit(blocks)) == k).toArrow()
        items = _items(rows.column("i").to_numpy(), rows.column("t").combine_chunks(), threshold)
        if len(items.seeds):
            yield items


def _grams(batch: pa.RecordBatch, lengths: tuple[int, ...]) -> tuple[tk.Words, np.ndarray, np.ndarray]:
    w = tk.words(batch.column("text"))
    gram, at, _ = _runs(w.hash, w.first - w.first[0], lengths)
    return w, gram, at


def _among(gram: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the grams that are among the sorted known ones, and where these are."""
    place = np.searchsorted(known, gram)
    hit = np.flatnonzero(known[np.minimum(place, len(known) - 1)] == gram)
    return hit, place[hit]


def _count(shared, lengths: tuple[int, ...]):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        counts, docs = np.zeros(len(known), dtype=np.int64), 0
        for batch in tk.batches(stream, "text"):
            _, gram, _ = _grams(batch, lengths)
            counts += np.bincount(_among(gram, known)[1], minlength=len(known))
            docs += batch.num_rows
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(counts[at], docs))], ["seed", "n"]
        )

    return run


def rare_seeds(docs: DataFrame, items: Items, rare: float = RARE, keep: int = KEEP) -> Items:
    """The block with its rare seeds only, by their counts over the whole corpus, and the hits that each item needs."""
    known = np.unique(items.seeds)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    got = docs.select("text").mapInArrow(_count(shared, items.lengths), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    seed, n = (got.column(c).to_numpy() for c in ("seed", "n"))
    counts, rows = np.zeros(len(known), dtype=np.int64), int(n[seed < 0].sum())
    counts[seed[seed >= 0]] = n[seed >= 0]
    n = counts[np.searchsorted(known, items.seeds)]
    order = np.lexsort((n, items.seed_item))
    per = np.bincount(items.seed_item, minlength=len(items.ids))
    begin = np.cumsum(per) - per
    last = np.zeros(len(items.ids), dtype=np.int64)  # the count of the last of the item's rarest seeds
    some = per > 0
    last[some] = n[order][begin[some] + np.minimum(per[some], np.maximum(keep, items.lost[some] + 1)) - 1]
    stays = (n <= max(1.0, rare * rows)) | (n <= last[items.seed_item])
    kept = np.bincount(items.seed_item[stays], minlength=len(items.ids))
    return Items(
        items.ids, items.words, items.first, items.seeds[stays], items.seed_item[stays], items.seed_place[stays],
        items.lost, np.maximum(1, kept - items.lost), items.lengths,
    )


def align(a: np.ndarray, b: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each row of `a` (words of an item, 0 beyond its end) against the row of `b`, of `wide` words, and
    the column at which it ends. All rows of a step are filled at once; gaps along a row are a running maximum."""
    n, m = b.shape
    kind = np.int16 if a.shape[1] + m < 1 << 15 else np.int32  # holds a score plus a column
    column = np.arange(m, dtype=kind)
    inside = column[None, :] < wide[:, None]
    last = np.zeros((n, m + 1), dtype=kind)
    best, end = np.zeros(n, dtype=kind), np.zeros(n, dtype=np.int64)
    for i in range(a.shape[1]):
        same = (a[:, i : i + 1] == b) & (a[:, i : i + 1] != 0) & inside
        now = np.maximum(last[:, :-1] + np.where(same, kind(1), kind(-1)), last[:, 1:] - kind(1))
        np.maximum(now, 0, out=now)
        now += column
        np.maximum.accumulate(now, axis=1, out=now)
        now -= column
        top = now.max(axis=1)
        better = top > best
        end[better] = now[better].argmax(axis=1)
        np.maximum(best, top, out=best)
        last[:, 1:] = now
    return best, end


def _matches(batch: pa.RecordBatch, items: Items, threshold: float) -> tuple[np.ndarray, ...]:
    """Row, item, score, first and last word of every match in a batch."""
    none = (np.zeros(0, np.int64),) * 5
    w, gram, at = _grams(batch, items.lengths)
    first = w.first - w.first[0]
    hit, place = _among(gram, items.seeds) if len(items.seeds) else (np.zeros(0, np.int64),) * 2
    if not len(hit):
        return none
    upto = np.searchsorted(items.seeds, gram[hit], side="right")
    each = np.repeat(np.arange(len(hit)), upto - place)
    seed = place[each] + np.arange(len(each)) - np.repeat(np.cumsum(upto - place) - (upto - place), upto - place)
    word = at[hit][each]
    row, item, inner = w.owner()[word], items.seed_item[seed], items.seed_place[seed]
    word = word - first[row]
    # distinct seeds of an item in a document
    pair = row * len(items.ids) + item
    size = np.diff(items.first)
    wide_key = pair * (int(size.max()) + 1) + inner
    met, n = np.unique(np.unique(wide_key) // (int(size.max()) + 1), return_counts=True)
    met = met[n >= items.need[met % len(items.ids)]]
    good = np.isin(pair, met)
    if not good.any():
        return none
    row, item, diagonal = row[good], item[good], (word - inner)[good]
    m = size[item]
    bins = np.floor_divide(diagonal, 2 * m)
    key = np.unique(np.stack([item, row, bins]), axis=1)
    item, row, bins = key
    m = size[item]
    pad = np.ceil((1 - threshold) * m).astype(np.int64) + 2  # a match has no more words inserted than that
    lo = np.maximum(bins * 2 * m - pad, 0)
    hi = np.minimum((bins + 1) * 2 * m + m + pad, np.diff(first)[row])
    score, end = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
    order = np.argsort(m, kind="stable")
    k = 0
    while k < len(order):
        step = max(1, CELLS // int(4 * m[order[k]] + 8))
        take = order[k : k + step]
        k += step
        rows, wide = int(m[take].max()), int((hi - lo)[take].max())
        a, b = np.zeros((len(take), rows), np.uint64), np.zeros((len(take), wide), np.uint64)
        for r, x in enumerate(take.tolist()):
            a[r, : m[x]] = items.words[items.first[item[x]] : items.first[item[x] + 1]]
            b[r, : hi[x] - lo[x]] = w.hash[first[row[x]] + lo[x] : first[row[x]] + hi[x]]
        score[take], end[take] = align(a, b, (hi - lo)[take])
    order = np.lexsort((lo, -score, item, row))
    top = np.ones(len(order), dtype=bool)
    top[1:] = (row[order][1:] != row[order][:-1]) | (item[order][1:] != item[order][:-1])
    take = order[top]
    take = take[score[take] >= threshold * m[take] - 1e-9]
    last = lo[take] + end[take]
    return row[take], item[take], score[take], np.maximum(0, last - m[take] + 1), last


def _find(shared, threshold: float):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in tk.batches(stream, "text"):
            row, item, score, begin, end = _matches(batch, items, threshold)
            m = np.diff(items.first)[item]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), *map(pa.array, (items.ids[item], score / np.maximum(m, 1), score, m, begin, end))],
                ["doc_id", "of", "similarity", "score", "item_words", "doc_from", "doc_to"],
            )

    return run


def _drop(shared, threshold: float, text_col: str):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.batches(stream, text_col):
            keep = np.ones(batch.num_rows, dtype=bool)
            texts = pa.RecordBatch.from_arrays([batch.column(text_col)], ["text"])
            keep[_matches(texts, shared.value, threshold)[0]] = False
            yield batch.filter(pa.array(keep))

    return run


def contaminated(
    docs: DataFrame, bench: DataFrame, id_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD,
    rare: float = RARE, keep: int = KEEP, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per document and test item that it holds, with the similarity and the words (from 0) where it stands."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull())
    out = spark.createDataFrame([], _FOUND)
    for items in _blocks(bench, text_col, block_chars, threshold):
        shared = spark.sparkContext.broadcast(rare_seeds(base, items, rare, keep))
        out = out.unionByName(base.mapInArrow(_find(shared, threshold), _FOUND))
    ids = bench.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.xxhash64(text_col).alias("of"))
    return out.join(ids, "of").select("doc_id", "item_id", "similarity", "score", "item_words", "doc_from", "doc_to")


def decontaminate(
    docs: DataFrame, bench: DataFrame, text_col: str = "text", threshold: float = THRESHOLD,
    rare: float = RARE, keep: int = KEEP, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The documents that hold no test item, in the columns they came with."""
    base, out = docs.select("text"), docs
    for items in _blocks(bench, text_col, block_chars, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(rare_seeds(base, items, rare, keep))
        out = out.mapInArrow(_drop(shared, threshold, "text"), docs.schema)
    return out
