"""Language identification by rank-order profiles and out-of-place distance.

A profile is the `TOP` most frequent character n-grams (1 to 3 characters of the lower-cased text;
letters, with one mark for any run of other characters; no n-gram spans a word's inside and the next
word's) in order of frequency. The distance of a document to a language is the sum, over the
document's own `TOP` n-grams, of how far each stands from its place in the language's profile, or
`TOP` for one that the profile lacks. The nearest language is predicted; the score is 1 - d1 / (2 d2)
for the two smallest distances (0.5: a tie; 1: a perfect fit, or only one language).

N-gram counts of training documents are summed inside the tasks (and handed on whenever a task holds
`FLUSH` of them), so a language with most of the rows costs no more than another. The model has `TOP`
rows for each language. It is learned from at most about `TRAIN_DOCS` labelled documents, drawn by a
hash of the id (all of them up to that bound); every document is predicted from its whole text.

Defined results: `und` with score 0 for a null text, a text without a letter, or when no language was
learned; n-grams of equal frequency are ordered by their hash and languages at equal distance by
name; repeated rows get equal results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engramlake.llm import tokens as tk

TOP, TRAIN_DOCS, FLUSH, NONE = 300, 50_000, 1 << 20, "und"
#: Code points whose n-grams are sorted at once; bytes of texts that are taken together.
PIECE, BATCH = 1 << 20, 1 << 20
_GRAM_BITS = np.uint64(40)
_MASK = np.uint64((1 << 40) - 1)
_A = tk.mix(np.arange(1, 8, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters (0: a run of others) of all texts with a 0 before each, and the text of every character."""
    data, at = tk.flat(texts)
    data = data[at[0] : at[-1]]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    starts = np.cumsum(np.concatenate([[0], (data & 0xC0) != 0x80]))[at - at[0]]
    x = np.where(_letters()[points], points, 0).astype(np.uint64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(starts))
    x = np.append(np.insert(x, starts[:-1], 0), np.uint64(0))
    owner = np.append(np.insert(owner, starts[:-1], np.arange(len(at) - 1)), max(0, len(at) - 2))
    keep = x != 0
    keep[0] = True
    keep[1:] |= x[:-1] != 0
    return x[keep], owner[keep].astype(np.uint64)


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[new], np.add.reduceat(counts[order], new)


def gram_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, count), sorted by text and gram."""
    x, owner = _characters(texts)
    keys, counts = [], []
    for lo in range(0, len(x), PIECE):
        p, o = x[lo : lo + PIECE + 2], owner[lo : lo + PIECE + 2]
        n = min(PIECE, len(p))
        one = p[:n]
        parts = [(tk.mix(one * _A[0] + _A[3]), o[:n], one != 0)]
        if len(p) > 1:
            k = min(n, len(p) - 1)
            who = np.where(p[:k] != 0, o[:k], o[1 : k + 1])
            parts.append((tk.mix(p[:k] * _A[0] + p[1 : k + 1] * _A[1] + _A[4]), who, (p[:k] | p[1 : k + 1]) != 0))
        if len(p) > 2:
            k = min(n, len(p) - 2)
            total = p[:k] * _A[0] + p[1 : k + 1] * _A[1] + p[2 : k + 2] * _A[2] + _A[5]
            parts.append((tk.mix(total), o[1 : k + 1], p[1 : k + 1] != 0))
        key = np.concatenate([(w[ok] << _GRAM_BITS) | (g[ok] & _MASK) for g, w, ok in parts])
        key.sort()
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        keys.append(key[new])
        counts.append(np.diff(np.append(new, len(key))))
    key, count = (np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if len(keys) > 1:
        key, count = _merge(key, count)
    return (key >> _GRAM_BITS).astype(np.int64), (key & _MASK).astype(np.int64), count


def ranked(of: np.ndarray, gram: np.ndarray, count: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, rank) of the most frequent n-grams of each text."""
    order = np.lexsort((gram, -count, of))
    of, gram = of[order], gram[order]
    begin = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    rank = np.arange(len(of)) - np.repeat(begin, np.diff(np.append(begin, len(of))))
    keep = rank < top
    return of[keep], gram[keep], rank[keep]


@dataclass
class Profiles:
    langs: list[str]
    #: By language: sorted n-grams, and their ranks.
    grams: list[np.ndarray]
    ranks: list[np.ndarray]
    top: int = TOP


def distances(of: np.ndarray, gram: np.ndarray, rank: np.ndarray, texts: int, p: Profiles) -> np.ndarray:
    """Array (texts, languages) of out-of-place distances."""
    out = np.zeros((texts, len(p.langs)))
    for k, (grams, ranks) in enumerate(zip(p.grams, p.ranks)):
        at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
        far = np.where(grams[at] == gram, np.abs(ranks[at] - rank), p.top)
        out[:, k] = np.bincount(of, weights=far, minlength=texts)
    return out


def _learn(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def release() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            g, c = _merge(*map(np.concatenate, zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g), pa.array(c)], ["lang", "gram", "n"])
        held.clear()

    for batch in tk.batches(stream, "text", BATCH):
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lang in sorted(set(langs)):
            texts = batch.column("text").filter(pa.array(langs == lang))
            _, g, c = gram_counts(texts)
            if len(g):
                held.setdefault(lang, []).append(_merge(g, c))
                size += len(g)
        if size > FLUSH:
            yield from release()
            size = 0
    yield from release()


def learn(docs: DataFrame, train: Column, top: int = TOP, rows: int = TRAIN_DOCS) -> Profiles:
    """Profiles of the languages named in `lang`, from documents for which `train` holds."""
    known = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    many = known.select("doc_id").count()
    share = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, rows / max(many, 1))))
    each = known.filter(share).select("lang", "text").mapInArrow(_learn, "lang string, gram long, n long")
    sums = each.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows_ = sums.withColumn("rank", place).filter(F.col("rank") <= top).select("lang", "gram", "rank").toPandas()
    langs = sorted(rows_.lang.unique())
    one = [rows_[rows_.lang == x].sort_values("gram") for x in langs]
    return Profiles(langs, [x.gram.to_numpy() for x in one], [x["rank"].to_numpy() - 1 for x in one], top)


def _predict(shared):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Profiles = shared.value
        for batch in tk.batches(stream, "text", BATCH):
            n = batch.num_rows
            of, gram, rank = ranked(*gram_counts(batch.column("text")), p.top)
            lang, score = np.full(n, NONE, dtype=object), np.zeros(n)
            some = np.bincount(of, minlength=n) > 0
            if p.langs and some.any():
                d = distances(of, gram, rank, n, p)
                best = d.argmin(axis=1)
                d1 = d[np.arange(n), best]
                d[np.arange(n), best] = np.inf
                d2 = d.min(axis=1)
                fit = np.where(np.isinf(d2), 1.0, 1 - d1 / np.maximum(2 * np.where(np.isinf(d2), 1, d2), 1e-9))
                lang[some], score[some] = np.array(p.langs, dtype=object)[best[some]], np.clip(fit[some], 0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(score)],
                ["doc_id", "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """Per document: doc_id, lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return base.mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")
