"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

1. Weights. Every token has features: the word and its prefixes of 4, 6 and 8 bytes, so that the
   inflected forms of a rare word share evidence. A feature's weight is its log-odds ratio between
   toxic and clean documents under an informative Dirichlet prior (`PRIOR` documents spread as the
   whole training corpus), less `Z` standard errors; documents are counted, not occurrences, so
   that one text that repeats a word proves nothing. A token scores the best weight of its features,
   and at least -`FLOOR`; tokens without evidence score -`FLOOR`.
2. Segments. All maximal scoring segments of a text are found by one linear scan (a stack of
   candidate segments with back links). Only tokens that score above zero are visited; the runs
   between them enter through prefix sums.
3. Calibration. On training documents whose weights they did not help to learn: `lam` solves
   sum(p(s) exp(lam s)) = 1 over the token scores of clean documents; the maximum of n clean tokens
   then exceeds s with expectation K n exp(-lam s), and K is fitted from the clean documents' maxima.
   A segment is significant if that expectation is below `ALPHA`. A document's evidence is the sum of
   lam s - ln(K n) over its significant segments, or that of its best segment if none is. Evidence is
   mapped to a probability by monotone regression over bins of it.

The model has a fixed size, whatever the corpus: `BUCKETS` hashed features (4 bytes each) and some
bins. It is fitted on at most about `TRAIN_ROWS` labelled rows, drawn by a hash of the id (all of
them up to that bound); every document is scored, over its whole text.

Defined results: a null or empty text, or one without words, has no segment and the score of that;
an unlabelled corpus gives everything score 0; rows that repeat an id share its label, and of
clashing labels the toxic one holds; a null id is held out of training. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.llm import tokens as tk

BUCKETS, PREFIXES, PRIOR, Z, FLOOR, ALPHA = 1 << 20, (4, 6, 8), 50.0, 1.64, 0.25, 0.05
TRAIN_ROWS = 200_000
BINS, BIN_WIDTH = 96, 0.5
#: Token scores lie in (-FLOOR, TOP]; the histogram of clean scores has this many steps.
TOP, STEPS = 12.0, 256


@dataclass
class Model:
    weights: np.ndarray
    lam: float = 1.0
    k: float = 1.0
    probability: np.ndarray = field(default_factory=lambda: np.zeros(BINS))


def features(w: tk.Words) -> np.ndarray:
    """Feature buckets, one column for each token."""
    shift = np.uint64(64 - int(BUCKETS).bit_length() + 1)
    return (np.vstack([w.hash[None, :], w.prefix]) >> shift).astype(np.int64)


def weights(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log-odds ratios with a Dirichlet prior, less Z standard errors, from document counts."""
    seen = toxic + clean
    out = np.full(len(seen), -np.inf, dtype=np.float64)
    at = np.flatnonzero(seen)
    if n_toxic and n_clean:
        a = PRIOR * seen[at] / (n_toxic + n_clean)
        t, c = toxic[at] + a, clean[at] + a
        odds = lambda x, n: np.log(x) - np.log(np.maximum(n + PRIOR - x, 1e-9))
        out[at] = odds(t, n_toxic) - odds(c, n_clean) - Z * np.sqrt(1 / t + 1 / c)
    return np.clip(out - FLOOR, -FLOOR, TOP).astype(np.float32)


def scores(w: tk.Words, table: np.ndarray) -> np.ndarray:
    return table[features(w)].max(axis=0).astype(np.float64) if len(w.hash) else np.zeros(0)


def maximal_segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """(begin, end, score) of all maximal scoring segments, in linear time, in order of place."""
    upto = np.concatenate([[0.0], np.cumsum(values)])
    # candidates: left sum, right sum, begin, end, and the last candidate before with a smaller left sum
    left: list[float] = []
    right: list[float] = []
    begin: list[int] = []
    end: list[int] = []
    back: list[int] = []
    for i in np.flatnonzero(values > 0).tolist():
        lo, hi, start = float(upto[i]), float(upto[i + 1]), i
        j = len(left) - 1
        while True:
            while j >= 0 and left[j] >= lo:
                j = back[j]
            if j < 0 or right[j] >= hi:
                break
            lo, start = left[j], begin[j]
            del left[j:], right[j:], begin[j:], end[j:], back[j + 1 :]
            j = back.pop()
        left.append(lo)
        right.append(hi)
        begin.append(start)
        end.append(i + 1)
        back.append(j)
    return [(b, e, r - lo) for b, e, lo, r in zip(begin, end, left, right)]


def evidence(segments: list[tuple[int, int, float]], n: int, model: Model) -> float:
    """Nats against chance; minus infinity without a segment."""
    if not segments:
        return -np.inf
    base = np.log(model.k * n)
    each = model.lam * np.array([s for _, _, s in segments]) - base
    sure = each > -np.log(ALPHA)
    return float(each[sure].sum() if sure.any() else each.max())


def bin_of(e: float) -> int:
    return 0 if e == -np.inf else int(np.clip(1 + np.floor((min(e, 1e6) + 8) / BIN_WIDTH), 1, BINS - 1))


def monotone(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The rising step function nearest to the shares of `bad` (pool adjacent violators); empty bins take the bin before."""
    pools: list[list[float]] = []
    for b, g in zip(bad, good):
        pools.append([b, b + g, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            x = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], x)]
    return np.concatenate([np.full(int(k), (b + 0.05) / (n + 0.5) if n else 0.0) for b, n, k in pools])


def _value(model: Model, seg: list, n: int) -> float:
    return float(model.probability[bin_of(evidence(seg, n, model))])


def _texts(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tk.Words]]:
    for batch in tk.batches(stream, "text"):
        yield batch, tk.words(batch.column("text"), PREFIXES)


def _count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), dtype=np.int64)
    docs = np.zeros(2, dtype=np.int64)
    for batch, w in _texts(stream):
        label = np.array(batch.column("label").to_pylist(), dtype=np.int64)
        pair = np.unique(np.tile(w.owner(), 1 + len(PREFIXES)) * BUCKETS + features(w).ravel())
        for k in (0, 1):
            counts[k] += np.bincount(pair[label[pair // BUCKETS] == k] % BUCKETS, minlength=BUCKETS)
            docs[k] += int((label == k).sum())
    at = np.flatnonzero(counts.any(axis=0))
    ids = np.append(at, -1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids), *(pa.array(np.append(counts[k][at], docs[k])) for k in (1, 0))], ["f", "toxic", "clean"]
    )


def _maxima(table):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = np.zeros(STEPS, dtype=np.int64)
        for batch, w in _texts(stream):
            label = np.array(batch.column("label").to_pylist(), dtype=np.int64)
            s, first = scores(w, table.value), w.first - w.first[0]
            step = ((s + FLOOR) / (TOP + FLOOR) * (STEPS - 1)).astype(np.int64)
            hist += np.bincount(step[label[w.owner()] == 0], minlength=STEPS)
            segments = [
                [x[2] for x in maximal_segments(s[a:b])] for a, b in zip(first[:-1].tolist(), first[1:].tolist())
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(label), pa.array(np.diff(first)), pa.array(segments, pa.list_(pa.float64()))],
                ["label", "n", "segments"],
            )
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1]), pa.array([0]), pa.array([hist.tolist()], pa.list_(pa.float64()))],
            ["label", "n", "segments"],
        )

    return run


def _lam(hist: np.ndarray) -> float:
    """The positive root of sum(p exp(lam s)) = 1."""
    s = np.arange(STEPS) / (STEPS - 1) * (TOP + FLOOR) - FLOOR
    p = hist / max(1, hist.sum())
    if not (p[s > 0] > 0).any() or (p * s).sum() >= 0:
        return 1.0
    lo, hi = 1e-3, 60.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * s, 600))).sum() < 1 else (lo, mid)
    return float(np.clip(lo, 0.2, 5.0))


def labelled(docs: DataFrame, labels: DataFrame, train: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most about `rows` labelled documents for which `train` holds."""
    each = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    each = each.groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.max("toxic").cast("long").alias("label"))
    each = each.filter(F.col("label").isin(0, 1))
    many = each.count()
    share = F.pmod(F.xxhash64(F.lit("train"), "of"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, rows / max(many, 1))))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(train)
    return base.join(F.broadcast(each.filter(share)), F.col("doc_id") == F.col("of")).drop("of")


def fit(docs: DataFrame, labels: DataFrame, train: Column, rows: int = TRAIN_ROWS) -> Model:
    """Learn from labelled documents: four fifths give the weights, one fifth the calibration."""
    spark = docs.sparkSession
    known = labelled(docs, labels, train, rows)
    hold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(5)) == 0
    got = known.filter(~hold).mapInArrow(_count, "f long, toxic long, clean long")
    got = got.groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    got = got.filter("f < 0 or toxic > 0").toPandas()  # what no toxic document has weighs -FLOOR in any case
    toxic, clean = np.zeros(BUCKETS), np.zeros(BUCKETS)
    sizes, got = got[got.f < 0], got[got.f >= 0]
    toxic[got.f], clean[got.f] = got.toxic, got.clean
    model = Model(weights(toxic, clean, int(sizes.toxic.sum()), int(sizes.clean.sum())))
    table = spark.sparkContext.broadcast(model.weights)
    tried = known.filter(hold).mapInArrow(_maxima(table), "label long, n long, segments array<double>")
    tried = tried.persist()
    hist = tried.filter("label = -1").select(F.posexplode("segments")).groupBy("pos").agg(F.sum("col").alias("n"))
    counts = np.zeros(STEPS)
    for r in hist.collect():
        counts[r.pos] = r.n
    model.lam = _lam(counts)
    worst = F.exp(-F.lit(model.lam) * F.array_max("segments"))
    clean_docs = tried.filter("label = 0 and n > 0")
    row = clean_docs.agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.col("n") * F.coalesce(worst, F.lit(1.0))).alias("mass")
    ).first()
    model.k = float(np.clip(row.docs / row.mass, 1e-6, 1.0)) if row.docs and row.mass else 1.0
    each = F.transform("segments", lambda s: s * model.lam - F.log(F.greatest(F.col("n"), F.lit(1)) * model.k))
    sure = F.filter(each, lambda e: e > -float(np.log(ALPHA)))
    total = F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda a, x: a + x)).otherwise(F.array_max(each))
    place = F.when(total.isNull(), 0).otherwise(
        F.greatest(F.lit(1), F.least(F.lit(BINS - 1), 1 + F.floor((total + 8) / BIN_WIDTH)))
    )
    tally = tried.filter("label >= 0").groupBy(place.cast("int").alias("b"), "label").count().collect()
    bad, good = np.zeros(BINS), np.zeros(BINS)
    for r in tally:
        (bad if r.label else good)[r.b] += r["count"]
    model.probability = monotone(bad, good)
    tried.unpersist()
    return model


def _score(model):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch, w in _texts(stream):
            s, first = scores(w, m.weights), w.first - w.first[0]
            place = (w.start, w.end)
            origin = tk.flat(batch.column("text"))[1]
            out, spans = [], []
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                seg = maximal_segments(s[a:b])
                out.append(_value(m, seg, b - a))
                base = np.log(m.k * max(1, b - a)) - np.log(ALPHA)
                spans.append([
                    {"begin": int(place[0][a + x] - origin[i]), "end": int(place[1][a + y - 1] - origin[i]), "score": v}
                    for x, y, v in seg if m.lam * v > base
                ])
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out, pa.float64()), pa.array(spans, kind)],
                ["doc_id", "score", "passages"],
            )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, score (0 to 1) and its significant passages (byte spans of the lower-cased text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "doc_id long, score double, passages array<struct<begin: bigint, end: bigint, score: double>>"
    return base.mapInArrow(_score(shared), kind)
