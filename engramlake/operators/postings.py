"""A trigram index for substring search: which pages have which three characters in a row, in Parquet, in segments.

A page has a term only if it has all trigrams of the term, so the postings of these are intersected and only the pages that are left are read and searched. A segment
holds some pages, whole, with its trigrams in order, so no posting is shuffled, and Parquet's statistics let a search skip what it does not need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.functions import text as T

#: Characters of a segment's texts; one text is never cut.
CHARS = 1 << 21


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, trigram) of the distinct trigrams of each text, as numbers of three code points, in the order of trigrams."""
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = owner[:-2] == owner[2:]
    key, owner = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[inside], owner[:-2][inside]
    # owners ascend, so a stable sort keeps them in order
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    new = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])) if len(key) else np.zeros(0, bool)
    return owner[new], key[new]


def _postings(keys: pa.Array, texts: list[list[str]], name: str) -> pa.RecordBatch:
    """(gram, pages) of a segment. The texts of a page follow one another."""
    width = len(texts)
    of, gram = grams([t for row in zip(*texts) for t in row])
    of = of // width
    new = np.append(True, (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])) if len(gram) else np.zeros(0, bool)
    of, gram = of[new], gram[new]
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
    ends = pa.array(np.append(first, len(gram)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(gram[first]), pa.ListArray.from_arrays(ends, keys.take(pa.array(of)))], ["gram", name])


def build(pages: DataFrame, path: str, key: str = "slug", columns: tuple[str, ...] = ("title", "body")) -> None:
    """Write the index of the pages' lower-cased texts."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def segment() -> Iterator[pa.RecordBatch]:
            x = pa.Table.from_batches(waiting).combine_chunks()
            out = _postings(x[key].combine_chunks(), [[t or "" for t in x[c].to_pylist()] for c in columns], "keys")
            # lists of many keys go in few rows at a time
            for lo in range(0, out.num_rows, 4096):
                yield out.slice(lo, 4096)

        for whole in stream:
            sizes = sum(pc.fill_null(pc.utf8_length(whole.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
            part = (size + np.cumsum(sizes) - sizes) // CHARS
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)] if len(sizes) else [0]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if waiting and (lo or size >= CHARS):
                    yield from segment()
                    waiting, size = [], 0
                waiting.append(whole.slice(lo, hi - lo))
                size += int(sizes[lo:hi].sum())
        if waiting:
            yield from segment()

    x = pages.select(key, *[F.lower(c).alias(c) for c in columns])
    x.mapInArrow(run, f"gram long, keys array<{x.schema[key].dataType.simpleString()}>").write.parquet(path)


def candidates(spark: SparkSession, path: str, terms: list[str], key: str = "slug") -> DataFrame | None:
    """The pages (key) that have all trigrams of the terms; None if the terms have none, as they are too short, so that no page is ruled out."""
    known = np.unique(grams([t.lower() for t in terms])[1]).tolist()
    if not known:
        return None
    found = spark.read.parquet(path).filter(F.col("gram").isin(known)).select("gram", F.explode("keys").alias(key))
    return found.groupBy(key).agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(known)).select(key)


def having(pages: DataFrame, path: str, terms: list[str], key: str = "slug") -> DataFrame:
    """The pages whose title or body has every term, in any case; only the texts of candidates are searched."""
    few = candidates(pages.sparkSession, path, terms, key)
    some = pages if few is None else pages.join(few, key, "left_semi")
    return some.filter(T.contains_all(F.col("title"), terms) | T.contains_all(F.col("body"), terms))
