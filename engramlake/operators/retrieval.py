"""Retrieval: chunks, lexical and vector legs, rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from engramlake.functions import text as T

CHUNK, OVERLAP, RRF = 300, 50, 60


def chunks(pages: DataFrame, key: str = "doc_id", body: str = "body", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Windows of `size` words that overlap by `overlap`: key, chunk_index, chunk_text, token_count."""
    step = size - overlap
    words = F.filter(F.split(F.col(body), r"\s+"), lambda w: w != "")
    x = pages.select(F.col(key), words.alias("w"))
    n = F.size("w")
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step).cast("int"))
    each = x.select(key, "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    part = F.slice("w", F.col("chunk_index") * step + 1, F.lit(size))
    return each.select(key, "chunk_index", F.array_join(part, " ").alias("chunk_text"), F.size(part).alias("token_count"))


def _gram_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, trigram) of the distinct trigrams of each text's words, padded by two blanks before and one after; a trigram is three code points."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+", " ")
    words = pc.replace_substring(pc.utf8_trim(plain, " "), " ", "   ").to_pylist()
    whole = "".join(f"  {w} " for w in words)
    c = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 3 for w in words])
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # a window that ends in two blanks lies across words, or in a text without any
    inside = (owner[:-2] == owner[2:]) & ~((c[1:-1] == 32) & (c[2:] == 32))
    key, owner = ((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])[inside], owner[:-2][inside]
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])) if len(key) else np.zeros(0, bool)
    return owner[new], key[new]


def scored(rows: DataFrame, columns: dict[str, str], query: str, chars: int = 1 << 20) -> DataFrame:
    """Rows with the trigram similarity of text columns to one query (columns: text column, name of its score); as `text.similarity`.

    Trigrams are made for a batch of texts at once, of about so many characters, in Arrow buffers.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _gram_keys(pa.array([query]))[1]
        for whole in stream:
            sizes = np.sum([pc.fill_null(pc.utf8_length(whole.column(c)), 0).to_numpy(zero_copy_only=False) for c in columns], axis=0)
            part = (np.cumsum(sizes) - sizes) // chars
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)] if len(sizes) else [0]
            for lo, hi in zip(edges[:-1], edges[1:]):
                batch, out = whole.slice(lo, hi - lo), []
                for c in columns:
                    owner, key = _gram_keys(batch.column(c))
                    n = np.bincount(owner, minlength=hi - lo)
                    both = np.bincount(owner[np.isin(key, known)], minlength=hi - lo)
                    every = n + len(known) - both
                    out.append(pa.array(np.where(every > 0, both / np.maximum(every, 1), 0.0)))
                yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, *columns.values()])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *[StructField(n, DoubleType()) for n in columns.values()]]))


def search_pages(pages: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Pages whose title or body has every term, best trigram similarity first."""
    terms = query.split()
    hit = T.contains_all(F.col("title"), terms) | T.contains_all(F.col("body"), terms)
    found = scored(pages.filter(hit).select("slug", "type", "created_s", "title", "body"), {"title": "_t", "body": "_b"}, query)
    found = found.select("slug", "type", F.round(F.greatest("_t", "_b"), 6).alias("score"), "created_s")
    return found.orderBy(F.desc("score"), F.desc("created_s"), "slug").limit(limit).drop("created_s")


def search_chunks(cut: DataFrame, query: str, limit: int = 20, key: str = "doc_id") -> DataFrame:
    """Chunks with every term, best similarity first, each with a snippet of its first term."""
    terms = query.split()
    found = scored(cut.filter(T.contains_all(F.col("chunk_text"), terms)), {"chunk_text": "score"}, query).withColumn("score", F.round("score", 6))
    top = found.orderBy(F.desc("score"), key, "chunk_index").limit(limit)
    return top.select(key, "chunk_index", "score", T.snippet(F.col("chunk_text"), terms[0]).alias("snippet"))


def find_chunks(pages: DataFrame, query: str, limit: int = 20, key: str = "doc_id", body: str = "body") -> DataFrame:
    """As `search_chunks` over the chunks of pages, of which only those that have every term are cut."""
    return search_chunks(chunks(pages.filter(T.contains_all(F.col(body), query.split())), key, body), query, limit, key)


def nearest(vectors: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k vectors of the largest cosine similarity (exact; each task keeps its own k). A null vector, or one of another length than the query's, is an error of the data and left out; one of length 0 has none."""
    q = np.asarray(query, dtype=np.float64)
    norm = float(np.sqrt(q @ q))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            lists = batch.column(vector)
            sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(sizes == len(q)))
            m = batch.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, len(q))
            with np.errstate(divide="ignore", invalid="ignore"):
                score = (m @ q) / (np.sqrt(np.einsum("ij,ij->i", m, m)) * norm)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(score, mask=~np.isfinite(score))], [key, "score"])

    rows = vectors.select(key, vector)
    found = rows.mapInArrow(run, StructType([rows.schema[key], StructField("score", DoubleType())]))
    return found.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), key).limit(k)


def fuse(legs: list[DataFrame], pool: str = "max", k: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of ranked legs (slug, rank from 0)."""
    each = legs[0]
    for leg in legs[1:]:
        each = each.unionByName(leg)
    part = 1 / (F.lit(k) + F.col("rank") + 1)
    return each.groupBy("slug").agg((F.max(part) if pool == "max" else F.sum(part)).alias("rrf"))


def ranks(top: DataFrame, *order: Column) -> DataFrame:
    """Ranks from 0 of a leg that a limit has already made small."""
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)) - 1)


def stale(cut: DataFrame, embedded: DataFrame, key: str = "doc_id", batch: int = 256) -> DataFrame:
    """The next batch of chunks that have no embedding (embedded: key, chunk_index), in order."""
    return cut.join(embedded, [key, "chunk_index"], "left_anti").orderBy(key, "chunk_index").limit(batch)
