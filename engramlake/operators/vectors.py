"""An inverted file of vectors: lists around coarse centroids, of which a search reads only those nearest to the query.

Centroids are fitted on a bounded sample; every vector is in the list of its nearest one. With fewer probes than lists a search may miss vectors of lists that it does not read: `recall` measures that against
the exact way (`retrieval.nearest`), which stays the default.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from engramlake.operators import retrieval as R

#: Lists, vectors that the centroids are fitted on, and rounds of fitting.
LISTS, SAMPLE, ROUNDS = 64, 20_000, 12


def _units(column: pa.Array, width: int) -> np.ndarray:
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.maximum(norm, 1e-300)[:, None]


def centroids(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", lists: int = LISTS, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids of a sample drawn by a hash of the key: `sample` vectors at most reach the driver. Null vectors, and those of another length than most, are left out."""
    some = vectors.filter(F.size(vector) > 0).orderBy(F.xxhash64(F.lit(17), key), key).select(vector).limit(sample).toArrow()
    column = some.column(vector).combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    width = int(np.bincount(sizes).argmax())
    x = _units(column.filter(pa.array(sizes == width)), width)
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.sqrt(np.einsum("ij,ij->i", total, total))
        c = np.where(norm[:, None] > 0, total / np.maximum(norm, 1e-300)[:, None], c)
    return c


def build(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", lists: int = LISTS, sample: int = SAMPLE) -> None:
    """Write the lists of all vectors, in folders by list; a list that holds many is spread over tasks by the key. Vectors without a place (null, of another length) are in list -1, which each search reads."""
    c = centroids(vectors, vector, key, lists, sample)
    rows = vectors.select(key, vector)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            column = batch.column(vector)
            sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
            near = np.full(batch.num_rows, -1, np.int32)
            fits = np.flatnonzero(sizes == c.shape[1]) if len(c) else np.zeros(0, np.int64)
            if len(fits):
                near[fits] = (_units(column.take(pa.array(fits)), c.shape[1]) @ c.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], [*batch.schema.names, "list"])

    placed = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("list", IntegerType())]))
    placed.repartition("list", F.pmod(F.xxhash64(key), F.lit(8))).write.partitionBy("list").parquet(f"{path}/lists")
    spark = vectors.sparkSession
    # an index of no vectors has no files in its lists, so their schema stands beside them
    spark.createDataFrame([], placed.schema).write.parquet(f"{path}/schema")
    spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(c)], "list int, centroid array<double>").write.parquet(f"{path}/centroids")


def probed(spark: SparkSession, path: str, query: list[float], k: int = 10, probes: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k vectors of the largest cosine similarity among those of the `probes` lists whose centroids are nearest to the query."""
    q = np.asarray(query, dtype=np.float64)
    known = spark.read.schema("list int, centroid array<double>").parquet(f"{path}/centroids").collect()  # one row for each list
    near = sorted(known, key=lambda r: (-float(np.dot(r.centroid, q)), r.list))[:probes]
    some = spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/lists").filter(F.col("list").isin([-1, *[r.list for r in near]]))
    return R.nearest(some, query, k, key, vector)


def recall(spark: SparkSession, path: str, vectors: DataFrame, queries: list[list[float]], k: int = 10, probes: int = 8) -> float:
    """The part of the exact k nearest vectors of the queries that probing finds."""
    hits = [len({r[0] for r in probed(spark, path, q, k, probes).collect()} & {r[0] for r in R.nearest(vectors, q, k).collect()}) for q in queries]
    return sum(hits) / max(1, k * len(queries))
