"""What operators that go on step by step need: steps settled before the next builds on them, and walks in order with little state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType


def _shared(spark: SparkSession) -> str:
    """The folder that all executors reach: spark.checkpoint.dir, else, on a local master, one beside the warehouse."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The rows, written where all executors reach them and read back.

    Without it, a step's plan holds the plans of all steps before it several times over. A checkpoint would cut the plan too, but it keeps the plan's estimate of its size, which joins
    multiply from step to step until it has too many digits to handle; a table has the size of its files.
    """
    path = shared_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(
    rows: DataFrame, keys: list[str], order: list[Column], size: str, most: float, count: int | None = None, mark: str | None = None,
    whole: str | None = None, name: str = "block",
) -> DataFrame:
    """The rows with a number `name` (from 0) of the part of its key that each falls into, walking each key in order.

    A part ends before the row that would bring its sizes above `most` or its rows above `count`, and before a row whose mark is not the
    first mark that the part has. Rows with `whole` are not cut. Each cut depends on the one before, so a key is one task's walk; it is a
    sorted stream of record batches, of which only the running totals are kept.
    """

    def walk(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, total, n, first = None, 0, 0.0, 0, None
        for batch in stream:
            out = []
            ids = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            sizes = batch.column(size).to_pylist()
            marks = batch.column(mark).to_pylist() if mark else [None] * len(ids)
            uncut = batch.column(whole).to_pylist() if whole else [False] * len(ids)
            for key, s, m, w in zip(ids, sizes, marks, uncut):
                s = s or 0.0
                if key != now:
                    now, part, total, n, first = key, 0, 0.0, 0, None
                elif not w and n and ((first is not None and m != first) or total + s > most or (count is not None and n >= count)):
                    part, total, n, first = part + 1, 0.0, 0, None
                total, n, first = total + s, n + 1, m if first is None else first
                out.append(part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, name])

    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return sorted_rows.mapInArrow(walk, StructType([*rows.schema.fields, StructField(name, LongType())]))


def digested(rows: DataFrame, keys: list[str], order: list[Column], text: str, separator: str = "\n") -> DataFrame:
    """(keys, hash): SHA-256 of each key's texts in order, joined by the separator (null: empty).

    The texts of a key are a sorted stream into a running hash, so no key is gathered, however long it is.
    """
    import hashlib

    def walk(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []
        for batch in stream:
            ids = zip(*[batch.column(k).to_pylist() for k in keys])
            for key, value in zip(ids, batch.column(text)):
                if digest is None or key != now:
                    if digest is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256()
                else:
                    digest.update(separator.encode())
                if value.is_valid:
                    digest.update(value.as_buffer())
            if len(done) >= 10_000:
                yield emit(done)
                done = []
        if digest is not None:
            done.append((*now, digest.hexdigest()))
        if done:
            yield emit(done)

    def emit(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], [*keys, "hash"])

    x = rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, text)
    fields = x.select(*keys).schema.fields
    types = [to_arrow_type(f.dataType) for f in fields] + [pa.string()]
    return x.mapInArrow(walk, StructType([*fields, StructField("hash", StringType())]))


def positions(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """The rows with pos, from 0 inside their group in the order given (nulls first).

    Rows are sorted over range partitions, so a group of any size is spread; only its number of rows in each partition is gathered.
    """
    each = settled(rows).withColumn("_at", F.monotonically_increasing_id())
    each = each.repartitionByRange(group, *order, "_at").sortWithinPartitions(group, *order, "_at").withColumn("_at", F.monotonically_increasing_id())
    each = settled(each.withColumn("_part", F.shiftright("_at", 33)))
    held = each.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_in")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(W.partitionBy("_group").orderBy("_in")) - F.col("_rows") - F.col("_first")
    held = held.withColumn("_from", before).drop("_first", "_rows")
    met = each.join(held, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_in")))
    return met.withColumn("pos", F.col("_at") + F.col("_from")).drop("_at", "_part", "_group", "_in", "_from")
