"""A global order for tables of any size, and Arrow streams cut at the edges of runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engramlake.llm.common import durable

#: Bits of a row's place in its partition in `monotonically_increasing_id`.
PLACE_BITS = 33


def in_order(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """The rows, written sorted by the keys (nulls first) over range partitions, with `at`: a long that grows in that order.

    Equal rows are dealt to neighbouring partitions by their place in the input, so no key fills a partition alone. The input is read twice (once for the
    bounds of the ranges): give a durable table, whose order of rows is fixed.
    """
    each = df.withColumn("at", F.monotonically_increasing_id())
    ranged = each.repartitionByRange(*keys, "at").sortWithinPartitions(*keys, "at")
    return durable(ranged.withColumn("at", F.monotonically_increasing_id()), name)


def positions(ordered: DataFrame, group: str) -> DataFrame:
    """Rows of `in_order` (whose first key is `group`) with pos, from 0 inside their group, and n, the group's rows.

    Only the number of rows of each group in each partition is gathered: a group has at most one such row for a partition.
    """
    part = F.shiftright("at", PLACE_BITS)
    held = ordered.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before, all_ = W.partitionBy("_group").orderBy("_part"), W.partitionBy("_group")
    held = held.withColumns({"_from": F.sum("_rows").over(before) - F.col("_rows") - F.col("_first"), "n": F.sum("_rows").over(all_)})
    met = ordered.join(held, F.col(group).eqNullSafe(F.col("_group")) & (part == F.col("_part")))
    return met.withColumn("pos", F.col("at") + F.col("_from")).drop("_group", "_part", "_first", "_rows", "_from", "at")


def whole_runs(stream: Iterator[pa.RecordBatch], begins: Callable[[pa.Table], np.ndarray]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs, with the index of each run's first row (and the number of rows at the end). `begins` marks rows that begin a run."""
    left: list[pa.RecordBatch] = []
    for batch in stream:
        rows = pa.Table.from_batches([*left, batch])
        at = np.flatnonzero(begins(rows))
        if len(at) > 1:
            yield rows.slice(0, int(at[-1])).combine_chunks(), at
            rows = rows.slice(int(at[-1]))
        left = rows.to_batches()
    if left and (rows := pa.Table.from_batches(left)).num_rows:
        yield rows.combine_chunks(), np.append(np.flatnonzero(begins(rows)), rows.num_rows)
