"""Cuts of a stream of any length, in parallel: as `steps.cut` makes them in one walk.

Where a part that begins at a row would end is a function of that row alone. So:

1. A stream is dealt in chunks of about `WIDTH` budgets, each with as many rows of the next chunk as a part may reach into. For every row of a chunk the task finds where a part that begins there ends, and
   where the cuts that follow from it leave the chunk: always into the next one.
2. These maps, from a row at which a chunk is entered to the row at which the next one is, are composed in groups of `FAN` chunks, round by round, until a stream has one. A group is entered in its first chunk alone, so a
   round has a `FAN`th of the rows of the one before.
3. A stream begins with a cut. Downwards the groups are walked again, which gives each chunk the row at which it is entered, and so its cuts; the parts are numbered by running sums over chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engramlake.operators.steps import positions, settled

WIDTH, FAN, STRETCH = 16, 64, 4096


def _ends(sizes: np.ndarray, marks: list, n: int, most: float, count: int | None) -> list[int | None]:
    """For each of the first n rows the row before which a part that begins there ends; None: at the end of the stream, as far as is known."""
    first, run_end = [None] * len(marks), [len(marks)] * len(marks)
    for i in range(len(marks) - 1, -1, -1):
        if marks[i] is not None:
            first[i] = i
            run_end[i] = run_end[i + 1] if i + 1 < len(marks) and marks[i + 1] == marks[i] else i + 1
        else:
            first[i] = first[i + 1] if i + 1 < len(marks) else None
    out: list[int | None] = []
    total = np.concatenate([[0.0], np.cumsum(sizes)])
    for i in range(n):
        # as far as the budget may reach, then exactly as a walk adds up
        far = min(len(sizes), int(np.searchsorted(total, total[i] + most * (1 + 1e-9) + 1e-6, side="right")) + 1)
        over = np.flatnonzero(np.cumsum(sizes[i:far])[1:] > most)
        stops = [i + 1 + int(over[0])] if len(over) else []
        if count is not None:
            stops.append(i + max(1, count))
        if first[i] is not None:
            stops.append(run_end[first[i]])
        stop = min(stops, default=len(sizes))
        out.append(stop if stop < len(sizes) else None)
    return out


def _chunks(stream: Iterator[pa.RecordBatch], most: float, count: int | None) -> Iterator[tuple]:
    """Of each chunk its key and rank, the entry that was put before it (or None), its rows' columns, the number of its own rows, and the ends of parts that begin there."""

    def rows() -> Iterator[tuple]:
        for batch in stream:
            yield from zip(*(batch.column(c).to_pylist() for c in ("_key", "_rank", "_entry", "pos", "_size", "_mark", "_halo")))

    for (key, rank), part in groupby(rows(), key=lambda r: r[:2]):
        entry, own = None, []
        for r in part:
            if r[3] is None:
                entry = r[2]
            else:
                own.append(r)
        if not own:
            continue
        n = sum(not r[6] for r in own)
        yield key, rank, entry, [r[3] for r in own], n, _ends(np.array([r[4] or 0.0 for r in own]), [r[5] for r in own], n, most, count)


def _emitted(rows: Iterator[tuple], schema: pa.Schema, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _grouped(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Key, group, entry, and the maps of the group's nodes in order."""

    def rows() -> Iterator[tuple]:
        for batch in stream:
            yield from zip(*(batch.column(c).to_pylist() for c in ("_key", "_group", "_node", "_from", "_to", "_entry")))

    for (key, group), part in groupby(rows(), key=lambda r: r[:2]):
        entry, maps = None, {}
        for _, _, node, lo, hi, at in part:
            if node is None:
                entry = at
            else:
                maps.setdefault(node, {})[lo] = hi
        yield key, group, entry, sorted(maps.items())


def cut_long(rows: DataFrame, key: str, order: list[str], size: str, most: float, count: int | None = None, mark: str | None = None, name: str = "block", width: int = WIDTH, fan: int = FAN) -> DataFrame:
    """The rows with a number `name` (from 0) of the part of their key that each falls into, as `steps.cut` gives it, for sizes that are not negative.

    Rows whose sizes are 0 do not fill a chunk, so a chunk has as many of them as follow each other.
    """
    names = rows.columns
    key_type = pa.field("_key", pa.string())
    placed = positions(rows.withColumn("_key", F.to_json(F.struct(F.col(key).alias("k")))), key, *order)
    placed = placed.withColumns({"_size": F.greatest(F.coalesce(F.col(size).cast("double"), F.lit(0.0)), F.lit(0.0)), "_mark": F.col(mark).cast("string") if mark else F.lit(None).cast("string"), "_stretch": F.floor(F.col("pos") / STRETCH)})
    sums = placed.groupBy("_key", "_stretch").agg(F.sum("_size").alias("_sum"))
    sums = sums.withColumn("_base", F.sum("_sum").over(W.partitionBy("_key").orderBy("_stretch")) - F.col("_sum")).drop("_sum")
    before = F.coalesce(F.sum("_size").over(W.partitionBy("_key", "_stretch").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    placed = placed.withColumn("_within", before).join(sums, ["_key", "_stretch"]).withColumn("_sum", F.col("_within") + F.col("_base"))
    placed = settled(placed.withColumn("_chunk", F.floor(F.col("_sum") / (most * width))).drop("_stretch", "_within", "_base"))
    chunks = placed.groupBy("_key", "_chunk").agg(F.min("pos").alias("_first"), F.max("_sum").alias("_last"))
    along = W.partitionBy("_key").orderBy("_chunk")
    chunks = chunks.withColumns({"_rank": (F.row_number().over(along) - 1).cast("long"), "_reach": F.lag("_last").over(along) + most * (1 + 1e-9) + 1e-6})
    ranked = placed.join(chunks.select("_key", "_chunk", "_rank", "_first", "_reach"), ["_key", "_chunk"])
    near = (F.col("_rank") > 0) & ((F.col("_sum") <= F.col("_reach")) | (F.col("pos") == F.col("_first")))
    both = F.when(near, F.array(F.col("_rank"), F.col("_rank") - 1)).otherwise(F.array("_rank"))
    lean = ranked.select("_key", "pos", "_size", "_mark", F.col("_rank").alias("_own"), F.explode(both).alias("_rank"))
    lean = settled(lean.select("_key", "_rank", F.lit(None).cast("long").alias("_entry"), "pos", "_size", "_mark", (F.col("_own") != F.col("_rank")).alias("_halo")))
    dealt = lambda x, *by: x.repartition("_key", by[0]).sortWithinPartitions("_key", *by)

    maps_kind = pa.schema([key_type, ("_node", pa.int64()), ("_from", pa.int64()), ("_to", pa.int64())])

    def maps(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for k, rank, _, pos, n, ends in _chunks(stream, most, count):
                leave: list[int | None] = [None] * n
                for i in range(n - 1, -1, -1):
                    at = ends[i]
                    leave[i] = None if at is None else pos[at] if at >= n else leave[at]
                for i in range(n):
                    yield k, rank, pos[i], leave[i]

        yield from _emitted(each(), maps_kind)

    ddl = "_key string, _node long, _from long, _to long"
    levels = [settled(dealt(lean, "_rank", "pos").mapInArrow(maps, ddl))]
    top = levels[0].agg(F.max("_node")).first()[0] or 0

    def composed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for k, group, _, nodes in _grouped(stream):
                for lo in nodes[0][1]:
                    at: int | None = lo
                    for _, found in nodes:
                        at = found[at] if at is not None else None
                    yield k, group, lo, at

        yield from _emitted(each(), maps_kind)

    def groups(x: DataFrame) -> DataFrame:
        return x.withColumn("_group", F.floor(F.col("_node") / fan))

    none = F.lit(None).cast("long")
    for _ in range(math.ceil(math.log(top + 1, fan)) if top else 0):
        up = groups(levels[-1]).withColumn("_entry", none)
        levels.append(settled(dealt(up, "_group", "_node", "_from").mapInArrow(composed, ddl)))

    entries_kind = pa.schema([key_type, ("_node", pa.int64()), ("_entry", pa.int64())])

    def walked(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for k, _, at, nodes in _grouped(stream):
                for node, found in nodes:
                    if at is None:
                        break
                    yield k, node, at
                    at = found[at]

        yield from _emitted(each(), entries_kind)

    entries = levels[-1].filter("_node = 0 AND _from = 0").select("_key", "_node", F.col("_from").alias("_entry"))
    for below in reversed(levels[:-1]):
        first = entries.select("_key", F.col("_node").alias("_group"), none.alias("_node"), none.alias("_from"), none.alias("_to"), "_entry")
        all_ = groups(below).withColumn("_entry", none).select("_key", "_group", "_node", "_from", "_to", "_entry").unionByName(first)
        entries = settled(dealt(all_, "_group", "_node", "_from").mapInArrow(walked, "_key string, _node long, _entry long"))

    cuts_kind = pa.schema([key_type, ("_rank", pa.int64()), ("pos", pa.int64()), ("_cut", pa.bool_())])

    def marked(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for k, rank, entry, pos, n, ends in _chunks(stream, most, count):
                cuts, at = set(), None if entry is None else entry - pos[0]
                while at is not None and at < n:
                    cuts.add(at)
                    at = ends[at]
                for i in range(n):
                    yield k, rank, pos[i], i in cuts

        yield from _emitted(each(), cuts_kind)

    heads = entries.select("_key", F.col("_node").alias("_rank"), "_entry", none.alias("pos"), F.lit(None).cast("double").alias("_size"), F.lit(None).cast("string").alias("_mark"), F.lit(None).cast("boolean").alias("_halo"))
    cut = settled(dealt(lean.unionByName(heads), "_rank", "pos").mapInArrow(marked, "_key string, _rank long, pos long, _cut boolean"))
    per = cut.groupBy("_key", "_rank").agg(F.sum(F.col("_cut").cast("long")).alias("_n"))
    per = per.withColumn("_from", F.sum("_n").over(W.partitionBy("_key").orderBy("_rank")) - F.col("_n")).drop("_n")
    own = F.sum(F.col("_cut").cast("long")).over(W.partitionBy("_key", "_rank").orderBy("pos"))
    numbered = cut.withColumn("_in", own).join(per, ["_key", "_rank"]).select("_key", "pos", (F.col("_from") + F.col("_in") - 1).alias(name))
    return placed.join(numbered, ["_key", "pos"]).select(*names, name)
