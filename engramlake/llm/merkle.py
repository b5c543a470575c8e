"""A Merkle manifest of a dataset: every row's leaf, the root of its group, the root of all, and a path that proves the row.

A run of three nodes has the digest of their digests (the last run of a level may have fewer, even one); a tree has one level more as long as
several nodes are left. Each group of rows is a tree, its leaves in order, and the roots of the groups, in order of the groups, are the leaves of one more tree.

1. Rows become leaves (`leaves`), which are ranked in their group by a range sort; texts are not shuffled.
2. Upwards (`climb`): aligned blocks of 3^`HEIGHT` nodes are dealt to tasks, and one treehash stack for each block gives the block's root;
   the blocks' roots are the nodes of the next round, until each tree has one node. A round has 243 times fewer nodes than the one before.
3. Downwards (`descend`): each block meets the path of its own root, which all its nodes share. In the block the paths advance leaf by leaf: for
   each level there is the run that the path passes now, and a treehash stack that makes the next run, one leaf at a time, so that it is ready
   when the path gets there. Beside the block's leaves, a traversal holds three nodes a level for the stacks and three for the path.

A path is a list of (before, after), from the leaf to the root: the digests of the run's other nodes to the left and to the right, joined. So
folding a digest is H(before || digest || after) for each entry, with built-in functions.

Defined results: a null field is `-`; ids and groups that are null come first; equal ids are ordered by leaf, and equal rows have leaves of their own; an empty
table has no rows; extra columns are not read. A lone leaf is its tree's root, with an empty path. Texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.llm.common import durable, observed
from engramlake.llm.ordering import in_order, positions, whole_runs

#: Fixed value: nodes in a run.
FAN = 3
#: Levels of an aligned block.
HEIGHT = 5

_PATH = "array<struct<before:string,after:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(n: int) -> int:
    """Levels above n leaves, counted until one node is left."""
    height = 0
    while n > 1:
        n, height = -(-n // FAN), height + 1
    return height


class Treehash:
    """The nodes of one level over leaves that are given one at a time; holds at most two nodes of each level below."""

    def __init__(self, level: int):
        self.level = level
        self.stack: list[list[str]] = [[] for _ in range(level + 1)]

    def push(self, node: str, at: int = 0) -> None:
        while True:
            held = self.stack[at]
            held.append(node)
            if at == self.level or len(held) < FAN:
                return
            node, at = digest("".join(held)), at + 1
            held.clear()

    def nodes(self) -> list[str]:
        """The level's nodes; runs that the last leaf has left unfilled are closed."""
        for k in range(self.level):
            if self.stack[k]:
                node = digest("".join(self.stack[k]))
                self.stack[k].clear()
                self.push(node, k + 1)
        return self.stack[self.level]


def top(leaves: list[str], height: int) -> str:
    """The one node at `height` above a block's leaves."""
    work = Treehash(height)
    for leaf in leaves:
        work.push(leaf)
    return work.nodes()[0]


def traverse(leaves: list[str], height: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf of a block, in order, its path of `height` levels as (before, after) pairs."""
    spans = [FAN ** (k + 1) for k in range(height)]
    runs, ahead = [], []
    for k, span in enumerate(spans):
        first = Treehash(k)
        for leaf in leaves[:span]:
            first.push(leaf)
        runs.append(first.nodes())
        ahead.append(Treehash(k))
    path = [("", "")] * height
    for i in range(len(leaves)):
        for k, span in enumerate(spans):
            below = span // FAN
            if i % below:
                break  # nodes of this level and above are those of the leaf before
            place = i // below % FAN
            path[k] = "".join(runs[k][:place]), "".join(runs[k][place + 1 :])
        yield path
        for k, span in enumerate(spans):
            if i + span < len(leaves):
                ahead[k].push(leaves[i + span])
            if (i + 1) % span == 0:
                runs[k], ahead[k] = ahead[k].nodes(), Treehash(k)


class _Blocks:
    """Aligned blocks of `height` levels (fewer in a tree that has no more) in a stream of nodes."""

    def __init__(self, height: int):
        self.height, self.size = height, FAN**height

    def begins(self, rows: pa.Table) -> np.ndarray:
        return rows.column("pos").to_numpy() % self.size == 0

    def each(self, rows: pa.Table, at: np.ndarray) -> Iterator[tuple[list[str], int]]:
        """Each block's leaves and height."""
        nodes, n = rows.column("node").to_pylist(), rows.column("n").to_numpy()
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            yield nodes[lo:hi], self.height if n[lo] > self.size else levels(int(n[lo]))

    def roots(self, stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in whole_runs(stream, self.begins):
            tops = [top(nodes, height) for nodes, height in self.each(rows, at)]
            first = rows.take(at[:-1])
            up = lambda c: np.asarray(first.column(c).to_numpy())
            place, n = pa.array(up("pos") // self.size), pa.array(-(-up("n") // self.size))
            yield pa.RecordBatch.from_arrays([first.column("tree").combine_chunks(), place, n, pa.array(tops, pa.string())], ["tree", "pos", "n", "node"])

    def paths(self, stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in whole_runs(stream, self.begins):
            ends, before, after = [0], [], []
            for nodes, height in self.each(rows, at):
                for path in traverse(nodes, height):
                    before += [b for b, _ in path]
                    after += [a for _, a in path]
                    ends.append(len(before))
            pairs = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"])
            own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield from rows.append_column("own", own).to_batches()


def _dealt(nodes: DataFrame) -> DataFrame:
    """Nodes in order, each block in one task."""
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "pos")


def climb(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """From nodes (tree, pos, n, node, any more) the rounds of blocks' roots, up to the round in which each tree has one."""
    blocks, kind = _Blocks(height), nodes.schema["tree"].dataType.simpleString()
    rounds, most = [nodes], None
    while most is None or most > 1:
        now = rounds[-1].select("tree", "pos", "n", "node").withColumn("block", F.floor(F.col("pos") / blocks.size))
        up = _dealt(now).mapInArrow(blocks.roots, f"tree {kind}, pos long, n long, node string")
        up, (most,) = observed(up, "merkle-roots", F.coalesce(F.max("n"), F.lit(0)))
        rounds.append(up)
    return rounds


def descend(rounds: list[DataFrame], above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The first round's rows with path and roots. above: path and roots of each tree's own root, by tree."""
    blocks, kept = _Blocks(height), [f.name for f in rounds[0].schema]
    on = lambda rows, more, *keys: rows.join(more, [rows[a].eqNullSafe(more[b]) for a, b in keys]).drop(*[more[b] for _, b in keys])
    tops = rounds[-1].select(F.col("tree"), F.col("pos"), F.col("node").alias("root"))
    up = above.select(F.col("tree").alias("of"), "path", "roots")
    up = on(tops, up, ("tree", "of")).select("tree", "pos", "path", F.concat(F.array("root"), "roots").alias("roots"))
    for depth, nodes in enumerate(reversed(rounds[:-1])):
        now = nodes.withColumn("block", F.floor(F.col("pos") / blocks.size))
        met = on(now, up.select(F.col("tree").alias("of"), F.col("pos").alias("at"), "path", "roots"), ("tree", "of"), ("block", "at"))
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema)
        out = _dealt(met).mapInArrow(blocks.paths, f"{kind}, own {_PATH}")
        last = depth == len(rounds) - 2
        out = out.select(*(kept if last else ["tree", "pos"]), F.concat("own", "path").alias("path"), "roots")
        up = out if last else durable(out, "merkle-paths")
    return up


def leaves(docs: DataFrame, columns: list[str], text: Column | None = None) -> Column:
    """The digest of a row's columns, in order: `-` for null, else its bytes in UTF-8, `:`, itself. text: stands for the last column."""
    each = [F.col(c).cast("string") for c in columns[:-1]] + [F.col(columns[-1]) if text is None else text]
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in each]
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda at, step: F.sha2(F.concat(step["before"], at, step["after"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path, level by level, left to right, as one string."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """From rows (id, tree, node, any more) the same rows with path and roots (the group's root, the root of all)."""
    ordered = in_order(rows, "merkle-leaves", "tree", "id", "node")
    rounds = climb(positions(ordered, "tree"), height)
    groups = in_order(rounds[-1].select(F.lit(0).alias("all"), F.col("tree").alias("of"), "node"), "merkle-groups", "all", "of")
    over = climb(positions(groups.withColumnRenamed("all", "tree"), "tree"), height)
    root = over[-1].select("tree", F.array().cast(_PATH).alias("path"), F.array().cast("array<string>").alias("roots"))
    above = descend(over, root, height).select(F.col("of").alias("tree"), "path", "roots")
    return descend(rounds, above, height)


def audit(docs: DataFrame, tampered: Column, text: Column, height: int = HEIGHT) -> DataFrame:
    """Documents' manifest with a check of every row: doc_id, leaf, subroot, root, proof_sha256, and folded_root from the row as it is now.

    tampered: rows whose text is `text` now.
    """
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    now = F.when(F.coalesce(tampered, F.lit(False)), leaves(docs, columns, text)).otherwise(leaves(docs, columns))
    made = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("tree"), leaves(docs, columns).alias("node"), now.alias("now"))
    out = manifest(durable(made, "merkle-rows"), height)
    folded = fold(F.col("now"), F.col("path"))
    return out.select(
        F.col("id").alias("doc_id"), F.col("node").alias("leaf"), F.col("roots")[0].alias("subroot"), F.col("roots")[1].alias("root"),
        F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
