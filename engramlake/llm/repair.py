"""Repair of conversation structure: the cheapest edits that make a conversation's roles `(s?(ua)+)?`, found by a min-plus scan of its turns.

A turn may be kept (0), given the role user or assistant (3) or deleted (4); blank turns and repeats of an earlier one must be deleted, and a truncated
turn that stays costs 3 more. Before, between and after turns an empty turn of the user or the assistant may be inserted (3). Of the cheapest ways, the one whose
audit (the initials of its edits, in order) comes first in ASCII order is taken.

States are what the roles written so far end with: nothing, s, u, a. A turn is a 4x4 matrix over (cost, audit): the best way from one state to another that deals with
the turn, followed by insertions (the insert closure). Products of matrices add costs and join audits, sums take the least (cost, audit). That is a semiring here: of two ways through the same
turns with one cost, no audit starts with the other (the rest would be insertions, which cost), so joining on either side keeps their order.

1. Turns are ordered over range partitions (`ordering.in_order`) and dealt as runs of `RUN` consecutive turns, whatever their conversations.
   A conversation that touches no edge of a run is whole there; of the others each run gives the product of its turns.
2. Products of one conversation are multiplied in groups of `FAN` neighbours, round by round, until it has one: the product is associative.
3. The least way from nothing to nothing or to a is the result. Downwards the same groups are walked to find the states at their edges, and so each run's audit.
4. The repaired conversation is hashed in order. That is sequential by nature: one stream with one running hash, in bounded memory.

A conversation's audit is one string, so 16 strings of a letter a turn are what its topmost product takes.

Defined results: nulls in any column are one space where text is needed; null turns come first; turns of one number are ordered by role and text; rows with a null conversation are one
conversation; repeated rows are turns of their own, and the later ones duplicates; a conversation without turns has zeros, an empty audit and the hash of nothing; an empty
table has no rows; extra columns are not read. A role counts by its first letter, whatever follows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.llm import tokens as tk
from engramlake.llm.common import SPACES, durable
from engramlake.llm.ordering import in_order, whole_runs

#: Turns in a run, and products multiplied at a time.
RUN, FAN = 256, 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
STATES = 4
#: Where a role's initial leads from each state; a state that it does not stand for is left out.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ENDS = (0, 3)

Way = tuple[int, str] | None
Matrix = list[list[Way]]


def _least(a: Way, b: Way) -> Way:
    return b if a is None or b is not None and b < a else a


def times(a: Matrix, b: Matrix) -> Matrix:
    """The product of two matrices."""
    out: Matrix = []
    for row in a:
        best: list[Way] = [None] * STATES
        for way, then in zip(row, b):
            if way is not None:
                for j, more in enumerate(then):
                    if more is not None:
                        best[j] = _least(best[j], (way[0] + more[0], way[1] + more[1]))
        out.append(best)
    return out


def _closure() -> Matrix:
    """Any number of insertions; two lead from each state to all that insertions can reach."""
    one: Matrix = [[(0, "") if i == j else None for j in range(STATES)] for i in range(STATES)]
    for role in ("u", "a"):
        for i, j in STEPS[role].items():
            one[i][j] = _least(one[i][j], (INSERT, "I"))
    return times(one, one)


CLOSURE = _closure()


def turn(initial: str, must_go: bool, truncated: bool) -> Matrix:
    """A turn's matrix with its insert closure."""
    way: Matrix = [[(DELETE, "D") if i == j else None for j in range(STATES)] for i in range(STATES)]
    if not must_go:
        more = TRUNCATED if truncated else 0
        for i, j in STEPS.get(initial, {}).items():
            way[i][j] = _least(way[i][j], (KEEP + more, "K"))
        for role in ("u", "a"):
            for i, j in STEPS[role].items():
                way[i][j] = _least(way[i][j], (REROLE + more, "R"))
    return times(way, CLOSURE)


_TURNS = {(s, g, t): turn(s, g, t) for s in ("s", "u", "a", "") for g in (False, True) for t in (False, True)}


def product(kinds: list[tuple[str, bool, bool]]) -> Matrix:
    """The matrix of consecutive turns, with insertions before them."""
    out = CLOSURE
    for kind in kinds:
        out = times(out, _TURNS[kind])
    return out


def path(parts: list[Matrix], start: int, end: int) -> list[int]:
    """States at the edges of consecutive parts on the least way from start to end."""
    best: list[Way] = [(0, "") if j == start else None for j in range(STATES)]
    back: list[list[int]] = []
    for part in parts:
        now: list[Way] = [None] * STATES
        came = [0] * STATES
        for i, way in enumerate(best):
            if way is not None:
                for j, more in enumerate(part[i]):
                    got = None if more is None else (way[0] + more[0], way[1] + more[1])
                    if got is not None and (now[j] is None or got < now[j]):
                        now[j], came[j] = got, i
        best = now
        back.append(came)
    states = [end]
    for came in reversed(back):
        states.append(came[states[-1]])
    return states[::-1]


# Damage and faults, with built-in functions


def damaged(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) of which some are dropped, emptied, cut, repeated or given another role, by a hash of their ids; dropped ones stay as rows with `there` false."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.pmod(F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")), F.lit(20))
    text = F.when(lot == 1, "").when(lot == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(lot == 4, "user").otherwise(said("role"))
    copies = F.when(lot == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (lot != 0).alias("there"), copies.alias("copies"))
    return out.withColumn("copies", F.explode("copies")).drop("copies")


def _kinds(ordered: DataFrame) -> DataFrame:
    """Per turn, without its text: conv_id, at, initial, and whether it is blank, a duplicate, truncated (the first of these that holds)."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    blank = bare == ""
    cut = ~F.substring(bare, -1, 1).isin(".", "!", "?")
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    each = ordered.select("conv_id", "at", "run", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), cut.alias("cut"), F.unhex(same).alias("same"))
    seen = each.groupBy(F.col("conv_id").alias("of"), F.col("same").alias("like")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("many"))
    met = each.join(seen.filter("many > 1"), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("same") == F.col("like")), "left")
    again = ~F.col("blank") & F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    return met.select("conv_id", "at", "run", "initial", "blank", again.alias("again"), (F.col("cut") & ~F.col("blank") & ~again).alias("cut"))


# The scan

_NODE = pa.schema(
    [("conv_id", pa.int64()), ("place", pa.int64()), ("edge", pa.bool_()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("cost", pa.list_(pa.int64())), ("audit", pa.list_(pa.string()))]
)
_NODE_DDL = "conv_id long, place long, edge boolean, blank long, duplicate long, truncated long, illegal long, head string, tail string, cost array<long>, audit array<string>"
_LEGAL = {"su", "ua", "au"}


def _packed(m: Matrix) -> dict:
    flat = [way for row in m for way in row]
    return {"cost": [None if w is None else w[0] for w in flat], "audit": [None if w is None else w[1] for w in flat]}


def _matrix(row: dict) -> Matrix:
    flat = [None if c is None else (c, a) for c, a in zip(row["cost"], row["audit"])]
    return [flat[k : k + STATES] for k in range(0, STATES * STATES, STATES)]


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about `most` letters of audits."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 256 + sum(len(a or "") for a in row.get("audit", ()))
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _new_run(rows: pa.Table) -> np.ndarray:
    run = rows.column("run").to_numpy()
    return np.concatenate([[True], run[1:] != run[:-1]])[: len(run)]


def _runs(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The product of each conversation's turns in each run; edge: the conversation touches the run's edge and may go on beyond it."""
    for rows, at in whole_runs(stream, _new_run):
        table = list(zip(*(rows.column(c).to_pylist() for c in ("conv_id", "initial", "blank", "again", "cut"))))
        runs, out = rows.column("run"), []
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            place, k = runs[lo].as_py(), lo
            for conv, turns in groupby(table[lo:hi], key=lambda r: r[0]):
                turns = list(turns)
                initials = [t[1] for t in turns]
                kinds = [(i if i in STEPS else "", b or d, c) for _, i, b, d, c in turns]
                out.append(
                    {"conv_id": conv, "place": place, "edge": k == lo or k + len(turns) == hi, "blank": sum(t[2] for t in turns), "duplicate": sum(t[3] for t in turns), "truncated": sum(t[4] for t in turns)}
                    | {"illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])), "head": initials[0], "tail": initials[-1]}
                    | _packed(product(kinds))
                )
                k += len(turns)
        yield from _batches(iter(out), _NODE)


def _stream(stream: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in stream:
        for k in range(batch.num_rows):  # a row at a time: its strings may be long
            yield batch.slice(k, 1).to_pylist()[0]


def _products(stream: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for (conv, group), rows in groupby(_stream(stream), key=lambda r: (r["conv_id"], r["up"])):
        now, total = None, None
        for row in rows:
            if now is None:
                now, total = row, _matrix(row)
                continue
            now["illegal"] += row["illegal"] + (now["tail"] + row["head"] not in _LEGAL)
            for c in ("blank", "duplicate", "truncated"):
                now[c] += row[c]
            now["tail"], total = row["tail"], times(total, _matrix(row))
        yield {k: now[k] for k in _NODE.names if k in now} | {"conv_id": conv, "place": group} | _packed(total)


def _joined(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One product for each group of neighbours of one conversation."""
    yield from _batches(_products(stream), _NODE)


def _walked(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states at the edges of each product of a group, on the least way between the group's own."""
    names = ["conv_id", "place", "start", "end"]

    def each() -> Iterator[dict]:
        for (conv, _), rows in groupby(_stream(stream), key=lambda r: (r["conv_id"], r["up"])):
            rows = list(rows)
            states = path([_matrix(r) for r in rows], rows[0]["start"], rows[0]["end"])
            for r, i, j in zip(rows, states, states[1:]):
                yield dict(zip(names, (conv, r["place"], i, j)))

    yield from _batches(each(), pa.schema([(c, pa.int64()) for c in names]))


def _groups(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("up", F.floor(F.col("place") / FAN)).repartition("conv_id", "up").sortWithinPartitions("conv_id", "up", "place")


def _best(cost: str = "cost", audit: str = "audit") -> Column:
    """The end of the least way from nothing."""
    way = lambda j: F.struct(F.coalesce(F.col(cost)[j], F.lit(2**62)).alias("c"), F.col(audit)[j].alias("a"))
    return F.when(way(ENDS[0]) <= way(ENDS[1]), F.lit(ENDS[0])).otherwise(F.lit(ENDS[1]))


def numbered(ordered: DataFrame) -> tuple[DataFrame, int]:
    """Ordered turns with the number of their run, and a bound of these numbers."""
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    most = ordered.agg(F.max(part).alias("parts"), F.max(place).alias("places")).first()
    if most.parts is None:
        return ordered.withColumn("run", F.lit(0).cast("long")), 0
    wide = most.places // RUN + 1
    return ordered.withColumn("run", part * wide + F.floor(place / RUN)), (most.parts + 1) * wide


def scan(ordered: DataFrame, runs: int) -> tuple[DataFrame, DataFrame]:
    """From numbered turns: per conversation its faults and its least way (cost, audit); and each run's part of the audit (conv_id, place, audit)."""
    first = durable(_kinds(ordered).repartition("run").sortWithinPartitions("run", "at").mapInArrow(_runs, _NODE_DDL), "repair-runs")
    rounds = [first.filter("edge")]
    for _ in range(max(1, math.ceil(math.log(max(2, runs), FAN)))):
        rounds.append(durable(_groups(rounds[-1]).mapInArrow(_joined, _NODE_DDL), "repair-products"))
    done = first.filter("NOT edge").unionByName(rounds[-1]).withColumn("end", _best())
    faults = done.select("conv_id", "blank", "duplicate", "truncated", "illegal", F.element_at("cost", F.col("end") + 1).alias("cost"), F.element_at("audit", F.col("end") + 1).alias("audit"))
    ways = rounds[-1].select("conv_id", "place", F.lit(0).cast("long").alias("start"), _best().cast("long").alias("end"))
    on = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    for nodes in reversed(rounds[:-1]):
        above = ways.select(F.col("conv_id").alias("of"), F.col("place").alias("at"), "start", "end")
        met = nodes.drop("edge", "head", "tail", "blank", "duplicate", "truncated", "illegal").withColumn("up", F.floor(F.col("place") / FAN)).join(above, on("conv_id", "of") & (F.col("up") == F.col("at"))).drop("of", "at")
        ways = durable(_groups(met).mapInArrow(_walked, "conv_id long, place long, start long, end long"), "repair-ways")
    at = ways.select(F.col("conv_id").alias("of"), F.col("place").alias("at"), "start", "end")
    open_ = first.filter("edge").join(at, on("conv_id", "of") & (F.col("place") == F.col("at")))
    whole = first.filter("NOT edge").withColumn("end", _best())
    parts = open_.select("conv_id", "place", F.element_at("audit", (F.col("start") * STATES + F.col("end") + 1).cast("int")).alias("audit"))
    return faults, parts.unionByName(whole.select("conv_id", "place", F.element_at("audit", F.col("end") + 1).alias("audit")))


# The repaired conversation


class _Writer:
    """A conversation that is being repaired: a running hash, and the state that the roles so far end in."""

    def __init__(self):
        self.said, self.state, self.count = hashlib.sha256(), 0, 0
        self.edits, self.at = "", 0

    def write(self, role: str, text: str) -> None:
        self.said.update(f"{chr(10) if self.count else ''}{role}:{text}".encode())
        self.state, self.count = STEPS[role[:1]][self.state], self.count + 1

    def add(self, text: str) -> None:
        """A turn of the user or the assistant, whichever may follow."""
        self.write("assistant" if self.state == 2 else "user", text)

    def inserted(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.add("")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self.write(role, text)
        elif edit == "R":
            self.add(text)
        self.inserted()


def _said(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each conversation's repaired turns; a run's audit comes before its turns."""

    def turns() -> Iterator[tuple]:
        for batch in tk.batches(stream, "text"):
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")))

    def each() -> Iterator[dict]:
        for conv, rows in groupby(turns(), key=lambda r: r[0]):
            now = _Writer()
            for _, audit, role, text in rows:
                if audit is None:
                    now.turn(role, text)
                else:
                    now.edits, now.at = audit, 0
                    now.inserted()
            yield {"conv_id": conv, "repaired_sha256": now.said.hexdigest()}

    yield from _batches(each(), pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))


def repaired(ordered: DataFrame, parts: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256: the hash of `role:text` of the repaired turns, joined by line ends."""
    none = F.lit(None).cast("string")
    texts = ordered.select("conv_id", "run", "at", none.alias("audit"), "role", "text")
    audits = parts.select("conv_id", F.col("place").alias("run"), F.lit(-1).cast("long").alias("at"), "audit", none.alias("role"), none.alias("text"))
    both = texts.unionByName(audits).repartition("conv_id").sortWithinPartitions("conv_id", "run", "at")
    return both.mapInArrow(_said, "conv_id long, repaired_sha256 string")


def report(turns: DataFrame) -> DataFrame:
    """Per conversation of `turns` after `damaged`: gaps, faults, the least edits and the hash of what they give."""
    hurt = damaged(turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"))
    ordered, runs = numbered(in_order(hurt.filter("there").drop("there"), "repair-ordered", "conv_id", "turn", "role", "text"))
    there = F.when(F.col("there"), F.col("turn"))
    gaps = hurt.groupBy("conv_id").agg((F.max(there) - F.min(there) + 1 - F.count_distinct(there)).alias("gaps"))
    faults, parts = scan(ordered, runs)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = gaps.unionByName(faults, True).unionByName(repaired(ordered, parts), True)
    out = every.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts], F.max("audit").alias("audit"), F.max("repaired_sha256").alias("hash"))
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("hash", F.lit(nothing)).alias("repaired_sha256"))
