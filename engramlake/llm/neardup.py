"""Near-duplicate classes: BagMinHash signatures, banding, and a check of the multiset overlap.

Two texts are near copies if their multisets of five-word shingles have a weighted Jaccard
similarity of 0.8 or more (a text of one to four words has one shingle, of all its words). The
classes are the connected components of that relation.

1. One pass over the texts gives each document a node (128 bits of hashes of its word sequence), its
   number of shingles and its band hashes.
2. Documents with one word sequence are exact copies and are one node (partial
   sums before the shuffle, so a group of a third of all rows is a few rows per task).
3. Nodes that share a band meet in a bucket. In each of `rounds` rounds a bucket has one hub (at first the node with most copies,
   then one drawn by a hash), and the members that are not in the hub's class yet are compared with it. A bucket of g near copies
   costs g - 1 comparisons. After a round the classes are the components of the links so far, and a bucket whose members are of one
   class is done.
4. In what is left, every two members of a bucket of at most `LARGE` members that are of different classes are compared, unless it is certain that they are
   not near: by their sizes, or by their maps. A node's map has a bit for each hash value (of 16 for a shingle, or so) that one of its shingles
   has. A bit of one node that the other lacks is a shingle that the other lacks, so the maps bound the overlap from above, and no link is
   lost to them. A pair is weighed in the first of the buckets that it shares. Of unlike members, only pairs that may be near
   leave the join. Members of larger buckets meet by their rarest shingles instead (`_rare_pairs`): of two near multisets, the larger one's first n - ceil(t n) + 1 elements, the rarest
   first, and the smaller one's first n - ceil(2 t n / (1 + t)) + 1 share one, whatever the order. So pages that share a template, however many, meet only where the template is
   nearly all that they have, and then they are near. How rare a shingle is, is counted in `SLOTS` hash slots; any order loses nothing.
5. Connected components, by star steps; the class id is the least doc_id in it.

Comparisons are exact: the texts of the pair's nodes are read again, and their shingle multisets
are intersected. With 32 bands of 7 rows, a pair at 0.8 shares a band with probability 0.9995, at
0.85 with 0.99999; every pair that shares one is settled exactly.

Defined results: null texts are a class of their own each; texts without a word are classed with
equal texts; repeated rows are copies; a null doc_id takes part and has the class of its text; an
empty table gives no rows. Other columns are not read by `classes` and pass through `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.llm import bagminhash as bmh
from engramlake.llm import tokens as tk
from engramlake.llm.common import durable, fresh, observed
from engramlake.llm.components import components

SHINGLE, THRESHOLD, BANDS, ROWS, ROUNDS = 5, 0.8, 32, 7, 1

#: Bits of a node's map for each of its shingles (up to the next power of two), and the most that a map has. Fewer bits bound
#: the overlap less tightly, so that more pairs are compared; they lose none.
MAP_BITS, MOST_BITS = 16, 1 << 15

#: Members of a bucket up to which they are compared with one another, which writes nothing but may take their number squared, halved (33 million comparisons of maps); beyond it, a fifth of each
#: member's shingles is written and joined. Both find the same. And slots in which shingles are counted (4 bytes each, sent to the tasks).
LARGE, SLOTS = 8192, 1 << 20

_FEATURES = "doc_id long, text_key long, node binary, n long, bands array<long>"
_SETS = "node binary, n long, bands array<long>, map array<long>, grams binary, counts binary"


def _content(w: tk.Words) -> list[np.ndarray]:
    """Two 64-bit hashes of each text's word sequence."""
    lengths = w.lengths()
    place = (np.arange(len(w.hash)) - np.repeat(w.first[:-1], lengths)).astype(np.uint64)
    out = []
    for salt in (11, 12):
        v = np.append(tk.mix(w.hash ^ tk.mix(place * np.uint64(2) + np.uint64(salt))), np.uint64(0))
        total = np.cumsum(v)
        ends = np.concatenate([[np.uint64(0)], total])
        out.append(tk.mix(ends[w.first[1:]] - ends[w.first[:-1]] + lengths.astype(np.uint64)).view(np.int64))
    return out


def _pack(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary column of runs of an array: run i is values[at[i]:at[i + 1]]."""
    offsets = (at * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def _features(bands: int, rows: int, shingle: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.batches(stream, "text"):
            w = tk.words(batch.column("text"))
            h1, h2 = _content(w)
            gram, owner, count = bmh.multisets(*tk.grams(w.hash, w.first, shingle, short=True))
            n = np.bincount(owner, weights=count, minlength=batch.num_rows).astype(np.int64)
            sig = bmh.signatures(gram, owner, count, batch.num_rows, bands * rows)
            key = batch.column("text_key").to_numpy(zero_copy_only=False)
            both = np.stack([np.where(n > 0, h1, key), np.where(n > 0, h2, 0)], axis=1)
            at = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(bmh.bands(sig, rows)[n > 0].ravel()))
            node = _pack(both.ravel(), np.arange(batch.num_rows + 1) * 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), node, pa.array(n), lists],
                ["doc_id", "text_key", "node", "n", "bands"],
            )

    return run


def features(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, node (hashes of the word sequence), n (shingles), bands; null texts have no row."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return x.filter(F.col("text").isNotNull()).mapInArrow(_features(bands, rows, shingle), _FEATURES)


def _maps(gram: np.ndarray, owner: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bit maps of texts of n shingles, one after the other, and where each begins (in 64-bit words)."""
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(n, 1) * MAP_BITS)).astype(np.int64), 64, MOST_BITS)
    at = np.concatenate([[0], np.cumsum(bits // 64)])
    spot = (gram & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    out = np.zeros(at[-1] * 64, dtype=np.uint8)
    out[at[owner] * 64 + spot] = 1
    return np.packbits(out, bitorder="little").view(np.int64), at


def _shingles(shingle: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.batches(stream, "text"):
            w = tk.words(batch.column("text"))
            gram, owner, count = bmh.multisets(*tk.grams(w.hash, w.first, shingle, short=True))
            at = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            n = np.bincount(owner, weights=count, minlength=batch.num_rows).astype(np.int64)
            bits, begin = _maps(gram, owner, n)
            maps = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(bits))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(n), batch.column("bands"), maps, _pack(gram, at), _pack(count.astype(np.int64), at)],
                ["node", "n", "bands", "map", "grams", "counts"],
            )

    return run


def _compare(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        c = {k: batch.column(k) for k in ("ga", "ca", "gb", "cb")}
        ints = lambda k, i, t: np.frombuffer(c[k][i].as_buffer(), dtype=t)
        sims = [
            bmh.overlap(ints("ga", i, "u8"), ints("ca", i, "i8"), ints("gb", i, "u8"), ints("cb", i, "i8"))
            for i in range(batch.num_rows)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())], ["a", "b", "sim"]
        )


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, sim) for distinct pairs of nodes."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"), F.col("counts").alias("ca"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"), F.col("counts").alias("cb"))
    met = pairs.select("a", "b").distinct().join(right, "b").join(left, "a").select("a", "b", "ga", "ca", "gb", "cb")
    return met.mapInArrow(_compare, "a binary, b binary, sim double")


def _fits(a: str, b: str, threshold: float) -> Column:
    """The sizes of two multisets allow the similarity."""
    return F.least(a, b) >= threshold * F.greatest(a, b)


def _possible(threshold: float) -> Column:
    """The maps of a and b, of sizes that fit, allow the similarity. The longer map is folded to the length of the other."""

    def folded(x: str, y: str) -> Column:
        half = F.greatest(F.lit(1), (F.size(x) / 2).cast("int"))
        halves = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseOR(q))
        return F.when(F.size(x) > F.size(y), halves).otherwise(F.col(x))

    def lacking(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda t, c: t + c)

    a, b = folded("map_a", "map_b"), folded("map_b", "map_a")
    most = F.least(F.col("na") - lacking(a, b), F.col("nb") - lacking(b, a))
    return most * (1 + threshold) >= threshold * (F.col("na") + F.col("nb")) - 1e-6


def _hub_pairs(members: DataFrame, first: bool, draw: int) -> DataFrame:
    """(a, b): the members of each bucket (band, node, copies, root) with its hub, where they are of different classes."""
    order = F.struct((-F.col("copies")).alias("c"), "node", "root") if first else F.struct(F.xxhash64(F.lit(draw), "node").alias("c"), "node", "root")
    hubs = members.groupBy("band").agg(F.min(order).alias("h")).select("band", F.col("h.node").alias("b"), F.col("h.root").alias("rb"))
    return members.join(hubs, "band").filter(F.col("root") != F.col("rb")).select(F.col("node").alias("a"), "b")


def _unsettled(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The members (band, node, copies) of the buckets that hold more than one class, with their class, `root`."""
    root = F.lit(None).cast("binary") if roots is None else F.col("root")
    x = (members if roots is None else members.join(roots, "node", "left")).withColumn("root", F.coalesce(root, "node"))
    busy = x.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
    return x.join(busy, "band")


def _unlike_pairs(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the pairs of a bucket that are of different classes and may be near, each in the first bucket that it shares."""
    cards = members.select("band", "node", "root").join(sets.select("node", "n", "bands", "map"), "node")
    side = lambda x: cards.select("band", F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("root", "bands", "map")], F.col("n").alias(f"n{x}"))
    here = F.col("band") == F.array_min(F.array_intersect("bands_a", "bands_b"))
    met = (F.col("a") > F.col("b")) & (F.col("root_a") != F.col("root_b")) & _fits("na", "nb", threshold)
    return side("a").join(side("b"), "band").filter(met & here & _possible(threshold)).select("a", "b")


def _elements(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The elements of a batch's multisets (a shingle's second, third ... occurrence is an element of its own), the row of each, and each row's number of elements."""
    flat = lambda c, t: [np.frombuffer(x.as_buffer(), dtype=t) for x in batch.column(c)]
    grams, counts = flat("grams", "u8"), flat("counts", "i8")
    gram, count = np.concatenate([np.zeros(0, np.uint64), *grams]), np.concatenate([np.zeros(0, np.int64), *counts])
    owner = np.repeat(np.arange(batch.num_rows), [len(g) for g in grams])
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    element = np.repeat(gram, count)
    more = nth > 0
    element[more] = tk.mix(element[more] ^ tk.mix(nth[more].astype(np.uint64)))
    of = np.repeat(owner, count)
    return element, of, np.bincount(of, minlength=batch.num_rows).astype(np.int64)


def _slot_counts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, np.int64)
    for batch in tk.batches(stream, "grams"):
        total += np.bincount((_elements(batch)[0] % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "many"])


def _prefixes(many: np.ndarray, threshold: float):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.batches(stream, "grams"):
            element, of, n = _elements(batch)
            order = np.lexsort((element, many[(element % np.uint64(SLOTS)).astype(np.int64)], of))
            element, of = element[order], of[order]
            at = np.arange(len(of)) - (np.cumsum(n) - n)[of]
            # the small term keeps a product that is whole from being rounded up
            length = lambda share: (n - np.ceil(share * n - 1e-9).astype(np.int64) + 1)[of]
            kept = at < length(threshold)
            short = (at < length(2 * threshold / (1 + threshold)))[kept]
            rows = pa.array(of[kept])
            columns = [batch.column(c).take(rows) for c in ("node", "root", "n")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(element[kept].view(np.int64)), pa.array(at[kept]), pa.array(short)], ["node", "root", "n", "element", "at", "short"])

    return run


def _rare_pairs(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the nodes of different classes that share an element of their prefixes, and whose sizes and places of it allow the similarity."""
    own = members.select("node", "root").distinct()
    mine = durable(sets.select("node", "n", "grams", "counts").join(own, "node"), "nd-crowded")
    counted = mine.select("grams", "counts").mapInArrow(_slot_counts, "slot long, many long").groupBy("slot").agg(F.sum("many").alias("many"))
    found = counted.toArrow()  # one row for each of SLOTS at most
    many = np.zeros(SLOTS, np.int32)
    many[found.column("slot").to_numpy()] = np.minimum(found.column("many").to_numpy(), np.iinfo(np.int32).max)
    heads = mine.mapInArrow(_prefixes(many, threshold), "node binary, root binary, n long, element long, at long, short boolean")
    # elements of one class make no pairs
    busy = heads.groupBy("element").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("short").alias("any")).filter("lo <> hi AND any").select("element")
    heads = durable(heads.join(busy, "element"), "nd-heads-of-sets")
    classes_ = heads.select("element", "root").distinct()
    unlike = classes_.select("element", F.col("root").alias("ra")).join(classes_.select("element", F.col("root").alias("rb")), "element").filter("ra <> rb")
    side = lambda x, s: x.select("element", F.col("root").alias(f"r{s}"), F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("at").alias(f"at{s}"))
    met = unlike.join(side(heads, "a"), ["element", "ra"]).join(side(heads.filter("short"), "b"), ["element", "rb"])
    most = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb"))
    fits = (F.col("nb") <= F.col("na")) & _fits("na", "nb", threshold) & (most * (1 + threshold) >= threshold * (F.col("na") + F.col("nb")) - 1e-6)
    return met.filter(fits).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _joined(links: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(node, root) after more links, given that before them (None: there were none); only classes, not their nodes, are linked anew."""
    if roots is None:
        return durable(components(links), "nd-classes")
    for x in "ab":
        of = roots.select(F.col("node").alias(x), F.col("root").alias("of"))
        links = links.join(of, x, "left").withColumn(x, F.coalesce("of", x)).drop("of")
    merged = durable(components(links), "nd-merged").select(F.col("node").alias("root"), F.col("root").alias("to"))
    old = roots.join(merged, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    new = merged.join(roots, F.col("node") == merged["root"], "left_anti").select(F.col("root").alias("node"), F.col("to").alias("root"))
    return durable(old.unionByName(new), "nd-classes")


def _left_pairs(here: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): what is to be compared of the members of buckets that the hubs have left."""
    crowds, (n,) = observed(here.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > LARGE).select("band"), "nd-crowds", F.count(F.lit(1)))
    if not n:
        return _unlike_pairs(here, sets, threshold)
    small, crowded = here.join(crowds, "band", "left_anti"), here.join(crowds, "band", "left_semi")
    return _unlike_pairs(small, sets, threshold).unionByName(_rare_pairs(crowded, sets, threshold))


def roots(nodes: DataFrame, sets_of, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame | None:
    """(node, root) of the nodes (node, copies, bands) that are near another one: components of all near pairs. None: there are none."""
    each = nodes.select("node", "copies", F.explode("bands").alias("band"))
    busy = each.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("band")
    members, (n,) = observed(each.join(busy, "band"), "nd-members", F.count(F.lit(1)))
    found = None
    if not n:
        return found
    sets = durable(sets_of(members.select("node").distinct()), "nd-sets")
    for k in range(rounds + 1):
        here, (n,) = observed(_unsettled(members, found), "nd-buckets", F.count(F.lit(1)))
        if not n:
            break
        pairs = _hub_pairs(here, k == 0, k) if k < rounds else _left_pairs(here, sets, threshold)
        near = similarities(pairs, sets).filter(F.col("sim") >= threshold).select("a", "b")
        near, (n,) = observed(near, "nd-links", F.count(F.lit(1)))
        found = _joined(near, found) if n else found
    return found


def classes(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    shingle: int = SHINGLE,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per document: doc_id, text_key (hash of the text), class_id (least doc_id of its class), class_key
    (the text hash of that document) and class_size (documents in the class)."""
    f = durable(features(docs, bands, rows, shingle), "nd-features")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    nodes = f.groupBy("node").agg(first, F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    nodes = durable(nodes, "nd-nodes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        at = nodes.join(wanted, "node", "left_semi").select("node", "bands", F.col("first.doc_id").alias("of"), "first.text_key")
        x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
        met = x.join(at, (x.doc_id.eqNullSafe(at.of)) & (x.text_key == at.text_key)).select("node", "bands", "text")
        return met.mapInArrow(_shingles(shingle), _SETS).dropDuplicates(["node"])

    near = roots(nodes.filter(F.size("bands") > 0), sets_of, threshold, rounds)
    lone = nodes.select("node", "first", "copies")
    lone = lone.withColumn("root", F.col("node")) if near is None else lone.join(near, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lone = durable(lone, "nd-rooted")
    # settled apart from the join by root, which can then split a large class
    heads = durable(lone.groupBy("root").agg(F.min("first").alias("head"), F.sum("copies").alias("class_size")), "nd-class-heads")
    of = lone.join(heads, "root").select("node", "head", "class_size")
    named = f.select("doc_id", "text_key", "node").join(of, "node")
    out = named.select(
        "doc_id", "text_key", F.col("head.doc_id").alias("class_id"), F.col("head.text_key").alias("class_key"), "class_size"
    )
    none = docs.filter(F.col("text").isNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"),
        F.col("doc_id").cast("long").alias("class_id"), F.xxhash64("text").alias("class_key"), F.lit(1).cast("long").alias("class_size"),
    )
    return out.unionByName(none)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents with one of each class kept, the one with the least doc_id, in the columns they came with.

    Rows that repeat an id and a text are one document. Documents with a null text stay.
    """
    key, of, head = fresh(docs, "near_key", "near_of", "near_head")
    heads = classes(docs, **options).filter(
        F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("class_key"))
    )
    heads = durable(heads.select(F.col("doc_id").alias(of), F.col("text_key").alias(head)).distinct(), "nd-heads")
    x = docs.withColumn(key, F.xxhash64("text"))
    met = x.join(heads, F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.col(key) == F.col(head)))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    once = met.filter(F.col("text").isNotNull()).dropDuplicates(["doc_id", key]).select(*cols)
    return once.unionByName(docs.filter(F.col("text").isNull()))
