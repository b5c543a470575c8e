"""Mixing sources to target weights.

1. Size: the words of every document. The documents of a source are dealt to chunks of about `chunk_docs` by a hash;
   the words of a chunk form one stream, in the order of doc_id. Equal rows in a pile of more than that are numbered (`unpiled`), and the hash takes the number in.
2. Targets: the sources, in code-point order with null last, take the weights in turn and share
   `share` of all words; a target stops at `cap` times its source's size, and the excess is
   shared again by weight until none is above (the level of that filling is found in closed form).
3. Blocks: each stream is packed into blocks of `block_words` words; its last may be shorter. The blocks of a source are numbered
   through, chunk by chunk.
4. Draws: the slots of the output are dealt to shards of `shard_slots`; every slot draws its
   source, so a shard's counts are multinomial. The counts are then conditioned on the totals:
   slots that a source drew beyond its target go, in order, to those that drew too few.
5. Index: slot j of a source maps to block perm(j mod blocks) of pass j div blocks, where perm is
   a pseudorandom permutation keyed by source and pass (swap-or-not rounds).
6. Join: slots meet blocks by (source, chunk, number in the chunk). That is the mixed corpus (`mixed`): one row
   per slot, with the words of its block and the spans of the documents that they come from.

`mix` writes that corpus to the shared folder and sums its spans: one row per document: doc_id, size, source_size, target, taken. A source's taken
words are within a block's length of its target, or so; a block is taken at most `cap` times
(rounded up), so no document is taken more often than that. Everything is drawn from hashes of
the seed, so reruns agree.

Only DataFrame functions are used. A source with a third of all rows never meets in one task: its documents lie in chunks, its draws
are sums for each shard, and running sums over chunks or shards are taken in two levels. Slots are made shard by shard. One row per
source passes through a single-partition window, which the targets need; documents, blocks and slots never do. The texts are
shuffled once: documents and slots are dealt to the tasks by chunk, and in its task a chunk is cut into blocks, which go to their
slots by one grouping there.

Defined results: a null or empty text has size 0 and takes 0; a null source is a source; repeated
rows are documents of their own; ties in doc_id are ordered by size and a hash of the text; null ids are
dealt by that hash; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engramlake.llm.common import durable, fresh, let, observed, words_of

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
BLOCK_WORDS, SHARD_SLOTS, CHUNK_DOCS, SEED, ROUNDS, BINS = 64, 4096, 128, 20240201, 10, 1024
#: Rows of one window of a running sum, slots that a task makes, and blocks of a stretch by which a block's chunk is looked up.
RUN, TASK_SLOTS, STRETCH = 4096, 1 << 18, 1024
#: Sources up to which their ranges of slots, and piles of equal rows up to which their keys (a few numbers each) are broadcast; beyond, they are a shuffled join.
MOST_SOURCES = 100_000


def sized(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, source, size (words), a salt that orders equal ids, and the columns named."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source"),
        F.size(words_of(text)).cast("long").alias("size"),
        F.xxhash64(text).alias("salt"),
        *also,
    )


def targets(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: sid (its rank), source, source_size, docs, target."""
    every = W.orderBy(F.lit(0))  # over one row per source
    s = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    s = s.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.array(*map(F.lit, weights))[F.pmod(F.col("sid") - 1, F.lit(len(weights)))])
    s = s.withColumn("most", F.lit(cap) * F.col("source_size").cast("double"))
    whole = every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("goal", F.lit(share) * F.sum("source_size").over(whole))
    # fill in the order in which sources reach their caps: the capped ones are a prefix
    by_cap = W.orderBy(F.col("most") / F.col("weight"), "sid")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("left", F.col("goal") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing)))
    full = F.col("left") * F.col("weight") >= F.col("most") * F.col("rest")
    s = s.withColumn("full", full).withColumn("place", F.row_number().over(by_cap))
    first = F.min(F.when(~F.col("full"), F.struct("place", (F.col("left") / F.col("rest")).alias("level")))).over(whole)
    s = s.withColumn("level", first["level"])
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * F.col("level"))
    return s.select(F.col("sid").cast("int").alias("sid"), "source", "source_size", "docs", target.alias("target"))


def running(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """The frame with a column `name`: the sum of `value` over the rows of the keys that are before the row in `order`, a whole number.

    Stretches of `RUN` numbers of the order are summed first, so no window holds more rows than that, or one for each stretch.
    """
    part, base = fresh(df, "stretch", "stretch_base")
    df = df.withColumn(part, F.floor(F.col(order) / RUN))
    before = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    sums = df.groupBy(*keys, part).agg(F.sum(value).alias(base)).withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    within = W.partitionBy(*keys, part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0))).join(sums, [*keys, part])
    return df.withColumn(name, F.col(name) + F.col(base)).drop(part, base)


def piles(docs: DataFrame, chunk_docs: int = CHUNK_DOCS) -> tuple[DataFrame, int]:
    """Groups of equal rows (of, id, mark, many: source, doc_id, salt and their number) of more than a chunk's documents, and how many groups there are: at most one for that many documents."""
    same = docs.filter(F.col("size") > 0).groupBy(F.col("source").alias("of"), F.col("doc_id").alias("id"), F.col("salt").alias("mark"))
    out, (n,) = observed(same.agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > chunk_docs), "mix-piles", F.count(F.lit(1)))
    return out, n


def unpiled(docs: DataFrame, heaps: DataFrame | None, few: bool = True) -> DataFrame:
    """Documents with `copy`, the number of a row in its pile (0 where there is none), so that a hash that takes it in tells the rows of a pile apart.

    Equal rows are alike, so a pile is numbered by making it anew: one of its rows, as often as it was there, in stretches that are dealt to the tasks. A few piles are broadcast.
    """
    if heaps is None:
        return docs.withColumn("copy", F.lit(0).cast("long"))
    names = docs.columns
    met = docs.join(F.broadcast(heaps) if few else heaps, F.col("source").eqNullSafe(F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("salt") == F.col("mark")), "left")
    light = met.filter("many IS NULL").select(*names, F.lit(0).cast("long").alias("copy"))
    one = met.filter("many IS NOT NULL").groupBy("source", "doc_id", "salt").agg(F.first("many").alias("many"), *[F.first(c).alias(c) for c in names if c not in ("source", "doc_id", "salt")])
    lot = one.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("many") - 1) / RUN)))).repartition("source", "doc_id", "salt", "lot")
    last = F.least(F.col("many"), (F.col("lot") + 1) * RUN) - 1
    return light.unionByName(lot.withColumn("copy", F.explode(F.sequence(F.col("lot") * RUN, last))).select(*names, "copy"))


def chunked(docs: DataFrame, sources: DataFrame, chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """The documents with words, with sid and chunk instead of their source; `copy` tells equal rows apart."""
    chunks = F.greatest(F.lit(1), F.ceil(F.col("docs") / chunk_docs)).alias("chunks")
    dim = sources.select("sid", F.col("source").alias("of"), chunks)
    d = docs.filter(F.col("size") > 0).join(dim, F.col("source").eqNullSafe(F.col("of"))).drop("of", "source")
    return d.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "salt", "copy"), F.col("chunks"))).drop("chunks", "copy")


def directory(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per chunk: sid, chunk, blocks and `base`, the number of its first block in the source."""
    per = placed.groupBy("sid", "chunk").agg(F.ceil(F.sum("size") / block_words).alias("blocks"))
    return running(per, ["sid"], "chunk", "blocks", "base")


def slot_counts(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per source with words: blocks, slots (its target in blocks), `upto`, the slots of the sources before it and its own, and all slots."""
    blocks = chunks.groupBy("sid").agg(F.sum("blocks").alias("blocks"))
    s = sources.join(blocks, "sid")
    s = s.withColumn("slots", F.round(F.col("target") / F.col("source_size") * F.col("blocks")).cast("long"))
    upto = F.sum("slots").over(W.orderBy("sid"))
    return s.select("sid", "blocks", "slots", upto.alias("upto"), F.sum("slots").over(W.partitionBy()).alias("all"))


def draws(counts: DataFrame, total: int, few: bool = True, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """One row per shard and source: how many of the shard's slots drew the source (a multinomial draw). `total`: all slots; `few`: so few
    sources that their ranges (one row each, and one for each of `BINS`) are broadcast."""
    width = max(1, -(-total // BINS))
    edge = counts.withColumn("from", F.col("upto") - F.col("slots")).filter(F.col("slots") > 0)
    bins = edge.withColumn(
        "bin", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor((F.col("upto") - 1) / width)))
    ).select("sid", "from", "upto", "bin")
    shards = -(-total // shard_slots)
    each = counts.sparkSession.range(0, shards, 1, max(1, -(-total // TASK_SLOTS))).withColumnRenamed("id", "shard")
    size = F.least(F.lit(shard_slots), F.lit(total) - F.col("shard") * shard_slots)
    slots = each.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), size)))
    slots = slots.withColumn("v", F.pmod(F.xxhash64(F.lit(seed), "shard", "k"), F.lit(total)))
    slots = slots.select("shard", "v", F.floor(F.col("v") / width).alias("bin"))
    hit = slots.join(F.broadcast(bins) if few else bins, "bin")
    hit = hit.filter((F.col("v") >= F.col("from")) & (F.col("v") < F.col("upto")))
    return hit.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n"))


def slots(counts: DataFrame, drawn: DataFrame, total: int) -> DataFrame:
    """One row per output slot: shard, sid and j, the slot's number within its source, from 0 to slots - 1."""
    d = running(drawn, ["sid"], "shard", "n", "base").join(counts.select("sid", "slots"), "sid")
    d = d.repartition(max(1, -(-total // TASK_SLOTS)), "shard")  # each task makes the slots of its own shards
    upto = F.col("base") + F.col("n")

    def each(lo: Column, hi: Column) -> DataFrame:
        j = F.explode(F.sequence(lo, hi - 1)).alias("j")
        return d.filter(lo < hi).select("shard", "sid", "slots", j)

    within = each(F.col("base"), F.least(upto, "slots")).drop("slots")
    # of a source's surplus and of another's want, only the counts pass through a window
    sums = drawn.groupBy("sid").agg(F.sum("n").alias("n"))
    gap = counts.select("sid", "slots").join(sums, "sid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    gap = gap.withColumn("over", F.greatest(F.col("n") - F.col("slots"), F.lit(0)))
    gap = gap.withColumn("want", F.greatest(F.col("slots") - F.col("n"), F.lit(0)))
    before = W.orderBy("sid").rowsBetween(W.unboundedPreceding, -1)
    gap = gap.withColumn("over_at", F.coalesce(F.sum("over").over(before), F.lit(0)))
    gap = gap.withColumn("want_at", F.coalesce(F.sum("want").over(before), F.lit(0)))
    spare = each(F.greatest("base", "slots"), upto).join(gap.select("sid", "over_at"), "sid")
    spare = spare.select("shard", (F.col("over_at") + F.col("j") - F.col("slots")).alias("o"))
    want = gap.filter(F.col("want") > 0).select(
        "sid", "n", "want_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("want") - 1)).alias("i")
    )
    want = want.select("sid", (F.col("n") + F.col("i")).alias("j"), (F.col("want_at") + F.col("i")).alias("o"))
    return within.unionByName(spare.join(want, "o").select("shard", "sid", "j"))


def permutation_points(counts: DataFrame, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """One row per source and pass over its blocks: the key points of the pass's permutation."""
    turns = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / F.col("blocks")))).alias("turn")
    x = counts.filter(F.col("slots") > 0).select("sid", "blocks", turns)
    points = F.transform(
        F.sequence(F.lit(1), F.lit(rounds)),
        lambda r: F.pmod(F.xxhash64(F.lit(seed), r, F.col("sid"), F.col("turn")), F.col("blocks")),
    )
    return x.select("sid", "turn", "blocks", points.alias("points"))


def permuted(index: Column, n: Column, points: Column) -> Column:
    """The image of an index (0 to n - 1) under the permutation that the points define.

    Swap-or-not rounds: in each, an index is paired with its mirror image in the round's point,
    and one bit drawn for the pair says whether the two change places.
    """

    def step(x: Column, at: Column) -> Column:
        other = F.pmod(at - x, n)
        bit = F.xxhash64(at, F.greatest(x, other)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(points, index, step)


def slot_blocks(counts: DataFrame, dealt: DataFrame, seed: int = SEED) -> DataFrame:
    """The block of each slot: shard, slot (its place in the shard, from 0), sid, block."""
    place = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "sid", "j"), "sid", "j")
    x = dealt.withColumn("slot", (F.row_number().over(place) - 1).cast("long")).join(counts.select("sid", "blocks"), "sid").select(
        "shard", "slot", "sid", F.floor(F.col("j") / F.col("blocks")).alias("turn"), F.pmod(F.col("j"), F.col("blocks")).alias("k")
    )
    x = x.join(permutation_points(counts), ["sid", "turn"])
    return x.select("shard", "slot", "sid", permuted(F.col("k"), F.col("blocks"), F.col("points")).alias("block"))


def in_chunks(taken: DataFrame, chunks: DataFrame) -> DataFrame:
    """The slots (shard, slot, sid, block) with the chunk of their block, and its number there, `k`."""
    last = F.floor((F.col("base") + F.col("blocks") - 1) / STRETCH)
    at = F.explode(F.sequence(F.floor(F.col("base") / STRETCH), last)).alias("stretch")
    at = chunks.select("sid", "chunk", "base", "blocks", at)
    met = taken.withColumn("stretch", F.floor(F.col("block") / STRETCH)).join(at, ["sid", "stretch"])
    met = met.filter((F.col("block") >= F.col("base")) & (F.col("block") < F.col("base") + F.col("blocks")))
    return met.select("shard", "slot", "sid", "block", "chunk", (F.col("block") - F.col("base")).alias("k"))


def _spans(block_words: int) -> Column:
    """The parts of a document in the blocks of its chunk: k, and the span: `at`, the offset of its first word in the stream,
    doc_id, `start` (the offset of the document), words, text."""
    b, none = F.lit(block_words), F.lit(None).cast("struct<shard:bigint,slot:bigint,block:bigint>")

    def span(k: Column, words: Column) -> Column:
        lo = F.greatest(F.col("start"), k * b)
        n = F.least(F.col("start") + F.col("size"), (k + 1) * b) - lo
        text = F.array_join(F.slice(words, (lo - F.col("start") + 1).cast("int"), n.cast("int")), " ")
        part = F.struct(lo.alias("at"), F.col("doc_id"), F.col("start"), n.alias("words"), text.alias("text"))
        return F.struct(k.alias("k"), part.alias("span"), none.alias("place"))

    blocks = F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))
    return let(words_of(F.col("text")), lambda words: F.transform(blocks, lambda k: span(k, words)))


def assembled(placed: DataFrame, taken: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Slots joined with their blocks: shard, slot, sid, chunk, block, text, spans. `placed`: documents with text, in chunks; `taken`:
    slots, in chunks.

    Both are dealt by chunk in one shuffle; blocks and slots then meet in a grouping by block that needs no other.
    """
    none = F.lit(None)
    d = placed.select("sid", "chunk", "doc_id", "size", "salt", "text", *[none.cast("long").alias(c) for c in ("k", "shard", "slot", "block")])
    t = taken.select("sid", "chunk", *[none.cast(kind).alias(c) for c, kind in (("doc_id", "long"), ("size", "long"), ("salt", "long"), ("text", "string"))], "k", "shard", "slot", "block")
    w = W.partitionBy("sid", "chunk").orderBy(F.col("k").isNotNull(), "doc_id", "size", "salt").rowsBetween(W.unboundedPreceding, -1)
    each = d.unionByName(t).withColumn("start", F.coalesce(F.sum("size").over(w), F.lit(0)))
    spans = _spans(block_words)
    place = F.array(F.struct("k", F.lit(None).cast("struct<at:bigint,doc_id:bigint,start:bigint,words:bigint,text:string>").alias("span"), F.struct("shard", "slot", "block").alias("place")))
    each = each.select("sid", "chunk", F.explode(F.when(F.col("k").isNull(), spans).otherwise(place)).alias("x"))
    each = each.select("sid", "chunk", "x.k", "x.span", "x.place").groupBy("sid", "chunk", "k")
    met = each.agg(F.sort_array(F.collect_list("span")).alias("spans"), F.collect_list("place").alias("places"))
    text = F.array_join(F.col("spans.text"), " ").alias("text")
    spans = F.transform("spans", lambda x: x.dropFields("text")).alias("spans")
    return met.select("sid", "chunk", text, spans, F.explode("places").alias("x")).select("x.*", "sid", "chunk", "text", "spans")


def _mixed(docs: DataFrame, weights, share: float, cap: float, block_words: int, shard_slots: int):
    """The sizes, the sources, the documents with words in their chunks, and the mixed corpus."""
    base = durable(sized(docs), "mix-sizes")
    sources = durable(targets(base, weights, share, cap), "mix-sources")
    heaps, n = piles(base)
    heaps = heaps if n else None
    alone = lambda x: unpiled(x, heaps, n <= MOST_SOURCES)
    placed = chunked(alone(base), sources)
    chunks = durable(directory(placed, block_words), "mix-chunks")
    counts = durable(slot_counts(sources, chunks), "mix-counts")
    total, many = counts.agg(F.max("all"), F.count(F.lit(1))).first()
    total = total or 0
    drawn = durable(draws(counts, total, many <= MOST_SOURCES, shard_slots), "mix-draws")
    taken = durable(in_chunks(slot_blocks(counts, slots(counts, drawn, total)), chunks), "mix-slots")
    out = assembled(chunked(alone(sized(docs, "text")), sources), taken, block_words).join(sources.select("sid", "source"), "sid")
    return base, sources, placed, out.select("shard", "slot", "sid", "source", "chunk", "block", "text", "spans")


def mixed(
    docs: DataFrame,
    weights=WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
) -> DataFrame:
    """The mixed corpus, one row per slot: shard, slot, sid, source, chunk, block, text (its words) and spans (of documents).

    Rows come by chunk; who writes shards sorts them by (shard, slot).
    """
    return _mixed(docs, weights, share, cap, block_words, shard_slots)[3]


def training_text(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus as a trainer reads it: shard, slot, source, block, doc_ids (of the documents in it), n_words, text."""
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["words"])
    ids = F.array_distinct(F.transform("spans", lambda x: x["doc_id"]))
    return mixed(docs, **options).select("shard", "slot", "source", "block", ids.alias("doc_ids"), n.alias("n_words"), "text")


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken: its words in the mixed corpus."""
    base, sources, placed, corpus = _mixed(docs, weights, share, cap, block_words, shard_slots)
    corpus = durable(corpus, "mix-corpus", "zstd")
    spans = corpus.select("sid", "chunk", F.explode("spans").alias("x"))
    taken = spans.groupBy("sid", "chunk", "x.start").agg(F.sum("x.words").alias("taken"))
    w = W.partitionBy("sid", "chunk").orderBy("doc_id", "size", "salt").rowsBetween(W.unboundedPreceding, -1)
    some = placed.withColumn("start", F.coalesce(F.sum("size").over(w), F.lit(0)))
    some = some.join(taken, ["sid", "chunk", "start"], "left").select("sid", "doc_id", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    none = base.filter(F.col("size") == 0).join(sources.select("sid", F.col("source").alias("of")), F.col("source").eqNullSafe(F.col("of")))
    none = none.select("sid", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none).join(sources.select("sid", "source_size", "target"), "sid").select(
        "doc_id", "size", "source_size", "target", "taken"
    )
