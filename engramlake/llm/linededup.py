"""Line dedup by site-relative frequency.

The pages of a host are grouped; a line that stands on more than `ratio` of them, and on at
least `min_pages` (two: a line that is not repeated is no duplicate), is boilerplate of that host and is dropped from its pages, whatever
share of a page that is. Lines are compared without the white space at their ends; a page counts once however
often it has the line; lines without a word are never boilerplate and stay.

Pages of a host that have the same text count as one page, among its pages and for its lines: copies
of a page do not make its own lines boilerplate, and are left whole for document dedup.

How it runs: the line hashes of a page (8 bytes each) meet those of its copies by a hash of its text,
and one of them stays; then (host, line hash) pairs are counted with map-side partial sums, so a hot
host, a page copied very often or a line on a third of all pages costs one small row per task. What survives is one array of hashes
per host, with at most (average lines per page) / ratio entries; it is joined to the pages by
host, as a broadcast if it has at most `MOST_LINES` hashes and else as a sort-merge join whose skewed host
adaptive execution splits. The lines of a page are never shuffled apart from their page.

Defined results: a null text stays null and counts as a page without lines; an empty text stays
empty, and so does a page of boilerplate only; null hosts are one host; an empty table gives an
empty table. Other columns are passed through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.llm.common import SPACES, durable, fresh, let

RATIO, MIN_PAGES = 0.02, 2
#: Boilerplate lines of all hosts up to which their hashes (8 bytes each) are broadcast; beyond, they are a shuffled join.
MOST_LINES = 500_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(SPACES)))


def boilerplate(
    pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """One row per host that has boilerplate: `host` and `lines`, the hashes of its boilerplate lines."""
    lines = F.array_distinct(F.transform(_lines(text), lambda x: F.btrim(x, F.lit(SPACES))))
    hashes = F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.xxhash64(x))
    base = pages.select(host.alias("host"), F.xxhash64(text).alias("page"), hashes.alias("lines"))
    base = base.dropDuplicates(["host", "page"])
    each = base.select("host", F.explode("lines").alias("line"))
    counts = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    pairs = pages.select(host.alias("of"), F.xxhash64(text).alias("page")).distinct()
    totals = pairs.groupBy("of").agg(F.count(F.lit(1)).alias("total"))
    over = counts.filter(F.col("n") >= min_pages).join(totals, F.col("host").eqNullSafe(F.col("of")))
    return over.filter(F.col("n") > ratio * F.col("total")).groupBy("host").agg(F.collect_list("line").alias("lines"))


def _judge(text: Column, known: Column) -> Column:
    """Struct: the text that stays, its count of lines, dropped lines and dropped characters."""

    def of_lines(lines: Column) -> Column:
        found = F.array_intersect(F.coalesce(known, F.array().cast("array<bigint>")), F.transform(lines, _key))
        return let(found, lambda f: split_up(lines, f))

    def split_up(lines: Column, f: Column) -> Column:
        return let(F.filter(lines, lambda x: F.array_contains(f, _key(x))), lambda gone: verdict(lines, f, gone))

    def verdict(lines: Column, f: Column, gone: Column) -> Column:
        stays = F.array_join(F.filter(lines, lambda x: ~F.array_contains(f, _key(x))), "\n")
        return F.struct(
            F.when(F.size(f) > 0, stays).otherwise(text).alias("text"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(gone).cast("long").alias("n_dropped"),
            chars(gone).cast("long").alias("dropped_chars"),
        )

    chars = lambda a: F.length(F.array_join(a, ""))
    none = F.struct(
        text.alias("text"),
        *[F.lit(0).cast("long").alias(c) for c in ("n_lines", "n_dropped", "dropped_chars")],
    )
    return F.when(text.isNull(), none).otherwise(let(_lines(text), of_lines))


def dedup_lines(
    pages: DataFrame,
    host: Column,
    text_col: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    report: str = "line_report",
) -> DataFrame:
    """The pages with a struct column `report`: text, n_lines, n_dropped, dropped_chars."""
    at, of, lines = fresh(pages, "page_host", "boilerplate_host", "boilerplate_lines")
    known = durable(boilerplate(pages, host, F.col(text_col), ratio, min_pages), "host-lines").select(
        F.col("host").alias(of), F.col("lines").alias(lines)
    )
    if (known.agg(F.sum(F.size(lines))).first()[0] or 0) <= MOST_LINES:
        known = F.broadcast(known)
    joined = pages.withColumn(at, host).join(known, F.col(at).eqNullSafe(F.col(of)), "left")
    judged = joined.withColumn(report, _judge(F.col(text_col), F.col(lines)))
    return judged.drop(at, of, lines)


def clean_documents(docs: DataFrame, host_col: str = "source", **options) -> DataFrame:
    """The documents with their boilerplate lines dropped, in the columns they came with (n_chars follows the text)."""
    (report,) = fresh(docs, "line_report")
    out = dedup_lines(docs, F.col(host_col), report=report, **options)
    new = {"text": F.col(f"{report}.text"), "n_chars": F.length(F.col(f"{report}.text")).cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
