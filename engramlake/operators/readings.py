"""Names in CJK characters read through a table of readings: the longest entry at each place, from left to right.

The table is a frame (text, reading): one or more characters, and their syllables with blanks between them. Every start of a name meets the table once, as an equi join on the
pieces that begin there, so the table may be of any size; the walk over a name's places is a fold inside its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions import messages as M

#: Characters that need a reading.
CJK = "[一-鿿]"


def bare(name: Column) -> Column:
    """A name without what stands in brackets."""
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return trim(F.regexp_replace(trim(name), r"[（(][^）)]*[）)]", ""))


def syllables(texts: DataFrame, readings: DataFrame, longest: int = 4) -> DataFrame:
    """(text, syllables) of distinct texts; a character that is none of CJK is a syllable of its own in lower case, blanks are left out, and a text with a CJK character that no entry covers has null.

    longest: characters of the longest entry that is looked up. Of entries with one text the first reading in order counts. The entries that fit a text are gathered in its
    row: at most `longest` for each of its characters.
    """
    names = texts.select("text").filter("text IS NOT NULL").distinct()
    table = readings.filter(F.length("text") > 0).groupBy(F.col("text").alias("piece")).agg(F.min("reading").alias("reading"))
    at = names.select("text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("at")).filter("length(text) > 0")
    pieces = at.select("text", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("text") - F.col("at") + 1))).alias("n"))
    pieces = pieces.withColumn("piece", F.substr("text", F.col("at"), F.col("n"))).filter(F.col("piece").rlike(CJK))
    best = pieces.join(table, "piece").groupBy("text", "at").agg(F.max_by(F.struct("n", "reading"), "n").alias("best"))
    found = best.groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("at", "best"))).alias("found"))
    x = names.join(found, "text", "left")

    def step(state: Column, i: Column) -> Column:
        char = F.substr(F.col("text"), i, F.lit(1))
        hit = F.col("found")[i]
        other = F.when(F.trim(char) == "", state["said"]).otherwise(F.concat(state["said"], F.array(F.lower(char))))
        none = F.lit(None).cast("array<string>")
        said = F.when(hit.isNotNull(), F.concat(state["said"], F.split(F.trim(hit["reading"]), r"\s+"))).when(char.rlike(CJK), none).otherwise(other)
        moved = F.struct((i + F.coalesce(hit["n"], F.lit(1))).alias("next"), said.alias("said"))
        return F.when(i < state["next"], state).otherwise(moved)

    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("said"))
    return x.select("text", F.aggregate(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1))), start, step, lambda s: s["said"]).alias("syllables"))


def person_slugs(names: DataFrame, readings: DataFrame | None = None) -> DataFrame:
    """(name, slug) of distinct names: as `messages.person_slug`, and of names with CJK characters family-given, where the first syllable is the family name and the
    others are joined. A name that neither way covers has null."""
    each = names.select("name").filter("name IS NOT NULL").distinct().withColumn("slug", M.person_slug(F.col("name")))
    if readings is None:
        return each
    # a lambda variable keeps the name from being stripped for each use
    each = each.withColumn("text", F.transform(F.array(bare(F.col("name"))), lambda x: F.when(x.rlike(CJK), x))[0])
    said = F.transform("syllables", F.lower)
    slug = F.when(F.size(said) > 1, F.concat(F.lit("person/"), said[0], F.lit("-"), F.array_join(F.slice(said, F.lit(2), F.size(said)), ""))).when(F.size(said) == 1, F.concat(F.lit("person/"), said[0]))
    read = syllables(each.select("text"), readings).select("text", slug.alias("_read"))
    return each.join(read, "text", "left").select("name", F.coalesce("slug", "_read").alias("slug"))
