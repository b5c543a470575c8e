"""Hybrid search: a lexical and a vector leg over the chunks of the pages that a filter allows, fused and weighted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions import text as T
from engramlake.operators import filters
from engramlake.operators import graph as G
from engramlake.operators import retrieval as R
from engramlake.operators.filters import MemoryFilter
from engramlake.operators.steps import settled

#: Words that a query is better without.
STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "to", "of", "for", "in", "on", "at", "and", "or", "what", "which", "that",
    "this", "with", "do", "does",
)
#: Weights of a page's tier, of its own text, of its backlinks.
TIER_WEIGHTS = {"warm": 0.8, "cold": 0.6}
OWN_TEXT, BACKLINK = 2.0, 0.05


def rewritten(query: Column, synonyms: Mapping[str, Sequence[str]] | None = None, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Queries without stopwords (unless nothing else is in them), each word followed by its synonyms, each word once in any case."""
    words = F.filter(F.split(F.trim(F.regexp_replace(query, r"\s+", " ")), " "), lambda w: w != "")
    stops = F.array(*map(F.lit, stopwords)) if stopwords else F.array().cast("array<string>")

    def base(all_words: Column) -> Column:
        kept = F.filter(all_words, lambda w: ~F.array_contains(stops, F.lower(w)))
        return F.when(F.size(kept) > 0, kept).otherwise(all_words)

    def grown(words: Column) -> Column:
        if not synonyms:
            return words
        more = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k.lower()), F.array(*map(F.lit, v)))])
        none = F.array().cast("array<string>")
        return F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.coalesce(F.try_element_at(more, F.lower(w)), none))))

    def once(words: Column) -> Column:
        low = F.transform(words, lambda w: F.lower(w))
        return F.filter(words, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)

    return F.array_join(once(grown(base(words))), " ")


def rewritten_query(query: str, synonyms: Mapping[str, Sequence[str]] | None = None) -> str:
    """One query, rewritten by the rule of `rewritten`; the query itself where nothing is left."""
    words = query.split()
    base, out = [w for w in words if w.lower() not in STOPWORDS] or words, {}
    for w in base:
        for x in (w, *(synonyms or {}).get(w.lower(), ())):
            out.setdefault(x.lower(), x)
    return " ".join(out.values()) or query


def hybrid(
    pages: DataFrame, contributions: DataFrame, vectors: DataFrame, links: DataFrame, query: str, vector: list[float], as_of_s: int,
    f: MemoryFilter = MemoryFilter(), pool: str = "max", synonyms: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """slug, type, title, score of the best pages. Pages: doc_id, slug, type, title, body, tier, created_s, source; vectors: doc_id, embedding.

    Each leg keeps only its candidates (at most 50), so fusing and weighting handle a few rows; these are joined to pages and links as
    the small side.
    """
    limit = filters.clamped(f.limit)
    most = filters.candidates(limit)
    terms = rewritten_query(query, synonyms)
    seen = filters.matching(pages, contributions, f)
    # a chunk has all terms only if its page does: terms hold no blanks, and a chunk's words are the page's
    some = seen.filter(T.contains_all(F.col("body"), terms.split())).select("slug", F.struct("created_s", "slug").alias("of"), "body")
    cut = R.chunks(some, "of").filter(T.contains_all(F.col("chunk_text"), terms.split())).select("of.slug", "of.created_s", "chunk_index", "chunk_text")
    lex = R.scored(cut, {"chunk_text": "score"}, terms)
    lex = lex.select("slug", "chunk_index", "created_s", F.round("score", 6).alias("score"))
    order = (F.desc("score"), F.desc("created_s"), F.asc("slug"), F.asc("chunk_index"))
    a = R.ranks(lex.orderBy(*order).limit(most), *order).select("slug", "rank")
    near = R.nearest(vectors.join(seen.select("doc_id", "slug"), "doc_id"), vector, most, "slug")
    b = R.ranks(near, F.desc("score"), F.asc("slug")).select("slug", "rank")
    fused = settled(R.fuse([a, b], pool))
    tier = F.lit(1.0)
    for name, weight in TIER_WEIGHTS.items():
        tier = F.when(F.col("tier") == name, weight).otherwise(tier)
    few = F.broadcast(fused)  # at most twice the candidates
    back = G.backlinks(links.join(F.broadcast(fused.select(F.col("slug").alias("dst"))), "dst", "left_semi"))
    x = pages.join(few, "slug").join(back, "slug", "left")
    boost = 1 + BACKLINK * F.log1p(F.coalesce(F.col("backlinks"), F.lit(0)))
    age = (F.lit(as_of_s) - F.col("created_s")) / 86400.0
    weighted = F.round(F.col("rrf") * OWN_TEXT * tier * boost * F.coalesce(T.freshness(age), F.lit(1.0)), 6)
    x = x.select("slug", "type", "title", weighted.alias("score"))
    if f.types:
        x = x.filter(F.col("type").isin(*f.types))
    if f.exclude_types:
        x = x.filter(~F.col("type").isin(*f.exclude_types))
    return x.orderBy(F.desc("score"), "slug").limit(limit)
