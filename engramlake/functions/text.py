"""Text expressions: trigram similarity, token estimates, redaction, slugs, noise rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of personal data and their replacements, in the order in which they apply.
REDACTIONS = (
    (r"1[3-9]\d{9}", "[PHONE]"),
    (r"\d{17}[\dXx]", "[ID]"),
    (r"\d{16,19}", "[CARD]"),
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "[IP]"),
)
#: Fixed value: the CJK ranges whose characters count one by one.
CJK = r"[一-鿿㐀-䶿぀-ヿ가-힯]"

#: Fixed value: the CJK ideographs that are words of their own in a text's variety of words.
IDEOGRAPHS = r"[一-鿿㐀-䶿]"


def trigrams(x: Column) -> Column:
    """The set of trigrams of the words of a text, each padded by two blanks before and one after."""
    words = F.array_distinct(F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != ""))

    def grams(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, grams)))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 if neither text has any."""
    pair = F.struct(trigrams(a).alias("x"), trigrams(b).alias("y"))
    sizes = lambda p: F.struct(
        F.size(F.array_intersect(p["x"], p["y"])).alias("both"), (F.size(p["x"]) + F.size(p["y"])).alias("all")
    )
    share = lambda n: F.when(n["all"] > 0, n["both"] / (n["all"] - n["both"])).otherwise(F.lit(0.0))
    # lambda variables keep each list of trigrams from being made more than once
    return F.transform(F.transform(F.array(pair), sizes), share)[0]


def contains_all(x: Column, terms: list[str]) -> Column:
    """Every term stands in the text, in any case."""
    out = F.lit(bool(terms))
    for t in terms:
        out = out & F.lower(x).contains(t.lower())
    return out


def snippet(x: Column, term: str, around: int = 40) -> Column:
    """The first match with `around` characters on either side, marked, with dots where text was cut."""
    at = F.instr(F.lower(x), term.lower())
    lo = F.greatest(at - around, F.lit(1))
    hi = F.least(at + len(term) + around, F.length(x) + 1)
    return F.when(
        at > 0,
        F.concat(
            F.when(lo > 1, "...").otherwise(""), F.substr(x, lo, at - lo), F.lit("**"), F.substr(x, at, F.lit(len(term))),
            F.lit("**"), F.substr(x, at + len(term), hi - at - len(term)), F.when(hi <= F.length(x), "...").otherwise(""),
        ),
    )


def token_estimate(x: Column) -> Column:
    """1.5 for a CJK character, 1.3 for a run of others without white space."""
    rest = F.regexp_replace(x, CJK, " ")
    return 1.5 * F.regexp_count(x, F.lit(CJK)) + 1.3 * F.regexp_count(rest, F.lit(r"[^\s]+"))


def type_token_ratio(x: Column) -> Column:
    words = F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.when(F.size(words) > 0, F.size(F.array_distinct(words)) / F.size(words)).otherwise(F.lit(0.0))


def word_ratio(x: Column) -> Column:
    """Distinct words over words, where each CJK character is a word and the rest of a run without white space is one more."""
    rest = F.filter(F.split(F.lower(F.regexp_replace(x, IDEOGRAPHS, "")), r"\s+"), lambda w: w != "")
    words = F.concat(F.regexp_extract_all(x, F.lit(IDEOGRAPHS), F.lit(0)), rest)
    share = lambda w: F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(F.lit(0.0))
    return F.transform(F.array(words), share)[0]


def ratio_score(r: Column) -> Column:
    return F.when(r > 0.6, 1.0).when(r < 0.2, F.when(r > 0, 0.1).otherwise(0.0)).otherwise((r - 0.2) / 0.4)


def token_score(t: Column) -> Column:
    return F.when(t < 50, t / 50).when(t <= 500, 1.0).when(t <= 3000, 1 - (t - 500) / 5000).otherwise(0.5)


def redact(x: Column) -> Column:
    for pattern, mark in REDACTIONS:
        x = F.regexp_replace(x, pattern, mark)
    return x


def slugify(x: Column) -> Column:
    """Lower-case letters and digits joined by dashes; a short or empty slug gets a hash."""
    kebab = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    mark = F.substring(F.sha2(x, 256), 1, 12)
    return F.when(F.length(kebab) >= 3, kebab).when(kebab == "", mark).otherwise(F.concat(kebab, F.lit("-"), mark))


def freshness(age_days: Column) -> Column:
    return 1 + 0.3 * F.exp(-F.greatest(age_days, F.lit(0.0)) / 90)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, v: t + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
