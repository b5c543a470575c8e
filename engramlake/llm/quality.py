"""Quality rules: every rule is evaluated once into a bitmask ledger; policies are masks over it.

The ledger holds one row per document: the measurements, `failed` (bit k set: rule k failed)
and the document's id. A policy is a version name and the mask of the rules that reject; a new
policy, or an ablation of one, reads the ledger and never the texts again.

Only DataFrame functions are used. All counts are made inside the row, so nothing is shuffled
and a hot source costs no more than another.

Defined results: a null text has no words (all counts 0); an empty text likewise; repeated rows
give repeated results; an empty table gives an empty ledger; columns of the input other than the
id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.llm.common import fresh, let, words_of

#: Fixed value: the characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
NGRAM = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters")


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column


def rules(of=F.col) -> list[Rule]:
    """The rules in bit order; `of` gives a measurement by its name. Integer arithmetic keeps every verdict exact."""
    n = of("n_words")
    return [
        Rule("few_words", n < 10),
        Rule("repeated_ngrams", 100 * of("n_repeat_words") > 20 * n),
        Rule("symbols_per_word", 10 * of("n_symbols") > 3 * n),
        Rule("duplicate_lines", (of("n_dup_lines") >= 3) & (10 * of("n_dup_lines") > 3 * of("n_lines"))),
        Rule("word_length", (of("word_chars") > 25 * n) | (of("word_chars") < 2 * n)),
        Rule("few_letters", 2 * of("n_letters") < of("word_chars")),
    ]


#: Policies by version: the names of the rules that reject a document.
POLICIES = {
    "base": ("few_words", "repeated_ngrams"),
    "v1": ("few_words", "repeated_ngrams", "symbols_per_word", "duplicate_lines", "word_length", "few_letters"),
}


def mask(policy: str | tuple[str, ...]) -> int:
    wanted = POLICIES[policy] if isinstance(policy, str) else policy
    names = [r.name for r in rules()]
    return sum(1 << names.index(w) for w in wanted)


def _covered(grams: Column, width: int) -> Column:
    """Positions covered by windows whose hash is in the array at least twice.

    `grams[i]` is the hash of the window that begins at word i. Sorting (hash, position) puts
    equal windows side by side; the union of the intervals [p, p + width) is summed from the
    sorted starting points.
    """
    ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def starts(s: Column) -> Column:
        last = F.size(s) - 1
        twin = lambda e, k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["g"] == e["g"])) | (
            (k < last) & (s[F.least(k + 1, last)]["g"] == e["g"])
        )
        return F.sort_array(F.array_compact(F.transform(s, lambda e, k: F.when(twin(e, k), e["i"]))))

    def union(p: Column) -> Column:
        last = F.size(p) - 1
        steps = F.transform(
            p,
            lambda x, k: F.when(k < last, F.least(p[F.least(k + 1, last)] - x, F.lit(width))).otherwise(F.lit(width)),
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(ordered, starts), union)


def repeat_words(words: Column, width: int = NGRAM) -> Column:
    """Words that lie in a window of `width` words found twice or more in the array."""

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - width),
            lambda i: F.xxhash64(*[h[i + k] for k in range(width)]),
        )

    def count(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(_covered(g, width))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < width, F.lit(0).cast("long")).otherwise(let(let(hashes, windows), count))


def _dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def measurements(text: Column) -> Column:
    """A struct of the counts named in MEASURES."""
    whole = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), _dup_lines(lines).alias("n_dup_lines"))

    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        let(words_of(text), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(whole) - F.length(F.regexp_replace(whole, r"\p{L}+", ""))).cast("long").alias("n_letters"),
    )


def _from(m: str) -> list[Column]:
    at = {"n_words": "w", "word_chars": "w", "n_repeat_words": "w", "n_lines": "l", "n_dup_lines": "l"}
    return [(F.col(f"{m}.{at[x]}.{x}") if x in at else F.col(f"{m}.{x}")).alias(x) for x in MEASURES]


def _failed(of=F.col) -> Column:
    bits = [F.when(r.fails, F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(rules(of))]
    return sum(bits[1:], bits[0]).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, every measurement, and `failed`, the bits of the failed rules."""
    measured = docs.select(F.col(id_col).alias("doc_id"), measurements(F.col(text_col)).alias("m"))
    return measured.select("doc_id", *_from("m")).withColumn("failed", _failed())


def apply_policy(book: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """The ledger with `kept`: no rule of the policy failed."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(book: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """One row per rule of the policy: documents failing it, failing it alone, and kept without it.

    One pass over the ledger: the documents are counted by their failure bits (at most two to
    the number of rules), and the rules are then read off those bits.
    """
    m = mask(policy)
    by_bits = book.groupBy(F.col("failed").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    named = [(1 << k, r.name) for k, r in enumerate(rules()) if m >> k & 1]
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(n).alias("rule")) for b, n in named]))
    x = by_bits.select("bits", "n", each.alias("r")).select("bits", "n", "r.*")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    rest = F.col("bits").bitwiseAND(F.lit(m) - F.col("bit"))
    return x.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("failing"),
        total(F.col("bits") == F.col("bit")).alias("failing_alone"),
        total(rest == 0).alias("kept_without"),
    )


def filter_documents(docs: DataFrame, policy: str | tuple[str, ...] = "v1", text_col: str = "text") -> DataFrame:
    """The documents that the policy keeps, with the columns they came with."""
    (book,) = fresh(docs, "quality_book")
    measured = docs.withColumn(book, measurements(F.col(text_col)))
    flat = measured.withColumn(book, F.struct(*_from(book)))
    bits = _failed(lambda name: F.col(f"{book}.{name}"))
    return flat.filter(bits.bitwiseAND(F.lit(mask(policy))) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
