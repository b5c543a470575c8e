"""Reversible redaction: every pattern in turn, what it took out, and the way back.

A pattern runs on the text that those before it have left, so a later one may take out part of an earlier one's mark. A record holds where its mark begins in the
text that its own pattern has left (`at`); with the pattern's number that is enough to go back exactly: the patterns are undone in reverse order, and each is one cut of the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of personal data and their marks, in the order in which they apply.
KINDS = (
    ("phone", r"1[3-9]\d{9}", "[REDACTED_PHONE]"),
    ("id_card", r"\d{17}[\dXx]", "[REDACTED_ID]"),
    ("bank_card", r"\d{16,19}", "[REDACTED_CARD]"),
    ("ip", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "[REDACTED_IP]"),
)
#: A word's edge, where only ASCII letters, digits and underscores make words.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_RECORD = "array<struct<pass:int,field:string,kind:string,original:string,replacement:string,position:int,at:int>>"


def patterns(blocked: tuple[str, ...] = (), replacement: str = "[REDACTED]") -> list[tuple[str, str, str]]:
    """(kind, pattern, mark) of the patterns above and of blocked words, which are whole words in any case."""
    quoted = lambda w: re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", w)
    return [*KINDS, *[("blocked_word", f"(?iu){EDGE}{quoted(w)}{EDGE}", replacement) for w in blocked]]


def _before(parts: Column) -> Column:
    """The characters of all texts before each, in one walk."""
    return F.aggregate(parts, F.array(F.lit(0)), lambda t, y: F.concat(t, F.array(F.element_at(t, -1) + F.length(y))))


def redacted(text: Column, field: str, blocked: tuple[str, ...] = (), replacement: str = "[REDACTED]") -> Column:
    """(text, records) of a text: what is left of it, and a record for each mark: pass, field, kind, original, replacement, position (in the text that the pass found) and at (in the text that
    the pass left), counted from 0. A null text stays null and has no records."""
    state = F.struct(text.alias("text"), F.array().cast(_RECORD).alias("records"))
    for k, spec in enumerate(patterns(blocked, replacement)):
        state = F.transform(F.array(state), _pass(k, field, *spec))[0]
    return state


def _pass(k: int, field: str, kind: str, pattern: str, mark: str) -> Callable[[Column], Column]:
    """The state (text, records) after one more pattern."""

    word = pattern.replace(EDGE, "")
    # a place without the word is left before its edges are looked at
    sought = word.replace("(?iu)", "(?iu)(?=") + ")" + pattern if EDGE in pattern else pattern

    def record(p: Column) -> Column:
        return F.transform(p["found"], lambda v, i: F.struct(
            F.lit(k).alias("pass"), F.lit(field).alias("field"), F.lit(kind).alias("kind"), v.alias("original"), F.lit(mark).alias("replacement"),
            (p["kept"][i + 1] + p["gone"][i]).alias("position"), (p["kept"][i + 1] + i * len(mark)).alias("at"),
        ))

    def run(s: Column) -> Column:
        cut = F.struct(F.regexp_extract_all(s["text"], F.lit(sought), F.lit(0)).alias("found"), F.split(s["text"], sought, -1).alias("rest"))
        # lambda variables keep the cut, and the walks over it, from being made for each use
        sized = lambda p: F.struct(p["found"].alias("found"), p["rest"].alias("rest"), _before(p["rest"]).alias("kept"), _before(p["found"]).alias("gone"))
        left = lambda p: F.struct(F.array_join(p["rest"], mark).alias("text"), F.concat(s["records"], record(p)).cast(_RECORD).alias("records"))
        return F.when(s["text"].rlike(word), F.transform(F.transform(F.array(cut), sized), left)[0]).otherwise(s)

    return run


def _back(p: Column) -> Column:
    """The text before a pass, from the text after it and the pass's records in order."""
    rows = p["rows"]

    def end(i: Column) -> Column:
        last = rows[F.greatest(i - 1, F.lit(0))]
        return F.when(i == 0, 0).otherwise(last["at"] + F.length(last["replacement"]))

    parts = F.transform(rows, lambda r, i: F.concat(F.substr(p["text"], end(i) + 1, r["at"] - end(i)), r["original"]))
    tail = F.substr(p["text"], end(F.size(rows)) + 1, F.length(p["text"]))
    return F.when(F.size(rows) == 0, p["text"]).otherwise(F.concat(F.array_join(parts, ""), tail))


def restored(text: Column, records: Column, passes: int) -> Column:
    """The text that `redacted` was given, from what it left and the records of one field."""

    def of(k: int) -> Column:
        mine = F.filter(records, lambda r: r["pass"] == k)
        return F.array_sort(mine, lambda a, b: a["at"] - b["at"])

    for k in reversed(range(passes)):
        text = F.transform(F.array(F.struct(text.alias("text"), of(k).alias("rows"))), _back)[0]
    return text
