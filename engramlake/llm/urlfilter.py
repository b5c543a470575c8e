"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

A canonical URL is its host (between the first `://` and the next `/`, `?`, `#` or the end; A-Z
lower-cased) followed by its path (up to `?`, `#` or the end). Rules are globs over it: `?` stands for
one byte other than `/`, `*` for any run of bytes without `/` and `**` for any run of bytes. All globs
are packed into one row of 64-bit words, one bit for each place between their letters (Shift-And with
self-loops for the stars); a byte of input moves every glob with one shift, two masks and an or. The
URLs of an Arrow batch are simulated side by side, the longest first, and leave when they end.

A host rule `example.net/en/` is the two globs `example.net/en/**` and `*.example.net/en/**`. Of the
host rules that fit, the longest wins (then the first given). Where none fits, the method decides by
`JUNK`, globs for addresses that are not worth fetching: block if one matches, else allow.

Each URL is judged by itself: no shuffle, and a hot host costs what any other does.

Defined results: a null URL or one without `://` has an empty host and path, fits no rule and is
allowed; a path is empty where the host is followed by `?`, `#` or nothing, and then no rule with a
path fits; repeated rows give repeated results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.llm import tokens as tk

#: Fixed values: (verdict, host and path).
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
#: Addresses of spam, trackers and endless calendars.
JUNK = (
    "*cheap-pills*/**",
    "*casino*/**",
    "*free-money*/**",
    "ads.*/**",
    "*.ads.*/**",
    "tracker.*/**",
    "*/wp-login*",
    "*/cgi-bin/**",
    "**/calendar/????/??/**",
)


@dataclass
class Automaton:
    """step[c] and loop[c]: for a byte c, the places that it may move into, and those that it may stay in."""

    begin: np.ndarray
    step: np.ndarray
    loop: np.ndarray
    #: Word and bit of the last place of each glob.
    word: np.ndarray
    bit: np.ndarray


def compile_globs(globs: tuple[str, ...]) -> Automaton:
    places: list[tuple[bytes | None, int]] = []  # by place: the byte before it (None: any but /), the star on it
    first, last = [], []
    for glob in globs:
        first.append(len(places))
        places.append((b"", 0))
        data, k = glob.encode(), 0
        while k < len(data):
            if data[k : k + 1] == b"*":
                stars = 2 if data[k : k + 2] == b"**" else 1
                places[-1] = (places[-1][0], max(stars, places[-1][1]))
                k += stars
                continue
            places.append((None if data[k : k + 1] == b"?" else data[k : k + 1], 0))
            k += 1
        last.append(len(places) - 1)
    words = max(1, -(-len(places) // 64))
    begin, step, loop = np.zeros(words, np.uint64), np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
    slash, others = ord("/"), [c for c in range(256) if c != ord("/")]
    for p, (byte, stars) in enumerate(places):
        at, one = p // 64, np.uint64(1) << np.uint64(p % 64)
        if byte is None:
            step[others, at] |= one
        elif byte:
            step[byte[0], at] |= one
        if stars:
            loop[others, at] |= one
        if stars == 2:
            loop[slash, at] |= one
    for p in first:
        begin[p // 64] |= np.uint64(1) << np.uint64(p % 64)
    ends = np.array(last, dtype=np.int64)
    return Automaton(begin, step, loop, ends // 64, (ends % 64).astype(np.uint64))


def run(texts: pa.Array, a: Automaton) -> np.ndarray:
    """Array (texts, globs): which globs match each whole text."""
    data, at = tk.flat(texts, lower=False)
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    start, length = at[:-1][order], size[order]
    state = np.repeat(a.begin[None, :], len(size), axis=0)
    live = len(size)
    for k in range(int(length[0]) if len(size) else 0):
        while live and length[live - 1] <= k:
            live -= 1
        c = data[start[:live] + k]
        now = state[:live]
        moved = now << np.uint64(1)
        moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
        state[:live] = (moved & a.step[c]) | (now & a.loop[c])
    out = np.zeros((len(size), len(a.word)), dtype=bool)
    out[order] = (state[:, a.word] >> a.bit[None, :]) & np.uint64(1) != 0
    return out


def host_of(url: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), upper, lower)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _judge(rules: tuple[tuple[str, str], ...], junk: tuple[str, ...]):
    # the longest first, so that the first that matches wins
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    globs = [g for _, r in ordered for g in (f"{r}**", f"*.{r}**")]
    automaton = compile_globs((*globs, *junk))
    names, verdicts = [*(r for _, r in ordered), None], [*(v for v, _ in ordered), None]

    def judge(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.batches(stream, "subject"):
            met = run(batch.column("subject"), automaton)
            fits = met[:, : len(globs)].reshape(batch.num_rows, len(ordered), 2).any(axis=2)
            which = np.where(fits.any(axis=1), fits.argmax(axis=1) if len(ordered) else 0, len(ordered))
            bad = met[:, len(globs) :].any(axis=1)
            verdict = [verdicts[k] or ("block" if b else "allow") for k, b in zip(which.tolist(), bad.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("page_id", "host", "path")),
                    pa.array([names[k] for k in which.tolist()], pa.string()),
                    pa.array(verdict, pa.string()),
                    pa.array(bad),
                ],
                ["page_id", "host", "path", "rule", "verdict", "junk"],
            )

    return judge


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, junk: tuple[str, ...] = JUNK) -> DataFrame:
    """Per page: page_id, host, path, the rule that holds (or null), the verdict, and whether a junk glob matches."""
    x = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    kind = f"page_id {dict(pages.dtypes)['page_id']}, host string, path string, rule string, verdict string, junk boolean"
    return x.withColumn("subject", F.concat("host", "path")).mapInArrow(_judge(rules, junk), kind)
