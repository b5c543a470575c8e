"""Memory filters: which pages a search may see, by source, participant, type and time, and the bounds of its arguments."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Results by default and at most, for searches, lists and walks (depth).
SEARCH, LISTS, DEPTH = (20, 50), (20, 100), (2, 5)
#: Seconds of the units of a relative time.
UNITS = {"m": 60, "h": 3600, "d": 86400}


@dataclass(frozen=True)
class MemoryFilter:
    """What pages must be. A page is judged by its active contributions; only one without any is judged by its own source."""

    platform: str | Sequence[str] | None = None
    source_type: str | Sequence[str] | None = None
    channel: str | None = None
    channel_name: str | None = None
    participant: str | None = None
    types: Sequence[str] = ()
    exclude_types: Sequence[str] = ()
    since: str | None = None
    until: str | None = None
    limit: int | None = None


def clamped(value: float | None, bounds: tuple[int, int] = SEARCH) -> int:
    """A limit within its bounds (default, most); the default for what is no positive number."""
    if value is None or value != value or value in (float("inf"), float("-inf")) or value <= 0:
        return bounds[0]
    return min(int(value), bounds[1])


def candidates(limit: int) -> int:
    """How many candidates each leg of a search fetches for so many results."""
    return min(SEARCH[1], max(SEARCH[0], 3 * limit))


def seconds(at: str) -> tuple[int, bool]:
    """Epoch seconds (UTC) of a date or a time, and whether it was a date only."""
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", at):
        d = date.fromisoformat(at)
        return int(datetime(d.year, d.month, d.day, tzinfo=timezone.utc).timestamp()), True
    t = datetime.fromisoformat(at)
    return int((t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp()), False


def since(text: str, now_s: int) -> int:
    """The epoch second that a relative time (7d, 2h, 30m) or an absolute one names."""
    if m := re.fullmatch(r"(\d+)([mhd])", text):
        return now_s - int(timedelta(seconds=int(m[1]) * UNITS[m[2]]).total_seconds())
    return seconds(text)[0]


def valid_slug(slug: str) -> bool:
    """Slash-separated parts without white space, empty parts or ways up."""
    parts = slug.split("/")
    return bool(slug) and not re.search(r"\s", slug) and all(p not in ("", ".", "..") for p in parts)


def _source_tests(f: MemoryFilter) -> list[Callable[[Column], Column]]:
    """Tests of a source (platform, source_type, channel, channel_name, author, participants), one for each field of the filter."""
    tests: list[Callable[[Column], Column]] = []
    for field in ("platform", "source_type"):
        wanted = getattr(f, field)
        wanted = [wanted] if isinstance(wanted, str) else list(wanted or ())
        if wanted:
            tests.append(lambda s, field=field, wanted=wanted: s[field].isin(*wanted))
    for field in ("channel", "channel_name"):
        if getattr(f, field):
            tests.append(lambda s, field=field: s[field] == getattr(f, field))
    if f.participant:
        who = lambda p: (p["name"] == f.participant) | (p["id"] == f.participant)
        tests.append(lambda s: F.coalesce(F.exists(s["participants"], who), F.lit(False)) | F.coalesce(who(s["author"]), F.lit(False)))
    return tests


def matching(pages: DataFrame, contributions: DataFrame, f: MemoryFilter) -> DataFrame:
    """The pages (slug, type, created_s, source) that a filter lets through. Contributions: page, active, source.

    One partial aggregation of the contributions answers all source tests; it is skipped where the filter has none.
    """
    out = pages
    if tests := _source_tests(f):
        live = contributions.filter("active").groupBy(F.col("page").alias("_page"))
        live = live.agg(*[F.max(F.coalesce(t(F.col("source")), F.lit(False))).alias(f"_met{k}") for k, t in enumerate(tests)])
        out = out.join(live, out["slug"] == F.col("_page"), "left")
        for k, t in enumerate(tests):
            out = out.filter(F.when(F.col("_page").isNotNull(), F.col(f"_met{k}")).otherwise(F.coalesce(t(F.col("source")), F.lit(False))))
        out = out.select(*pages.columns)
    if f.types:
        out = out.filter(F.col("type").isin(*f.types))
    if f.exclude_types:
        out = out.filter(~F.col("type").isin(*f.exclude_types))
    at = F.coalesce(F.col("source.timestamp_s"), F.col("created_s"))
    if f.since:
        out = out.filter(at >= seconds(f.since)[0])
    if f.until:
        end, day = seconds(f.until)
        out = out.filter(at < end + 86400 if day else at <= end)
    return out
