"""Conversation blocks as a stream: messages wait for the watermark, join the open block of their stream, and close it by the rules of `activity.blocks`."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from engramlake.operators.activity import GAP_S, MESSAGES, TOKENS

#: Seconds after which a block of a document, which no gap closes, is taken to be whole.
IDLE_S = 30 * 86400

_MESSAGE = "at_s long, seq long, msg_id string, platform string, channel string, contact string, tokens double, thread string, doc_token string"
_BLOCK = "stream string, platform string, channel string, messages long, tokens double, start_s long, end_s long, thread string, participants int, block_hash string"
_NAMES = [c.split()[0] for c in _MESSAGE.split(", ")]


def _same(a, b) -> bool:
    return a == b or a is None and b is None


class Blocks(StatefulProcessor):
    """Per stream: the messages that the watermark has not passed, and one open block.

    A message waits until the watermark has passed it, so that late ones (within the watermark's delay) come before it in order; then it joins the open block or closes it. A block
    is also closed when the watermark is beyond the gap that would close it. Its state is bounded by the caps (in a document, by its parts).
    """

    def __init__(self, gap_s: int, tokens: float, most: int, idle_s: int):
        self.gap_s, self.tokens, self.most, self.idle_s = gap_s, tokens, most, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _MESSAGE)
        self.open = handle.getValueState("open", "block string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # pandas has no null for whole numbers or texts of its own
        plain = lambda v: None if pd.isna(v) else v
        for frame in rows:
            new = [tuple(plain(v) for v in r) for r in frame[_NAMES].itertuples(index=False)]
            self.waiting.appendList(new)
            # one timer for the first of them: when it expires, it takes all that are ready and sets the next one
            if new:
                self.handle.registerTimer(int(min(r[0] for r in new)) * 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        every = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in every if r[0] * 1000 <= now), key=lambda r: r[:2])
        if ready:
            late = [r for r in every if r[0] * 1000 > now]
            if late:
                self.waiting.put(late)
                self.handle.registerTimer(int(min(r[0] for r in late)) * 1000)
            else:
                self.waiting.clear()
        block = json.loads(self.open.get()[0]) if self.open.exists() else None
        done = []
        for r in ready:
            row = dict(zip(_NAMES, r))
            block = self._taken(block, row, done)
        if block is not None:
            end = (block["last"]["at_s"] + (self.idle_s if block["doc"] else self.gap_s)) * 1000
            if end < now:
                done.append(block)
                block = None
            elif ready:
                self.handle.registerTimer(end + 1)
        if block is None:
            self.open.clear()
        else:
            self.open.update((json.dumps(block),))
        if done:
            yield pd.DataFrame([self._row(key[0], b) for b in done], columns=[c.split()[0] for c in _BLOCK.split(", ")])

    def _taken(self, block: dict | None, row: dict, done: list[dict]) -> dict:
        """The open block after a message, which may have closed the one before."""
        channel = row["channel"] or ""
        doc = channel.startswith("docs/")
        alone = channel.startswith(("mail/", "calendar/")) or channel == "tasks" or doc and row["doc_token"] is None
        mark = None if doc or alone else row["thread"]
        size = row["tokens"] or 0.0
        if block is not None:
            was = block["last"]
            joins = _same(row["platform"], was["platform"]) and _same(row["channel"], was["channel"]) and not alone and not block["alone"]
            joins = joins and (_same(row["doc_token"], was["doc_token"]) if doc else row["at_s"] - was["at_s"] <= self.gap_s)
            full = not doc and (block["mark"] is not None and mark != block["mark"] or block["tokens"] + size > self.tokens or len(block["ids"]) >= self.most)
            if not joins or full:
                done.append(block)
                block = None
        if block is None:
            block = {"ids": [], "tokens": 0.0, "start": row["at_s"], "mark": None, "contacts": [], "doc": doc, "alone": alone}
        block["ids"].append(row["msg_id"])
        block["tokens"] += size
        block["mark"] = mark if block["mark"] is None else block["mark"]
        if row["contact"] is not None and row["contact"] not in block["contacts"]:
            block["contacts"].append(row["contact"])
        block["last"] = {c: row[c] for c in ("at_s", "platform", "channel", "doc_token")}
        return block

    @staticmethod
    def _row(stream, b: dict) -> tuple:
        mark = hashlib.sha256("|".join(sorted(i for i in b["ids"] if i is not None)).encode()).hexdigest()[:16]
        last = b["last"]
        return stream, last["platform"], last["channel"], len(b["ids"]), round(b["tokens"], 1), b["start"], last["at_s"], b["mark"], len(b["contacts"]), mark


def blocks(stream: DataFrame, late: str = "2 seconds", gap_s: int = GAP_S, tokens: float = TOKENS, most: int = MESSAGES, idle_s: int = IDLE_S) -> DataFrame:
    """Closed blocks of a stream of messages (stream, at_s, seq, msg_id, platform, channel, contact, tokens, thread, doc_token), as `activity.blocks` makes them of a table.

    Messages that come later than `late` behind the newest one are dropped. The state store must be RocksDB (`drain` sets it).
    """
    x = stream.select("stream", *[F.col(c).cast(k).alias(c) for c, k in (f.split() for f in _MESSAGE.split(", "))])
    x = x.withColumn("at", F.timestamp_seconds("at_s")).withWatermark("at", late)
    return x.groupBy("stream").transformWithStateInPandas(Blocks(gap_s, tokens, most, idle_s), _BLOCK, "Append", "EventTime")
