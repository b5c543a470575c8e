"""Chat formatting: turns become one marked-up text, assembled as bytes in Arrow columns.

The template writes a turn as `<|im_start|>` role `\n` text `<|im_end|>` `\n`. Inside texts and roles
every `<` that is followed by backslashes and `|` gets one more backslash, so no control string can
stand in a text and the escape is undone exactly; in roles, backslashes and line ends are escaped too.
The loss mask is one span of bytes in each assistant turn: its text, without the marks.

Assembly is columnar: for a batch of turns the lengths of the five segments of each row give cumulative
offsets; headers and contents are scattered from their flat buffers into one preallocated buffer, which
becomes the Arrow column. A turn's bytes depend on that turn alone, so formatting needs no shuffle, and a
conversation of any length is the concatenation of its rows in order.

`digest` reads the formatted rows back: they are ordered by (conversation, turn) and walked as a stream
that holds one running hash, so a conversation with a third of all rows takes one task's time but no
memory. (A hash of a whole conversation is sequential by nature.)

Defined results: a null text or role is empty; turns are ordered by turn (null first), and equal turns
by their formatted text; repeated rows are turns of their own; a null conversation id is one conversation; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm import tokens as tk

#: The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"

_FORMATTED = "conv_id long, turn long, formatted string, loss_from long, loss_to long"


def _escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def _unescape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<\\(\\*)\|", r"<\1|")


def _escape_role(roles: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(_escape(roles), "\\", "\\\\"), "\n", "\\n")


@lru_cache(maxsize=1024)
def _role_of(head: str) -> str:
    """The role that a formatted row's head stands for."""
    role = "\\".join(p.replace("\\n", "\n") for p in head.split("\\\\"))
    return re.sub(r"<\\(\\*)\|", r"<\1|", role)


def assemble(segments: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows made of segments, each given as flat bytes and offsets: one buffer, and the offsets of every row's segments."""
    rows = len(segments[0][1]) - 1
    lengths = np.stack([np.diff(at) for _, at in segments], axis=1)
    place = np.concatenate([[0], np.cumsum(lengths.ravel())])
    out = np.empty(int(place[-1]), dtype=np.uint8)
    for k, (data, at) in enumerate(segments):
        size = lengths[:, k]
        begin = place[:-1].reshape(rows, -1)[:, k] if rows else np.zeros(0, np.int64)
        shift = np.repeat(begin - (at[:-1] - at[0]), size)
        out[np.arange(int(size.sum())) + shift] = data[at[0] : at[-1]]
    return out, place


def _constant(text: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return np.tile(data, rows), np.arange(rows + 1) * len(data)


def _format(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tk.batches(stream, "text"):
        n = batch.num_rows
        role = batch.column("role")
        content = tk.flat(_escape(batch.column("text")), lower=False)
        parts = [_constant(START, n), tk.flat(_escape_role(role), lower=False), _constant("\n", n), content, _constant(f"{END}\n", n)]
        data, place = assemble(parts)
        grid = place[:-1].reshape(n, len(parts)) if n else np.zeros((0, len(parts)), np.int64)
        rows = np.append(grid[:, 0], place[-1])
        text = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(rows.astype(np.int64)), pa.py_buffer(data)])
        none = pa.array(np.array([r != LEARNED for r in role.to_pylist()], dtype=bool))
        span = lambda k: pc.if_else(none, None, pa.array(grid[:, k] - grid[:, 0]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("turn"), text.cast(pa.string()), span(3).cast(pa.int64()), span(4).cast(pa.int64())],
            ["conv_id", "turn", "formatted", "loss_from", "loss_to"],
        )


def format_turns(turns: DataFrame) -> DataFrame:
    """Per turn: conv_id, turn, formatted text, and the loss mask's bytes in it (null: no loss)."""
    x = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return x.mapInArrow(_format, _FORMATTED)


class _Reading:
    """What is known so far of the conversation that is being read."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss, self.chars = conv, 0, 0, 0
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss, self.learned.hexdigest(), self.chars


_DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
    ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


def _digest(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, done = None, []

    def released() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pylist([dict(zip(_DIGEST.names, r)) for r in done], schema=_DIGEST)
        done.clear()
        return out

    for whole in stream:
        for batch in tk.batches(iter([whole]), "formatted"):
            text = batch.column("formatted")
            chars = pc.utf8_length(text).to_pylist()
            body = _unescape(text)
            convs, lo, hi = (batch.column(c).to_pylist() for c in ("conv_id", "loss_from", "loss_to"))
            spans = [None if a is None else t.as_buffer().to_pybytes()[a:b].decode() for t, a, b in zip(text, lo, hi)]
            learned = _unescape(pa.array(spans, pa.string())).to_pylist()
            for conv, t, raw, n, loss in zip(convs, body.to_pylist(), text, chars, learned):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Reading(conv)
                head = raw.as_py()
                role = _role_of(head[len(START) : head.index("\n")])
                content = t[t.index("\n") + 1 : -len(END) - 1]
                now.turns += 1
                now.chars += n
                now.all.update(f"{role}\n{content}\n".encode())
                if loss is not None:
                    now.loss += len(loss)
                    now.learned.update(loss.encode())
            if len(done) >= 1000:
                yield released()
    if now is not None:
        done.append(now.row())
    if done:
        yield released()


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from formatted turns: counts and hashes of the turns and of the text under the loss mask."""
    order = ["conv_id", "turn", "formatted"]
    x = formatted.repartition("conv_id").sortWithinPartitions(*order)
    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return x.mapInArrow(_digest, kind)


def conversations(formatted: DataFrame) -> DataFrame:
    """Training rows of whole conversations (conv_id, text); for conversations whose text fits a row."""
    rows = formatted.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "formatted"))).alias("rows"))
    return rows.select("conv_id", F.concat_ws("", "rows.formatted").alias("text"))
