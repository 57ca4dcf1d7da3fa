"""Chat formatting by columnar byte assembly.

A turn is written as ``[INST]role[/INST]text</s>``.  Inside roles and texts every backslash is doubled, and every control
string gets a backslash after its first character, so that none is left and the texts can be read back.

Turns of a conversation come together in order.  For a block of turns the lengths of all segments give, by running
sums, the place of each in the output; headers are set and contents are scattered there by index, into one buffer
that Arrow then holds as the texts of all conversations of the block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
CONTROLS = ("<s>", END, OPEN, CLOSE)
#: The role whose texts count for the loss.
LEARNT = "assistant"
#: Bytes of turns that are laid out at once; a longer conversation is written in several parts.
BLOCK_BYTES = 4 << 20
#: Contents from this length on are copied whole rather than by index.
LONG = 1 << 14
FORMATTED = "conv_id long, part long, text string, n_turns long, loss_starts array<long>, loss_ends array<long>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(text: pa.Array) -> pa.Array:
    out = pc.replace_substring(text, "\\", "\\\\")
    for mark in CONTROLS:
        out = pc.replace_substring(out, mark, mark[0] + "\\" + mark[1:])
    return out


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def _content(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column without nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    found = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return found[offsets[0] : offsets[-1]], offsets - offsets[0]


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy content i, ``data[offsets[i]:offsets[i + 1]]``, to ``out[at[i]:]``."""
    sizes = np.diff(offsets)
    long = sizes >= LONG
    for i in np.flatnonzero(long):
        out[at[i] : at[i] + sizes[i]] = data[offsets[i] : offsets[i + 1]]
    if long.any():
        data, at, sizes = data[np.repeat(~long, sizes)], at[~long], sizes[~long]
    begin = np.cumsum(sizes) - sizes
    out[np.repeat(at - begin, sizes) + np.arange(len(data))] = data


def assembled(role: pa.Array, text: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """(buffer, ends of turns, (start, end) of every text in it) of turns."""
    (roles, role_at), (texts, text_at) = _content(escaped(role)), _content(escaped(text))
    marks = [np.frombuffer(m.encode(), np.uint8) for m in (OPEN, CLOSE, END)]
    sizes = np.empty((len(role), 5), np.int64)
    sizes[:, 0::2] = [len(m) for m in marks]
    sizes[:, 1], sizes[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(sizes).reshape(-1, 5)
    starts = ends - sizes
    buffer = pa.allocate_buffer(int(ends[-1, -1]) if len(ends) else 0)
    out = np.frombuffer(buffer, np.uint8)
    for k, mark in zip((0, 2, 4), marks):
        out[starts[:, k, None] + np.arange(len(mark))] = mark
    _scatter(out, starts[:, 1], roles, role_at)
    _scatter(out, starts[:, 3], texts, text_at)
    return buffer, ends[:, 4], np.stack([starts[:, 3], ends[:, 3]], 1)


def _first_of_runs(conv: pa.Array) -> np.ndarray:
    """Where another conversation begins; rows without an id are one."""
    ids, none = conv.fill_null(0).to_numpy(zero_copy_only=False), conv.is_null().to_numpy(zero_copy_only=False)
    new = np.ones(len(conv), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])
    return np.flatnonzero(new)


def _same_id(a: pa.Scalar, b: pa.Scalar) -> bool:
    return a.as_py() == b.as_py()


def format_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``FORMATTED`` rows of turns (conv_id, role, text) that are sorted by conversation.

    A conversation is one row, or several parts in order if its turns fill more than a block.
    """
    held: pa.Table | None = None
    begun: tuple[pa.Scalar, int] | None = None  # a conversation whose first parts are out, and how many

    def blocks() -> Iterator[tuple[pa.Table, bool]]:
        nonlocal held
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.set_column(2, "text", table["text"].cast(pa.large_string()).fill_null(""))
            table = table.set_column(1, "role", table["role"].cast(pa.large_string()).fill_null(""))
            size = np.cumsum(pc.binary_length(table["text"]).to_numpy()) // BLOCK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1), len(table)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    piece = table.slice(a, b - a)
                    yield (piece if held is None else pa.concat_tables([held, piece])).combine_chunks(), False
        if held is not None:
            yield held.combine_chunks(), True

    for block, last in blocks():
        conv = block["conv_id"].chunk(0)
        first = _first_of_runs(conv)
        keep = len(block)
        held = None
        if not last and (len(first) > 1 or block.nbytes < BLOCK_BYTES):
            keep = int(first[-1])  # the last conversation may go on
            held = block.slice(keep)
            first = first[:-1]
        if not keep:
            continue
        block = block.slice(0, keep).combine_chunks()
        conv = block["conv_id"].chunk(0)
        buffer, ends, spans = assembled(block["role"].chunk(0), block["text"].chunk(0))
        turns = np.diff([*first, keep])
        at = np.concatenate([[0], ends[first + turns - 1]])
        learnt = np.flatnonzero(pc.equal(block["role"], LEARNT).to_numpy())
        of_run = np.searchsorted(first, learnt, "right") - 1
        inside = spans[learnt] - at[of_run][:, None]
        lists = np.concatenate([[0], np.cumsum(np.bincount(of_run, minlength=len(first)))]).astype(np.int32)
        parts = np.zeros(len(first), np.int64)
        if begun and _same_id(begun[0], conv[0]):
            parts[0] = begun[1]
        begun = (conv[keep - 1], int(parts[-1]) + 1)
        text = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(at.astype(np.int64)), buffer]).cast(pa.string())
        starts, stops = (pa.ListArray.from_arrays(pa.array(lists), pa.array(inside[:, k])) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([conv.take(pa.array(first)), pa.array(parts), text, pa.array(turns), starts, stops], ["conv_id", "part", "text", "n_turns", "loss_starts", "loss_ends"])


def _in_order(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    named = turns.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    return named.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def formatted(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``FORMATTED``: the text of every conversation, and where in its UTF-8 bytes the texts of the assistant lie.

    Null roles and texts are empty.  Rows without a conversation are one; a null turn comes first; rows of one turn are
    ordered by role and text, repeated ones stay.  A conversation of over BLOCK_BYTES has several rows, numbered by
    ``part``, that follow each other in their partition.  Each task goes through its conversations in order, a
    block at a time, so its memory doesn't grow with them; one that goes on without end keeps one task busy.
    Other columns are ignored.  An empty table has no rows.
    """
    return _in_order(turns, conv_id, turn, role, text).mapInArrow(format_turns, FORMATTED)


class _Reading:
    """What has been read of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n_turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, spans: list[tuple[int, int]]) -> None:
        self.chars += len(text)
        for one in text.split(END)[:-1]:
            role, _, content = one[len(OPEN) :].partition(CLOSE)
            self.turns.update(f"{unescaped(role)}\n{unescaped(content)}\n".encode())
            self.n_turns += 1
        data = text.encode()
        for start, end in spans:
            content = unescaped(data[start:end].decode())
            self.loss.update(content.encode())
            self.loss_chars += len(content)

    def row(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``DIGESTS`` of formatted conversations, whose parts follow each other."""
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    now: _Reading | None = None
    for batch in batches:
        done = []
        for k in range(batch.num_rows):
            conv_id, part, text, _, starts, ends = (column[k].as_py() for column in batch.columns)
            if part == 0:
                if now is not None:
                    done.append(now.row())
                now = _Reading(conv_id)
            now.add(text, list(zip(starts, ends)))
        if done:
            yield batch_of(done)
    if now is not None:
        yield batch_of([now.row()])


def digests(turns: DataFrame, more: DataFrame | None = None, **columns: str) -> DataFrame:
    """``DIGESTS`` per conversation of the turns (and of ``more``), all read from the formatted texts.

    Turns are hashed as role, line feed, text, line feed; the loss covers the texts of the assistant.  SHA-256 goes
    through a conversation in order, so its parts are read where they were written.
    """
    every = turns if more is None else turns.unionByName(more, allowMissingColumns=True)
    return formatted(every, **columns).mapInArrow(read_digests, DIGESTS)


def sql_escaped(column: str) -> str:
    """The same escapes in SQL."""
    out = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    for mark in CONTROLS:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


def probe(turns: DataFrame) -> DataFrame:
    """Conversation -1, whose texts are made of control strings."""
    said = f"{END}{OPEN} ok {CLOSE}"
    rows = turns.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, LEARNT, said)], "conv_id long, turn long, role string, text string")
    kinds: list[Column] = [F.col(c).cast(turns.schema[c].dataType) for c in rows.columns]
    return rows.select(*kinds)
