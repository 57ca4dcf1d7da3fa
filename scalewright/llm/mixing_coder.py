"""Token ids in files, packed by an adaptive context-mixing range coder.

Ids of a segment are cut into blocks of at most ``BLOCK``, coded side by side, one numpy lane each, with one model for
all of them.  For each id the model adds up four predictions into one distribution:

* the id that follows the same two ids (order 2),
* two ids that follow the same id (order 1),
* all ids of the segment so far by their counts, with a share for every id (order 0).

The weights in use depend on how firmly orders 2 and 1 hold in their contexts, and follow how often each prediction was
right there.  The id's part of that sum, which is exact in whole numbers and adds up to a power of two, goes to a range
coder that keeps one number per lane (range asymmetric numeral systems), so reading an id back takes no division by a range.
The model learns from all lanes after every few ids, so between two lessons a step is some dozens of array operations over
all lanes, and the writer weighs the ids between them at once.  Every block has its own checksum.

Files are written by Spark's text writer, one segment a line; the reader goes by the lengths in the headers.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import new_path, saved

#: Most and fewest ids in a block of a long segment, and blocks that are coded side by side.
BLOCK, LEAST_BLOCK, LANES = 1024, 512, 2048
END_ID = 2
#: Kinds of characters that the byte-level vocabulary's pre-tokenizer tells apart; all others are one more kind.
_KINDS = {1: r"\p{L}+", 2: r"\p{N}+", 3: r"\s+"}
_SPACE, _BLANK, _APOSTROPHE = 3, ord(" "), ord("'")
#: What an apostrophe at the start of a word takes with it.
_SHORT, _LONG = "stmd", ("re", "ve", "ll")
#: Words remembered, each 64 bytes of a long one counting as a further word, and bytes of texts that are split at once.
REMEMBERED, TEXT_AT_ONCE = 1 << 20, 1 << 22
#: The letters of a byte-level vocabulary: bytes that can be printed stand for themselves, others for characters from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_LETTERS = np.arange(256, dtype="<u4")
_LETTERS[sorted({*range(256)} - _PRINTED)] = np.arange(256, 256 + 256 - len(_PRINTED))

_HASHED = 1 << 18
_U = np.uint64
#: What the weights of the four predictions add up to, what the counts of order 0 do, and the longest time between lessons.
_WEIGHTS, _BASE, _LESSON = 256, 1 << 19, 32
#: A lane's number stays in [_LEAST, 2^32 * _LEAST); the parts add up to 2^_BITS.
_BITS, _LEAST, _WORD = 27, _U(1 << 31), _U(32)


def _lesson_after(t: int) -> bool:
    """Whether the model learns once ``t`` ids of every lane are known: often at first, then every ``_LESSON``."""
    return t % _LESSON == 0 or t <= 8 * _LESSON and t % (_LESSON // 2) == 0 or t < _LESSON and t & (t - 1) == 0


class _Model:
    """Predictions and weights of all lanes, which share them."""

    def __init__(self, lanes: int):
        self.two, self.firm_two = np.full(_HASHED, 0xFFFF, np.uint16), np.zeros(_HASHED, np.int8)
        self.one, self.other, self.firm_one = np.full(1 << 16, 0xFFFF, np.uint16), np.full(1 << 16, 0xFFFF, np.uint16), np.zeros(1 << 16, np.int8)
        self.right = np.tile(np.array([2, 2, 1, 3]), (16, 1))
        self.counts, self.n = np.zeros(1 << 16, np.int64), 0
        self.back1, self.back2 = np.zeros(lanes, np.intp), np.zeros(lanes, np.intp)
        self.steps: list[tuple] = []
        self._weigh()

    def _weigh(self) -> None:
        """What coding uses of the counts: shares of all ids that add up to _BASE."""
        share = 1 + (self.counts * (_BASE - len(self.counts)) // self.n if self.n else np.full(len(self.counts), _BASE // len(self.counts) - 1))
        share[np.flatnonzero(self.counts)[: _BASE - share.sum()]] += 1  # what rounding left
        self.share, self.upto = share.astype(np.int32), np.concatenate([[0], np.cumsum(share)]).astype(np.int32)
        self.whose = None
        self.total = _BASE * _WEIGHTS
        w = 1 + self.right * (_WEIGHTS - 4) // self.right.sum(1, keepdims=True)
        w[:, 3] += _WEIGHTS - w.sum(1)
        *self.masses, self.rest = (v.astype(np.int32) for v in (*(w[:, :3].T * _BASE), w[:, 3]))

    def look(self, back2: np.ndarray | None = None, back1: np.ndarray | None = None) -> None:
        """Predictions behind two ids (those of this position), what each weighs, and what a count does."""
        back2, back1 = (self.back2, self.back1) if back2 is None else (back2, back1)
        self.at, self.behind = (back2 * 40503 + back1 * 30011) & (_HASHED - 1), back1
        self.p = [self.two.take(self.at).astype(np.int32), self.one.take(back1).astype(np.int32), self.other.take(back1).astype(np.int32)]
        self.row = self.firm_two.take(self.at) * np.int8(4) + self.firm_one.take(back1)
        row = self.row.astype(np.intp)
        self.mass, self.count = [m.take(row) for m in self.masses], self.rest.take(row)

    def part(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids' parts of the total begin, and how long they are."""
        start, own = self.count * self.upto.take(ids), self.count * self.share.take(ids)
        ids = ids.astype(np.int32)
        self.hit = [p == ids for p in self.p]
        for p, hit, mass in zip(self.p, self.hit, self.mass):
            start += mass * (p < ids)
            own += mass * hit
        return start, own

    def find(self, value: np.ndarray) -> np.ndarray:
        """The id whose part holds ``value``.

        The predictions are passed in ascending order.  A value behind one's part loses its mass, a value within it is
        moved into the share of the id's count, and one before it stays.
        """
        a, b, c = (p.astype(np.int64) << 32 | mass for p, mass in zip(self.p, self.mass))
        a, b = np.minimum(a, b), np.maximum(a, b)
        b, c = np.minimum(b, c), np.maximum(b, c)
        a, b = np.minimum(a, b), np.maximum(a, b)
        if self.whose is None:
            self.whose = np.repeat(np.arange(len(self.share), dtype=np.uint16), self.share)
        value = value.astype(np.int32)
        for packed in (a, b, c):
            last = self.count * self.upto.take((packed >> 32) + 1) - 1
            value = np.maximum(value - packed.astype(np.int32), np.minimum(value, last))
        return self.whose.take(value // self.count).astype(np.intp)

    def learn(self, ids: np.ndarray) -> None:
        """Contexts, weights and counts after ``ids``, which ``look`` and ``part`` were called for."""
        none, one, two, three = np.arange(4, dtype=np.int8)
        which = np.where(self.hit[0], none, np.where(self.hit[1], one, np.where(self.hit[2], two, three)))
        self.right += np.bincount(self.row * 4 + which, minlength=64).reshape(16, 4)
        firm, small = self.row >> 2, ids.astype(np.uint16)
        first, second, third = (p.astype(np.uint16) for p in self.p)
        # Of ids in one context the last one counts.
        self.two[self.at] = np.where(firm > 1, first, small)
        self.firm_two[self.at] = self._firmer(firm, self.hit[0])
        firm = self.row & 3
        self.other[self.behind] = np.where(self.hit[1], third, np.where(firm > 1, small, second))
        self.one[self.behind] = np.where(firm > 1, second, small)
        self.firm_one[self.behind] = self._firmer(firm, self.hit[1])
        self.counts += np.bincount(ids, minlength=1 << 16)
        self.n += len(ids)
        self._weigh()

    @staticmethod
    def _firmer(firm: np.ndarray, hit: np.ndarray) -> np.ndarray:
        return np.where(hit, np.minimum(firm + 1, 3), np.where(firm > 1, firm - 1, 1)).astype(np.int8, copy=False)

    def backs(self, seen: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The two ids before each of the ids of ``seen`` (steps x lanes) from step ``start`` to ``end``, in a line."""
        before = np.zeros((end - start + 2, seen.shape[1]), np.intp)
        before[max(0, 2 - start) :] = seen[max(0, start - 2) : end]
        return before[:-2].ravel(), before[1:-1].ravel()

    def update(self, ids: np.ndarray, t: int, seen: np.ndarray) -> None:
        """The ids of step ``t``, which ``look`` and ``part`` were called for, are known; ``seen`` (lanes x steps) has them all.

        At the end of a lesson the model learns.
        """
        self.back2, self.back1 = self.back1, ids.astype(np.intp)
        self.steps.append((self.at, self.behind, self.row, *self.p, *self.hit))
        if _lesson_after(t + 1):
            at, behind, row, *both = map(np.concatenate, zip(*self.steps))
            self.at, self.behind, self.row, self.p, self.hit = at, behind, row, both[:3], both[3:]
            self.learn(seen.T[t + 1 - len(self.steps) : t + 1].ravel())
            self.steps = []


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Packed bytes of each row of ``ids`` (lanes x length)."""
    lanes, length = ids.shape
    ids = np.ascontiguousarray(ids.T).astype(np.intp)
    model, known = _Model(lanes), 0
    starts, owns = np.empty((length, lanes), np.int32), np.empty((length, lanes), np.int32)
    while known < length:
        upto = known + 1
        while upto < length and not _lesson_after(upto):
            upto += 1
        now = ids[known:upto].ravel()
        model.look(*model.backs(ids, known, upto))
        starts[known:upto], owns[known:upto] = (v.reshape(-1, lanes) for v in model.part(now))
        model.learn(now)
        known = upto
    # The coder works like a stack, so it takes the ids from the last to the first.
    x, out, at = np.full(lanes, _LEAST, _U), np.zeros((lanes, length + 2), np.uint32), np.full(lanes, length + 2)
    for start, own in zip(starts[::-1], owns[::-1]):
        start, own = start.astype(_U), own.astype(_U)
        full = np.flatnonzero(x >= own << _U(63 - _BITS))
        at[full] -= 1
        out[full, at[full]] = x[full] & _U(0xFFFFFFFF)
        x[full] >>= _WORD
        times = x // own
        x = (times << _U(_BITS)) + (x - times * own) + start
    lane = np.arange(lanes)
    out[lane, at - 1], out[lane, at - 2] = x & _U(0xFFFFFFFF), x >> _WORD
    return [row[k:].astype("<u4").tobytes() for row, k in zip(out, at - 2)]


def decode_blocks(packed: list[bytes], length: int) -> np.ndarray:
    """The inverse of ``encode_blocks``."""
    lanes = len(packed)
    words = np.zeros((lanes, max(map(len, packed)) // 4 + 1), np.uint32)
    for i, raw in enumerate(packed):
        words[i, : len(raw) // 4] = np.frombuffer(raw, "<u4")
    model = _Model(lanes)
    ids = np.zeros((length, lanes), np.intp)
    x, at = words[:, 0].astype(_U) << _WORD | words[:, 1], np.full(lanes, 2)
    for t in range(length):
        model.look()
        value = x & _U((1 << _BITS) - 1)
        now = model.find(value)
        start, own = model.part(now)
        x = (x >> _U(_BITS)) * own.astype(_U) + (value - start.astype(_U))
        low = np.flatnonzero(x < _LEAST)
        x[low] = x[low] << _WORD | words[low, at[low]]
        at[low] += 1
        ids[t] = now
        model.update(now, t, ids.T)
    return ids.T.astype(np.int64)


_HEAD = struct.Struct("<4sIIIII")
_BLOCK_HEAD = struct.Struct("<II")
_MAGIC = b"MXR3"


def pack_segment(part: int, docs: list[tuple[int, int]], ids: np.ndarray) -> bytes:
    """A segment: header, (doc_id, n_tokens) of the documents that start in it, and its blocks.

    All blocks have one length; the last is filled up with the end id.
    """
    length = min(BLOCK, max(LEAST_BLOCK, -(-len(ids) // LANES)), max(1, len(ids)))
    lanes = -(-len(ids) // length) if len(ids) else 0
    grid = np.full(lanes * length, END_ID, np.uint16)
    grid[: len(ids)] = ids
    blocks = encode_blocks(grid.reshape(lanes, length)) if lanes else []
    table = np.array(docs, "<i8").tobytes()
    out = [_HEAD.pack(_MAGIC, part, len(docs), len(ids), length, lanes), table]
    for block in blocks:
        out += [_BLOCK_HEAD.pack(len(block), zlib.crc32(block)), block]
    return b"".join(out)


def unpack_segments(content: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, documents, ids) of the segments of one file; a block that fails its checksum raises."""
    at = 0
    while at < len(content):
        magic, part, n_docs, n_ids, length, lanes = _HEAD.unpack_from(content, at)
        if magic != _MAGIC:
            raise ValueError(f"no segment at byte {at}")
        at += _HEAD.size
        docs = np.frombuffer(content, "<i8", 2 * n_docs, at).reshape(n_docs, 2)
        at += 16 * n_docs
        blocks = []
        for k in range(lanes):
            size, crc = _BLOCK_HEAD.unpack_from(content, at)
            at += _BLOCK_HEAD.size
            blocks.append(content[at : at + size])
            if zlib.crc32(blocks[-1]) != crc:
                raise ValueError(f"block {k} of part {part} is damaged")
            at += size
        yield part, docs, decode_blocks(blocks, length).ravel()[:n_ids].astype(np.uint16) if lanes else np.zeros(0, np.uint16)
        at += 1  # the line end


@cache
def _kinds() -> np.ndarray:
    """The kind of every code point."""
    kinds = np.zeros(0x110000, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(low, high)))
        for kind, pattern in _KINDS.items():
            for run in regex.finditer(pattern, every):
                kinds[low + run.start() : low + run.end()] = kind
    return kinds


def _word_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which characters begin a word, by the rules of the ByteLevel pre-tokenizer; ``first`` marks those that begin a text.

    A word is a run of one kind with a blank before it if there is one.  White space before a run is a word up to its last
    character, which is the run's blank or a word of its own.  An apostrophe at the start of a word and certain letters behind it are one.
    """
    kinds = _kinds().take(points)
    begin = first.copy()
    change = (kinds[1:] != kinds[:-1]) & ~first[1:]
    begin[1:] |= change & (points[:-1] != _BLANK)
    begin[:-1] |= change & (kinds[:-1] == _SPACE)
    begin[1:] |= change & (kinds[1:] == _SPACE)
    at = np.flatnonzero(begin & (points == _APOSTROPHE))
    if len(at):
        # No letter follows behind the end of a text.
        behind = [np.where(np.append(first, [True] * k)[at + k], 0, np.append(points, [0] * k)[at + k]) for k in (1, 2)]
        behind[1] = np.where(behind[0] == 0, 0, behind[1])
        short = np.isin(behind[0], [*map(ord, _SHORT)])
        long = np.logical_or.reduce([(behind[0] == ord(a)) & (behind[1] == ord(b)) for a, b in _LONG])
        begin[at[short | long] + 1] = False
        ends = np.concatenate([at[short] + 2, at[long] + 3])
        begin[ends[ends < len(begin)]] = True
    return begin


class _WordIds:
    """Ids of texts, the tokenizers library being asked once per distinct word.

    The vocabulary's merges never cross the words of its pre-tokenizer, so the ids of a text are the ids of
    its words in turn; a test compares with whole texts.  Texts that hold an added token are the exception:
    the library looks for those tokens before the words, so it encodes such a text whole.  A word goes to the library's merges
    directly, its bytes as the letters that the vocabulary is written in.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merged = self.tokenizer.model
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.upto, self.size = array("H"), array("q", [0]), 0

    def of_text(self, text: str) -> np.ndarray:
        return self.of_texts(pa.array([text], pa.string()))[0]

    def of_texts(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts without nulls, one after the other, and how many each has."""
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = (bounds - bounds[0]).astype(np.intp)
        if not len(raw):
            return np.zeros(0, np.uint16), np.zeros(len(texts), np.intp)
        points, at, ascii_only = raw, bounds, raw.max() < 128
        if not ascii_only:
            points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
            at = np.append(0, np.cumsum(pc.utf8_length(texts).to_numpy())).astype(np.intp)
        first = np.zeros(len(points) + 1, bool)
        first[at] = True
        begin = _word_starts(points, first[:-1])
        whole = np.logical_or.reduce([pc.match_substring(texts, t).to_numpy(zero_copy_only=False) for t in self.added] or [np.zeros(len(texts), bool)])
        for k in np.flatnonzero(whole):
            begin[at[k] + 1 : at[k + 1]] = False
        if not ascii_only:
            of_points, begin = begin, np.zeros(len(raw), bool)
            begin[raw.view(np.int8) > -65] = of_points  # the bytes that don't go on with a character
        words = np.append(np.flatnonzero(begin), len(raw))
        coded = pa.Array.from_buffers(pa.binary(), len(words) - 1, [None, pa.py_buffer(words.astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
        place = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist()).take(coded.indices.to_numpy())
        ids, upto = np.frombuffer(self.ids, np.uint16), np.frombuffer(self.upto, np.int64)
        begins, sizes = upto.take(place), upto.take(place + 1) - upto.take(place)
        ends = np.append(0, np.cumsum(sizes))
        flat = ids.take(np.repeat(begins - ends[:-1], sizes) + np.arange(ends[-1]))
        return flat, np.diff(ends.take(np.searchsorted(words, bounds)))

    def _places(self, words: list[bytes]) -> np.ndarray:
        """The place of every word among those that are remembered; new ones are encoded."""
        if self.size >= REMEMBERED:
            self._forget()
        places = list(map(self.place.get, words))
        new = [w for w, place in zip(words, places) if place is None]
        # No text has the byte that parts the words here.
        added = [t.encode() for t in self.added]
        for word, letters in zip(new, _LETTERS.take(np.frombuffer(b"\xff".join(new), np.uint8)).tobytes().decode("utf-32-le").split("\xff")):
            if any(t in word for t in added):
                self.ids.extend(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
            else:
                self.ids.extend([t.id for t in self.merged.tokenize(letters)])
            self.place[word] = len(self.place)
            self.upto.append(len(self.ids))
            self.size += 1 + len(word) // 64
        return np.array([self.place[w] for w in words] if new else places, np.intp)


@lru_cache(1)
def _words(tokenizer_json: str) -> _WordIds:
    """The words that a Python process knows; the tasks that it runs share them."""
    return _WordIds(tokenizer_json)


_NULL_ID = -(1 << 63)


def _at_once(texts: pa.StringArray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of TEXT_AT_ONCE bytes together, or a longer one alone."""
    upto = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)))
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(upto, upto[start] + TEXT_AT_ONCE, "right")) - 1)
        yield start, end
        start = end


def _write(tokenizer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words, whole = TaskContext.get().partitionId(), _words(tokenizer.value), BLOCK * LANES
        held, size, docs = [], 0, []

        def segment(ids: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack_segment(part, docs, ids)], pa.binary())], ["segment"])

        for batch in batches:
            doc_ids, texts = batch.column(0).fill_null(_NULL_ID).to_pylist(), batch.column(1).cast(pa.string()).fill_null("")
            for start, end in _at_once(texts):
                ids, sizes = words.of_texts(texts[start:end])
                ids, sizes = np.insert(ids, np.cumsum(sizes), END_ID), sizes + 1
                for doc_id, n, upto in zip(doc_ids[start:end], sizes.tolist(), np.cumsum(sizes).tolist()):
                    held.append(ids[upto - n : upto])
                    docs.append((doc_id, n))
                    size += n
                    if size >= whole:
                        together, size = np.concatenate(held), size % whole
                        for at in range(0, len(together) - size, whole):
                            yield segment(together[at : at + whole])
                            docs = []
                        held = [together[len(together) - size :]]
        if size or docs:
            yield segment(np.concatenate(held))

    return run


def write_ids(docs: DataFrame, path: str, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of ``docs`` under ``path``, in ascending order of doc_id over the numbered files.

    Null texts count as empty; each document ends with ``END_ID``.  Null ids come first.  Rows repeated
    under one id follow each other, by hash of their texts and then by text, so that reruns agree.  Partitions
    are ranges of id and hash: an id that many different texts share is split, too.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        tokenizer = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    ordered = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
    ordered.select("doc_id", "text").mapInArrow(_write(tokenizer), "segment binary").select(F.col("segment").cast("string").alias("value")).write.text(path)


_READ = "part int, number int, doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in _READ.split(", ")]
    for batch in batches:
        for content in batch.column("content"):
            open_docs: deque[tuple[int, int]] = deque()
            rest, done, start, rows, part = np.zeros(0, np.uint16), 0, 0, [], 0
            for part, docs, ids in unpack_segments(content.as_py()):
                open_docs += map(tuple, docs.tolist())
                ids, at = np.concatenate((rest, ids)), 0
                while open_docs and at + open_docs[0][1] <= len(ids):
                    doc_id, n = open_docs.popleft()
                    rows.append((part, done, None if doc_id == _NULL_ID else doc_id, start, n, zlib.crc32(ids[at : at + n].astype("<u4").tobytes())))
                    at, done, start = at + n, done + 1, start + n
                rest = ids[at:]
            if open_docs or len(rest):
                raise ValueError(f"part {part} ends within a document")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files under ``path``."""
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path).where("length > 0").select("content")
    rows = saved(files.mapInArrow(_read, _READ), "coder-read")
    # One row per file: the ids in all files before it.
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(before, F.col("part") == F.col("of")).select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def stored_documents(docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of ``docs`` in the shared folder and return what reading the files back gives."""
    path = new_path(docs.sparkSession, "ids")
    write_ids(docs, path, tokenizer_file, doc_id, text)
    return read_documents(docs.sparkSession, path)
