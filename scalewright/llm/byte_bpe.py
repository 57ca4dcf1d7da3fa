"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

1. Spark cuts all texts into words by the vocabulary's pattern and counts the distinct ones.
2. The ranked merges of the frequent distinct words are folded over their byte pieces by Spark's higher-order
   functions, with the ranks as a literal map (``merged_in_sql``).  That table has at most ``FREQUENT`` words, so
   it is broadcast.
3. Texts become ids batch by batch: the distinct words of a batch are looked up in that table, and a rarer word is
   folded where it occurs, in the task (``merge_word``).  The README says why those aren't folded by 2 and joined.
4. Decoding concatenates the binary pieces of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import saved, small_batches

#: Words of the broadcast table at most, and the longest of them.
FREQUENT, LONGEST_FREQUENT = 1 << 17, 64
#: Rare words that a task remembers; a full memory is emptied, which costs time but changes no result.
REMEMBERED = 1 << 16
#: Texts that are turned into ids at once.
TEXTS = 512


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines ``base64 rank``; read by the driver, some 50,000 entries."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of lowest rank is merged until no pair has a rank; the first wins ties."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 256:
        return _merge_long(parts, ranks)
    none = len(ranks) + 1
    pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs:
        best = min(pairs)
        if best == none:
            break
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same fold with a heap and linked neighbours: n log n for words of any length."""
    from heapq import heapify, heappop, heappush

    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapify(heap)
    alive: list[bytes | None] = list(parts)
    while heap:
        _, i, joined = heappop(heap)
        j = after[i] if alive[i] is not None else n
        if j >= n or alive[i] + alive[j] != joined or len(alive[i]) + len(alive[j]) != len(joined):
            continue
        alive[i], alive[j] = joined, None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := ranks.get(alive[a] + alive[b])) is not None:
                heappush(heap, (r, a, alive[a] + alive[b]))
    return [ranks[p] for p in alive if p is not None]


def java_pattern(pattern: str) -> str:
    """The pattern for Spark, whose white space has to be asked for by its Unicode property."""
    return pattern.replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")


def split_texts(docs: DataFrame, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, words, odd): the words of each text in order; null counts as empty.

    ``odd`` is a text with code points that Spark's Java doesn't know yet, whose classes it can't tell; such
    a text has no words here and is cut by the task.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    odd = body.rlike("\\p{Cn}")
    words = F.regexp_extract_all(body, F.lit(java_pattern(pattern)), F.lit(0))
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("key"), F.when(~odd, words).alias("words"), F.when(odd, body).alias("odd"))


def frequent_words(split: DataFrame) -> DataFrame:
    """(word) of the most frequent distinct words of all texts, at most ``FREQUENT``.

    Counts are put in classes, eight for each doubling, and the classes with the largest counts that together
    fit are taken, so nothing is sorted.
    """
    words = split.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = saved(words.where(F.char_length("word") <= LONGEST_FREQUENT).withColumn("class", F.floor(F.log2("n") * 8).cast("int")), "bpe-words")
    total, least = 0, None
    for r in sorted(words.groupBy("class").count().collect(), key=lambda r: -r["class"]):  # a few hundred classes
        total += r["count"]
        if total > FREQUENT:
            break
        least = r["class"]
    return words.where(F.col("class") >= least if least is not None else F.lit(False)).select("word")


class WordIds(dict):
    """word -> ids as bytes of little-endian unsigned 32-bit integers; folds the merges of words it hasn't."""

    def __init__(self, ranks: dict[bytes, int], frequent: dict[str, bytes], pattern: str):
        super().__init__()
        self.ranks, self.frequent, self.find = ranks, frequent, regex.compile(pattern)

    def __missing__(self, word: str) -> bytes:
        known = self.frequent.get(word)
        if known is not None:
            return known
        ids = array("I", merge_word(word.encode(), self.ranks)).tobytes()
        if len(word) <= LONGEST_FREQUENT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def of_texts(self, words: pa.ListArray, odd: pa.Array) -> list[bytes]:
        """Ids of the texts of a batch; every distinct word is looked up once."""
        coded = words.flatten().dictionary_encode()
        found = [self[w] for w in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        table, starts, codes = np.frombuffer(b"".join(found), np.uint32), np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        times = sizes[codes]
        ends = np.concatenate(([0], np.cumsum(times)))
        ids = table[np.repeat(starts[codes] - ends[:-1], times) + np.arange(ends[-1])]
        stops = ends[np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
        out = [ids[a:b].tobytes() for a, b in zip([0, *stops], stops)]
        for i in np.flatnonzero(odd.is_valid().to_numpy(zero_copy_only=False)):
            out[i] = b"".join([self[w] for w in self.find.findall(odd[int(i)].as_py())])
        return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def _shared(split: DataFrame, vocabulary: str):
    """Broadcast ranks and ids of frequent words; both are of bounded size."""
    ranks = load_ranks(vocabulary)
    context = split.sparkSession.sparkContext
    folded = merged_in_sql(frequent_words(split), ranks).toArrow()
    ids = (array("I", x.as_py()).tobytes() for x in folded.column("ids"))
    return context.broadcast(ranks), context.broadcast(dict(zip(folded.column("word").to_pylist(), ids)))


def encoded(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): ids of the whole text as little-endian unsigned 32-bit integers.

    Null counts as empty, and an empty text has no ids.  Repeated rows are encoded each.  Texts are never shuffled.
    """
    split = split_texts(docs, pattern, doc_id, text)
    ranks, frequent = _shared(split, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(ranks.value, frequent.value, pattern)
        for part in _parts(batches):
            ids = words.of_texts(part.column("words"), part.column("odd"))
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(ids, pa.binary())], ["key", "ids"])

    return split.mapInArrow(run, "key long, ids binary").withColumnRenamed("key", "doc_id")


def _pieces(ranks: dict[bytes, int]) -> list[bytes]:
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pieces


def decoded_bytes(ids: bytes, pieces: list[bytes]) -> bytes:
    return b"".join([pieces[i] for i in array("I", ids)])


def decoded(ids: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of a table (doc_id, ids)."""
    ranks = ids.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(ranks.value)
        for part in _parts(batches):
            texts = [decoded_bytes(raw.as_py(), pieces).decode() for raw in part.column("ids")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 per row: every text is encoded, its ids decoded again.

    Null counts as empty; repeated rows are encoded each.  A batch of texts goes both ways in one task, since
    ids of the whole corpus would be as large as its texts; what is written are the digests.
    """
    split = split_texts(docs, pattern, doc_id, text)
    ranks, frequent = _shared(split, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pieces = WordIds(ranks.value, frequent.value, pattern), _pieces(ranks.value)
        for part in _parts(batches):
            ids = words.of_texts(part.column("words"), part.column("odd"))
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            shas = [pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(decoded_bytes(x, pieces)).hexdigest() for x in ids])]
            yield pa.RecordBatch.from_arrays([part.column("key"), n, *shas], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    with small_batches(docs.sparkSession, TEXTS):
        return saved(split.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"), "bpe-digests")


#: Parts of the literal rank map of ``merged_in_sql``: a look-up scans one part of a few entries.
MAP_PARTS = 4096


def rank_literal(ranks: dict[bytes, int], parts: int = MAP_PARTS) -> Column:
    """The ranks as one foldable literal: an array of maps from hex pieces, parted by crc32."""
    maps: list[dict[str, int]] = [{} for _ in range(parts)]
    for token, rank in ranks.items():
        key = token.hex().upper()
        maps[zlib.crc32(key.encode()) % parts][key] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def _folded(ranks: Column, hex_text: Column, parts: int) -> Column:
    """Ids of a word in hex digits: the adjacent pieces of lowest rank are joined until no pair has a rank."""
    none = F.lit(2147483647)

    def rank(piece: Column) -> Column:
        return ranks[(F.crc32(piece.cast("binary")) % parts).cast("int")][piece]

    def joined(acc: Column) -> Column:
        pairs = F.zip_with(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.slice(acc, 2, F.greatest(F.size(acc) - 1, F.lit(0))), lambda x, y: F.concat(x, y))
        # transform over one element names a value that is used more than once.
        return F.transform(F.array(F.transform(pairs, lambda k: F.coalesce(rank(k), none))), lambda r: F.when(F.coalesce(F.array_min(r), none) == none, acc).otherwise(
            F.transform(F.array(F.array_position(r, F.array_min(r)).cast("int")), lambda p: F.concat(F.slice(acc, 1, p - 1), F.array(F.concat(acc[p - 1], acc[p])), F.slice(acc, p + 2, F.size(acc))))[0]
        ))[0]

    nothing = F.array().cast("array<string>")
    pieces = F.when(F.length(hex_text) == 0, nothing).otherwise(F.transform(F.sequence(F.lit(1), F.length(hex_text), F.lit(2)), lambda i: F.substr(hex_text, i, F.lit(2))))
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(hex_text), F.lit(1))), pieces, lambda acc, _: joined(acc))
    return F.transform(folded, rank)


def merged_in_sql(words: DataFrame, ranks: dict[bytes, int], parts: int = MAP_PARTS) -> DataFrame:
    """(word, ids) of a table of distinct words: the fold in Spark's higher-order functions alone.

    The literal map occurs once in the plan, bound to a lambda's variable.
    """
    hexed = words.select("word", F.hex(F.encode("word", "UTF-8")).alias("hex"))
    return hexed.select("word", F.transform(F.array(rank_literal(ranks, parts)), lambda r: _folded(r, F.col("hex"), parts))[0].alias("ids"))
