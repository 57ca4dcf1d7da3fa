"""Phrase collocations counted in counting quotient filters.

1. Words are counted per language.  Those that occur often enough get whole numbers as ids, most frequent ones first; the
   ids of a phrase are packed into one number.  A phrase can't be more frequent than its parts, so words that are too
   rare, and phrases of three words with a pair that is too rare, needn't be counted.
2. Each task permutes the packed phrases, invertibly, and keeps them in counting quotient filters: the upper bits, the
   quotient, say where a phrase belongs, and only the remainder and a count are stored.  The remainder is full, so no
   two phrases are ever confused.
3. The filters of one range of quotients are merged in sorted order, counts added, and the permutation is undone.

Ids of up to MOST_WORDS words are broadcast.  Phrases with a word beyond those are counted as text, exactly.  What
tells too rare pairs is a bitmap of bounded size, and lets others through that the counts then drop.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import saved, small_batches

LEAST, TOP, SHARE = 10, 2000, 50
#: Bits of a word's id, and the most words that have one.
ID_BITS = 20
MOST_WORDS = (1 << ID_BITS) - 1
#: Bytes of text that are cut into words at once, distinct words and phrases that a task holds before it hands them on.
SLICE_BYTES, HELD_WORDS, HELD_PHRASES = 1 << 20, 1 << 18, 1 << 21
#: Texts that a task gets at once, and parts in which the best phrases of a language are found first.
TEXTS, PARTS = 256, 16
#: Phrases of a merged range on average, and the most bits of a range's number.
RANGE_PHRASES, MOST_RANGE_BITS = 1 << 20, 16
#: Positions of a bitmap per key, and at most (32 MB).
POSITIONS_PER_KEY, MOST_POSITIONS = 16, 1 << 28

#: Bytes that end a piece become a full stop, A to Z lower case; bytes of other characters are above 127.
_TABLE = bytes(ord(".") if c in b".,;:!?\x0a\x0b\x0c\x0d" else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Odd factors of the permutation.
FACTORS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def permuted(keys: np.ndarray, bits: int) -> np.ndarray:
    """A one-to-one map of numbers below 2 ** bits."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    with np.errstate(over="ignore"):
        keys = (keys.astype(np.uint64) * np.uint64(FACTORS[0])) & mask
        keys ^= keys >> half
        return (keys * np.uint64(FACTORS[1])) & mask


def restored(keys: np.ndarray, bits: int) -> np.ndarray:
    """The inverse of ``permuted``."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    back = [np.uint64(pow(f, -1, 1 << bits)) for f in FACTORS]
    with np.errstate(over="ignore"):
        keys = (keys.astype(np.uint64) * back[1]) & mask
        keys ^= keys >> half
        return (keys * back[0]) & mask


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, counts added up)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    total = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first) if len(keys) else counts
    return keys[first], total.astype(np.uint64)


def _narrow(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width if width else 0, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


def packed_filter(keys: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A counting quotient filter of distinct sorted keys below 2 ** bits.

    It holds the number of keys, the length of every quotient's run, the remainders in as few bytes as they need, and
    counts in a byte each, those above 254 apart.
    """
    q = min(bits, max(0, int(len(keys)).bit_length() - 1))
    rest = bits - q
    runs = np.bincount((keys >> np.uint64(rest)).astype(np.int64), minlength=1 << q)
    width = max(1, (int(runs.max()).bit_length() + 7) // 8)
    large = counts > 254
    head = np.array([len(keys), q, width, int(large.sum())], "<u4").tobytes()
    remainders = _narrow(keys & np.uint64((1 << rest) - 1), -(-rest // 8)) if rest else b""
    return head + _narrow(runs, width) + remainders + np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<u8").tobytes()


def opened_filter(data: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, counts) of ``packed_filter``."""
    n, q, width, n_large = (int(v) for v in np.frombuffer(data[:16], "<u4"))
    rest, at = bits - q, 16
    runs = _wide(data[at : (at := at + width * (1 << q))], width)
    size = -(-rest // 8)
    keys = np.repeat(np.arange(1 << q, dtype=np.uint64), runs.astype(np.int64)) << np.uint64(rest)
    if rest:
        keys |= _wide(data[at : (at := at + n * size)], size)
    counts = np.frombuffer(data[at : (at := at + n)], np.uint8).astype(np.uint64)
    counts[counts == 255] = np.frombuffer(data[at : at + 8 * n_large], "<u8")
    return keys, counts


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bool, list[bytes]]]:
    """(language, whether this goes on where the last slice ended, words and full stops between pieces)."""
    for batch in batches:
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            texts.setdefault(lang, []).append(text)
        for lang, held in texts.items():
            whole = b".".join(held).translate(_TABLE).replace(b".", b" . ")
            at = 0
            while at < len(whole):
                end = whole.find(b" ", at + SLICE_BYTES)
                end = len(whole) if end < 0 else end
                yield lang, at > 0, whole[at:end].split()
                at = end


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word, n) of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for one, found in held.items():
                found.pop(b".", None)
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(found), pa.string()), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])
            held.clear()

        for one, _, words in _tokens(batches):
            held.setdefault(one, Counter()).update(words)
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from out()
        yield from out()

    return _texts(docs, text, lang).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Ids of the most frequent words, from 1 on, and which words beyond them may be frequent enough too."""

    def __init__(self, langs: list[str], words: list[str], rest: np.ndarray | None):
        self.langs, self.words, self.rest = langs, words, rest

    def ids(self) -> dict[str, dict[bytes, int]]:
        out: dict[str, dict[bytes, int]] = {}
        for k, (lang, word) in enumerate(zip(self.langs, self.words), 1):
            out.setdefault(lang, {})[word.encode()] = k
        return out


def bitmap(keys: DataFrame, key: Column, n: int) -> np.ndarray:
    """Bits at the hash positions of whole numbers ``key``: their lower bits."""
    positions = 1 << 15
    while positions < min(MOST_POSITIONS, POSITIONS_PER_KEY * n):
        positions *= 2
    at = keys.select((F.pmod(key, F.lit(positions)) + 1).alias("at"))
    out = np.zeros(positions // 8, np.uint8)
    # At most MOST_POSITIONS / 32,768 rows of 4 KB.
    for r in at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect():
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def among(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def vocabulary(words: DataFrame, most: int = MOST_WORDS) -> Vocabulary:
    """Of a written table (lang, word, n): the ``most`` most frequent words."""
    known = words.orderBy(F.col("n").desc(), "lang", "word").limit(most).select("lang", "word").toArrow()
    n = words.limit(most + 1).count() if known.num_rows == most else known.num_rows
    rest = bitmap(words, F.xxhash64("word"), words.count()) if n > most else None
    return Vocabulary(known["lang"].to_pylist(), known["word"].to_pylist(), rest)


def _streams(batches: Iterator[pa.RecordBatch], vocab: Vocabulary, order: int) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """(language, ids, words) of slices: 0 ends a piece or is a rare word, -1 a word that has no id but may be frequent."""
    ids = vocab.ids()
    tail: tuple[np.ndarray, list[bytes]] = (np.zeros(0, np.int64), [])
    for lang, goes_on, words in _tokens(batches):
        known = ids.get(lang, {})
        found = np.fromiter(map(known.get, words, repeat(0)), np.int64, len(words))
        if vocab.rest is not None:
            open_words = [k for k in np.flatnonzero(found == 0) if words[k] != b"."]
            hashes = np.array([xxhash.xxh64_intdigest(words[k], 42) for k in open_words], np.uint64)
            found[np.array(open_words, np.int64)[among(vocab.rest, hashes)]] = -1
        if goes_on:
            found, words = np.concatenate([tail[0], found]), tail[1] + words
        tail = (found[1 - order :], words[1 - order :])
        yield lang, found, words


def phrase_filters(texts: DataFrame, vocab, order: int, range_bits: int, pairs=None) -> DataFrame:
    """(quotient_range, filter): the phrases of ``order`` words with ids, a filter per task and range.

    Of three words both pairs must be in the bitmap ``pairs``.
    """
    bits = order * ID_BITS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = counted(np.concatenate(held))
            held.clear()
            cuts = np.searchsorted(keys, np.arange(1, 1 << range_bits, dtype=np.uint64) << np.uint64(bits - range_bits))
            cuts = [0, *cuts.tolist(), len(keys)]
            full = [r for r in range(1 << range_bits) if cuts[r + 1] > cuts[r]]
            mask = np.uint64((1 << (bits - range_bits)) - 1)
            data = [packed_filter(keys[cuts[r] : cuts[r + 1]] & mask, counts[cuts[r] : cuts[r + 1]], bits - range_bits) for r in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(data, pa.binary())], ["quotient_range", "filter"])

        for _, ids, _ in _streams(batches, vocab.value, order):
            parts = [ids[k : len(ids) - order + 1 + k] for k in range(order)]
            good = np.logical_and.reduce([p > 0 for p in parts])
            if order == 3:
                ok = np.zeros(max(len(ids) - 1, 0), bool)
                both = (ids[:-1] > 0) & (ids[1:] > 0)
                ok[both] = among(pairs.value, permuted((ids[:-1][both] << ID_BITS) | ids[1:][both], 2 * ID_BITS))
                good &= ok[:-1] & ok[1:]
            key = np.zeros(int(good.sum()), np.int64)
            for p in parts:
                key = (key << ID_BITS) | p[good]
            held.append(permuted(key, bits))
            n += len(key)
            if n >= HELD_PHRASES:
                yield from out()
                n = 0
        if n:
            yield from out()

    return texts.mapInArrow(build, "quotient_range int, filter binary")


def merged_phrases(filters: DataFrame, vocab, order: int, range_bits: int, least: int) -> DataFrame:
    """(key, lang, words, a) of the phrases that all filters together count ``least`` times; ``key`` is the permuted number."""
    bits = order * ID_BITS

    def decoded(r: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        often = counts >= least
        keys = keys[often] | (np.uint64(r) << np.uint64(bits - range_bits))
        plain = restored(keys, bits)
        ids = [((plain >> np.uint64(k * ID_BITS)) & np.uint64(MOST_WORDS)).astype(np.int64) - 1 for k in reversed(range(order))]
        v = vocab.value
        words = [[v.words[k] for k in one] for one in zip(*(i.tolist() for i in ids))]
        langs = [v.langs[k] for k in ids[0].tolist()]
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(langs, pa.string()), pa.array(words, pa.list_(pa.string())), pa.array(counts[often].astype(np.int64))], ["key", "lang", "words", "a"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def added() -> tuple[np.ndarray, np.ndarray]:
            return counted(np.concatenate([keys, *(k for k, _ in waiting)]), np.concatenate([counts, *(c for _, c in waiting)]))

        for batch in batches:
            for r, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if r != now:
                    if now is not None:
                        yield decoded(now, *added())
                    now, keys, counts, waiting = r, np.zeros(0, np.uint64), np.zeros(0, np.uint64), []
                waiting.append(opened_filter(data.as_py(), bits - range_bits))
                if sum(len(k) for k, _ in waiting) > HELD_PHRASES:
                    keys, counts = added()
                    waiting = []
        if now is not None:
            yield decoded(now, *added())

    # A task holds the distinct phrases of one range at a time.
    sorted_filters = filters.repartition(1 << min(range_bits, 12), "quotient_range").sortWithinPartitions("quotient_range")
    return sorted_filters.mapInArrow(merge, "key long, lang string, words array<string>, a long")


def phrases_as_text(texts: DataFrame, vocab, order: int, least: int) -> DataFrame:
    """(key, lang, words, a) of frequent phrases with a word beyond the ids; ``key`` is null."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, words in _streams(batches, vocab.value, order):
            parts = np.stack([ids[k : len(ids) - order + 1 + k] for k in range(order)])
            at = np.flatnonzero((parts != 0).all(0) & (parts < 0).any(0))
            found = Counter(tuple(words[k : k + order]) for k in at.tolist())
            rows = [[w.decode() for w in p] for p in found]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array(rows, pa.list_(pa.string())), pa.array(list(found.values()), pa.int64())], ["lang", "words", "a"])

    rows = texts.mapInArrow(find, "lang string, words array<string>, a long")
    return rows.groupBy("lang", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least).select(F.lit(None).cast("long").alias("key"), "lang", "words", "a")


def frequent_phrases(docs: DataFrame, words: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Written tables (key, lang, words, a) of the phrases of two and of three words; ``words`` is that of frequent ones."""
    spark = docs.sparkSession
    texts = _texts(docs, text, lang)
    found = vocabulary(words, most_words)
    vocab = spark.sparkContext.broadcast(found)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    range_bits = min(MOST_RANGE_BITS, max(4, math.ceil(math.log2(max(1, total / RANGE_PHRASES)))))
    tables: list[DataFrame] = []
    pairs = None
    for order in (2, 3):
        rows = merged_phrases(phrase_filters(texts, vocab, order, range_bits, pairs), vocab, order, range_bits, least)
        if found.rest is not None:
            rows = rows.unionByName(phrases_as_text(texts, vocab, order, least))
        tables.append(saved(rows, f"phrases-{order}"))
        if order == 2:
            keyed = tables[0].where("key is not null")
            pairs = spark.sparkContext.broadcast(bitmap(keyed, F.col("key"), keyed.count()))
    return tables[0], tables[1]


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)); decimals hold the products."""
    a, left, right = (f"cast({c} as decimal(19,0))" for c in (a, left, right))
    return F.expr(f"cast((cast(1000000 * ({a} * {a}) as decimal(38,0)) div cast({left} * {right} as decimal(38,0))) as long)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, most_words: int = MOST_WORDS, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of two or three words per language.

    A null text is empty, a null language is ``und``.  Repeated rows count each time.  Ties of the score go by ``a``, then by
    the phrase.  Texts are cut a slice at a time, however long they are.  An empty table, or one without frequent
    phrases, gives no rows.  Other columns are ignored.
    """
    with small_batches(docs.sparkSession, TEXTS):
        counts = saved(word_counts(docs, text, lang), "phrase-words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    words = saved(counts.where(F.col("n") >= least), "frequent-words")
    with small_batches(docs.sparkSession, TEXTS):
        two, three = frequent_phrases(docs, words, least, most_words, text, lang)
    part = lambda df, name, *key: df.select("lang", *key, F.col("a").alias(name))
    one = words.select("lang", F.col("word").alias("w"), F.col("n").alias("a"))
    two = two.select("lang", F.col("words")[0].alias("w1"), F.col("words")[1].alias("w2"), "a")
    three = three.select("lang", *[F.col("words")[k].alias(f"w{k + 1}") for k in range(3)], "a")

    def with_word(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.join(one.select("lang", F.col("w").alias(column), F.col("a").alias(name)), ["lang", column])

    pairs = with_word(with_word(two, "w1", "l"), "w2", "r")
    longer = part(three, "longer", "w1", "w2").unionByName(three.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("a").alias("longer")))
    longer = longer.groupBy("lang", "w1", "w2").agg(F.max("longer").alias("longer"))
    pairs = pairs.join(longer, ["lang", "w1", "w2"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score("a", "l", "r").alias("score"))

    triples = with_word(with_word(three, "w1", "l1"), "w3", "r2")
    triples = triples.join(part(two, "l2", "w1", "w2"), ["lang", "w1", "w2"])
    triples = triples.join(two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1")), ["lang", "w2", "w3"])
    triples = triples.withColumns({"s1": _score("a", "l1", "r1"), "s2": _score("a", "l2", "r2")})
    first = F.col("s1") <= F.col("s2")
    pick = lambda name: F.when(first, F.col(f"{name}1")).otherwise(F.col(f"{name}2"))
    triples = triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", pick("l").alias("l"), pick("r").alias("r"), pick("s").alias("score"))

    # The first ones of a language are among the first ones of its parts, so no task gets more than PARTS x ``top`` rows of it.
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")).cast("long")
    best = pairs.unionByName(triples).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    best = best.withColumn("rank", rank("lang", "part")).where(F.col("rank") <= top).repartition("lang")
    best = best.withColumn("rank", rank("lang")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
