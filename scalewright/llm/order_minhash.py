"""Near-duplicate detection by Order MinHash, candidates verified by banded alignment.

* A text is its words.  Its k-mers are ``K`` consecutive words, labelled with their occurrence (the second
  equal k-mer of a text differs from the first).
* A sketch samples the ``SAMPLED`` labelled k-mers that are smallest under one hash function and keeps them
  in text order.  Texts of high edit similarity agree on a sketch with high probability; texts that only
  share words in another order don't.  ``SKETCHES`` hash functions give as many sketches.
* Texts of up to ``SHORT`` words have few k-mers and get sketches of ``SAMPLED_SHORT`` k-mers.  Texts of up to
  ``DELETED`` words get no sketches for each other but the hashes of all that deleting as many words as the
  similarity allows can leave: two texts within that distance always have one in common.  Texts near a limit get
  what both sides get, so no pair of the two sides is lost.
* Texts that agree on a sketch share a bucket.  Every member is compared with one member of the bucket, its
  centre, so a bucket of any size costs one comparison per member.  Linked texts form classes.
* Where a bucket still holds more than one class, ``TURNS`` further centres, drawn by hash, are compared with
  the members of other classes.  That joins what one centre missed at one comparison per member.
* In buckets that are mixed even then, all pairs of different classes are compared, in blocks of at most
  ``BLOCK`` x ``BLOCK`` members, behind two exact bounds: on length, and on the difference of hashed
  word counts in twice as many bins as words, which the edit distance can't be less than.  So no class is left apart, and no cap drops a pair.
* A candidate is a link if the edit similarity of its words, 1 - distance / longer length, is at least
  ``SIMILARITY``, found by bit-parallel alignment within the band of diagonals that it allows.

Exact copies are collapsed to one representative first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .membership import rows_but, rows_in
from .store import ROWS_PER_FILE, saved, small_batches

K = 2
SAMPLED, SAMPLED_SHORT = 3, 2
SKETCHES = 48
#: Words of the longest text with sketches of fewer k-mers, and of the longest whose deletions are listed.
SHORT, DELETED = 64, 14
SIMILARITY = 0.8
BLOCK = 256
#: Rounds of further centres.
TURNS = 2
#: Least and most bins of the hashed word counts; between them a text has two a word, rounded up to a power of two.
BINS, MOST_BINS = 512, 1 << 16
#: Word hashes remembered by a task; a full memory is emptied.
REMEMBERED = 1 << 18
#: Texts and pairs of texts that a Python task holds at once.
TEXTS, PAIRS = 2048, 512

_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MOST = np.uint64(2**64 - 1)
_SEEDS = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _M)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def allowed(n: int) -> int:
    """Most edits of a pair whose longer text has ``n`` words."""
    return int(n * (1 - SIMILARITY) + 1e-9)


def labelled_kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers of a text, in order, each with its occurrence; a text of fewer words is one k-mer.

    A first occurrence has the plain hash, whether or not the text repeats another k-mer.
    """
    n = max(1, len(words) - k + 1)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, len(words))):
        h = _mix(h * _M + words[j : j + n] + np.uint64(j + 1))
    order = np.argsort(h, kind="stable")
    s = h[order]
    start = np.concatenate(([True], s[1:] != s[:-1]))
    if start.all():
        return h
    first = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    label = np.empty(n, dtype=np.uint64)
    label[order] = (np.arange(n) - first).astype(np.uint64)
    return np.where(label > 0, _mix(h + label * _M), h)


def sketches(kmers: np.ndarray, sampled: int = SAMPLED) -> np.ndarray:
    """One 64-bit value per sketch: the sampled k-mers in text order."""
    n = len(kmers)
    out = np.zeros(len(_SEEDS), dtype=np.uint64)
    step = max(1, (1 << 21) // n)  # bounds the matrix for very long texts
    for a in range(0, len(_SEEDS), step):
        seeds = _SEEDS[a : a + step, None]
        values = (kmers[None, :] ^ seeds) * _M
        values ^= values >> np.uint64(29)
        m = min(sampled, n)
        if n > m:
            # The smallest one after the other: a few scans are cheaper than a partition of each row.
            at, row = np.empty((len(values), m), np.int64), np.arange(len(values))
            for j in range(m):
                at[:, j] = values.argmin(axis=1)
                values[row, at[:, j]] = _MOST
            at = np.sort(at, axis=1)
        else:
            at = np.broadcast_to(np.arange(n), values.shape)
        h = seeds[:, 0]
        for j in range(m):
            h = _mix(h * _M + kmers[at[:, j]])
        out[a : a + step] = h
    return out


def deletions(words: np.ndarray) -> list[int]:
    """Hashes of what is left after deleting at most ``allowed`` words, each once."""
    left = found = {tuple(words.tolist())}
    for _ in range(allowed(len(words))):
        left = {x[:i] + x[i + 1 :] for x in left for i in range(len(x))}
        found = found | left
    return [xxhash.xxh3_64_intdigest(np.array(x, np.uint64).tobytes()) for x in found]


def keys(words: np.ndarray) -> np.ndarray:
    """All buckets of a text.  The shorter text of a pair with more than n words has n + 1 - allowed(n + 1) at least."""
    n, out = len(words), []
    if 4 <= n <= DELETED:
        out.append(np.array(deletions(words), np.uint64))
    kmers = labelled_kmers(words)
    for sampled, least, most in ((SAMPLED_SHORT, DELETED, SHORT), (SAMPLED, SHORT, n)):
        if least + 1 - allowed(least + 1) <= n <= most:
            out.append(sketches(kmers, sampled))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def bin_bits(n_words: int) -> int:
    return min(max(BINS, 2 * n_words) - 1, MOST_BINS - 1).bit_length()


def word_counts(words: np.ndarray) -> np.ndarray:
    """Counts of hashed words in the smallest type that holds them; cut counts would be no bound once folded.

    Bins follow the length, since a fixed number of them fills up in long texts and then tells nothing.
    """
    bits = bin_bits(len(words))
    counts = np.bincount((words >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.min_scalar_type(int(counts.max())))


def stored_counts(raw: bytes, n_words: int) -> np.ndarray:
    """The counts of a text of ``n_words`` from their bytes, one row."""
    return np.frombuffer(raw, f"u{len(raw) >> bin_bits(n_words)}")[None, :]


def folded(counts: np.ndarray, bins: int) -> np.ndarray:
    """Rows of counts in fewer bins; sums of bins keep differences a lower bound."""
    return counts.reshape(len(counts), bins, -1).sum(2, dtype=np.int32)


def least_distances(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Lower bounds of the edit distances of one text and others, from rows of counts (1 row, many rows)."""
    bins = min(one.shape[1], others.shape[1])
    more = folded(others, bins) - folded(one, bins)
    return np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))


def edit_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else ``most + 1``.

    The bit vectors hold only the 2 * most + 1 diagonals that an alignment of at most ``most`` edits can
    touch (Hyyro's banded form of Myers' algorithm), in Python integers of any width.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m, asked = len(a), len(b), most
    if n - m > most:
        return asked + 1
    most = min(most, n)
    if most == 0:
        return 0 if a == b else 1
    # The window of column i holds a[i - most] to a[i + most], the lowest bit first.
    full = (1 << (2 * most + 1)) - 1
    positions: dict = {}
    for i, x in enumerate(a):
        positions[x] = positions.get(x, 0) | (1 << (i + most))
    vp, vn = (full >> most) << most, 0
    # The score follows the diagonal most below the main one until a ends there, then the last row.
    score, top, row, last = most, 1 << (2 * most), 1 << (2 * most - 1), n - most
    hopeless = most + m - last
    for i in range(m):
        x = (positions.get(b[i], 0) >> i) & full
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if i < last:
            score += not d0 & top
        else:
            score += bool(hp & row) - bool(hn & row)
            row >>= 1
        if score > hopeless:
            return asked + 1
        vp = (hn | ~((d0 >> 1) | hp)) & full
        vn = (d0 >> 1) & hp
    return score if score <= most else asked + 1


#: Band of the alignments that run side by side: its diagonals fit a 64-bit word.
NARROW = 31


def narrow_distances(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Edit distances of many pairs at once, exact up to ``NARROW`` and larger than it otherwise.

    The same recurrence as ``edit_distance``, one pair a lane.  The first of a pair must be the longer one
    and have at least ``NARROW`` elements.
    """
    lanes, w = len(pairs), 2 * NARROW + 1
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    a = np.zeros((lanes, NARROW + max(int(n.max()), int(m.max())) + w), np.uint64)
    b = np.zeros((lanes, int(m.max())), np.uint64)
    for i, (x, y) in enumerate(pairs):
        a[i, NARROW : NARROW + len(x)] = x | np.uint64(1)
        b[i, : len(y)] = y | np.uint64(1)
    one = np.uint64(1)
    full = np.uint64((1 << w) - 1)
    vp, vn = np.full(lanes, (int(full) >> NARROW) << NARROW, np.uint64), np.zeros(lanes, np.uint64)
    score, last = np.full(lanes, NARROW), n - NARROW
    top, hopeless = np.uint64(2 * NARROW), NARROW + m - last
    bits = np.zeros((lanes, 64), bool)
    live = np.arange(lanes)
    result = np.full(lanes, NARROW + 1)
    for i in range(int(m.max())):
        np.equal(a[:, i : i + w], b[:, i : i + 1], out=bits[:, :w])
        x = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        row = np.clip(2 * NARROW - 1 - (i - last), 0, 63).astype(np.uint64)
        along = ((hp >> row) & one).astype(np.int64) - ((hn >> row) & one).astype(np.int64)
        score = score + np.where(i < last, 1 - ((d0 >> top) & one).astype(np.int64), along)
        down = d0 >> one
        vp, vn = (hn | ~(down | hp)) & full, down & hp
        ended = (m == i + 1) | (score > hopeless)
        if ended.any():
            done = ended & (m == i + 1)
            result[live[done]] = np.minimum(score[done], NARROW + 1)
            keep = ~ended
            live, a, b, n, m, vp, vn, score, last, hopeless, bits = (v[keep] for v in (live, a, b, n, m, vp, vn, score, last, hopeless, bits))
            if not len(live):
                break
    return result


def similarity_at_least(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY, band: int = 8) -> float | None:
    """1 - distance / longer length if that is ``least`` or more.  Narrow bands are tried first."""
    longer = max(len(a), len(b))
    most = int(longer * (1 - least) + 1e-9)
    a, b = a.tolist(), b.tolist()
    while True:
        band = min(band, most)
        d = edit_distance(a, b, band)
        if d <= band:
            return 1 - d / longer
        if band == most:
            return None
        band *= 4


def similarities(pairs: list[tuple[np.ndarray, np.ndarray]], least: float = SIMILARITY) -> list[float | None]:
    """Edit similarity of pairs of hashed words, None below ``least``."""
    out: list[float | None] = [None] * len(pairs)
    narrow = []
    for i, (x, y) in enumerate(pairs):
        if len(x) < len(y):
            x, y = y, x
        most = int(len(x) * (1 - least) + 1e-9)
        if len(x) - len(y) > most:
            continue
        more = np.bincount((x >> np.uint64(52)).astype(np.int64), minlength=4096) - np.bincount((y >> np.uint64(52)).astype(np.int64), minlength=4096)
        if max(more[more > 0].sum(), -more[more < 0].sum()) > most:
            continue
        if len(x) < 2 * NARROW or not len(y):
            out[i] = similarity_at_least(x, y, least)
        else:
            narrow.append((len(x), i, x, y, most))
    narrow.sort(key=lambda p: p[0])
    at = 0
    while at < len(narrow):
        group = narrow[at : at + max(1, min(256, (1 << 21) // narrow[min(at + 255, len(narrow) - 1)][0]))]
        at += len(group)
        for (n, i, x, y, most), d in zip(group, narrow_distances([(x, y) for _, _, x, y, _ in group])):
            if d <= min(most, NARROW):
                out[i] = 1 - int(d) / n
            elif most > NARROW and d > NARROW:
                out[i] = similarity_at_least(x, y, least, 4 * NARROW)
    return out


_SIGNED = "doc_id long, text_hash long, n_words int, sketches array<long>, counts binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memory = WordHashes()
    for batch in batches:
        out = ([], [], [], [], [])
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = (text.as_py() or "").split()
            if not words:
                continue
            hashes = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
            out[0].append(doc_id)
            out[1].append(xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63))
            out[2].append(len(words))
            out[3].append(keys(hashes).view(np.int64))
            out[4].append(word_counts(hashes).tobytes())
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "text_hash", "n_words", "sketches", "counts"])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memory = WordHashes()

    def hashed(text: pa.Scalar) -> np.ndarray:
        words = text.as_py().split()
        return np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))

    for batch in batches:
        found = similarities([(hashed(x), hashed(y)) for x, y in zip(batch.column("text_a"), batch.column("text_b"))])
        rows = [(a, b, s) for a, b, s in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), found) if s is not None]
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([], [], []), kinds)], ["a", "b", "similarity"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of the pairs that alignment confirms; ``texts`` (doc_id, text) has one row per id."""
    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    found = both.select("a", "b", "text_a", "text_b").mapInArrow(_align, "a long, b long, similarity double")
    # Links are small: they go to few files, while the alignment stays with its many tasks.
    found = found.repartition(1 + pairs.count() // ROWS_PER_FILE)
    with small_batches(pairs.sparkSession, PAIRS):
        return saved(found, "omh-verified")


def components(links: DataFrame) -> DataFrame:
    """(id, class_id) of all ids in ``links`` (a, b): the smallest id that links lead to.

    Each round every id moves to its smallest neighbour, and on to where that one moves, and the links are
    contracted to what still joins different ids; their number falls fast, so later rounds are small.  The
    smallest id of a class never moves.  Every round is written, so lineage stays short.
    """
    n = 2 * links.count()
    links = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "omh-links", n)
    classes = None
    while True:
        ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = saved(ends.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("p")), "omh-moves", n)
        for _ in range(2):
            on = moved.select(F.col("v").alias("w"), F.col("p").alias("q"))
            moved = moved.join(on, F.col("p") == F.col("w")).select("v", F.col("q").alias("p"))
        moved = saved(moved, "omh-moves", n)
        if classes is None:
            classes = moved.select(F.col("v").alias("id"), F.col("p").alias("class_id"))
        else:
            classes = saved(classes.join(moved, F.col("class_id") == F.col("v"), "left").select("id", F.coalesce("p", "class_id").alias("class_id")), "omh-classes", n)
        one, other = moved.select(F.col("v").alias("a"), F.col("p").alias("pa")), moved.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        left = links.join(one, "a").join(other, "b").where("pa <> pb")
        links = saved(left.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "omh-links", n)
        if links.isEmpty():
            return classes


def _cross_pairs(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs of different classes in two blocks of a bucket that both bounds leave possible.

    A pair that shares several buckets is named by the one of the least sketch.
    """
    one, other = group[group.side == 0], group[group.side == 1]
    if len(other) == 0:
        other, own = one, True
    else:
        own = False
    fine = [[stored_counts(c, n) for c, n in zip(g.counts, g.n_words)] for g in (one, other)]
    coarse = np.concatenate([folded(c, BINS) for c in fine[1]])
    wide = np.array([c.shape[1] for c in fine[1]])
    n = [g.n_words.to_numpy() for g in (one, other)]
    ids = [g.rep.to_numpy() for g in (one, other)]
    classes = [g.class_id.to_numpy() for g in (one, other)]
    sketched = [g.sketches.to_numpy() for g in (one, other)]
    a, b = [], []
    for i in range(len(one)):
        most = np.floor(np.maximum(n[0][i], n[1]) * (1 - SIMILARITY) + 1e-9)
        fits = (classes[1] != classes[0][i]) & (np.abs(n[1] - n[0][i]) <= most)
        if own:
            fits[: i + 1] = False
        at = np.flatnonzero(fits)
        if len(at):
            at = at[least_distances(folded(fine[0][i], BINS), coarse[at]) <= most[at]]
            close = np.zeros(len(at), bool)
            for bins in np.unique(wide[at]):
                same = np.flatnonzero(wide[at] == bins)
                close[same] = least_distances(fine[0][i], np.concatenate([fine[1][k] for k in at[same]])) <= most[at[same]]
            at = at[close]
            at = at[[np.intersect1d(sketched[0][i], sketched[1][k], assume_unique=True)[0] == group.sketch.iloc[0] for k in at]] if len(at) else at
            a += [min(ids[0][i], x) for x in ids[1][at]]
            b += [max(ids[0][i], x) for x in ids[1][at]]
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _turned(buckets: DataFrame, classes: DataFrame, done: DataFrame, turn: int) -> DataFrame:
    """(a, b): members of mixed buckets with a centre of another class, which a hash of id and turn draws."""
    labelled = buckets.join(classes, buckets.rep == classes.id, "left").select("sketch", "rep", F.coalesce("class_id", "rep").alias("class_id"))
    drawn = labelled.withColumn("draw", F.xxhash64("rep", "sketch", F.lit(turn)))
    mixed = drawn.groupBy("sketch").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi"), F.min("draw").alias("least")).where("lo < hi")
    members = drawn.join(mixed.select("sketch", "least"), ["sketch"])
    centres = members.where("draw = least").select("sketch", F.col("rep").alias("centre"), F.col("class_id").alias("centre_class"))
    pairs = members.join(centres, ["sketch"]).where("class_id <> centre_class")
    return pairs.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct().join(done, ["a", "b"], "left_anti")


def _mixed_buckets(buckets: DataFrame, signed: DataFrame, classes: DataFrame, done: DataFrame) -> DataFrame:
    """(a, b): pairs of different classes that share a bucket and weren't compared yet."""
    labelled = buckets.join(classes, buckets.rep == classes.id, "left").select("sketch", "rep", F.coalesce("class_id", "rep").alias("class_id"))
    mixed = labelled.groupBy("sketch").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("sketch", "n")
    members = labelled.join(mixed, ["sketch"])
    # A member of a bucket of many blocks goes to the groups (own block, other block), on the side of the lower block or the upper.
    members = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    members = members.withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
    members = members.select("sketch", F.least("block", "with").alias("lower"), F.greatest("block", "with").alias("upper"), (F.col("block") > F.col("with")).cast("int").alias("side"), F.col("rep"), "class_id")
    members = members.join(signed.select(F.col("doc_id").alias("rep"), "n_words", "counts", "sketches"), "rep")
    # Few bytes but much work: a fixed number of partitions, which AQE doesn't merge into one task.
    keys = ["sketch", "lower", "upper"]
    members = members.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    pairs = members.groupBy(*keys).applyInPandas(_cross_pairs, "a long, b long").distinct()
    return pairs.join(done, ["a", "b"], "left_anti")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the smallest id of its class), kept.

    Texts without words (null, empty, blank) and rows without an id are never near another text: each is its own class.  Texts
    of fewer than four words are only equal to copies, since one edit leaves a similarity below 0.8.  Repeated rows share their class, and
    all rows with the class's id are marked kept.  Ids of the smallest value stand for copies.
    """
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id is not null")
    with small_batches(docs.sparkSession, TEXTS):
        signed = saved(texts.mapInArrow(_sign, _SIGNED), "omh-signed")
    n_docs = signed.count()
    # Copies: equal sequences of words, by hash and length.
    reps = saved(signed.groupBy("text_hash", "n_words").agg(F.min("doc_id").alias("rep")), "omh-reps", n_docs)
    chosen = signed.join(reps.select(F.col("rep").alias("doc_id"), "text_hash"), ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id"])
    rows = chosen.select(F.col("doc_id").alias("rep"), F.explode("sketches").alias("sketch"))
    buckets = saved(rows.join(rows.groupBy("sketch").agg(F.min("rep").alias("centre"), F.max("rep").alias("most")).where("centre < most"), ["sketch"]).select("sketch", "rep", "centre"), "omh-buckets", SKETCHES * n_docs)
    signed_reps = signed.select("doc_id", "n_words", "counts", "sketches").join(buckets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    signed_reps = saved(signed_reps, "omh-counts", 4 * n_docs)
    # The texts of bucket members alone: one pass over the documents serves all comparisons.
    members = saved(rows_in(texts, {"doc_id": F.col("doc_id")}, signed_reps.select("doc_id")).dropDuplicates(["doc_id"]), "omh-texts", 4 * n_docs)

    n_rows = buckets.count()
    done = saved(buckets.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), "omh-star", n_rows)
    links = verified(done, members)
    buckets, classes = buckets.select("sketch", "rep"), components(links)
    for turn in range(TURNS + 1):
        if turn < TURNS:
            rest = saved(_turned(buckets, classes, done, turn), "omh-rest", n_rows)
        else:
            rest = saved(_mixed_buckets(buckets, signed_reps, classes, done), "omh-rest", n_rows)
        if rest.isEmpty():
            continue
        found = verified(rest, members)
        done = done.unionByName(rest)
        if not found.isEmpty():
            # Classes stand for the links they come from.
            links = found.select("a", "b").unionByName(classes.where("id <> class_id").select(F.col("class_id").alias("a"), F.col("id").alias("b")))
            classes = components(links)

    of_rep = reps.join(classes, reps.rep == classes.id, "left").select("text_hash", "n_words", F.coalesce("class_id", "rep").alias("class_id"))
    of_doc = signed.select("doc_id", "text_hash", "n_words").join(of_rep, ["text_hash", "n_words"]).groupBy(F.col("doc_id").alias("known")).agg(F.min("class_id").alias("class_id"))
    everyone = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id")).join(of_doc, F.col("doc_id") == F.col("known"), "left")
    return everyone.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.expr("doc_id <=> coalesce(class_id, doc_id)").alias("kept"))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the row of the smallest id of each class, all columns kept.

    Of rows repeated under one id and text one is left.  Only the rows of dropped and repeated ids are shuffled.
    """
    dropped = saved(near_groups(docs, doc_id, text).where("not kept").select("doc_id").distinct(), "omh-dropped", docs.count())
    body = F.col(f"`{text}`")
    return rows_but(docs, {"doc_id": F.col(f"`{doc_id}`").cast("long")}, dropped, body, F.lit(1))
