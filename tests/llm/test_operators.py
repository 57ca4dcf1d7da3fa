"""The ten operators against brute force on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from scalewright.llm import byte_bpe, divergence_rules, dom_marginals, fourier_quality, minimax_shards, mixing_coder, order_minhash, quotient_dedup, source_mix, warc_chunks

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, row string"
R = random.Random(7)
WORDS = ["w%d" % i for i in range(400)]
SPACES = " \t\n\x0b\x0c\r"


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def table(spark, texts):
    """Texts as documents with extra columns whose names the operators use themselves."""
    rows = [(i, t, ["en", "de", None, "xx"][i % 4], None if i % 7 == 0 else "s%d" % (i % 3), 0, -1, -2, "r") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


LONG = prose(30_000)
TEXTS = [None, "", " \n ", "one", "two words", LONG, prose(200), "a b c", "a  b\tc", "abc", "ü ñ 漢字 🙂 x", *[prose(80) for _ in range(20)]]
TEXTS += [TEXTS[12], TEXTS[12] + " ", TEXTS[13]]


def bare(t):
    return "".join(c for c in t or "" if c not in SPACES)


def test_exact_groups(spark):
    docs = table(spark, TEXTS)
    docs = docs.unionByName(docs.where("doc_id = 12")).unionByName(spark.createDataFrame([(None, "abc", "en", "s", 0, 0, 0, "r")], DOCS))
    rows = quotient_dedup.exact_groups(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    all_rows = [*enumerate(TEXTS), (12, TEXTS[12]), (None, "abc")]
    for r in rows:
        text = TEXTS[r["doc_id"]] if r["doc_id"] is not None else "abc"
        same = [(i, t) for i, t in all_rows if bare(t) == bare(text)]
        keep = min((x for x in same if x[0] is not None), key=lambda x: (-len(x[1] or ""), x[0]))[0]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(same), r["doc_id"] == keep)
        assert r["text_sha256"] == hashlib.sha256(bare(text).encode()).hexdigest()
    kept = quotient_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({bare(t) for t in TEXTS})
    assert quotient_dedup.exact_groups(docs.where("false")).collect() == []


def test_exact_groups_whose_longest_copy_has_no_id(spark):
    rows = [(None, "a b c d"), (3, "ab cd"), (2, "ab cd"), (1, "abcd"), (None, "x y"), (None, "xy"), (4, "z")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 0, 0, "r") for i, t in rows], DOCS)
    got = sorted((r["text_sha256"], r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in quotient_dedup.exact_groups(docs).collect())
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("abcd", "xy", "z")}
    want = [(sha["abcd"], i, 2, 4, i == 2) for i in (0, 1, 2, 3)] + [(sha["xy"], 0, None, 2, True)] * 2 + [(sha["z"], 4, 4, 1, True)]
    assert got == sorted(want, key=lambda r: r[:2])


def test_quotient_filters_are_lossless():
    values = np.array([5, 5, 2**63 + 9, 2**40, 7], np.uint64)
    q, runs, rest, counts = quotient_dedup.filter_of(values, np.ones(5))
    assert quotient_dedup.fingerprints_of(q, runs, rest).tolist() == [5, 7, 2**40, 2**63 + 9] and counts.tolist() == [2, 1, 1, 1]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[-1] + 1))
    return row[-1]


def changed(words, n):
    words = list(words)
    for _ in range(n):
        at = R.randrange(len(words))
        words[at : at + R.choice([0, 1])] = [R.choice(WORDS)] * R.choice([0, 1])
    return words


def test_banded_alignment():
    for _ in range(500):
        a = [R.randrange(5) for _ in range(R.randrange(14))]
        b = [R.randrange(5) for _ in range(R.randrange(14))]
        for most in (0, 1, 3, 20):
            assert order_minhash.edit_distance(a, b, most) == min(levenshtein(a, b), most + 1)
    pairs = []
    for _ in range(60):
        a = np.array([R.randrange(300) for _ in range(R.randint(62, 110))], np.uint64) << np.uint64(32)
        b = np.array([x for x in a.tolist() if R.random() > 0.3 * R.random()], np.uint64)
        pairs.append((a, b))
    got = order_minhash.narrow_distances(pairs)
    assert [min(int(x), 32) for x in got] == [min(levenshtein(a.tolist(), b.tolist()), 32) for a, b in pairs]


def test_near_groups(spark):
    base = [[R.choice(WORDS) for _ in range(150)] for _ in range(12)]
    texts = [" ".join(changed(b, n)) for b in base for n in (0, 2, 4)] + [None, "", "one two", "one two", " ".join(base[0][:75])]
    docs = table(spark, texts)
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_groups(docs).collect()}
    assert len(got) == len(texts)
    for k in range(12):
        assert {got[3 * k + i] for i in range(3)} == {3 * k}
    assert got[36] == 36 and got[37] == 37 and got[38] == got[39] == 38 and got[40] == 40
    kept = order_minhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(set(got.values()))
    assert order_minhash.near_groups(docs.where("false")).collect() == []


def brute_classes(texts):
    """Smallest index that links of similarity 0.8 lead to."""
    words = [t.split() for t in texts]
    label = list(range(len(words)))
    for i, x in enumerate(words):
        for j in range(i):
            if label[i] != label[j] and 5 * levenshtein(x, words[j]) <= max(len(x), len(words[j])):
                label = [min(label[i], label[j]) if c in (label[i], label[j]) else c for c in label]
    return label


def test_near_groups_of_short_texts(spark):
    rng = random.Random(5)
    texts = ["a b c d e f g", "a b c x e f g", "h i j k", "h i j k l", "m n o", "m n o p"]
    for n in range(4, 15):
        for _ in range(4):
            words = [rng.choice(WORDS) for _ in range(n)]
            for edits in (0, 1, 2):
                other = list(words)
                for at in rng.sample(range(n), edits):
                    other[at] = rng.choice(["", "new", "new new"])
                texts.append(" ".join(" ".join(other).split()))
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_groups(table(spark, texts)).collect()}
    assert got[1] == 0 and got[3] == 2 and got[5] == 5
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_near_pairs_with_scattered_changes_share_a_bucket():
    rng = np.random.default_rng(4)
    for n, pairs in ((15, 60), (20, 60), (40, 60), (64, 60), (66, 60), (200, 60), (500, 20)):
        for similarity, recall in ((0.8, 0.9), (0.85, 0.95), (0.9, 1), (0.95, 1)):
            found = 0
            for _ in range(pairs):
                a = rng.integers(0, 2**63, n).astype(np.uint64)
                b = a.copy()
                at = rng.choice(n, int(n * (1 - similarity) + 1e-9), replace=False)
                b[at] = rng.integers(0, 2**63, len(at)).astype(np.uint64)
                found += len(np.intersect1d(order_minhash.keys(a), order_minhash.keys(b))) > 0
            assert found >= recall * pairs, (n, similarity, found)


def test_a_repeated_kmer_does_not_change_the_others():
    words = np.arange(1, 81, dtype=np.uint64)
    again = np.concatenate((words[:78], words[:2]))
    assert len(np.intersect1d(order_minhash.labelled_kmers(words), order_minhash.labelled_kmers(again))) >= 70


def test_bpe_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.load_ranks(path)
    real = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*TEXTS, "x" * 3000, "it's <|endoftext|>  \n\n \x85 ½12"]
    for r in byte_bpe.round_trip(table(spark, texts), path, public_tokenizers.PATTERN).collect():
        text = texts[r["doc_id"]] or ""
        ids = real.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    # Words of every length, with bytes of every kind, folded by Spark alone.
    words = ["", " the", "x" * 300, "".join(map(chr, range(33, 127))), "ü漢🙂" * 20, *{w for t in texts if t for w in t.split(" ")[:50]}]
    folded = byte_bpe.merged_in_sql(spark.createDataFrame([(w,) for w in words], "word string"), ranks).collect()
    assert {r["word"]: r["ids"] for r in folded} == {w: byte_bpe.merge_word(w.encode(), ranks) if w else [] for w in words}
    back = byte_bpe.decoded(byte_bpe.encoded(table(spark, TEXTS[8:12]), path, public_tokenizers.PATTERN), path)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(enumerate(TEXTS[8:12]))


def test_frequent_words_change_no_ids(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, TEXTS)
    want = sorted(tuple(r) for r in byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect())
    for most in (0, 40):
        monkeypatch.setattr(byte_bpe, "FREQUENT", most)
        frequent = byte_bpe.frequent_words(byte_bpe.split_texts(docs, public_tokenizers.PATTERN)).count()
        assert frequent <= most and sorted(tuple(r) for r in byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect()) == want
    assert byte_bpe.round_trip(docs.where("false"), path, public_tokenizers.PATTERN).collect() == []


def test_every_code_point_is_cut_as_the_library_does(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.load_ranks(path)
    real = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    # Each code point between letters, digits, signs and white space, so that its class decides where words end.
    texts = ["".join(f"a{c}1{c} {c}.{c}  " for c in chars[at : at + 256]) for at in range(0, len(chars), 256)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect():
        ids = real.encode_ordinary(texts[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest(), r["doc_id"]


def base_rules(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {w for w in windows if windows.count(w) > 1} if len(windows) < 500 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + j for i, w in enumerate(windows) if w in repeated for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(SPACES)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_divergence_rules(spark):
    common = divergence_rules.COMMON_WORDS["en"]
    clean = [" ".join(R.choice(common) if R.random() < 0.5 else R.choice(WORDS)[::-1] + "e" for _ in range(120)) for _ in range(60)]
    junk = ["*** $$$ ### ".join(t.split()) for t in clean[:3]] + [" ".join("a b c d".split() * 40)]
    texts = [*TEXTS, *clean, *junk, "a b c\na b c\n\n \nx | y\nx | y", "one two three one two three"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 0, 0, "r") for i, t in enumerate(texts)], DOCS)
    rows = {r["doc_id"]: r for r in divergence_rules.assessed(docs).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        want = base_rules(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, text and text[:60]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    first = len(TEXTS)
    assert all(rows[first + i]["kept"] for i in range(60)) and not any(rows[first + 60 + i]["kept"] for i in range(4))
    kept = divergence_rules.kept_documents(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["kept"]}
    assert divergence_rules.assessed(docs.where("false")).collect() == []


def test_windows_of_one_hash_are_told_apart_by_their_words(spark, monkeypatch):
    monkeypatch.setattr(divergence_rules, "WINDOW_HASH", "cast(length(words[i]) % 2 as bigint)")
    few = ["a", "bb", "c", "dd"]
    texts = [*TEXTS[:5], *TEXTS[6:], *[" ".join(R.choice(few) for _ in range(n)) for n in (3, 4, 5, 9, 30, 80)], prose(600) + " x y z x y z", "a a a a", "a b c a d c a b c"]
    rows = divergence_rules.assessed(table(spark, texts)).collect()
    assert len(rows) == len(texts)
    assert {r["doc_id"]: r["n_repeat_words"] for r in rows} == {i: base_rules(t)[4] for i, t in enumerate(texts)}


def brute_quality_scores(texts, labels, folds):
    """Features, normal equations, folds and calibration by plain loops; the fold of a row is given."""
    f = fourier_quality
    rows = np.array([f.statistics(t or "") for t in texts])
    known = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 != 1]
    kernel = f.Kernel(rows[known].mean(axis=0), np.maximum(rows[known].std(axis=0), 1e-9))

    def lifted(row):
        x = [max(-f.LARGEST, min(f.LARGEST, (v - m) / s)) for v, m, s in zip(row, kernel.mean, kernel.scale)]
        angles = [sum(a * w for a, w in zip(x, kernel.waves[:, j])) + kernel.phases[j] for j in range(f.FEATURES)]
        return np.array([*(np.sqrt(2 / f.FEATURES) * np.cos(a) for a in angles), 1.0])

    z = [lifted(r) for r in rows]

    def fitted(used):
        left, right = f.RIDGE * np.eye(f.FEATURES + 1), np.zeros(f.FEATURES + 1)
        for i in used:
            left, right = left + np.outer(z[i], z[i]), right + labels[i] * z[i]
        return np.linalg.solve(left, right)

    bins = {}
    for k in range(f.FOLDS):
        weights = fitted([i for i in known if folds[i] != k])
        for i in known:
            if folds[i] == k:
                at = min(f.BINS - 1, max(0, int((z[i] @ weights + 0.5) / 2 * f.BINS)))
                bins.setdefault(at, []).append(labels[i])
    at = sorted(bins)
    mean = lambda a, b: np.mean([y for j in at[a : b + 1] for y in bins[j]])
    levels = [max(min(mean(a, b) for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
    raw = np.array([v @ fitted(known) for v in z])
    return 0.999 * np.interp(raw, [(j + 0.5) * 2 / f.BINS - 0.5 for j in at], levels) + 0.001 * np.clip((raw + 1) / 3, 0, 1)


def test_quality_scores_against_plain_loops(spark):
    rng = random.Random(11)
    texts, labels = [None, ""], [0, 1]
    for _ in range(90):
        good = rng.random() < 0.6
        said = prose(rng.randint(5, 90)).split()
        texts.append(" ".join(w.upper() + "!" if rng.random() < (0.2 if good else 0.5) else w for w in said) + "." * good)
        labels.append(int(good if rng.random() < 0.85 else not good))
    docs = table(spark, texts)
    statistics = spark.createDataFrame([(i, *map(float, fourier_quality.statistics(t or ""))) for i, t in enumerate(texts)], ["doc_id", *fourier_quality.NAMES])
    folds = {r["doc_id"]: r["fold"] for r in statistics.select("doc_id", fourier_quality.fold().alias("fold")).collect()}
    assert len(set(folds.values())) == fourier_quality.FOLDS
    want = brute_quality_scores(texts, labels, folds)
    rows = fourier_quality.scored(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int")).collect()
    assert len(rows) == len(texts)
    assert [r["score"] for r in sorted(rows, key=lambda r: r["doc_id"])] == pytest.approx(want.tolist(), abs=1e-6)


def test_quality_scores(spark):
    texts = [prose(60) + "." if i % 2 else " ".join(w.upper() + "!!" for w in prose(60).split()) for i in range(240)]
    docs, labels = table(spark, [*texts, None, ""]), spark.createDataFrame([(i, i % 2) for i in range(240)], "doc_id long, quality int")
    rows = fourier_quality.scored(docs, labels).collect()
    assert len(rows) == 242 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 240]
    assert held and all(r["predicted"] == r["doc_id"] % 2 for r in held)
    # Labels of held-out rows change nothing.
    flipped = spark.createDataFrame([(i, i % 2 if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - i % 2) for i in range(240)], "doc_id long, quality int")
    again = {r["doc_id"]: r["score"] for r in fourier_quality.scored(docs, flipped).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in rows)
    assert {r["score"] for r in fourier_quality.scored(docs, labels.where("false")).collect()} == {0.5}
    assert fourier_quality.isotonic(np.ones(3), np.array([0.0, 2.0, 1.0])).tolist() == [0, 1.5, 1.5]


def test_range_coder_round_trips():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (2, 3), (5, 700)):
        ids = np.minimum(rng.pareto(0.6, shape) * 3, 50256).astype(np.int64)
        packed = mixing_coder.encode_blocks(ids)
        assert (mixing_coder.decode_blocks(packed, shape[1]) == ids).all()
    segment = mixing_coder.pack_segment(3, [(7, 700)], ids[0].astype(np.uint16))
    part, docs, back = next(mixing_coder.unpack_segments(segment + b"\n"))
    assert part == 3 and docs.tolist() == [[7, 700]] and (back == ids[0]).all()
    broken = bytearray(segment)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        list(mixing_coder.unpack_segments(bytes(broken) + b"\n"))


def test_mixed_parts_of_all_ids_fill_the_total():
    rng = np.random.default_rng(5)
    seen = rng.integers(0, 40, (3, 64))
    model = mixing_coder._Model(3)
    for t in range(40):
        model.look()
        model.part(seen[:, t])
        model.update(seen[:, t], t, seen)
    model.look()
    upto = np.zeros(3, np.int64)
    for x in range(1 << 16):
        start, own = model.part(np.full(3, x))
        assert (start == upto).all()
        if x < 60:  # every value of a part leads back to its id
            for value in (start, start + own // 2, start + own - 1):
                assert (model.find(value) == x).all()
        upto = start + own
    assert (upto == model.total).all()


def test_mixing_packs_closer_than_zlib():
    import zlib

    import public_tokenizers
    import pyarrow.parquet as pq

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        words = mixing_coder._WordIds(f.read())
    ids = [x for text in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"] for x in words.of_text(text.as_py() or "")]
    grid = np.array(ids[: len(ids) // 4096 * 4096], np.uint16).reshape(-1, 4096)
    packed = mixing_coder.encode_blocks(grid)
    assert (mixing_coder.decode_blocks(packed, 4096) == grid).all()
    assert sum(map(len, packed)) < len(zlib.compress(grid.tobytes(), 9)) < sum(len(zlib.compress(row.tobytes(), 9)) for row in grid)


def test_stored_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    real = Tokenizer.from_file(path)
    texts, start = [*TEXTS, "a <|endoftext|> b"], 0
    rows = mixing_coder.stored_documents(table(spark, texts).repartition(3), path).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    for i, r in enumerate(rows):
        ids = [*real.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert mixing_coder.stored_documents(table(spark, texts).where("false"), path).collect() == []


def test_stored_ids_of_repeated_and_missing_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(k, t) for k in (None, 5, -3) for t in [*TEXTS[:5], *TEXTS[6:], None]]
    runs = [
        mixing_coder.stored_documents(spark.createDataFrame(order, "doc_id long, text string").repartition(n), path).collect() for order, n in ((rows, 2), (rows[::-1], 5))
    ]
    first, second = ([tuple(r) for r in sorted(run, key=lambda r: r["start"])] for run in runs)
    assert first == second and len(first) == len(rows)
    assert [r[0] for r in first] == [k for k in (None, -3, 5) for _ in range(len(rows) // 3)]
    assert all(a[1] + a[2] == b[1] for a, b in zip(first, first[1:]))


def test_ids_of_texts_with_added_tokens_are_the_librarys():
    path = public_tokenizers.path("byte_bpe_50k.json")
    real = Tokenizer.from_file(path)
    words = mixing_coder._WordIds(open(path, encoding="utf-8").read())
    for text in ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b", "<|endoftext", *(t or "" for t in TEXTS)]:
        assert words.of_text(text).tolist() == real.encode(text, add_special_tokens=False).ids
    assert words.of_text("hello <|endoftext|> world").tolist() == [31373, 220, 50256, 995]


def best_capacity(sizes, shards):
    best = [[0] + [10**18] * len(sizes)]
    for _ in range(shards):
        row = [min(max(best[-1][j], sum(sizes[j:i])) for j in range(i + 1)) for i in range(len(sizes) + 1)]
        best.append(row)
    return best[-1][-1]


def test_minimax_shards(spark):
    texts = [*TEXTS, *[prose(R.randint(1, 60)) for _ in range(40)]]
    docs = table(spark, texts)
    rows = minimax_shards.sharded(docs, 4).collect()
    by_text = {}
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "bytes", None)
        assert by_text.setdefault(text, r["shard"]) == r["shard"]
    for k in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    from pyspark.sql import functions as F

    keyed = docs.select(F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1).alias("k"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("s"))
    sizes = [r["s"] for r in keyed.groupBy("k").agg(F.sum("s").alias("s")).orderBy("k").collect()]
    assert max(sum(r["size"] for r in rows if r["shard"] == k) for k in range(4)) == best_capacity(sizes, 4)
    assert minimax_shards.sharded(docs.where("false")).collect() == []


def test_warc_round_trip(spark):
    big = LONG[:150_000]
    htmls = [None, "", "short", "short", "<p>" + "x" * 200, "<p>" + "x" * 200, big, big, "ü" * 70, "a\r\n\r\nWARC/1.1" * 20]
    rows = [(i, None if i == 1 else f"http://x/{i}", h, 5, "d") for i, h in enumerate(htmls)] + [(6, "http://x/6", big, 5, "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, chunk_no int, data string")
    found = warc_chunks.archived(pages).collect()
    assert len(found) == len(rows)
    for r in found:
        payload = (htmls[r["page_id"]] or "").encode()
        first = next(i for i, h in enumerate(htmls) if (h or "").encode() == payload) if len(payload) >= 100 else r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == r["page_id"] else ("revisit", first))
    assert warc_chunks.archived(pages.where("false")).collect() == []


def test_main_text(spark):
    page = "<html><head><title>T</title><script>x('<p>no</p>')</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='ad'>Buy this now.</div><article><h1>Head &amp; line</h1><p><b>Open tag here.<br><p>Some   text\nover lines, long enough to be a paragraph.</p><div class='comments'><p>Nice article, thanks.</p></div></article><footer>&copy; us.</footer></body></html>"
    want = "Head & line\nOpen tag here.\nSome text over lines, long enough to be a paragraph."
    pages = spark.createDataFrame([(i, "u", h, 1) for i, h in enumerate([page] * 5 + [None, "", "<p>x<"])], "page_id long, url string, html string, n_chars int")
    rows = {r["page_id"]: r for r in dom_marginals.extracted(pages).collect()}
    assert len(rows) == 8 and all(rows[i]["text"] == want and rows[i]["n_chars"] == len(want) for i in range(5))
    assert rows[5]["text"] == rows[6]["text"] == ""
    assert dom_marginals.extracted(pages.where("false")).collect() == []


@pytest.mark.parametrize(
    "html, want",
    [
        ("<head><title>T</title><body><p>kept", "kept"),
        ("<html><head><meta charset=x><style>p{}</style><p>kept</p>", "kept"),
        ("<head><title>T</title>kept", "kept"),
        ("<body><select><option>A<option>B</select><p>kept", "kept"),
        ("<body><select><optgroup><option>A<optgroup><option>B</select>kept", "kept"),
        ("<div><button>Buy<div>now</div></div><p>kept", "kept"),
        ("<div><button><div>Buy</div>now</button>kept</div>", "kept"),
        ("<p>one<label>Name<p>kept", "one kept"),
        ("<svg><path><p>kept", "kept"),
        ("<svg><title>x</title><text>y</text></svg>kept", "kept"),
        ("<template><div>no</div><p>no</template>kept", "kept"),
        ("<script>if (a</b>) x('</p>')</script>kept<textarea><p>no</textarea>", "kept"),
        ("<p>a <math><mi>x</mi></math> <canvas>b</canvas> <video>c</video> <audio>d</audio> <object>e</object>", "a x b c d e"),
    ],
)
def test_dropped_elements_end_where_html_ends_them(html, want):
    assert " ".join(t for t in dom_marginals.parsed(html).text if t is not None) == want


ARTICLE = "<html><body><nav><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></nav><div class='ad'>Buy this now, today.</div><%s class=%s><h1>Line %d</h1><p>A paragraph of some length, with an end.</p><div class='comments'><p>Nice article, thanks a lot.</p></div></%s><footer>Made by us in some place.</footer></body></html>"


def test_potentials_are_the_counts_of_labelled_pages(spark):
    pages = [ARTICLE % (t, "x", i, t) for i, t in enumerate(["article", "main", "div", "article"])]
    found = dom_marginals.trained(spark.createDataFrame(list(enumerate([*pages, None, ""])), "page_id long, html string"))
    counts = {}
    for html in pages:
        if "<div class=x>" in html:
            continue
        for page in (html, html.replace("<article", "<div").replace("/article>", "/div>").replace("<main", "<div").replace("/main>", "/div>")):
            tree = dom_marginals.parsed(page)
            content, parents = [], tree.parent
            for i in range(len(tree.tag)):
                above, j = [], i
                while j >= 0:
                    above.append((tree.tag[j], tree.hints[j]))
                    j = parents[j]
                content.append(int(any(h == ("", "x") or "x" in h for _, h in above) and not any(t in dom_marginals.BOILERPLATE or set(h) & set(dom_marginals.HINTS_AGAINST) for t, h in above)))
            for i in range(1, len(content)):
                for feature in [*dom_marginals.looks(tree, i), f"pair:{tree.kind[i]}:{content[parents[i]]}"]:
                    counts[feature, content[i]] = counts.get((feature, content[i]), 0) + 1
    want = dom_marginals.Potentials(dom_marginals.Counter(counts))
    assert found.node == want.node and found.pair == want.pair


@pytest.mark.parametrize("element", ["article", "main", "div", "section"])
def test_pages_without_an_article_element(spark, element):
    pages = [ARTICLE % ("article", "x", i, "article") for i in range(20)] + [ARTICLE % (element, "x", i, element) for i in range(20)]
    rows = dom_marginals.extracted(spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages)], "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in rows} == {i: f"Line {i % 20}\nA paragraph of some length, with an end." for i in range(40)}


def test_no_page_labels_itself(spark):
    rows = dom_marginals.extracted(spark.createDataFrame([(0, "u", ARTICLE % ("div", "post", 0, "div"))], "page_id long, url string, html string")).collect()
    assert rows[0]["text"] == "Line 0\nA paragraph of some length, with an end."


@pytest.mark.parametrize("start", ["<div>", "<svg>", "<ul><li>", "<p>a<b>", "<b><button><div>", "<td><select>"])
def test_deep_pages_take_linear_time(start):
    import time

    model, taken = dom_marginals.Potentials(dom_marginals.prior_counts()), []
    for n in (4000, 32_000):
        before = time.process_time()
        dom_marginals.main_text(start * n + "x", model)
        taken.append(time.process_time() - before)
    assert taken[1] < 24 * taken[0] + 0.5  # quadratic time would be 64 times as long


def brute_marginals(tree, model):
    from itertools import product

    n, totals, ones = len(tree.tag), 0.0, [0.0] * len(tree.tag)
    import math

    own = [[0.7, 0.3]]
    for i in range(1, n):
        odds = max(-dom_marginals.STRONGEST, min(dom_marginals.STRONGEST, sum(model.node[f][1] - model.node[f][0] for f in dom_marginals.looks(tree, i) if f in model.node)))
        own.append([1 / (1 + math.exp(odds)), 1 / (1 + math.exp(-odds))])
    for state in product((0, 1), repeat=n):
        p = own[0][state[0]]
        for i in range(1, n):
            p *= own[i][state[i]] * model.pair[tree.kind[i]][state[tree.parent[i]]][state[i]]
        totals += p
        for i in range(n):
            ones[i] += p * state[i]
    return [x / totals for x in ones]


def test_messages_give_exact_marginals():
    model = dom_marginals.Potentials(dom_marginals.prior_counts())
    tree = dom_marginals.parsed("<body><div class=ad>one<p>two.</p></div><article><p>three.<p>four</article></body>")
    assert model.marginals(tree) == pytest.approx(brute_marginals(tree, model), abs=1e-9)


def test_source_mix(spark):
    texts = [prose(R.randint(1, 50)) if i % 50 else None for i in range(900)]
    docs = table(spark, texts)
    rows = source_mix.mixed(docs).collect()
    assert [tuple(r) for r in sorted(source_mix.mixed(docs.repartition(7)).collect())] == [tuple(r) for r in sorted(rows)]
    source = {i: None if i % 7 == 0 else "s%d" % (i % 3) for i in range(900)}
    sizes = {i: len((t or "").split()) for i, t in enumerate(texts)}
    names = ["s0", "s1", "s2", None]
    total = {s: sum(sizes[i] for i in sizes if source[i] == s) for s in names}
    weight, target, free = dict(zip(names, (5, 2, 1, 5))), {}, set(names)
    left = 1.5 * sum(total.values())
    while True:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        full = {s for s in free if share[s] >= 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in full} or share
        if not full:
            break
        free -= full
        left -= sum(2 * total[s] for s in full)
    taken = dict.fromkeys(names, 0)
    for r in rows:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (sizes[r["doc_id"]], total[s]) and r["target"] == pytest.approx(target[s])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] for s in names)
    mix = source_mix.mixture(docs)
    assert mix.columns == docs.columns and mix.count() == sum(r["copies"] for r in rows)
    assert source_mix.mixed(docs.where("false")).collect() == []


def test_word_count_bound_never_exceeds_the_edit_distance():
    rng = np.random.default_rng(1)
    vocabulary = rng.integers(0, 2**64, 400, dtype=np.uint64)
    for _ in range(100):
        a = vocabulary[rng.integers(0, 400, int(rng.integers(1, 900)))]
        b = a.tolist()
        for _ in range(int(rng.integers(0, 30))):
            k = int(rng.integers(0, len(b) + 1))
            b[k : k + int(rng.integers(0, 2))] = vocabulary[rng.integers(0, 400, int(rng.integers(0, 2)))].tolist()
        b = np.array(b or [1], np.uint64)
        distance = order_minhash.edit_distance(a.tolist(), b.tolist(), 2000)
        counts = [order_minhash.word_counts(x)[None, :] for x in (a, b)]
        assert order_minhash.least_distances(*counts)[0] <= distance
        assert order_minhash.least_distances(*(order_minhash.folded(c, order_minhash.BINS) for c in counts))[0] <= distance


def test_word_count_bound_holds_for_frequent_words_in_bins_of_two_widths():
    a, b = np.uint64(1 << 54), np.uint64(1 << 54 | 1 << 53)  # one bin of 1,024, two of 2,048
    one, other = (np.repeat(np.array([a, b]), n) for n in ((300, 200), (300, 220)))
    counts = [order_minhash.word_counts(x)[None, :] for x in (one, other)]
    assert [c.shape[1] for c in counts] == [1024, 2048]
    assert order_minhash.least_distances(*counts)[0] == 20 == order_minhash.edit_distance(one.tolist(), other.tolist(), 104)
    rows = [(i, len(x), order_minhash.word_counts(x).tobytes(), i, 0, 5, np.array([5, 7 + i])) for i, x in enumerate((one, other))]
    pairs = order_minhash._cross_pairs(pd.DataFrame(rows, columns=["rep", "n_words", "counts", "class_id", "side", "sketch", "sketches"]))
    assert pairs.to_numpy().tolist() == [[0, 1]]


def test_words_of_ascii_texts_are_the_librarys():
    path = public_tokenizers.path("byte_bpe_50k.json")
    real, rng = Tokenizer.from_file(path), np.random.default_rng(6)
    words = mixing_coder._WordIds(open(path, encoding="utf-8").read())
    signs = np.array([*map(chr, range(128)), *" \n\t'''stremvdl0aZ" * 4])
    for text in ["".join(rng.choice(signs, 200)) for _ in range(100)]:
        assert words.of_text(text).tolist() == real.encode(text, add_special_tokens=False).ids


def test_lanes_learn_from_each_other():
    lane = np.random.default_rng(8).integers(0, 50000, 512)
    ids = np.tile(lane, (64, 1))
    for i, row in enumerate(ids):
        row[:] = np.roll(row, 8 * i)
    packed = mixing_coder.encode_blocks(ids)
    assert (mixing_coder.decode_blocks(packed, 512) == ids).all()
    # Alone, a lane of ids that never come twice has nothing to learn from.
    assert sum(map(len, packed)) < 0.7 * 64 * len(mixing_coder.encode_blocks(ids[:1])[0])


def test_texts_split_at_once_are_the_librarys():
    path = public_tokenizers.path("byte_bpe_50k.json")
    real, rng = Tokenizer.from_file(path), np.random.default_rng(7)
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    texts = ["x".join(points[k : k + 4096]) for k in range(0, len(points), 4096)]
    signs = [*"''''stremvdl \n\t  a0.", "ſ", "é", "٣", "<|endoftext|>", "\U0001f600"]
    texts += ["", *("".join(rng.choice(signs, rng.integers(0, 12))) for _ in range(3000)), "'", "'l", "'s's", "''re", " 's", "\n'll", ""]
    words = mixing_coder._WordIds(open(path, encoding="utf-8").read())
    for column in (pa.array(texts), pa.array(["before", *texts])[1:]):
        ids, sizes = words.of_texts(column)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [real.encode(t, add_special_tokens=False).ids for t in texts]
    assert [next(mixing_coder._at_once(pa.array(t))) for t in (["a"], ["a" * (mixing_coder.TEXT_AT_ONCE + 1), "b"], ["a", "b"])] == [(0, 1), (0, 1), (0, 2)]


def test_tasks_of_a_process_share_the_words():
    content = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    words = mixing_coder._words(content)
    words.of_text("shared words")
    assert mixing_coder._words(content) is words and b" words" in words.place


def test_forgetting_words_changes_no_ids(monkeypatch):
    monkeypatch.setattr(mixing_coder, "REMEMBERED", 3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    real, words = Tokenizer.from_file(path), mixing_coder._WordIds(open(path, encoding="utf-8").read())
    for text in ["one two three four five", "two " * 100, "x" * 1000, "one two"]:
        assert words.of_text(text).tolist() == real.encode(text, add_special_tokens=False).ids
    assert len(words.place) < 5
