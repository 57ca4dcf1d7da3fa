"""Clusters, phrases and chat texts against brute force, with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from scalewright.llm import chat_format, drift_clusters, phrase_filters

R = random.Random(11)


# --- clusters


def brute_clusters(vectors, clusters, rounds):
    whole = [(i, [int(np.floor(256.0 * x)) for x in v]) for i, v in vectors]
    order = sorted(whole, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:clusters]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(centres)), key=lambda k: (dist(v, centres[k]), k))
    for _ in range(rounds):
        at = [nearest(v) for _, v in whole]
        for k in set(at):
            mine = [v for (_, v), a in zip(whole, at) if a == k]
            centres[k] = [sum(c) // len(mine) for c in zip(*mine)]
    at = [nearest(v) for _, v in whole]
    d = [dist(v, centres[a]) for (_, v), a in zip(whole, at)]
    fits = lambda s: s if s < 1 << 63 else None
    out = []
    for (i, _), a, one in zip(whole, at, d):
        out.append((i, a, fits(one), fits(sum(x for x, b in zip(d, at) if b == a)), fits(sum(d)), hashlib.sha256(",".join(map(str, centres[a])).encode()).hexdigest()))
    return sorted(out, key=str)


def vectors_of(n, spread=1.0):
    rng = np.random.default_rng(5)
    middle = rng.normal(0, spread, (6, 64))
    return [(i, (middle[i % 6] + rng.normal(0, 0.3, 64)).astype(np.float32).tolist()) for i in range(n)]


COLUMNS = "vec_id long, embedding array<float>, cluster string, v int, lower double"


def test_clusters(spark):
    good = vectors_of(300)
    good += [(7, good[7][1]), (900, good[7][1]), (901, good[7][1]), (None, good[3][1])]
    bad = [(950, None), (951, []), (952, [1.0] * 63), (953, [1.0] * 63 + [None]), (954, [float("nan")] * 64), (955, [1.0] * 63 + [float("inf")])]
    df = spark.createDataFrame([(i, v, "x", 1, 0.5) for i, v in good + bad], COLUMNS).repartition(5)
    got = sorted((tuple(r) for r in drift_clusters.clustered(df, clusters=10).collect()), key=str)
    assert got == brute_clusters(good, 10, 5)
    few = good[:3]
    got = sorted((tuple(r) for r in drift_clusters.clustered(df.where("vec_id < 3")).collect()), key=str)
    assert got == brute_clusters(few, 40, 5)
    assert drift_clusters.clustered(df.where("false")).collect() == []
    assert drift_clusters.clustered(df.where("vec_id >= 950")).collect() == []


def test_clusters_of_very_large_components(spark):
    rows = vectors_of(24) + [(100, [3e38] * 64), (101, [3e38] * 63 + [-3e38]), (102, [1e7] * 64), (103, [1e7] * 63 + [1e7 + 1])]
    df = spark.createDataFrame([(i, v, "x", 1, 0.5) for i, v in rows], COLUMNS)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]  # as stored, in single precision
    got = sorted((tuple(r) for r in drift_clusters.clustered(df, clusters=5, rounds=2).collect()), key=str)
    assert got == brute_clusters(rows, 5, 2)


def test_drift_bound_holds_and_is_tighter():
    rng = np.random.default_rng(3)
    tighter = 0
    for _ in range(300):
        a, centre = rng.normal(0, 3, (2, 4))
        b = a + rng.normal(0, 0.5, 4)
        radius = rng.uniform(0.1, 2)
        inside = rng.normal(0, 1, (400, 4))
        inside = centre + radius * inside / np.linalg.norm(inside, axis=1, keepdims=True)
        nearer = np.linalg.norm(inside - a, axis=1) - np.linalg.norm(inside - b, axis=1)
        bound = drift_clusters.tightened_drift(centre, radius, a, b)
        assert nearer.max() <= bound + 1e-9 <= np.linalg.norm(b - a) + 2e-9
        tighter += bound < 0.9 * np.linalg.norm(b - a)
    assert tighter > 100


def test_bounds_spare_comparisons():
    x = np.floor(256 * np.array([v for _, v in vectors_of(3000)]).astype(float))
    old = drift_clusters.Centroids([[int(c) for c in row] for row in x[:6]])
    cluster, upper, lower = drift_clusters._nearest(old, x)
    new = drift_clusters.Centroids([[int(s) // int((cluster == k).sum()) for s in x[cluster == k].sum(0)] for k in range(6)])
    radius = np.array([upper[cluster == k].max() for k in range(6)])
    got = drift_clusters.reassigned(x, cluster, upper, lower, new, *drift_clusters.drifts(old, new, radius))
    assert (got[0] == drift_clusters._nearest(new, x)[0]).all() and got[3] < len(x) / 10


# --- phrases


def brute_phrases(docs, least, top, share):
    counts, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    out = []
    for (lang, words), a in counts.items():
        if len(words) < 2 or a < least:
            continue
        if len(words) == 2 and any(100 * f >= share * a and f >= least for (g, w), f in counts.items() if g == lang and len(w) == 3 and words in (w[:2], w[1:])):
            continue
        cuts = [(1000000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, counts[lang, words[:k]], counts[lang, words[k:]], n[lang], score))
    ranked = []
    for lang in n:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i, *r[1:]) for i, r in enumerate(mine[:top], 1)]
    return sorted(ranked)


DOCS = "doc_id long, text string, lang string, n long, word string, phrase string"
SOME = [f"w{k}" for k in range(12)] + ["Über", "\x00", "ﬁ", "B"]


def phrase_docs():
    say = lambda k: " ".join(R.choice(SOME[: R.choice((4, 16))]) + R.choice(["", "", "", ".", ",", "\t", "\n", "!"]) for _ in range(k))
    docs = [(R.choice(["en", "de", None, ""]), say(R.choice((0, 3, 60)))) for _ in range(150)]
    return docs + [("en", None), ("en", ""), ("en", " . ; "), ("de", "a b c " * 2000), ("fr", "once only"), ("en", "w1 W2 w3. " * 30), ("en", "w1 W2 w3. " * 30)]


@pytest.mark.parametrize("most_words", [phrase_filters.MOST_WORDS, 9])
def test_phrases(spark, most_words, monkeypatch):
    docs = phrase_docs()
    df = spark.createDataFrame([(i, t, g, 0, "x", "y") for i, (g, t) in enumerate(docs)], DOCS).repartition(3)
    monkeypatch.setattr(phrase_filters, "SLICE_BYTES", 997)  # the long text is cut into many slices
    got = sorted(tuple(r) for r in phrase_filters.collocations(df, least=5, top=60, most_words=most_words).collect())
    assert got == brute_phrases(docs, 5, 60, 50) and len(got) > 70
    if most_words == 9:
        return
    assert phrase_filters.collocations(df.where("false")).collect() == []
    assert phrase_filters.collocations(df, least=10**6).collect() == []


def test_slices_of_a_text_join_up():
    words = [b"a", b"b", b"c", b"d"]
    vocab = phrase_filters.Vocabulary(["en"] * 4, [w.decode() for w in words], None)
    text = b" ".join(R.choice(words) for _ in range(5000))
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": pa.array([text], pa.binary())})
    before, phrase_filters.SLICE_BYTES = phrase_filters.SLICE_BYTES, 101
    try:
        found = Counter(tuple(i[k : k + 3].tolist()) for _, i, _ in phrase_filters._streams(iter([batch]), vocab, 3) for k in range(len(i) - 2))
    finally:
        phrase_filters.SLICE_BYTES = before
    ids = [words.index(w) + 1 for w in text.split()]
    assert found == Counter(tuple(ids[k : k + 3]) for k in range(len(ids) - 2))


@pytest.mark.parametrize("bits", [1, 7, 24, 40, 60, 63])
def test_filters_are_lossless(bits):
    rng = np.random.default_rng(bits)
    keys = rng.integers(0, 1 << bits, 5000, dtype=np.uint64)
    moved = phrase_filters.permuted(keys, bits)
    assert (moved < 1 << bits).all() and (phrase_filters.restored(moved, bits) == keys).all()
    distinct, counts = phrase_filters.counted(moved)
    assert dict(zip(distinct.tolist(), counts.tolist())) == Counter(moved.tolist())
    counts[::3] *= np.uint64(10**12)
    data = phrase_filters.packed_filter(distinct, counts, bits)
    back, of = phrase_filters.opened_filter(data, bits)
    assert (back == distinct).all() and (of == counts).all()
    merged = phrase_filters.counted(np.concatenate([distinct, distinct[::2]]), np.concatenate([counts, counts[::2]]))
    assert (merged[0] == distinct).all() and (merged[1][::2] == 2 * counts[::2]).all() and (merged[1][1::2] == counts[1::2]).all()
    ones = np.ones(len(distinct), np.uint64)
    assert bits < 40 or len(phrase_filters.packed_filter(distinct, ones, bits)) < (bits / 8 + 1) * len(distinct) + 100


# --- chat texts


TURNS = "conv_id long, turn long, role string, text string, part string, n_turns int"


def chat_rows():
    marks = ["</s>", "[INST]", "[/INST]", "<s>", "\\", "<\\/s>", "\\\\", "<</s>/s>", "[[INST]INST]", "ü漢🙂", "\n", "plain words"]
    say = lambda: "".join(R.choice(marks) for _ in range(R.randrange(6)))
    rows = [(c, t, R.choice(["user", "assistant", "system", None, "to</s>ol"]), R.choice([None, say(), say()])) for c in range(40) for t in range(R.randrange(1, 9))]
    rows += [(None, 0, "assistant", "no id"), (None, 1, "user", "none"), (50, None, "user", "first"), (50, 0, "assistant", "b"), (50, 0, "assistant", "a"), (50, 0, "assistant", "a")]
    rows += [(60, 0, "user", "long </s> " * 60_000), (60, 1, "assistant", "[INST] \\ " * 70_000), (60, 2, "user", "bye")]
    return rows + [(70, t, "assistant" if t % 2 else "user", f"turn {t} </s>") for t in range(3000)]


def brute_chat(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in mine)
        loss = "".join(t or "" for _, _, r, t in mine if r == "assistant")
        out.append((conv, len(mine), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [chat_format.BLOCK_BYTES, 300])
def test_chat(spark, block, monkeypatch):
    monkeypatch.setattr(chat_format, "BLOCK_BYTES", block)
    rows = chat_rows()
    df = spark.createDataFrame([(*r, "p", 9) for r in rows], TURNS).repartition(7)
    got = [tuple(r) for r in chat_format.digests(df, chat_format.probe(df)).collect()]
    said = "</s>[INST] ok [/INST]"
    assert sorted((r[:5] for r in got), key=str) == brute_chat(rows + [(-1, 0, "user", said), (-1, 1, "assistant", said)])
    texts = {}
    for r in sorted(chat_format.formatted(df).collect(), key=lambda r: r["part"]):
        texts[r["conv_id"]] = texts.get(r["conv_id"], "") + r["text"]
        data = r["text"].encode()
        for a, b in zip(r["loss_starts"], r["loss_ends"]):
            assert data[:a].endswith(b"[INST]assistant[/INST]") and data[b : b + 4] == b"</s>"
    for conv, _, _, _, _, chars in got:
        if conv != -1:
            assert len(texts[conv]) == chars
            assert texts[conv].count("</s>") == texts[conv].count("[/INST]") == sum(r[0] == conv for r in rows)
    assert chat_format.digests(df.where("false")).collect() == [] and chat_format.formatted(df.where("false")).collect() == []


def test_escapes_are_reversible_and_leave_no_mark():
    for _ in range(2000):
        text = "".join(R.choice("\\<>/s[]INST") for _ in range(R.randrange(12))) + R.choice(["", *chat_format.CONTROLS])
        found = chat_format.escaped(pa.array([text]))[0].as_py()
        assert chat_format.unescaped(found) == text and not any(m in found for m in chat_format.CONTROLS)
