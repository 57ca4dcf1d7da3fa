"""Taking rows out by key, and every stage of the pipeline against brute force."""

import hashlib
import math
import random
import re
from array import array
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from scalewright.llm import byte_bpe, divergence_rules, membership, order_minhash, quotient_dedup
from scalewright.llm.store import saved

SPACES = " \t\n\x0b\x0c\r"
#: Extra columns bear the names that the operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_chars int, keep_id long, again string, row string, id int, same int, maybe boolean, bits binary, at long, size long, class_id long, content string"


def table(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    return spark.createDataFrame([(*r, 1, -1, "a", "r", 2, 3, True, b"x", 4, 5, 6, "c") for r in rows], DOCS)


def test_rows_by_key(spark):
    rows = spark.range(5000).selectExpr("case when id % 50 = 7 then null else id end as k", "id as maybe", "'x' as bits", "id as row")
    keys = spark.range(0, 5000, 3).selectExpr("id as k").unionByName(spark.sql("select cast(null as long) as k"))
    inside = membership.rows_in(rows, {"k": F.col("k")}, keys)
    outside = membership.rows_not_in(rows, {"k": F.col("k")}, keys, 5000)
    assert inside.columns == outside.columns == rows.columns
    want = {i for i in range(5000) if i % 50 == 7 or i % 3 == 0}
    assert {r["maybe"] for r in inside.collect()} == want
    assert {r["maybe"] for r in outside.collect()} == set(range(5000)) - want
    assert membership.rows_in(rows, {"k": F.col("k")}, keys.where("false")).count() == 0
    assert membership.rows_not_in(rows, {"k": F.col("k")}, keys.where("false"), 5000).count() == 5000


def test_a_full_bitmap_changes_no_result(spark, monkeypatch):
    monkeypatch.setattr(membership, "MOST_POSITIONS", 1 << 15)
    monkeypatch.setattr(membership, "LEAST_POSITIONS", 64)
    rows, keys = spark.range(4000).toDF("k"), spark.range(0, 4000, 2).toDF("k")
    assert sorted(r["k"] for r in membership.rows_not_in(rows, {"k": F.col("k")}, keys, 4000).collect()) == list(range(1, 4000, 2))


def test_rows_that_stay_are_not_shuffled(spark):
    df = membership.rows_not_in(spark.range(1000).withColumn("text", F.lit("t")), {"k": F.col("id")}, spark.range(10).toDF("k"), 1000)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and "strategy=broadcast" in plan and plan.count("Join LeftAnti") == 1


def test_dropping_copies_of_repeated_and_missing_ids(spark):
    rows = [(1, "a b", "en", "s"), (1, "a b", "en", "s"), (1, "ab", "en", "s"), (2, "ab", "en", "s"), (None, "ab", "en", "s"), (None, "z", "en", "s"), (None, "z", "en", "s"), (None, "y", "en", "s"), (3, None, "en", "s"), (4, "", "en", "s")]
    docs = table(spark, rows)
    exact = quotient_dedup.drop_copies(docs)
    assert exact.columns == docs.columns
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in exact.collect()) == [(0, "y"), (0, "z"), (1, "a b"), (3, "")]
    near = order_minhash.drop_near_copies(docs)
    assert near.columns == docs.columns
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in near.collect()) == [(0, "ab"), (0, "y"), (0, "z"), (1, "a b"), (1, "ab"), (3, ""), (4, "")]


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(100, 190)] + [(300, i) for i in range(200, 260)] + [(400 + i, 400 + (i + 1) % 37) for i in range(37)] + [(5, 5), (9, 7), (7, 9)]
    links += [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(160)]
    label = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for a, b in links * 300:
        if a != b and label[a] != label[b]:
            label[a] = label[b] = min(label[a], label[b])
    got = order_minhash.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["id"]: r["class_id"] for r in got} == label and len(got) == len(label)
    assert order_minhash.components(spark.createDataFrame([], "a long, b long")).collect() == []


def bare(text):
    return "".join(c for c in text or "" if c not in SPACES)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def histograms(text, language):
    """Counts by character class, and by common word of the language, the rest last."""
    kinds = Counter()
    for c in text or "":
        import unicodedata

        kind = unicodedata.category(c)
        name = "lower" if kind == "Ll" else "upper" if kind == "Lu" else "space" if c in SPACES else "punctuation" if c in ".,;:!?'\"()-" else "digit" if c in "0123456789" else "symbol" if c in "#*$%&|<>" else "rest"
        kinds[name] += 1
    listed = divergence_rules.COMMON_WORDS.get(language) or sorted({w for ws in divergence_rules.COMMON_WORDS.values() for w in ws})
    n = Counter(words_of(text))
    common = [n[w] for w in listed]
    return [kinds[c] for c in divergence_rules.CLASSES], [*common, sum(n.values()) - sum(common)]


def jensen_shannon(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0)
    return math.sqrt(max(0, (kl(p) + kl(q)) / 2))


def brute_quality(rows):
    """The rows that are kept, and both distances, by the rules as they are described."""
    seen = []
    for _, text, lang, _ in rows:
        language = lang if lang in divergence_rules.COMMON_WORDS else "other"
        words = words_of(text)
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeated = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        seen.append((language, len(words), failed, histograms(text, language)))

    shares = lambda h: [x / max(1, sum(h)) for x in h]

    def references(chosen):
        out = {}
        for language in {s[0] for s in chosen}:
            own = [s[3] for s in chosen if s[0] == language]
            out[language] = [[sum(col) / len(own) for col in zip(*(shares(h[k]) for h in own))] for k in (0, 1)]
        return out

    def judged(known):
        out = []
        for language, n, failed, h in seen:
            ds = [jensen_shannon(shares(h[k]), known[language][k]) if language in known and enough else None for k, enough in ((0, sum(h[0]) >= divergence_rules.LEAST_CHARACTERS), (1, n >= divergence_rules.LEAST_WORDS))]
            near = None in ds or math.sqrt((ds[0] ** 2 + ds[1] ** 2) / 2) <= divergence_rules.LIMIT + divergence_rules.SCATTER / math.sqrt(max(1, n))
            out.append((not failed and near, *ds))
        return out

    first = judged(references([s for s in seen if not s[2]]))
    return judged(references([s for s, j in zip(seen, first) if j[0]]))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[-1] + 1))
    return row[-1]


def brute_near(rows):
    label = {r[0]: r[0] for r in rows}
    for i, x in enumerate(rows):
        for y in rows[:i]:
            a, b = (x[1] or "").split(), (y[1] or "").split()
            if label[x[0]] != label[y[0]] and a and b and 5 * levenshtein(a, b) <= max(len(a), len(b)):
                lo, hi = sorted((label[x[0]], label[y[0]]))
                label = {k: lo if v == hi else v for k, v in label.items()}
    return {k for k, v in label.items() if k == v}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = []
    for lang in ("en", "de", None, "xx"):
        common = divergence_rules.COMMON_WORDS.get(lang, divergence_rules.COMMON_WORDS["en"])
        for _ in range(14):
            words = [rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(rng.randint(55, 75))]
            rows.append(" ".join(words) + ".")
            if rng.random() < 0.3:
                rows.append(rows[-1].replace(" ", "  ", 3))
            if rng.random() < 0.5:
                for at in rng.sample(range(len(words)), 4):
                    words[at] = "changed"
                rows.append(" ".join(words) + ".")
        rows += [None, "", "few words", "### $$$ " * 40, " ".join("a b c".split() * 30)]
        rows = [(r, lang) if not isinstance(r, tuple) else r for r in rows]
    return [(i, text, lang, [None, "s1", "s2"][i % 3]) for i, (text, lang) in enumerate(rows)]


def four(df):
    return sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect())


def test_every_stage_against_brute_force(spark, corpus):
    # Every stage is written and read again, as run() does.
    stages = {name: lambda s, d, sf_dir, f=f, name=name: saved(f(s, d, sf_dir), name) for name, f in corpus_pipeline.STAGES}
    docs = table(spark, corpus)

    judged = {r["doc_id"]: r for r in divergence_rules.assessed(docs).collect()}
    want = brute_quality(corpus)
    assert len({w[0] for w in want}) == 2
    for row, (kept, characters, common) in zip(corpus, want):
        got = judged[row[0]]
        assert got["kept"] == kept, row
        assert (got["character_distance"], got["word_distance"]) == (pytest.approx(characters, abs=1e-6), pytest.approx(common, abs=1e-6))
    left = [r for r, w in zip(corpus, want) if w[0]]
    out = stages["quality_rules"](spark, docs, "")
    assert out.columns == docs.columns and four(out) == left

    best = {}
    for r in left:
        best.setdefault(bare(r[1]), []).append(r)
    left = sorted(min(g, key=lambda r: (-len(r[1]), r[0])) for g in best.values())
    out = stages["exact_dedup"](spark, out, "")
    assert out.columns == docs.columns and four(out) == left

    stay = brute_near(left)
    assert len(stay) < len(left)
    left = [r for r in left if r[0] in stay]
    out = stages["near_dedup"](spark, out, "")
    assert out.columns == docs.columns and four(out) == left

    mix = stages["mix_sources"](spark, out, "")
    assert mix.columns == docs.columns
    times = Counter(r[0] for r in four(mix))
    size = {r[0]: len(words_of(r[1])) for r in left}
    assert set(times) <= set(size) and max(times.values()) <= 2
    assert sum(size[i] * n for i, n in times.items()) == pytest.approx(1.5 * sum(size.values()), rel=0.05)
    assert four(mix) == four(stages["mix_sources"](spark, out.repartition(3), ""))

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    real = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r[0]: r[1] for r in left}
    tokens = stages["encode_tokens"](spark, mix, "").collect()
    assert Counter(r["doc_id"] for r in tokens) == times
    for r in tokens:
        ids = real.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def test_every_stage_of_an_empty_table(spark, corpus):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table(spark, corpus[:2]).where("false"), "").collect() == []
