"""Quality rules by distribution divergence, in DataFrame operations only.

Two histograms describe a document: its characters by class, and its words by common word of its
language.  Language references are the mean histograms of all documents that pass the base rules, each
document counting once; a second round leaves out those that the first references reject.  A document is
rejected when the root mean square of its two Jensen-Shannon distances is above a limit that is wider for
fewer words, since short histograms scatter more.  A document with too few entries isn't judged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .membership import rows_not_in
from .store import saved
from .text import SPACE_CLASS, SPACES, words

# Frequent function words of each language, as written in running text.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in a is that for it as was with be by on are from or this".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus au sur".split(),
}
#: Documents in other languages, or in none, share one reference, with the words of all.
OTHER = "other"
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "space", "punctuation", "digit", "symbol", "rest")
#: A document is kept up to a distance (base 2, 0 to 1) of LIMIT + SCATTER / sqrt(words).
LIMIT, SCATTER = 0.12, 1.0
#: Histograms with fewer characters or words aren't judged.
LEAST_CHARACTERS, LEAST_WORDS = 200, 50
#: Shares are summed as whole parts of this, so that sums don't depend on the order of addition.
UNIT = 1_000_000_000
#: Hash of the window of ``words`` at ``i``.
WINDOW_HASH = "xxhash64(words[i], words[i + 1], words[i + 2])"


def _remaining(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def features(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, language, characters, common, barrier).

    ``barrier`` keeps the optimizer from pushing a filter on the verdict below this point, where it would
    inline, and so repeat, the work behind every column.
    ``row`` is the whole input row as a struct.  Null texts have no words.  Work and memory are linear in
    the length of a text (n log n for the sort of its windows).
    """
    body = F.coalesce(F.col("row").getField(text), F.lit(""))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    df = df.withColumn("body", body).withColumn("words", words(F.col("row").getField(text)))
    df = df.withColumn("language", F.coalesce(F.col("row").getField(lang), F.lit(OTHER))).withColumn("n", F.size("words"))
    df = df.withColumn("language", F.when(F.col("language").isin(*COMMON_WORDS), F.col("language")).otherwise(OTHER))

    # What is left of the text after one class of characters after the other is deleted.
    df = df.withColumn("r1", _remaining(F.col("body"), "\\p{Ll}+"))
    df = df.withColumn("r2", _remaining(F.col("r1"), "\\p{Lu}+")).withColumn("r3", _remaining(F.col("r2"), SPACE_CLASS + "+"))
    df = df.withColumn("r4", _remaining(F.col("r3"), "[.,;:!?'\"()\\-]+")).withColumn("r5", _remaining(F.col("r4"), "[0-9]+"))
    df = df.withColumn("r6", _remaining(F.col("r5"), "[#*$%&|<>]+"))
    length = [F.char_length(c) for c in ("body", "r1", "r2", "r3", "r4", "r5", "r6")]
    characters = F.array(*[(a - b).cast("long") for a, b in zip(length, length[1:])], length[-1].cast("long"))

    # A key is the hash of a window of three words above, its position below; equal windows sort together.
    # The hash is cut, so neighbours with one hash are compared word by word.  Should a text hold two windows
    # of different words under one hash, its windows themselves are sorted instead.
    df = df.withColumn("bits", F.expr("cast(ceil(log2(greatest(n, 2))) as int) + 1"))
    keys = F.expr(f"case when n >= 3 then sort_array(transform(sequence(0, n - 3), i -> coalesce(shiftleft({WINDOW_HASH}, bits) | cast(i as bigint), 0L))) else cast(array() as array<bigint>) end")
    df = df.withColumn("keys", keys)
    twins = F.expr("""filter(zip_with(slice(keys, 1, greatest(size(keys) - 1, 0)), slice(keys, 2, greatest(size(keys) - 1, 0)),
        (a, b) -> case when shiftright(a, bits) = shiftright(b, bits)
            then array(cast(a & (shiftleft(1L, bits) - 1) as int), cast(b & (shiftleft(1L, bits) - 1) as int)) end), x -> x is not null)""")
    df = df.withColumn("twins", twins)
    df = df.withColumn("mistaken", F.expr("exists(twins, t -> words[t[0]] != words[t[1]] or words[t[0] + 1] != words[t[1] + 1] or words[t[0] + 2] != words[t[1] + 2])"))
    windows = F.expr("case when mistaken then sort_array(transform(sequence(0, n - 3), i -> struct(concat_ws(' ', words[i], words[i + 1], words[i + 2]) as said, i as at))) end")
    df = df.withColumn("windows", windows)
    same = F.expr("""case when mistaken then filter(zip_with(slice(windows, 1, size(windows) - 1), slice(windows, 2, size(windows) - 1),
        (a, b) -> case when a.said = b.said then array(a.at, b.at) end), x -> x is not null) else twins end""")
    df = df.withColumn("same", same)
    df = df.withColumn("starts", F.expr("sort_array(array_distinct(flatten(same)))"))
    covered = F.expr("""case when size(starts) = 0 then 0L else 3L + aggregate(zip_with(slice(starts, 1, size(starts) - 1), slice(starts, 2, size(starts) - 1),
        (p, q) -> least(3L, cast(q - p as bigint))), 0L, (s, x) -> s + x) end""")
    df = df.withColumn("n_repeat_words", covered)

    lines = F.filter(F.split("body", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = df.withColumn("lines", lines)

    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    df = df.withColumn("hits", F.filter("words", lambda x: x.isin(*every)))
    listed = reduce(lambda other, k: F.when(F.col("language") == k, F.array(*map(F.lit, COMMON_WORDS[k]))).otherwise(other), COMMON_WORDS, F.array(*map(F.lit, every)))
    df = df.withColumn("listed", listed)
    df = df.withColumn("counts", F.expr("transform(listed, c -> cast(size(hits) - size(array_remove(hits, c)) as bigint))"))
    common = F.expr("concat(counts, array(n - aggregate(counts, 0L, (s, x) -> s + x)))")
    n_words = F.col("n").cast("long")
    return df.select(
        "row",
        n_words.alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.octet_length("r5") - F.octet_length("r6")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((n_words < 50) | (100 * F.col("n_repeat_words") > 50 * n_words)).alias("base_failed"),
        "language",
        characters.alias("characters"),
        common.alias("common"),
        F.monotonically_increasing_id().alias("barrier"),
    )


def _shares(counts: str) -> Column:
    total = f"greatest(1L, aggregate({counts}, 0L, (s, x) -> s + x))"
    return F.expr(f"transform({counts}, x -> cast(floor(x * {UNIT}D / {total}) as bigint))")


def references(measured: DataFrame) -> DataFrame:
    """(reference_language, character_reference, word_reference): at most one row per known language and one more."""
    good = measured.where(~F.col("base_failed")).select("language", _shares("characters").alias("c"), _shares("common").alias("w"))
    most = len({w for ws in COMMON_WORDS.values() for w in ws}) + 1
    sums = [F.sum(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(most)]
    summed = good.groupBy("language").agg(F.count(F.lit(1)).alias("docs"), *sums)

    def mean(names: list[str]) -> Column:
        return F.filter(F.array(*[F.col(x) / F.col("docs") / UNIT for x in names]), lambda x: x.isNotNull())

    return summed.select(F.col("language").alias("reference_language"), mean([f"c{i}" for i in range(len(CLASSES))]).alias("character_reference"), mean([f"w{i}" for i in range(most)]).alias("word_reference"))


def distance(counts: str, reference: str) -> Column:
    """Jensen-Shannon distance of a histogram of counts to a reference of shares."""
    total = f"greatest(1L, aggregate({counts}, 0L, (s, x) -> s + x))"
    term = "case when {a} > 0 then {a} * log2(2 * {a} / ({p} + {q})) else 0D end"
    p, q = f"(x / {total})", "y"
    both = f"({term.format(a=p, p=p, q=q)} + {term.format(a=q, p=p, q=q)}) / 2"
    return F.expr(f"sqrt(greatest(0D, aggregate(zip_with({counts}, {reference}, (x, y) -> {both}), 0D, (s, v) -> s + v)))")


def verdicts(measured: DataFrame, language_references: DataFrame) -> DataFrame:
    """``measured`` with character_distance, word_distance (null: not judged) and kept.

    ``language_references`` has a row per known language at most, so that it is broadcast.  Without a reference for a language (no document of it passed the base rules) nothing is judged.
    """
    judged = measured.join(F.broadcast(language_references), F.col("language") == F.col("reference_language"), "left")
    n_characters = F.expr("aggregate(characters, 0L, (s, x) -> s + x)")
    judged = judged.withColumn("character_distance", F.when(n_characters >= LEAST_CHARACTERS, distance("characters", "character_reference")))
    judged = judged.withColumn("word_distance", F.when(F.col("n_words") >= LEAST_WORDS, distance("common", "word_reference")))
    joint = F.sqrt((F.pow("character_distance", F.lit(2)) + F.pow("word_distance", F.lit(2))) / 2)
    near = F.coalesce(joint <= LIMIT + SCATTER / F.sqrt("n_words"), F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & near & (F.col("barrier") >= 0))


def trimmed_references(measured: DataFrame) -> DataFrame:
    """References of the documents that references of all documents keep."""
    return references(verdicts(measured, references(measured)).where("kept").select(*measured.columns))


def assessed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, the base figures, base_failed, kept and both distances.

    Null and empty texts fail the base rules.  Repeated rows are judged alike.  Null or unknown languages
    are compared with the pooled reference.
    """
    needed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    measured = features(needed)
    measured = saved(measured.select(F.col("row.doc_id").alias("doc_id"), *[c for c in measured.columns if c != "row"]), "divergence-features")
    out = verdicts(measured, saved(trimmed_references(measured), "divergence-references"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "character_distance", "word_distance")


def _content(text: str, lang: str) -> Column:
    """What the verdict depends on, as a digest; null and empty are judged alike."""
    return F.sha2(F.concat(F.coalesce(F.col(f"`{lang}`"), F.lit("")), F.lit("\n"), F.coalesce(F.col(f"`{text}`"), F.lit(""))), 256)


def kept_documents(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns kept; null and empty texts go.

    Texts are measured once.  Rows that stay are never shuffled: what is rejected is taken out by the digest
    of its text and language.
    """
    measured = features(docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")))
    content = F.sha2(F.concat(F.coalesce("row.lang", F.lit("")), F.lit("\n"), F.coalesce("row.text", F.lit(""))), 256)
    measured = saved(measured.select(content.alias("content"), "n_words", "base_failed", "language", "characters", "common", "barrier"), "divergence-features")
    known = saved(trimmed_references(measured), "divergence-references")
    n = measured.count()
    rejected = saved(verdicts(measured, known).where("not kept").select("content").distinct(), "divergence-rejected", n)
    return rows_not_in(docs, {"content": _content(text, lang)}, rejected, n)
