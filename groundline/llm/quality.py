"""Quality rules by the divergence of distributions, in DataFrame functions alone.

For every text the histogram of its character classes and that of its common words are compared to
references of languages by Jensen-Shannon distance (the square root of the divergence in bits).  A
reference is a sum over the core of a language's documents that pass the base rules: the half whose
character classes are nearest to the sum of them all.  A document is rejected if it fails the base rules, or if its histogram of either kind is farther than a limit from
every language's, unless it is too short for that kind (the minimum-length guards).

Defined results: a null or empty text has no words and fails the base rules; where no language has a
reference, only the base rules count, and so they do for a text that is marked as of a language without one (one without a mark
is compared to all); repeated rows each give a row and count as often; an empty table gives no rows; other columns are kept by
`keep`, whatever their names, and ignored by `judge`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.llm import common

# Frequent function words of each language.
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "un", "del", "las"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une"),
}
WORDS = tuple(sorted({w for ws in COMMON_WORDS.values() for w in ws}))
# Digits are left out, as numbers in prose are no fault.
CLASSES = ("lower", "upper", "blank", "punct", "other")
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Limits of the distances, and words and characters from which each is asked for.
CLASS_LIMIT, CLASS_GUARD = 0.18, 200
WORD_LIMIT, WORD_GUARD = 0.305, 150
#: Distances are counted in so many steps from 0 to 1.
STEPS = 10_000


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words in windows of this width that come twice or more, counting each word once."""
    n = F.size(words)

    def covered(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return let(ordered, lambda s: let(F.sort_array(F.transform(twice(s), lambda e: e["i"])), union))

    def twice(s: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(s, k)["g"] == e["g"], F.lit(False))
        return F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1))

    def union(places: Column) -> Column:
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
        return F.aggregate(places, zero, lambda acc, p: F.struct((p + width).alias("end"), (acc["total"] + width - F.greatest(F.lit(0), acc["end"] - p)).alias("total")), lambda acc: acc["total"])

    grams = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    counted = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
    return F.when(n < width, F.lit(0)).otherwise(counted)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", whole: bool = False) -> DataFrame:
    """A row for each document: the base figures and both histograms; with `whole` also the row itself, as `row`."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    text = F.col("_text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang") if lang_col in docs.columns else F.lit(None).cast("string").alias("lang"), common.text_or_empty(text_col).alias("_text"), *row)
    lines = let(F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0), lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def of_words(w: Column) -> Column:
        found = F.transform(F.filter(w, lambda x: F.lower(x).isin(*WORDS)), F.lower)
        counts = let(found, lambda f: F.transform(F.array(*map(F.lit, WORDS)), lambda k: F.size(F.filter(f, lambda x: x == k))))
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"), counts.alias("words"))

    rows = rows.select(
        *["row"] * whole, "doc_id", "lang", F.length(text).alias("n"), without(text, SPACE).cast("long").alias("word_chars"),
        without(text, r"\P{L}+").alias("letters"), without(text, r"\P{Lu}+").alias("upper"), without(text, "[^0-9]+").alias("digit"), without(text, r"""[^.,;:!?'"()-]+""").alias("punct"),
        without(text, f"[^{SYMBOLS}]+").cast("long").alias("n_symbols"), lines.cast("long").alias("n_dup_lines"), let(words_of(text), of_words).alias("of"),
    ).select("*", "of.*")
    blank = F.col("n") - F.col("word_chars")
    parts = {"lower": F.col("letters") - F.col("upper"), "upper": F.col("upper"), "blank": blank, "punct": F.col("punct"), "other": F.col("word_chars") - F.col("letters") - F.col("digit") - F.col("punct")}
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.select(*["row"] * whole, "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "n", F.array(*[parts[c].cast("long") for c in CLASSES]).alias("classes"), "words")


def language_references(rows: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """For each language with a word list: shares of the character classes, and of its common words and all others."""
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.col("words")[i]).alias(f"w{i}") for i in range(len(WORDS))]
    found = rows.filter(~F.col("base_failed") & F.col("lang").isin(*COMMON_WORDS)).groupBy("lang").agg(F.sum("n_words").alias("total"), *sums).collect()
    out = {}
    for r in found:
        chars = [r[f"c{i}"] for i in range(len(CLASSES))]
        words = [r[f"w{WORDS.index(w)}"] for w in COMMON_WORDS[r["lang"]]]
        words.append(r["total"] - sum(words))
        if sum(chars) and r["total"]:
            out[r["lang"]] = ([c / sum(chars) for c in chars], [w / r["total"] for w in words])
    return out


def js_distance(counts: Column, shares: list[float]) -> Column:
    """Between the histogram of counts and given shares; 1 if the counts are all 0."""
    q = F.array(*[F.lit(float(x)) for x in shares])
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)

    def terms(n: Column) -> Column:
        return F.zip_with(counts, q, lambda c, s: (part(c / n, (c / n + s) / 2) + part(s, (c / n + s) / 2)) / 2)

    divergence = let(total, lambda n: F.aggregate(terms(n), F.lit(0.0), lambda s, x: s + x))
    return F.when(total > 0, F.sqrt(F.greatest(divergence, F.lit(0.0)))).otherwise(F.lit(1.0))


def with_distances(rows: DataFrame, references: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    """Adds the distances to the nearest language."""
    nearest = lambda cs: F.least(*cs) if len(cs) > 1 else cs[0]
    own = lambda lang: [F.col("words")[WORDS.index(w)].cast("long") for w in COMMON_WORDS[lang]]
    rows = rows.withColumn("class_distance", nearest([js_distance(F.col("classes"), chars) for chars, _ in references.values()]))
    return rows.withColumn("word_distance", nearest([js_distance(F.array(*own(k), F.col("n_words") - sum(own(k), F.lit(0))), words) for k, (_, words) in references.items()]))


def js_distance_of(counts: list[int], shares: list[float]) -> float:
    """The same in Python, for tests."""
    n = sum(counts)
    if not n:
        return 1.0
    total = 0.0
    for c, s in zip(counts, shares, strict=True):
        m = (c / n + s) / 2
        total += sum(a * math.log2(a / m) for a in (c / n, s) if a > 0) / 2
    return math.sqrt(max(total, 0.0))


def medians(rows: DataFrame) -> dict[str, float]:
    """The median of class_distance by language, in steps of 1 / STEPS: the same however rows are dealt, and a few rows for the driver."""
    step = F.ceil(F.col("class_distance") * STEPS)
    counts: dict[str, list[tuple[int, int]]] = {}
    for r in rows.groupBy("lang", step.alias("step")).agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["lang"], []).append((r["step"], r["n"]))
    out = {}
    for lang, steps in counts.items():
        left = sum(n for _, n in steps) / 2
        for s, n in sorted(steps):
            left -= n
            if left <= 0:
                out[lang] = s / STEPS
                break
    return out


def verdicts(docs: DataFrame, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT, class_guard: int = CLASS_GUARD, word_guard: int = WORD_GUARD, **columns) -> DataFrame:
    """The features with the distances and kept."""
    rows = common.materialize(features(docs, **columns), "quality")
    references = language_references(rows)
    if references:
        core = with_distances(rows, references)
        limits = medians(core.filter(~F.col("base_failed") & F.col("lang").isin(*references)))
        near = F.lit(False)
        for lang, limit in limits.items():
            near = near | ((F.col("lang") == lang) & (F.col("class_distance") <= limit))
        rows = with_distances(rows, language_references(core.filter(near)))
    else:
        rows = rows.withColumns({"class_distance": F.lit(0.0), "word_distance": F.lit(0.0)})
    far = ((F.col("n") >= class_guard) & (F.col("class_distance") > class_limit)) | ((F.col("n_words") >= word_guard) & (F.col("word_distance") > word_limit))
    # what is marked as of a language without a reference cannot be compared to its own
    known = F.col("lang").isNull() | F.col("lang").isin(*references) if references else F.lit(False)
    return rows.withColumn("kept", ~F.col("base_failed") & ~(far & known))


def judge(docs: DataFrame, **options) -> DataFrame:
    """doc_id, the base figures, base_failed, class_distance, word_distance and kept."""
    return verdicts(docs, **options).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def keep(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the rules keep, with their columns."""
    return verdicts(docs, whole=True, **options).filter("kept").select("row.*")
