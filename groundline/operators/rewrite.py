"""Rewriting of questions: synonyms and the scheme that they name."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundline.functions import text as tx
from groundline.settings import DEFAULT, Settings


def expand(question: Column, settings: Settings = DEFAULT) -> Column:
    """The normalised question followed by variants of the terms that it holds.

    Variants are added while the whole stays within the ratio; one for each question may exceed it, and a later one
    that would ends its own term's list.  A variant that already stands there as a single word is left out.
    """
    entries = [F.struct(F.lit(i).alias("term"), F.lit(rf"(?iU)\b{re.escape(term)}\b").alias("pattern"), F.lit(v).alias("variant")) for i, (term, variants) in enumerate(settings.synonyms) for v in variants]
    text = tx.normalize(question)
    if not entries:
        return text

    def fold(original: Column) -> Column:
        cap = F.floor(F.length(original) * settings.expansion_ratio)
        start = F.struct(original.alias("out"), F.lit(False).alias("forced"), F.lit(-1).alias("closed"))

        def step(state: Column, e: Column) -> Column:
            candidate = F.concat(state["out"], F.lit(" "), e["variant"])
            asked = F.rlike(original, e["pattern"]) & (state["closed"] != e["term"]) & ~F.array_contains(F.split(state["out"], " "), e["variant"])
            fits = F.length(candidate) <= cap
            added = asked & (fits | ~state["forced"])
            return F.struct(
                F.when(added, candidate).otherwise(state["out"]).alias("out"),
                (state["forced"] | (asked & ~fits)).alias("forced"),
                F.when(asked & ~fits & state["forced"], e["term"]).otherwise(state["closed"]).alias("closed"),
            )

        return F.aggregate(F.array(*entries), start, step, lambda s: s["out"])

    return F.when(text == "", text).otherwise(F.transform(F.array(text), fold)[0])


def detect_scheme(question: Column, settings: Settings = DEFAULT) -> Column:
    """The slug of the one scheme that the question names; null for none or several."""
    text = tx.normalize(question)
    found = [F.when(text.rlike("(?iU)" + "|".join(rf"\b{re.escape(a)}\b" for a in names)), F.lit(slug)) for slug, names in settings.named() if names]
    hits = F.filter(F.array(*found), lambda s: s.isNotNull())
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def without_scheme(question: Column, settings: Settings = DEFAULT) -> Column:
    """The normalised question without the names of schemes, the brand before them and what usually follows; as it was where nothing is left."""
    text = tx.normalize(question)
    names = sorted({n for _, names in settings.named() for n in names}, key=lambda n: (-len(n), n))
    if not names:
        return text
    brand = rf"(?:{re.escape(settings.brand.lower())} )?" if settings.brand else ""
    spelled = "|".join(map(re.escape, names))
    rest = F.regexp_replace(text, rf"(?iU)(?:\b(?:of|in|for|on) )?(?:\bthe )?\b{brand}(?:{spelled})\b{settings.scheme_tail}\b", " ")
    rest = tx.collapse(F.regexp_replace(rest, r"\s+([?.!,])", "$1"))
    return F.when(F.length(F.regexp_replace(rest, r"(?U)\W", "")) == 0, text).otherwise(rest)
