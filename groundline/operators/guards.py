"""Classifiers of questions and answers, the cascade, and what a refusal says."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.functions import text as tx
from groundline.settings import ADVICE_REFUSAL, DEFAULT, EDUCATION_LINK, OUT_OF_CORPUS, PERFORMANCE_REFUSAL, PII_REFUSAL, Settings

# Patterns of each class; BRAND stands for an optional brand name.
ADVICE = (
    r"\bshould i\b",
    r"\bwhich (is|one) (is )?better\b",
    r"\bis it (good|worth|safe)\b",
    r"\brecommend",
    r"\bsuggest",
    r"\bworth buying\b",
    r"\bbuy or sell\b",
    r"\ballocat",
    r"\bportfolio for me\b",
    r"\bbest (scheme|fund|option)\b",
    r"\b(best|highest|top) returns?\b",
    r"\bwhich BRAND(fund|scheme|one)\b[^?]{0,40}\breturns?\b",
    r"\bcan i invest in\b",
    r"\bwhich fund should\b",
    r"\bopinion\b",
)
PII = {
    "pan": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
    "aadhaar": r"\b[2-9]\d{3}\s?\d{4}\s?\d{4}\b",
    "phone": r"\b(?:\+?91[- ]?)?[6-9]\d{9}\b",
    "email": r"[\w.+-]+@[\w-]+\.[\w.]+",
    "account": r"\b(acct|account|folio)(?:\s*(?:no\.?|num(?:ber)?|is|was|:|=))*\s*\d{6,}\b",
    "otp": r"\b(otp|one time password)(?:\s*(?:is|was|:|=))*\s*\d{4,6}\b",
}
PERFORMANCE = (r"\breturns? of\b", r"\bcagr\b", r"\bbest performing\b", r"\bwhich gave.*return", r"\bperformance vs\b", r"\b1 year return\b", r"\bsince inception return\b", r"\bnav history\b")
PROJECTION = (
    r"\b(expected|projected|forecast|estimated|likely|potential)\b[^.]{0,40}\breturn",
    r"\bwill (return|grow|give|yield|rise|fall)\b",
    r"\bshould (return|grow|give|yield)\b",
    r"\bguarantee[sd]?\b",
    r"\bdouble your money\b",
    r"\bhow much will\b",
    r"\b(target|assumed) return\b",
)
# A negation within the 24 characters before a match; the window's edge counts as a word's.
NEGATIONS = ("not", "n't", "never", "avoid")
NEGATED = "(?<!" + "|".join(rf"\b{w}\b.{{0,{24 - len(w)}}}|{w}\b.{{{24 - len(w)}}}" for w in NEGATIONS) + ")"


def any_of(text: Column, patterns: tuple[str, ...], flags: str = "(?iU)", before: str = "") -> Column:
    return reduce(Column.__or__, (text.rlike(f"{flags}{before}{p}") for p in patterns))


def advice_patterns(settings: Settings = DEFAULT) -> tuple[str, ...]:
    brand = f"({re.escape(settings.brand)} )?" if settings.brand else ""
    return tuple(p.replace("BRAND", brand) for p in ADVICE)


def is_advice(text: Column, settings: Settings = DEFAULT, negation: bool = True) -> Column:
    """Some match of some pattern, outside quoted spans, that no negation precedes."""
    body = tx.strip_quoted(text)
    found = any_of(body, advice_patterns(settings))
    # looking back is slow, and few texts have a match to look back from
    return found & any_of(body, advice_patterns(settings), "(?isU)", NEGATED) if negation else found


def pii_names(text: Column, strict: bool = False) -> Column:
    """Names of the kinds found, in a fixed order; `strict` ignores case."""
    body = tx.text_or_empty(text)
    found = [F.when(body.rlike(("(?iU)" if strict else "(?U)") + p), F.lit(name)) for name, p in PII.items()]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def is_performance(text: Column) -> Column:
    return any_of(tx.text_or_empty(text), PERFORMANCE)


def is_projection(text: Column) -> Column:
    return any_of(tx.strip_quoted(text), PROJECTION)


def check(questions: DataFrame, column: str = "question", settings: Settings = DEFAULT) -> DataFrame:
    """Adds action, refusal_type, matched_names, query, query_chars, truncated and warnings."""
    raw, limit = tx.text_or_empty(F.col(column)), settings.max_query_chars
    rows = questions.withColumns({"query_chars": F.length(raw), "truncated": F.length(raw) > limit, "_text": F.substring(raw, 1, limit)})
    rows = rows.withColumns({"_advice": is_advice(F.col("_text"), settings), "_pii": pii_names(F.col("_text")), "_performance": is_performance(F.col("_text"))})
    kind = F.when(F.col("_advice"), "advice").when(F.size("_pii") > 0, "pii").when(F.col("_performance"), "performance")
    rows = rows.withColumn("refusal_type", kind)
    names = F.when(F.col("refusal_type") == "pii", F.col("_pii")).when(F.col("refusal_type").isNotNull(), F.array("refusal_type")).otherwise(F.array().cast("array<string>"))
    warnings = F.array(F.when(F.col("truncated"), F.lit(f"query truncated to {limit} characters")), F.when(F.col("refusal_type") == "pii", F.lit("query discarded; not embedded or stored")))
    return rows.withColumns({
        "action": F.when(F.col("refusal_type").isNull(), "answer").otherwise("refuse"),
        "matched_names": names,
        "query": F.when(F.col("refusal_type").isNull(), F.col("_text")).otherwise(""),
        "warnings": F.filter(warnings, lambda w: w.isNotNull()),
    }).drop("_text", "_advice", "_pii", "_performance")


def link(scheme: Column, settings: Settings = DEFAULT) -> Column:
    """The scheme's page, or the home page."""
    out = F.lit(settings.home_url)
    for slug, url in settings.scheme_urls:
        out = F.when(scheme == slug, F.lit(url)).otherwise(out)
    return out


def refusal_text(kind: Column, scheme: Column, settings: Settings = DEFAULT) -> Column:
    """An unknown kind is an error; null stays null."""
    page = F.concat(F.lit("\n\nOfficial page: "), link(scheme, settings))
    said = (
        F.when(kind == "advice", F.lit(f"{ADVICE_REFUSAL}\n\nLearn more: {EDUCATION_LINK}"))
        .when(kind == "pii", F.lit(PII_REFUSAL))
        .when(kind == "performance", F.concat(F.lit(PERFORMANCE_REFUSAL), page))
        .when(kind == "out_of_corpus", F.concat(F.lit(OUT_OF_CORPUS), page))
    )
    return F.when(kind.isNull(), F.lit(None)).otherwise(F.coalesce(said, F.raise_error(F.concat(F.lit("unknown refusal type "), kind))))
