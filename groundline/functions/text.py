"""Text expressions: everything here is a Column in and a Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundline.settings import LAST_UPDATED

# Patterns and abbreviations.
QUOTES = "\"'‘’“”"
QUOTED_SPAN = f"[{QUOTES}][^{QUOTES}]*[{QUOTES}]"
URL = r"""https?://[^\s)\]<>"]+"""
ABBREVIATIONS = ("e.g.", "i.e.", "rs.", "no.", "mr.", "mrs.", "ms.", "dr.", "vs.", "etc.", "approx.", "p.a.", "w.e.f.")
TOKEN = r"\w+|[^\w\s]"
FENCE = r"={2,}\s*(?:BEGIN|END)\s*[A-Z_]+\s*={2,}"
MASK = "\u0001"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def collapse(text: Column) -> Column:
    """Unicode white space to single blanks, trimmed."""
    return F.trim(F.regexp_replace(text_or_empty(text), r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text_or_empty(text), r"(?U)\A\s+|\s+\z", "")


def normalize(text: Column) -> Column:
    return F.lower(collapse(text))


def strip_quoted(text: Column) -> Column:
    return F.regexp_replace(text_or_empty(text), QUOTED_SPAN, " ")


def count_tokens(text: Column) -> Column:
    """The additive counter: words and single signs."""
    return F.regexp_count(text_or_empty(text), F.lit(TOKEN)).cast("int")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text_or_empty(text), F.lit(TOKEN), F.lit(0))


def split_plain_sentences(text: Column) -> Column:
    """Trimmed pieces after each of . ! ? and white space; no abbreviations."""
    pieces = F.transform(F.split(strip(text), r"(?U)(?<=[.!?])\s+"), strip)
    return F.filter(pieces, lambda s: s != "")


def mask_periods(text: Column) -> Column:
    """Periods of abbreviations and of decimals become a mark, so that no sentence ends there; case is kept."""
    out = F.regexp_replace(text_or_empty(text), r"(?<=\d)\.(?=\d)", MASK)
    for a in ABBREVIATIONS:
        stem = a[:-1].replace(".", f"[.{MASK}]")
        # inner periods of an abbreviation stay as they are: they have no white space after them
        out = F.regexp_replace(out, rf"(?i)\b({stem})\.", f"$1{MASK}")
    return out


def split_sentences(text: Column) -> Column:
    pieces = F.split(mask_periods(strip(text)), r"(?U)(?<=[.!?])\s+")
    return F.filter(F.transform(pieces, lambda s: strip(F.replace(s, F.lit(MASK), F.lit(".")))), lambda s: s != "")


def count_sentences(text: Column) -> Column:
    return F.size(split_sentences(text))


def extract_urls(text: Column) -> Column:
    return F.regexp_extract_all(text_or_empty(text), F.lit(URL), F.lit(0))


def bare_url(url: Column) -> Column:
    return F.regexp_replace(url, r"[.,;]+\z", "")


def strip_last_updated(text: Column) -> Column:
    """Without a trailing line that gives the date of the sources."""
    return strip(F.regexp_replace(strip(text), rf"(?i)\s*\Q{LAST_UPDATED}\E\s*[^\n]*\z", ""))


def defang(text: Column) -> Column:
    """Without marks that would open or close a fence of the prompt."""
    return F.regexp_replace(text_or_empty(text), FENCE, "")


def latest_stamp(stamps: Column) -> Column:
    """Aggregate: the greatest stamp that is not blank, or an empty text; stamps order as texts."""
    return F.coalesce(F.max(F.nullif(stamps, F.lit(""))), F.lit(""))


def doc_id(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 12)


def chunk_id(url: Column, path: Column, ordinal: Column) -> Column:
    return F.substring(F.sha1(F.concat(url, F.array_join(path, "|"), ordinal.cast("string"))), 1, 12)


def text_key(text: Column) -> Column:
    return F.sha1(text)
