"""The corpus pipeline: stages that read documents and write what they keep, and packing at the end.

Every stage gives no rows for an empty table, takes very long texts whole, and judges repeated rows alike (near duplicates keep one of them);
all but packing keep the other columns, whatever their names, and packing leaves them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.llm import common, neardup, packing, pii, quality, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network calls toxic go; it learns from the labels of documents that are not held out.

    A null or empty text has no window and stays; repeated rows are judged alike; other columns are kept, whatever their names.
    """
    network = toxicity.fit(docs, common.read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, network)
    return scored.filter(F.col(scored.columns[-1]) < 0.5).drop(scored.columns[-1])


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far from every language's reference go; null and empty texts, without 50 words, go too, and so does each of some repeated rows or none."""
    return quality.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the least id's: five-word shingles, similarity 0.8 or more.

    A text without words is linked with nothing and stays; of rows of one id the least text stays, and rows without an id all stay.
    """
    return neardup.deduplicate(docs, percent=80)


def sanitize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Base spans become words for their kinds and disclosing terms go; every row stays, and a null text stays null."""
    return pii.sanitize(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a packed sequence, with its ids; a null text counts as an empty one and gives the end's id alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("personal data", sanitize),
    ("packing", pack),
]
#: A trained network and a tokenizer have no SQL; tests hold the operators of the stages against plain Python, and the stages against edge cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
