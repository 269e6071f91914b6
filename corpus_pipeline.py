"""A training-data pipeline over the documents table.

Stages, in order: language identification, near-duplicate removal, benchmark
decontamination, redaction of personal data, and packing.  Each takes what
its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollstats.llm import decontaminate, language, packing, pii, simhash
from rollstats.llm.common import columns_of, discard, fresh, saved, table

#: A document whose share of known n-grams is lower is in none of the learned languages.
MIN_LANGUAGE_SCORE = 0.3

#: The stages are not SQL: they are tested against brute force.
ORACLE_SQL = None


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and documents in none of the learned languages.

    So null and empty texts go; repeated rows stay or go together; ties between languages
    do not matter here; an empty table gives no rows.  Without any labelled row nothing is learned, and all go.
    """
    model = language.train(docs)
    label, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    judged = language.identify(docs, model, label_col=label, score_col=score)
    kept = (F.col(label) != language.UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE)
    return judged.where(kept).select(*columns_of(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id stays.

    Ties and null ids go by the place of the row, null ids last; null and empty texts
    are one group; repeated rows are copies; an empty table gives no rows.
    """
    return simhash.first_of_each_group(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null and empty texts hold none and stay; equal texts stay or go together; an empty
    benchmark keeps all rows, and an empty table gives none.
    """
    return decontaminate.clean_of(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in angle brackets; lengths follow.

    Every row stays: a null text stays null, with a null length, an empty one empty.  Of spans that
    overlap the first counts; repeated rows are treated alike; an empty table gives no rows.
    """
    spans = fresh(docs, "pii_spans")
    found = pii.find_pii(docs, rules_col=fresh(docs, "pii_rules"), spans_col=spans)
    return found.withColumn("text", pii.redacted(F.col("text"), F.col(spans))).withColumn(
        "n_chars", F.length("text").cast("long")
    ).select(*columns_of(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into windows.

    A null or empty text is its end id alone; repeated rows are packed as often as they
    come; ties between equal pieces go by row; an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_copies),
    ("pii_redaction", redact_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; a stage's table goes once the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
