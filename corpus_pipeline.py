"""A training corpus from ``documents``: language, near copies, benchmark passages, personal data, tokens.

Each stage takes all that the one before kept, as ``(spark, docs, sf_dir)``, and returns a
DataFrame that is written as Parquet and read again for the next. All but the last return the
columns of ``documents``, whatever others the table has.
"""

from __future__ import annotations

import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import decontaminate, langid, pii, sentencepieces, simhash
from mosaiq.llm.common import remove, shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Cosine with the nearest language under which a text counts as in none. Clean texts of a few words lie as low as chance
#: does (0.03), so it only rejects what no trigram speaks for.
LEAST_SCORE = 0.02
#: Near copies share this much of their shingles of so many words.
SHINGLE, SIMILARITY = 5, Fraction(4, 5)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; those without letters, or like none of the languages, go.

    Prototypes are learnt from all documents with a lang that aren't held out. A document without a
    lang gets the predicted one; a given lang stays.
    """
    docs = docs.select(*COLUMNS)
    model = langid.prototypes(docs.where(~langid.held_out()))
    found = langid.identify(docs, model, COLUMNS)
    if model:  # with nothing learnt, nothing can be rejected
        found = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
        found = found.withColumn("lang", F.coalesce("lang", "lang_pred"))
    return found.select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less near copies of one with a smaller doc_id, by SimHash classes and exact shingle similarity."""
    return simhash.deduplicate(docs.select(*COLUMNS), SHINGLE, SIMILARITY).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the contract's rule, less benchmark passages of whole windows."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind in brackets."""
    docs = docs.select(*COLUMNS)
    return pii.redact(docs, pii.trained(docs)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's piece ids, with doc_id, lang and source."""
    return sentencepieces.encode(docs, sentencepieces.Pieces.read(sentencepieces.MODEL), ("doc_id", "lang", "source"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: The language and personal data models aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written to the shared folder.

    A stage's files go once the next stage's are written; those that the last one reads stay.
    """
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{at}/{k}-{name}")
            docs = spark.read.parquet(f"{at}/{k}-{name}")
            if before:
                remove(spark, before)
            before = f"{at}/{k}-{name}"
    return docs
