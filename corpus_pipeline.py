"""A training-data pipeline over the documents table: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents, and each works on what the stage before it kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scorelattice.llm import decontam, lang_id, mixing, pii, simhash
from scorelattice.llm.common import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language: no letter at all, or n-grams like those of no profile.

    Profiles and least scores come from every row with a text and a language outside the held-out fold.
    Null and empty texts have no letter and go; a null id or language doesn't matter; a very long text is read
    whole; repeated rows are judged each; without a training row nothing is known and all go; an empty table
    gives no rows; extra columns, whatever their names, are kept.
    """
    profiles = lang_id.train(docs)
    return lang_id.keep_known(docs, profiles, lang_id.floors(docs, profiles))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each SimHash group; rows of other groups stay, whatever their ids.

    Null texts, and texts without words, have fingerprint zero and are one group; a null id comes after all
    others, and rows without one are told apart by their content; of rows alike in every column one stays;
    an empty table gives no rows; extra columns are kept.
    """
    return simhash.kept_rows(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap a benchmark item.

    Null and empty texts, here and there, overlap nothing; repeated rows are judged each; texts are compared
    whole, whatever their length; an empty benchmark drops nothing; ids play no part; extra columns are kept.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, plain or disguised, by its kind.

    A null text stays null and an empty one empty; whole texts are read, whatever their length; n_chars, where
    there is one, follows the new text; repeated rows are treated alike; every row stays; extra columns are kept.
    """
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document go into the mix.

    A null or empty text has size 0 and gives no words; a null source is a source of its own, last in order;
    rows that repeat, or share an id or none, are documents of their own; extra columns are left out; an empty
    table gives no rows.
    """
    return mixing.mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("PII", redact_pii),
    ("mixing sources", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs


#: The stages draw, classify and hash as SQL can't: each stage's operator is tested against a brute-force version,
#: and the stages together by what they must keep and drop of planted rows (tests/llm/test_table_operators.py).
ORACLE_SQL = None
