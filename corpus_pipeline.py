"""Corpus pipeline over ``documents``: quality, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and reread as the next one's docs.
All but the last return the columns of ``documents``. The last returns the pieces of packed sequences.

Odd rows: null and empty texts get the classifier's bias as their score and stay or go by it, have no shingles, no leaks
and no secrets, and pack as the end id alone. Rows without an id stay through near_duplicates and decontamination. Rows of
equal ids are one node of near_duplicates and one document of decontamination. Extra columns are kept up to packing.
Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frostline.llm.common import materialize, read
from frostline.llm.decontamination import drop_contaminated
from frostline.llm.ngram_join import keep_first_of_groups
from frostline.llm.packing import pack_documents
from frostline.llm.quality import keep_good
from frostline.llm.secret_scan import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least id."""
    return keep_first_of_groups(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; found secrets are masked in its text."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: The classifier, the token counts and the packing have no SQL form; the tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
