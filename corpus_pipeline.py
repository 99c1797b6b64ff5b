"""A training-data pipeline over documents: five stages, each of which reads what the one before wrote.

Language ID drops documents of no known language; exact dedup and near dedup keep one of each group
of copies; mixing draws the rest towards the sources' target weights (a document comes once for each
round that takes it, cut to the blocks taken); BPE encodes and decodes what is left.

Results for odd input: rows whose text is null, empty or without a letter have no language and go in the
first stage. Rows that repeat id and text stay or go together. Of equal texts the largest id stays, of
near copies the smallest id of the component; rows with a null id lose among equal texts, and are linked
with nothing by near dedup. A null source is a source of its own. Very long texts are read whole. Where
no row has a language, nothing
can be learned and nothing is kept. An empty table gives an empty result. Extra columns, whatever their
names, pass through all stages but the last, which returns its own columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellforge.llm import exact_dedup, language_id, mixing, near_dedup, queries
from cellforge.llm.common import passing, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.known_language(docs)


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.bpe_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", _language),
    ("exact_dedup", _exact),
    ("near_dedup", _near),
    ("mixing", _mix),
    ("bpe", _encode),
]

#: The language model, the random mix and the tokenizer are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with passing() as kept:  # what a stage stores on its way goes once its result is there
            docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
