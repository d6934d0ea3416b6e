"""A corpus pipeline of five stages over ``documents``.

Toxic documents go, one document of each group of near duplicates stays, documents with
benchmark passages go, personal data is replaced in the texts that are left, and these
are encoded. Each stage reads what its predecessor wrote.

Defined results, for every stage: all columns of the documents stay as they are, whatever
their names, but ``text`` and ``n_chars`` where personal data is replaced; null and empty
texts are neither toxic, nor copies, nor contaminated, and have no tokens; rows that repeat
an id and a text share their fate, and all of them stay if one does; rows with a null id are
no copies of others; of documents with equal texts the smallest id stays; an empty table
gives no rows; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm import decontamination, ngram_join, pii, sentencepiece_codec, toxicity
from chronoloom.llm.common import read_table, stash
from chronoloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of similar texts stays."""
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and words that give it away, are replaced by their kind."""
    return pii.sanitise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return sentencepiece_codec.encode_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("sentencepiece", encode),
]

#: SQL has no form of the classifier or the tokenizer; tests hold the run against a
#: plain version of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
