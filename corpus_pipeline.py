"""From raw documents to packed training sequences: five stages, each a call of one operator of refloom.llm.

All stages take rows with nulls in any column, empty and very long texts, repeated rows, extra columns whatever their names,
and tables without rows. All but the last return rows of their input with the columns as they came.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from refloom.llm import decontam, langid, neardup, packing, quality
from refloom.llm.base import prepare, table


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, learned from labels of these documents, accepts. A null or empty text counts as
    one of the usual size difference; without labels of both kinds all documents stay."""
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a learned language makes up a fair share. Texts that are null, empty or without a letter go; if no row
    names a language, all go."""
    return langid.keep_identified(docs, langid.fit_languages(docs))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group linked at a similarity of 0.8. Rows without an id or without words are in no
    group and stay; rows that repeat id and text count as one."""
    return neardup.keep_one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them. Rows without an id or words stay; without benchmark items all do."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences; a null or empty text has one piece of one id, each repeated row its own."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_good_quality),
    ("language", keep_known_language),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: The stages learn models and tokenize, which SQL can't express. tests/llm/test_pipeline.py compares the near-duplicate and
#: decontamination stages with brute force over all pairs, the others with what their operators, tested against brute force
#: themselves, say of the stage's input, and run() with the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Between stages the rows are written out (checkpoint), so that a lost executor costs no recomputation."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint()
    return STAGES[-1][1](spark, docs, sf_dir)
