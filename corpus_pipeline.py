"""From raw documents to token digests in five stages, each written and read again by the next.

run() writes each stage's rows to the shared checkpoint folder, as a driver that calls the
stages one by one does.
"""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession

from themescope.llm import bpe, decontam, neardup, suffix, toxicity
from themescope.llm.common import read
from themescope.llm.queries import VOCABULARY
from themescope.session import cut_lineage


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least id."""
    return neardup.keep_first(docs)


#: Bytes of a passage that is a repeat: fifty words are about 300 bytes in the languages of the
#: corpus, with short words 240.
REPEAT_BYTES = 240


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of REPEAT_BYTES and more that stand at several places."""
    return suffix.remove_repeats(docs, REPEAT_BYTES)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the texts."""
    return bpe.digests(docs, tokenizers.path(VOCABULARY), tokenizers.PATTERN)


STAGES = [
    ("toxicity", keep_clean),
    ("minhash_near_dedup", keep_one_of_each_group),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_benchmark),
    ("byte_bpe", encode),
]

#: Learned scores and hashed candidates are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
