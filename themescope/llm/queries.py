"""One query for each operator, over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession

from themescope.llm import audit, bpe, decontam, langid, license, mixture, neardup, packing, quality, rules, rules_sql
from themescope.llm import runs, suffix, toxicity
from themescope.llm.common import read

#: Rank file of the byte-level queries, found by the public_tokenizers package.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Vocabulary file of the packing by mixture.
PACKING_VOCABULARY = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {"op6_quality_rules": rules_sql.SQL, "op12_source_audit": audit.SQL}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.digests(read(spark, folder, "documents"), passage_bytes=suffix.PASSAGE_BYTES)


@query
def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(read(spark, folder, "documents"), tokenizers.path(VOCABULARY), tokenizers.PATTERN)


@query
def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license.scan(read(spark, folder, "documents"))


@query
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.predict(read(spark, folder, "documents"))


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.predict(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judge(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query
def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.predict(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.matches(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query
def op7_token_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"), tokenizers.path(VOCABULARY), tokenizers.PATTERN)


@query
def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.classes(read(spark, folder, "documents"))


@query
def op11_mixture_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return mixture.digests(mixture.pack(docs, tokenizers.path(PACKING_VOCABULARY), tokenizers.PATTERN))


@query
def op12_source_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit(read(spark, folder, "documents"))


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.digests(read(spark, folder, "documents"), planted=True)
