"""A training corpus from `documents`, stage by stage.

Quality classifier, exact deduplication, n-gram Jaccard join, benchmark
decontamination and best-fit packing. Each stage takes what its predecessor
kept, written as Parquet and reread; all but the last return the columns of
documents. Rows are dropped by a hash of all their columns, so a doc_id that
is null or repeats costs no other row.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from epilens.llm.common import Scratch, intermediates, keep_ids, row_key, unused
from epilens.llm.decontam import contaminated, find_contamination
from epilens.llm.exact_dedup import exact_dedup
from epilens.llm.ngram_join import ngram_components
from epilens.llm.packing import pack
from epilens.llm.quality import score_quality


def _without(spark: SparkSession, docs: DataFrame, find: Callable[[], DataFrame]) -> DataFrame:
    """docs less the rows that the operator's result names by row_key. What the operator wrote on the way is deleted."""
    scratch = Scratch(spark)
    with intermediates():
        rows = scratch.table(find().select("row_key").distinct(), "dropped")
    key = unused(docs, "row_key")
    keyed = docs.withColumn(key, row_key(docs))
    return keep_ids(keyed, rows.withColumnRenamed("row_key", key), key, "left_anti").select([f"`{c}`" for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _without(spark, docs, lambda: score_quality(spark, docs, labels).where("not kept"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest doc_id."""
    return exact_dedup(spark, docs).select([f"`{c}`" for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a 5-word Jaccard similarity of 0.8 or more, the smallest doc_id."""
    return _without(spark, docs, lambda: ngram_components(spark, docs, width=5, percent=80).where("not stays"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(spark, docs, lambda: contaminated(find_contamination(spark, docs, benchmark)).where("contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [("quality", quality), ("exact_dedup", dedup), ("ngram_join", near_dedup), ("decontamination", decontaminate), ("packing", packing)]

#: Tokenisation and packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
