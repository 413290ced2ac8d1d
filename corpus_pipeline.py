"""A training corpus from raw documents: five stages, each a written table.

quality     documents that importance resampling rejects go
lines       repeated three-line windows go; a document that loses all its text goes
near        one document of each class of near copies stays (five words, similarity 0.8)
benchmark   documents with a benchmark passage go
pack        the rest, tokenized and packed into sequences

All stages but the last return the columns of ``documents``.

Defined cases: NULL and empty texts pass every stage; rows that repeat an id and its text
become one in the stage near, as do the classes there, ties going to the smallest id; empty
tables stay empty. Columns of the documents are carried through whatever their names are, also
where an operator has a column of that name; ``n_chars`` follows the text where it is present.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnwork.llm import decontaminate, line_dedup, ngram_join, packing, quality
from tarnwork.storage import dropped, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _carried(stage):
    """``stage`` with all columns but those that it reads under names that no operator has, and back."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inside = [c if c in ("doc_id", "text", "n_chars") else f"__carried_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*inside), sf_dir).select(*inside).toDF(*docs.columns)

    return run_stage


@_carried
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.sample(docs, _table(spark, sf_dir, "labels")).select(*docs.columns)


@_carried
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(docs)
    left = out.filter((F.col("n_removed") == 0) | (F.trim(F.coalesce("text", F.lit(""))) != ""))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


@_carried
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, n=5, percent=80).select(*docs.columns)


@_carried
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, _table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.run(docs)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near", near_stage), ("benchmark", benchmark_stage), ("pack", pack_stage)]
ORACLE_SQL = None  # SQL can express neither the sampling nor the packing; tests/llm holds every stage against a plain version of it


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    before = None
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stored(docs, name)
            if before is not None:
                dropped(before)
            before = docs
    return docs
