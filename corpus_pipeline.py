"""Corpus preparation as five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. ``run`` chains them with every stage's output written as Parquet in the
shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.llm import lines, mixing, near, packing, quality
from logloom.llm.common import store


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat across documents; ``n_chars`` follows the new text."""
    return lines.drop_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: SimHash, and MinHash for pairs beyond its radius; then 5-word shingles decide, Jaccard similarity 0.8 or more."""
    return near.drop_near(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix, each as often as it is taken."""
    return mixing.mix(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins: one row a piece."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near", near_stage), ("mix", mix_stage), ("pack", pack_stage)]

#: Near-dedup needs 64-bit hashes that the SQL engine lacks; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs, f"stage{k}")
    return docs
