"""The training-data pipeline: each stage works on all that the one before has kept.

Quality classifier, exact dedup, MinHash near-dedup, suffix-array dedup, best-fit packing. Every stage but the
last returns the columns of documents; what it returns is written as Parquet and read back as the next one's
documents. The stages fit a model, search similar texts and run over suffixes, which SQL cannot express, so
there is no SQL twin; ``tests/llm/test_pipeline.py`` holds what each stage keeps against plain versions.

Null and empty texts are texts like any other: the classifier scores them, exact dedup keeps one of them, near-dedup
links them with nothing, and packing gives them one piece with the end mark. A null doc_id is one more document.
Of rows that repeat id and text one stays; rows that repeat an id with other texts are documents of their own. Of
equal texts the smallest id stays, of a near group too. Empty tables give no rows. Further columns go along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm import exact_dedup, minhash_dedup, packing, quality, suffix_dedup
from quarrymill.runtime import prepare, stage, table

STAGES = [
    ("quality_classifier", quality.stage_function),
    ("exact_dedup", exact_dedup.stage_function),
    ("minhash_near_dedup", minhash_dedup.stage_function),
    ("suffix_dedup", suffix_dedup.stage_function),
    ("best_fit_packing", packing.stage_function),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
