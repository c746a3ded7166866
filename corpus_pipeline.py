"""A training corpus from raw documents: five stages, each written and read again.

1. quality rules: documents that the rules reject go;
2. n-gram Jaccard join: of each group of near duplicates the smallest doc_id stays;
3. benchmark decontamination: documents with a passage of the benchmark go;
4. secret scans: secrets are replaced by a mark, documents stay;
5. packing: the rest is cut into sequences.

Every stage decides by row: a row without doc_id, or one that shares its doc_id with
another text, is a document of its own.  Stage 1 drops null, empty and very short
texts as the rules do; stage 2 drops repeated rows and leaves all rows without doc_id;
stage 3 judges each row by its own text; stage 4 changes texts and drops nothing;
stage 5 packs every row that is left.  Very long texts are read whole; among equal
copies the one with the smallest doc_id stays; extra columns are carried through to
stage 4; empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkwarden.llm import decontaminate, jaccard, packing, quality, secrets
from sparkwarden.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.stage(spark, docs, sf_dir)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.stage(spark, docs, sf_dir)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.stage(spark, docs, sf_dir)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.stage(spark, docs, sf_dir)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.stage(spark, docs, sf_dir)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("packing", sequence_packing),
]

#: Models and tokenizers are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
