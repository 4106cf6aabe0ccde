"""A training corpus from the documents: five stages, each on all that its predecessor kept.

Quality rules and toxicity reject documents, near-duplicates leave one document of each
class, mixing repeats and drops documents to meet the sources' word budgets, and the
last stage encodes what is left.  ``run`` writes each stage to the shared scratch folder
and reads it back.  No stage can be given in SQL as a whole (a trained model, hashed
darts), so there is no ORACLE_SQL; ``tests/llm`` holds the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.llm import bpe, mixing, neardup, quality, toxicity
from stocklens.llm.common import fresh, stored, table
from stocklens.llm.queries import PATTERN, VOCABULARY

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass their base rules and whose host is not rejected."""
    scored = stored(quality.with_base_rules(docs), "quality")
    rules = fresh(docs, "rules")
    judged = quality.with_host_verdicts(scored, rules=rules)
    return judged.filter(F.col(fresh(scored, "kept"))).select(*docs.columns)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below the threshold; the model learns from those with labels."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_scores(docs, model)
    return scored.filter(F.col(fresh(docs, "toxicity")) < toxicity.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest doc_id."""
    return neardup.without_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, a row for each time that one is taken."""
    return mixing.mixed_documents(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids (binary, four little-endian bytes each) and number of tokens."""
    ids = fresh(docs, "ids")
    encoded = docs.withColumn(ids, bpe.encode(F.col("text"), VOCABULARY, PATTERN))
    return encoded.withColumn(fresh(docs, "n_tokens"), F.expr(f"length(`{ids}`) div 4"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("bpe_encoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
