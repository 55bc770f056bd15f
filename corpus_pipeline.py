"""Raw documents to a training mix, in five stages that hand on Parquet.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the
columns of ``documents``; the last one returns what the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asfiled.durable import materialise
from asfiled.llm.decontaminate import decontaminate
from asfiled.llm.jaccard_join import one_per_component
from asfiled.llm.mixing import mix
from asfiled.llm.pii import replace_entities
from asfiled.llm.quality_rules import keep_good
from asfiled.llm.registry import SURROGATE_KEY
from asfiled.llm.rows import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return keep_good(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of similar shingles, the one with the smallest id."""
    return one_per_component(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; ``n_chars`` follows the text."""
    replaced = replace_entities(docs, SURROGATE_KEY)
    return replaced.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else replaced


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words, and how often, the mix takes each document."""
    return mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("surrogates", surrogates),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs


#: Surrogates come from keyed hashes of every entity; SQL twins of it are left out, and the
#: pipeline is tested against a brute-force version of all stages.
ORACLE_SQL = None
