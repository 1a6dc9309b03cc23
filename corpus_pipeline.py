"""From raw documents to training shards: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage takes the documents that the one before it kept. All but the last return the columns of documents; the last
returns where each kept row goes. The stages call the operators of tamis.llm with the settings of the registered queries,
but for near-duplicates: there, as no contract fixes them, shingles of five words and a similarity of 0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.common import materialize
from tamis.llm.decontamination import drop_contaminated
from tamis.llm.jaccard_join import jaccard_components
from tamis.llm.mixing import mix_sources
from tamis.llm.queries import TOXIC, learned_toxicity, read
from tamis.llm.sharding import shard_documents
from tamis.llm.toxicity import keep_clean

#: The share of the entropy of equal weights that the mix may reach, and how often a source may be read more than another.
ENTROPY_SHARE, MAX_REPEATS = 0.95, 4.0
SHARDS = 40


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. The model is learned from all labelled documents of its fold."""
    model = learned_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return keep_clean(docs, model, TOXIC)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component; documents without words, or an id, all stay."""
    found = jaccard_components(docs, words=5, percent=80)
    later = materialize(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("later")).distinct(), "later")
    return docs.join(later, docs["doc_id"] == later["later"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, and again as often as the mix reads its source."""
    return mix_sources(docs, ENTROPY_SHARE, MAX_REPEATS).drop("mix_epoch", "mix_slice")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row."""
    return shard_documents(docs, SHARDS)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The string kernel, the templates and the bisections are not SQL: the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder, as the next one reads them often."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
