"""The training-data pipeline: five stages over `documents`, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import bytecnn, minhash, mixing, shards, winnow
from lattica.llm._store import keep, read


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents under the threshold go."""
    model = bytecnn.train(*bytecnn.sample(docs, read(spark, sf_dir, "labels")))
    return bytecnn.keep_good(docs, model)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: the smallest doc_id of each group stays."""
    return minhash.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that share a span with a benchmark item go."""
    return winnow.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Temperature mixing: documents are drawn by source, rows repeat with the epochs."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Minimax sharding: adds shard_id."""
    return shards.assign(docs)


STAGES = [
    ("quality_classifier", classify),
    ("near_dedup", dedup),
    ("decontamination", decontaminate),
    ("temperature_mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each returns is written as Parquet in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)


#: A trained network and transitive near-duplicate groups are beyond SQL; tests compare run() with brute force.
ORACLE_SQL: str | None = None
