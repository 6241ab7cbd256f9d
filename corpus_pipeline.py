"""A corpus from raw documents: toxic documents go, then exact and near
copies, then documents that hold benchmark items; what is left is mixed to
target weights by source."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sensorframe.llm import block_names, mixing, order_minhash, tiling, toxicity
from sensorframe.llm.common import noting, read_table, saved
from sensorframe.session import delete_path

_left: list[str] = []


def stage(f):
    """A stage that first removes the work folders of the stage before. Stages run one
    after another, each on what the one before has written, so those are not read any more."""
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for path in _left:
            delete_path(spark, path)
        with noting() as made:
            out = f(spark, docs, sf_dir)
        _left[:] = made
        return out
    return run


@stage
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    labels = toxicity.training_labels(read_table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return block_names.drop_duplicates(docs)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return order_minhash.drop_near_duplicates(docs)


@stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return tiling.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(docs)


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("near dedup", near), ("decontamination", benchmark), ("mixing", mix)]

#: The stages train models and follow sketches, which SQL cannot express; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
