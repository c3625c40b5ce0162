"""The training-data pipeline over documents."""

from pyspark.sql import DataFrame, SparkSession

from lumiframe.llm import stages

STAGES = stages.STAGES
ORACLE_SQL = None  # classifiers, fingerprints and tokens have no SQL; tests/llm hold the run against a brute-force one


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each result written and read again as the next one's input."""
    return stages.run(spark, sf_dir)
