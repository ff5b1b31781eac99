"""Factor tables from text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from landflux.sources.schemas import FACTOR


def read_factors(spark: SparkSession, path: str) -> DataFrame:
    """Factor rows from CSV with a header; a row that does not fit the schema fails the job."""
    return (
        spark.read.schema(FACTOR)
        .option("header", "true")
        .option("mode", "FAILFAST")
        .option("enforceSchema", "false")
        .csv(path)
    )
