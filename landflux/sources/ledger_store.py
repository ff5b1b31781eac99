"""The ledger on disk: Parquet partitioned by year, replaced year by year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from landflux.sources.schemas import LEDGER, LEDGER_COLUMNS


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Replace the years that ``ledger`` holds and leave all other years alone.

    The rebalance lets adaptive execution split a large year over many writers
    and put small years together, by measured size.
    """
    (
        ledger.select(*LEDGER_COLUMNS)
        .hint("rebalance", "year")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year")
        .parquet(path)
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The stored ledger; a filter on ``year`` prunes folders."""
    return spark.read.schema(LEDGER).parquet(path).select(*LEDGER_COLUMNS)
