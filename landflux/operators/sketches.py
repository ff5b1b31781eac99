"""Sketches per year that unite for any span of years.

Counting units or ranking totals over a span needs all rows of the span. A sketch
holds what such an answer needs in a few kilobytes, and sketches of years unite
to that of a span, so they are kept beside the ledger, year by year, and any span
is answered from them alone. A year that is written again gets a new sketch; the
others stay.

Nulls are in no sketch. A span without a stored year has no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landflux.operators.report import totals

HLL_BITS = 14
KLL_SIZE = 800
# one standard error of a count, relative
COUNT_ERROR = 1.04 / 2 ** (HLL_BITS / 2)
# error of a quantile's rank as a share of the rows, kept in 99 of 100 cases
RANK_ERROR = 2.296 / KLL_SIZE**0.9021


def coverage_sketches(obs: DataFrame) -> DataFrame:
    """One row a year: sketches of the units and providers seen."""
    return obs.groupBy(F.year("obs_date").alias("year")).agg(
        F.hll_sketch_agg("unit_id", HLL_BITS).alias("units"),
        F.hll_sketch_agg("provider_id", HLL_BITS).alias("providers"),
    )


def flux_sketches(entries: DataFrame, by: list[str]) -> DataFrame:
    """One row per ``by`` and year: sketches of the units and of their yearly totals.

    Amounts must have one unit. A hot group is summed up within the map tasks.
    """
    yearly = totals(entries, [*by, "year", "unit_id"])
    return yearly.groupBy(*by, "year").agg(
        F.hll_sketch_agg("unit_id", HLL_BITS).alias("units"),
        F.kll_sketch_agg_double(F.col("amount").cast("double"), KLL_SIZE).alias("amounts"),
    )


def write_sketches(sketches: DataFrame, path: str) -> None:
    """Replace the years that ``sketches`` holds and leave all other years alone."""
    (
        sketches.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year")
        .parquet(path)
    )


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _by_span(sketches: DataFrame, spans: DataFrame) -> DataFrame:
    """Every sketch under the spans that hold its year, on equal years."""
    years = spans.select("first_year", "last_year").distinct()
    years = years.withColumn("year", F.explode(F.sequence("first_year", "last_year")))
    return years.join(sketches, "year")


def coverage_of_spans(sketches: DataFrame, spans: DataFrame) -> DataFrame:
    """Units and providers seen in each span (first_year, last_year), within ``COUNT_ERROR``."""
    return (
        _by_span(sketches, spans)
        .groupBy("first_year", "last_year")
        .agg(
            F.hll_sketch_estimate(F.hll_union_agg("units")).alias("approx_units"),
            F.hll_sketch_estimate(F.hll_union_agg("providers")).alias("approx_providers"),
        )
    )


def distribution_of_spans(
    sketches: DataFrame, spans: DataFrame, by: list[str], probs: dict[str, float]
) -> DataFrame:
    """Percentiles of the yearly unit totals in each span and ``by``, their number and the units.

    A percentile is a total of the span whose rank is within ``RANK_ERROR`` of the
    one asked for. Sketches of totals draw lots, so reruns may differ within it.
    """
    united = _by_span(sketches, spans).groupBy(*by, "first_year", "last_year").agg(
        F.kll_merge_agg_double("amounts").alias("_all"), F.hll_union_agg("units").alias("_units")
    )
    return united.select(
        *by,
        "first_year",
        "last_year",
        F.kll_sketch_get_n_double("_all").alias("n"),
        F.hll_sketch_estimate("_units").alias("approx_units"),
        *[F.kll_sketch_get_quantile_double("_all", F.lit(p)).alias(name) for name, p in probs.items()],
    )
