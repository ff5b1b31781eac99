"""Land tables derived from the stored tables through fixed adapters."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landflux.sources import literals
from landflux.sources.schemas import BOX, CURVE, FACTOR, GWP, MONEY, STORED

# Stand-in class of each stored type.
TYPE_TO_USE = {
    "ECONOMY": "cropland",
    "LARGE": "forest",
    "MEDIUM": "grassland",
    "PROMO": "settlement",
    "SMALL": "wetland",
    "STANDARD": "other",
}


def _class_of(kind: str) -> Column:
    expr = None
    for stored, use in TYPE_TO_USE.items():
        expr = (F if expr is None else expr).when(F.col(kind) == stored, use)
    return expr


class LandTables:
    """Lazy land tables over a folder of Parquet files.

    ``since`` and ``until`` (ISO dates, until exclusive) bound the dated tables.
    They are compared with the stored timestamps themselves, so the filter
    reaches the Parquet scan.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        since: str | None = None,
        until: str | None = None,
    ):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.since = since
        self.until = until

    def stored(self, name: str) -> DataFrame:
        return self.spark.read.schema(STORED[name]).parquet(self.path(name))

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def stream_path(self, name: str) -> str:
        """The same place as a pattern: a stream takes a single file only in that form."""
        return f"{self.folder}/{name}.parque[t]"

    def _dated(self, df: DataFrame, column: str) -> DataFrame:
        if self.since:
            df = df.filter(F.col(column) >= F.lit(self.since).cast("timestamp_ntz"))
        if self.until:
            df = df.filter(F.col(column) < F.lit(self.until).cast("timestamp_ntz"))
        return df

    @cached_property
    def country(self) -> DataFrame:
        return (
            self.stored("nation")
            .join(self.stored("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("n_nationkey").alias("country_id"),
                F.col("n_name").alias("country"),
                F.col("r_regionkey").alias("region_id"),
                F.col("r_name").alias("region"),
            )
        )

    @cached_property
    def land_unit(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.stored("customer").select(
            key.alias("unit_id"),
            F.col("c_nationkey").alias("country_id"),
            F.col("c_mktsegment").alias("zone"),
            (key % 91 + 10).cast(MONEY).alias("area_ha"),
            ((key * 37) % 3600 / F.lit(10.0) - 180).alias("lon"),
            ((key * 53) % 1400 / F.lit(10.0) - 60).alias("lat"),
        )

    @cached_property
    def land_obs(self) -> DataFrame:
        lines = self._dated(self.stored("lineitem"), "l_shipdate")
        return (
            lines.join(self.stored("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.stored("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("o_custkey").alias("unit_id"),
                F.to_date("l_shipdate").alias("obs_date"),
                _class_of("p_type").alias("land_use"),
                F.col("l_quantity").cast(MONEY).alias("area_ha"),
                F.col("l_suppkey").alias("provider_id"),
            )
        )

    @cached_property
    def stock_obs(self) -> DataFrame:
        return self._dated(self.stored("orders"), "o_orderdate").select(
            F.col("o_orderkey").alias("plot_obs_id"),
            F.col("o_custkey").alias("unit_id"),
            F.to_date("o_orderdate").alias("survey_date"),
            (F.col("o_totalprice") / 1000).alias("c_density"),
            F.col("o_orderstatus").alias("status"),
        )

    @cached_property
    def _event_lines(self) -> DataFrame:
        lines = self._dated(self.stored("lineitem"), "l_shipdate")
        lines = lines.filter(F.col("l_returnflag").isin("R", "A"))
        return lines.join(
            self.stored("orders"), F.col("l_orderkey") == F.col("o_orderkey")
        ).withColumn("kind", F.when(F.col("l_returnflag") == "R", "harvest").otherwise("fire"))

    @cached_property
    def disturbance(self) -> DataFrame:
        return self._event_lines.select(
            F.col("o_custkey").alias("unit_id"),
            F.to_date("l_shipdate").alias("event_date"),
            "kind",
            (F.col("l_discount") * 10).alias("severity"),
            F.col("l_quantity").cast(MONEY).alias("volume_m3"),
        )

    @cached_property
    def claim(self) -> DataFrame:
        """Claims named by their source keys: a running number would need one global order."""
        day = F.to_date("l_shipdate")
        return self._event_lines.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("claim_id"),
            F.col("o_custkey").alias("unit_id"),
            "kind",
            day.alias("start_date"),
            F.date_add(day, 30).alias("end_date"),
        )

    @cached_property
    def years(self) -> tuple[int, int]:
        """First and last year of the observations: one small job over one column."""
        year = F.year("l_shipdate")
        row = self._dated(self.stored("lineitem"), "l_shipdate").agg(F.min(year), F.max(year)).first()
        return (row[0], row[1]) if row[0] is not None else (0, -1)

    @cached_property
    def n_input(self) -> DataFrame:
        lines = self._dated(self.stored("lineitem"), "l_shipdate")
        lines = lines.filter(F.col("l_returnflag") == "N")
        return (
            lines.join(self.stored("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(F.col("o_custkey").alias("unit_id"), F.year("l_shipdate").alias("year"))
            .agg(F.sum((F.col("l_quantity") / 100).cast(MONEY)).cast(MONEY).alias("n_tonnes"))
        )

    @cached_property
    def tower_reading(self) -> DataFrame:
        return readings_from_events(self._dated(self.stored("events"), "ts"))

    @cached_property
    def alert(self) -> DataFrame:
        return alerts_from_events(self._dated(self.stored("events"), "ts"))

    @cached_property
    def site(self) -> DataFrame:
        """Towers stand on the units that report readings."""
        towers = self.stored("events").select(F.col("user_id").alias("tower_id")).distinct()
        units = self.land_unit.select(F.col("unit_id").alias("tower_id"), "unit_id", "zone")
        return units.join(towers, "tower_id", "left_semi")

    @cached_property
    def factor(self) -> DataFrame:
        return literals.small_table(self.spark, literals.FACTOR_ROWS, FACTOR)

    @cached_property
    def gwp(self) -> DataFrame:
        return literals.small_table(self.spark, literals.GWP_ROWS, GWP)

    @cached_property
    def curves(self) -> DataFrame:
        return literals.small_table(self.spark, literals.curve_rows(), CURVE)

    @cached_property
    def boxes(self) -> DataFrame:
        return literals.small_table(self.spark, literals.BOX_ROWS, BOX)


def readings_from_events(events: DataFrame) -> DataFrame:
    """Tower readings; works on a static table and on a stream."""
    k = F.get_json_object("props", "$.k").cast("int")
    uptake = F.col("event_type").isin("view", "click")
    return events.select(
        F.col("event_id").alias("reading_id"),
        F.col("user_id").alias("tower_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("kind"),
        F.when(uptake, -F.col("value")).otherwise(F.col("value")).alias("flux"),
        (k * 0.4).alias("temp_c"),
    )


def alerts_from_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") == "error").select(
        F.col("user_id").alias("tower_id"), F.col("ts").cast("timestamp").alias("alert_ts")
    )


def read_land_tables(spark: SparkSession, folder: str, **bounds: str) -> LandTables:
    return LandTables(spark, folder, **bounds)
