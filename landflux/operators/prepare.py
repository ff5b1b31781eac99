"""Cleaning and shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.32


def valid_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows for which every rule holds; a rule that yields null is broken."""
    keep = F.lit(True)
    for rule in rules.values():
        keep = keep & F.coalesce(rule, F.lit(False))
    return df.filter(keep)


def rejected_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of all broken rules in ``broken``."""
    marks = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("broken", F.concat_ws(";", *marks)).filter(F.col("broken") != "")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under ``order``, which must break all ties.

    The filter on row number 1 lets Spark cut each map partition to one row per
    key before the shuffle, so a hot key sends one row per mapper.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def attach(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Add a dimension's columns; ``dim`` has one row per key."""
    return df.join(dim, key, "left")


def pools_long(df: DataFrame, ids: list[str], pools: list[str]) -> DataFrame:
    return df.unpivot(ids, pools, "pool", "amount")


def pools_wide(df: DataFrame, ids: list[str], pools: list[str]) -> DataFrame:
    """One column per pool.

    Sums under a filter need one shuffle; ``pivot`` would first sum per pool and
    shuffle again.
    """
    sums = [F.expr(f"sum(amount) filter (where pool = '{p}') as {p}") for p in pools]
    return df.groupBy(*ids).agg(*sums)


def densify_years(
    df: DataFrame, y0: int, y1: int, key: str = "unit_id", value: str = "land_use"
) -> DataFrame:
    """One row per key and year from ``y0`` to ``y1``, the last known value carried on.

    Every observed row covers the years up to the next one, so it is stretched
    over them; the first also covers the years before it, with a null value. A
    row with a null value is no observation. A key without any value gives no row.
    One shuffle by key, no join, and at most one input row per key and year.
    """
    window = Window.partitionBy(key).orderBy("year")
    low = F.when(F.col("_prev").isNull(), F.lit(y0)).otherwise(F.greatest("year", F.lit(y0)))
    high = F.least(F.coalesce(F.col("_next") - 1, F.lit(y1)), F.lit(y1))
    return (
        df.select(key, "year", value)
        .filter(F.col(value).isNotNull())
        .withColumn("_prev", F.lag("year").over(window))
        .withColumn("_next", F.lead("year").over(window))
        .withColumn("_low", low)
        .withColumn("_high", high)
        .filter("_low <= _high")
        .select(
            key,
            F.col("year").alias("_seen"),
            value,
            F.explode(F.sequence("_low", "_high")).alias("year"),
        )
        .select(
            key,
            "year",
            F.when(F.col("_seen") <= F.col("year"), F.col(value)).alias(value),
            (F.col("_seen") == F.col("year")).alias("observed"),
        )
    )


def grid_aggregate(df: DataFrame, degrees: float, value: str) -> DataFrame:
    """Totals and area-weighted means of ``value`` on a longitude-latitude grid."""
    area = F.col("area_ha").cast("double")
    cells = df.select(
        F.floor(F.col("lon") / degrees).cast("int").alias("cell_x"),
        F.floor(F.col("lat") / degrees).cast("int").alias("cell_y"),
        F.col("area_ha"),
        (area * F.col(value)).cast("decimal(28,6)").alias("_weighted"),
    )
    middle = F.radians((F.col("cell_y") + 0.5) * degrees)
    total = F.col("total_area_ha").cast("double")
    return (
        cells.groupBy("cell_x", "cell_y")
        .agg(
            F.count("*").alias("n_units"),
            F.sum("area_ha").alias("total_area_ha"),
            F.sum("_weighted").alias("_weighted"),
        )
        .withColumn("mean_value", F.try_divide(F.col("_weighted").cast("double"), total))
        .withColumn("cell_km2", F.lit((KM_PER_DEGREE * degrees) ** 2) * F.cos(middle))
        .drop("_weighted")
    )


FINEST = 26  # level of the smallest cells, five millionths of a degree wide


def zones_of_points(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Which boxes hold each point; west and south edges belong to a box.

    A box whose west edge lies east of its east edge goes over the date line.

    Cells come in levels, each half as wide as those of the level above. A box is
    listed at the level whose cells are as large as the box, less than twice, so
    under four cells at most; a point is looked up under its one cell of every
    level that a box is listed at. The join is on equal cells, the exact test
    comes after: a point meets no box more than two cells of its size away.
    """
    over = F.col("lon0") > F.col("lon1")
    west, east = F.struct("lon0", F.lit(180.0).alias("lon1")), F.struct(F.lit(-180.0).alias("lon0"), "lon1")
    parts = F.when(over, F.array(west, east)).otherwise(F.array(F.struct("lon0", "lon1")))
    boxes = boxes.select("*", F.explode(parts).alias("_part")).withColumns(
        {"lon0": F.col("_part.lon0"), "lon1": F.col("_part.lon1")}
    )
    extent = F.greatest(F.col("lon1") - F.col("lon0"), F.col("lat1") - F.col("lat0"))
    level = F.floor(F.log2(F.lit(360.0) / extent)).cast("int")
    boxes = boxes.filter(extent > 0).withColumn("_level", F.greatest(F.lit(0), F.least(F.lit(FINEST), level)))

    def cell(degrees: str) -> Column:
        return F.floor((F.col(degrees) + 180.0) * F.pow(F.lit(2.0), F.col("_level")) / 360.0)

    listed = boxes.withColumn("_cx", F.explode(F.sequence(cell("lon0"), cell("lon1"))))
    listed = listed.withColumn("_cy", F.explode(F.sequence(cell("lat0"), cell("lat1"))))
    used = boxes.agg(F.collect_set("_level")).scalar()
    placed = points.withColumn("_level", F.explode(used))
    placed = placed.withColumn("_cx", cell("lon")).withColumn("_cy", cell("lat"))
    inside = (
        (F.col("lon") >= F.col("lon0"))
        & (F.col("lon") < F.col("lon1"))
        & (F.col("lat") >= F.col("lat0"))
        & (F.col("lat") < F.col("lat1"))
    )
    found = placed.join(listed, ["_level", "_cx", "_cy"]).filter(inside)
    return found.select(*points.columns, "box_id")
