"""Small stand-in tables: one Python list each, shared by Spark and the SQL checks.

The values are invented for trying the library out and carry no authority; load
real ones with ``read_factors``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Param, country, zone, land use, valid from, valid to, value,
# unit, relative uncertainty.
FACTOR_ROWS = [
    ("growth", None, None, None, 1990, 2050, 0.5, "t dm/ha/yr", 0.5),
    ("growth", None, None, "forest", 1990, 2050, 4.0, "t dm/ha/yr", 0.3),
    ("growth", None, None, "grassland", 1990, 2050, 0.75, "t dm/ha/yr", 0.4),
    ("growth", None, None, "other", 1990, 2050, 0.0, "t dm/ha/yr", 0.0),
    ("growth", None, "BUILDING", "forest", 1990, 2050, 5.5, "t dm/ha/yr", 0.25),
    ("growth", None, "MACHINERY", "forest", 1990, 1997, 3.25, "t dm/ha/yr", 0.25),
    ("growth", None, "MACHINERY", "forest", 1998, 2050, 3.625, "t dm/ha/yr", 0.2),
    ("growth", 3, "BUILDING", "forest", 1990, 2050, 6.25, "t dm/ha/yr", 0.1),
    ("growth", 7, "AUTOMOBILE", "wetland", 1996, 1999, 1.25, "t dm/ha/yr", 0.2),
    ("growth", 4, None, None, None, 1999, 0.9, "t dm/ha/yr", 0.35),
    ("growth", 4, None, None, 2000, None, 1.1, "t dm/ha/yr", 0.3),
    ("growth", 9, None, "forest", 1850, 2100, 4.4, "t dm/ha/yr", 0.15),
    ("growth", 9, "FURNITURE", None, 1900, None, 2.2, "t dm/ha/yr", 0.3),
    ("growth", None, "FURNITURE", None, 1900, 2150, 0.8, "t dm/ha/yr", 0.45),
    ("root_ratio", 11, None, None, 1980, None, 0.33, "ratio", 0.2),
    ("root_ratio", None, None, None, 1990, 2050, 0.3, "ratio", 0.3),
    ("root_ratio", None, None, "forest", 1990, 2050, 0.26, "ratio", 0.2),
    ("root_ratio", None, None, "grassland", 1990, 2050, 1.6, "ratio", 0.4),
    ("carbon_fraction", None, None, None, 1990, 2050, 0.47, "tC/t dm", 0.05),
    ("carbon_fraction", None, None, "wetland", 1990, 2050, 0.45, "tC/t dm", 0.05),
    ("biomass", None, None, "forest", 1990, 2050, 120.0, "tC/ha", 0.3),
    ("biomass", None, None, "cropland", 1990, 2050, 5.0, "tC/ha", 0.5),
    ("biomass", None, None, "grassland", 1990, 2050, 8.0, "tC/ha", 0.5),
    ("biomass", None, None, "wetland", 1990, 2050, 20.0, "tC/ha", 0.5),
    ("biomass", None, None, "settlement", 1990, 2050, 3.0, "tC/ha", 0.6),
    ("biomass", None, None, "other", 1990, 2050, 0.0, "tC/ha", 0.0),
    ("biomass", None, "AUTOMOBILE", "forest", 1990, 2050, 95.0, "tC/ha", 0.25),
    ("biomass", 7, "AUTOMOBILE", "forest", 1990, 2050, 101.5, "tC/ha", 0.15),
    ("expansion", None, None, None, 1990, 2050, 0.6, "t dm/m3", 0.2),
    ("expansion", None, "BUILDING", "forest", 1990, 2050, 0.75, "t dm/m3", 0.15),
    ("dead_wood", None, None, None, 1990, 2050, 0.0, "tC/ha", 0.5),
    ("dead_wood", None, None, "forest", 1990, 2050, 14.0, "tC/ha", 0.5),
    ("dead_wood", None, None, "wetland", 1990, 2050, 3.0, "tC/ha", 0.5),
    ("litter", None, None, None, 1990, 2050, 0.0, "tC/ha", 0.5),
    ("litter", None, None, "forest", 1990, 2050, 22.0, "tC/ha", 0.4),
    ("litter", None, None, "wetland", 1990, 2050, 5.0, "tC/ha", 0.4),
    ("soc_ref", None, None, None, 1990, 2050, 65.0, "tC/ha", 0.9),
    ("soc_ref", None, None, "wetland", 1990, 2050, 90.0, "tC/ha", 0.9),
    ("soc_ref", None, "HOUSEHOLD", "wetland", 1990, 2050, 110.0, "tC/ha", 0.9),
    ("soc_land_use", None, None, None, 1990, 2050, 1.0, "ratio", 0.1),
    ("soc_land_use", None, None, "cropland", 1990, 2050, 0.8, "ratio", 0.1),
    ("soc_land_use", None, None, "settlement", 1990, 2050, 0.7, "ratio", 0.2),
    ("soc_land_use", None, None, "other", 1990, 2050, 0.6, "ratio", 0.2),
    ("soc_management", None, None, None, 1990, 2050, 1.0, "ratio", 0.1),
    ("soc_management", None, None, "cropland", 1990, 2050, 1.05, "ratio", 0.1),
    ("soc_input", None, None, None, 1990, 2050, 1.0, "ratio", 0.1),
    ("soc_input", None, None, "cropland", 1990, 2050, 0.95, "ratio", 0.1),
    ("soc_input", None, None, "grassland", 1990, 2050, 1.1, "ratio", 0.1),
    ("organic_share", None, None, None, 1990, 2050, 0.02, "ratio", 0.5),
    ("organic_share", None, None, "wetland", 1990, 2050, 0.6, "ratio", 0.3),
    ("organic_drainage", None, None, None, 1990, 2050, 0.0, "tC/ha/yr", 0.0),
    ("organic_drainage", None, None, "cropland", 1990, 2050, 7.9, "tC/ha/yr", 0.3),
    ("organic_drainage", None, None, "grassland", 1990, 2050, 5.6, "tC/ha/yr", 0.3),
    ("organic_drainage", None, None, "forest", 1990, 2050, 0.7, "tC/ha/yr", 0.5),
    ("fuel", None, None, None, 1990, 2050, 3.0, "t dm/ha", 0.5),
    ("fuel", None, None, "forest", 1990, 2050, 80.0, "t dm/ha", 0.4),
    ("fuel", None, None, "grassland", 1990, 2050, 5.0, "t dm/ha", 0.4),
    ("combustion", None, None, None, 1990, 2050, 0.5, "ratio", 0.3),
    ("combustion", None, None, "forest", 1990, 2050, 0.45, "ratio", 0.3),
    ("combustion", None, None, "grassland", 1990, 2050, 0.8, "ratio", 0.2),
    ("fire_CH4", None, None, None, 1990, 2050, 2.3, "g/kg dm", 0.4),
    ("fire_CH4", None, None, "forest", 1990, 2050, 4.7, "g/kg dm", 0.4),
    ("fire_N2O", None, None, None, 1990, 2050, 0.21, "g/kg dm", 0.5),
    ("fire_N2O", None, None, "forest", 1990, 2050, 0.26, "g/kg dm", 0.5),
    ("n2o_direct", None, None, None, 1990, 2050, 0.01, "tN2O-N/tN", 0.7),
    ("n2o_direct", None, None, "cropland", 1998, 2050, 0.012, "tN2O-N/tN", 0.6),
    ("product_share", None, None, None, 1990, 2050, 0.55, "ratio", 0.2),
    ("product_decay", None, None, None, 1990, 2050, 0.0231, "1/yr", 0.3),
    ("rewetting_CH4", None, None, "wetland", 1990, 2050, 0.18, "tCH4/ha/yr", 0.6),
    ("debris_share", None, None, None, 1990, 2050, 0.3, "ratio", 0.4),
    ("debris_years", None, None, None, 1990, 2050, 10.0, "yr", 0.3),
]

# 100-year warming potentials of the two sets.
GWP_ROWS = [
    ("AR5", "CO2", 1.0),
    ("AR5", "CH4", 28.0),
    ("AR5", "N2O", 265.0),
    ("AR6", "CO2", 1.0),
    ("AR6", "CH4", 27.0),
    ("AR6", "N2O", 273.0),
]

# Box, west, east, south, north.
BOX_ROWS = [
    (1, -180.0, -60.0, -60.0, 10.0),
    (2, -90.5, 15.25, -20.0, 45.0),
    (3, 0.0, 180.0, -60.0, 0.0),
    (4, 10.0, 60.0, 30.0, 80.0),
    (5, 59.9, 140.3, -10.5, 55.5),
    (6, -180.0, 180.0, 60.0, 80.0),
]


def curve_rows() -> list[tuple]:
    """Biomass change in tC/ha for each year after a change of land use.

    A loss falls by 60 % at once and by a tenth of the rest in each of the next
    ten years; a gain grows by equal steps over twenty years.
    """
    density = {r[3]: r[6] for r in FACTOR_ROWS if r[0] == "biomass" and r[2] is None}
    rows = []
    for a, before in density.items():
        for b, after in density.items():
            diff = after - before
            if diff < 0:
                rows.append((a, b, 0, round(0.6 * diff, 6), "AGB"))
                rows += [(a, b, age, round(0.04 * diff, 6), "AGB") for age in range(1, 11)]
            elif diff > 0:
                rows += [(a, b, age, round(0.05 * diff, 6), "AGB") for age in range(20)]
    return rows


_ARROW = {"int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of literal rows.

    Arrow input becomes a local relation, whose exact size the optimizer knows;
    a plain Python list would become an RDD of unknown size.
    """
    fields = [part.split() for part in schema.split(", ")]
    columns = zip(*rows, strict=True)
    table = pa.table(
        {name: pa.array(col, _ARROW[kind]) for (name, kind), col in zip(fields, columns, strict=True)}
    )
    return spark.createDataFrame(table)
