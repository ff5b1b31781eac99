"""Declared schemas: nothing in the library infers types from data."""

MONEY = "decimal(18,4)"

# Source tables as stored, limited to the columns the adapters use.
STORED = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "part": "p_partkey bigint, p_type string",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
        "o_totalprice double, o_orderdate timestamp_ntz"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_discount double, l_returnflag string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
        "value double, props string"
    ),
}

FACTOR = (
    "param string, country_id int, zone string, land_use string, valid_from int, "
    "valid_to int, value double, unit string, rel_unc double"
)
GWP = "gwp_set string, gas string, value double"
CURVE = "from_use string, to_use string, age int, share double, pool string"
BOX = "box_id int, lon0 double, lon1 double, lat0 double, lat1 double"
READING = (
    "reading_id bigint, tower_id bigint, ts timestamp, kind string, flux double, temp_c double"
)

LEDGER_COLUMNS = ["unit_id", "year", "pool", "process", "gas", "amount", "unit"]
LEDGER = (
    "unit_id bigint, year int, pool string, process string, gas string, "
    "amount decimal(18,4), unit string"
)

LAND_USES = ["cropland", "forest", "grassland", "other", "settlement", "wetland"]
POOLS = ["AGB", "BGB", "DW", "LITTER", "SOC", "HWP"]
