from landflux.sources.factor_files import read_factors
from landflux.sources.ledger_store import read_ledger, write_ledger
from landflux.sources.tables import LandTables, read_land_tables

__all__ = ["LandTables", "read_land_tables", "read_factors", "read_ledger", "write_ledger"]
