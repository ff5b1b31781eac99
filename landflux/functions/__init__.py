from landflux.functions.amounts import amount, normal_draw, rounded, to_unit, uniform_draw
from landflux.functions.custom import fit_per_group, map_factor, response_curve_rows, user_curve_rows
from landflux.functions.fits import fit_rows, saturating

__all__ = [
    "amount",
    "rounded",
    "to_unit",
    "uniform_draw",
    "normal_draw",
    "fit_per_group",
    "map_factor",
    "response_curve_rows",
    "user_curve_rows",
    "fit_rows",
    "saturating",
]
