"""Units of measurement and the affine expressions that convert between them."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column

from sigtab.functions.numeric import as_col

# Dimension -> unit -> factor to the SI unit of the dimension.
UNITS: dict[str, dict[str, float]] = {
    "voltage": {"V": 1.0, "mV": 1e-3, "µV": 1e-6, "nV": 1e-9, "kV": 1e3, "MV": 1e6},
    "current": {"A": 1.0, "mA": 1e-3, "µA": 1e-6, "nA": 1e-9, "kA": 1e3},
    "resistance": {"Ω": 1.0, "mΩ": 1e-3, "µΩ": 1e-6, "kΩ": 1e3, "MΩ": 1e6},
    "power": {"W": 1.0, "mW": 1e-3, "µW": 1e-6, "kW": 1e3, "MW": 1e6},
    "magnetic_flux_density": {"T": 1.0, "mT": 1e-3, "µT": 1e-6, "nT": 1e-9, "G": 1e-4},
    "frequency": {"Hz": 1.0, "mHz": 1e-3, "kHz": 1e3, "MHz": 1e6, "GHz": 1e9},
    "time": {"s": 1.0, "ms": 1e-3, "µs": 1e-6, "ns": 1e-9, "min": 60.0, "h": 3600.0},
    "length": {"m": 1.0, "mm": 1e-3, "µm": 1e-6, "nm": 1e-9, "km": 1e3, "in": 0.0254, "ft": 0.3048},
    "acceleration": {"m/s²": 1.0, "g": 9.80665, "cm/s²": 1e-2},
    "force": {"N": 1.0, "mN": 1e-3, "kN": 1e3, "lbf": 4.44822},
    "pressure": {"Pa": 1.0, "kPa": 1e3, "MPa": 1e6, "bar": 1e5, "mbar": 1e2, "atm": 101325.0, "psi": 6894.76},
    "angle": {"rad": 1.0, "deg": math.pi / 180.0, "°": math.pi / 180.0, "mrad": 1e-3},
    "temperature": {"K": 1.0, "°C": 1.0, "°F": 5.0 / 9.0},
}
# Added to a reading before scaling to kelvin.
TEMPERATURE_ZERO = {"K": 0.0, "°C": 273.15, "°F": 459.67}


def dimension_of(unit: str) -> str | None:
    return next((d for d, table in UNITS.items() if unit in table), None)


def convert(value, source: str, target: str) -> Column:
    """``value`` in ``source`` units expressed in ``target`` units."""
    dim, other = dimension_of(source), dimension_of(target)
    if dim is None or other is None:
        raise ValueError(f"unknown unit: {source if dim is None else target}")
    if dim != other:
        raise ValueError(f"incompatible dimensions: {dim} vs {other}")
    a, b = UNITS[dim][source], UNITS[dim][target]
    if dim == "temperature":
        return (as_col(value) + TEMPERATURE_ZERO[source]) * a / b - TEMPERATURE_ZERO[target]
    return as_col(value) * a / b


def guess_unit(name: str) -> str | None:
    """The unit written in a column name as ``name [unit]`` or ``name (unit)``."""
    for pattern in (r"\[([^\]]+)\]", r"\(([^)]+)\)"):
        found = re.search(pattern, name)
        if found:
            return found.group(1) if dimension_of(found.group(1)) else None
    return None
