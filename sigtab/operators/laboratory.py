"""Formulas over tables of measurements."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtab.functions.numeric import as_col, div, finite, keys

RANDLES_SEVCIK = 2.69e5  # fixed value, for A, cm², cm²/s, mol/cm³ and V/s at 298.15 K


def dilution_ppm(source_ppm, flow_gas, flow_total) -> Column:
    """Concentration after mixing; null where a flow is not positive or exceeds the total."""
    c, g, t = finite(as_col(source_ppm)), finite(as_col(flow_gas)), finite(as_col(flow_total))
    return F.when((g > 0) & (t >= g) & (c >= 0), c * g / F.when(t > 0, t))


def detection_limits(slope, noise_std) -> tuple[Column, Column]:
    """Limits of detection (3 sigma) and quantification (10 sigma); null for a zero slope."""
    m, s = F.abs(finite(as_col(slope))), finite(as_col(noise_std))
    s = F.when(s >= 0, s)
    return div(3 * s, m), div(10 * s, m)


def scherrer_size(two_theta_deg, fwhm_deg, wavelength: float = 1.5406, shape: float = 0.9) -> Column:
    """Crystallite size in the unit of the wavelength; null for a width that is not positive."""
    beta = F.radians(finite(as_col(fwhm_deg)))
    theta = F.radians(finite(as_col(two_theta_deg)) / 2)
    return F.when(beta > 0, F.lit(shape * wavelength) / (F.when(beta > 0, beta) * F.cos(theta)))


def active_area(slope, electrons: float = 1.0, diffusion: float = 1e-5, concentration: float = 1e-6, kelvin: float = 298.15) -> Column:
    """Electrochemically active area from a Randles-Sevcik slope."""
    if min(electrons, diffusion, concentration, kelvin) <= 0:
        raise ValueError("all constants must be positive")
    k = RANDLES_SEVCIK * electrons ** 1.5 * math.sqrt(diffusion) * concentration * math.sqrt(298.15 / kelvin)
    return F.abs(finite(as_col(slope))) / k


def propagate_product(df: DataFrame, value: str, uncertainty: str, power: str, by=None, coefficient: float = 1.0) -> DataFrame:
    """Value, absolute and relative uncertainty of coefficient · Π value^power per group of factors.

    A group with a zero value, or a negative base under a fractional power, gets nulls.
    """
    by = keys(by)
    v, u, p = finite(value), finite(uncertainty), finite(power)
    whole = p == F.round(p)
    ok = (v != 0) & (u >= 0) & p.isNotNull() & ((v > 0) | whole)
    odd = (v < 0) & (F.pmod(p, F.lit(2.0)) == 1)
    share = p * u / F.when(v != 0, v)
    t = df.groupBy(*by).agg(
        F.min(F.coalesce(ok, F.lit(False))).alias("_ok"), F.sum(p * F.log(F.when(v != 0, F.abs(v)))).alias("_log"),
        F.count_if(odd).alias("_neg"), F.sqrt(F.sum(share * share)).alias("relative"))
    sign = F.when(F.col("_neg") % 2 == 1, -1.0).otherwise(1.0)
    product = F.when(F.col("_ok"), F.lit(float(coefficient)) * sign * F.exp("_log"))
    return t.select(*by, product.alias("value"), (F.abs(product) * F.col("relative")).alias("uncertainty"),
                    F.when(F.col("_ok"), F.col("relative")).alias("relative"))
