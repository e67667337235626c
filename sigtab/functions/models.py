"""Curve models as column expressions, used to fit and to predict."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from sigtab.functions.expressions import ArrayCompiler, Compiler
from sigtab.functions.numeric import as_col

LEAST_WIDTH = 1e-12


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def _width(value) -> Column:
    return F.greatest(F.abs(_c(value)), F.lit(LEAST_WIDTH))


def _exp(value: Column) -> Column:
    return F.exp(F.least(F.greatest(value, F.lit(-700.0)), F.lit(700.0)))


def gaussian(x, amplitude, center, sigma, offset=0.0) -> Column:
    z = (as_col(x) - _c(center)) / _width(sigma)
    return _c(amplitude) * _exp(-0.5 * z * z) + _c(offset)


def lorentzian(x, amplitude, center, gamma, offset=0.0) -> Column:
    z = (as_col(x) - _c(center)) / _width(gamma)
    return _c(amplitude) / (1 + z * z) + _c(offset)


# Mixing share of the lorentzian as a polynomial of the ratio of both full widths.
MIXING = (1.36603, -0.47719, 0.11116)


def voigt(x, amplitude, center, sigma, gamma, offset=0.0) -> Column:
    """Pseudo-Voigt: a gaussian and a lorentzian of one centre, mixed by the ratio of their widths."""
    r = 2 * _width(gamma) / (_width(sigma) * (2 * math.sqrt(2 * math.log(2))) + LEAST_WIDTH)
    share = F.least(F.greatest(r * (MIXING[0] + r * (MIXING[1] + r * MIXING[2])), F.lit(0.0)), F.lit(1.0))
    return _c(amplitude) * (share * lorentzian(x, 1.0, center, gamma) + (1 - share) * gaussian(x, 1.0, center, sigma)) + _c(offset)


def logistic(x, top, rate, mid, offset=0.0) -> Column:
    return _c(top) / (1 + _exp(-_c(rate) * (as_col(x) - _c(mid)))) + _c(offset)


def exponential(x, amplitude, rate, offset=0.0) -> Column:
    return _c(amplitude) * _exp(_c(rate) * as_col(x)) + _c(offset)


def decay(x, amplitude, tau, offset=0.0) -> Column:
    return _c(amplitude) * _exp(-as_col(x) / _width(tau)) + _c(offset)


def double_decay(x, amplitude1, tau1, amplitude2, tau2, offset=0.0) -> Column:
    return decay(x, amplitude1, tau1) + decay(x, amplitude2, tau2, offset)


def power_law(x, amplitude, exponent, offset=0.0) -> Column:
    return _c(amplitude) * F.pow(as_col(x), _c(exponent)) + _c(offset)


def sine(x, amplitude, omega, phase, offset=0.0) -> Column:
    return _c(amplitude) * F.sin(_c(omega) * as_col(x) + _c(phase)) + _c(offset)


# name -> (builder, parameter names)
MODELS: dict[str, tuple[Callable, list[str]]] = {
    "gaussian": (gaussian, ["amplitude", "center", "sigma", "offset"]),
    "lorentzian": (lorentzian, ["amplitude", "center", "gamma", "offset"]),
    "voigt": (voigt, ["amplitude", "center", "sigma", "gamma", "offset"]),
    "logistic": (logistic, ["top", "rate", "mid", "offset"]),
    "exponential": (exponential, ["amplitude", "rate", "offset"]),
    "exp1": (decay, ["amplitude", "tau", "offset"]),
    "exp2": (double_decay, ["amplitude1", "tau1", "amplitude2", "tau2", "offset"]),
    "power": (power_law, ["amplitude", "exponent", "offset"]),
    "sine": (sine, ["amplitude", "omega", "phase", "offset"]),
}


def from_formula(formula: str, x: str, parameters: list[str]) -> Callable:
    """A model from formula text over ``x`` and named parameters."""
    def build(column, *values):
        known = {x: as_col(column), **{p: _c(v) for p, v in zip(parameters, values)}}

        def lookup(name: str) -> Column:
            if name not in known:
                raise KeyError(f"unknown name in a model: {name}")
            return known[name]

        return Compiler(lookup).compile(formula)

    build(F.lit(1.0), *[1.0] * len(parameters))
    return build


# ---- the same curves over arrays, for fits that run inside a task ----

def _wide(value: float) -> float:
    return max(abs(value), LEAST_WIDTH)


def _bell(x: np.ndarray, center: float, sigma: float) -> np.ndarray:
    return np.exp(np.maximum(-0.5 * ((x - center) / _wide(sigma)) ** 2, -700.0))


def _cauchy(x: np.ndarray, center: float, gamma: float) -> np.ndarray:
    return 1 / (1 + ((x - center) / _wide(gamma)) ** 2)


def _mixed(x: np.ndarray, center: float, sigma: float, gamma: float) -> np.ndarray:
    r = 2 * _wide(gamma) / (_wide(sigma) * (2 * math.sqrt(2 * math.log(2))) + LEAST_WIDTH)
    share = min(max(r * (MIXING[0] + r * (MIXING[1] + r * MIXING[2])), 0.0), 1.0)
    return share * _cauchy(x, center, gamma) + (1 - share) * _bell(x, center, sigma)


def _growth(value: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(value, -700.0, 700.0))


ARRAY_MODELS: dict[str, Callable] = {
    "gaussian": lambda x, a, c, s, o: a * _bell(x, c, s) + o,
    "lorentzian": lambda x, a, c, g, o: a * _cauchy(x, c, g) + o,
    "voigt": lambda x, a, c, s, g, o: a * _mixed(x, c, s, g) + o,
    "logistic": lambda x, top, rate, mid, o: top / (1 + _growth(-rate * (x - mid))) + o,
    "exponential": lambda x, a, rate, o: a * _growth(rate * x) + o,
    "exp1": lambda x, a, tau, o: a * _growth(-x / _wide(tau)) + o,
    "exp2": lambda x, a1, t1, a2, t2, o: a1 * _growth(-x / _wide(t1)) + a2 * _growth(-x / _wide(t2)) + o,
    "power": lambda x, a, e, o: a * np.power(x, e) + o,
    "sine": lambda x, a, omega, phase, o: a * np.sin(omega * x + phase) + o,
}


def array_formula(formula: str, x: str, parameters: list[str]) -> Callable:
    """The function of an array and parameter values that ``from_formula`` states as a column."""
    def value(at: np.ndarray, *values: float) -> np.ndarray:
        known = {x: at, **dict(zip(parameters, values))}
        return np.broadcast_to(np.asarray(ArrayCompiler(known.__getitem__).compile(formula), float), at.shape)

    return value
