"""Filter and window coefficients, computed once on the driver or per task."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def butterworth(order: int, kind: str, cutoff, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Digital Butterworth polynomials (numerator, denominator) by the bilinear transform."""
    edges = np.atleast_1d(np.asarray(cutoff, float))
    if kind not in ("lowpass", "highpass", "bandpass", "bandstop"):
        raise ValueError(f"unknown filter kind: {kind}")
    if len(edges) != (2 if kind.startswith("band") else 1) or not np.all((0 < edges) & (edges < fs / 2)) or np.any(np.diff(edges) <= 0):
        raise ValueError("cut-offs must rise and lie between 0 and half the sampling rate")
    warped = np.tan(np.pi * edges / fs)
    proto = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if kind == "lowpass":
        poles, zeros, gain = warped[0] * proto, np.empty(0), warped[0] ** order
    elif kind == "highpass":
        poles, zeros, gain = warped[0] / proto, np.zeros(order), 1.0
    else:
        width, centre2 = warped[1] - warped[0], warped[0] * warped[1]
        base = width * proto / 2 if kind == "bandpass" else width / proto / 2
        root = np.sqrt(base ** 2 - centre2)
        poles = np.concatenate([base + root, base - root])
        if kind == "bandpass":
            zeros, gain = np.zeros(order), width ** order
        else:
            zeros, gain = np.concatenate([np.full(order, 1j), np.full(order, -1j)]) * math.sqrt(centre2), 1.0
    gain = gain * np.real(np.prod(1 - zeros) / np.prod(1 - poles))
    z_poles = (1 + poles) / (1 - poles)
    z_zeros = np.concatenate([(1 + zeros) / (1 - zeros), -np.ones(len(poles) - len(zeros))])
    return np.real(gain * np.poly(z_zeros)), np.real(np.poly(z_poles))


def _state(b: np.ndarray, a: np.ndarray):
    """Companion form of the filter and its state for a constant input of one."""
    m = len(a) - 1
    b = np.pad(b, (0, len(a) - len(b)))
    A = np.zeros((m, m))
    A[:, 0] = -a[1:]
    A[:-1, 1:] = np.eye(m - 1)
    B = b[1:] - a[1:] * b[0]
    return A, B, b[0], np.linalg.solve(np.eye(m) - A, B)


def step_matrix(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """What one sample does to the state of the filter."""
    return _state(b, a)[0]


def rest_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The state after an input of one that has lasted forever."""
    return _state(b, a)[3]


def recurse(b, a, v: np.ndarray, x: np.ndarray, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """The recursive filter over ``v`` from state ``x`` on, in blocks, and the state at its end."""
    A, B, d, _ = _state(b, a)
    m = len(A)
    powers = [np.eye(m)]
    for _ in range(block):
        powers.append(powers[-1] @ A)
    see = np.array([p[0] for p in powers[:block]])  # state to output
    impulse = np.concatenate([[d], [p[0] @ B for p in powers[: block - 1]]])
    lag = np.subtract.outer(np.arange(block), np.arange(block))
    respond = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    feed = np.array([powers[block - 1 - k] @ B for k in range(block)]).T
    out = np.empty(len(v))
    whole = len(v) // block * block
    for s in range(0, whole, block):
        u = v[s:s + block]
        out[s:s + block] = see @ x + respond @ u
        x = powers[block] @ x + feed @ u
    tail = len(v) - whole
    if tail:
        out[whole:] = see[:tail] @ x + respond[:tail, :tail] @ v[whole:]
        x = powers[tail] @ x + feed[:, block - tail:] @ v[whole:]
    return out, x


def run_filter(b, a, v: np.ndarray) -> np.ndarray:
    """The recursive filter over ``v``, started as if the first value had lasted forever."""
    return recurse(b, a, v, rest_state(b, a) * v[0])[0]


def zero_phase(b, a, v: np.ndarray, pad: int) -> np.ndarray:
    """Filter forwards and backwards over the oddly extended values."""
    pad = min(pad, len(v) - 1)
    ext = np.pad(v, pad, mode="reflect", reflect_type="odd") if pad > 0 else v
    both = run_filter(b, a, run_filter(b, a, ext)[::-1])[::-1]
    return both[pad: len(both) - pad] if pad > 0 else both


def savgol_matrix(window: int, degree: int) -> np.ndarray:
    """Row r gives the weights of the window that yield the fitted polynomial at position r."""
    t = np.arange(window) - window // 2
    v = np.vander(t / max(1, window // 2), degree + 1, increasing=True)
    return v @ np.linalg.pinv(v)


def gaussian_taps(sigma: float) -> np.ndarray:
    """Normalised Gaussian weights out to four standard deviations."""
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return w / w.sum()


def window_values(kind: str, n: int, periodic: bool = False) -> np.ndarray:
    """Taper of n points; ``periodic`` drops the last point of a taper one longer."""
    m = n + 1 if periodic else n
    if kind in ("none", "boxcar"):
        return np.ones(n)
    made = {"hann": np.hanning, "hanning": np.hanning, "hamming": np.hamming, "blackman": np.blackman}.get(kind)
    if made is None:
        raise ValueError(f"unknown window: {kind}")
    if periodic and kind == "hamming":
        return (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(m) / (m - 1)))[:n]
    return made(m)[:n]


def window_column(kind: str, index: Column, n: Column, beta: float = 14.0) -> Column:
    """The taper weight of position ``index`` in a series of ``n`` rows."""
    last = F.when(n > 1, n - 1).otherwise(F.lit(1)).cast("double")
    phase = F.lit(2 * math.pi) * index / last
    if kind in ("none", "boxcar"):
        value = F.lit(1.0)
    elif kind in ("hann", "hanning"):
        value = F.lit(0.5) - 0.5 * F.cos(phase)
    elif kind == "hamming":
        value = F.lit(0.54) - 0.46 * F.cos(phase)
    elif kind == "blackman":
        value = F.lit(0.42) - 0.5 * F.cos(phase) + 0.08 * F.cos(2 * phase)
    elif kind == "kaiser":
        half = last / 2
        u = (index - half) / half
        value = _bessel0(F.lit(beta * beta / 4) * F.greatest(F.lit(1.0) - u * u, F.lit(0.0))) / _bessel0(F.lit(beta * beta / 4))
    else:
        raise ValueError(f"unknown window: {kind}")
    return F.when(n > 1, value).otherwise(F.lit(1.0))


def _bessel0(q: Column, terms: int = 60) -> Column:
    """Modified Bessel function of order zero as a power series in x²/4."""
    return F.aggregate(
        F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), F.lit(1.0),
        lambda s, k: F.lit(1.0) + s * q / (k * k).cast("double"))
