"""What the Column expressions say of one node, for arrays of (smile, node) inside a task."""

from __future__ import annotations

import math

import numpy as np

from .normal import ERF_DEN, ERF_NUM, INV_SQRT_PI, MID_DEN, MID_NUM, TAIL_DEN, TAIL_NUM
from .svi import PDF_FLOOR, WEIGHT_FLOOR


def norm_cdf(x: np.ndarray) -> np.ndarray:
    """N(x) by the approximation of ``normal.erfc_sql``, each part evaluated where it holds."""
    z = x * -math.sqrt(0.5)
    y, out = np.abs(z), np.full(z.shape, np.nan)
    near, far = y <= 0.46875, y > 4.0
    t = z[near]
    out[near] = 1.0 - t * np.polyval(ERF_NUM, t * t) / np.polyval(ERF_DEN, t * t)
    for part, tail in ((~near & (y <= 4.0), False), (far, True)):
        t = y[part]
        coarse = np.rint(t * 16.0) / 16.0
        decay = np.exp(-coarse * coarse) * np.exp(-(t - coarse) * (t + coarse))
        if tail:
            inverse = 1.0 / (t * t)
            rest = (INV_SQRT_PI - inverse * np.polyval(TAIL_NUM, inverse) / np.polyval(TAIL_DEN, inverse)) / t
        else:
            rest = np.polyval(MID_NUM, t) / np.polyval(MID_DEN, t)
        upper = np.where(t >= 27.0, 0.0, decay * rest)
        out[part] = np.where(z[part] > 0, upper, 2.0 - upper)
    return 0.5 * out


def variance(p: dict, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Total variance with its slope and curvature; the last two are NaN at the point of a smile without width."""
    x = k - p["m"]
    square = x * x + p["sigma"] * p["sigma"]
    root = np.sqrt(square)
    w = p["a"] + p["b"] * (p["rho"] * x + root)
    return w, p["b"] * (p["rho"] + x / root), p["b"] * p["sigma"] * p["sigma"] / (square * root)


def pdf(k: np.ndarray, w: np.ndarray, slope: np.ndarray, bend: np.ndarray, forward: np.ndarray) -> np.ndarray:
    """``Smile.pdf`` of a variance and its derivatives."""
    v = np.maximum(w, WEIGHT_FLOOR)
    lead = 1.0 - k * slope / (v * 2.0)
    g = lead * lead - slope * slope / 4.0 * (1.0 / v + 0.25) + bend / 2.0
    root = np.sqrt(np.maximum(w, PDF_FLOOR))
    d = -k / root - root / 2.0
    return g / (forward * np.exp(k) * math.sqrt(2.0 * math.pi) * root) * np.exp(d * d * -0.5)


def simpson(nodes: int, x: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """``quadrature.simpson_weight`` of every node."""
    i, r = np.arange(nodes), np.exp(delta)
    width = x * np.expm1(delta * 2.0) / 6.0
    opens = np.where(i < nodes - 1, width * (2.0 - r), 0.0)
    closes = np.where(i > 0, width / (r * r) * (2.0 - 1.0 / r), 0.0)
    return np.where(i % 2 == 1, width / (r * r) * (r + 1.0) * (r + 1.0), opens + closes)
