"""Raw SVI total variance and the density it implies, as Column expressions.

A smile is five columns (or literals) ``a, b, rho, m, sigma``. The expressions
also work inside higher-order-function lambdas, which is how the short
evaluations (a density peak, a minimum over a grid) stay local to one row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHT_FLOOR = 1e-12  # variance floor inside the Durrleman function
PDF_FLOOR = 1e-14     # variance floor inside the density


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


@dataclass(frozen=True)
class Smile:
    """The five parameters, each a Column or a number."""

    a: object
    b: object
    rho: object
    m: object
    sigma: object

    @classmethod
    def of(cls, prefix: str = "") -> "Smile":
        return cls(*[F.col(prefix + n) for n in ("a", "b", "rho", "m", "sigma")])

    def _parts(self, k: Column):
        x = k - _col(self.m)
        return x, F.sqrt(x * x + _col(self.sigma) * _col(self.sigma))

    def total_variance(self, k: Column) -> Column:
        x, root = self._parts(k)
        return _col(self.a) + _col(self.b) * (_col(self.rho) * x + root)

    def volatility(self, k: Column, tenor) -> Column:
        return F.sqrt(F.try_divide(F.greatest(self.total_variance(k), F.lit(0.0)), _col(tenor)))

    def slope(self, k: Column) -> Column:
        x, root = self._parts(k)
        return _col(self.b) * (_col(self.rho) + F.try_divide(x, root))

    def curvature(self, k: Column) -> Column:
        _, root = self._parts(k)
        return F.try_divide(_col(self.b) * _col(self.sigma) * _col(self.sigma), root * root * root)

    def durrleman(self, k: Column) -> Column:
        """Non-negative exactly where the implied density is."""
        w = F.greatest(self.total_variance(k), F.lit(WEIGHT_FLOOR))
        dw = self.slope(k)
        lead = F.lit(1.0) - k * dw / (w * 2.0)
        return lead * lead - dw * dw / 4.0 * (F.lit(1.0) / w + 0.25) + self.curvature(k) / 2.0

    def min_variance(self) -> Column:
        rho = _col(self.rho)
        return _col(self.a) + _col(self.b) * _col(self.sigma) * F.sqrt(F.lit(1.0) - rho * rho)

    def wing_slope(self) -> Column:
        return _col(self.b) * (F.abs(_col(self.rho)) + 1.0)

    def pdf(self, k: Column, forward) -> Column:
        """Risk-neutral density per unit strike at log-moneyness ``k``."""
        w = F.greatest(self.total_variance(k), F.lit(PDF_FLOOR))
        root = F.sqrt(w)
        d = -k / root - root / 2.0
        scale = _col(forward) * F.exp(k) * math.sqrt(2.0 * math.pi) * root
        return self.durrleman(k) / scale * F.exp(d * d * -0.5)
