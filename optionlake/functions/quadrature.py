"""Composite Simpson on a log-uniform grid, one weight per node.

On strikes x_i = F * exp(-h + i * delta) neighbouring intervals always stand in
the ratio r = exp(delta), so the three coefficients of Simpson's rule for uneven
intervals depend on x_i alone. An integral is then a plain sum of weight times
value: no neighbour lookups, no ordering, and a map-side partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_step(half_width: Column, nodes: int) -> Column:
    return half_width * 2.0 / (nodes - 1)


def simpson_weight(i: Column, nodes: int, x: Column, delta: Column) -> Column:
    """Weight of node ``i`` of an odd number of ``nodes`` at strike ``x``."""
    if nodes % 2 == 0:
        raise ValueError(f"Simpson's rule here needs an odd number of nodes, got {nodes}")
    r = F.exp(delta)
    width = x * F.expm1(delta * 2.0) / 6.0  # (h0 + h1) / 6 for a panel starting at x
    opens = F.when(i < nodes - 1, width * (F.lit(2.0) - r)).otherwise(0.0)
    closes = F.when(i > 0, width / (r * r) * (F.lit(2.0) - F.lit(1.0) / r)).otherwise(0.0)
    middle = width / (r * r) * (r + 1.0) * (r + 1.0)
    return F.when(i % 2 == 1, middle).otherwise(opens + closes)
