"""Risk-neutral densities of fitted smiles, and the integrals taken of them.

Input everywhere: one row per smile with ``a, b, rho, m, sigma``, ``forward``,
``discount`` and ``k_required`` (how far the grid must reach at least).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import black76, grid
from ..functions.quadrature import log_step, simpson_weight
from ..functions.svi import PDF_FLOOR, Smile
from ..session import spread

# Grid sizes and the half-width search.
NODES = 2001
SPAN_NODES = 4001
TAIL = 1e-13
MAX_HALF_WIDTH = 8.0
WIDEN = 1.5
START = 0.25
PEAK_REACH = 0.5
PEAK_POINTS = 101
IS_PROPER_MIN = -1e-10
IS_PROPER_MASS = 1e-3
# From the narrowest start, this many widenings pass the cap.
_TRIES = 9


def half_widths(p: dict[str, np.ndarray], tail: float = TAIL) -> np.ndarray:
    """Log half-width of every smile where its density has died out against its own peak; parameters are columns of numbers."""

    def density(k):
        w, slope, bend = grid.variance(p, k)
        undefined = (k == p["m"]) & (p["sigma"] == 0)  # the point of a smile without width
        return np.where(undefined, -np.inf, grid.pdf(k, w, slope, bend, p["forward"]))

    required = p["k_required"]
    peak = density(2.0 * PEAK_REACH / (PEAK_POINTS - 1) * np.arange(PEAK_POINTS) - PEAK_REACH).max(1, keepdims=True)
    atm = np.sqrt(np.maximum(grid.variance(p, np.zeros((1, 1)))[0], 0.0))
    tried = np.maximum(np.maximum(required, atm * 4.0), START) * WIDEN ** np.arange(_TRIES + 1.0)
    ends = np.maximum(*(np.where(np.isneginf(d), d, np.abs(d)) for d in (density(tried), density(-tried))))
    fades = (tried >= MAX_HALF_WIDTH) | (ends < peak * tail)
    first = np.take_along_axis(tried, fades.argmax(1)[:, None], 1)
    found = np.where(fades.any(1, keepdims=True), np.minimum(first, MAX_HALF_WIDTH), MAX_HALF_WIDTH)
    return np.where((peak > 0) & (peak < np.inf), found, np.maximum(required, 1.0))[:, 0]


def _half_width():
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, rho: pd.Series, m: pd.Series, sigma: pd.Series, forward: pd.Series, k_required: pd.Series) -> pd.Series:
        given = {"a": a, "b": b, "rho": rho, "m": m, "sigma": sigma, "forward": forward, "k_required": k_required}
        with np.errstate(all="ignore"):
            return pd.Series(half_widths({n: c.to_numpy("float64")[:, None] for n, c in given.items()}))

    return run


def with_half_width(smiles: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Add ``half_width``, with the smiles spread over tasks for the grids to come.

    It takes 121 densities a smile; lambdas over arrays are interpreted, and
    repeat the peak wherever it is named, so this is one Arrow function.
    """
    given = [F.col(c).cast("double") for c in ("a", "b", "rho", "m", "sigma", "forward")]
    return spread(smiles, *keys).withColumn("half_width", _half_width()(*given, F.coalesce("k_required", F.lit(0.0))))


def on_grid(smiles: DataFrame, nodes: int = NODES) -> DataFrame:
    """One row per grid node: ``i``, ``k`` and ``strike``. Rows stay where they are."""
    delta = log_step(F.col("half_width"), nodes)
    last = F.when(F.col("a").isNull(), 0).otherwise(nodes - 1)
    return (
        smiles.withColumn("i", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("k", delta * F.col("i") - F.col("half_width"))
        .withColumn("strike", F.col("forward") * F.exp("k"))
    )


def from_smile(smiles: DataFrame, keys: list[str] = (), nodes: int = NODES) -> DataFrame:
    """Closed-form density on the grid."""
    return on_grid(with_half_width(smiles, keys), nodes).withColumn(
        "pdf", Smile.of().pdf(F.col("k"), F.col("forward"))
    )


def from_finite_differences(smiles: DataFrame, keys: list[str], nodes: int = NODES) -> DataFrame:
    """The same density by differencing Black-76 calls twice: an independent check.

    A window holds one grid (``nodes`` rows), never more. The second difference
    is the one for uneven spacing; end nodes take their neighbour's value.
    """
    spaced = on_grid(with_half_width(smiles, keys), nodes)
    vol = F.sqrt(F.greatest(Smile.of().total_variance(F.col("k")), F.lit(PDF_FLOOR)))
    priced = black76.with_price(
        spaced, "_call", F.col("forward"), F.col("strike"), vol, F.col("discount"), "call"
    )
    order = Window.partitionBy(*keys).orderBy("i")
    back = F.col("strike") - F.lag("strike").over(order)
    ahead = F.lead("strike").over(order) - F.col("strike")
    rise = (F.lead("_call").over(order) - F.col("_call")) / ahead
    fall = (F.col("_call") - F.lag("_call").over(order)) / back
    inner = priced.withColumn("_pdf", (rise - fall) * 2.0 / (back + ahead) / F.col("discount"))
    return inner.withColumn(
        "pdf",
        F.coalesce(
            F.col("_pdf"),
            F.when(F.col("i") == 0, F.lead("_pdf").over(order)).otherwise(F.lag("_pdf").over(order)),
        ),
    ).drop("_call", "_pdf")


def _weighted(density: DataFrame, nodes: int) -> DataFrame:
    return density.withColumn(
        "_m",
        simpson_weight(F.col("i"), nodes, F.col("strike"), log_step(F.col("half_width"), nodes))
        * F.col("pdf"),
    )


def diagnostics(density: DataFrame, keys: list[str], nodes: int = NODES) -> DataFrame:
    """total_mass, min_pdf, max_pdf, implied_forward and is_proper per density."""
    return (
        _weighted(density, nodes)
        .groupBy(*keys)
        .agg(
            F.sum("_m").alias("total_mass"),
            F.min("pdf").alias("min_pdf"),
            F.max("pdf").alias("max_pdf"),
            F.sum(F.col("_m") * F.col("strike")).alias("implied_forward"),
        )
        .withColumn(
            "is_proper",
            (F.col("min_pdf") >= IS_PROPER_MIN) & (F.abs(F.col("total_mass") - 1.0) < IS_PROPER_MASS),
        )
    )


def moment(density: DataFrame, keys: list[str], power: int, nodes: int = NODES) -> DataFrame:
    return _weighted(density, nodes).groupBy(*keys).agg(
        F.sum(F.col("_m") * F.pow("strike", F.lit(power))).alias("moment")
    )


def cdf(density: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative trapezoid from the low end. A window holds one grid, never more."""
    order = Window.partitionBy(*keys).orderBy("i")
    area = (F.col("pdf") + F.lag("pdf").over(order)) / 2.0 * (
        F.col("strike") - F.lag("strike").over(order)
    )
    steps = density.withColumn("_area", F.coalesce(area, F.lit(0.0)))
    return steps.withColumn(
        "cdf", F.sum("_area").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_area")


def quantiles(density: DataFrame, keys: list[str], levels: list[float]) -> DataFrame:
    """Strike below which each probability sits, interpolated on the scaled CDF."""
    order = Window.partitionBy(*keys).orderBy("i")
    whole = Window.partitionBy(*keys)
    scaled = (
        cdf(density, keys)
        .withColumn("_c", F.col("cdf") / F.max(F.struct("i", "cdf")).over(whole)["cdf"])
        .withColumn("_c0", F.lag("_c").over(order))
        .withColumn("_x0", F.lag("strike").over(order))
    )
    wanted = scaled.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in levels])))
    inside = wanted.where((F.col("_c") >= F.col("p")) & ((F.col("_c0") < F.col("p")) | F.col("_c0").isNull()))
    at = F.when(
        F.col("_c0").isNull(), F.col("strike")
    ).otherwise(
        F.col("_x0") + (F.col("p") - F.col("_c0")) / (F.col("_c") - F.col("_c0")) * (F.col("strike") - F.col("_x0"))
    )
    # A CDF that dips over negative density can cross a level twice: the first.
    return inside.groupBy(*keys, "p").agg(F.min_by(at, F.col("i")).alias("strike"))
