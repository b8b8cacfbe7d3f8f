"""Densities, moments and a trust verdict for every smile of every capture."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import density, inversion, smile
from ..operators.moments import annualised_vol, moments
from ..schema import KEY

COLUMNS = [
    "expiry", "root", "tenor_years", "days", "forward", "n_quotes", "rmse_vol", "min_durrleman",
    "mass", "min_pdf", "forward_error", "annualised_vol", "skewness", "kurtosis", "bl_bkm_gap",
    "trustworthy", "failures", "excluded",
]


@dataclass(frozen=True)
class Thresholds:
    """What counts as trustworthy. Fixed default values."""

    max_rmse_vol: float = 0.01
    min_durrleman: float = -1e-6
    max_mass_error: float = 1e-4
    max_moment_disagreement: float = 1e-2
    max_forward_error: float = 1e-4
    min_pdf_relative: float = -1e-5
    min_quotes: int = smile.MIN_QUOTES


def _failures(t: Thresholds):
    """The checks an estimate did not pass, named with their numbers, in order."""
    dip = F.try_divide("min_pdf", "max_pdf")
    off = F.abs(F.col("forward_error"))
    checks = [
        (F.col("rmse_vol") > t.max_rmse_vol, F.format_string("fit rmse %.4f vol pts", "rmse_vol")),
        (F.col("min_durrleman") < t.min_durrleman, F.format_string("durrleman %.2e", "min_durrleman")),
        (F.abs(F.col("mass") - 1.0) > t.max_mass_error, F.format_string("mass %.6f", "mass")),
        (
            (F.col("max_pdf") > 0) & (dip < t.min_pdf_relative),
            F.format_string("negative density %.2e (%.1e of peak)", "min_pdf", dip),
        ),
        (
            off.isNull() | F.isnan(off) | (off > t.max_forward_error),
            F.coalesce(F.format_string("E[S]/F - 1 = %.2e", off), F.lit("E[S]/F - 1 = nan")),
        ),
        (
            F.col("bl_bkm_gap") > t.max_moment_disagreement,
            F.format_string("BL/BKM disagree %.2e", "bl_bkm_gap"),
        ),
    ]
    return F.concat_ws("; ", *[F.when(bad, text) for bad, text in checks])


def fits(
    quotes: DataFrame, thresholds: Thresholds = Thresholds(), penalty: float = smile.PENALTY, solver=None
) -> DataFrame:
    """Fitted smiles of curated quotes, inverting implied vols where missing."""
    prepared = quotes if "total_variance" in quotes.columns else inversion.prepare(quotes)
    return smile.fit(smile.curves(prepared), penalty, thresholds.min_quotes, solver=solver)


def judge(fitted: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Attach moments, the verdict and its reasons to fitted smiles.

    One pass: fits are costly, so they are never read twice for a join.
    """
    carried = [c for c in fitted.columns if c not in KEY]
    measured = moments(fitted, KEY, carried).withColumn(
        "forward_error", F.try_divide("implied_forward", "forward") - 1.0
    )
    estimated = F.col("excluded").isNull()
    return measured.withColumns(
        {
            "failures": F.when(estimated, _failures(thresholds)).otherwise(""),
            "days": F.col("tenor_years") * 365.0,
            "annualised_vol": annualised_vol(F.col("bl_variance"), F.col("tenor_years")),
        }
    ).withColumn("trustworthy", estimated & (F.col("failures") == ""))


def estimate_all(
    quotes: DataFrame, thresholds: Thresholds = Thresholds(), penalty: float = smile.PENALTY, solver=None
) -> DataFrame:
    """The term structure of every capture, excluded smiles and failures included."""
    judged = judge(fits(quotes, thresholds, penalty, solver), thresholds)
    return judged.withColumnsRenamed({"bl_skewness": "skewness", "bl_kurtosis": "kurtosis"}).select(
        "capture_utc", *COLUMNS
    )


def densities(fitted: DataFrame) -> DataFrame:
    """The density of every usable fit, one row per strike node."""
    return density.from_smile(fitted.where("excluded is null"), KEY).select(
        *KEY, "tenor_years", "forward", "discount", "i", "k", "strike", "pdf"
    )


def summary(estimates: DataFrame) -> DataFrame:
    """Per capture: counts, and the worst figures among the trustworthy."""
    ok = F.col("trustworthy")

    def among(value):
        return F.when(ok, value)

    return estimates.groupBy("capture_utc").agg(
        F.count(F.lit(1)).alias("n_smiles"),
        F.count_if(ok).alias("n_trustworthy"),
        F.count("excluded").alias("n_excluded"),
        F.max(among(F.col("rmse_vol"))).alias("max_rmse_vol"),
        F.max(among(F.abs(F.col("mass") - 1.0))).alias("worst_mass"),
        F.max(among(F.abs(F.col("forward_error")))).alias("worst_forward_error"),
        F.max(among(F.col("bl_bkm_gap"))).alias("worst_gap"),
        F.min(among(F.col("annualised_vol"))).alias("min_vol"),
        F.max(among(F.col("annualised_vol"))).alias("max_vol"),
    )
