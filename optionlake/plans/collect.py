"""Screening captures: validate, gate, explain, and the log that this leaves."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gate
from ..session import settle
from ..sources import payloads


def screen(
    bodies: DataFrame, seed: DataFrame | None = None, max_stale: timedelta = gate.MAX_STALE,
    force: bool = False, keep: Callable[[DataFrame], DataFrame] = settle,
) -> DataFrame:
    """Verdict and reason for each body of (ticker, capture_utc, body).

    Unusable bodies keep their ``error`` and get no verdict.
    """
    # A head is a few numbers of a body that took long to read: read it once.
    # An unusable one has no print to compare and must not become the state.
    heads = keep(
        payloads.snapshots(bodies).select(
            "ticker", "capture_utc", "feed_timestamp",
            F.when(F.col("error").isNull(), F.col("index_last_trade")).alias("index_last_trade"), "seqno", "spot", "n_options", "error"
        )
    )
    usable = F.col("error").isNull()
    judged = gate.judge(heads.withColumn("force", F.lit(force) & usable), seed, max_stale, keep=keep)
    judged = judged.withColumn("verdict", F.when(usable, F.col("verdict")))
    return gate.with_detail(judged, seed, max_stale, keep=keep).withColumn("detail", F.when(usable, F.col("detail")))


def outcomes(screened: DataFrame) -> DataFrame:
    """The health log a sequence of screened captures would have left."""
    failed = F.col("error").isNotNull()
    return screened.select(
        "ticker",
        F.col("capture_utc").alias("at"),
        F.when(failed, "BodyError").otherwise(F.col("verdict")).alias("verdict"),
        F.coalesce(F.col("verdict").isin(*gate.ACCEPTED), F.lit(False)).alias("written"),
        "error",
    )
