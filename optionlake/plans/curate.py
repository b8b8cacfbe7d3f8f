"""Curating captures: mids, forwards, flags and the drop, in a fixed order.

The forward is fitted on every quote with a live bid, in-the-money ones too,
because parity needs both legs; moneyness and so the ITM flag need the forward.
All captures of a frame are curated in one plan.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import forwards as fwd
from ..operators import quality
from ..schema import KEY

COLUMNS = [
    "capture_utc", "option_symbol", "root", "option_right", "expiry", "strike", "bid", "ask", "iv",
    "theo", "delta", "open_interest", "volume", "underlying_price",
]


@dataclass(frozen=True)
class CuratedChain:
    """Lazy frames of one or many captures."""

    assessed: DataFrame
    """Every quote, with forward columns and flags (flags matter where a forward is)."""

    forwards: DataFrame
    """One row per smile, including excluded ones with their reason."""

    filters: quality.Filters = quality.STRICT

    @property
    def flagged(self) -> DataFrame:
        return self.assessed.where("forward is not null")

    @property
    def quotes(self) -> DataFrame:
        return quality.keep(self.flagged, self.filters)

    @property
    def usable_forwards(self) -> DataFrame:
        return self.forwards.where("usable")

    @property
    def totals(self) -> DataFrame:
        return quality.attrition_totals(self.assessed, self.filters)

    @property
    def by_rule(self) -> DataFrame:
        return quality.attrition_by_rule(self.totals)

    @property
    def by_expiry(self) -> DataFrame:
        return quality.attrition_by_expiry(self.flagged, self.filters)

    def expiries(self) -> DataFrame:
        return self.quotes.select("capture_utc", "expiry").distinct()

    def for_expiry(self, expiry: date | None, root: str) -> DataFrame:
        """The surviving quotes of one smile, or of a root's every expiry."""
        here = F.col("root") == root
        return self.quotes.where(here if expiry is None else here & (F.col("expiry") == F.lit(expiry)))

    def forward_summary(self) -> DataFrame:
        """Per capture: usable of all, R2 and implied-rate range over the usable."""
        ok = F.col("usable")
        return self.forwards.groupBy("capture_utc").agg(
            F.count(F.lit(1)).alias("n_forwards"),
            F.count_if(ok).alias("n_usable"),
            F.min(F.when(ok, F.col("r2"))).alias("min_r2"),
            F.median(F.when(ok, F.col("r2"))).alias("median_r2"),
            F.min(F.when(ok, F.col("rate"))).alias("min_rate"),
            F.max(F.when(ok, F.col("rate"))).alias("max_rate"),
        )


def add_mid(quotes: DataFrame) -> DataFrame:
    return quality.missing_as_null(quotes, "bid", "ask", "iv").withColumn(
        "mid", (F.col("bid") + F.col("ask")) / 2.0
    )


def build(
    quotes: DataFrame,
    filters: quality.Filters = quality.STRICT,
    min_pairs: int = fwd.MIN_PAIRS,
    min_r2: float = fwd.MIN_R2,
) -> CuratedChain:
    """Curate quotes that carry the key, contract, bid, ask and iv columns."""
    with_mid = add_mid(quotes)
    # On the stored column first: that comparison reaches the Parquet scan.
    forwards = fwd.fit_forwards(add_mid(quotes.where("bid > 0")), min_pairs, min_r2)
    # No broadcast hint: AQE broadcasts the forwards when their measured size is
    # small, and splits hot partitions of the quotes when it is not.
    attached = with_mid.join(
        forwards.select(*KEY, "tenor_years", "forward", "discount", "rate"), KEY, "left"
    ).withColumn("log_moneyness", clock.log_moneyness(F.col("strike"), F.col("forward")))
    return CuratedChain(quality.add_flags(attached, filters), forwards, filters)


def from_catalog(quotes: DataFrame, capture_utc: datetime, **options) -> CuratedChain:
    """One capture out of the curated table, reading only the columns it needs."""
    here = F.col("capture_utc") == F.lit(capture_utc)
    if "capture_date" in quotes.columns:  # the table's partitions: only that day is read
        here = here & (F.col("capture_date") == F.to_date(F.lit(capture_utc)))
    chosen = quotes.where(here).select(*COLUMNS)
    if chosen.isEmpty():
        raise ValueError(f"no quotes for capture {capture_utc}")
    return build(chosen, **options)
