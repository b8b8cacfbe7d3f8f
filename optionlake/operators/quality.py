"""Per-quote quality flags, the drop step, and what each rule cost."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEY

FLAGS = ["zero_bid", "zero_ask", "crossed", "wide_spread", "zero_iv", "expired", "zero_dte", "itm"]
NO_FORWARD = "no_usable_forward"


@dataclass(frozen=True)
class Filters:
    """Thresholds behind the flags and the set of flags that remove a quote."""

    max_relative_spread: float = 0.5
    min_tenor_years: float = 1.0 / 365.0
    drop: frozenset = frozenset(set(FLAGS) - {"zero_iv"})

    def without(self, *flags: str) -> "Filters":
        return replace(self, drop=self.drop - set(flags))


STRICT = Filters()
PERMISSIVE = Filters(drop=frozenset())


def is_otm(right: Column, strike: Column, forward: Column) -> Column:
    """At the forward both rights are out of the money."""
    return F.when(right == "call", strike >= forward).otherwise(strike <= forward)


def missing_as_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN to NULL. Spark orders NaN above every number, so ``NaN > x`` holds."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in columns})


def add_flags(quotes: DataFrame, filters: Filters = STRICT) -> DataFrame:
    """Attach mid, spread, relative_spread and one boolean per flag.

    Needs ``forward`` and ``tenor_years``. A quote with a missing side has no
    mid and so an infinite relative spread: it is wide, not merely unknown.
    """

    def holds(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    bid, ask = F.col("bid"), F.col("ask")
    return (
        missing_as_null(quotes, "bid", "ask", "iv", "forward", "tenor_years")
        .withColumns({"mid": (bid + ask) / 2.0, "spread": ask - bid})
        .withColumn(
            "relative_spread",
            F.coalesce(F.when(F.col("mid") > 0, F.col("spread") / F.col("mid")), F.lit(float("inf"))),
        )
        .withColumns(
            {
                "zero_bid": holds(bid <= 0),
                "zero_ask": holds(ask <= 0),
                "crossed": holds(bid > ask),
                "wide_spread": F.col("relative_spread") > filters.max_relative_spread,
                "zero_iv": holds(F.col("iv") == 0.0),
                "expired": holds(F.col("tenor_years") <= 0),
                "zero_dte": holds(F.col("tenor_years") < filters.min_tenor_years),
                "itm": ~holds(is_otm(F.col("option_right"), F.col("strike"), F.col("forward"))),
            }
        )
    )


def drop_condition(filters: Filters = STRICT) -> Column:
    active = [F.col(f) for f in FLAGS if f in filters.drop]
    return reduce(or_, active) if active else F.lit(False)


def keep(flagged: DataFrame, filters: Filters = STRICT) -> DataFrame:
    return flagged.where(~drop_condition(filters))


def attrition_by_expiry(flagged: DataFrame, filters: Filters = STRICT) -> DataFrame:
    """One row per smile: quotes in, quotes kept, and every flag's count."""
    return flagged.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_in"),
        F.count_if(~drop_condition(filters)).alias("n_kept"),
        *[F.count_if(F.col(f)).alias(f) for f in FLAGS],
    )


def attrition_totals(assessed: DataFrame, filters: Filters = STRICT) -> DataFrame:
    """One row per capture over all its quotes, those without a forward too.

    ``assessed`` holds every quote, flagged where it has a forward. Flags of a
    quote without a forward count nowhere but in ``no_usable_forward``.
    """
    has = F.col("forward").isNotNull()
    totals = assessed.groupBy("capture_utc").agg(
        F.count(F.lit(1)).alias("total_in"),
        F.count_if(has & ~drop_condition(filters)).alias("total_kept"),
        *[F.count_if(has & F.col(f)).alias(f) for f in FLAGS],
        F.count_if(~has).alias(NO_FORWARD),
    )
    return totals.withColumn(
        "total_dropped", F.col("total_in") - F.col("total_kept")
    ).withColumn(
        "kept_fraction", F.coalesce(F.try_divide(F.col("total_kept"), F.col("total_in")), F.lit(0.0))
    )


def attrition_by_rule(totals: DataFrame) -> DataFrame:
    """Long form of the totals: every flag always, the forward rule when it hit."""
    rules = [*FLAGS, NO_FORWARD]
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("flagged")) for r in rules])
    return (
        totals.select("capture_utc", "total_in", F.inline(pairs))
        .where((F.col("rule") != NO_FORWARD) | (F.col("flagged") > 0))
    )
