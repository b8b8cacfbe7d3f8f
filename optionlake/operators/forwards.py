"""Forward and discount factor per smile, by put-call parity.

    C(K) - P(K) = D * (F - K)

so the least-squares line of C - P on K has slope -D and intercept D * F. The
fit runs over every call/put pair at a strike without ever forming the pairs:
the count, mean and spread of each side at a strike carry exactly what the pairs
would contribute (n_c * n_p pairs with mean difference c - p). The only shuffles
are therefore of partial aggregates, and a strike quoted a million times costs
one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..schema import KEY

# Exclusion thresholds.
MIN_PAIRS = 8
MIN_R2 = 0.99
MAX_DISCOUNT = 1.5
MAX_ABS_RATE = 0.25

COLUMNS = [
    "tenor_years", "forward", "discount", "rate", "n_pairs", "r2", "rmse", "excluded", "usable",
]


def _per_strike(quotes: DataFrame, keys: list[str]) -> DataFrame:
    sides = {}
    for name in ("call", "put"):
        mid = F.when(F.col("option_right") == name, F.col("mid"))
        sides[name] = [
            F.count(mid).alias(f"{name}_n"),
            F.avg(mid).alias(f"{name}_mean"),
            (F.var_pop(mid) * F.count(mid)).alias(f"{name}_ss"),
        ]
    pairs = (F.col("call_n") * F.col("put_n")).cast("double")
    return (
        quotes.groupBy(*keys, "strike")
        .agg(*sides["call"], *sides["put"])
        .select(
            *keys,
            F.when(pairs > 0, F.col("strike")).alias("k"),
            F.when(pairs > 0, F.col("call_mean") - F.col("put_mean")).alias("y"),
            F.when(pairs > 0, pairs).otherwise(0.0).alias("w"),
            F.when(
                pairs > 0,
                F.col("put_n") * F.col("call_ss") + F.col("call_n") * F.col("put_ss"),
            ).otherwise(0.0).alias("within"),
        )
    )


def parity_line(quotes: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Slope, intercept, R2 and RMSE of C - P on K for every group with a quote.

    Two passes over the per-strike aggregates. The second is taken around the
    means and around the first pass's line, so nothing cancels: a residual sum
    that is tiny next to the total keeps its digits.
    """
    points = _per_strike(quotes, keys)
    rough = points.groupBy(*keys).agg(
        F.sum("w").cast("long").alias("n_pairs"),
        F.try_divide(F.sum(F.col("w") * F.col("k")), F.sum("w")).alias("k_mean"),
        F.try_divide(F.sum(F.col("w") * F.col("y")), F.sum("w")).alias("y_mean"),
        F.coalesce(F.regr_slope("y", "k"), F.lit(0.0)).alias("slope0"),
        (F.max("k") - F.min("k")).alias("k_range"),
        # Read here too so both passes read the same columns and share a shuffle.
        F.sum("within").alias("spread"),
    )
    dk = F.col("k") - F.col("k_mean")
    dy = F.col("y") - F.col("y_mean")
    off = dy - F.col("slope0") * dk
    fine = (
        points.join(rough, keys)
        .groupBy(*keys)
        .agg(
            *[F.first(c).alias(c) for c in ("n_pairs", "k_mean", "y_mean", "slope0", "k_range", "spread")],
            F.sum(F.col("w") * dk * dk).alias("sxx"),
            F.sum(F.col("w") * off * dk).alias("sxr"),
            F.sum(F.col("w") * off * off + F.col("within")).alias("srr"),
            F.sum(F.col("w") * dy * dy).alias("between"),
        )
    )
    correction = F.try_divide(F.col("sxr"), F.col("sxx"))
    ss_res = F.greatest(F.col("srr") - correction * F.col("sxr"), F.lit(0.0))
    slope = F.col("slope0") + correction
    total = F.col("between") + F.col("spread")
    return fine.select(
        *keys,
        "n_pairs",
        F.coalesce("k_range", F.lit(0.0)).alias("k_range"),
        slope.alias("slope"),
        (F.col("y_mean") - slope * F.col("k_mean")).alias("intercept"),
        F.when(total > 0, F.lit(1.0) - ss_res / total).otherwise(0.0).alias("r2"),
        F.sqrt(F.try_divide(ss_res, F.col("n_pairs"))).alias("rmse"),
    )


def _reason(min_pairs: int, min_r2: float) -> Column:
    """Why a smile has no forward, tested in a fixed order; NULL when it has one."""
    n, d, r2 = F.col("n_pairs"), F.col("_discount"), F.col("_r2")
    forward, rate = F.col("_forward"), F.col("_rate")
    return (
        F.when(F.col("tenor_years") <= 0, F.lit("expired"))
        .when(n < min_pairs, F.format_string(f"only %d call/put pairs, need {min_pairs}", n))
        .when(F.col("k_range") == 0, F.lit("all pairs at one strike"))
        .when(d <= 0, F.format_string("non-positive discount factor %.4f", d))
        .when(d > MAX_DISCOUNT, F.format_string("implausible discount factor %.4f", d))
        .when(r2 < min_r2, F.format_string(f"parity fit R2 %.4f below {min_r2}", r2))
        .when(forward <= 0, F.concat(F.lit("non-positive forward "), forward.cast("string")))
        .when(
            F.abs(rate) > MAX_ABS_RATE,
            F.format_string(
                f"implied rate %.1f%% outside +/-{MAX_ABS_RATE * 100:.0f}%%", rate * 100.0
            ),
        )
    )


def fit_forwards(
    quotes: DataFrame, min_pairs: int = MIN_PAIRS, min_r2: float = MIN_R2
) -> DataFrame:
    """One row per (capture, expiry, root) with a live bid, excluded ones included.

    ``quotes`` needs the key columns, ``strike``, ``option_right``, ``bid`` and
    ``mid``. In- and out-of-the-money quotes both take part: parity needs both.
    """
    line = parity_line(quotes.where("bid > 0"))
    discount = -F.col("slope")
    fits = (
        line.withColumn(
            "tenor_years", clock.tenor_years(F.col("expiry"), F.col("root"), F.col("capture_utc"))
        )
        .withColumn("_discount", F.when(F.col("k_range") > 0, discount))
        .withColumn("_forward", F.when(F.col("_discount") > 0, F.col("intercept") / F.col("_discount")))
        .withColumn(
            "_rate",
            F.when(
                (F.col("_discount") > 0) & (F.col("tenor_years") != 0),
                -F.ln("_discount") / F.col("tenor_years"),
            ),
        )
        .withColumn("_r2", F.col("r2"))
        .withColumn("excluded", _reason(min_pairs, min_r2))
    )
    usable = F.col("excluded").isNull()
    # n_pairs is never counted for an expired smile, and r2 exists only once a
    # line was fitted.
    expired = F.col("tenor_years") <= 0
    fitted = ~expired & (F.col("n_pairs") >= min_pairs) & (F.col("k_range") > 0)
    return fits.select(
        *KEY,
        "tenor_years",
        F.when(usable, F.col("_forward")).alias("forward"),
        F.when(usable, F.col("_discount")).alias("discount"),
        F.when(usable, F.col("_rate")).alias("rate"),
        F.when(expired, F.lit(0)).otherwise(F.col("n_pairs")).cast("long").alias("n_pairs"),
        F.when(fitted, F.col("_r2")).alias("r2"),
        F.when(usable, F.col("rmse")).alias("rmse"),
        "excluded",
        usable.alias("usable"),
    )
