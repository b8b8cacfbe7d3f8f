"""Static no-arbitrage checks: vertical spreads, butterflies and calendars.

Vertical and butterfly conditions compare a quote with the next one or two up
the strike ladder, so both come out of one pass over rows that carry their
followers (`ordered.with_following`). The calendar condition interpolates curves
onto a shared grid; each piece of a curve emits exactly the grid points that
fall inside it, so interpolation is a projection and not a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY
from .ordered import with_following

# Tolerances, grid and the least knots a curve needs.
PRICE_TOL = 1e-9
CALENDAR_TOL = 1e-6
GRID_POINTS = 41
MIN_KNOTS = 4
MIN_ROWS = 3

STRIKE_BAND = 250.0
LOG_BAND = 0.05

VIOLATION = (
    "struct<kind:string,strikes:array<double>,magnitude:double,"
    "relative:double,executable:boolean,detail:string>"
)
COLUMNS = [*KEY, "kind", "strikes", "magnitude", "relative", "executable", "detail"]


def call_curve(quotes: DataFrame) -> DataFrame:
    """Every quote as its call equivalent: C(K) = P(K) + D * (F - K).

    Without bid and ask columns a vertical cannot be shown to be executable, and
    a butterfly is as executable as its value on mids.
    """
    quoted = {"bid", "ask"} <= {*quotes.columns}
    bid, ask = (F.col(c) if quoted else F.lit(None).cast("double") for c in ("bid", "ask"))
    shift = F.when(
        F.col("option_right") != "call", F.col("discount") * (F.col("forward") - F.col("strike"))
    ).otherwise(0.0)
    return quotes.dropna(subset=["mid", "strike", "forward", "discount"]).select(
        *KEY,
        "strike",
        "option_right",
        "forward",
        "discount",
        (F.col("mid") + shift).alias("call"),
        (bid + shift).alias("call_bid"),
        (ask + shift).alias("call_ask"),
        F.lit(quoted).alias("quoted"),
    )


def _breach(kind: str, strikes: list[Column], size: Column, relative: Column, exe: Column, detail: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        F.array(*strikes).alias("strikes"),
        size.alias("magnitude"),
        relative.alias("relative"),
        F.coalesce(exe, F.lit(False)).alias("executable"),
        detail.alias("detail"),
    ).cast(VIOLATION)


def _ladder(curve: DataFrame) -> DataFrame:
    return with_following(
        curve,
        KEY,
        F.floor(F.col("strike") / STRIKE_BAND),
        ["strike", "option_right", "call", "call_bid", "call_ask"],
        ["strike", "call", "call_bid", "call_ask"],
    ).where(F.col("group_rows") >= MIN_ROWS)


def _vertical(tol: float) -> list[Column]:
    nxt = F.get("ahead", 0)
    dk = nxt["strike"] - F.col("strike")
    slope = F.when(dk > 0, (nxt["call"] - F.col("call")) / dk).otherwise(F.lit(0.0))
    discount = F.col("discount")
    strikes = [F.col("strike"), nxt["strike"]]
    there = F.size("ahead") >= 1
    rising = _breach(
        "vertical", strikes, slope, slope,
        nxt["call_bid"] - F.col("call_ask") > tol,
        F.format_string("call price rises with strike: dC/dK = %+.6f > 0", slope),
    )
    steep = _breach(
        "vertical", strikes, -slope - discount, -slope - discount,
        F.col("call_bid") - nxt["call_ask"] - discount * dk > tol,
        F.format_string(
            "call spread cheaper than its worst case: dC/dK = %.6f < -D = %.6f", slope, -discount
        ),
    )
    return [
        F.when(there & (slope > tol), rising),
        F.when(there & (slope < -discount - tol), steep),
    ]


def _butterfly(tol: float) -> list[Column]:
    body, wing = F.get("ahead", 0), F.get("ahead", 1)
    k1, k2, k3 = F.col("strike"), body["strike"], wing["strike"]
    span = k3 - k1
    low = F.when(span > 0, (k3 - k2) / span).otherwise(F.lit(0.0))
    high = F.when(span > 0, (k2 - k1) / span).otherwise(F.lit(0.0))
    value = low * F.col("call") + high * wing["call"] - body["call"]
    cost = F.when(F.col("quoted"), low * F.col("call_ask") + high * wing["call_ask"] - body["call_bid"]).otherwise(value)
    relative = F.when(F.col("forward") != 0, -value / F.col("forward")).otherwise(-value)
    found = _breach(
        "butterfly", [k1, k2, k3], -value, relative, cost < -tol,
        F.when(
            F.col("quoted"),
            F.format_string(
                "butterfly value %.6e on mids, %.6e at the quoted bid-ask"
                " -- negative density between %.0f and %.0f", value, cost, k1, k3,
            ),
        ).otherwise(F.format_string("butterfly value %.6e on mids -- negative density between %.0f and %.0f", value, k1, k3)),
    )
    return [F.when((F.size("ahead") >= 2) & (value < -tol), found)]


def price_violations(curve: DataFrame, tol: float = PRICE_TOL) -> DataFrame:
    """Vertical and butterfly breaches of a call curve (see `call_curve`)."""
    found = F.array_compact(F.array(*_vertical(tol), *_butterfly(tol)))
    return _ladder(curve).select(*KEY, F.inline(found)).select(*COLUMNS)


def price_checks(curve: DataFrame) -> DataFrame:
    """How many adjacent pairs and triples each capture's curves offer."""
    sizes = curve.groupBy(*KEY).count()
    enough = F.col("count") >= MIN_ROWS
    return sizes.groupBy("capture_utc").agg(
        F.sum(F.when(enough, F.col("count") - 1).otherwise(0)).alias("vertical"),
        F.sum(F.when(enough, F.col("count") - 2).otherwise(0)).alias("butterfly"),
    )


def _knots(quotes: DataFrame) -> DataFrame:
    """One total variance per log-moneyness: a call and a put can share a point."""
    return (
        quotes.dropna(subset=["log_moneyness", "total_variance"])
        .groupBy(*KEY, F.col("log_moneyness").alias("k"))
        .agg(F.avg("total_variance").alias("w"), F.min("tenor_years").alias("tenor_years"))
    )


def _curve_pairs(knots: DataFrame) -> DataFrame:
    """Tenor-adjacent curves of one root with the log-moneyness range they share.

    One row per (pair, side): the pair is named by its longer curve, and a curve
    takes part once as the near side and once as the far side.
    """
    curves = (
        knots.groupBy(*KEY)
        .agg(
            F.min("k").alias("lo"), F.max("k").alias("hi"),
            F.count(F.lit(1)).alias("n"), F.min("tenor_years").alias("tenor"),
        )
        .where(F.col("n") >= MIN_KNOTS)
    )
    # One row per expiry of a root: an exchange lists a few hundred at most.
    step = Window.partitionBy("capture_utc", "root").orderBy("tenor", "expiry")
    return (
        curves.withColumn("far", F.lead(F.struct("expiry", "lo", "hi", "tenor")).over(step))
        .where("far is not null")
        .select(
            "capture_utc", "root",
            F.col("expiry").alias("near_expiry"), F.col("far.expiry").alias("far_expiry"),
            F.greatest("lo", "far.lo").alias("from_k"), F.least("hi", "far.hi").alias("to_k"),
            F.col("tenor").alias("near_tenor"), F.col("far.tenor").alias("far_tenor"),
        )
        .where("to_k > from_k")
        .withColumn("expiry", F.explode(F.array("near_expiry", "far_expiry")))
    )


def _on_grid(knots: DataFrame, pairs: DataFrame, n_grid: int) -> DataFrame:
    """(pair, grid index, side, w): piecewise-linear curves on the shared grid."""
    pieces = with_following(
        knots, KEY, F.floor(F.col("k") / LOG_BAND), ["k"], ["k", "w"]
    ).select(
        *KEY, "k", "w",
        F.get("ahead", 0)["k"].alias("k_next"), F.get("ahead", 0)["w"].alias("w_next"),
        (F.size("ahead") == 1).alias("last_piece"),
    ).where("k_next is not null")
    step = (F.col("to_k") - F.col("from_k")) / (n_grid - 1)
    # Indices near the piece by arithmetic, then exactly by comparing points, so
    # rounding can neither lose a grid point nor count one twice.
    first = F.greatest(F.floor((F.col("k") - F.col("from_k")) / step) - 1, F.lit(0))
    final = F.least(F.ceil((F.col("k_next") - F.col("from_k")) / step) + 1, F.lit(n_grid - 1))
    at = F.when(F.col("i") == n_grid - 1, F.col("to_k")).otherwise(F.col("from_k") + F.col("i") * step)
    inside = (F.col("g") >= F.col("k")) & (
        (F.col("g") < F.col("k_next")) | (F.col("last_piece") & (F.col("g") == F.col("k_next")))
    )
    weight = (F.col("g") - F.col("k")) / (F.col("k_next") - F.col("k"))
    return (
        pieces.join(pairs, KEY)
        .where((F.col("k") <= F.col("to_k")) & (F.col("k_next") >= F.col("from_k")))
        .where(final >= first)
        .withColumn("i", F.explode(F.sequence(first, final)))
        .withColumn("g", at)
        .where(inside)
        .withColumn("w_at", F.col("w") + weight * (F.col("w_next") - F.col("w")))
    )


def calendar_violations(
    quotes: DataFrame, tol: float = CALENDAR_TOL, n_grid: int = GRID_POINTS
) -> DataFrame:
    """Total variance falling with tenor at fixed log-moneyness, within a root."""
    knots = _knots(quotes)
    pairs = _curve_pairs(knots)
    pair = ["capture_utc", "root", "near_expiry", "far_expiry", "near_tenor", "far_tenor"]
    near = F.col("expiry") == F.col("near_expiry")
    points = (
        _on_grid(knots, pairs, n_grid)
        .groupBy(*pair, "i")
        .agg(
            F.max(F.when(near, F.col("w_at"))).alias("near_w"),
            F.max(F.when(~near, F.col("w_at"))).alias("far_w"),
            F.max("g").alias("g"),
        )
    )
    worst = points.groupBy(*pair).agg(
        # Largest drop, the lowest grid point among equals.
        F.max_by(
            F.struct("g", "near_w", "far_w"),
            F.struct((F.col("near_w") - F.col("far_w")).alias("drop"), (-F.col("i")).alias("first")),
        ).alias("at")
    )
    drop = F.col("at.near_w") - F.col("at.far_w")
    found = _breach(
        "calendar", [F.col("at.g")], drop, drop / F.greatest("at.near_w", F.lit(1e-12)), F.lit(False),
        F.format_string(
            "total variance falls from %.6f at T=%.4f to %.6f at T=%.4f at log-moneyness %+.4f",
            "at.near_w", "near_tenor", "at.far_w", "far_tenor", "at.g",
        ),
    )
    return (
        worst.where(drop > tol)
        .withColumn("expiry", F.col("far_expiry"))
        .select(*KEY, F.inline(F.array(found)))
        .select(*COLUMNS)
    )


def violations(quotes: DataFrame, tol: float = PRICE_TOL) -> DataFrame:
    """All breaches of a curated chain; calendars need ``total_variance``."""
    found = price_violations(call_curve(quotes), tol)
    if "total_variance" in quotes.columns:
        found = found.unionByName(calendar_violations(quotes))
    return found


def checked(quotes: DataFrame) -> DataFrame:
    """Conditions examined per capture, in long form (kind, n_checked)."""
    counts = price_checks(call_curve(quotes)).select(
        "capture_utc",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("kind"), F.col(c).alias("n_checked"))
                    for c in ("vertical", "butterfly")
                ]
            )
        ),
    )
    if "total_variance" in quotes.columns:
        curves = quotes.groupBy(*KEY).agg(F.lit(1).alias("one")).groupBy("capture_utc").agg(
            F.count(F.lit(1)).alias("n_checked")
        )
        counts = counts.unionByName(
            curves.select("capture_utc", F.lit("calendar").alias("kind"), "n_checked")
        )
    return counts


def report(quotes: DataFrame) -> DataFrame:
    """(capture, kind): checked, breached on mids, executable, worst executable."""
    tally = violations(quotes).groupBy("capture_utc", "kind").agg(
        F.count(F.lit(1)).alias("on_mids"),
        F.count_if("executable").alias("executable"),
        F.max(F.when(F.col("executable"), F.col("relative"))).alias("worst_rel"),
    )
    return checked(quotes).join(tally, ["capture_utc", "kind"], "left").select(
        "capture_utc", "kind", "n_checked",
        F.coalesce("on_mids", F.lit(0)).alias("on_mids"),
        F.coalesce("executable", F.lit(0)).alias("executable"),
        F.coalesce("worst_rel", F.lit(0.0)).alias("worst_rel"),
    )


def of_kind(found: DataFrame, kind: str, executable_only: bool = False) -> DataFrame:
    out = found.where(F.col("kind") == kind)
    return out.where("executable") if executable_only else out


def worst(found: DataFrame, by: list[str] = ["capture_utc"]) -> DataFrame:
    """The breach with the largest relative size per group, without sorting."""
    size = F.struct("relative", "kind", "expiry", "root", "strikes")
    best = F.max_by(F.struct(*[c for c in COLUMNS if c not in by]), size)
    return found.groupBy(*by).agg(best.alias("_v")).select(*by, "_v.*")
