"""Which captures carry new information: duplicate prints and stale feeds.

The gate is a sequential rule (compare with the last *accepted* print), but its
state after any fresh capture is that capture's print: it was either accepted,
or equal to the state already. So "last accepted print" is "print of the last
fresh capture before this one", an as-of lookup that needs no sequential state.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..session import settle
from .ordered import last_before

# Feed delay, capture cadence and headroom behind the limit.
FEED_DELAY = timedelta(minutes=15)
CADENCE = timedelta(minutes=10)
HEADROOM = timedelta(minutes=2)
MAX_STALE = FEED_DELAY + CADENCE + HEADROOM

ACCEPT = "accept"
DUPLICATE = "duplicate_print"
STALE = "stale_feed"
FORCED = "forced"
LOCKED = "skipped_locked"
ACCEPTED = (ACCEPT, FORCED)


def verdict_of(last_print: Column, this_print: Column, fresh: Column, force: Column) -> Column:
    return (
        F.when(force, FORCED)
        .when(last_print == this_print, DUPLICATE)
        .when(~fresh, STALE)
        .otherwise(ACCEPT)
    )


def _led_by(rows: DataFrame, seed: DataFrame, **marks) -> DataFrame:
    """State from before the first attempt, as one leading row per ticker."""
    lead = seed.withColumns(
        {
            "capture_utc": F.lit("0001-01-01").cast("timestamp"),
            "_seed": F.lit(True),
            **{name: F.lit(value) for name, value in marks.items()},
        }
    )
    return rows.withColumn("_seed", F.lit(False)).unionByName(lead, allowMissingColumns=True)


def read_prints(attempts: DataFrame, max_stale: timedelta = MAX_STALE) -> DataFrame:
    """Add what the gate compares: ``print``, ``age_minutes``, ``_force`` and ``_fresh``."""
    force = F.coalesce("force", F.lit(False)) if "force" in attempts.columns else F.lit(False)
    age = clock.seconds_between(F.col("index_last_trade"), F.col("capture_utc"))
    return attempts.withColumns(
        {
            "print": clock.eastern_print(F.col("index_last_trade")), "age_minutes": age / 60.0, "_force": force,
            "_fresh": age <= max_stale.total_seconds(),
        }
    )


def judge(
    attempts: DataFrame,
    seed: DataFrame | None = None,
    max_stale: timedelta = MAX_STALE,
    order: list[str] | None = None,
    tasks: int | None = None,
    keep: Callable[[DataFrame], DataFrame] = settle,
) -> DataFrame:
    """Verdict of every capture attempt, in order of arrival per ticker.

    ``attempts`` needs ``ticker``, ``capture_utc`` and ``index_last_trade``, and
    may carry a boolean ``force``. ``seed`` holds (ticker, print, seqno) accepted
    before the first attempt. ``seqno`` plays no part: it moves without new prints.
    """
    order = order or ["capture_utc"]
    rows = read_prints(attempts, max_stale)
    if seed is not None:
        rows = _led_by(rows, seed, _force=True, _fresh=False)
    state = F.when(F.col("_force") | F.col("_fresh"), F.col("print"))
    held = last_before(rows, ["ticker"], order, state, "last_print", tasks, keep)
    if seed is not None:
        held = held.where(~F.col("_seed")).drop("_seed").select(
            *attempts.columns, "print", "age_minutes", "last_print", "_force", "_fresh"
        )
    return held.withColumn(
        "verdict", verdict_of(F.col("last_print"), F.col("print"), F.col("_fresh"), F.col("_force"))
    ).drop("_force", "_fresh")


def detail_of(last_seqno: Column, max_stale: timedelta = MAX_STALE) -> Column:
    """The human-readable reason of a judged row with ``spot``, ``seqno`` and ``n_options``, with the numbers behind it."""
    minutes = int(max_stale.total_seconds() // 60)
    moved = F.when(
        last_seqno != F.col("seqno"),
        F.format_string(", advanced from %d: seqno moves without new prints and is not a dedup key", last_seqno),
    ).otherwise("")
    spot = F.col("spot").cast("string")
    return (
        F.when(
            F.col("verdict") == FORCED,
            F.format_string("forced: index last printed %s ET (%.1f min old), spot %s", "print", "age_minutes", spot),
        )
        .when(
            F.col("verdict") == DUPLICATE,
            F.format_string("no new data: index last print still %s ET, spot %s (seqno %d%s)", F.col("print"), spot, F.col("seqno"), moved),
        )
        .when(
            F.col("verdict") == STALE,
            F.format_string(
                f"feed is stale: index last printed %s ET, %.1f min ago, over the {minutes} min limit"
                " (market closed or holiday)", "print", "age_minutes",
            ),
        )
        .otherwise(
            F.format_string(
                "new data: index last printed %s ET (%.1f min ago), spot %s, %d options",
                F.col("print"), F.col("age_minutes"), spot, F.col("n_options"),
            )
        )
    )


def with_detail(
    judged: DataFrame, seed: DataFrame | None = None, max_stale: timedelta = MAX_STALE, order: list[str] | None = None,
    tasks: int | None = None, keep: Callable[[DataFrame], DataFrame] = settle,
) -> DataFrame:
    """Add the human-readable reason. Needs ``spot``, ``seqno`` and ``n_options``."""
    accepted = F.when(F.col("verdict").isin(*ACCEPTED), F.col("seqno"))
    rows = judged if seed is None else _led_by(judged, seed.drop("print"), verdict=ACCEPT)
    rows = last_before(rows, ["ticker"], order or ["capture_utc"], accepted, "_seqno", tasks, keep)
    if seed is not None:
        rows = rows.where(~F.col("_seed")).drop("_seed")
    return rows.withColumn("detail", detail_of(F.col("_seqno"), max_stale)).drop("_seqno")


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("verdict").isin(*ACCEPTED))


def duplicates_of(captures: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """Archive repair: each capture that repeats a print, with the first to carry it.

    ``tie`` orders captures of one instant; all but the first of them repeat it.
    """
    place = F.struct("capture_utc", *(tie or []))
    first = captures.groupBy("ticker", "index_last_trade").agg(F.min(place).alias("_first"))
    return captures.join(first, ["ticker", "index_last_trade"]).where(place > F.col("_first")).withColumn(
        "duplicate_of", F.col("_first.capture_utc")
    ).drop("_first")
