"""A small subset of a chain that keeps every kind of trouble in it.

Each reason names rows that show one thing, in an order of its own and perhaps
only the first few. A row counts for the first reason that takes it. Picks
depend on the rows alone, so the same chain gives the same subset.

Limited reasons are one window over (group, reason); Spark cuts every task's
rows to the limit before the exchange, so what is shuffled is a few rows per
reason and task, however large the chain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reason:
    name: str
    condition: Column
    #: How many rows of a group it takes; None takes all.
    limit: int | None = None
    #: Text that comes before the row's id in the order.
    lead: Column | None = None


def by_reason(rows: DataFrame, group: list[str], id: str, reasons: list[Reason]) -> DataFrame:
    """Rows that a reason takes, with ``reason`` and ``reason_no``, the first that takes them.

    ``id`` names a row within its group. Reasons with a limit take rows in
    order of (lead, id); equal rows beyond the limit are left out by their id.
    A condition that is null does not hold.
    """
    taken = [
        F.when(r.condition, F.struct(F.lit(k).alias("no"), (F.lit("") if r.lead is None else F.coalesce(r.lead, F.lit(""))).alias("lead")))
        for k, r in enumerate(reasons)
    ]
    hits = rows.select(*group, id, F.explode(F.array_compact(F.array(*taken))).alias("_hit")).select(*group, id, "_hit.no", "_hit.lead")
    limits = {k: r.limit for k, r in enumerate(reasons) if r.limit is not None}
    picked = hits.where(~F.col("no").isin(*limits)) if limits else hits
    if limits:
        order = Window.partitionBy(*group, "no").orderBy("lead", id)
        own = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("no"))
        ranked = hits.where(F.col("no").isin(*limits)).withColumn("_place", F.row_number().over(order))
        first = ranked.where(F.col("_place") <= max(limits.values())).where(F.col("_place") <= own)
        picked = picked.unionByName(first.drop("_place"))
    winner = picked.groupBy(*group, id).agg(F.min("no").alias("reason_no"))
    name = F.element_at(F.array(*[F.lit(r.name) for r in reasons]), F.col("reason_no") + 1)
    return rows.join(winner.select(*[F.col(c).alias(f"_{c}") for c in (*group, id)], "reason_no"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*group, id)]).drop(
        *[f"_{c}" for c in (*group, id)]
    ).withColumn("reason", name)


def tally(picked: DataFrame, group: list[str]) -> DataFrame:
    """Rows per reason."""
    return picked.groupBy(*group, "reason_no", "reason").agg(F.count(F.lit(1)).alias("n"))


def troubles(collision: Column, monthly: Column, stale_before: str = "2026-01", deep: float = 0.10) -> list[Reason]:
    """What a chain of option quotes is kept for.

    Needs strike, spot, root, bid, ask, iv, last_trade_time and ``expires_today``.
    ``collision`` and ``monthly`` say which rows are listed by two roots, and
    which belong to the expiry that is kept for its good quotes.
    """
    away = F.abs(F.col("strike") - F.col("spot")) / F.col("spot")
    two_sided = (F.col("bid") > 0) & (F.col("ask") > 0)
    # Shares of spot, counts and the spread limit.
    return [
        Reason("0-DTE, within 2% of spot", F.col("expires_today") & (away <= 0.02)),
        Reason("root collision, near spot", collision & (away <= 0.03)),
        Reason("deep ITM, degenerate IV", F.col("strike") < F.col("spot") * deep, 8),
        Reason("zero-IV sentinel with a live quote, near spot", (F.col("iv") == 0.0) & (F.col("bid") > 0) & (away <= 0.10), 20),
        Reason("zero bid", F.col("bid") == 0, 12),
        Reason("stale last trade", F.col("last_trade_time") < stale_before, 8, F.col("last_trade_time")),
        Reason("relative spread > 50%", two_sided & (F.try_divide(F.col("ask") - F.col("bid"), (F.col("ask") + F.col("bid")) / 2) > 0.5), 10),
        Reason("monthly, liquid, near the money", monthly & (away <= 0.05) & (F.col("bid") > 0) & (F.col("iv") != 0.0), 120),
    ]
