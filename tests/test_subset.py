import random

import pytest
from pyspark.sql import functions as F

from optionlake.operators.subset import Reason, by_reason, tally


def plain(rows, reasons):
    """{(group, id): reason} taken one reason after another."""
    out = {}
    for group in {r["g"] for r in rows}:
        mine = [r for r in rows if r["g"] == group]
        for name, holds, lead, limit in reasons:
            for r in sorted((r for r in mine if holds(r)), key=lambda r: (lead(r), r["id"]))[:limit]:
                out.setdefault((group, r["id"]), name)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    return [
        {"g": rng.choice(["a", "a", "a", "b", None]), "id": f"i{k:04d}", "x": rng.choice([None, *range(10)]), "t": rng.choice([None, "2024", "2025", "2026"])}
        for k in range(900)
    ]


def test_first_reason_wins(spark, rows):
    frame = spark.createDataFrame(rows, "g string, id string, x int, t string").repartition(5)
    reasons = [
        Reason("low", F.col("x") < 2, 7), Reason("old", F.col("t") < "2026", 20, F.col("t")), Reason("five", F.col("x") == 5),
        Reason("even", F.col("x") % 2 == 0, 30), Reason("never", F.col("x") > 100, 3),
    ]
    want = plain(rows, [
        ("low", lambda r: r["x"] is not None and r["x"] < 2, lambda r: "", 7),
        ("old", lambda r: r["t"] is not None and r["t"] < "2026", lambda r: r["t"], 20),
        ("five", lambda r: r["x"] == 5, lambda r: "", None), ("even", lambda r: r["x"] is not None and r["x"] % 2 == 0, lambda r: "", 30),
    ])
    picked = by_reason(frame, ["g"], "id", reasons)
    assert {(r.g, r.id): r.reason for r in picked.collect()} == want
    assert picked.columns == ["g", "id", "x", "t", "reason_no", "reason"]
    counts = {(r.g, r.reason): r.n for r in tally(picked, ["g"]).collect()}
    assert counts[None, "low"] == 7 and sum(counts.values()) == len(want)
    assert by_reason(frame.limit(0), ["g"], "id", reasons).count() == 0


def test_rows_are_cut_to_the_limit_before_they_are_exchanged(spark, rows):
    frame = spark.createDataFrame(rows, "g string, id string, x int, t string")
    plan = by_reason(frame, ["g"], "id", [Reason("low", F.col("x") < 2, 7), Reason("odd", F.col("x") % 2 == 1, 9)])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and text.index("Final") < text.index("Partial", text.index("WindowGroupLimit"))
