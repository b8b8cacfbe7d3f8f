import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from optionlake.operators import forwards, quality
from optionlake.plans import curate

AT = datetime(2026, 8, 11, 20, 37, 3)
F0, D0 = 7752.07, 0.99544
COLUMNS = "capture_utc timestamp, expiry date, root string, strike double, option_right string, bid double, ask double, iv double, option_symbol string"


def chain(expiry=date(2026, 9, 18), root="SPXW", f=F0, d=D0, strikes=range(7000, 8500, 25), noise=0.0, seed=7):
    rng = random.Random(seed)
    rows = []
    for k in strikes:
        for right, sign in (("call", 1), ("put", -1)):
            mid = 6000 + sign * d * (f - k) / 2 + noise * rng.gauss(0, 1)
            rows.append((AT, expiry, root, float(k), right, mid - 0.5, mid + 0.5, 0.2, f"{root}{right}{k}"))
    return rows


def fit(spark, rows, **options):
    df = spark.createDataFrame(rows, COLUMNS).withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    return {(r.expiry, r.root): r for r in forwards.fit_forwards(df, **options).collect()}


def test_parity_recovers_both_roots_and_names_every_exclusion(spark):
    day = [date(2026, 9, d) for d in range(1, 12)]
    rows = chain() + chain(root="SPX", f=7734.42, d=0.9986)
    rows += chain(day[0], strikes=[7000, 7500, 8000])
    rows += chain(day[1], strikes=[7750] * 12)
    rows += chain(date(2026, 8, 11), root="SPX")
    rows += chain(day[2], d=-0.995) + chain(day[3], d=2.5) + chain(day[4], f=-100.0) + chain(date(2026, 8, 15), d=0.5)
    rows += chain(day[5], noise=500.0)
    rows += [r for r in chain(day[6]) if r[4] == "call"]
    got = fit(spark, rows, min_pairs=8)
    ok = got[date(2026, 9, 18), "SPXW"]
    assert ok.usable and ok.n_pairs == 60 and ok.r2 == pytest.approx(1.0, abs=1e-12) and ok.rmse < 1e-9
    assert ok.forward == pytest.approx(F0, rel=1e-12) and ok.discount == pytest.approx(D0, rel=1e-12)
    assert got[date(2026, 9, 18), "SPX"].forward == pytest.approx(7734.42, rel=1e-12)
    assert got[date(2026, 9, 18), "SPX"].tenor_years < ok.tenor_years
    why = {k[0]: r.excluded for k, r in got.items()}
    assert why[day[0]] == "only 3 call/put pairs, need 8"
    assert got[day[1], "SPXW"].n_pairs == 144 and why[day[1]] == "all pairs at one strike"
    assert why[date(2026, 8, 11)] == "expired" and got[date(2026, 8, 11), "SPX"].n_pairs == 0
    assert why[day[2]] == "non-positive discount factor -0.9950"
    assert why[day[3]] == "implausible discount factor 2.5000"
    assert float(why[day[4]].removeprefix("non-positive forward ")) == pytest.approx(-100)
    assert why[date(2026, 8, 15)].endswith("outside +/-25%")
    assert why[day[5]].startswith("parity fit R2 0.") and got[day[5], "SPXW"].rmse is None
    assert why[day[6]] == "only 0 call/put pairs, need 8"


def test_line_matches_all_pairs_with_copies(spark):
    """Copies on both sides of a strike: the same line as over every pair."""
    rng = random.Random(3)
    rows = [r for r in chain(noise=3.0) for _ in range(rng.choice([1, 1, 2, 5]))]
    rows = [(*r[:5], r[5] + (e := rng.gauss(0, 2)), r[6] + e, *r[7:]) for r in rows]
    got = fit(spark, rows, min_r2=0.0)[date(2026, 9, 18), "SPXW"]
    mids = [(r[3], r[4], (r[5] + r[6]) / 2) for r in rows]
    pairs = [(k, c - p) for k, s, c in mids if s == "call" for k2, t, p in mids if t == "put" and k2 == k]
    x, y = np.array(pairs).T
    slope, intercept = np.polyfit(x, y, 1)
    assert got.n_pairs == len(pairs)
    assert got.discount == pytest.approx(-slope, rel=1e-10) and got.forward == pytest.approx(-intercept / slope, rel=1e-10)
    assert got.rmse == pytest.approx(np.sqrt(np.mean((y - slope * x - intercept) ** 2)), rel=1e-9)
    assert got.r2 == pytest.approx(1 - np.mean((y - slope * x - intercept) ** 2) / np.var(y), abs=1e-10)


def test_each_flag_alone(spark):
    base = dict(option_right="call", strike=7800.0, bid=100.0, ask=102.0, iv=0.12, tenor_years=0.1033, forward=7752.07)
    nan = float("nan")
    cases = [
        ({}, set()), ({"bid": 0.0}, {"zero_bid", "wide_spread"}), ({"bid": 102.0, "ask": 100.0}, {"crossed"}),
        ({"bid": 1.0, "ask": 3.0}, {"wide_spread"}), ({"bid": 3.0, "ask": 5.0}, set()),
        ({"bid": 0.0, "ask": 0.0}, {"zero_bid", "zero_ask", "wide_spread"}), ({"iv": 0.0}, {"zero_iv"}),
        ({"tenor_years": -0.001}, {"expired", "zero_dte"}), ({"tenor_years": 0.0005}, {"zero_dte"}),
        ({"strike": 7000.0}, {"itm"}), ({"option_right": "put", "strike": 8000.0}, {"itm"}),
        ({"option_right": "put", "strike": 7752.07}, set()), ({"strike": 7752.07}, set()),
        ({"bid": None}, {"wide_spread"}), ({"bid": nan}, {"wide_spread"}), ({"ask": nan, "iv": nan}, {"wide_spread"}),
        ({"forward": nan}, {"itm"}),
    ]
    fields = list(base)
    rows = [(i, *[{**base, **change}[f] for f in fields]) for i, (change, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, option_right string, strike double, bid double, ask double, iv double, tenor_years double, forward double")
    got = {r.i: {f for f in quality.FLAGS if r[f]} for r in quality.add_flags(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_build_accounts_for_every_quote(spark):
    rows = chain() + chain(date(2026, 9, 1), strikes=[7000, 7500]) + chain(date(2026, 8, 11), root="SPX")
    rows[0] = (*rows[0][:5], None, *rows[0][6:])
    df = spark.createDataFrame(rows, COLUMNS)
    strict = curate.build(df)
    t = strict.totals.first()
    assert t.total_in == len(rows) and t.no_usable_forward == 4 + 120
    assert t.total_kept == strict.quotes.count() and t.total_kept + t.total_dropped == t.total_in
    rules = {r.rule: r.flagged for r in strict.by_rule.collect()}
    assert set(rules) == {*quality.FLAGS, "no_usable_forward"}
    loose = curate.build(df, quality.PERMISSIVE)
    assert loose.quotes.count() == 120
    no_itm = curate.build(df, quality.STRICT.without("itm")).totals.first()
    assert no_itm.total_kept > t.total_kept
    by = strict.by_expiry.first()
    assert by.n_in == 120 and by.n_kept == t.total_kept and by.itm == rules["itm"]
    with pytest.raises(ValueError, match="no quotes for capture"):
        extra = {c: F.lit(None).cast("double") for c in ("theo", "delta", "open_interest", "volume", "underlying_price")}
        curate.from_catalog(df.withColumns(extra), datetime(2020, 1, 1))


def test_chains_are_built_once_for_forwards_and_flags(spark, capsys):
    from optionlake.plans import registry

    registry._curated(spark, "/root/testdata/sf0.001").explain()
    assert "lineitem" not in capsys.readouterr().out
