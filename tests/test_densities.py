import math
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from optionlake.functions import black76, grid
from optionlake.functions.svi import Smile
from optionlake.operators import density, inversion, moments, smile
from optionlake.plans import estimate

AT = datetime(2026, 8, 11, 20, 37, 3)
EXPIRY = date(2026, 9, 18)
FWD, DISC, TENOR = 7752.07, 0.99544, 0.1033
FLAT = (0.04 * TENOR, 0.0, 0.0, 0.0, 1.0)
EQUITY = (0.002, 0.04, -0.7, 0.02, 0.15)


@pytest.fixture(scope="module")
def smiles(spark):
    rows = [(AT, EXPIRY, name, TENOR, FWD, DISC, 0.0, *p) for name, p in (("FLAT", FLAT), ("EQUITY", EQUITY))]
    return spark.createDataFrame(
        rows,
        "capture_utc timestamp, expiry date, root string, tenor_years double, forward double, discount double,"
        " k_required double, a double, b double, rho double, m double, sigma double",
    )


def by_root(df):
    return {r.root: r for r in df.collect()}


def test_moments_have_their_closed_forms(smiles):
    got = by_root(moments.moments(smiles, ["root"]))
    w, flat, equity = FLAT[0], got["FLAT"], got["EQUITY"]
    assert flat.mass == pytest.approx(1, abs=1e-9) and flat.implied_forward == pytest.approx(FWD, rel=1e-9)
    assert flat.px_mean == pytest.approx(FWD, rel=1e-9) and flat.px_variance == pytest.approx(FWD**2 * (math.exp(w) - 1), rel=1e-8)
    assert (flat.bl_variance, flat.bl_skewness, flat.bl_kurtosis) == pytest.approx((w, 0, 3), abs=1e-7)
    assert (flat.bkm_variance, flat.bkm_skewness, flat.bkm_kurtosis) == pytest.approx((w, 0, 3), abs=1e-7)
    assert flat.bl_mean == pytest.approx(-w / 2)
    known = (0.01143643, -1.690612, 9.838953)
    assert (equity.bl_variance, equity.bl_skewness, equity.bl_kurtosis) == pytest.approx(known, rel=1e-6)
    assert (equity.bkm_variance, equity.bkm_skewness, equity.bkm_kurtosis) == pytest.approx(known, rel=1e-6)
    assert equity.bl_bkm_gap < 1e-5


def test_density_quantiles_and_differences(smiles):
    closed = density.from_smile(smiles, ["root"])
    q = {(r.root, r.p): r.strike for r in density.quantiles(closed, ["root"], [0.05, 0.5]).collect()}
    w = FLAT[0]
    assert q["FLAT", 0.5] == pytest.approx(FWD * math.exp(-w / 2), rel=1e-5)
    assert q["FLAT", 0.05] == pytest.approx(FWD * math.exp(-w / 2 - 1.6448536 * math.sqrt(w)), rel=1e-4)
    widths = {r.root: r.half_width for r in closed.select("root", "half_width").distinct().collect()}
    assert widths["EQUITY"] == pytest.approx(6.342763, abs=1e-6)
    by_hand = density.from_finite_differences(smiles, ["root"], 4001)
    both = density.from_smile(smiles, ["root"], 4001).join(by_hand.select("root", "i", F.col("pdf").alias("fd")), ["root", "i"])
    core = both.where("abs(k) < 0.2").agg(F.max(F.abs(F.col("fd") / F.col("pdf") - 1)).alias("gap")).first()
    assert core.gap < 1e-3
    assert {r.root: r.is_proper for r in density.diagnostics(closed, ["root"]).collect()} == {"FLAT": True, "EQUITY": True}


def test_inversion_round_trips_and_never_raises(spark):
    sigmas = [0.01, 0.05, 0.12, 0.2, 0.35, 0.8, 1.2, 3.0]
    rows = [(s, k, r) for s in sigmas for k in (7000.0, 7752.07, 7800.0, 9000.0) for r in ("call", "put")]
    df = spark.createDataFrame(rows, "s double, k double, r string")
    vol = F.col("s") * math.sqrt(TENOR)
    df = black76.with_price(df, "p", FWD, F.col("k"), vol, DISC, F.col("r"))
    solved = inversion.with_implied_vol(df, "iv", F.col("p"), F.lit(FWD), F.col("k"), F.lit(TENOR), F.lit(DISC), F.col("r"))
    assert "Python" not in solved._jdf.queryExecution().executedPlan().toString()
    for r in solved.collect():
        floor = DISC * max((FWD - r.k) if r.r == "call" else (r.k - FWD), 0)
        if r.p - floor > 1e-4:
            assert r.iv == pytest.approx(r.s, rel=1e-8)
    bad = spark.createDataFrame([(-5.0,), (0.0,), (1e12,), (float("nan"),), (None,), (100.0,)], "p double")
    got = [r.v for r in inversion.with_total_vol(bad, "v", F.col("p"), F.lit(FWD), F.lit(7800.0), F.lit(DISC), F.lit("call")).collect()]
    assert got[:5] == [None] * 5 and got[5] > 0
    expired = inversion.with_implied_vol(bad, "v", F.col("p"), F.lit(FWD), F.lit(7800.0), F.lit(0.0), F.lit(DISC), F.lit("call"))
    assert {r.v for r in expired.collect()} == {None}


def test_inversion_reaches_rounding_wherever_a_price_tells_volatilities_apart(spark):
    """Total volatility 0.001 to 5 and log-moneyness to 5, on both sides; the price is given back, or there is no answer."""
    vols = [*np.geomspace(1e-3, 1, 40), *np.linspace(1.1, 4.99, 25)]
    rows = [(float(v), float(np.exp(x)), r) for v in vols for x in (0.0, 1e-9, 1e-4, 0.003, 0.02, 0.1, 0.4, 1.0, 2.5, 5.0) for r in ("call", "put")]
    rows += [(float(v), float(np.exp(-x)), r) for v, x, r in ((v, abs(math.log(k)), r) for v, k, r in rows[::3])]
    df = black76.with_price(spark.createDataFrame(rows, "v double, k double, r string"), "p", 1.0, F.col("k"), F.col("v"), 0.97, F.col("r"))
    solved = inversion.with_total_vol(df, "got", F.col("p"), F.lit(1.0), F.col("k"), F.lit(0.97), F.col("r"))
    back = black76.with_price(solved, "again", 1.0, F.col("k"), F.col("got"), 0.97, F.col("r")).collect()
    told = 0
    for r in back:
        low, high = 0.97 * max(1 - r.k if r.r == "call" else r.k - 1, 0), 0.97 * (1 if r.r == "call" else r.k)
        if low + 1e-9 < r.p < high - 1e-9:
            told += 1
            assert abs(r.again - r.p) <= 1e-8 * max(r.p, 1e-8)
            if r.p - low > 1e-5 * r.p and high - r.p > 1e-5 * r.p:
                assert r.got == pytest.approx(r.v, rel=1e-7)
    assert told > 1000


def surface(spark, n=60, copies=1, root="SPXW"):
    ks = np.linspace(-0.5, 0.3, n)
    a, b, rho, m, s = EQUITY
    rows = []
    for k in ks:
        w = a + b * (rho * (k - m) + math.sqrt((k - m) ** 2 + s * s))
        rows += [(AT, EXPIRY, root, TENOR, FWD, DISC, float(FWD * math.exp(k)), float(k), "call" if k >= 0 else "put", float(w))] * copies
    df = spark.createDataFrame(
        rows,
        "capture_utc timestamp, expiry date, root string, tenor_years double, forward double, discount double,"
        " strike double, log_moneyness double, option_right string, w double",
    )
    return black76.with_price(df, "mid", F.col("forward"), F.col("strike"), F.sqrt("w"), F.col("discount"), F.col("option_right")).drop("w")


def test_estimate_recovers_the_smile_and_trusts_it(spark):
    got = estimate.estimate_all(surface(spark).unionByName(surface(spark, 5, root="SPX"))).collect()
    thin, full = sorted(got, key=lambda r: r.n_quotes)
    assert thin.excluded == "only 5 usable quotes, need 8" and not thin.trustworthy and thin.failures == ""
    assert full.trustworthy and full.failures == "" and full.excluded is None and full.n_quotes == 60
    assert full.rmse_vol < 1e-6 and full.bl_bkm_gap < 1e-5 and abs(full.forward_error) < 1e-6
    assert full.annualised_vol == pytest.approx(math.sqrt(0.01143643 / TENOR), rel=1e-4)


def test_a_smile_without_a_single_variance_keeps_its_tenor(spark):
    quotes = surface(spark, 5).select(
        "capture_utc", "expiry", "root", "tenor_years", "forward", "discount", "log_moneyness",
        F.lit(None).cast("double").alias("total_variance"), F.lit(None).cast("double").alias("vega"),
    )
    got = estimate.estimate_all(quotes).first()
    assert (got.n_quotes, got.excluded) == (0, "only 0 usable quotes, need 8")
    assert got.days == pytest.approx(TENOR * 365) and got.forward == FWD


def test_impossible_thresholds_name_every_failure(spark):
    hard = estimate.Thresholds(-1.0, 1e9, -1.0, -1.0, -1.0, 1e9)
    got = estimate.estimate_all(surface(spark), hard).first()
    assert not got.trustworthy
    starts = ("fit rmse ", "durrleman ", "mass ", "negative density ", "E[S]/F - 1 = ", "BL/BKM disagree ")
    assert [any(f.startswith(s) for s in (starts[i],)) for i, f in enumerate(got.failures.split("; "))] == [True] * 6


@pytest.mark.parametrize(
    "params, reason",
    [
        ((-0.857380, 76.644618, 0.9959, 1.5720, 0.1248), "wing slope b(1+|rho|) = 152.975 exceeds Lee's bound 2.0"),
        ((-0.5, 0.04, -0.7, 0.02, 0.15), "fitted minimum variance -4.957e-01 < 0"),
        ((None,) * 5, "solver failed"),
    ],
)
def test_bad_fits_are_rejected(spark, params, reason):
    names = ("a", "b", "rho", "m", "sigma")

    def solver(k, w, weight):
        return F.struct(*[F.lit(p).cast("double").alias(n) for n, p in zip(names, params)])

    got = estimate.estimate_all(surface(spark), solver=solver).first()
    assert got.excluded.startswith(reason) and got.rmse_vol is None and got.mass is None


def test_copies_leave_the_fit_unchanged(spark):
    s = Smile.of()
    shown = [s.total_variance(F.lit(k)).alias(f"w{i}") for i, k in enumerate((-0.4, 0.0, 0.2))]

    def fitted(copies):
        q = inversion.prepare(surface(spark, copies=copies))
        return smile.fit(smile.curves(q)).select("n_quotes", "rmse_vol", *shown).first()

    one, many = fitted(1), fitted(7)
    assert many.n_quotes == 7 * one.n_quotes
    assert [many.w0, many.w1, many.w2] == pytest.approx([one.w0, one.w1, one.w2], abs=1e-9)


def test_penalty_keeps_a_dented_smile_arbitrage_free():
    k = np.linspace(-0.3, 0.3, 41)
    w = 0.01 + 0.3 * np.maximum(np.abs(k) - 0.05, 0.0) - 0.004 * np.exp(-((k / 0.02) ** 2))
    free, held = (smile.solve([k], [w], [np.ones_like(k)], p)[0] for p in (0.0, 10.0))

    def lowest(theta):
        (v, dv, d2v), _ = smile._model(theta[None], np.linspace(-3, 3, 400)[None], False)
        v = np.maximum(v, 1e-12)
        grid = np.linspace(-3, 3, 400)
        return np.min((1 - grid * dv / (2 * v)) ** 2 - dv**2 / 4 * (1 / v + 0.25) + d2v / 2)

    assert lowest(held) >= min(lowest(free), -1e-2) and lowest(held) > -1e-2


def test_a_fit_that_has_not_arrived_says_so(spark, monkeypatch):
    done = smile.fit(smile.curves(inversion.prepare(surface(spark)))).first()
    assert done.excluded is None and done.decrement <= smile.CERTAIN and done.steps > 3 and done.bounds_hit == 0
    monkeypatch.setattr(smile, "MAX_STEPS", 2)
    stopped = smile.fit(smile.curves(inversion.prepare(surface(spark)))).first()
    assert stopped.excluded == "solver failed: not converged" and stopped.decrement > smile.CERTAIN and stopped.rmse_vol is None
    assert estimate.estimate_all(surface(spark)).first().excluded == stopped.excluded


def test_certificate_promises_what_further_steps_give():
    rng = np.random.default_rng(2)
    k = np.linspace(-0.3, 0.3, 25)
    w = 0.01 + 0.1 * (-0.5 * (k - 0.02) + np.sqrt((k - 0.02) ** 2 + 0.01)) + rng.normal(0, 2e-4, 25)
    found = smile.solve([k], [w], [np.ones_like(k)])[0]
    data = (k[None], w[None], np.ones((1, 25)), np.linspace(-3, 3, 400)[None])
    assert found[5] <= smile.CERTAIN
    for scale in (1e-2, 1e-3):
        theta = found[None, :5] * (1 + scale)
        gap, held = smile.certificate(theta, data, 0.0)
        cost = smile._evaluate(theta, data, 0.0)[0][0]
        best = smile._evaluate(found[None, :5], data, 0.0)[0][0]
        assert gap[0] * cost == pytest.approx(cost - best, rel=0.3) and held[0] == 0
    flat = smile.solve([k], [np.full(25, 0.01)], [np.ones_like(k)])[0]
    assert flat[5] <= smile.CERTAIN  # an exact fit, with parameters to spare


def test_a_step_looks_only_at_curves_with_negative_density(monkeypatch):
    """The penalty's Jacobian is built for the curves it weighs on, and a batch gives what its curves give alone."""
    rng = np.random.default_rng(3)
    ks = [np.linspace(-0.3, 0.2, n) for n in (20, 25, 30)]
    ws = [0.002 + 0.04 * (-0.7 * (k - 0.02) + np.sqrt((k - 0.02) ** 2 + 0.15**2)) * (1 + 0.02 * rng.standard_normal(k.size)) for k in ks]
    seen, real = [], smile._density_jacobian
    monkeypatch.setattr(smile, "_density_jacobian", lambda theta, *rest: seen.append(len(theta)) or real(theta, *rest))
    data = (np.stack([ks[0]] * 2), np.stack([ws[0]] * 2), np.ones((2, 20)), np.stack([np.linspace(-3, 3, 400)] * 2))
    theta = np.array([EQUITY, (0.0001, 0.5, -0.9, 0.1, 0.001)])
    cost, grad, hess = smile._evaluate(theta, data, 10.0)
    assert seen == [1]
    for i in range(5):
        reach = np.zeros_like(theta)
        reach[:, i] = 1e-7
        slope = (smile._evaluate(theta + reach, data, 10.0)[0] - smile._evaluate(theta - reach, data, 10.0)[0]) / 4e-7
        assert slope == pytest.approx(grad[:, i], rel=1e-3, abs=1e-6)
    ones = [np.ones_like(k) for k in ks]
    alone = np.concatenate([smile.solve([k], [w], [o]) for k, w, o in zip(ks, ws, ones)])
    assert smile.solve(ks, ws, ones)[:, :5] == pytest.approx(alone[:, :5], rel=1e-5)


def test_grids_are_numbers_in_a_task_and_equal_the_expressions(smiles):
    """The half-width is no interpreted lambda, the integrals make no row of a node, and both forms of the density agree."""
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (density.with_half_width(smiles), moments.integrals(smiles, ["root"]))]
    assert not any("lambda" in p or "Generate" in p for p in plans) and all("ArrowEvalPython" in p for p in plans)
    nodes = density.from_smile(smiles.where("root = 'EQUITY'"), ["root"]).select("k", "pdf").collect()
    k = np.array([[r.k for r in nodes]])
    p = {n: np.array([[v]]) for n, v in zip(("a", "b", "rho", "m", "sigma"), EQUITY)}
    assert grid.pdf(k, *grid.variance(p, k), FWD)[0] == pytest.approx([r.pdf for r in nodes], rel=1e-9, abs=1e-300)
    x = np.linspace(-12, 12, 4001)
    assert grid.norm_cdf(x) == pytest.approx([math.erfc(-v / math.sqrt(2)) / 2 for v in x], rel=1e-13)
    assert grid.norm_cdf(np.array([-np.inf, np.inf])).tolist() == [0.0, 1.0]
