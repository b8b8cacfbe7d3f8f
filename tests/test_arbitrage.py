import random
from datetime import date, datetime

import pytest

from optionlake.operators import arbitrage as arb

AT = datetime(2026, 8, 11, 20, 37, 3)
SCHEMA = "capture_utc timestamp, expiry date, root string, strike double, option_right string, mid double, bid double, ask double, forward double, discount double"


def brute(rows, tol=1e-9):
    """The stated conditions, one chain at a time, straight from their definition."""
    out, groups = [], {}
    for r in rows:
        if r[5] is not None:
            groups.setdefault((r[1], r[2]), []).append(r)
    for (expiry, root), g in groups.items():
        pts = []
        for _, _, _, k, right, mid, bid, ask, f, d in g:
            s = d * (f - k) if right != "call" else 0.0
            pts.append((k, right, mid + s, bid + s, ask + s, f, d))
        pts.sort()
        if len(pts) < 3:
            continue
        for p, n in zip(pts, pts[1:]):
            dk = n[0] - p[0]
            slope = (n[2] - p[2]) / dk if dk > 0 else 0.0
            if slope > tol:
                out.append((expiry, root, "vertical", (p[0], n[0]), slope, n[3] - p[4] > tol))
            if slope < -p[6] - tol:
                out.append((expiry, root, "vertical", (p[0], n[0]), -slope - p[6], p[3] - n[4] - p[6] * dk > tol))
        for a, b, c in zip(pts, pts[1:], pts[2:]):
            span = c[0] - a[0]
            lo, hi = ((c[0] - b[0]) / span, (b[0] - a[0]) / span) if span > 0 else (0.0, 0.0)
            value = lo * a[2] + hi * c[2] - b[2]
            if value < -tol:
                cost = lo * a[4] + hi * c[4] - b[3]
                out.append((expiry, root, "butterfly", (a[0], b[0], c[0]), -value, cost < -tol))
    return out


def noisy(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for expiry in (date(2026, 9, 18), date(2026, 10, 16)):
        for root in ("SPX", "SPXW"):
            for k in rng.sample(range(200, 12000, 10), n if root == "SPX" else 2):
                for right in ("call", "put"):
                    mid = max(0.99 * (8000 - k if right == "call" else k - 8000), 0) + rng.uniform(0, 60)
                    half = rng.uniform(0, 8)
                    rows.append((AT, expiry, root, float(k), right, None if rng.random() < 0.05 else mid, mid - half, mid + half, 8000.0, 0.99))
    return rows


@pytest.mark.parametrize("band", [37.0, 250.0, 50000.0])
def test_bands_do_not_change_the_answer(spark, monkeypatch, band):
    monkeypatch.setattr(arb, "STRIKE_BAND", band)
    rows = noisy(11)
    found = arb.price_violations(arb.call_curve(spark.createDataFrame(rows, SCHEMA))).collect()
    got = sorted((r.expiry, r.root, r.kind, tuple(r.strikes), round(r.magnitude, 9), r.executable) for r in found)
    want = sorted((*w[:4], round(w[4], 9), w[5]) for w in brute(rows))
    assert got == want and len(got) > 50


def test_report_counts_positions(spark):
    rows = noisy(5)
    report = {r.kind: r for r in arb.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    sizes = {}
    for r in rows:
        if r[5] is not None:
            sizes[r[1], r[2]] = sizes.get((r[1], r[2]), 0) + 1
    want = brute(rows)
    assert report["vertical"].n_checked == sum(n - 1 for n in sizes.values() if n >= 3)
    assert report["butterfly"].n_checked == sum(n - 2 for n in sizes.values() if n >= 3)
    for kind in ("vertical", "butterfly"):
        assert report[kind].on_mids == sum(w[2] == kind for w in want)
        assert report[kind].executable == sum(w[2] == kind and w[5] for w in want)


def test_calendar_within_a_root_only(spark):
    rows = []

    def curve(expiry, root, tenor, sigma, ks):
        for k in ks:
            rows.append((AT, expiry, root, k, sigma * sigma * tenor * (1 + k * k), tenor))

    ks = [i / 20 for i in range(-8, 9)]
    curve(date(2026, 9, 18), "A", 0.1, 0.40, ks)
    curve(date(2026, 11, 18), "A", 0.3, 0.10, ks[3:])
    curve(date(2026, 9, 18), "B", 0.1, 0.40, ks)
    curve(date(2026, 12, 18), "B", 0.4, 0.20, ks)
    curve(date(2026, 12, 18), "C", 0.5, 0.01, ks)
    curve(date(2027, 1, 15), "C", 0.6, 0.001, ks[:3])
    df = spark.createDataFrame(rows, "capture_utc timestamp, expiry date, root string, log_moneyness double, total_variance double, tenor_years double")
    found = arb.calendar_violations(df).collect()
    assert [(r.root, r.expiry, r.executable) for r in found] == [("A", date(2026, 11, 18), False)]
    r = found[0]
    # The drop (0.016 - 0.003)(1 + k^2) is largest where |k| is: the high end.
    assert r.strikes[0] == pytest.approx(0.4) and r.magnitude == pytest.approx(0.013 * 1.16)
    assert r.relative == pytest.approx(0.013 / 0.016)
    assert "total variance falls from 0.018560 at T=0.1000" in r.detail
