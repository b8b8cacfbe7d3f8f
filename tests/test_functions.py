import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from optionlake.functions import black76, clock, normal, symbols


def column(spark, values, kind, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_erfc_and_cdf_are_accurate_on_the_whole_line(spark):
    xs = [-40.0, -6.0, -1.0, -0.3, 0.0, 0.2, 0.46, 0.48, 1.0, 3.9, 4.1, 10.0, 26.0, float("inf"), -float("inf")]
    df = spark.createDataFrame([(x,) for x in xs], "x double").withColumn("e", F.expr(normal.erfc_sql("x")))
    for r in normal.with_norm_cdf(df, {"n": F.col("x")}).collect():
        assert r.e == pytest.approx(math.erfc(r.x), rel=5e-16, abs=1e-320)
        assert r.n == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), rel=1e-14, abs=1e-300)


BAD_SYMBOLS = [
    "", "SPX", "260821C01400000", "SPX260821C0140000", "SPX260821C014000000", "SPX26021C01400000", "SPX260821X01400000",
    "spxw260821C01400000", "SPX260821c01400000", "SPX260821C0140000A", "1SPX260821C01400000", "SPX260821C01400000X",
    "SPX261301C01400000", "SPX260832C01400000", "SPX260001C01400000", "SPX260800C01400000", "SPX270229C01400000", None,
]


def test_symbols(spark):
    assert column(spark, BAD_SYMBOLS, "string", symbols.contract) == [None] * len(BAD_SYMBOLS)
    good = column(
        spark, ["SPXW260821P07727500", "SPX2608 21C00000001", "SPX280229C99999999"], "string", symbols.contract
    )
    assert [(g.root, g.option_right, str(g.expiry), g.strike) for g in good] == [
        ("SPXW", "put", "2026-08-21", 7727.5), ("SPX", "call", "2026-08-21", 0.001), ("SPX", "call", "2028-02-29", 99999.999),
    ]
    assert good[1].option_symbol == "SPX260821C00000001"


def test_capture_names(spark):
    names = ["_SPX_2026-08-11T20-37-03Z.json.gz", "SPY_2026-08-11T20-37-03Z.json", "_SPX_2026-08-11T20-37-03Z.json.tmp",
             ".DS_Store", "_SPX_2026-08-11.json", "_SPX_2026-08-11T20:37:03Z.json"]
    got = column(spark, names, "string", symbols.capture_file)
    assert got[2:] == [None] * 4
    assert (got[0].ticker, got[0].compressed, got[0].stem) == ("_SPX", True, "_SPX_2026-08-11T20-37-03Z")
    assert (got[1].ticker, got[1].compressed) == ("SPY", False)


def test_eastern_stamps(spark):
    text = ["2026-08-11T16:14:59", "2026-08-11 16:14:59.25", "20260811", "2026-01-11T16", "16:14:59", "2026",
            "2026-08-11T16:14:59+00:00", "2026-08-11T16:14:59Z", "2026-13-11T16:14:59", "2026-08-11T24:00:00", ""]
    shown = column(spark, text, "string", lambda c: F.date_format(clock.eastern_instant(c), "yyyy-MM-dd HH:mm:ss.SS"))
    assert shown[:4] == ["2026-08-11 20:14:59.00", "2026-08-11 20:14:59.25", "2026-08-11 04:00:00.00", "2026-01-11 21:00:00.00"]
    assert shown[4:] == [None] * 7
    assert column(spark, text[6:9], "string", clock.looks_aware) == [True, True, False]


def test_tenor_follows_settlement_and_daylight_saving(spark):
    rows = spark.sql("""select * from values (date'2026-08-21', 'SPX'), (date'2026-08-21', 'SPXW'), (date'2026-12-18', 'SPX'),
        (date'2026-08-11', 'SPX') as t(e, r)""")
    at = F.lit(datetime(2026, 8, 11, 20, 0)).cast("timestamp")
    got = [r.t for r in rows.select(clock.tenor_years(F.col("e"), F.col("r"), at).alias("t")).collect()]
    hours = [t * 365 * 24 for t in got]
    assert hours[1] - hours[0] == pytest.approx(6.5)
    assert hours[0] == pytest.approx(9 * 24 + 17.5)
    assert hours[2] == pytest.approx(128 * 24 + 18.5)
    assert hours[3] == pytest.approx(-6.5)


def test_prices_reach_their_limits(spark):
    df = spark.sql("""select * from values (0D, 7700D, 'call', 100 * 0.99D), (0D, 7800D, 'call', 0D), (50D, 7800D, 'call', 7800 * 0.99D),
        (CAST('NaN' AS DOUBLE), 7900D, 'put', 100 * 0.99D), (0D, 7800D, 'neither', NULL) as t(v, k, r, want)""")
    got = black76.with_price(df, "p", 7800.0, F.col("k"), F.col("v"), 0.99, F.col("r")).collect()
    for r in got:
        assert r.p == (None if r.want is None else pytest.approx(float(r.want), rel=1e-6, abs=1e-12))
    with pytest.raises(ValueError):
        black76.with_price(df, "p", 7800.0, F.col("k"), F.col("v"), 0.99, "straddle")
    far = df.limit(1).select(black76.vega(7752.07, 100000.0, 0.03, 0.99).alias("v")).first().v
    assert 0 <= far < 1e-100


def test_a_contract_reads_its_symbol_once(spark):
    """Inside a lambda nothing is shared, so a symbol mentioned nine times was unpacked and matched as often."""
    shown = str(symbols.contract(F.col("a_symbol")))
    assert shown.count("a_symbol") == 1 and shown.count("regexp") + shown.count("RLIKE") == 1
    rows = spark.createDataFrame([("SPXW260908C07825000",), ("SPX 260230P00000500",), ("SPX260229P00000500",), ("SPX260228P00000500\n",), ("?X260228P00000500",), ("",), (None,)], "s string")
    got = [r.c for r in rows.select(F.transform(F.array("s"), symbols.contract)[0].alias("c")).collect()]
    assert [g and (g.root, g.option_right, str(g.expiry), g.strike) for g in got] == [
        ("SPXW", "call", "2026-09-08", 7825.0), None, None, ("SPX", "put", "2026-02-28", 0.5), None, None, None
    ]
