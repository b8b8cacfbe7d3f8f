"""Option-chain captures derived from the benchmark tables by plain arithmetic.

The given tables hold no option chains, so each line item is read as one print
on a chain: its keys choose capture, expiry, root, right and strike, and its
price the noise. Line items are aggregated per contract first, so a capture has
one row per contract however the items are distributed, and the number of
captures grows with the order keys. Every derived number is integer arithmetic
or a formula a SQL engine can repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import black76, symbols
from ..functions.svi import Smile

ORDERS_PER_CAPTURE = 1000
CAPTURE_SECONDS = 1  # two-digit years then last for 2.3e12 order keys
EPOCH = 1786455300  # 2026-08-11 13:35:00 UTC
WEEKS = 8
SLOTS = 60
LOW_STRIKE = 7000
STRIKE_STEP = 25
SPOT = 7750.0
TICKER = "_SPX"

# The equity smile every chain is priced from, scaled by time from 38 days.
A, B, RHO, M, SIGMA = 0.002, 0.04, -0.7, 0.02, 0.15
SMILE_DAYS = 38.0
WIDTH = 0.0055  # logistic scale per root day, near 20 % annual volatility


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (capture, week, root, right, strike slot) with a noise number."""
    items = read(spark, sf_dir, "lineitem")
    return (
        items.select(
            F.expr(f"l_orderkey div {ORDERS_PER_CAPTURE}").alias("cap"),
            (F.col("l_suppkey") % WEEKS).cast("int").alias("week"),
            F.when(F.col("l_linenumber") % 2 == 0, "SPX").otherwise("SPXW").alias("root"),
            F.when(F.col("l_quantity").cast("int") % 2 == 0, "call").otherwise("put").alias("option_right"),
            (F.col("l_partkey") % SLOTS).cast("int").alias("slot"),
            F.round(F.col("l_extendedprice") * 100.0).cast("bigint").alias("cents"),
        )
        .groupBy("cap", "week", "root", "option_right", "slot")
        .agg(F.sum("cents").alias("h"), F.count(F.lit(1)).alias("n"))
    )


def capture_instant(cap: Column) -> Column:
    return F.timestamp_seconds(F.lit(EPOCH) + cap * CAPTURE_SECONDS)


def _market(rows: DataFrame) -> DataFrame:
    """Capture, expiry, forward, discount and smile scale from cap, week and root."""
    week, spxw = F.col("week"), F.col("root") == "SPXW"
    steep = (week == 6) & (F.col("root") == "SPX")
    return rows.withColumns(
        {
            "capture_utc": capture_instant(F.col("cap")),
            "expiry": F.date_add(F.to_date(capture_instant(F.col("cap"))), week * 7),
            "underlying_price": F.lit(SPOT) + (F.col("cap") % 17) * 0.25,
            "days": week * 7.0 + 0.25,
            "f0": F.lit(SPOT) + (F.col("cap") % 17) * 0.25 + week * 4.0 + F.when(spxw, 0.5).otherwise(0.0),
            "d0": F.when(steep, 0.95).otherwise(F.lit(1.0) - week * 0.0008),
        }
    ).withColumn("scale", F.col("days") / SMILE_DAYS)


def smiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One known smile per (capture, expiry, root) that the line items touch."""
    items = read(spark, sf_dir, "lineitem")
    touched = items.select(
        F.expr(f"l_orderkey div {ORDERS_PER_CAPTURE}").alias("cap"),
        (F.col("l_suppkey") % WEEKS).cast("int").alias("week"),
        F.when(F.col("l_linenumber") % 2 == 0, "SPX").otherwise("SPXW").alias("root"),
    ).distinct()
    market = _market(touched)
    return market.select(
        "capture_utc", "expiry", "root", "week",
        (F.col("days") / 365.0).alias("tenor_years"),
        F.col("f0").alias("forward"), F.col("d0").alias("discount"),
        (F.col("scale") * A).alias("a"), (F.col("scale") * B).alias("b"),
        F.lit(RHO).alias("rho"), F.lit(M).alias("m"), F.lit(SIGMA).alias("sigma"),
        F.lit(0.0).alias("k_required"),
    )


def thin() -> Column:
    """Contracts of a smile that hardly trades: they are listed, but nine of ten have no book."""
    return (F.col("week") == 7) & (F.col("root") == "SPX") & (F.col("slot") % 10 != 0)


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts with strike, forward, discount and the variance of the known smile."""
    strike = (F.col("slot") * STRIKE_STEP + LOW_STRIKE).cast("double")
    rows = _market(cells(spark, sf_dir)).withColumn("strike", strike)
    known = F.expr(f"{A}D + {B}D*({RHO}D*(k0 - {M}D) + sqrt((k0 - {M}D)*(k0 - {M}D) + {SIGMA * SIGMA!r}D))")
    return rows.withColumn("k0", F.ln(F.col("strike") / F.col("f0"))).withColumn("w0", F.col("scale") * known)


def model_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts with their exact Black-76 price: no noise, no rounding."""
    return black76.with_price(
        contracts(spark, sf_dir), "model", F.col("f0"), F.col("strike"), F.sqrt("w0"), F.col("d0"),
        F.col("option_right"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated-style quotes: prices with spreads, noise and broken books.

    Prices are those of a logistic terminal distribution, which obeys parity, is
    free of arbitrage and has a smile of its own, in a formula of one line.
    """
    h = F.col("h")
    priced = contracts(spark, sf_dir).withColumn("width", F.sqrt("days") * SPOT * WIDTH).withColumn(
        "model",
        F.expr("d0 * width * ln(1D + exp((CASE WHEN option_right = 'call' THEN f0 - strike ELSE strike - f0 END) / width))"),
    )
    noisy = (F.col("week") == 5) & (F.col("root") == "SPX")
    middle = (
        F.col("model") + 0.00123457 + (F.floor(h / 7) % 5 - 2) * 0.01
        + F.when(noisy, (h % 601).cast("double")).otherwise(0.0)
    )
    half = (h % 4 + 1) * 0.05 + F.col("model") * 0.002

    def cents(x: Column, least: int) -> Column:
        return F.greatest(F.floor(x * 100.0 + 0.5), F.lit(least).cast("bigint")) / 100.0

    low, high = cents(middle - half, 0), cents(middle + half, 1)
    crossed = h % 97 == 0
    keys = ["cap", "week", "root", "option_right", "slot"]
    # Same keys as the aggregation in `cells`, so no exchange. It makes the book
    # a value: filters on it stop here instead of repeating its formula, as they
    # would stop at the scan of a stored table.
    book = (
        priced.withColumns(
            {
                "bid": F.when((h % 211 != 0) & ~thin(), F.when(crossed, high).otherwise(low)),
                "ask": F.when((h % 223 != 0) & ~thin(), F.when(h % 193 == 0, 0.0).when(crossed, low).otherwise(high)),
                "iv": F.when(h % 13 == 0, 0.0).otherwise(F.sqrt(F.col("w0") / (F.col("days") / 365.0))),
            }
        )
        .groupBy(*keys)
        .agg(*[F.first(c).alias(c) for c in ("h", "n", "bid", "ask", "iv", "model", "strike", "k0", "w0")])
    )
    symbol = F.concat(
        "root", F.date_format("expiry", "yyMMdd"),
        F.when(F.col("option_right") == "call", "C").otherwise("P"),
        F.lpad((F.col("strike") * 1000).cast("bigint").cast("string"), 8, "0"),
    )
    instant = F.col("capture_utc")
    return _market(book).select(
        "capture_utc",
        F.date_format(instant, "yyyy-MM-dd HH:mm:ss").alias("feed_timestamp"),
        (instant - F.expr("interval 15 minutes")).alias("index_last_trade"),
        (F.lit(1_000_000) + F.col("cap")).alias("seqno"),
        F.lit(TICKER).alias("underlying_ticker"),
        "underlying_price",
        symbol.alias("option_symbol"), "root", "option_right", "expiry", "strike", "bid", "ask", "iv",
        F.col("model").alias("theo"),
        F.lit(None).cast("double").alias("delta"),
        (h % 1000).cast("double").alias("open_interest"),
        F.col("n").cast("double").alias("volume"),
        "h", "n", "cap", "week", "slot", "scale", "k0", "w0", "f0", "d0", "days",
    )


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw JSON bodies, one per capture, some broken on purpose.

    A body holds at most one option per contract cell, so what is gathered per
    capture is bounded by the grid and not by the line items.
    """
    symbol = F.when(F.col("h") % 89 == 0, F.concat(F.lit("?"), "option_symbol")).otherwise(F.col("option_symbol"))
    option = F.struct(
        symbol.alias("option"), "bid", "ask", "iv", "theo", "open_interest", "volume",
        F.when(F.col("h") % 2 == 0, "up").otherwise("").alias("tick"),
    )
    chains = quotes(spark, sf_dir).groupBy("cap", "capture_utc", "feed_timestamp", "seqno", "underlying_price").agg(
        F.collect_list(option).alias("options")
    )
    broken = F.col("cap") % 7
    eastern = F.from_utc_timestamp(F.col("capture_utc") - F.expr("interval 15 minutes"), "America/New_York")
    data = F.struct(
        F.when(broken == 5, F.lit(0.0)).otherwise(F.col("underlying_price")).alias("current_price"),
        F.when(broken == 6, F.lit("16:14:59")).otherwise(F.date_format(eastern, "yyyy-MM-dd'T'HH:mm:ss")).alias("last_trade_time"),
        "seqno",
        (F.col("underlying_price") - 1.0).alias("prev_day_close"),
        "options",
    )
    body = F.to_json(
        F.struct(F.when(broken != 3, F.col("feed_timestamp")).alias("timestamp"), F.lit("_SPX").alias("symbol"), data.alias("data"))
    )
    return chains.select(F.lit(TICKER).alias("ticker"), "capture_utc", body.alias("body"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture attempts from the event log: five tickers share all the events."""
    ts = F.col("ts").cast("timestamp")
    micros = F.unix_micros(ts)
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("ticker"),
        ts.alias("capture_utc"),
        "event_id",
        # The index last printed at the latest multiple of 40 minutes.
        F.timestamp_micros(micros - micros % F.lit(2_400_000_000)).alias("index_last_trade"),
        F.col("event_id").alias("seqno"),
        F.col("value").alias("spot"),
        (F.col("event_id") % 50 == 0).alias("force"),
        F.lit(0).alias("n_options"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection log from the event log."""
    kind = F.col("event_id") % 9
    failed = (kind == 4) | (kind == 5)
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("ticker"),
        F.col("ts").cast("timestamp").alias("at"),
        "event_id",
        F.when(failed, "FeedError").when(kind == 8, "skipped_locked").when(kind < 3, "accept").otherwise("duplicate_print").alias("verdict"),
        (kind < 3).alias("written"),
        F.when(failed, F.concat(F.lit("attempt "), F.col("event_id").cast("string"))).alias("error"),
    )


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive file names from the orders, malformed ones among them."""
    key = F.col("o_orderkey")
    stamp = symbols.stamp(capture_instant(key))
    return read(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.when(key % 11 == 0, F.concat(F.lit("_SPX_"), stamp, F.lit(".json.gz.tmp")))
        .when(key % 13 == 0, F.concat(F.lit("spy_"), stamp, F.lit(".json")))
        .when(key % 17 == 0, F.concat(F.lit("SPY_"), F.translate(stamp, "-", ":"), F.lit(".json")))
        .when(key % 2 == 0, F.concat(F.lit("_SPX_"), stamp, F.lit(".json.gz")))
        .otherwise(F.concat(F.lit("SPY_"), stamp, F.lit(".json")))
        .alias("name"),
    )
