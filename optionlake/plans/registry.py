"""Every operator as a runnable query over the benchmark tables.

A query is ``f(spark, sf_dir) -> DataFrame``. Numbers are rounded well above
solver noise and instants shown as text, so results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import black76, clock, symbols
from ..functions.svi import Smile
from ..operators import arbitrage as arb
from ..operators import density, gate, health, inversion, moments, quality, reconcile, smile
from ..operators import forwards as fwd
from ..schema import KEY
from ..session import settle, tune
from ..sources import archive, curated, payloads
from . import collect, curate, estimate, tape

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(run: Query) -> Query:
    def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(tune(spark), sf_dir)

    tuned.__doc__ = run.__doc__
    REGISTRY[run.__name__] = tuned
    return tuned


def rnd(value, digits: int, name: str | None = None) -> Column:
    """Rounded, and never minus zero."""
    column = F.col(value) if isinstance(value, str) else value
    return (F.round(column, digits) + 0.0).alias(name or value)


def when_text(column: str = "capture_utc", name: str = "capture") -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(name)


def count(value, name: str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("bigint").alias(name)


def smile_key() -> list:
    return [when_text(), "expiry", "root"]


# --- curation ----------------------------------------------------------------


@query
def forward_curve(spark, sf):
    fits = fwd.fit_forwards(curate.add_mid(tape.quotes(spark, sf).where("bid > 0")))
    return fits.select(
        *smile_key(), rnd("tenor_years", 10), rnd("forward", 6), rnd("discount", 8), rnd("rate", 7),
        count("n_pairs", "n_pairs"), rnd("r2", 8), "excluded", "usable",
    )


@query
def forward_rmse(spark, sf):
    return curate.build(tape.quotes(spark, sf)).usable_forwards.select(*smile_key(), rnd("rmse", 6), rnd("r2", 9))


@query
def forward_summary(spark, sf):
    s = curate.build(tape.quotes(spark, sf)).forward_summary()
    return s.select(
        when_text(), count("n_forwards", "n_forwards"), count("n_usable", "n_usable"), rnd("min_r2", 8),
        rnd("median_r2", 8), rnd("min_rate", 6), rnd("max_rate", 6),
    )


@query
def curve_steps(spark, sf):
    """Step of the forward from one expiry to the next within a root."""
    order = Window.partitionBy("capture_utc", "root").orderBy("tenor_years")  # a row per expiry
    f = curate.build(tape.quotes(spark, sf)).usable_forwards
    return f.select(*smile_key(), rnd(F.col("forward") - F.lag("forward").over(order), 5, "step"))


@query
def tenor_by_root(spark, sf):
    return tape.quotes(spark, sf).select("capture_utc", "expiry", "root").distinct().select(
        *smile_key(), rnd(clock.tenor_years(F.col("expiry"), F.col("root"), F.col("capture_utc")), 12, "tenor_years"),
        F.date_format(clock.settlement_instant(F.col("expiry"), F.col("root")), "yyyy-MM-dd HH:mm:ss").alias("settles"),
    )


def contract_key() -> list:
    return [*smile_key(), "option_right", "strike"]


@query
def log_moneyness(spark, sf):
    return curate.build(tape.quotes(spark, sf)).flagged.select(*contract_key(), rnd("log_moneyness", 9), rnd("mid", 4), rnd("spread", 4))


@query
def quality_flags(spark, sf):
    flagged = curate.build(tape.quotes(spark, sf)).flagged
    finite = F.when(F.col("relative_spread") < float("inf"), F.col("relative_spread"))
    return flagged.select(*contract_key(), rnd(finite, 8, "relative_spread"), *quality.FLAGS)


@query
def kept_quotes(spark, sf):
    return curate.build(tape.quotes(spark, sf)).quotes.select(*contract_key(), "bid", "ask", rnd("log_moneyness", 9))


@query
def attrition_totals(spark, sf):
    t = curate.build(tape.quotes(spark, sf)).totals
    return t.select(
        when_text(), *[count(c, c) for c in ("total_in", "total_kept", "total_dropped", *quality.FLAGS, quality.NO_FORWARD)],
        rnd("kept_fraction", 9),
    )


@query
def attrition_by_rule(spark, sf):
    return curate.build(tape.quotes(spark, sf)).by_rule.select(when_text(), "rule", count("flagged", "flagged"))


@query
def attrition_by_expiry(spark, sf):
    t = curate.build(tape.quotes(spark, sf)).by_expiry
    return t.select(*smile_key(), *[count(c, c) for c in ("n_in", "n_kept", *quality.FLAGS)])


@query
def kept_without_rule(spark, sf):
    """What each rule costs on its own: quotes kept with that one rule disabled."""
    flagged = curate.build(tape.quotes(spark, sf)).flagged
    rules = sorted(quality.STRICT.drop)
    kept = flagged.groupBy("capture_utc").agg(
        F.count_if(~quality.drop_condition(quality.STRICT)).alias("strict"),
        F.count_if(~quality.drop_condition(quality.PERMISSIVE)).alias("permissive"),
        *[F.count_if(~quality.drop_condition(quality.STRICT.without(r))).alias(f"without_{r}") for r in rules],
    )
    return kept.select(when_text(), *[count(c, c) for c in kept.columns if c != "capture_utc"])


@query
def smile_slice(spark, sf):
    """One root's surviving quotes with their position along the strikes of a smile."""
    kept = curate.build(tape.quotes(spark, sf)).for_expiry(None, "SPXW")
    order = Window.partitionBy(*KEY).orderBy("strike", "option_right")  # one row per contract
    return kept.select(*contract_key(), F.row_number().over(order).cast("bigint").alias("position"))


# --- catalog -----------------------------------------------------------------


@query
def captures_view(spark, sf):
    return curated.captures_view(tape.quotes(spark, sf)).select(
        when_text(), "feed_timestamp", when_text("index_last_trade", "index_last_trade"), "seqno",
        "underlying_ticker", "underlying_price", *[count(c, c) for c in ("n_options", "n_expiries", "n_roots")],
    )


@query
def root_collisions(spark, sf):
    """Contracts two roots both list on one expiry, through the SQL views."""
    tape.quotes(spark, sf).createOrReplaceTempView("tape_quotes")
    return spark.sql("""
        SELECT date_format(capture_utc, 'yyyy-MM-dd HH:mm:ss') AS capture, expiry, count(*) AS collisions
        FROM (SELECT capture_utc, expiry, option_right, strike FROM tape_quotes
              GROUP BY capture_utc, expiry, option_right, strike HAVING count(DISTINCT root) > 1)
        GROUP BY capture_utc, expiry""")


@query
def boolean_sums(spark, sf):
    q = tape.quotes(spark, sf)
    return q.groupBy("capture_utc").agg(
        F.count_if(F.col("root") == "SPX").alias("spx"), F.count_if(F.col("root") == "SPXW").alias("spxw"),
        F.count_if(F.col("iv") == 0.0).alias("iv_sentinel"), F.count_if(F.col("bid").isNull()).alias("no_bid"),
    ).select(when_text(), *[count(c, c) for c in ("spx", "spxw", "iv_sentinel", "no_bid")])


@query
def newest_capture(spark, sf):
    return curated.newest(curated.captures_view(tape.quotes(spark, sf)), 5).select(when_text(), count("n_options", "n_options"))


@query
def capture_match(spark, sf):
    """The newest capture, and the last whose stamp contains a pattern."""
    found = curated.matching(curated.captures_view(tape.quotes(spark, sf)), "35-0")
    return found.select(when_text("newest", "newest"), when_text("match", "match"))


@query
def eastern_time(spark, sf):
    """Instants shown as Eastern wall time, by capture."""
    q = tape.quotes(spark, sf).select("index_last_trade").distinct()
    return q.select(when_text("index_last_trade", "utc"), clock.eastern_print(F.col("index_last_trade")).alias("eastern"))


# --- ingest ------------------------------------------------------------------


@query
def contract_symbols(spark, sf):
    """Parse a symbol per line item, malformed and impossible ones among them."""
    items = tape.read(spark, sf, "lineitem")
    key = F.col("l_orderkey")
    day = F.lpad((F.col("l_partkey") % 35).cast("string"), 2, "0")
    strike = (F.col("l_suppkey") * 2500 + 125).cast("string")
    text = F.concat(
        F.when(key % 19 == 0, "spxw").when(key % 23 == 0, "SP X").otherwise("SPXW"),
        F.lit("2602"), day, F.when(key % 29 == 0, "X").when(key % 2 == 0, "C").otherwise("P"),
        F.when(F.length(strike) < 8, F.lpad(strike, 8, "0")).otherwise(strike),  # an over-long one stays whole
    )
    parsed = items.select(symbols.contract(text).alias("c"))
    return parsed.groupBy("c.root", "c.option_right", "c.expiry", "c.strike").agg(F.count(F.lit(1)).alias("n"))


@query
def capture_names(spark, sf):
    named = tape.file_names(spark, sf).select("id", symbols.capture_file(F.col("name")).alias("c"))
    return named.select("id", "c.ticker", when_text("c.capture_utc"), "c.compressed", "c.stem")


@query
def payload_rows(spark, sf):
    rows = payloads.option_rows(payloads.snapshots(tape.bodies(spark, sf)))
    return payloads.quotes(rows).select(
        *contract_key(), "option_symbol", "feed_timestamp", when_text("index_last_trade", "index_last_trade"), "seqno",
        "underlying_ticker", "underlying_price", "bid", "ask", rnd("iv", 9), rnd("theo", 4), "open_interest", "volume", "tick", "gamma",
    )


@query
def payload_errors(spark, sf):
    report = payloads.conversion_report(payloads.snapshots(tape.bodies(spark, sf)))
    return report.select(when_text(), "stem", count("rows", "rows"), count("unparsed", "unparsed"), "error")


@query
def backfill_totals(spark, sf):
    report = payloads.conversion_report(payloads.snapshots(tape.bodies(spark, sf)))
    status = F.when(F.col("error").isNull(), "written").otherwise("failed")
    outcomes = report.select("stem", status.alias("status"), "rows", "unparsed", "error")
    return curated.Backfill(outcomes, 0).sums().select(*[count(c, c) for c in ("written", "skipped", "failed", "rows", "unparsed")])


@query
def capture_meta(spark, sf):
    meta = payloads.capture_meta(payloads.snapshots(tape.bodies(spark, sf)))
    return meta.select(when_text(), "ticker", "seqno", "spot", "prev_day_close", "iv30")


@query
def body_screening(spark, sf):
    """Validate and gate raw bodies end to end."""
    done = collect.screen(tape.bodies(spark, sf))
    return done.select(when_text(), "verdict", rnd("age_minutes", 4), count("n_options", "n_options"), "error")


@query
def freshness_verdicts(spark, sf):
    judged = gate.judge(tape.attempts(spark, sf), order=["capture_utc", "event_id"])
    return judged.select("event_id", "ticker", "print", "last_print", rnd("age_minutes", 4), "verdict")


@query
def verdict_counts(spark, sf):
    judged = gate.judge(tape.attempts(spark, sf), order=["capture_utc", "event_id"])
    return judged.groupBy("ticker", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query
def health_record(spark, sf):
    folded = health.fold(tape.outcomes(spark, sf), ["ticker"], ["at", "event_id"])
    return folded.select(
        "ticker", *[when_text(c, c) for c in ("last_attempt", "last_ok", "last_write")], "last_verdict", "last_error",
        *[count(c, c) for c in ("consecutive_failures", "total_writes", "total_skips", "total_failures")],
    )


@query
def duplicate_captures(spark, sf):
    found = gate.duplicates_of(tape.attempts(spark, sf).select("ticker", "capture_utc", "index_last_trade", "event_id"), ["event_id"])
    return found.select("event_id", "ticker", when_text("duplicate_of", "duplicate_of"))


@query
def layer_divergence(spark, sf):
    """Archived stems from the order keys against curated stems from the part keys."""
    raw = tape.read(spark, sf, "orders").select(
        symbols.stem(F.lit("_SPX"), tape.capture_instant(F.expr("o_orderkey div 10"))).alias("stem")
    )
    made = tape.read(spark, sf, "lineitem").select(
        symbols.stem(F.lit("_SPX"), tape.capture_instant(F.col("l_partkey") * 5)).alias("stem")
    )
    return reconcile.divergence(raw, made)


@query
def manifest_check(spark, sf):
    """A checksum manifest over whole documents, parsed and compared with them."""
    docs = tape.read(spark, sf, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    digest = F.sha2(F.col("text"), 256)
    line = F.concat(F.when(F.col("doc_id") % 17 == 0, F.sha2(name, 256)).otherwise(digest), F.lit("  "), name)
    lines = docs.where("doc_id % 13 <> 0 OR doc_id % 11 = 0").select(
        F.explode(F.array(F.lit("# comment"), F.lit(""), line)).alias("value")
    )
    on_disk = docs.where("doc_id % 11 <> 0").select(name.alias("name"), digest.alias("digest"))
    return reconcile.verify(archive.manifest_entries(lines), on_disk)


# --- arbitrage ---------------------------------------------------------------


def _breaches(found: DataFrame) -> DataFrame:
    strikes = F.concat_ws("/", F.transform("strikes", lambda k: F.format_string("%.1f", k)))
    return found.select(*smile_key(), "kind", strikes.alias("strikes"), rnd("magnitude", 6), rnd("relative", 8), "executable")


@query
def price_arbitrage(spark, sf):
    """Vertical and butterfly breaches of the curated chains."""
    return _breaches(arb.price_violations(arb.call_curve(curate.build(tape.quotes(spark, sf)).quotes)))


@query
def price_arbitrage_unfiltered(spark, sf):
    """The same checks with every quote kept: both rights share strikes."""
    chain = curate.build(tape.quotes(spark, sf), quality.PERMISSIVE)
    return _breaches(arb.price_violations(arb.call_curve(chain.quotes)))


@query
def price_arbitrage_on_mids(spark, sf):
    """The same checks on a curve that has mids only."""
    chain = curate.build(tape.quotes(spark, sf), quality.PERMISSIVE)
    return _breaches(arb.price_violations(arb.call_curve(chain.quotes.drop("bid", "ask"))))


def _variance_frame(spark, sf) -> DataFrame:
    """Known total variances with noise large enough to cross between expiries."""
    q = tape.quotes(spark, sf)
    noise = (F.col("h") % 11 - 5) / 50.0
    return q.select(
        *KEY, F.col("k0").alias("log_moneyness"), (F.col("w0") * (noise + 1.0)).alias("total_variance"),
        (F.col("days") / 365.0).alias("tenor_years"),
    )


@query
def calendar_arbitrage(spark, sf):
    found = arb.calendar_violations(_variance_frame(spark, sf))
    at = F.get("strikes", F.lit(0))
    return found.select(*smile_key(), "kind", rnd(at, 8, "at"), rnd("magnitude", 9), rnd("relative", 7), "executable")


@query
def arbitrage_report(spark, sf):
    r = arb.report(curate.build(tape.quotes(spark, sf)).quotes)
    return r.select(when_text(), "kind", *[count(c, c) for c in ("n_checked", "on_mids", "executable")], rnd("worst_rel", 8))


@query
def worst_breach(spark, sf):
    found = arb.price_violations(arb.call_curve(curate.build(tape.quotes(spark, sf)).quotes))
    return arb.worst(found, ["capture_utc", "kind"]).select(when_text(), "kind", rnd("relative", 8))


# --- pricing -----------------------------------------------------------------


@query
def model_prices(spark, sf):
    m = tape.model_quotes(spark, sf)
    return m.select(*contract_key(), rnd("model", 6, "price"))


@query
def put_call_parity(spark, sf):
    """C - P against D * (F - K) for every contract cell, both priced."""
    q = tape.model_quotes(spark, sf)
    vol = F.sqrt("w0")
    both = black76.with_price(q, "c", F.col("f0"), F.col("strike"), vol, F.col("d0"), "call")
    both = black76.with_price(both, "p", F.col("f0"), F.col("strike"), vol, F.col("d0"), "put")
    return both.select(*contract_key(), rnd(F.col("c") - F.col("p"), 7, "gap"))


@query
def model_vega(spark, sf):
    q = tape.model_quotes(spark, sf)
    vol, tenor = F.sqrt("w0"), F.col("days") / 365.0
    return q.select(
        *contract_key(),
        rnd(black76.vega(F.col("f0"), F.col("strike"), vol, F.col("d0")), 6, "per_total_vol"),
        rnd(black76.vega(F.col("f0"), F.col("strike"), vol, F.col("d0"), tenor), 6, "per_vol"),
    )


@query
def price_bounds(spark, sf):
    q = tape.model_quotes(spark, sf)
    low, high = black76.price_bounds(F.col("f0"), F.col("strike"), F.col("d0"), F.col("option_right"))
    return q.select(*contract_key(), rnd(low, 6, "low"), rnd(high, 6, "high"))


@query
def implied_vols(spark, sf):
    """Volatility back from a price moved off the money's time-value floor."""
    q = tape.model_quotes(spark, sf).withColumn("v", F.sqrt("w0") + 0.05)
    q = black76.with_price(q, "price", F.col("f0"), F.col("strike"), F.col("v"), F.col("d0"), F.col("option_right"))
    q = inversion.with_implied_vol(
        q, "implied_vol", F.col("price"), F.col("f0"), F.col("strike"), F.col("days") / 365.0, F.col("d0"), F.col("option_right")
    )
    return q.select(*contract_key(), rnd("implied_vol", 6))


@query
def unpriceable(spark, sf):
    """Prices on or outside the bounds have no volatility and raise nothing."""
    q = tape.model_quotes(spark, sf)
    low, high = black76.price_bounds(F.col("f0"), F.col("strike"), F.col("d0"), F.col("option_right"))
    bad = F.when(F.col("slot") % 3 == 0, low).when(F.col("slot") % 3 == 1, high * 1.01).otherwise(-5.0)
    q = inversion.with_total_vol(q, "v", bad, F.col("f0"), F.col("strike"), F.col("d0"), F.col("option_right"))
    return q.groupBy("capture_utc").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("inverted")
    ).select(when_text(), count("n", "n"), count("inverted", "inverted"))


# --- smiles and densities ----------------------------------------------------


@query
def smile_surface(spark, sf):
    q = tape.smiles(spark, sf).withColumn("k", F.explode(F.array(*[F.lit(x / 10.0) for x in range(-5, 6)])))
    s, k = Smile.of(), F.col("k")
    return q.select(
        *smile_key(), "k", rnd(s.total_variance(k), 12, "w"), rnd(s.volatility(k, F.col("tenor_years")), 10, "vol"),
        rnd(s.slope(k), 12, "dw"), rnd(s.curvature(k), 10, "d2w"), rnd(s.durrleman(k), 8, "g"),
        rnd(s.min_variance(), 12, "w_min"),
    )


@query
def durrleman_minimum(spark, sf):
    q = tape.smiles(spark, sf)
    low = smile.durrleman_minimum(Smile.of(), F.lit(-3.0), F.lit(3.0))
    return q.select(*smile_key(), rnd(low, 8, "g_min"))


@query
def density_nodes(spark, sf):
    """Closed-form density of every smile on its own grid, summarised by tenth."""
    d = density.from_smile(tape.smiles(spark, sf), KEY)
    return d.groupBy(*KEY, F.floor(F.col("i") / 200).cast("bigint").alias("part")).agg(
        F.sum(F.col("pdf") * F.col("forward")).alias("s"), F.max(F.col("pdf") * F.col("forward")).alias("peak")
    ).select(*smile_key(), "part", rnd("s", 6, "total"), rnd("peak", 6))


@query
def density_diagnostics(spark, sf):
    d = density.diagnostics(density.from_smile(tape.smiles(spark, sf), KEY), KEY)
    return d.select(*smile_key(), rnd("total_mass", 8), rnd("implied_forward", 4), rnd("max_pdf", 9), "is_proper")


@query
def density_by_differences(spark, sf):
    d = density.diagnostics(density.from_finite_differences(tape.smiles(spark, sf), KEY), KEY)
    return d.select(*smile_key(), rnd("total_mass", 5), rnd("implied_forward", 1))


@query
def density_quantiles(spark, sf):
    d = density.quantiles(density.from_smile(tape.smiles(spark, sf), KEY), KEY, [0.05, 0.25, 0.5, 0.75, 0.95])
    return d.select(*smile_key(), "p", rnd("strike", 4))


@query
def second_moment(spark, sf):
    d = density.moment(density.from_smile(tape.smiles(spark, sf), KEY), KEY, 2)
    return d.select(*smile_key(), rnd(F.col("moment") / 1e6, 6, "moment"))


@query
def density_moments(spark, sf):
    m = moments.moments(tape.smiles(spark, sf), KEY)
    return m.select(
        *smile_key(), rnd("bl_mean", 9), rnd("bl_variance", 10), rnd("bl_skewness", 6), rnd("bl_kurtosis", 5),
        rnd("px_mean", 4), rnd("px_variance", 1), rnd("px_skewness", 5), rnd("px_kurtosis", 4),
    )


@query
def spanning_moments(spark, sf):
    m = moments.moments(tape.smiles(spark, sf), KEY)
    return m.select(*smile_key(), rnd("bkm_variance", 9), rnd("bkm_skewness", 5), rnd("bkm_kurtosis", 4))


@query
def moment_agreement(spark, sf):
    """The two routes agree to well under the verdict's tolerance."""
    m = moments.moments(tape.smiles(spark, sf), KEY)
    return m.select(*smile_key(), (F.col("bl_bkm_gap") < 1e-4).alias("agrees"))


def _known(spark, sf) -> DataFrame:
    """Contracts with exact variances, forward and discount."""
    return tape.model_quotes(spark, sf).select(
        *KEY, (F.col("days") / 365.0).alias("tenor_years"), F.col("f0").alias("forward"), F.col("d0").alias("discount"),
        F.col("k0").alias("log_moneyness"), F.when(~tape.thin(), F.col("w0")).alias("total_variance"),
        black76.vega(F.col("f0"), F.col("strike"), F.sqrt("w0"), F.col("d0")).alias("vega"),
    )


@query
def smile_fits(spark, sf):
    """Fitted smiles evaluated where their quotes are, relative to their level."""
    fitted = smile.fit(smile.curves(_known(spark, sf)))
    s = Smile.of()
    points = F.array(*[F.lit(x / 100.0) for x in (-8, -4, 0, 4, 8)])
    scale = F.col("tenor_years") * 365.0 / tape.SMILE_DAYS
    return fitted.withColumn("k", F.explode(points)).select(
        *smile_key(), "k", count("n_quotes", "n_quotes"), rnd(s.total_variance(F.col("k")) / scale, 6, "w"), "excluded",
    )


@query
def known_smile_estimates(spark, sf):
    """The whole estimate on exact variances: every verdict is known."""
    e = estimate.estimate_all(_known(spark, sf))
    return e.select(
        *smile_key(), count("n_quotes", "n_quotes"), rnd("days", 4), rnd("mass", 5), rnd("annualised_vol", 5),
        rnd("skewness", 3), rnd("kurtosis", 2), "trustworthy", "failures", "excluded",
    )


@query
def expiry_estimates(spark, sf):
    """Term structure of every capture from its noisy quotes."""
    return estimate.estimate_all(curate.build(tape.quotes(spark, sf)).quotes).withColumn("capture_utc", when_text())


@query
def estimate_verdicts(spark, sf):
    """Verdicts on noisy quotes: the chains are clean, so enough quotes means trust."""
    e = estimate.estimate_all(curate.build(tape.quotes(spark, sf)).quotes)
    return e.select(*smile_key(), count("n_quotes", "n_quotes"), "trustworthy", "failures", "excluded")


@query
def estimate_summary(spark, sf):
    e = estimate.estimate_all(curate.build(tape.quotes(spark, sf)).quotes)
    return estimate.summary(e).withColumn("capture_utc", when_text())


def _curated(spark, sf) -> DataFrame:
    """Kept quotes of the curated chains. The chains are built once: forwards and flags read them three times."""
    return curate.build(settle(tape.quotes(spark, sf).select(*curate.COLUMNS))).quotes


@query
def full_arbitrage_report(spark, sf):
    """All three conditions on curated chains with inverted volatilities."""
    prepared = settle(inversion.prepare(_curated(spark, sf)))
    r = arb.report(prepared)
    return r.select(when_text(), "kind", *[count(c, c) for c in ("n_checked", "on_mids", "executable")], rnd("worst_rel", 8))


@query
def inverted_quotes(spark, sf):
    """Curated quotes with their volatility, variance and vega, from their own mids and parity forwards."""
    p = inversion.prepare(curate.build(tape.quotes(spark, sf)).quotes)
    return p.select(*contract_key(), rnd("implied_vol", 6), rnd("total_variance", 8), rnd("vega", 3))


@query
def estimate_counts(spark, sf):
    """Smiles per capture: how many are trusted or left out, and why."""
    e = estimate.estimate_all(curate.build(tape.quotes(spark, sf)).quotes)
    reasons = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_quotes", "excluded"))), lambda x: x["excluded"]), "; ")
    per = e.groupBy("capture_utc").agg(
        F.count(F.lit(1)).alias("n_smiles"), F.count_if("trustworthy").alias("n_trustworthy"), F.count("excluded").alias("n_excluded"), reasons.alias("reasons")
    )
    return per.select(when_text(), *[count(c, c) for c in ("n_smiles", "n_trustworthy", "n_excluded")], "reasons")


@query
def violation_details(spark, sf):
    """What every price breach of the curated chains says about itself."""
    found = arb.price_violations(arb.call_curve(curate.build(tape.quotes(spark, sf)).quotes))
    strikes = F.concat_ws("/", F.transform("strikes", lambda k: F.format_string("%.1f", k)))
    return found.select(*smile_key(), "kind", strikes.alias("strikes"), "detail")


@query
def moment_differences(spark, sf):
    """Price-space moments against the spanning route, field by field."""
    gaps = moments.relative_to(moments.moments(tape.smiles(spark, sf), KEY), KEY, "px", "bkm")
    return gaps.select(*smile_key(), *[rnd(f, 5) for f in ("mean", "variance", "skewness", "kurtosis")])


def _doubtful(spark, sf) -> DataFrame:
    """Fits with one fault each by week: badly fitting, dipping on paper, dented, with wings that hold too much, and left out."""
    week = F.col("week")
    fits = tape.smiles(spark, sf).withColumns(
        {
            "rmse_vol": F.when(week == 2, 0.0123).otherwise(0.001), "min_durrleman": F.when(week == 3, -0.25).otherwise(0.1),
            "b": F.col("b") * F.when(week == 4, 2.0).when(week == 5, 31.0).otherwise(1.0),
            "sigma": F.when(week == 4, 0.004).otherwise(F.col("sigma")), "excluded": F.when(week == 1, "left out"),
        }
    )
    return fits.withColumns({c: F.when(week != 1, F.col(c)) for c in ("a", "b", "rho", "m", "sigma")}).drop("week")


@query
def verdict_failures(spark, sf):
    """Checks that doubtful fits do not pass, with their numbers; the agreement of the two moment routes is in other queries."""
    judged = estimate.judge(_doubtful(spark, sf))
    shown = F.filter(F.split("failures", "; "), lambda f: ~f.startswith("BL/BKM"))
    return judged.select(*smile_key(), "excluded", F.array_join(shown, "; ").alias("failures"))


from . import layer  # noqa: E402, F401 (registers the queries over files and streams)
