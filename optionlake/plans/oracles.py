"""The same results in plain SQL, derived independently.

Where Spark uses an approximation of N(x), this uses Gauss-Legendre quadrature;
where it uses per-node Simpson weights, this uses neighbouring nodes; where it
aggregates sides of a strike, this joins every call/put pair; where it carries
followers across strike bands, this uses plain windows.
"""

from __future__ import annotations

import math

import numpy as np

from . import tape

_T, _W = np.polynomial.legendre.leggauss(48)
_NODES = "[" + ",".join(repr(float((t + 1) / 2)) for t in _T) + "]"
_WEIGHTS = "[" + ",".join(repr(float(w / 2)) for w in _W) + "]"
_ROOT = repr(math.sqrt(2.0 * math.pi))


def cdf(x: str) -> str:
    area = f"list_dot_product(list_transform({_NODES}, lambda t: exp(-0.5*({x})*({x})*t*t)), {_WEIGHTS})"
    return f"(CASE WHEN ({x}) > 8.5 THEN 1.0 WHEN ({x}) < -8.5 THEN 0.0 ELSE 0.5 + ({x})*{area}/{_ROOT} END)"


def rnd(x: str, digits: int, name: str) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


def text(x: str, name: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S') AS {name}"


def svi(k: str, p: str = "") -> str:
    return f"({p}a + {p}b*({p}rho*({k}-{p}m) + sqrt(({k}-{p}m)*({k}-{p}m) + {p}sigma*{p}sigma)))"


def slope(k: str) -> str:
    return f"(b*(rho + ({k}-m)/sqrt(({k}-m)*({k}-m)+sigma*sigma)))"


def bend(k: str) -> str:
    return f"(b*sigma*sigma/pow(({k}-m)*({k}-m)+sigma*sigma, 1.5))"


def durrleman(k: str) -> str:
    w, d, c = f"greatest({svi(k)}, 1e-12)", slope(k), bend(k)
    return f"(pow(1 - {k}*{d}/(2*{w}), 2) - {d}*{d}/4*(1/{w} + 0.25) + {c}/2)"


def pdf(k: str, f: str = "forward") -> str:
    w = f"greatest({svi(k)}, 1e-14)"
    return f"({durrleman(k)}/({f}*exp({k})*sqrt(2*pi()*{w}))*exp(-0.5*pow(-({k})/sqrt({w}) - sqrt({w})/2, 2)))"


SMILE = f"{text('capture_utc', 'capture')}, expiry, root"
CONTRACT = f"{SMILE}, option_right, strike"
KEY = "capture_utc, expiry, root"

INSTANT = f"make_timestamp(({tape.EPOCH} + {tape.CAPTURE_SECONDS}*cap)*1000000)"
CELLS = f"""
items AS (
  SELECT l_orderkey // {tape.ORDERS_PER_CAPTURE} AS cap, CAST(l_suppkey % {tape.WEEKS} AS INTEGER) AS week,
         CASE WHEN l_linenumber % 2 = 0 THEN 'SPX' ELSE 'SPXW' END AS root,
         CASE WHEN CAST(l_quantity AS INTEGER) % 2 = 0 THEN 'call' ELSE 'put' END AS option_right,
         CAST(l_partkey % {tape.SLOTS} AS INTEGER) AS slot,
         CAST(round(l_extendedprice*100) AS BIGINT) AS cents
  FROM lineitem),
cells AS (SELECT cap, week, root, option_right, slot, CAST(sum(cents) AS BIGINT) AS h, count(*) AS n
          FROM items GROUP BY ALL)"""
_MARKET = f"""
  {INSTANT} AS capture_utc, CAST({INSTANT} AS DATE) + 7*week AS expiry,
  {tape.SPOT} + (cap % 17)*0.25 AS underlying_price, week*7.0::DOUBLE + 0.25 AS days,
  ({tape.SPOT} + (cap % 17)*0.25 + week*4.0 + CASE WHEN root = 'SPXW' THEN 0.5 ELSE 0.0 END)::DOUBLE AS f0,
  (CASE WHEN week = 6 AND root = 'SPX' THEN 0.95 ELSE 1.0::DOUBLE - week*0.0008::DOUBLE END)::DOUBLE AS d0"""
VOLS = f"""{CELLS},
grid AS (SELECT *, {_MARKET}, (7000.0 + 25*slot)::DOUBLE AS strike FROM cells),
shaped AS (SELECT *, days/{tape.SMILE_DAYS}::DOUBLE AS scale, ln(strike/f0) AS k0, CAST(n AS BIGINT) AS nn FROM grid),
vols AS (SELECT *, scale*({tape.A}::DOUBLE + {tape.B}::DOUBLE*({tape.RHO}::DOUBLE*(k0-{tape.M}::DOUBLE)
         + sqrt((k0-{tape.M}::DOUBLE)*(k0-{tape.M}::DOUBLE)+{tape.SIGMA ** 2!r}::DOUBLE))) AS w0 FROM shaped)"""
MODEL = f"""{VOLS},
ds AS (SELECT *, sqrt(w0) AS v, (-k0 + w0/2)/sqrt(w0) AS d1,
       CASE WHEN option_right = 'call' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS side FROM vols),
model AS (SELECT *, d0*side*(f0*{cdf('side*d1')} - strike*{cdf('side*(d1-v)')}) AS model FROM ds)"""
QUOTES = f"""{VOLS},
logistic AS (SELECT *, d0*width*ln(1 + exp((CASE WHEN option_right = 'call' THEN f0-strike ELSE strike-f0 END)/width)) AS model
         FROM (SELECT *, sqrt(days)*{tape.SPOT}::DOUBLE*{tape.WIDTH}::DOUBLE AS width FROM vols)),
priced AS (SELECT *, model + 0.00123457 + ((h // 7) % 5 - 2)*0.01
           + CASE WHEN week = 5 AND root = 'SPX' THEN (h % 601)::DOUBLE ELSE 0.0 END AS middle,
           (h % 4 + 1)*0.05 + model*0.002 AS half FROM logistic),
book AS (SELECT *, greatest(CAST(floor((middle-half)*100.0+0.5) AS BIGINT), 0)/100.0::DOUBLE AS low,
         greatest(CAST(floor((middle+half)*100.0+0.5) AS BIGINT), 1)/100.0::DOUBLE AS high FROM priced),
quotes AS (SELECT capture_utc, strftime(capture_utc, '%Y-%m-%d %H:%M:%S') AS feed_timestamp,
  capture_utc - INTERVAL 15 MINUTE AS index_last_trade, 1000000 + cap AS seqno, '_SPX' AS underlying_ticker,
  underlying_price::DOUBLE AS underlying_price,
  root || strftime(expiry, '%y%m%d') || CASE WHEN option_right = 'call' THEN 'C' ELSE 'P' END
    || lpad(CAST(CAST(strike*1000 AS BIGINT) AS VARCHAR), 8, '0') AS option_symbol,
  root, option_right, expiry, strike,
  CASE WHEN h % 211 <> 0 AND NOT (week = 7 AND root = 'SPX' AND slot % 10 <> 0) THEN CASE WHEN h % 97 = 0 THEN high ELSE low END END AS bid,
  CASE WHEN h % 223 <> 0 AND NOT (week = 7 AND root = 'SPX' AND slot % 10 <> 0) THEN CASE WHEN h % 193 = 0 THEN 0.0 WHEN h % 97 = 0 THEN low ELSE high END END AS ask,
  CASE WHEN h % 13 = 0 THEN 0.0 ELSE sqrt(w0/(days/365.0)) END AS iv, model AS theo,
  (h % 1000)::DOUBLE AS open_interest, nn::DOUBLE AS volume, h, cap, week, slot, scale, k0, w0, f0, d0, days
  FROM book)"""
_SETTLES = """timezone('America/New_York', CAST(expiry AS TIMESTAMP)
  + CASE WHEN root = 'SPX' THEN INTERVAL 570 MINUTE ELSE INTERVAL 960 MINUTE END)"""
_TENOR = f"((epoch_us({_SETTLES}) - epoch_us(capture_utc))/1e6/(365.0*86400.0))"
FORWARDS = f"""{QUOTES},
mids AS (SELECT *, (bid + ask)/2.0 AS mid FROM quotes WHERE bid > 0),
pairs AS (SELECT c.capture_utc, c.expiry, c.root, c.strike AS k, c.mid - p.mid AS y
          FROM mids c JOIN mids p USING (capture_utc, expiry, root, strike)
          WHERE c.option_right = 'call' AND p.option_right = 'put' AND c.mid IS NOT NULL AND p.mid IS NOT NULL),
lines AS (SELECT {KEY}, count(*) AS n, max(k)-min(k) AS width, regr_slope(y, k) AS sl, avg(y) - regr_slope(y, k)*avg(k) AS ic
          FROM pairs GROUP BY ALL),
resid AS (SELECT {KEY}, sum((y - ic - sl*k)*(y - ic - sl*k)) AS ssr, sum((y - ybar)*(y - ybar)) AS sst
          FROM pairs JOIN lines USING (capture_utc, expiry, root)
          JOIN (SELECT {KEY}, avg(y) AS ybar FROM pairs GROUP BY ALL) USING (capture_utc, expiry, root) GROUP BY ALL),
every AS (SELECT {KEY}, {_TENOR} AS tenor_years FROM (SELECT DISTINCT {KEY} FROM mids)),
raw AS (SELECT e.*, coalesce(n, 0) AS n, coalesce(width, 0) AS width, -sl AS d, CASE WHEN -sl > 0 THEN ic/(-sl) END AS f,
        CASE WHEN sst > 0 THEN 1 - ssr/sst ELSE 0 END AS r2, sqrt(ssr/n) AS rmse
        FROM every e LEFT JOIN lines USING (capture_utc, expiry, root) LEFT JOIN resid USING (capture_utc, expiry, root)),
why AS (SELECT *, CASE WHEN d > 0 THEN -ln(d)/tenor_years END AS rate0, CASE
   WHEN tenor_years <= 0 THEN 'expired'
   WHEN n < 8 THEN printf('only %d call/put pairs, need 8', n)
   WHEN width = 0 THEN 'all pairs at one strike'
   WHEN d <= 0 THEN printf('non-positive discount factor %.4f', d)
   WHEN d > 1.5 THEN printf('implausible discount factor %.4f', d)
   WHEN r2 < 0.99 THEN printf('parity fit R2 %.4f below 0.99', r2)
   WHEN f <= 0 THEN 'non-positive forward'
   WHEN abs(-ln(d)/tenor_years) > 0.25 THEN printf('implied rate %.1f%% outside +/-25%%', -ln(d)/tenor_years*100) END AS excluded FROM raw),
forwards AS (SELECT {KEY}, tenor_years, CASE WHEN excluded IS NULL THEN f END AS forward, CASE WHEN excluded IS NULL THEN d END AS discount,
   CASE WHEN excluded IS NULL THEN rate0 END AS rate, CASE WHEN tenor_years <= 0 THEN 0 ELSE n END AS n_pairs,
   CASE WHEN tenor_years > 0 AND n >= 8 AND width > 0 THEN r2 END AS r2, CASE WHEN excluded IS NULL THEN rmse END AS rmse, excluded,
   excluded IS NULL AS usable FROM why)"""
FLAGGED = f"""{FORWARDS},
attached AS (SELECT q.*, f.tenor_years, f.forward, f.discount, ln(q.strike/f.forward) AS log_moneyness,
   (q.bid + q.ask)/2.0 AS mid, q.ask - q.bid AS spread
   FROM quotes q LEFT JOIN forwards f USING (capture_utc, expiry, root)),
assessed AS (SELECT *, CASE WHEN mid > 0 THEN (ask-bid)/mid END AS rel,
   coalesce(bid <= 0, false) AS zero_bid, coalesce(ask <= 0, false) AS zero_ask, coalesce(bid > ask, false) AS crossed,
   coalesce(CASE WHEN mid > 0 THEN (ask-bid)/mid END > 0.5, true) AS wide_spread,
   coalesce(iv = 0, false) AS zero_iv, coalesce(tenor_years <= 0, false) AS expired,
   coalesce(tenor_years < 1.0/365.0, false) AS zero_dte,
   NOT coalesce(CASE WHEN option_right = 'call' THEN strike >= forward ELSE strike <= forward END, false) AS itm FROM attached),
flagged AS (SELECT *, zero_bid OR zero_ask OR crossed OR wide_spread OR expired OR zero_dte OR itm AS dropped
            FROM assessed WHERE forward IS NOT NULL),
kept AS (SELECT * FROM flagged WHERE NOT dropped)"""
FLAGS = ["zero_bid", "zero_ask", "crossed", "wide_spread", "zero_iv", "expired", "zero_dte", "itm"]
FLAG_SUMS = ", ".join(f"count(*) FILTER ({f}) AS {f}" for f in FLAGS)
SMILES = f"""
items AS (SELECT DISTINCT l_orderkey // {tape.ORDERS_PER_CAPTURE} AS cap, CAST(l_suppkey % {tape.WEEKS} AS INTEGER) AS week,
         CASE WHEN l_linenumber % 2 = 0 THEN 'SPX' ELSE 'SPXW' END AS root FROM lineitem),
market AS (SELECT *, {_MARKET} FROM items),
smiles AS (SELECT capture_utc, expiry, root, week, days/365.0::DOUBLE AS tenor_years, f0 AS forward, d0 AS discount,
  days/{tape.SMILE_DAYS}::DOUBLE*{tape.A}::DOUBLE AS a, days/{tape.SMILE_DAYS}::DOUBLE*{tape.B}::DOUBLE AS b,
  {tape.RHO}::DOUBLE AS rho, {tape.M}::DOUBLE AS m, {tape.SIGMA}::DOUBLE AS sigma FROM market)"""
_PEAK = "(SELECT max({p}) FROM (SELECT -0.5 + i*0.01::DOUBLE AS x FROM range(0, 101) t(i)))"
WIDTHS = f"""{SMILES},
shapes AS (SELECT DISTINCT week, a, b, rho, m, sigma, 1.0::DOUBLE AS one FROM smiles),
peaks AS (SELECT week, max({pdf('x', 'one')}) AS peak FROM shapes, (SELECT -0.5 + i*0.01::DOUBLE AS x FROM range(0, 101) t(i)) GROUP BY week),
tries AS (SELECT s.*, peak, j, greatest(4*sqrt({svi('0.0::DOUBLE')}), 0.25)*pow(1.5, j) AS x
          FROM shapes s JOIN peaks USING (week), range(0, 10) t(j)),
widths AS (SELECT week, least(min_by(x, j), 8.0) AS h FROM tries
           WHERE x >= 8 OR greatest(abs({pdf('x', 'one')}), abs({pdf('(-x)', 'one')})) < 1e-13*peak GROUP BY week)"""


def nodes(n: int) -> str:
    """Grid nodes of every smile, with Simpson weights from their neighbours."""
    return f"""{WIDTHS},
spots AS (SELECT s.*, h, i, 2*h/({n}-1)*i - h AS k, forward*exp(2*h/({n}-1)*i - h) AS strike
          FROM smiles s JOIN widths USING (week), range(0, {n}) t(i)),
near AS (SELECT *, lag(strike, 2) OVER o AS x_2, lag(strike) OVER o AS x_1, lead(strike) OVER o AS x1, lead(strike, 2) OVER o AS x2
         FROM spots WINDOW o AS (PARTITION BY {KEY} ORDER BY i)),
weighted AS (SELECT *, CASE WHEN i % 2 = 1 THEN (x1-x_1)/6*(x1-x_1)*(x1-x_1)/((x1-strike)*(strike-x_1)) ELSE
   coalesce((x2-strike)/6*(2-(x2-x1)/(x1-strike)), 0) + coalesce((strike-x_2)/6*(2-(x_1-x_2)/(strike-x_1)), 0) END AS sw FROM near)"""


def dense() -> str:
    return f"{nodes(2001)}, dens AS (SELECT *, {pdf('k')} AS p FROM weighted)"


def q(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"


def _moment_shape(prefix: str) -> str:
    v = f"({prefix}2-{prefix}1*{prefix}1)"
    return (
        f"{v} AS var, ({prefix}3-3*{prefix}1*{prefix}2+2*pow({prefix}1,3))/pow({v},1.5) AS skew, "
        f"({prefix}4-4*{prefix}1*{prefix}3+6*{prefix}1*{prefix}1*{prefix}2-3*pow({prefix}1,4))/({v}*{v}) AS kurt"
    )


_LOG_SUMS = ", ".join(f"sum(sw*p*pow(k,{j}))/sum(sw*p) AS l{j}" for j in range(1, 5))
_REL_SUMS = ", ".join(f"sum(sw*p*pow(strike/forward-1,{j}))/sum(sw*p) AS r{j}" for j in range(1, 5))

_CURVE = """{base},
curve AS (SELECT *, mid + CASE WHEN option_right <> 'call' THEN discount*(forward-strike) ELSE 0 END AS c,
  bid + CASE WHEN option_right <> 'call' THEN discount*(forward-strike) ELSE 0 END AS cb,
  ask + CASE WHEN option_right <> 'call' THEN discount*(forward-strike) ELSE 0 END AS ca,
  count(*) OVER (PARTITION BY capture_utc, expiry, root) AS size FROM {source} WHERE mid IS NOT NULL),
steps AS (SELECT *, lead(strike) OVER o AS k2, lead(c) OVER o AS c2, lead(cb) OVER o AS cb2, lead(ca) OVER o AS ca2,
  lead(strike, 2) OVER o AS k3, lead(c, 2) OVER o AS c3, lead(ca, 2) OVER o AS ca3 FROM curve WHERE size >= 3
  WINDOW o AS (PARTITION BY capture_utc, expiry, root ORDER BY strike, option_right, c, cb, ca)),
sloped AS (SELECT *, CASE WHEN k2 > strike THEN (c2-c)/(k2-strike) ELSE 0 END AS sl,
  CASE WHEN k3 > strike THEN (k3-k2)/(k3-strike) ELSE 0 END AS w1, CASE WHEN k3 > strike THEN (k2-strike)/(k3-strike) ELSE 0 END AS w3 FROM steps),
found AS (
  SELECT capture_utc, expiry, root, 'vertical' AS kind, printf('%.1f/%.1f', strike, k2) AS strikes, sl AS magnitude, sl AS relative,
    coalesce(cb2 - ca > 1e-9, false) AS executable FROM sloped WHERE k2 IS NOT NULL AND sl > 1e-9
  UNION ALL SELECT capture_utc, expiry, root, 'vertical', printf('%.1f/%.1f', strike, k2), -sl-discount, -sl-discount,
    coalesce(cb - ca2 - discount*(k2-strike) > 1e-9, false) FROM sloped WHERE k2 IS NOT NULL AND sl < -discount-1e-9
  UNION ALL SELECT capture_utc, expiry, root, 'butterfly', printf('%.1f/%.1f/%.1f', strike, k2, k3), c2-w1*c-w3*c3, (c2-w1*c-w3*c3)/forward,
    coalesce(w1*ca + w3*ca3 - cb2 < -1e-9, false) FROM sloped WHERE k3 IS NOT NULL AND w1*c + w3*c3 - c2 < -1e-9)"""


def curve(source: str) -> str:
    return _CURVE.format(base=FLAGGED, source=source)


_BREACH = f"SELECT {SMILE}, kind, strikes, {rnd('magnitude', 6, 'magnitude')}, {rnd('relative', 8, 'relative')}, executable FROM found"

_STAMPED = "strftime({x}, '%Y-%m-%dT%H-%M-%SZ')"
_BODIES = f"""{QUOTES},
chains AS (SELECT cap, capture_utc, count(*) AS n_all, count(*) FILTER (h % 89 = 0) AS bad,
   any_value(underlying_price) AS underlying_price FROM quotes GROUP BY cap, capture_utc),
judged AS (SELECT *, CASE WHEN cap % 7 = 3 THEN 'payload has no top-level ''timestamp'''
   WHEN cap % 7 = 6 THEN 'unparseable timestamp ''16:14:59''' WHEN cap % 7 = 5 THEN 'unusable current_price: 0.0' END AS error FROM chains)"""
_ATTEMPTS = """
attempts AS (SELECT event_id, event_type AS ticker, ts, epoch_us(ts) - epoch_us(ts) % 2400000000 AS printed,
  (epoch_us(ts) % 2400000000)/6e7 AS age, event_id % 50 = 0 AS force FROM events),
named AS (SELECT *, strftime(timezone('America/New_York', timezone('UTC', make_timestamp(printed))), '%Y-%m-%dT%H:%M:%S') AS print,
  force OR age <= 27 AS fresh FROM attempts),
held AS (SELECT *, last_value(CASE WHEN fresh THEN print END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_print FROM named),
verdicts AS (SELECT *, CASE WHEN force THEN 'forced' WHEN last_print = print THEN 'duplicate_print' WHEN NOT fresh THEN 'stale_feed'
  ELSE 'accept' END AS verdict FROM held)"""

_TRUE_MOMENTS = f"""{dense()},
lm AS (SELECT {KEY}, sum(sw*p) AS mass, {_LOG_SUMS} FROM dens GROUP BY ALL),
shape AS (SELECT *, {_moment_shape('l')} FROM lm)"""


ORACLES: dict[str, str] = {
    "forward_curve": q(FORWARDS, f"SELECT {SMILE}, {rnd('tenor_years', 10, 'tenor_years')}, {rnd('forward', 6, 'forward')}, {rnd('discount', 8, 'discount')}, {rnd('rate', 7, 'rate')}, CAST(n_pairs AS BIGINT) AS n_pairs, {rnd('r2', 8, 'r2')}, excluded, usable FROM forwards"),
    "forward_rmse": q(FORWARDS, f"SELECT {SMILE}, {rnd('rmse', 6, 'rmse')}, {rnd('r2', 9, 'r2')} FROM forwards WHERE usable"),
    "forward_summary": q(FORWARDS, f"SELECT {text('capture_utc', 'capture')}, count(*) AS n_forwards, count(*) FILTER (usable) AS n_usable, {rnd('min(r2) FILTER (usable)', 8, 'min_r2')}, {rnd('median(r2) FILTER (usable)', 8, 'median_r2')}, {rnd('min(rate)', 6, 'min_rate')}, {rnd('max(rate)', 6, 'max_rate')} FROM forwards GROUP BY capture_utc"),
    "curve_steps": q(FORWARDS, f"SELECT {SMILE}, {rnd('forward - lag(forward) OVER (PARTITION BY capture_utc, root ORDER BY tenor_years)', 5, 'step')} FROM forwards WHERE usable"),
    "tenor_by_root": q(QUOTES, f"SELECT {SMILE}, {rnd(_TENOR, 12, 'tenor_years')}, strftime(make_timestamp(epoch_us({_SETTLES})), '%Y-%m-%d %H:%M:%S') AS settles FROM (SELECT DISTINCT {KEY} FROM quotes)"),
    "log_moneyness": q(FLAGGED, f"SELECT {CONTRACT}, {rnd('log_moneyness', 9, 'log_moneyness')}, {rnd('mid', 4, 'mid')}, {rnd('spread', 4, 'spread')} FROM flagged"),
    "quality_flags": q(FLAGGED, f"SELECT {CONTRACT}, {rnd('rel', 8, 'relative_spread')}, {', '.join(FLAGS)} FROM flagged"),
    "kept_quotes": q(FLAGGED, f"SELECT {CONTRACT}, bid, ask, {rnd('log_moneyness', 9, 'log_moneyness')} FROM kept"),
    "attrition_totals": q(FLAGGED, f"""SELECT {text('capture_utc', 'capture')}, total_in, coalesce(total_kept, 0) AS total_kept, total_in - coalesce(total_kept, 0) AS total_dropped,
        {', '.join(f'coalesce({f}, 0) AS {f}' for f in FLAGS)}, total_in - coalesce(n, 0) AS no_usable_forward, {rnd('coalesce(total_kept, 0)/total_in', 9, 'kept_fraction')}
        FROM (SELECT capture_utc, count(*) AS total_in FROM quotes GROUP BY 1)
        LEFT JOIN (SELECT capture_utc, count(*) AS n, count(*) FILTER (NOT dropped) AS total_kept, {FLAG_SUMS} FROM flagged GROUP BY 1) USING (capture_utc)"""),
    "attrition_by_rule": q(FLAGGED, " UNION ALL ".join(f"SELECT {text('capture_utc', 'capture')}, '{f}' AS rule, count(*) FILTER (forward IS NOT NULL AND {f}) AS flagged FROM assessed GROUP BY capture_utc" for f in FLAGS) + f" UNION ALL SELECT {text('capture_utc', 'capture')}, 'no_usable_forward', count(*) FROM assessed WHERE forward IS NULL GROUP BY capture_utc"),
    "attrition_by_expiry": q(FLAGGED, f"SELECT {SMILE}, count(*) AS n_in, count(*) FILTER (NOT dropped) AS n_kept, {FLAG_SUMS} FROM flagged GROUP BY {KEY}"),
    "kept_without_rule": q(FLAGGED, f"SELECT {text('capture_utc', 'capture')}, count(*) FILTER (NOT dropped) AS strict, count(*) AS permissive, " + ", ".join(
        "count(*) FILTER (NOT (" + " OR ".join(g for g in FLAGS if g not in (f, "zero_iv")) + f")) AS without_{f}" for f in FLAGS if f != "zero_iv") + " FROM flagged GROUP BY capture_utc"),
    "smile_slice": q(FLAGGED, f"SELECT {CONTRACT}, row_number() OVER (PARTITION BY {KEY} ORDER BY strike, option_right) AS position FROM kept WHERE root = 'SPXW'"),
    "captures_view": q(QUOTES, f"SELECT {text('capture_utc', 'capture')}, any_value(feed_timestamp) AS feed_timestamp, {text('any_value(index_last_trade)', 'index_last_trade')}, any_value(seqno) AS seqno, any_value(underlying_ticker) AS underlying_ticker, any_value(underlying_price) AS underlying_price, count(*) AS n_options, count(DISTINCT expiry) AS n_expiries, count(DISTINCT root) AS n_roots FROM quotes GROUP BY capture_utc"),
    "root_collisions": q(QUOTES, f"SELECT {text('capture_utc', 'capture')}, expiry, count(*) AS collisions FROM (SELECT capture_utc, expiry, option_right, strike FROM quotes GROUP BY ALL HAVING count(DISTINCT root) > 1) GROUP BY capture_utc, expiry"),
    "boolean_sums": q(QUOTES, f"SELECT {text('capture_utc', 'capture')}, CAST(sum(CAST(root='SPX' AS INT)) AS BIGINT) AS spx, CAST(sum(CAST(root='SPXW' AS INT)) AS BIGINT) AS spxw, CAST(sum(CAST(iv=0 AS INT)) AS BIGINT) AS iv_sentinel, count(*) FILTER (bid IS NULL) AS no_bid FROM quotes GROUP BY capture_utc"),
    "newest_capture": q(QUOTES, f"SELECT {text('capture_utc', 'capture')}, count(*) AS n_options FROM quotes GROUP BY capture_utc ORDER BY capture_utc DESC LIMIT 5"),
    "capture_match": q(QUOTES, f"SELECT {text('max(capture_utc)', 'newest')}, {text('max(capture_utc) FILTER (contains(s, ' + chr(39) + '35-0' + chr(39) + '))', 'match')} FROM (SELECT capture_utc, {_STAMPED.format(x='capture_utc')} AS s FROM quotes)"),
    "eastern_time": q(QUOTES, f"SELECT DISTINCT {text('index_last_trade', 'utc')}, strftime(timezone('America/New_York', timezone('UTC', index_last_trade)), '%Y-%m-%dT%H:%M:%S') AS eastern FROM quotes"),
    "contract_symbols": """WITH t AS (SELECT CASE WHEN l_orderkey % 19 = 0 THEN 'spxw' WHEN l_orderkey % 23 = 0 THEN 'SP X' ELSE 'SPXW' END || '2602' || lpad(CAST(l_partkey % 35 AS VARCHAR), 2, '0')
        || CASE WHEN l_orderkey % 29 = 0 THEN 'X' WHEN l_orderkey % 2 = 0 THEN 'C' ELSE 'P' END || lpad(CAST(l_suppkey*2500+125 AS VARCHAR), CAST(greatest(8, length(CAST(l_suppkey*2500+125 AS VARCHAR))) AS INTEGER), '0') AS s FROM lineitem),
        c AS (SELECT replace(s, ' ', '') AS s FROM t),
        p AS (SELECT s, regexp_extract(s, '^([A-Z]+)(\\d{6})([CP])(\\d{8})$', 1) AS root, try_cast('20' || substr(regexp_extract(s, '(\\d{6})[CP]', 1), 1, 2) || '-' || substr(regexp_extract(s, '(\\d{6})[CP]', 1), 3, 2) || '-' || substr(regexp_extract(s, '(\\d{6})[CP]', 1), 5, 2) AS DATE) AS d,
              regexp_extract(s, '([CP])\\d{8}$', 1) AS r, try_cast(right(s, 8) AS BIGINT)/1000.0::DOUBLE AS k FROM c),
        ok AS (SELECT *, root <> '' AND d IS NOT NULL AS good FROM p)
        SELECT CASE WHEN good THEN root END AS root, CASE WHEN good THEN CASE WHEN r = 'C' THEN 'call' ELSE 'put' END END AS option_right, CASE WHEN good THEN d END AS expiry, CASE WHEN good THEN k END AS strike, count(*) AS n FROM ok GROUP BY 1, 2, 3, 4""",
    "capture_names": f"""WITH t AS (SELECT o_orderkey AS id, {_STAMPED.format(x=f'make_timestamp(({tape.EPOCH} + {tape.CAPTURE_SECONDS}*o_orderkey)*1000000)')} AS s, make_timestamp(({tape.EPOCH} + {tape.CAPTURE_SECONDS}*o_orderkey)*1000000) AS ts FROM orders)
        SELECT id, CASE WHEN good THEN ticker END AS ticker, CASE WHEN good THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS capture, CASE WHEN good THEN id % 2 = 0 END AS compressed, CASE WHEN good THEN ticker || '_' || s END AS stem
        FROM (SELECT *, id % 11 <> 0 AND id % 13 <> 0 AND id % 17 <> 0 AS good, CASE WHEN id % 2 = 0 THEN '_SPX' ELSE 'SPY' END AS ticker FROM t)""",
    "payload_rows": q(QUOTES, f"SELECT {CONTRACT}, option_symbol, feed_timestamp, {text('index_last_trade', 'index_last_trade')}, seqno, underlying_ticker, underlying_price, bid, ask, {rnd('iv', 9, 'iv')}, {rnd('theo', 4, 'theo')}, open_interest, volume, CASE WHEN h % 2 = 0 THEN 'up' END AS tick, CAST(NULL AS DOUBLE) AS gamma FROM quotes WHERE h % 89 <> 0 AND cap % 7 NOT IN (3, 5, 6)"),
    "payload_errors": q(_BODIES, f"SELECT {text('capture_utc', 'capture')}, '_SPX_' || {_STAMPED.format(x='capture_utc')} AS stem, CASE WHEN error IS NULL THEN n_all - bad END AS rows, CASE WHEN error IS NULL THEN bad END AS unparsed, error FROM judged"),
    "backfill_totals": q(_BODIES, "SELECT count(*) FILTER (error IS NULL) AS written, CAST(0 AS BIGINT) AS skipped, count(*) FILTER (error IS NOT NULL) AS failed, CAST(sum(n_all - bad) FILTER (error IS NULL) AS BIGINT) AS rows, CAST(sum(bad) FILTER (error IS NULL) AS BIGINT) AS unparsed FROM judged"),
    "capture_meta": q(_BODIES, f"SELECT {text('capture_utc', 'capture')}, '_SPX' AS ticker, 1000000 + cap AS seqno, underlying_price AS spot, underlying_price - 1.0 AS prev_day_close, CAST(NULL AS DOUBLE) AS iv30 FROM judged WHERE error IS NULL"),
    "body_screening": q(_BODIES, f"SELECT {text('capture_utc', 'capture')}, CASE WHEN error IS NULL THEN 'accept' END AS verdict, CASE WHEN error IS NULL THEN 15.0::DOUBLE END AS age_minutes, n_all AS n_options, error FROM judged"),
    "freshness_verdicts": q(_ATTEMPTS, f"SELECT event_id, ticker, print, last_print, {rnd('age', 4, 'age_minutes')}, verdict FROM verdicts"),
    "verdict_counts": q(_ATTEMPTS, "SELECT ticker, verdict, count(*) AS n FROM verdicts GROUP BY ticker, verdict"),
    "health_record": """WITH o AS (SELECT event_type AS ticker, ts, event_id, event_id % 9 AS kind FROM events WHERE event_id % 9 <> 8),
        r AS (SELECT *, kind IN (4, 5) AS bad, kind < 3 AS written, CASE WHEN kind IN (4, 5) THEN 'FeedError' WHEN kind < 3 THEN 'accept' ELSE 'duplicate_print' END AS verdict,
              row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, event_id DESC) AS back FROM o),
        b AS (SELECT ticker, min(back) AS good FROM r WHERE NOT bad GROUP BY ticker)
        SELECT ticker, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_attempt, strftime(max(ts) FILTER (NOT bad), '%Y-%m-%d %H:%M:%S') AS last_ok, strftime(max(ts) FILTER (written), '%Y-%m-%d %H:%M:%S') AS last_write,
          max(verdict) FILTER (back = 1) AS last_verdict, max(CASE WHEN bad THEN 'attempt ' || event_id END) FILTER (back = 1) AS last_error,
          count(*) FILTER (bad AND (good IS NULL OR back < good)) AS consecutive_failures, count(*) FILTER (NOT bad AND written) AS total_writes, count(*) FILTER (NOT bad AND NOT written) AS total_skips, count(*) FILTER (bad) AS total_failures
        FROM r LEFT JOIN b USING (ticker) GROUP BY ticker""",
    "duplicate_captures": q(_ATTEMPTS, "SELECT event_id, ticker, strftime(f, '%Y-%m-%d %H:%M:%S') AS duplicate_of FROM (SELECT *, min(ts) OVER (PARTITION BY ticker, printed) AS f, row_number() OVER (PARTITION BY ticker, printed ORDER BY ts, event_id) AS place FROM attempts) WHERE place > 1"),
    "layer_divergence": f"""WITH raw AS (SELECT DISTINCT '_SPX_' || {_STAMPED.format(x=f'make_timestamp(({tape.EPOCH} + {tape.CAPTURE_SECONDS}*(o_orderkey // 10))*1000000)')} AS stem FROM orders),
        made AS (SELECT DISTINCT '_SPX_' || {_STAMPED.format(x=f'make_timestamp(({tape.EPOCH} + {tape.CAPTURE_SECONDS}*(l_partkey * 5))*1000000)')} AS stem FROM lineitem)
        SELECT stem, 'missing_curated' AS side FROM (SELECT stem FROM raw EXCEPT SELECT stem FROM made) UNION ALL SELECT stem, 'orphan_curated' FROM (SELECT stem FROM made EXCEPT SELECT stem FROM raw)""",
    "manifest_check": """SELECT 'doc_' || doc_id || '.txt' AS name, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 13 = 0 THEN 'unlisted' WHEN doc_id % 17 = 0 THEN 'corrupted' ELSE 'ok' END AS status
        FROM documents""",
    "price_arbitrage": q(curve("kept"), _BREACH),
    "price_arbitrage_unfiltered": q(curve("flagged"), _BREACH),
    "price_arbitrage_on_mids": q(curve("flagged"), _BREACH.replace(" executable ", " kind = 'butterfly' AS executable ")).replace("option_right, c, cb, ca)", "option_right, c)"),
    "calendar_arbitrage": q(f"""{QUOTES},
        knots AS (SELECT {KEY}, k0 AS k, avg(w0*(1+(h % 11 - 5)/50.0)) AS w, min(days/365.0) AS tenor FROM quotes GROUP BY capture_utc, expiry, root, k0),
        curves AS (SELECT {KEY}, min(k) AS lo, max(k) AS hi, min(tenor) AS tenor FROM knots GROUP BY ALL HAVING count(*) >= 4),
        pairs AS (SELECT *, lead(expiry) OVER o AS far, lead(lo) OVER o AS lo2, lead(hi) OVER o AS hi2 FROM curves WINDOW o AS (PARTITION BY capture_utc, root ORDER BY tenor)),
        shared AS (SELECT capture_utc, root, expiry AS near, far, i, CASE WHEN i = 40 THEN least(hi, hi2) ELSE greatest(lo, lo2) + i*((least(hi, hi2)-greatest(lo, lo2))/40) END AS g
                 FROM pairs, range(0, 41) t(i) WHERE far IS NOT NULL AND least(hi, hi2) > greatest(lo, lo2)),
        pieces AS (SELECT *, lead(k) OVER o AS k2, lead(w) OVER o AS w2, lead(k, 2) OVER o IS NULL AS final FROM knots WINDOW o AS (PARTITION BY {KEY} ORDER BY k)),
        a AS (SELECT g.*, p.w + (g - k)/(k2 - k)*(w2 - w) AS wa FROM shared g JOIN pieces p ON p.capture_utc = g.capture_utc AND p.root = g.root AND p.expiry = g.near AND k2 IS NOT NULL AND g >= k AND (g < k2 OR (final AND g = k2))),
        ab AS (SELECT a.*, p.w + (g - k)/(k2 - k)*(w2 - w) AS wb FROM a JOIN pieces p ON p.capture_utc = a.capture_utc AND p.root = a.root AND p.expiry = a.far AND k2 IS NOT NULL AND g >= k AND (g < k2 OR (final AND g = k2))),
        worst AS (SELECT *, row_number() OVER (PARTITION BY capture_utc, root, near ORDER BY wa - wb DESC, i) AS r FROM ab)""",
        f"SELECT {text('capture_utc', 'capture')}, far AS expiry, root, 'calendar' AS kind, {rnd('g', 8, 'at')}, {rnd('wa - wb', 9, 'magnitude')}, {rnd('(wa - wb)/greatest(wa, 1e-12)', 7, 'relative')}, false AS executable FROM worst WHERE r = 1 AND wa - wb > 1e-6"),
    "arbitrage_report": q(f"""{curve('kept')},
        sizes AS (SELECT capture_utc, count(*) AS n FROM kept WHERE mid IS NOT NULL GROUP BY {KEY}),
        checks AS (SELECT capture_utc, 'vertical' AS kind, sum(CASE WHEN n >= 3 THEN n - 1 ELSE 0 END) AS n_checked FROM sizes GROUP BY 1 UNION ALL SELECT capture_utc, 'butterfly', sum(CASE WHEN n >= 3 THEN n - 2 ELSE 0 END) FROM sizes GROUP BY 1),
        tally AS (SELECT capture_utc, kind, count(*) AS on_mids, count(*) FILTER (executable) AS exe, max(relative) FILTER (executable) AS worst FROM found GROUP BY 1, 2)""",
        f"SELECT {text('capture_utc', 'capture')}, kind, CAST(n_checked AS BIGINT) AS n_checked, coalesce(on_mids, 0) AS on_mids, coalesce(exe, 0) AS executable, {rnd('coalesce(worst, 0)', 8, 'worst_rel')} FROM checks LEFT JOIN tally USING (capture_utc, kind)"),
    "worst_breach": q(curve("kept"), f"SELECT {text('capture_utc', 'capture')}, kind, {rnd('max(relative)', 8, 'relative')} FROM found GROUP BY capture_utc, kind"),
    "model_prices": q(MODEL, f"SELECT {CONTRACT}, {rnd('model', 6, 'price')} FROM model"),
    "put_call_parity": q(MODEL, f"SELECT {CONTRACT}, {rnd('d0*(f0-strike)', 7, 'gap')} FROM model"),
    "model_vega": q(MODEL, f"SELECT {CONTRACT}, {rnd('d0*f0*exp(-0.5*d1*d1)/sqrt(2*pi())', 6, 'per_total_vol')}, {rnd('d0*f0*exp(-0.5*d1*d1)/sqrt(2*pi())*sqrt(days/365.0)', 6, 'per_vol')} FROM model"),
    "price_bounds": q(MODEL, f"SELECT {CONTRACT}, {rnd('d0*greatest(side*(f0-strike), 0)', 6, 'low')}, {rnd('''d0*CASE WHEN option_right = 'call' THEN f0 ELSE strike END''', 6, 'high')} FROM model"),
    "implied_vols": q(MODEL, f"SELECT {CONTRACT}, {rnd('(sqrt(w0) + 0.05)/sqrt(days/365.0)', 6, 'implied_vol')} FROM model"),
    "unpriceable": q(MODEL, f"SELECT {text('capture_utc', 'capture')}, count(*) AS n, CAST(0 AS BIGINT) AS inverted FROM model GROUP BY capture_utc"),
    "smile_surface": q(SMILES, f"SELECT {SMILE}, k, {rnd(svi('k'), 12, 'w')}, {rnd('sqrt(' + svi('k') + '/tenor_years)', 10, 'vol')}, {rnd(slope('k'), 12, 'dw')}, {rnd(bend('k'), 10, 'd2w')}, {rnd(durrleman('k'), 8, 'g')}, {rnd('a + b*sigma*sqrt(1-rho*rho)', 12, 'w_min')} FROM smiles, (SELECT i/10.0::DOUBLE AS k FROM range(-5, 6) t(i))"),
    "durrleman_minimum": q(SMILES, f"SELECT {SMILE}, {rnd('min(' + durrleman('k') + ')', 8, 'g_min')} FROM smiles, (SELECT -3.0 + 6.0::DOUBLE/399*i AS k FROM range(0, 400) t(i)) GROUP BY {KEY}"),
    "density_nodes": q(dense(), f"SELECT {SMILE}, i // 200 AS part, {rnd('sum(p*forward)', 6, 'total')}, {rnd('max(p*forward)', 6, 'peak')} FROM dens GROUP BY {KEY}, i // 200"),
    "density_diagnostics": q(dense(), f"SELECT {SMILE}, {rnd('sum(sw*p)', 8, 'total_mass')}, {rnd('sum(sw*p*strike)', 4, 'implied_forward')}, {rnd('max(p)', 9, 'max_pdf')}, min(p) >= -1e-10 AND abs(sum(sw*p) - 1) < 1e-3 AS is_proper FROM dens GROUP BY {KEY}"),
    "density_by_differences": q(f"""{nodes(2001)},
        vv AS (SELECT *, sqrt(greatest({svi('k')}, 1e-14)) AS v FROM weighted),
        calls AS (SELECT *, discount*(forward*{cdf('-k/v + v/2')} - strike*{cdf('-k/v - v/2')}) AS c FROM vv),
        diffs AS (SELECT *, 2*((lead(c) OVER o - c)/(x1-strike) - (c - lag(c) OVER o)/(strike-x_1))/(x1-x_1)/discount AS q FROM calls WINDOW o AS (PARTITION BY {KEY} ORDER BY i)),
        filled AS (SELECT *, CASE WHEN i = 0 THEN lead(q) OVER o WHEN i = 2000 THEN lag(q) OVER o ELSE q END AS p FROM diffs WINDOW o AS (PARTITION BY {KEY} ORDER BY i))""",
        f"SELECT {SMILE}, {rnd('sum(sw*p)', 5, 'total_mass')}, {rnd('sum(sw*p*strike)', 1, 'implied_forward')} FROM filled GROUP BY {KEY}"),
    "density_quantiles": q(f"""{dense()},
        area AS (SELECT *, coalesce((p + lag(p) OVER o)/2*(strike - x_1), 0) AS da FROM dens WINDOW o AS (PARTITION BY {KEY} ORDER BY i)),
        cum AS (SELECT *, sum(da) OVER (PARTITION BY {KEY} ORDER BY i ROWS UNBOUNDED PRECEDING) / sum(da) OVER (PARTITION BY {KEY}) AS c FROM area),
        seg AS (SELECT *, lag(c) OVER (PARTITION BY {KEY} ORDER BY i) AS c0 FROM cum),
        hit AS (SELECT s.*, u.p AS level FROM seg s, (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS p) u WHERE c >= u.p AND c0 < u.p)""",
        f"SELECT {SMILE}, level AS p, {rnd('min_by(x_1 + (level - c0)/(c - c0)*(strike - x_1), i)', 4, 'strike')} FROM hit GROUP BY {KEY}, level"),
    "second_moment": q(dense(), f"SELECT {SMILE}, {rnd('sum(sw*p*strike*strike)/1e6', 6, 'moment')} FROM dens GROUP BY {KEY}"),
    "density_moments": q(f"""{dense()},
        sums AS (SELECT {KEY}, any_value(forward) AS forward, {_LOG_SUMS}, {_REL_SUMS} FROM dens GROUP BY ALL),
        ls AS (SELECT *, {_moment_shape('l')} FROM sums), rs AS (SELECT {KEY}, {_moment_shape('r')} FROM sums)""",
        f"SELECT {SMILE}, {rnd('l1', 9, 'bl_mean')}, {rnd('ls.var', 10, 'bl_variance')}, {rnd('ls.skew', 6, 'bl_skewness')}, {rnd('ls.kurt', 5, 'bl_kurtosis')}, {rnd('forward*(1+r1)', 4, 'px_mean')}, {rnd('forward*forward*rs.var', 1, 'px_variance')}, {rnd('rs.skew', 5, 'px_skewness')}, {rnd('rs.kurt', 4, 'px_kurtosis')} FROM ls JOIN rs USING ({KEY})"),
    "spanning_moments": q(f"""{nodes(4001)},
        vv AS (SELECT *, sqrt(greatest({svi('k')}, 1e-14)) AS v, CASE WHEN k >= 0 THEN 1.0 ELSE -1.0 END AS side FROM weighted),
        o AS (SELECT *, sw/(strike*strike)*side*(forward*{cdf('side*(-k/v + v/2)')} - strike*{cdf('side*(-k/v - v/2)')}) AS o FROM vv),
        sums AS (SELECT {KEY}, -sum(o) AS l1, sum(2*(1-k)*o) AS l2, sum((6*k-3*k*k)*o) AS l3, sum((12*k*k-4*k*k*k)*o) AS l4 FROM o GROUP BY ALL),
        s AS (SELECT *, {_moment_shape('l')} FROM sums)""",
        f"SELECT {SMILE}, {rnd('var', 9, 'bkm_variance')}, {rnd('skew', 5, 'bkm_skewness')}, {rnd('kurt', 4, 'bkm_kurtosis')} FROM s"),
    "moment_agreement": q(SMILES, f"SELECT {SMILE}, true AS agrees FROM smiles"),
    "smile_fits": q(f"""{MODEL}, sizes AS (SELECT {KEY}, any_value(scale) AS scale, count(*) FILTER (NOT (week = 7 AND root = 'SPX' AND slot % 10 <> 0)) AS n, CASE WHEN count(*) FILTER (NOT (week = 7 AND root = 'SPX' AND slot % 10 <> 0)) < 8 THEN printf('only %d usable quotes, need 8', count(*) FILTER (NOT (week = 7 AND root = 'SPX' AND slot % 10 <> 0))) END AS excluded FROM model GROUP BY {KEY})""",
        f"SELECT {SMILE}, k, n AS n_quotes, {rnd(f'CASE WHEN excluded IS NULL THEN {tape.A} + {tape.B}*({tape.RHO}*(k-{tape.M}) + sqrt((k-{tape.M})*(k-{tape.M})+{tape.SIGMA ** 2!r})) END', 6, 'w')}, excluded FROM sizes, (SELECT unnest([-8, -4, 0, 4, 8])/100.0::DOUBLE AS k)"),
    "known_smile_estimates": q(f"""{_TRUE_MOMENTS},
        {MODEL.replace('items AS', 'its AS').replace('FROM items', 'FROM its').strip()},
        sizes AS (SELECT {KEY}, any_value(days) AS days, count(*) FILTER (NOT (week = 7 AND root = 'SPX' AND slot % 10 <> 0)) AS n, CASE WHEN count(*) FILTER (NOT (week = 7 AND root = 'SPX' AND slot % 10 <> 0)) < 8 THEN printf('only %d usable quotes, need 8', count(*) FILTER (NOT (week = 7 AND root = 'SPX' AND slot % 10 <> 0))) END AS excluded FROM model GROUP BY {KEY})""",
        f"""SELECT {text('z.capture_utc', 'capture')}, z.expiry, z.root, n AS n_quotes, {rnd('days', 4, 'days')}, {rnd('CASE WHEN excluded IS NULL THEN mass END', 5, 'mass')},
        {rnd('CASE WHEN excluded IS NULL THEN sqrt(var/(days/365.0)) END', 5, 'annualised_vol')}, {rnd('CASE WHEN excluded IS NULL THEN skew END', 3, 'skewness')}, {rnd('CASE WHEN excluded IS NULL THEN kurt END', 2, 'kurtosis')},
        excluded IS NULL AS trustworthy, '' AS failures, excluded FROM sizes z JOIN shape s ON s.capture_utc = z.capture_utc AND s.expiry = z.expiry AND s.root = z.root"""),
    "estimate_verdicts": q(FLAGGED, f"SELECT {SMILE}, count(*) AS n_quotes, count(*) >= 8 AS trustworthy, '' AS failures, CASE WHEN count(*) < 8 THEN printf('only %d usable quotes, need 8', count(*)) END AS excluded FROM kept GROUP BY {KEY}"),
}


# --- files, streams, subsets ---------------------------------------------------

_STEM = f"'_SPX_' || {_STAMPED.format(x='capture_utc')}"
_GOOD = "h % 89 <> 0 AND cap % 7 NOT IN (3, 5, 6)"
ORACLES |= {
    "archive_bodies": q(_BODIES, f"SELECT {_STEM} AS stem, {text('capture_utc', 'capture')}, '_SPX' AS ticker, error, n_all AS n_options FROM judged"),
    "archive_names": q(_BODIES, f"SELECT '_SPX' AS ticker, {text('capture_utc', 'capture')}, true AS compressed, {_STEM} AS stem, {_STEM} || '.json.gz' AS name, true AS filled FROM judged"),
    "manifest_on_disk": q(_BODIES, f"""SELECT unnest(CASE WHEN s % 11 = 0 THEN [name] WHEN s % 13 = 0 THEN [name, 'new_' || name] ELSE [name] END) AS name,
        unnest(CASE WHEN s % 11 = 0 THEN ['missing'] WHEN s % 13 = 0 THEN ['missing', 'unlisted'] WHEN s % 17 = 0 THEN ['corrupted'] ELSE ['ok'] END) AS status
        FROM (SELECT {_STEM} || '.json.gz' AS name, epoch_us(capture_utc) // 1000000 AS s FROM judged)"""),
    "gzip_archive": q(_BODIES, f"SELECT {_STEM} AS stem, false AS skipped, true AS smaller, n_all AS n_options, count(*) OVER () AS plain_before FROM judged"),
    "curated_captures": q(QUOTES, f"SELECT {text('capture_utc', 'capture')}, any_value(feed_timestamp) AS feed_timestamp, {text('any_value(index_last_trade)', 'index_last_trade')}, any_value(seqno) AS seqno, any_value(underlying_ticker) AS underlying_ticker, any_value(underlying_price) AS underlying_price, count(*) AS n_options, count(DISTINCT expiry) AS n_expiries, count(DISTINCT root) AS n_roots FROM quotes WHERE {_GOOD} GROUP BY capture_utc"),
    "curated_quotes": q(QUOTES, f"SELECT {SMILE}, count(*) AS n, sum(strike) AS strikes, count(bid) AS bids, {rnd('sum(ask)', 4, 'asks')}, count(*) FILTER (h % 2 = 0) AS ups FROM quotes WHERE {_GOOD} GROUP BY {KEY}"),
    "backfill_resumed": q(_BODIES, f"SELECT {_STEM} AS stem, CASE WHEN error IS NULL THEN 'skipped' ELSE 'failed' END AS status, CASE WHEN error IS NULL THEN n_all - bad ELSE 0 END AS rows, CASE WHEN error IS NULL THEN bad ELSE 0 END AS unparsed, error FROM judged"),
    "curated_divergence": q(_BODIES, f"SELECT {_STEM} AS stem, 'missing_curated' AS side FROM judged WHERE error IS NOT NULL"),
    "stream_verdicts": ORACLES["freshness_verdicts"],
    "stream_bodies": q(_BODIES, f"""SELECT {text('capture_utc', 'capture')}, CASE WHEN error IS NULL THEN 'accept' END AS verdict, CASE WHEN error IS NULL THEN 15.0::DOUBLE END AS age_minutes, n_all AS n_options, error,
        CASE WHEN error IS NULL THEN 'new data: index last printed ' || strftime(timezone('America/New_York', timezone('UTC', capture_utc - INTERVAL 15 MINUTE)), '%Y-%m-%dT%H:%M:%S') || ' ET (15.0 min ago), spot ' || underlying_price::DOUBLE || ', ' || n_all || ' options' END AS detail FROM judged"""),
    "health_ages": """WITH r AS (SELECT event_type AS ticker, ts, event_id % 9 AS kind FROM events WHERE event_id % 9 <> 8),
        c AS (SELECT ticker, max(ts) AS a, max(ts) FILTER (kind NOT IN (4, 5)) AS o, max(ts) FILTER (kind < 3) AS w FROM r GROUP BY ticker)
        SELECT ticker, (epoch_us(TIMESTAMP '2030-01-01') - epoch_us(a)) // 60000000 * 60 AS attempt_age, (epoch_us(TIMESTAMP '2030-01-01') - epoch_us(o)) // 60000000 * 60 AS ok_age,
          (epoch_us(TIMESTAMP '2030-01-01') - epoch_us(w)) // 60000000 * 60 AS write_age, w IS NULL OR TIMESTAMP '2030-01-01' - w > INTERVAL 1 DAY AS late FROM c""",
}
_REASONS = [  # name, condition, order, how many
    ("0-DTE, within 2% of spot", "week = 0 AND abs(strike - spot)/spot <= 0.02", "option_symbol", None),
    ("root collision, near spot", "n_roots = 2 AND week = 1 AND abs(strike - spot)/spot <= 0.03", "option_symbol", None),
    ("deep ITM, degenerate IV", "strike < spot*0.92", "option_symbol", 8),
    ("zero-IV sentinel with a live quote, near spot", "iv = 0 AND bid > 0 AND abs(strike - spot)/spot <= 0.10", "option_symbol", 20),
    ("zero bid", "bid = 0", "option_symbol", 12),
    ("stale last trade", "traded < '2026-01'", "traded, option_symbol", 8),
    ("relative spread > 50%", "bid > 0 AND ask > 0 AND (ask - bid)/((ask + bid)/2) > 0.5", "option_symbol", 10),
    ("monthly, liquid, near the money", "week = 5 AND abs(strike - spot)/spot <= 0.05 AND bid > 0 AND iv <> 0", "option_symbol", 120),
]
_SUBSET = f"""{QUOTES},
chain AS (SELECT *, underlying_price AS spot, CASE WHEN h % 17 = 0 THEN '2025-' || lpad(CAST(h % 12 + 1 AS VARCHAR), 2, '0') || '-15T10:00:00' WHEN h % 5 <> 0 THEN '2026-08-10T15:59:00' END AS traded,
  count(*) OVER (PARTITION BY capture_utc, expiry, option_right, strike) AS n_roots FROM quotes),
picks AS ({' UNION ALL '.join(
    f"SELECT capture_utc, option_symbol, {k} AS no FROM (SELECT *, row_number() OVER (PARTITION BY capture_utc ORDER BY {order}) AS place FROM chain WHERE {where})" + (f" WHERE place <= {limit}" if limit else "")
    for k, (_, where, order, limit) in enumerate(_REASONS))}),
chosen AS (SELECT capture_utc, option_symbol, min(no) AS no FROM picks GROUP BY ALL),
why AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{name}')" for k, (name, *_) in enumerate(_REASONS))}) v(no, reason))"""
ORACLES["subset_by_reason"] = q(_SUBSET, f"SELECT {text('capture_utc', 'capture')}, option_symbol, no::BIGINT AS reason_no, reason FROM chosen JOIN why USING (no)")
ORACLES["subset_tally"] = q(_SUBSET, f"SELECT {text('capture_utc', 'capture')}, reason, count(*) AS n FROM chosen JOIN why USING (no) GROUP BY ALL")


# --- estimates end to end --------------------------------------------------------

# Total volatility by bisection, out of the money: the lower end moves up by halves of the range while the price there is too low.
_LOW_VOL, _TOP_VOL = 1e-8, 5.0
_HALVES = "[" + ", ".join([repr(_LOW_VOL), *(repr((_TOP_VOL - _LOW_VOL) / 2**k) for k in range(1, 61))]) + "]"


def _unit_price(v: str) -> str:
    near = f"(side*(ln(forward/strike)/({v}) + ({v})/2))"
    return f"side*(forward*{cdf(near)} - strike*{cdf(f'({near} - side*({v}))')})"


PREPARED = f"""{FLAGGED},
sided AS (SELECT *, CASE WHEN option_right = 'call' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS side, mid/discount AS target FROM kept),
bounded AS (SELECT *, mid > discount*greatest(side*(forward - strike), 0) + 1e-12 AND mid < discount*CASE WHEN side > 0 THEN forward ELSE strike END - 1e-12
   AND target <= {_unit_price(repr(_TOP_VOL))} AS solvable FROM sided),
inverted AS (SELECT *, CASE WHEN solvable THEN list_reduce({_HALVES}, lambda low_end, half: CASE WHEN {_unit_price('(low_end + half)')} < target THEN low_end + half ELSE low_end END) END AS v FROM bounded),
prepared AS (SELECT *, v/sqrt(tenor_years) AS implied_vol, v*v AS total_variance FROM inverted)"""
_CALENDAR = f"""
knots AS (SELECT {KEY}, log_moneyness AS k, avg(total_variance) AS w, min(tenor_years) AS tenor FROM prepared WHERE total_variance > 0 GROUP BY ALL),
curves AS (SELECT {KEY}, min(k) AS lo, max(k) AS hi, min(tenor) AS tenor FROM knots GROUP BY ALL HAVING count(*) >= 4),
neighbours AS (SELECT *, lead(expiry) OVER o AS far, lead(lo) OVER o AS lo2, lead(hi) OVER o AS hi2 FROM curves WINDOW o AS (PARTITION BY capture_utc, root ORDER BY tenor)),
shared AS (SELECT capture_utc, root, expiry AS near, far, i, CASE WHEN i = 40 THEN least(hi, hi2) ELSE greatest(lo, lo2) + i*((least(hi, hi2)-greatest(lo, lo2))/40) END AS g
   FROM neighbours, range(0, 41) t(i) WHERE far IS NOT NULL AND least(hi, hi2) > greatest(lo, lo2)),
pieces AS (SELECT *, lead(k) OVER o AS k2, lead(w) OVER o AS w2, lead(k, 2) OVER o IS NULL AS final FROM knots WINDOW o AS (PARTITION BY {KEY} ORDER BY k)),
near_side AS (SELECT g.*, p.w + (g - k)/(k2 - k)*(w2 - w) AS wa FROM shared g JOIN pieces p ON p.capture_utc = g.capture_utc AND p.root = g.root AND p.expiry = g.near AND k2 IS NOT NULL AND g >= k AND (g < k2 OR (final AND g = k2))),
both_sides AS (SELECT a.*, p.w + (g - k)/(k2 - k)*(w2 - w) AS wb FROM near_side a JOIN pieces p ON p.capture_utc = a.capture_utc AND p.root = a.root AND p.expiry = a.far AND k2 IS NOT NULL AND g >= k AND (g < k2 OR (final AND g = k2))),
drops AS (SELECT capture_utc, root, near FROM both_sides GROUP BY ALL HAVING max(wa - wb) > 1e-6)"""
ORACLES |= {
    "inverted_quotes": q(PREPARED, f"SELECT {CONTRACT}, {rnd('implied_vol', 6, 'implied_vol')}, {rnd('total_variance', 8, 'total_variance')}, {rnd('discount*forward*exp(-0.5*pow(ln(forward/strike)/v + v/2, 2))/sqrt(2*pi())', 3, 'vega')} FROM prepared"),
    "full_arbitrage_report": q(f"""{PREPARED},{curve('kept').removeprefix(FLAGGED).lstrip(',')},{_CALENDAR},
        sizes AS (SELECT capture_utc, count(*) AS n FROM kept WHERE mid IS NOT NULL GROUP BY {KEY}),
        checks AS (SELECT capture_utc, 'vertical' AS kind, sum(CASE WHEN n >= 3 THEN n - 1 ELSE 0 END) AS n_checked FROM sizes GROUP BY 1
           UNION ALL SELECT capture_utc, 'butterfly', sum(CASE WHEN n >= 3 THEN n - 2 ELSE 0 END) FROM sizes GROUP BY 1
           UNION ALL SELECT capture_utc, 'calendar', count(*) FROM (SELECT DISTINCT {KEY} FROM kept) GROUP BY 1),
        tally AS (SELECT capture_utc, kind, count(*) AS on_mids, count(*) FILTER (executable) AS exe, max(relative) FILTER (executable) AS worst FROM found GROUP BY 1, 2
           UNION ALL SELECT capture_utc, 'calendar', count(*), 0, NULL FROM drops GROUP BY 1)""",
        f"SELECT {text('capture_utc', 'capture')}, kind, CAST(n_checked AS BIGINT) AS n_checked, coalesce(on_mids, 0) AS on_mids, coalesce(exe, 0) AS executable, {rnd('coalesce(worst, 0)', 8, 'worst_rel')} FROM checks LEFT JOIN tally USING (capture_utc, kind)"),
    "estimate_counts": q(f"""{PREPARED}, smile_sizes AS (SELECT {KEY}, count(*) AS n, count(*) FILTER (total_variance > 0) AS solved FROM prepared WHERE total_variance IS NOT NULL GROUP BY ALL),
        smiles_all AS (SELECT {KEY}, coalesce(n, 0) AS n FROM (SELECT DISTINCT {KEY} FROM kept) LEFT JOIN smile_sizes USING (capture_utc, expiry, root))""",
        f"SELECT {text('capture_utc', 'capture')}, count(*) AS n_smiles, count(*) FILTER (n >= 8) AS n_trustworthy, count(*) FILTER (n < 8) AS n_excluded, coalesce(string_agg(CASE WHEN n < 8 THEN 'only ' || n || ' usable quotes, need 8' END, '; ' ORDER BY n), '') AS reasons FROM smiles_all GROUP BY capture_utc"),
}


# --- what results say about themselves ---------------------------------------------

_DOUBTFUL = dense().replace(f"{tape.B}::DOUBLE AS b", f"{tape.B}::DOUBLE*(CASE week WHEN 4 THEN 2.0 WHEN 5 THEN 31.0 ELSE 1.0 END)::DOUBLE AS b").replace(
    f"{tape.SIGMA}::DOUBLE AS sigma", f"(CASE WHEN week = 4 THEN 0.004 ELSE {tape.SIGMA} END)::DOUBLE AS sigma"
)
_VALUE = "(w1*c + w3*c3 - c2)"
ORACLES |= {
    "violation_details": q(f"""{curve('kept')},
        told AS (SELECT *, 'vertical' AS kind, printf('%.1f/%.1f', strike, k2) AS strikes, printf('call price rises with strike: dC/dK = %+.6f > 0', sl) AS detail FROM sloped WHERE k2 IS NOT NULL AND sl > 1e-9
          UNION ALL SELECT *, 'vertical', printf('%.1f/%.1f', strike, k2), printf('call spread cheaper than its worst case: dC/dK = %.6f < -D = %.6f', sl, -discount) FROM sloped WHERE k2 IS NOT NULL AND sl < -discount-1e-9
          UNION ALL SELECT *, 'butterfly', printf('%.1f/%.1f/%.1f', strike, k2, k3), printf('butterfly value %.6e on mids, %.6e at the quoted bid-ask -- negative density between %.0f and %.0f', {_VALUE}, w1*ca + w3*ca3 - cb2, strike, k3)
          FROM sloped WHERE k3 IS NOT NULL AND {_VALUE} < -1e-9)""",
        f"SELECT {SMILE}, kind, strikes, detail FROM told"),
    "moment_differences": q(f"""{nodes(4001)},
        vv AS (SELECT *, sqrt(greatest({svi('k')}, 1e-14)) AS v, CASE WHEN k >= 0 THEN 1.0 ELSE -1.0 END AS side FROM weighted),
        o AS (SELECT *, sw/(strike*strike)*side*(forward*{cdf('side*(-k/v + v/2)')} - strike*{cdf('side*(-k/v - v/2)')}) AS o FROM vv),
        sums AS (SELECT {KEY}, -sum(o) AS l1, sum(2*(1-k)*o) AS l2, sum((6*k-3*k*k)*o) AS l3, sum((12*k*k-4*k*k*k)*o) AS l4 FROM o GROUP BY ALL),
        s AS (SELECT *, {_moment_shape('l')} FROM sums),
        dens AS (SELECT *, {pdf('k')} AS p FROM weighted),
        means AS (SELECT {KEY}, any_value(forward) AS forward, {_REL_SUMS} FROM dens GROUP BY ALL),
        r AS (SELECT *, {_moment_shape('r')} FROM means),
        both_routes AS (SELECT r.capture_utc, r.expiry, r.root, forward*(1+r1) AS m1, forward AS m2, forward*forward*r.var AS v1, s.var AS v2, r.skew AS s1, s.skew AS s2, r.kurt AS k1, s.kurt AS k2 FROM r JOIN s USING ({KEY}))""",
        f"SELECT {SMILE}, " + ", ".join(rnd(f"({x}1 - {x}2)/greatest(abs({x}1), abs({x}2))", 5, n) for x, n in (("m", "mean"), ("v", "variance"), ("s", "skewness"), ("k", "kurtosis"))) + " FROM both_routes"),
    "verdict_failures": q(f"""{_DOUBTFUL},
        shown AS (SELECT {KEY}, any_value(week) AS week, sum(sw*p) AS mass, min(p) AS low, max(p) AS top, abs(sum(sw*p*strike)/any_value(forward) - 1) AS off FROM dens GROUP BY ALL)""",
        f"""SELECT {SMILE}, CASE WHEN week = 1 THEN 'left out' END AS excluded, CASE WHEN week = 1 THEN '' ELSE concat_ws('; ',
          CASE WHEN week = 2 THEN 'fit rmse 0.0123 vol pts' END, CASE WHEN week = 3 THEN 'durrleman -2.50e-01' END,
          CASE WHEN abs(mass - 1) > 1e-4 THEN printf('mass %.6f', mass) END,
          CASE WHEN low/top < -1e-5 THEN printf('negative density %.2e (%.1e of peak)', low, low/top) END,
          CASE WHEN off > 1e-4 THEN printf('E[S]/F - 1 = %.2e', off) END) END AS failures FROM shown"""),
}
