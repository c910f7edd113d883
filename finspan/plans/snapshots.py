"""Book and market snapshots: aliases, roll-ups, expectations and displayed figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finspan.functions import text as T
from finspan.operators import portfolio as O
from finspan.operators import returns as R
from finspan.plans.market import ASSETS, CATEGORY, FACTORS, MARKET, ROLL, TRAIL, assets, category, factors, market, rets, rolling
from finspan.plans.portfolio import MOVE, POS, latest, positions
from finspan.plans.sqlbase import CROSS, LOTS, TAGS, UNIVERSE, history, panel, registry
from finspan.sources import panels as P
from finspan.sources.panels import rounded

QUERIES, ORACLES, query = registry()

#: Holdings that are priced by another ticker's series, scaled to their own price: (symbol, alias).
PRICE_ALIASES = [("Fund#1", "Brand#1"), ("Fund#2", "Brand#7"), ("Brand#3", "Brand#4")]


@query(
    f"""WITH p AS ({panel()}), m(ticker, alias) AS (VALUES {", ".join(map(str, PRICE_ALIASES))}), u AS (SELECT symbol, abs(CAST(sum(market_value) AS DOUBLE)) / nullif(abs(sum(quantity)), 0) AS unit FROM (SELECT 'Fund#' || right(symbol, 1) AS symbol, market_value, quantity FROM lots WHERE symbol IN ('Brand#1', 'Brand#2') UNION ALL SELECT symbol, market_value, quantity FROM lots WHERE symbol = 'Brand#3') GROUP BY 1),
l AS (SELECT ticker, arg_max(close, date) AS close FROM p GROUP BY 1)
SELECT date, ticker, round(close, 6) AS close FROM p WHERE ticker NOT IN (SELECT ticker FROM m) UNION ALL SELECT date, m.ticker, round(p.close * unit / l.close, 6) FROM p JOIN m ON p.ticker = alias JOIN l ON l.ticker = alias JOIN u ON symbol = m.ticker""".replace("WITH p", f"WITH {LOTS}, p", 1)
)
def alias_prices(spark, sf):
    """Series of funds without prices: another's closes scaled to the broker's unit price."""
    lots = P.lots(spark, sf).select("symbol", "quantity", "market_value")
    funds = lots.where(F.col("symbol").isin("Brand#1", "Brand#2")).withColumn("symbol", F.concat(F.lit("Fund#"), F.right("symbol", F.lit(1))))
    held = funds.union(lots.where("symbol = 'Brand#3'")).groupBy("symbol")
    unit = held.agg(F.try_divide(F.abs(F.sum("market_value").cast("double")), F.abs(F.sum("quantity"))).alias("unit"))
    out = R.aliased(P.prices(spark, sf).select("date", "ticker", "close"), unit, spark.createDataFrame(PRICE_ALIASES, "symbol string, alias string"))
    return out.withColumn("close", F.round(F.col("close") * 1e6) / 1e6)  # ties as binary fractions have them, as in the twin


@query(f"WITH {ASSETS}, d AS (SELECT ret - avg(ret) OVER () AS d FROM assets WHERE ret IS NOT NULL) SELECT count(*) AS n, CASE WHEN count(*) >= 10 THEN round(stddev_samp(d), 6) END AS dispersion, round(max(d) - min(d), 6) AS span FROM d")
def dispersion(spark, sf):
    """Cross-sectional deviation of returns, for ten assets at least; a deviation does not depend on the mean taken off."""
    a = assets(spark, sf).where("ret is not null")
    return rounded(a.agg(F.count("*").alias("n"), F.when(F.count("*") >= 10, F.stddev_samp("ret")).alias("dispersion"), (F.max("ret") - F.min("ret")).alias("span")))


@query(f"WITH {ASSETS} SELECT u.ticker AS missing FROM universe u LEFT JOIN assets a ON u.ticker = a.ticker WHERE a.ret IS NULL")
def unpriced_assets(spark, sf):
    """The universe without a return in the last period: left anti join."""
    return P.universe(spark, sf).join(assets(spark, sf).where("ret is not null"), "ticker", "left_anti").select(F.col("ticker").alias("missing"))


@query(f"WITH {ASSETS}, g AS (SELECT tier1, avg(ret) AS ret FROM assets WHERE ret IS NOT NULL GROUP BY 1), w(fund, tier1, w) AS (VALUES ('Balanced', 'PROMO', 0.5), ('Balanced', 'ECONOMY', 0.3), ('Balanced', 'UNPRICED', 0.2), ('Plain', 'ECONOMY', 1.0), ('Blind', 'UNPRICED', 1.0)) SELECT fund, round(sum(w * ret) / sum(CASE WHEN ret IS NOT NULL THEN w END), 6) AS ret, round(coalesce(sum(CASE WHEN ret IS NOT NULL THEN w END), 0), 6) AS priced FROM w LEFT JOIN g ON w.tier1 = g.tier1 GROUP BY 1")
def blended_returns(spark, sf):
    """Returns of looked-through funds from proxies of their parts, with weights scaled to the priced ones."""
    mix = [("Balanced", "PROMO", 0.5), ("Balanced", "ECONOMY", 0.3), ("Balanced", "UNPRICED", 0.2), ("Plain", "ECONOMY", 1.0), ("Blind", "UNPRICED", 1.0)]
    proxies = assets(spark, sf).where("ret is not null").groupBy(F.col("tier1").alias("class")).agg(F.avg("ret").alias("ret"))
    return rounded(O.blended(spark.createDataFrame(mix, "fund string, class string, w double"), proxies))


@query(
    f"""WITH {LOTS}, a AS (SELECT broker, symbol, CAST(sum(market_value) AS DOUBLE) AS value, sum(quantity) AS quantity, sum(abs(quantity)) AS turnover, sum(avg_price * abs(quantity)) / sum(abs(quantity)) AS price FROM lots GROUP BY 1, 2)
SELECT broker, symbol, value, quantity, round(price, 4) AS price, CASE WHEN quantity < 0 OR value < 0 THEN 'short' ELSE 'long' END AS side, round(value / sum(value) OVER (PARTITION BY broker), 6) AS nav_weight FROM a"""
)
def broker_rollup(spark, sf):
    """Lots of a broker by symbol, with the running average price made free of order, side and weight in the broker's net value."""
    size = F.abs("quantity")
    a = P.lots(spark, sf).groupBy("broker", "symbol").agg(F.sum("market_value").cast("double").alias("value"), F.sum("quantity").alias("quantity"), F.round(F.sum(F.col("avg_price") * size) / F.sum(size), 4).alias("price"))
    total = a.groupBy("broker").agg(F.sum("value").alias("total"))
    side = F.when((F.col("quantity") < 0) | (F.col("value") < 0), "short").otherwise("long")
    return a.join(total, "broker").select("broker", "symbol", "value", "quantity", "price", side.alias("side"), F.round(F.col("value") / F.col("total"), 6).alias("nav_weight"))


@query(
    f"""WITH {LOTS} SELECT broker, count(*) AS n, count(*) FILTER (quantity > 0) AS n_long, count(*) FILTER (quantity < 0) AS n_short, CAST(sum(abs(market_value)) AS DOUBLE) AS gross, CAST(sum(market_value) AS DOUBLE) AS net, count(DISTINCT symbol) AS n_symbols FROM lots GROUP BY 1"""
)
def broker_totals(spark, sf):
    m = F.col("market_value")
    return P.lots(spark, sf).groupBy("broker").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("quantity") > 0).alias("n_long"),
        F.count_if(F.col("quantity") < 0).alias("n_short"),
        F.sum(F.abs(m)).cast("double").alias("gross"),
        F.sum(m).cast("double").alias("net"),
        F.count_distinct("symbol").alias("n_symbols"),
    )


@query(
    f"""WITH {POS}, {TRAIL}, {MARKET}, b AS (SELECT ticker, CASE WHEN regr_count(ret, fret) >= 30 THEN regr_slope(ret, fret) END AS beta FROM t JOIN m ON t.seq = m.seq GROUP BY 1), f AS (SELECT arg_max(fret, seq) AS fret FROM m WHERE fret IS NOT NULL)
SELECT round(sum(weight * beta), 6) AS beta, round(sum(weight * beta) * max(fret), 6) AS expected, round(sum(bod_weight * ret) - sum(weight * beta) * max(fret), 6) AS alpha FROM pos LEFT JOIN b ON ticker = symbol, f"""
)
def book_alpha(spark, sf):
    """Beta of the book, the return it explains and what is left of the book's return."""
    b = R.beta_to(rets(spark, sf), market(spark, sf)).select(F.col("ticker").alias("symbol"), "beta")
    f = market(spark, sf).where("fret is not null").agg(F.max_by("fret", "seq").alias("fret"))
    g = positions(spark, sf).join(b, "symbol", "left").agg(F.sum(F.col("weight") * F.col("beta")).alias("beta"), F.sum(F.col("bod_weight") * F.col("ret")).alias("ret"))
    expected = F.col("beta") * F.col("fret")
    return rounded(g.join(F.broadcast(f)).select("beta", expected.alias("expected"), (F.col("ret") - expected).alias("alpha")))


@query(
    f"""WITH {POS}, {TAGS}, y AS (SELECT max(year(date)) AS y FROM r), e AS (SELECT ticker, arg_max(close, date) AS close FROM r, y WHERE year(date) = y GROUP BY 1), s AS (SELECT ticker, arg_max(close, date) AS close FROM r, y WHERE year(date) < y GROUP BY 1),
g AS (SELECT e.ticker, 100 * (e.close / s.close - 1) AS ytd FROM e JOIN s ON e.ticker = s.ticker)
SELECT axis, tag, round(sum(abs(weight) * ytd) / nullif(sum(CASE WHEN ytd IS NOT NULL THEN abs(weight) END), 0), 6) AS ytd, count(ytd) AS n FROM pos JOIN tags t ON t.ticker = symbol LEFT JOIN g ON g.ticker = symbol GROUP BY 1, 2"""
)
def weighted_ytd(spark, sf):
    """Return of the year by tag, weighted by the book's gross weights of those with one."""
    y = R.ytd_return(R.on_calendar(P.prices(spark, sf))).select(F.col("ticker").alias("symbol"), F.col("ret").alias("ytd"))
    t = P.tags(spark, sf).withColumnRenamed("ticker", "symbol")
    j = positions(spark, sf).select("symbol", F.abs("weight").alias("w")).join(t, "symbol").join(y, "symbol", "left")
    return rounded(j.groupBy("axis", "tag").agg(F.try_divide(F.sum(F.col("w") * F.col("ytd")), F.sum(F.when(F.col("ytd").isNotNull(), F.col("w")))).alias("ytd"), F.count("ytd").alias("n")))


@query(f"WITH {ROLL}, k AS (SELECT date, ticker, factor, row_number() OVER (PARTITION BY date, ticker ORDER BY round(corr * corr, 6) DESC, factor) AS k FROM roll WHERE corr IS NOT NULL) SELECT factor, count(*) AS n, count(DISTINCT ticker) AS n_tickers, max(date) AS last FROM k WHERE k = 1 GROUP BY 1")
def best_factor_histogram(spark, sf):
    """How often each factor explains most."""
    r = rolling(spark, sf).where("corr is not null").withColumn("r2", F.round(F.col("corr") * F.col("corr"), 6))
    best = r.groupBy("date", "ticker").agg(F.min(F.struct((-F.col("r2")).alias("low"), "factor"))["factor"].alias("factor"))
    return best.groupBy("factor").agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("n_tickers"), F.max("date").alias("last"))


@query(
    f"""WITH {history()}, {TRAIL}, {FACTORS}, b AS (SELECT ticker, factor, regr_slope(ret, fret) AS beta FROM t JOIN f ON t.seq = f.seq GROUP BY 1, 2),
w AS (SELECT ticker, max(CASE WHEN factor = 'SMALL' THEN beta END) AS small, max(CASE WHEN factor = 'LARGE' THEN beta END) AS large, max(CASE WHEN factor = 'ECONOMY' THEN beta END) AS economy, max(CASE WHEN factor = 'PROMO' THEN beta END) AS promo, avg(beta) AS mean FROM b GROUP BY 1)
SELECT ticker, round(small - large, 6) AS size_tilt, round(economy - promo, 6) AS price_tilt, round(mean, 6) AS mean_beta FROM w"""
)
def factor_decomposition(spark, sf):
    """Tilts as differences of betas to opposite factors."""
    b = R.trailing(rets(spark, sf), 60).join(factors(spark, sf), "seq").groupBy("ticker", "factor").agg(F.regr_slope("ret", "fret").alias("beta"))
    at = lambda k: F.max(F.when(F.col("factor") == k, F.col("beta")))
    return rounded(b.groupBy("ticker").agg((at("SMALL") - at("LARGE")).alias("size_tilt"), (at("ECONOMY") - at("PROMO")).alias("price_tilt"), F.avg("beta").alias("mean_beta")))


@query(
    f"""WITH {history()}, {MARKET}, v AS (SELECT stddev_samp(fret) * sqrt(52.0) AS vol FROM (SELECT * FROM m ORDER BY seq DESC LIMIT 61)), l AS (SELECT * FROM m WHERE fret IS NOT NULL ORDER BY seq DESC LIMIT 20)
SELECT seq, round(fret, 6) AS ret, round(vol / sqrt(52.0), 6) AS expected, round(abs(fret) / nullif(vol / sqrt(52.0), 0), 6) AS multiple, CASE WHEN abs(fret) <= vol / sqrt(52.0) THEN 'ordinary' WHEN abs(fret) <= 2 * vol / sqrt(52.0) THEN 'large' ELSE 'extreme' END AS verdict FROM l, v"""
)
def expected_moves(spark, sf):
    """The benchmark's last moves against what its annual volatility leads to expect of one period."""
    m = market(spark, sf)
    v = m.orderBy(F.desc("seq")).limit(61).agg(F.stddev_samp("fret").alias("expected"))
    j = m.where("fret is not null").orderBy(F.desc("seq")).limit(20).join(F.broadcast(v))
    size = F.abs("fret")
    verdict = F.when(size <= F.col("expected"), "ordinary").when(size <= 2 * F.col("expected"), "large").otherwise("extreme")
    return rounded(j.select(F.col("seq").cast("bigint").alias("seq"), F.col("fret").alias("ret"), "expected", F.try_divide(size, F.col("expected")).alias("multiple"), verdict.alias("verdict")))


@query(f"WITH {POS} SELECT symbol, coalesce(printf('%+.2f%%', round(ret, 6)), '—') AS ret, printf('%.1fM', round(mtm, 2) / 1000000) AS value, CASE WHEN mtm < 0 THEN 'short' ELSE 'long' END AS side FROM pos WHERE abs(weight) > 0.005")
def displayed_positions(spark, sf):
    """Signed percent, millions and a dash for what is undefined, of positions above half a percent."""
    p = positions(spark, sf).where("abs(weight) > 0.005")
    return p.select("symbol", T.signed_percent(F.round("ret", 6)).alias("ret"), F.format_string("%.1fM", F.round("mtm", 2) / 1000000).alias("value"), F.when(F.col("mtm") < 0, "short").otherwise("long").alias("side"))


@query(
    f"""WITH {CATEGORY}, d AS (SELECT date, seq, tier1, mean_ret, sign(mean_ret) AS s, lag(sign(mean_ret)) OVER (PARTITION BY tier1 ORDER BY seq) AS before FROM c) SELECT tier1, date, round(mean_ret, 6) AS mean_ret, CASE WHEN before IS NULL THEN 'first' WHEN s = before THEN 'extended' ELSE 'reset' END AS change FROM d WHERE seq = (SELECT max(seq) FROM c)"""
)
def streak_updates(spark, sf):
    """What the last date does to each category's streak."""
    c = category(spark, sf)
    before = F.lag(F.signum("mean_ret")).over(Window.partitionBy("tier1").orderBy("seq"))
    d = c.withColumn("change", F.when(before.isNull(), "first").when(F.signum("mean_ret") == before, "extended").otherwise("reset"))
    last = c.agg(F.max("seq").alias("seq"))
    return rounded(d.join(F.broadcast(last), "seq").select("tier1", "date", "mean_ret", "change"))


@query(
    f"""WITH {history('x', 'month', CROSS)}, {UNIVERSE}, t AS (SELECT x.ticker, tier1, seq, ret FROM x JOIN universe u ON u.ticker = x.ticker, x_l WHERE seq > last - 24 AND ret IS NOT NULL)
SELECT a.tier1, a.ticker AS a, b.ticker AS b, count(*) AS n, round(corr(a.ret, b.ret), 6) AS corr FROM t a JOIN t b ON a.tier1 = b.tier1 AND a.seq = b.seq AND a.ticker < b.ticker GROUP BY 1, 2, 3 HAVING count(*) >= 12"""
)
def correlation_matrix(spark, sf):
    """Correlations within a category over the last 24 periods, of pairs with twelve or more in common."""
    t = R.trailing(rets(spark, sf, "month", P.CROSS), 24).where("ret is not null").join(P.universe(spark, sf), "ticker").select("tier1", "seq", "ticker", "ret")
    j = t.withColumnsRenamed({"ticker": "a", "ret": "x"}).join(t.withColumnsRenamed({"ticker": "b", "ret": "y"}), ["tier1", "seq"]).where("a < b")
    return rounded(j.groupBy("tier1", "a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("corr")).where("n >= 12"))


@query(f"WITH {MOVE} SELECT m.ticker, round(m.ret, 6) AS ret, k.seq < last AS stale FROM move m JOIN k ON k.ticker = m.ticker AND k.k = 1, r_l")
def stale_prices(spark, sf):
    """Each ticker's last return, and whether it is of an earlier session than the market's last."""
    r = rets(spark, sf)
    last = r.agg(F.max("seq").alias("last"))
    at = r.where("ret is not null").groupBy("ticker").agg(F.max("seq").alias("seq"))
    return rounded(latest(spark, sf).join(at, "ticker").join(F.broadcast(last)).select("ticker", "ret", (F.col("seq") < F.col("last")).alias("stale")))
