"""Market queries: histories, risk, categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finspan.operators import returns as R
from finspan.plans.sqlbase import CROSS, UNIVERSE, history, panel, registry
from finspan.sources import panels as P
from finspan.sources.panels import rounded

QUERIES, ORACLES, query = registry()


def rets(spark: SparkSession, sf: str, grain: str = "week", key: str = "p_brand") -> DataFrame:
    return R.daily_returns(R.on_calendar(P.prices(spark, sf, grain, key)))


def market(spark: SparkSession, sf: str, grain: str = "week") -> DataFrame:
    """(seq, fret) of the benchmark, on the calendar of the brands."""
    cal = R.on_calendar(P.prices(spark, sf, grain)).select("date", "seq").distinct()
    m = P.prices(spark, sf, grain, "'ALL'").join(cal, "date")
    return R.daily_returns(m).select("seq", F.col("ret").alias("fret"))


def factors(spark: SparkSession, sf: str, grain: str = "week") -> DataFrame:
    """(seq, factor, fret) by part type, on the calendar of the brands."""
    cal = R.on_calendar(P.prices(spark, sf, grain)).select("date", "seq").distinct()
    return R.daily_returns(P.prices(spark, sf, grain, "p_type").join(cal, "date")).select("seq", F.col("ticker").alias("factor"), F.col("ret").alias("fret"))


FACTORS = f"""f_p AS ({panel(key="p_type")}), f AS (SELECT c.seq, ticker AS factor, CASE WHEN lag(c.seq) OVER w = c.seq - 1 THEN 100 * (close / lag(close) OVER w - 1) END AS fret
FROM f_p p JOIN r_c c ON p.date = c.date WINDOW w AS (PARTITION BY ticker ORDER BY c.seq))"""
MARKET = f"""m_p AS ({panel(key="'ALL'")}), m AS (SELECT c.seq, CASE WHEN lag(c.seq) OVER w = c.seq - 1 THEN 100 * (close / lag(close) OVER w - 1) END AS fret
FROM m_p p JOIN r_c c ON p.date = c.date WINDOW w AS (ORDER BY c.seq))"""
TRAIL = "t AS (SELECT r.*, last FROM r, r_l WHERE seq > last - 60)"


@query(f"SELECT date, ticker, close, volume FROM ({panel()})")
def price_panel(spark, sf):
    return P.prices(spark, sf)


@query(f"WITH {history(grain='day')} SELECT n.date, n.n FROM r_n n JOIN r_c c ON n.date = c.date")
def sparse_filter(spark, sf):
    return R.sparse_filter(P.prices(spark, sf, "day"))


@query(f"WITH {history()} SELECT date, ticker, seq, round(ret, 6) AS ret FROM r")
def daily_returns(spark, sf):
    return rounded(rets(spark, sf).select("date", "ticker", F.col("seq").cast("bigint").alias("seq"), "ret"))


@query(f"WITH {history()} SELECT b.ticker, round(100 * (b.close / a.close - 1), 6) AS ret FROM r b JOIN r_l ON b.seq = last LEFT JOIN r a ON a.ticker = b.ticker AND a.seq = last - 5")
def return_over_n(spark, sf):
    return rounded(R.return_over(R.on_calendar(P.prices(spark, sf)), 5))


@query(
    f"""WITH {history()}, y AS (SELECT max(year(date)) AS y FROM r), b AS (SELECT ticker, arg_max(close, date) AS close FROM r, y WHERE year(date) = y GROUP BY 1),
a AS (SELECT ticker, arg_max(close, date) AS close FROM r, y WHERE year(date) < y GROUP BY 1)
SELECT k.ticker, round(100 * (b.close / a.close - 1), 6) AS ret FROM (SELECT DISTINCT ticker FROM r) k LEFT JOIN b ON k.ticker = b.ticker LEFT JOIN a ON k.ticker = a.ticker"""
)
def ytd_return(spark, sf):
    return rounded(R.ytd_return(R.on_calendar(P.prices(spark, sf))))


#: A past day for which figures are made again.
AS_OF = "1997-06-30"


@query(
    f"""WITH p AS (SELECT * FROM ({panel()}) WHERE date <= DATE '{AS_OF}'), n AS (SELECT date, count(*) AS n FROM p GROUP BY 1), c AS (SELECT date, row_number() OVER (ORDER BY date) AS seq FROM n WHERE n >= 0.5 * (SELECT max(n) FROM n)),
r AS (SELECT p.*, seq FROM p JOIN c ON p.date = c.date), l AS (SELECT max(seq) AS last FROM c) SELECT b.ticker, b.date, round(100 * (b.close / a.close - 1), 6) AS ret FROM r b JOIN l ON b.seq = last LEFT JOIN r a ON a.ticker = b.ticker AND a.seq = last - 5"""
)
def return_as_of(spark, sf):
    """Five-row returns as a past day's report had them; later prices don't count, neither for the calendar."""
    on = R.on_calendar(R.as_of(P.prices(spark, sf), AS_OF))
    day = on.agg(F.max("date").alias("date"))
    return rounded(R.return_over(on, 5).join(F.broadcast(day)).select("ticker", "date", "ret"))


@query(f"WITH {history()}, {TRAIL} SELECT ticker, CASE WHEN count(ret) >= 30 THEN round(stddev_samp(ret) * sqrt(52.0), 6) END AS vol FROM t GROUP BY ticker")
def annualized_vol(spark, sf):
    return rounded(R.annualized_vol(rets(spark, sf)))


@query(
    f"""WITH {history()}, {TRAIL}, n AS (SELECT ticker, ret AS now FROM t WHERE seq = last)
SELECT t.ticker, CASE WHEN count(ret) >= 30 AND now IS NOT NULL THEN round_even(100.0 * count(*) FILTER (ret < now) / count(ret), 0) END AS pct FROM t JOIN n ON t.ticker = n.ticker GROUP BY t.ticker, now"""
)
def return_percentile(spark, sf):
    return R.return_percentile(rets(spark, sf))


@query(f"WITH {history()}, {TRAIL}, {MARKET} SELECT ticker, CASE WHEN regr_count(ret, fret) >= 30 THEN round(regr_slope(ret, fret), 6) END AS beta, CAST(regr_count(ret, fret) AS BIGINT) AS n FROM t JOIN m ON t.seq = m.seq GROUP BY ticker")
def beta_vs_market(spark, sf):
    return rounded(R.beta_to(rets(spark, sf), market(spark, sf)))


@query(f"WITH {history()}, {TRAIL}, {FACTORS} SELECT ticker, factor, round(CASE WHEN count(*) > 1 THEN corr(ret, fret) END, 6) AS corr FROM t JOIN f ON t.seq = f.seq WHERE ret IS NOT NULL AND fret IS NOT NULL GROUP BY 1, 2")
def factor_correlation(spark, sf):
    return rounded(R.correlations(rets(spark, sf), factors(spark, sf)))


@query(
    f"""WITH {history()}, {FACTORS}, t AS (SELECT f.* FROM f, r_l WHERE seq > last - 60)
SELECT a.factor AS a, b.factor AS b, round(corr(a.fret, b.fret), 6) AS corr FROM t a JOIN t b ON a.seq = b.seq AND a.factor < b.factor WHERE a.fret IS NOT NULL AND b.fret IS NOT NULL GROUP BY 1, 2 ORDER BY 3, 1, 2 LIMIT 5"""
)
def low_corr_pairs(spark, sf):
    """The five least correlated pairs of factors."""
    f = factors(spark, sf).where("fret is not null")
    t = f.join(F.broadcast(f.agg(F.max("seq").alias("last"))), F.col("seq") > F.col("last") - 60)
    a, b = t.select("seq", F.col("factor").alias("a"), F.col("fret").alias("x")), t.select("seq", F.col("factor").alias("b"), F.col("fret").alias("y"))
    return a.join(b, "seq").where("a < b").groupBy("a", "b").agg(F.round(F.corr("x", "y"), 6).alias("corr")).orderBy("corr", "a", "b").limit(5)


@query(
    f"""WITH {history()}, t AS (SELECT r.*, sign(ret) AS s FROM r, r_l WHERE seq > last - 15 AND ret IS NOT NULL),
k AS (SELECT *, row_number() OVER w AS k, first_value(s) OVER w AS first FROM t WINDOW w AS (PARTITION BY ticker ORDER BY seq DESC)),
g AS (SELECT ticker, first, coalesce(min(CASE WHEN s <> first OR s = 0 THEN k END) - 1, max(k)) AS n FROM k GROUP BY 1, 2)
SELECT ticker, CAST(first * n AS INTEGER) AS streak FROM g WHERE n >= 3"""
)
def streaks(spark, sf):
    return R.streaks(rets(spark, sf), least=3)


ASSETS = f"{history('x', 'month', CROSS)}, {UNIVERSE}, assets AS (SELECT x.ticker, tier1, tier2, ret FROM x JOIN x_l ON seq = last JOIN universe u ON u.ticker = x.ticker)"


def assets(spark: SparkSession, sf: str) -> DataFrame:
    """(ticker, tier1, tier2, ret) of the last period."""
    x = rets(spark, sf, "month", P.CROSS)
    return R.trailing(x, 1).join(P.universe(spark, sf), "ticker").select("ticker", "tier1", "tier2", "ret")


@query(f"WITH {ASSETS} SELECT tier1, count(ret) AS n, round(avg(ret), 6) AS mean_ret FROM assets WHERE ret IS NOT NULL GROUP BY 1")
def tier1_summary(spark, sf):
    return rounded(assets(spark, sf).where("ret is not null").groupBy("tier1").agg(F.count("ret").alias("n"), F.avg("ret").alias("mean_ret")))


@query(f"WITH {ASSETS} SELECT tier1, tier2, count(ret) AS n, round(avg(ret), 6) AS mean_ret FROM assets WHERE ret IS NOT NULL GROUP BY GROUPING SETS ((tier1), (tier1, tier2))")
def tier2_summary(spark, sf):
    return rounded(assets(spark, sf).where("ret is not null").groupingSets([["tier1"], ["tier1", "tier2"]], "tier1", "tier2").agg(F.count("ret").alias("n"), F.avg("ret").alias("mean_ret")))


@query(f"WITH {ASSETS} SELECT ticker, round(ret, 6) AS ret FROM assets WHERE ret IS NOT NULL ORDER BY assets.ret DESC, ticker LIMIT 15")
def movers_up(spark, sf):
    return rounded(assets(spark, sf).where("ret is not null").orderBy(F.desc("ret"), "ticker").limit(15).select("ticker", "ret"))


@query(f"WITH {ASSETS} SELECT ticker, round(ret, 6) AS ret FROM assets WHERE ret IS NOT NULL ORDER BY assets.ret, ticker LIMIT 15")
def movers_down(spark, sf):
    return rounded(assets(spark, sf).where("ret is not null").orderBy("ret", "ticker").limit(15).select("ticker", "ret"))


@query(f"WITH {ASSETS} SELECT count(*) AS n_universe, count(a.ret) AS n_priced, round(100.0 * count(a.ret) / count(*), 6) AS pct FROM universe u LEFT JOIN assets a ON u.ticker = a.ticker")
def coverage(spark, sf):
    j = P.universe(spark, sf).select("ticker").join(assets(spark, sf).select("ticker", "ret"), "ticker", "left")
    return rounded(j.agg(F.count("*").alias("n_universe"), F.count("ret").alias("n_priced"), (100.0 * F.count("ret") / F.count("*")).alias("pct")))


@query(f"WITH {ASSETS} SELECT count(ret) AS n, round(100.0 * count(*) FILTER (ret > 0) / count(ret), 6) AS pct_up, round(avg(ret), 6) AS mean_ret, round(median(ret), 6) AS median_ret, round(stddev_samp(ret), 6) AS dispersion FROM assets")
def breadth(spark, sf):
    return rounded(assets(spark, sf).agg(F.count("ret").alias("n"), (100.0 * F.count_if(F.col("ret") > 0) / F.count("ret")).alias("pct_up"), F.avg("ret").alias("mean_ret"), F.expr("percentile(ret, 0.5)").alias("median_ret"), F.stddev_samp("ret").alias("dispersion")))


CATEGORY = f"{history('x', 'month', CROSS)}, {UNIVERSE}, c AS (SELECT date, seq, tier1, avg(ret) AS mean_ret, count(ret) AS n FROM x JOIN universe u ON u.ticker = x.ticker WHERE ret IS NOT NULL GROUP BY 1, 2, 3)"


def category(spark: SparkSession, sf: str) -> DataFrame:
    x = rets(spark, sf, "month", P.CROSS).where("ret is not null").join(P.universe(spark, sf), "ticker")
    return x.groupBy("date", "seq", "tier1").agg(F.avg("ret").alias("mean_ret"), F.count("ret").alias("n"))


@query(
    f"""WITH {history('x', 'month', CROSS)}, {UNIVERSE}
SELECT date, tier1, count(*) AS n, round(avg(ret), 6) AS mean_ret, round(median(ret), 6) AS median_ret, round(stddev_samp(ret), 6) AS std_ret, round(min(ret), 6) AS min_ret, round(max(ret), 6) AS max_ret
FROM x JOIN universe u ON u.ticker = x.ticker WHERE ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3"""
)
def category_stats(spark, sf):
    x = rets(spark, sf, "month", P.CROSS).where("ret is not null").join(P.universe(spark, sf), "ticker")
    g = x.groupBy("date", "tier1").agg(F.count("*").alias("n"), F.avg("ret").alias("mean_ret"), F.expr("percentile(ret, 0.5)").alias("median_ret"), F.stddev_samp("ret").alias("std_ret"), F.min("ret").alias("min_ret"), F.max("ret").alias("max_ret"))
    return rounded(g.where("n >= 3"))


@query(
    f"""WITH {CATEGORY}, s AS (SELECT *, sign(mean_ret) AS s, CASE WHEN sign(mean_ret) IS DISTINCT FROM lag(sign(mean_ret)) OVER w THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY tier1 ORDER BY seq)),
g AS (SELECT *, sum(new) OVER (PARTITION BY tier1 ORDER BY seq) AS island FROM s)
SELECT date, tier1, CAST(s * row_number() OVER (PARTITION BY tier1, island ORDER BY seq) AS INTEGER) AS streak FROM g"""
)
def category_streaks(spark, sf):
    """Signed length of each category's run, by gaps and islands."""
    w = Window.partitionBy("tier1").orderBy("seq")
    s = category(spark, sf).withColumn("s", F.signum("mean_ret"))
    s = s.withColumn("new", (~F.col("s").eqNullSafe(F.lag("s").over(w))).cast("int")).withColumn("island", F.sum("new").over(w))
    return s.select("date", "tier1", (F.col("s") * F.row_number().over(Window.partitionBy("tier1", "island").orderBy("seq"))).cast("int").alias("streak"))


@query(
    f"""WITH {CATEGORY} SELECT a.date, a.tier1, round(100.0 * count(*) FILTER (b.mean_ret < a.mean_ret) / count(*), 6) AS pct
FROM c a JOIN c b ON a.tier1 = b.tier1 AND b.seq BETWEEN a.seq - 60 AND a.seq - 1 GROUP BY 1, 2 HAVING count(*) >= 5"""
)
def category_percentile(spark, sf):
    c = category(spark, sf).select("date", "seq", F.col("tier1").alias("ticker"), F.col("mean_ret").alias("ret"))
    return rounded(R.percentile_of_prior(c).select("date", F.col("ticker").alias("tier1"), "pct"))


ROLL = f"""{history()}, {FACTORS}, j AS (SELECT r.date, r.seq, ticker, factor, ret, fret FROM r JOIN f ON r.seq = f.seq WHERE ret IS NOT NULL AND fret IS NOT NULL),
roll AS (SELECT date, seq, ticker, factor, CASE WHEN count(*) OVER w >= 20 THEN corr(ret, fret) OVER w END AS corr FROM j WINDOW w AS (PARTITION BY ticker, factor ORDER BY seq RANGE BETWEEN 60 PRECEDING AND CURRENT ROW))"""


def rolling(spark: SparkSession, sf: str) -> DataFrame:
    return R.rolling_correlation(rets(spark, sf), factors(spark, sf))


@query(f"WITH {ROLL} SELECT date, ticker, factor, round(corr, 4) AS corr FROM roll WHERE corr IS NOT NULL")
def rolling_factor_corr(spark, sf):
    return rounded(rolling(spark, sf).where("corr is not null").select("date", "ticker", "factor", "corr"), 4)


@query(f"WITH {ROLL} SELECT date, ticker, factor, r2 FROM (SELECT *, round(corr * corr, 6) AS r2, row_number() OVER (PARTITION BY date, ticker ORDER BY round(corr * corr, 6) DESC, factor) AS k FROM roll WHERE corr IS NOT NULL) WHERE k = 1")
def best_factor(spark, sf):
    r = rolling(spark, sf).where("corr is not null").withColumn("r2", F.round(F.col("corr") * F.col("corr"), 6))
    k = F.row_number().over(Window.partitionBy("date", "ticker").orderBy(F.desc("r2"), "factor"))
    return r.withColumn("k", k).where("k = 1").select("date", "ticker", "factor", "r2")


@query(
    f"""WITH {ROLL}, d AS (SELECT date, ticker, abs(corr - lag(corr, 5) OVER (PARTITION BY ticker, factor ORDER BY seq)) AS d FROM roll WHERE corr IS NOT NULL)
SELECT date, ticker, coalesce(bool_or(round(d, 6) > 0.15), false) AS changed FROM d GROUP BY 1, 2"""
)
def regime_change(spark, sf):
    """Whether a factor's correlation moved by more than 0.15 in five rows."""
    w = Window.partitionBy("ticker", "factor").orderBy("seq")
    d = rolling(spark, sf).where("corr is not null").withColumn("d", F.round(F.abs(F.col("corr") - F.lag("corr", 5).over(w)), 6))
    return d.groupBy("date", "ticker").agg(F.coalesce(F.bool_or(F.col("d") > 0.15), F.lit(False)).alias("changed"))


@query(f"WITH {history()} SELECT ticker, date, round(100 * (exp(sum(ln(1 + ret / 100)) OVER (PARTITION BY ticker, year(date) ORDER BY seq)) - 1), 5) AS ytd FROM r WHERE ret IS NOT NULL")
def ytd_compounded(spark, sf):
    return rounded(R.compounded_ytd(rets(spark, sf)), 5)


@query(
    f"""WITH {history()} SELECT a.ticker, a.date, round(100.0 * count(*) FILTER (b.ret < a.ret) / count(*), 6) AS pct
FROM r a JOIN r b ON a.ticker = b.ticker AND b.seq BETWEEN a.seq - 60 AND a.seq - 1 AND b.ret IS NOT NULL WHERE a.ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5"""
)
def ticker_percentile(spark, sf):
    return rounded(R.percentile_of_prior(rets(spark, sf)))


@query(
    f"""WITH {ASSETS}, k AS (SELECT *, row_number() OVER (PARTITION BY tier1 ORDER BY ret DESC, ticker) AS best, row_number() OVER (PARTITION BY tier1 ORDER BY ret, ticker) AS worst FROM assets WHERE ret IS NOT NULL)
SELECT tier1, max(CASE WHEN best = 1 THEN ticker END) AS best_ticker, max(CASE WHEN worst = 1 THEN ticker END) AS worst_ticker, round(max(ret), 6) AS best_ret, round(min(ret), 6) AS worst_ret FROM k GROUP BY 1"""
)
def best_worst_by_tier(spark, sf):
    a = assets(spark, sf).where("ret is not null")
    best, worst = F.min(F.struct((-F.col("ret")).alias("r"), "ticker")), F.min(F.struct("ret", "ticker"))
    return rounded(a.groupBy("tier1").agg(best["ticker"].alias("best_ticker"), worst["ticker"].alias("worst_ticker"), F.max("ret").alias("best_ret"), F.min("ret").alias("worst_ret")))


@query(f"WITH {history()}, {TRAIL}, v AS (SELECT ticker, stddev_samp(ret) AS s FROM t GROUP BY 1) SELECT t.ticker, round(ret / nullif(s, 0), 6) AS z FROM t JOIN v ON t.ticker = v.ticker WHERE seq = last")
def zscore(spark, sf):
    r = R.trailing(rets(spark, sf), 60)
    v = r.groupBy("ticker").agg(F.stddev_samp("ret").alias("s"))
    return rounded(r.where("seq = last").join(v, "ticker").select("ticker", F.try_divide("ret", "s").alias("z")))


@query(
    f"""WITH {history()}, {MARKET}, b AS (SELECT quantile_cont(fret, 0.1) AS q FROM m WHERE fret IS NOT NULL),
g AS (SELECT ticker, regr_slope(ret, fret) AS beta, regr_count(ret, fret) AS n, regr_slope(ret, fret) FILTER (fret <= q) AS crash, regr_count(ret, fret) FILTER (fret <= q) AS k FROM r JOIN m ON r.seq = m.seq, b GROUP BY 1)
SELECT ticker, round(beta, 6) AS beta, CASE WHEN n >= 120 AND k >= 10 THEN round(crash, 6) END AS crash_beta, CAST(k AS BIGINT) AS crash_rows FROM g"""
)
def crash_beta(spark, sf):
    """Beta on the benchmark's worst tenth of rows next to that on all."""
    m = market(spark, sf).where("fret is not null")
    q = m.agg(F.expr("percentile(fret, 0.1)").alias("q"))
    j = rets(spark, sf).join(m.join(F.broadcast(q)), "seq").withColumn("cret", F.when(F.col("fret") <= F.col("q"), F.col("ret")))
    g = j.groupBy("ticker").agg(F.regr_slope("ret", "fret").alias("beta"), F.regr_count("ret", "fret").alias("n"), F.regr_slope("cret", "fret").alias("crash"), F.regr_count("cret", "fret").alias("k"))
    return rounded(g.select("ticker", "beta", F.when((F.col("n") >= 120) & (F.col("k") >= 10), F.col("crash")).alias("crash_beta"), F.col("k").alias("crash_rows")))
