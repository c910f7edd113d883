"""Returns, risk and relative measures of long price histories.

A history is (date, ticker, close, ...); the calendar numbers the dates on which enough tickers have a price, and
all windows count calendar rows, so that a ticker's gaps are neither filled nor skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def by_ticker() -> Window:
    return Window.partitionBy("ticker").orderBy("seq")



def sparse_filter(prices: DataFrame, least: float = 0.5) -> DataFrame:
    """(date, n) of the dates with at least this share of the largest number of tickers."""
    n = prices.groupBy("date").agg(F.count("*").alias("n"))
    most = n.agg(F.max("n").alias("most"))
    return n.join(F.broadcast(most), F.col("n") >= least * F.col("most")).select("date", "n")  # one row


def as_of(prices: DataFrame, date: str | None) -> DataFrame:
    """Prices up to a day, that day included; all of them without one."""
    return prices if date is None else prices.where(F.col("date") <= F.lit(date).cast("date"))


def on_calendar(prices: DataFrame, least: float = 0.5) -> DataFrame:
    """Prices on the calendar's dates with their row number (seq); the calendar has one row a date."""
    seq = F.row_number().over(Window.orderBy("date"))
    return prices.join(F.broadcast(sparse_filter(prices, least).select("date", seq.alias("seq"))), "date")


def daily_returns(on: DataFrame) -> DataFrame:
    """Adds ret: percent to the calendar row before; null if the ticker has no price there."""
    before = F.lag("close").over(by_ticker())
    return on.withColumn("ret", F.when(F.lag("seq").over(by_ticker()) == F.col("seq") - 1, 100 * (F.col("close") / before - 1)))


def last_seq(on: DataFrame) -> DataFrame:
    return on.agg(F.max("seq").alias("last"))


def trailing(on: DataFrame, rows: int) -> DataFrame:
    """The last so many calendar rows."""
    return on.join(F.broadcast(last_seq(on)), F.col("seq") > F.col("last") - rows)


def return_over(on: DataFrame, n: int) -> DataFrame:
    """(ticker, ret): percent over n calendar rows to the last one."""
    ends = on.join(F.broadcast(last_seq(on)), (F.col("seq") == F.col("last")) | (F.col("seq") == F.col("last") - n))
    pair = ends.groupBy("ticker").agg(F.max(F.when(F.col("seq") == F.col("last"), F.col("close"))).alias("b"), F.max(F.when(F.col("seq") < F.col("last"), F.col("close"))).alias("a"))
    return pair.where("b is not null").select("ticker", (100 * (F.col("b") / F.col("a") - 1)).alias("ret"))


def ytd_return(on: DataFrame) -> DataFrame:
    """(ticker, ret): last price to the last one before this year; null for new listings."""
    year = on.agg(F.max(F.year("date")).alias("y"))
    j = on.join(F.broadcast(year))
    now = F.max(F.when(F.year("date") == F.col("y"), F.struct("date", "close")))["close"]
    base = F.max(F.when(F.year("date") < F.col("y"), F.struct("date", "close")))["close"]
    return j.groupBy("ticker").agg(now.alias("b"), base.alias("a")).select("ticker", (100 * (F.col("b") / F.col("a") - 1)).alias("ret"))


def annualized_vol(returns: DataFrame, rows: int = 60, periods: int = 52) -> DataFrame:
    """(ticker, vol): sample deviation over the last rows, null with fewer than half of them."""
    g = trailing(returns, rows).groupBy("ticker").agg(F.stddev_samp("ret").alias("s"), F.count("ret").alias("n"))
    return g.select("ticker", F.when(F.col("n") >= rows / 2, F.col("s") * F.sqrt(F.lit(float(periods)))).alias("vol"))


def return_percentile(returns: DataFrame, rows: int = 60, least: int = 30) -> DataFrame:
    """(ticker, pct): share of the window's returns below the last one, half-even to whole percents."""
    t = trailing(returns, rows)
    latest = t.where("seq = last").select("ticker", F.col("ret").alias("now"))
    g = t.join(latest, "ticker").groupBy("ticker", "now").agg(F.count("ret").alias("n"), F.count_if(F.col("ret") < F.col("now")).alias("below"))
    return g.select("ticker", F.when((F.col("n") >= least) & F.col("now").isNotNull(), F.bround(100.0 * F.col("below") / F.col("n"), 0)).alias("pct"))


def beta_to(returns: DataFrame, factor: DataFrame, rows: int = 60, least: int = 30) -> DataFrame:
    """(ticker, beta, n) against factor (seq, fret) over pairs that are complete."""
    g = trailing(returns, rows).join(factor.select("seq", "fret"), "seq").groupBy("ticker").agg(F.regr_slope("ret", "fret").alias("b"), F.regr_count("ret", "fret").alias("n"))
    return g.select("ticker", F.when(F.col("n") >= least, F.col("b")).alias("beta"), "n")


def correlations(returns: DataFrame, factors: DataFrame, rows: int = 60) -> DataFrame:
    """(ticker, factor, corr) with factors (seq, factor, fret)."""
    pairs = trailing(returns, rows).join(factors, "seq").where("ret is not null and fret is not null")
    return pairs.groupBy("ticker", "factor").agg(F.when(F.count("*") > 1, F.corr("ret", "fret")).alias("corr"))


def streaks(returns: DataFrame, rows: int = 15, least: int = 4) -> DataFrame:
    """(ticker, streak): signed number of last returns of one sign, gaps skipped, a zero ends it; of at least so many."""
    t = trailing(returns, rows).where("ret is not null")
    back = Window.partitionBy("ticker").orderBy(F.desc("seq"))
    s = t.withColumn("sign", F.signum("ret")).withColumn("k", F.row_number().over(back)).withColumn("first", F.first("sign").over(back))
    broken = F.min(F.when((F.col("sign") != F.col("first")) | (F.col("sign") == 0), F.col("k")))
    g = s.groupBy("ticker", "first").agg(broken.alias("at"), F.max("k").alias("n"))
    n = F.coalesce(F.col("at") - 1, F.col("n"))
    return g.where(n >= least).select("ticker", (F.col("first") * n).cast("int").alias("streak"))


def rolling_correlation(returns: DataFrame, factors: DataFrame, rows: int = 61, least: int = 20) -> DataFrame:
    """(date, seq, ticker, factor, corr) over the calendar rows up to each date."""
    w = Window.partitionBy("ticker", "factor").orderBy("seq").rangeBetween(-(rows - 1), 0)
    j = returns.join(factors, "seq").where("ret is not null and fret is not null")
    return j.withColumn("n", F.count("*").over(w)).withColumn("c", F.corr("ret", "fret").over(w)).select("date", "seq", "ticker", "factor", F.when(F.col("n") >= least, F.col("c")).alias("corr"))


def percentile_of_prior(returns: DataFrame, rows: int = 60, least: int = 5) -> DataFrame:
    """(ticker, date, pct): share of the rows before that lie below the row's return, the row itself left out."""
    w = Window.partitionBy("ticker").orderBy("seq").rangeBetween(-rows, -1)
    prior = returns.where("ret is not null").withColumn("before", F.collect_list("ret").over(w))
    below = F.size(F.filter("before", lambda x: x < F.col("ret")))
    return prior.where(F.size("before") >= least).select("ticker", "date", (100.0 * below / F.size("before")).alias("pct"))


def compounded_ytd(returns: DataFrame) -> DataFrame:
    """(ticker, date, ytd): returns of the year compounded up to each date."""
    w = Window.partitionBy("ticker", F.year("date")).orderBy("seq")
    return returns.where("ret is not null").select("ticker", "date", (100 * (F.exp(F.sum(F.log1p(F.col("ret") / 100)).over(w)) - 1)).alias("ytd"))


def aliased(prices: DataFrame, unit: DataFrame, aliases: DataFrame) -> DataFrame:
    """prices (date, ticker, close) with the series of aliased symbols: the alias's closes times unit price over its last close.

    unit: (symbol, unit). Series of symbols that are aliased are replaced. aliases: (symbol, alias), a fixed table.
    """
    last = prices.groupBy(F.col("ticker").alias("alias")).agg(F.max_by("close", "date").alias("last"))
    scale = F.broadcast(aliases).join(last, "alias").join(unit, "symbol").select("symbol", F.col("alias").alias("ticker"), "unit", "last")
    new = prices.join(scale, "ticker").select("date", F.col("symbol").alias("ticker"), F.try_divide(F.col("close") * F.col("unit"), F.col("last")).alias("close"))
    own = prices.join(F.broadcast(aliases.select(F.col("symbol").alias("ticker"))), "ticker", "left_anti")
    return own.select("date", "ticker", "close").union(new)
