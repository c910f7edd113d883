"""Positions and their attribution by peers, tags, look-through and scenario."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_move(returns: DataFrame) -> DataFrame:
    """(ticker, close, prev, ret): each ticker's last return with the prices at its ends, stale or not."""
    w = Window.partitionBy("ticker").orderBy("seq")
    v = returns.withColumn("prev", F.lag("close").over(w)).where("ret is not null")
    return v.groupBy("ticker").agg(F.max(F.struct("seq", "close", "prev", "ret")).alias("m")).select("ticker", "m.close", "m.prev", "m.ret")


def aggregate_lots(lots: DataFrame) -> DataFrame:
    """(symbol, quantity, market_value, avg_price, open_pnl, accounts): lots rolled up; closed symbols go.

    The price is weighted by absolute value; open_pnl is null if any lot's is.
    """
    size = F.abs(F.col("market_value"))
    g = lots.groupBy("symbol").agg(
        F.round(F.sum("quantity")).cast("bigint").alias("quantity"),
        F.sum("market_value").cast("double").alias("market_value"),
        F.try_divide(F.sum(F.col("avg_price") * size.cast("double")), F.sum(size).cast("double")).alias("avg_price"),
        F.when(F.count("open_pnl") == F.count("*"), F.sum("open_pnl").cast("double")).alias("open_pnl"),
        F.array_join(F.array_sort(F.collect_set("account")), ", ").alias("accounts"),
    )
    return g.where("quantity <> 0")


def positions(held: DataFrame, move: DataFrame) -> DataFrame:
    """(symbol, quantity, close, ret, mtm, bod, weight, bod_weight): values at the last price and the one before, weights of gross."""
    j = held.join(move, F.col("symbol") == F.col("ticker"), "left")
    j = j.withColumn("mtm", F.coalesce(F.col("quantity") * F.col("close"), "market_value")).withColumn("bod", F.coalesce(F.col("quantity") * F.col("prev"), "market_value"))
    gross = j.agg(F.sum(F.abs("mtm")).alias("g"), F.sum(F.abs("bod")).alias("h"))
    j = j.join(F.broadcast(gross))  # one row
    return j.select("symbol", "quantity", "close", "ret", "mtm", "bod", (F.col("mtm") / F.col("g")).alias("weight"), (F.col("bod") / F.col("h")).alias("bod_weight"))


def peer_attribution(held: DataFrame, peers: DataFrame, least: int) -> DataFrame:
    """(symbol, peer_group, ret, vs_peers); peers: (ticker, peer_group, ret); null against fewer than least peers."""
    g = peers.groupBy("peer_group").agg(F.avg("ret").alias("peer_ret"), F.count("ret").alias("peers"))
    own = peers.select(F.col("ticker").alias("symbol"), "peer_group")
    j = held.select("symbol", "ret").join(own, "symbol", "left").join(g, "peer_group", "left")
    return j.select("symbol", F.coalesce("peer_group", F.lit("Portfolio-Specific")).alias("peer_group"), "ret", F.when(F.col("peers") >= least, F.col("ret") - F.col("peer_ret")).alias("vs_peers"))


def tag_tilts(tagged: DataFrame, least: int) -> DataFrame:
    """(axis, tag, n, mean_ret, tilt): mean return of each tag's funds against that of all tagged funds."""
    all_funds = tagged.select("ticker", "ret").distinct().agg(F.avg("ret").alias("u"))
    g = tagged.groupBy("axis", "tag").agg(F.count("*").alias("n"), F.avg("ret").alias("mean_ret")).where(F.col("n") >= least)
    return g.join(F.broadcast(all_funds)).select("axis", "tag", "n", "mean_ret", (F.col("mean_ret") - F.col("u")).alias("tilt"))


def tag_grid(tagged: DataFrame, first: str, second: str, least: int) -> DataFrame:
    """(a, b, n, mean_ret) of the funds with tag a on the first axis and b on the second."""
    a = tagged.where(F.col("axis") == first).select("ticker", "ret", F.col("tag").alias("a"))
    b = tagged.where(F.col("axis") == second).select("ticker", F.col("tag").alias("b"))
    return a.join(b, "ticker").groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("ret").alias("mean_ret")).where(F.col("n") >= least)


def tag_active(book: DataFrame, tags: DataFrame) -> DataFrame:
    """(axis, tag, book, bench, tilt): weights by tag of a book (ticker, w) against those of all tagged tickers."""
    own = book.join(tags, "ticker").groupBy("axis", "tag").agg(F.sum("w").alias("book"))
    n = tags.agg(F.count_distinct("ticker").alias("n"))
    bench = tags.groupBy("axis", "tag").agg(F.count("*").alias("k")).join(F.broadcast(n)).select("axis", "tag", (F.col("k") / F.col("n")).alias("bench"))
    j = own.join(bench, ["axis", "tag"], "full_outer").fillna(0.0, ["book", "bench"])
    return j.select("axis", "tag", "book", "bench", (F.col("book") - F.col("bench")).alias("tilt"))


def tag_pnl(contributions: DataFrame, tags: DataFrame) -> DataFrame:
    """(axis, tag, bps, n): contributions (ticker, bps) split equally among a ticker's tags of one axis."""
    share = F.col("bps") / F.count("*").over(Window.partitionBy("ticker", "axis"))
    return contributions.join(tags, "ticker").withColumn("bps", share).groupBy("axis", "tag").agg(F.sum("bps").alias("bps"), F.count_distinct("ticker").alias("n"))


def eta_squared(values: DataFrame) -> DataFrame:
    """(axis, eta2, dispersion) of values (axis, v, ret): between-group over total sum of squares; population deviation."""
    total = values.groupBy("axis").agg(F.avg("ret").alias("g"), (F.sum(F.col("ret") * F.col("ret")) - F.count("*") * F.avg("ret") * F.avg("ret")).alias("total"), F.stddev_pop("ret").alias("dispersion"))
    group = values.groupBy("axis", "v").agg(F.count("*").alias("n"), F.avg("ret").alias("m"))
    j = group.join(total, "axis")
    return j.groupBy("axis").agg(F.try_divide(F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), F.lit(2))), F.max("total")).alias("eta2"), F.max("dispersion").alias("dispersion"))


def look_through(held: DataFrame, classes: DataFrame) -> DataFrame:
    """(symbol, class, value, ret): a position in equal parts of its classes."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    return held.join(classes, "symbol").select("symbol", "class", (F.col("mtm") / n).alias("value"), "ret")


def shocked(slices: DataFrame, shocks: DataFrame, overrides: DataFrame) -> DataFrame:
    """(scenario, symbol, pnl): by the override of the symbol, else the shock of the class, else that of no class, else none.

    The scenario tables are small by nature: one row for each scenario and class or symbol.
    """
    names = F.broadcast(shocks.select("scenario").distinct())
    j = slices.crossJoin(names)  # scenarios are a handful
    j = j.join(F.broadcast(overrides.withColumnRenamed("pct", "own")), ["scenario", "symbol"], "left")
    j = j.join(F.broadcast(shocks.where("class is not null").withColumnRenamed("pct", "of_class")), ["scenario", "class"], "left")
    j = j.join(F.broadcast(shocks.where("class is null").select("scenario", F.col("pct").alias("other"))), "scenario", "left")
    return j.select("scenario", "symbol", (F.col("value") * F.coalesce("own", "of_class", "other", F.lit(0.0)) / 100).alias("pnl"))


def liquidity_ladder(held: DataFrame, adv: DataFrame) -> DataFrame:
    """(bucket, n, value, pct) by the periods that selling at the average volume (symbol, adv) takes."""
    days = F.try_divide(F.abs("quantity"), F.col("adv"))
    bucket = F.when(days.isNull(), "unknown").when(days <= 5, "week").when(days <= 20, "month").otherwise("longer")
    g = held.join(adv, "symbol", "left").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.abs("mtm")).alias("value"))
    total = held.agg(F.sum(F.abs("mtm")).alias("gross"))
    return g.join(F.broadcast(total)).select("bucket", "n", F.round("value", 2).alias("value"), F.round(100 * F.col("value") / F.col("gross"), 6).alias("pct"))


def blended(mix: DataFrame, proxies: DataFrame) -> DataFrame:
    """(fund, ret, priced): weighted proxy returns (class, ret) of a mix (fund, class, w) over its priced weight, which is given too."""
    j = mix.join(proxies, "class", "left").withColumn("known", F.when(F.col("ret").isNotNull(), F.col("w")))
    return j.groupBy("fund").agg(F.try_divide(F.sum(F.col("w") * F.col("ret")), F.sum("known")).alias("ret"), F.coalesce(F.sum("known"), F.lit(0.0)).alias("priced"))


#: Classes that are divided into regions.
REGIONAL = ("Equities", "Bonds")


def regional_slices(held: DataFrame, own: DataFrame, classes: DataFrame, regions: DataFrame, cash: float = 0.0) -> DataFrame:
    """(symbol, class, region, value, ret): positions looked through by fractions, and a slice of cash.

    classes: (symbol, class, fraction) and regions: (symbol, class, region, share), of funds that are looked through; others
    are whole in their own class and region (own: symbol, class, region), `Other` without one. Other classes than REGIONAL have no region.
    """
    regional = F.col("class").isin(*REGIONAL)
    h = held.where("mtm is not null").select("symbol", "mtm", "ret")
    mixed = h.join(classes.where("fraction <> 0"), "symbol").join(regions.where(regional).where("share <> 0"), ["symbol", "class"], "left")
    mixed = mixed.select("symbol", "class", "region", (F.col("mtm") * F.col("fraction") * F.coalesce("share", F.lit(1.0))).alias("value"), "ret")
    whole = h.join(classes.select("symbol").distinct(), "symbol", "left_anti").join(own, "symbol", "left")
    whole = whole.select("symbol", F.coalesce("class", F.lit("Other")).alias("class"), F.when(regional, F.col("region")).alias("region"), F.col("mtm").alias("value"), "ret")
    slices = mixed.union(whole)
    if not cash:
        return slices
    return slices.union(held.sparkSession.createDataFrame([("CASH", "Cash", None, float(cash), 0.0)], "symbol string, class string, region string, value double, ret double"))


def regional_allocation(slices: DataFrame) -> DataFrame:
    """(level, parent, label, n, value, pct, ret): classes (level 0) and their regions (level 1); percent of the net total.

    The return is over the gross value of the slices that have one.
    """
    s = slices.withColumn("region", F.when(F.col("class").isin(*REGIONAL), F.coalesce("region", F.lit("Unclassified"))))
    known = F.when(F.col("ret").isNotNull(), F.col("value"))
    g = s.groupingSets([["class"], ["class", "region"]], "class", "region").agg(F.grouping("region").alias("up"), F.count("*").alias("n"), F.sum("value").alias("value"), F.try_divide(F.sum(known * F.col("ret")), F.sum(F.abs(known))).alias("ret"))
    up = F.col("up") == 1
    g = g.where(up | F.col("class").isin(*REGIONAL)).join(F.broadcast(s.agg(F.sum("value").alias("total"))))  # one row
    return g.select((1 - F.col("up")).cast("int").alias("level"), F.when(~up, F.col("class")).alias("parent"), F.when(up, F.col("class")).otherwise(F.col("region")).alias("label"), "n", "value", F.try_divide(100 * F.col("value"), F.col("total")).alias("pct"), "ret")


def shocked_by_region(slices: DataFrame, shocks: DataFrame, overrides: DataFrame) -> DataFrame:
    """(scenario, symbol, pnl): by the override of the symbol, else the shock of class and region, else that of the class, else none.

    The scenario tables are small by nature: one row for each scenario and class, region or symbol.
    """
    j = slices.crossJoin(F.broadcast(shocks.select("scenario").distinct()))  # scenarios are a handful
    j = j.join(F.broadcast(overrides.withColumnRenamed("pct", "own")), ["scenario", "symbol"], "left")
    j = j.join(F.broadcast(shocks.where("region is not null").withColumnRenamed("pct", "of_region")), ["scenario", "class", "region"], "left")
    j = j.join(F.broadcast(shocks.where("region is null").select("scenario", "class", F.col("pct").alias("of_class"))), ["scenario", "class"], "left")
    return j.select("scenario", "symbol", (F.col("value") * F.coalesce("own", "of_region", "of_class", F.lit(0.0)) / 100).alias("pnl"))
