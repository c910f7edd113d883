"""Portfolio queries: lots, positions, attribution, tags, allocation and scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finspan.operators import portfolio as O
from finspan.operators import returns as R
from finspan.plans.market import FACTORS, MARKET, TRAIL, factors, market, rets
from finspan.plans.sqlbase import LOTS, TAGS, history, registry
from finspan.sources import panels as P
from finspan.sources.panels import rounded

QUERIES, ORACLES, query = registry()


def latest(spark: SparkSession, sf: str) -> DataFrame:
    """(ticker, close, prev, ret, tier): last price, the one before, the return between, and the type most of whose parts carry the brand."""
    return O.last_move(rets(spark, sf))


def positions(spark: SparkSession, sf: str) -> DataFrame:
    return O.positions(O.aggregate_lots(P.lots(spark, sf)), latest(spark, sf))


MOVE = f"""{history()}, v AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY seq) AS prev FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY seq DESC) AS k FROM v WHERE ret IS NOT NULL), move AS (SELECT ticker, close, prev, ret FROM k WHERE k = 1)"""
HELD = f"""{LOTS}, held AS (SELECT symbol, CAST(round(sum(quantity)) AS BIGINT) AS quantity, CAST(sum(market_value) AS DOUBLE) AS market_value,
sum(avg_price * abs(CAST(market_value AS DOUBLE))) / nullif(CAST(sum(abs(market_value)) AS DOUBLE), 0) AS avg_price,
CASE WHEN count(open_pnl) = count(*) THEN CAST(sum(open_pnl) AS DOUBLE) END AS open_pnl, string_agg(DISTINCT account, ', ' ORDER BY account) AS accounts FROM lots GROUP BY 1 HAVING sum(quantity) <> 0)"""
POS = f"""{MOVE}, {HELD}, pos AS (SELECT symbol, h.quantity, close, ret, coalesce(h.quantity * close, h.market_value) AS mtm, coalesce(h.quantity * prev, h.market_value) AS bod,
coalesce(h.quantity * close, h.market_value) / sum(abs(coalesce(h.quantity * close, h.market_value))) OVER () AS weight,
coalesce(h.quantity * prev, h.market_value) / sum(abs(coalesce(h.quantity * prev, h.market_value))) OVER () AS bod_weight FROM held h LEFT JOIN move m ON m.ticker = h.symbol)"""


@query(f"WITH {HELD} SELECT symbol, quantity, market_value, round(avg_price, 4) AS avg_price, open_pnl, accounts FROM held")
def aggregate_holdings(spark, sf):
    return O.aggregate_lots(P.lots(spark, sf)).withColumn("avg_price", F.round("avg_price", 4))


@query(f"WITH {POS} SELECT symbol, quantity, round(close, 6) AS close, round(ret, 6) AS ret, round(mtm, 2) AS mtm, round(weight, 6) AS weight, round(bod_weight * ret * 100, 6) AS contribution_bps FROM pos")
def positions_mtm(spark, sf):
    p = positions(spark, sf)
    return p.select("symbol", "quantity", F.round("close", 6).alias("close"), F.round("ret", 6).alias("ret"), F.round("mtm", 2).alias("mtm"), F.round("weight", 6).alias("weight"), F.round(F.col("bod_weight") * F.col("ret") * 100, 6).alias("contribution_bps"))


@query(
    f"""WITH {POS} SELECT count(*) AS n, count(*) FILTER (mtm > 0) AS n_long, count(*) FILTER (mtm < 0) AS n_short, round(sum(CASE WHEN mtm > 0 THEN mtm ELSE 0 END), 2) AS long_value,
round(-sum(CASE WHEN mtm < 0 THEN mtm ELSE 0 END), 2) AS short_value, round(sum(abs(mtm)), 2) AS gross, round(sum(mtm), 2) AS net, round(sum(bod_weight * ret), 6) AS ret FROM pos"""
)
def portfolio_summary(spark, sf):
    m = F.col("mtm")
    return positions(spark, sf).agg(
        F.count("*").alias("n"),
        F.count_if(m > 0).alias("n_long"),
        F.count_if(m < 0).alias("n_short"),
        F.round(F.sum(F.when(m > 0, m).otherwise(0.0)), 2).alias("long_value"),
        F.round(-F.sum(F.when(m < 0, m).otherwise(0.0)), 2).alias("short_value"),
        F.round(F.sum(F.abs(m)), 2).alias("gross"),
        F.round(F.sum("mtm"), 2).alias("net"),
        F.round(F.sum(F.col("bod_weight") * F.col("ret")), 6).alias("ret"),
    )


@query(
    f"""WITH {MOVE}, {LOTS}, s AS (SELECT broker, account, CAST(sum(quantity) AS DOUBLE) AS q, symbol FROM lots GROUP BY 1, 2, 4), j AS (SELECT s.*, q * close AS mtm, q * prev AS bod, ret FROM s JOIN move m ON m.ticker = s.symbol)
SELECT coalesce(broker, 'TOTAL') AS broker, coalesce(account, 'TOTAL') AS account, count(*) AS n, round(sum(mtm), 2) AS mtm, round(sum(bod * ret) / nullif(sum(abs(bod)), 0), 6) AS ret FROM j GROUP BY GROUPING SETS ((broker, account), ())"""
)
def subportfolios(spark, sf):
    s = P.lots(spark, sf).groupBy("broker", "account", "symbol").agg(F.sum("quantity").alias("q"))
    j = s.join(latest(spark, sf), F.col("symbol") == F.col("ticker")).withColumn("mtm", F.col("q") * F.col("close")).withColumn("bod", F.col("q") * F.col("prev"))
    g = j.groupingSets([["broker", "account"], []], "broker", "account").agg(F.count("*").alias("n"), F.round(F.sum("mtm"), 2).alias("mtm"), F.round(F.try_divide(F.sum(F.col("bod") * F.col("ret")), F.sum(F.abs("bod"))), 6).alias("ret"))
    return g.withColumn("broker", F.coalesce("broker", F.lit("TOTAL"))).withColumn("account", F.coalesce("account", F.lit("TOTAL")))


@query(
    f"""WITH {POS}, {TRAIL}, {FACTORS}, b AS (SELECT ticker, factor, regr_slope(ret, fret) AS beta, regr_count(ret, fret) AS n FROM t JOIN f ON t.seq = f.seq GROUP BY 1, 2)
SELECT factor, round(sum(weight * beta), 6) AS exposure, count(*) AS n FROM b JOIN pos ON symbol = ticker WHERE n >= 30 GROUP BY 1"""
)
def factor_exposure(spark, sf):
    t = R.trailing(rets(spark, sf), 60).join(factors(spark, sf), "seq")
    b = t.groupBy("ticker", "factor").agg(F.regr_slope("ret", "fret").alias("beta"), F.regr_count("ret", "fret").alias("n")).where("n >= 30")
    j = b.drop("n").join(positions(spark, sf), F.col("symbol") == F.col("ticker"))
    return rounded(j.groupBy("factor").agg(F.sum(F.col("weight") * F.col("beta")).alias("exposure"), F.count("*").alias("n")))


PEERS = f"""{POS}, {TAGS}, first_tag AS (SELECT ticker, min(tag) AS peer_group FROM tags WHERE ord = 1 GROUP BY 1), g AS (SELECT peer_group, avg(ret) AS peer_ret, count(ret) AS peers FROM move JOIN first_tag USING (ticker) GROUP BY 1)"""


def peers(spark: SparkSession, sf: str) -> DataFrame:
    """(ticker, peer_group): a brand's first sector tag."""
    return P.tags(spark, sf).where("ord = 1").groupBy("ticker").agg(F.min("tag").alias("peer_group"))


@query(f"WITH {PEERS} SELECT symbol, coalesce(peer_group, 'Portfolio-Specific') AS peer_group, round(pos.ret, 6) AS ret, CASE WHEN peers >= 3 THEN round(pos.ret - peer_ret, 6) END AS vs_peers FROM pos LEFT JOIN first_tag ON ticker = symbol LEFT JOIN g USING (peer_group)")
def peer_attribution(spark, sf):
    return rounded(O.peer_attribution(positions(spark, sf), latest(spark, sf).join(peers(spark, sf), "ticker"), least=3))


@query(
    f"""WITH {history('x', 'month', "p_brand || '/' || p_type")}, {POS}, a AS (SELECT split_part(ticker, '/', 1) AS theme, avg(ret) AS mean_ret, count(ret) AS n FROM x JOIN x_l ON seq = last WHERE ret IS NOT NULL GROUP BY 1)
SELECT theme, round(mean_ret, 6) AS mean_ret, n FROM a WHERE theme NOT IN (SELECT symbol FROM pos WHERE weight > 0.04) ORDER BY abs(round(a.mean_ret, 6)) DESC, theme LIMIT 10"""
)
def unheld_themes(spark, sf):
    """The themes that moved most and are not among the larger longs (left anti join)."""
    x = R.trailing(rets(spark, sf, "month", P.CROSS), 1).where("ret is not null")
    a = x.groupBy(F.split_part("ticker", F.lit("/"), F.lit(1)).alias("theme")).agg(F.round(F.avg("ret"), 6).alias("mean_ret"), F.count("ret").alias("n"))
    held = positions(spark, sf).where("weight > 0.04").select(F.col("symbol").alias("theme"))
    return a.join(held, "theme", "left_anti").orderBy(F.desc(F.abs("mean_ret")), "theme").limit(10)


CONTRIB = f"{POS}, c AS (SELECT symbol, round(bod_weight * ret * 100, 6) AS bps FROM pos WHERE ret IS NOT NULL)"


@query(f"WITH {CONTRIB} (SELECT symbol, bps, 'top' AS side FROM c WHERE bps > 0 ORDER BY c.bps DESC, symbol LIMIT 10) UNION ALL (SELECT symbol, bps, 'bottom' AS side FROM c WHERE bps < 0 ORDER BY c.bps, symbol LIMIT 10)")
def top_contributors(spark, sf):
    c = positions(spark, sf).where("ret is not null").select("symbol", F.round(F.col("bod_weight") * F.col("ret") * 100, 6).alias("bps"))
    up = c.where("bps > 0").orderBy(F.desc("bps"), "symbol").limit(10).withColumn("side", F.lit("top"))
    return up.union(c.where("bps < 0").orderBy("bps", "symbol").limit(10).withColumn("side", F.lit("bottom")))


@query(f"WITH {POS} SELECT count(*) AS n, count(*) FILTER (ret > 0) AS n_up, round(100.0 * count(*) FILTER (ret * mtm > 0) / nullif(count(ret), 0), 6) AS hit_rate, round(1 / sum(power(abs(weight), 2)), 6) AS effective_n FROM pos")
def concentration(spark, sf):
    """Breadth and hit rate of the book, and the inverse of its Herfindahl index."""
    p = positions(spark, sf)
    return rounded(p.agg(F.count("*").alias("n"), F.count_if(F.col("ret") > 0).alias("n_up"), F.try_divide(100.0 * F.count_if(F.col("ret") * F.col("mtm") > 0), F.count("ret")).alias("hit_rate"), (1 / F.sum(F.pow(F.abs("weight"), F.lit(2)))).alias("effective_n")))


# tags


@query(f"WITH {TAGS} SELECT ticker, tag, axis, CAST(ord AS INTEGER) AS ord FROM tags")
def tag_explode(spark, sf):
    return P.tags(spark, sf)


TAGGED = f"{MOVE}, {TAGS}, tagged AS (SELECT t.*, ret FROM tags t JOIN move USING (ticker) WHERE ret IS NOT NULL)"


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    return P.tags(spark, sf).join(latest(spark, sf).where("ret is not null").select("ticker", "ret"), "ticker")


@query(f"WITH {TAGGED}, u AS (SELECT avg(ret) AS u FROM (SELECT DISTINCT ticker, ret FROM tagged)) SELECT axis, tag, count(*) AS n, round(avg(ret), 6) AS mean_ret, round(avg(ret) - max(u), 6) AS tilt FROM tagged, u GROUP BY 1, 2 HAVING count(*) >= 3")
def tag_tilts(spark, sf):
    return rounded(O.tag_tilts(tagged(spark, sf), 3))


@query(f"WITH {TAGGED} SELECT round(avg(ret) FILTER (tag = 'hot') - avg(ret) FILTER (tag = 'cold'), 6) AS hot_cold, round(avg(ret) FILTER (tag IN ('red', 'blue')) - avg(ret) FILTER (tag = 'big'), 6) AS color_big FROM tagged")
def style_spreads(spark, sf):
    t = tagged(spark, sf)
    mean = lambda *x: F.avg(F.when(F.col("tag").isin(*x), F.col("ret")))
    return rounded(t.agg((mean("hot") - mean("cold")).alias("hot_cold"), (mean("red", "blue") - mean("big")).alias("color_big")))


@query(f"WITH {TAGGED} SELECT s.tag AS style, k.tag AS sector, count(*) AS n, round(avg(s.ret), 6) AS mean_ret FROM tagged s JOIN tagged k ON s.ticker = k.ticker WHERE s.axis = 'Style' AND k.axis = 'Sector' GROUP BY 1, 2 HAVING count(*) >= 5")
def region_sector_grid(spark, sf):
    return rounded(O.tag_grid(tagged(spark, sf), "Style", "Sector", 5).withColumnsRenamed({"a": "style", "b": "sector"}))


BOOK = f"{POS}, {TAGS}, w AS (SELECT axis, tag, sum(abs(weight)) AS w FROM pos JOIN tags ON ticker = symbol WHERE mtm > 0 GROUP BY 1, 2), b AS (SELECT axis, tag, 1.0 * count(*) / (SELECT count(DISTINCT ticker) FROM tags) AS w FROM tags GROUP BY 1, 2)"
TILT = "tilt AS (SELECT coalesce(w.axis, b.axis) AS axis, coalesce(w.tag, b.tag) AS tag, coalesce(w.w, 0) AS book, coalesce(b.w, 0) AS bench, coalesce(w.w, 0) - coalesce(b.w, 0) AS tilt FROM w FULL JOIN b ON w.axis = b.axis AND w.tag = b.tag)"


def active(spark: SparkSession, sf: str) -> DataFrame:
    book = positions(spark, sf).where("mtm > 0").select(F.col("symbol").alias("ticker"), F.abs("weight").alias("w"))
    return O.tag_active(book, P.tags(spark, sf))


@query(f"WITH {BOOK}, {TILT} SELECT axis, tag, round(book, 6) AS book, round(bench, 6) AS bench, round(tilt, 6) AS tilt FROM tilt")
def tag_active_tilts(spark, sf):
    return rounded(active(spark, sf))


@query(
    f"""WITH {BOOK}, {TILT}, tg AS (SELECT t.*, ret FROM tags t JOIN move USING (ticker) WHERE ret IS NOT NULL), u AS (SELECT avg(ret) AS u FROM (SELECT DISTINCT ticker, ret FROM tg)),
mt AS (SELECT axis, tag, avg(ret) - max(u) AS mtilt FROM tg, u GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT t.axis, t.tag, round(tilt, 6) AS tilt, round(mtilt, 6) AS market_tilt, CASE WHEN mtilt IS NULL THEN 'no read' WHEN round(tilt, 6) * round(mtilt, 6) > 0 THEN 'WITH' ELSE 'AGAINST' END AS verdict FROM tilt t LEFT JOIN mt ON t.axis = mt.axis AND t.tag = mt.tag"""
)
def tag_bridge(spark, sf):
    m = O.tag_tilts(tagged(spark, sf), 3).select("axis", "tag", F.round("tilt", 6).alias("market_tilt"))
    j = rounded(active(spark, sf)).select("axis", "tag", "tilt").join(m, ["axis", "tag"], "left")
    return j.withColumn("verdict", F.when(F.col("market_tilt").isNull(), "no read").when(F.col("tilt") * F.col("market_tilt") > 0, "WITH").otherwise("AGAINST"))


@query(
    f"""WITH {POS}, {TAGS}, s AS (SELECT symbol, axis, tag, bod_weight * ret * 100 / count(*) OVER (PARTITION BY symbol, axis) AS bps FROM pos JOIN tags ON ticker = symbol WHERE ret IS NOT NULL)
SELECT axis, tag, round(sum(bps), 6) AS bps, count(DISTINCT symbol) AS n FROM s GROUP BY 1, 2"""
)
def tag_pnl(spark, sf):
    p = positions(spark, sf).where("ret is not null").select(F.col("symbol").alias("ticker"), (F.col("bod_weight") * F.col("ret") * 100).alias("bps"))
    return rounded(O.tag_pnl(p, P.tags(spark, sf)))


@query(
    f"""WITH {history('x', 'month', "p_brand || '/' || p_type")}, a AS (SELECT ret, split_part(ticker, '/', 1) AS brand, split_part(ticker, '/', 2) AS kind FROM x JOIN x_l ON seq = last WHERE ret IS NOT NULL), g AS (SELECT avg(ret) AS g, sum(ret * ret) - count(*) * avg(ret) * avg(ret) AS total, stddev_pop(ret) AS sd FROM a)
SELECT axis, round(sum(n * power(m - g, 2)) / nullif(max(total), 0), 6) AS eta2, round(max(sd), 6) AS dispersion FROM (SELECT 'brand' AS axis, brand AS v, count(*) AS n, avg(ret) AS m FROM a GROUP BY brand UNION ALL SELECT 'type', kind, count(*), avg(ret) FROM a GROUP BY kind), g GROUP BY axis"""
)
def eta_squared(spark, sf):
    """Share of the variance of returns that lies between brands, and between types."""
    a = R.trailing(rets(spark, sf, "month", P.CROSS), 1).where("ret is not null")
    a = a.select("ret", F.explode(F.map_from_arrays(F.array(F.lit("brand"), F.lit("type")), F.split("ticker", "/"))).alias("axis", "v"))
    return rounded(O.eta_squared(a))


# allocation and scenarios

SLICES = f"{POS}, {TAGS}, slices AS (SELECT symbol, tag AS class, mtm / count(*) OVER (PARTITION BY symbol) AS value, ret FROM pos JOIN tags ON ticker = symbol WHERE axis = 'Style')"


def slices(spark: SparkSession, sf: str) -> DataFrame:
    """(symbol, class, value, ret): positions looked through to equal parts by their style tags."""
    return O.look_through(positions(spark, sf), P.tags(spark, sf).where("axis = 'Style'").select(F.col("ticker").alias("symbol"), F.col("tag").alias("class")))


@query(f"WITH {SLICES} SELECT coalesce(class, 'TOTAL') AS class, round(sum(value), 2) AS value, round(100 * sum(value) / (SELECT sum(value) FROM slices), 6) AS pct, round(sum(CASE WHEN ret IS NOT NULL THEN value * ret END) / nullif(sum(CASE WHEN ret IS NOT NULL THEN abs(value) END), 0), 6) AS ret FROM slices GROUP BY GROUPING SETS ((class), ())")
def asset_allocation(spark, sf):
    s = slices(spark, sf)
    total = s.agg(F.sum("value").alias("total"))
    known = F.col("ret").isNotNull()
    g = s.groupingSets([["class"], []], "class").agg(F.sum("value").alias("value"), F.try_divide(F.sum(F.when(known, F.col("value") * F.col("ret"))), F.sum(F.when(known, F.abs("value")))).alias("ret"))
    return g.join(F.broadcast(total)).select(F.coalesce("class", F.lit("TOTAL")).alias("class"), F.round("value", 2).alias("value"), F.round(100 * F.col("value") / F.col("total"), 6).alias("pct"), F.round("ret", 6).alias("ret"))


#: Shocks in percent by scenario and class (none: all other classes), and overrides by symbol.
SHOCKS = [("crash", "hot", -30.0), ("crash", "cold", -12.0), ("crash", None, -20.0), ("rally", "red", 15.0), ("rally", "big", 8.0), ("calm", None, 1.0)]
OVERRIDES = [("crash", "Brand#1", -50.0), ("rally", "Brand#2", 0.0)]
_SHOCKED = f"""{SLICES}, shock(scenario, class, pct) AS (VALUES {", ".join(f"('{a}', {f"'{b}'" if b else "NULL"}, {c})" for a, b, c in SHOCKS)}),
override(scenario, symbol, pct) AS (VALUES {", ".join(f"('{a}', '{b}', {c})" for a, b, c in OVERRIDES)}),
hit AS (SELECT k.scenario, s.symbol, s.value * coalesce(o.pct, c.pct, d.pct, 0) / 100 AS pnl FROM (SELECT DISTINCT scenario FROM shock) k CROSS JOIN slices s LEFT JOIN override o ON o.scenario = k.scenario AND o.symbol = s.symbol
LEFT JOIN shock c ON c.scenario = k.scenario AND c.class = s.class LEFT JOIN shock d ON d.scenario = k.scenario AND d.class IS NULL)"""


def shocked(spark: SparkSession, sf: str) -> DataFrame:
    return O.shocked(slices(spark, sf), spark.createDataFrame(SHOCKS, "scenario string, class string, pct double"), spark.createDataFrame(OVERRIDES, "scenario string, symbol string, pct double"))


@query(f"WITH {_SHOCKED} SELECT scenario, round(sum(pnl), 2) AS pnl, round(100 * sum(pnl) / (SELECT sum(abs(mtm)) FROM pos), 6) AS pct_of_gross FROM hit GROUP BY 1")
def scenario_impact(spark, sf):
    gross = positions(spark, sf).agg(F.sum(F.abs("mtm")).alias("gross"))
    g = shocked(spark, sf).groupBy("scenario").agg(F.sum("pnl").alias("pnl"))
    return g.join(F.broadcast(gross)).select("scenario", F.round("pnl", 2).alias("pnl"), F.round(100 * F.col("pnl") / F.col("gross"), 6).alias("pct_of_gross"))


@query(
    f"""WITH {_SHOCKED}, s AS (SELECT scenario, symbol, round(sum(pnl), 2) AS pnl FROM hit GROUP BY 1, 2), ranked AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY pnl, symbol) AS worst, row_number() OVER (PARTITION BY scenario ORDER BY pnl DESC, symbol) AS best FROM s)
SELECT scenario, symbol, pnl, CASE WHEN worst <= 3 AND pnl < -50000 THEN 'worst' ELSE 'best' END AS side FROM ranked WHERE (worst <= 3 AND pnl < -50000) OR (best <= 3 AND pnl > 50000)"""
)
def scenario_top_symbols(spark, sf):
    s = shocked(spark, sf).groupBy("scenario", "symbol").agg(F.round(F.sum("pnl"), 2).alias("pnl"))
    w = Window.partitionBy("scenario")
    s = s.withColumn("worst", F.row_number().over(w.orderBy("pnl", "symbol"))).withColumn("best", F.row_number().over(w.orderBy(F.desc("pnl"), "symbol")))
    low = (F.col("worst") <= 3) & (F.col("pnl") < -50000)
    return s.where(low | ((F.col("best") <= 3) & (F.col("pnl") > 50000))).select("scenario", "symbol", "pnl", F.when(low, "worst").otherwise("best").alias("side"))


#: Funds that are looked through, their fractions by class and by region, and the cash beside the book.
MIX = [("Brand#1", "Equities", 0.5), ("Brand#1", "Bonds", 0.3), ("Brand#1", "Cash", 0.2), ("Brand#2", "Equities", 1.0), ("Brand#2", "Bonds", 0.0)]
REGIONS = [("Brand#1", "Equities", "US", 0.6), ("Brand#1", "Equities", "EM", 0.4), ("Brand#1", "Bonds", "EM", 1.0)]
CASH = 50_000.0
_OWN = "CASE right(p_brand, 1) WHEN '3' THEN 'Equities' WHEN '4' THEN 'Equities' WHEN '5' THEN 'Bonds' WHEN '6' THEN 'Commodities' ELSE 'Equities' END"
_REGION = "CASE right(p_brand, 1) WHEN '3' THEN 'US' WHEN '4' THEN 'International' WHEN '5' THEN 'US' WHEN '6' THEN 'US' END"
_REGIONAL = f"""{POS}, mix(symbol, class, fraction) AS (VALUES {", ".join(map(str, MIX))}), reg(symbol, class, region, share) AS (VALUES {", ".join(map(str, REGIONS))}), own AS (SELECT DISTINCT p_brand AS symbol, {_OWN} AS class, {_REGION} AS region FROM part),
sl AS (SELECT p.symbol, c.class, g.region, mtm * c.fraction * coalesce(g.share, 1) AS value, ret FROM pos p JOIN mix c ON c.symbol = p.symbol AND c.fraction <> 0 LEFT JOIN reg g ON g.symbol = c.symbol AND g.class = c.class
UNION ALL SELECT p.symbol, o.class, CASE WHEN o.class IN ('Equities', 'Bonds') THEN o.region END, mtm, ret FROM pos p JOIN own o ON o.symbol = p.symbol WHERE p.symbol NOT IN (SELECT symbol FROM mix) UNION ALL SELECT 'CASH', 'Cash', NULL, {CASH}, 0.0)"""


def regional(spark: SparkSession, sf: str) -> DataFrame:
    """(symbol, class, region, value, ret) of the book and its cash."""
    own = P.table(spark, sf, "part").select(F.col("p_brand").alias("symbol"), F.expr(_OWN).alias("class"), F.expr(_REGION).alias("region")).distinct()
    mix, regions = spark.createDataFrame(MIX, "symbol string, class string, fraction double"), spark.createDataFrame(REGIONS, "symbol string, class string, region string, share double")
    return O.regional_slices(positions(spark, sf), own, mix, regions, CASH)


@query(
    f"""WITH {_REGIONAL}, s AS (SELECT *, CASE WHEN class IN ('Equities', 'Bonds') THEN coalesce(region, 'Unclassified') END AS part FROM sl), g AS (SELECT 0 AS level, NULL AS parent, class AS label, value, ret FROM s UNION ALL SELECT 1, class, part, value, ret FROM s WHERE part IS NOT NULL)
SELECT CAST(level AS INTEGER) AS level, parent, label, count(*) AS n, round(sum(value), 2) AS value, round(100 * sum(value) / (SELECT sum(value) FROM sl), 6) AS pct, round(sum(value * ret) / nullif(sum(CASE WHEN ret IS NOT NULL THEN abs(value) END), 0), 6) AS ret FROM g GROUP BY 1, 2, 3"""
)
def allocation_by_region(spark, sf):
    """Classes with their regions below them, funds looked through, cash as a class."""
    return rounded(O.regional_allocation(regional(spark, sf)).withColumn("value", F.round("value", 2)))


#: Shocks in percent by scenario, class and region (none: all other regions of the class).
REGIONAL_SHOCKS = [("crash", "Equities", "US", -40.0), ("crash", "Equities", "EM", -50.0), ("crash", "Equities", None, -30.0), ("crash", "Bonds", "US", 10.0), ("crash", "Cash", None, 0.0), ("rates", "Bonds", None, -8.0), ("rates", "Commodities", None, 3.0)]


@query(
    f"""WITH {_REGIONAL}, shock(scenario, class, region, pct) AS (VALUES {", ".join(f"('{a}', '{b}', {f"'{c}'" if c else "NULL"}, {d})" for a, b, c, d in REGIONAL_SHOCKS)}), override(scenario, symbol, pct) AS (VALUES {", ".join(f"('{a}', '{b}', {c})" for a, b, c in OVERRIDES)})
SELECT k.scenario, s.symbol, round(sum(s.value * coalesce(o.pct, r.pct, c.pct, 0) / 100), 2) AS pnl FROM (SELECT DISTINCT scenario FROM shock) k CROSS JOIN sl s LEFT JOIN override o ON o.scenario = k.scenario AND o.symbol = s.symbol
LEFT JOIN shock r ON r.scenario = k.scenario AND r.class = s.class AND r.region = s.region LEFT JOIN shock c ON c.scenario = k.scenario AND c.class = s.class AND c.region IS NULL GROUP BY 1, 2"""
)
def regional_scenarios(spark, sf):
    """Scenario results by symbol, with shocks by class and region."""
    hit = O.shocked_by_region(regional(spark, sf), spark.createDataFrame(REGIONAL_SHOCKS, "scenario string, class string, region string, pct double"), spark.createDataFrame(OVERRIDES, "scenario string, symbol string, pct double"))
    return hit.groupBy("scenario", "symbol").agg(F.round(F.sum("pnl"), 2).alias("pnl"))


@query(
    f"""WITH {POS}, vol AS (SELECT ticker, avg(volume) AS adv FROM r, r_l WHERE seq > last - 20 GROUP BY 1), d AS (SELECT mtm, abs(quantity) / nullif(adv, 0) AS days FROM pos LEFT JOIN vol ON ticker = symbol)
SELECT CASE WHEN days IS NULL THEN 'unknown' WHEN days <= 5 THEN 'week' WHEN days <= 20 THEN 'month' ELSE 'longer' END AS bucket, count(*) AS n, round(sum(abs(mtm)), 2) AS value, round(100 * sum(abs(mtm)) / (SELECT sum(abs(mtm)) FROM pos), 6) AS pct FROM d GROUP BY 1"""
)
def liquidity_ladder(spark, sf):
    adv = R.trailing(R.on_calendar(P.prices(spark, sf)), 20).groupBy(F.col("ticker").alias("symbol")).agg(F.avg("volume").alias("adv"))
    return O.liquidity_ladder(positions(spark, sf), adv)


@query(f"WITH {POS}, {TRAIL}, {MARKET}, b AS (SELECT ticker, regr_slope(ret, fret) AS beta, regr_count(ret, fret) AS n FROM t JOIN m ON t.seq = m.seq GROUP BY 1) SELECT symbol, round(weight, 6) AS weight, round(beta, 6) AS beta, round(weight * beta, 6) AS contribution, CASE WHEN beta IS NULL THEN 'no beta' WHEN abs(beta) >= 1.2 THEN 'amplified' WHEN abs(beta) < 0.5 THEN 'muted' ELSE 'in line' END AS note FROM pos LEFT JOIN b ON ticker = symbol AND n >= 30")
def exposure_vs_beta(spark, sf):
    b = R.beta_to(rets(spark, sf), market(spark, sf)).select(F.col("ticker").alias("symbol"), "beta")
    size = F.abs("beta")
    j = positions(spark, sf).join(b, "symbol", "left").select("symbol", "weight", "beta", (F.col("weight") * F.col("beta")).alias("contribution"), F.when(F.col("beta").isNull(), "no beta").when(size >= 1.2, "amplified").when(size < 0.5, "muted").otherwise("in line").alias("note"))
    return rounded(j)


@query(
    f"""WITH {LOTS} SELECT CASE WHEN grouping(broker) = 0 THEN 'broker' WHEN grouping(account) = 0 THEN 'account' ELSE 'symbol' END AS dimension, coalesce(broker, account, symbol) AS value, count(*) AS n,
CAST(sum(CASE WHEN quantity > 0 THEN market_value ELSE 0 END) AS DOUBLE) AS long_value, CAST(sum(CASE WHEN quantity < 0 THEN market_value ELSE 0 END) AS DOUBLE) AS short_value FROM lots GROUP BY GROUPING SETS ((broker), (account), (symbol))"""
)
def multi_dim_aggregates(spark, sf):
    m = F.col("market_value")
    g = P.lots(spark, sf).groupingSets([["broker"], ["account"], ["symbol"]], "broker", "account", "symbol")
    g = g.agg(F.grouping("broker").alias("b"), F.grouping("account").alias("a"), F.count("*").alias("n"), F.sum(F.when(F.col("quantity") > 0, m).otherwise(0)).cast("double").alias("long_value"), F.sum(F.when(F.col("quantity") < 0, m).otherwise(0)).cast("double").alias("short_value"))
    return g.select(F.when(F.col("b") == 0, "broker").when(F.col("a") == 0, "account").otherwise("symbol").alias("dimension"), F.coalesce("broker", "account", "symbol").alias("value"), "n", "long_value", "short_value")


@query(f"WITH {LOTS} SELECT broker, account, count(*) AS n_lots, count(open_pnl) AS n_priced, CAST(sum(open_pnl) AS DOUBLE) AS pnl, round(100 * CAST(sum(open_pnl) AS DOUBLE) / nullif(CAST(sum(abs(market_value)) AS DOUBLE), 0), 6) AS pct FROM lots GROUP BY 1, 2")
def account_pnl(spark, sf):
    g = P.lots(spark, sf).groupBy("broker", "account")
    pnl, gross = F.sum("open_pnl").cast("double"), F.sum(F.abs("market_value")).cast("double")
    return g.agg(F.count("*").alias("n_lots"), F.count("open_pnl").alias("n_priced"), pnl.alias("pnl"), F.round(F.try_divide(100 * pnl, gross), 6).alias("pct"))
