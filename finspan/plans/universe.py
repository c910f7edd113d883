"""Universe construction queries: cleaning, mapping, labelling, ranking and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finspan.functions import labels as L
from finspan.functions import text as T
from finspan.operators import clustering as C
from finspan.operators import selection as S
from finspan.plans.corpus import SCORES, SOURCES, scored, sources
from finspan.plans.market import rets
from finspan.plans.sqlbase import CROSS, history, registry
from finspan.sources import panels as P
from finspan.sources.panels import rounded, table
from finspan.sources.sinks import written

QUERIES, ORACLES, query = registry()

# cleaning

RAW = "raw AS (SELECT p_partkey AS key, p_type AS kind, CASE WHEN p_size % 7 = 0 THEN '#N/A' WHEN p_size % 11 = 0 THEN 'n.a.' ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) END AS raw FROM part)"


def raw_prices(spark: SparkSession, sf: str) -> DataFrame:
    """(key, kind, raw): prices as a spreadsheet exports them, with error literals."""
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    raw = F.when(F.col("p_size") % 7 == 0, "#N/A").when(F.col("p_size") % 11 == 0, "n.a.").otherwise(price)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("kind"), raw.alias("raw"))


@query(f"WITH {RAW} SELECT key, try_cast(raw AS DOUBLE) AS value, raw LIKE '#%' AS error FROM raw")
def coerced_numbers(spark, sf):
    """Numbers out of text: error literals and other text become null."""
    return raw_prices(spark, sf).select("key", T.number(F.col("raw")).alias("value"), F.col("raw").startswith("#").alias("error"))


@query(f"WITH {RAW}, m AS (SELECT kind, median(try_cast(raw AS DOUBLE)) AS m FROM raw GROUP BY 1) SELECT key, round(coalesce(try_cast(raw AS DOUBLE), m), 6) AS value FROM raw JOIN m ON raw.kind = m.kind")
def median_filled(spark, sf):
    """Missing numbers filled with the median of their kind."""
    r = raw_prices(spark, sf).select("key", "kind", T.number(F.col("raw")).alias("value"))
    m = r.groupBy("kind").agg(F.percentile("value", F.lit(0.5)).alias("m"))
    return rounded(r.join(m, "kind").select("key", F.coalesce("value", "m").alias("value")))


IDS = "ids AS (SELECT p_partkey AS key, CASE p_partkey % 5 WHEN 0 THEN 'CASH' WHEN 1 THEN 'BX' || p_partkey || ' C' WHEN 2 THEN upper(left(md5(p_name), 8)) || (p_size % 10) WHEN 3 THEN upper(replace(p_name, ' ', '')) ELSE p_brand END AS symbol FROM part)"


def broker_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """(key, symbol) as brokers send them: cash, options, nine-character identifiers, names and tickers."""
    kind = F.col("p_partkey") % 5
    s = F.when(kind == 0, "CASH").when(kind == 1, F.concat(F.lit("BX"), "p_partkey", F.lit(" C")))
    s = s.when(kind == 2, F.concat(F.upper(F.left(F.md5("p_name"), F.lit(8))), F.col("p_size") % 10)).when(kind == 3, F.upper(F.replace("p_name", F.lit(" "), F.lit("")))).otherwise(F.col("p_brand"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("key"), s.alias("symbol"))


@query(
    f"""WITH {IDS} SELECT key, symbol, symbol <> 'CASH' AND NOT regexp_matches(symbol, ' [CP]$') AND NOT (regexp_full_match(symbol, '[A-Z0-9]{{9}}') AND regexp_matches(symbol, '[0-9]')) AS priceable FROM ids"""
)
def priceable_symbols(spark, sf):
    b = broker_symbols(spark, sf)
    return b.withColumn("priceable", L.priceable(F.col("symbol")))


@query(
    f"""WITH {IDS}, s AS (SELECT CASE WHEN regexp_matches(symbol, ' [CP]$') THEN 'derivative' WHEN symbol = 'CASH' THEN 'cash' WHEN regexp_full_match(symbol, '[A-Z0-9]{{9}}') AND regexp_matches(symbol, '[0-9]') THEN 'identifier' ELSE 'ticker' END AS kind FROM ids)
SELECT kind, count(*) AS n, round(1.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM s GROUP BY 1"""
)
def symbol_kinds(spark, sf):
    """Counts of symbol kinds and their shares of all."""
    g = broker_symbols(spark, sf).groupBy(L.symbol_kind(F.col("symbol")).alias("kind")).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    return rounded(g.join(F.broadcast(total)).select("kind", "n", (F.col("n") / F.col("total")).alias("share")))


#: Answers of a classifier in place of a label, by turns.
ANSWERS = ["nan", " N/A ", "na", "None", "NULL", "", "Unable to classify", "It is unknown", "Unclassified", "Parse Error: x"]


@query(
    f"""WITH a(i, answer) AS (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(ANSWERS))}), t AS (SELECT p_partkey AS key, CASE WHEN p_size % 20 < 10 THEN answer WHEN p_size % 20 = 19 THEN NULL ELSE p_type END AS tier1,
CASE WHEN p_partkey % 20 < 10 THEN p_brand ELSE b.answer END AS tier2 FROM part JOIN (SELECT i, answer FROM a) a ON a.i = p_size % 10 JOIN (SELECT i, answer FROM a) b(i, answer) ON b.i = p_partkey % 10)
SELECT key, tier1, tier2, coalesce(lower(trim(tier1)) NOT IN ('', 'nan', 'none', 'null', 'n/a', 'na') AND lower(trim(tier2)) NOT IN ('', 'nan', 'none', 'null', 'n/a', 'na')
AND NOT regexp_matches(lower(tier1 || ' ' || tier2), 'unable|unknown|unclassified|error'), false) AS valid FROM t""".replace("THEN answer", "THEN a.answer", 1)
)
def valid_labels(spark, sf):
    """Whether both tiers have a label: not null, blank, a literal for none or a refusal."""
    said = lambda i: F.element_at(F.array(*map(F.lit, ANSWERS)), (i % 10 + 1).cast("int"))
    size, key = F.col("p_size"), F.col("p_partkey")
    tier1 = F.when(size % 20 < 10, said(size)).when(size % 20 == 19, F.lit(None)).otherwise(F.col("p_type"))
    tier2 = F.when(key % 20 < 10, F.col("p_brand")).otherwise(said(key))
    return table(spark, sf, "part").select(key.alias("key"), tier1.alias("tier1"), tier2.alias("tier2")).withColumn("valid", L.valid_label(F.col("tier1"), F.col("tier2")))


@query(
    """WITH n AS (SELECT p_partkey AS key, p_brand AS symbol, CASE p_size % 5 WHEN 0 THEN p_brand WHEN 1 THEN CAST(p_partkey AS VARCHAR) WHEN 2 THEN '  ' WHEN 3 THEN NULL ELSE p_name END AS name FROM part)
SELECT *, trim(coalesce(name, '')) = '' OR trim(name) = symbol OR regexp_full_match(trim(name), '[0-9]+') AS junk FROM n"""
)
def junk_names(spark, sf):
    """Names that say nothing about the asset."""
    k = F.col("p_size") % 5
    name = F.when(k == 0, F.col("p_brand")).when(k == 1, F.col("p_partkey").cast("string")).when(k == 2, "  ").when(k == 4, F.col("p_name"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("symbol"), name.alias("name")).withColumn("junk", L.junk_name(F.col("name"), F.col("symbol")))


@query(
    """WITH t AS (SELECT p_partkey AS key, list_filter([CASE WHEN p_size % 2 = 0 THEN 'Small-Cap' END, CASE WHEN p_size % 3 = 0 THEN 'Mid-Cap' END, p_type, CASE WHEN p_size % 5 = 0 THEN 'Large-Cap' END], lambda x: x IS NOT NULL) AS tags,
(p_size % 2 = 0)::INT + (p_size % 3 = 0)::INT + (p_size % 5 = 0)::INT AS n FROM part) SELECT key, array_to_string(CASE WHEN n >= 2 THEN list_filter(tags, lambda x: x NOT LIKE '%-Cap') ELSE tags END, ', ') AS tags FROM t"""
)
def size_tags(spark, sf):
    """Tags without those of size where a fund has two or more of them."""
    s = F.col("p_size")
    tags = F.array_compact(F.array(F.when(s % 2 == 0, "Small-Cap"), F.when(s % 3 == 0, "Mid-Cap"), F.col("p_type"), F.when(s % 5 == 0, "Large-Cap")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.array_join(L.one_size(tags, ["Small-Cap", "Mid-Cap", "Large-Cap"]), ", ").alias("tags"))


@query("SELECT p_partkey AS key, p_brand || CASE WHEN p_size % 3 = 0 THEN ' Index' WHEN p_type = 'PROMO' THEN ' CN Equity' ELSE ' US Equity' END AS ticker FROM part")
def suffixed_tickers(spark, sf):
    """Tickers with the suffix of their source."""
    suffix = F.when(F.col("p_size") % 3 == 0, " Index").when(F.col("p_type") == "PROMO", " CN Equity").otherwise(" US Equity")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.concat("p_brand", suffix).alias("ticker"))


#: Proxies of index brands (proxy, score), and brands dropped from the universe.
PROXIES = [("Brand#1", "PX1", 3), ("Brand#2", "PX2", 2), ("Brand#3", "PX1", 1), ("Brand#4", "PX4", 3)]
DROPPED = ["Brand#5", "Brand#6"]


@query(
    f"""WITH m(brand, proxy, score) AS (VALUES {", ".join(map(str, PROXIES))})
SELECT p_partkey AS key, coalesce(proxy, CASE WHEN p_type = 'PROMO' THEN p_brand || '.TO' ELSE p_brand END) AS ticker, CASE WHEN proxy IS NULL THEN 'direct' ELSE 'proxy' END AS source, coalesce(score, 3) AS tracking_score
FROM part LEFT JOIN m ON brand = p_brand WHERE p_brand NOT IN ({", ".join(f"'{x}'" for x in DROPPED)})"""
)
def mapped_universe(spark, sf):
    """Brands as tradable tickers: by the proxy table, else direct, with dropped ones gone."""
    m = F.broadcast(spark.createDataFrame(PROXIES, "brand string, proxy string, score int"))  # a fixed table
    j = table(spark, sf, "part").where(~F.col("p_brand").isin(DROPPED)).join(m, F.col("brand") == F.col("p_brand"), "left")
    direct = F.when(F.col("p_type") == "PROMO", F.concat("p_brand", F.lit(".TO"))).otherwise(F.col("p_brand"))
    return j.select(F.col("p_partkey").alias("key"), F.coalesce("proxy", direct).alias("ticker"), F.when(F.col("proxy").isNull(), "direct").otherwise("proxy").alias("source"), F.coalesce("score", F.lit(3)).alias("tracking_score"))


@query(
    f"""WITH m(brand, proxy, score) AS (VALUES {", ".join(map(str, PROXIES))}), u AS (SELECT DISTINCT p_brand AS brand FROM part), j AS (SELECT u.brand, coalesce(proxy, u.brand) AS ticker, proxy IS NULL AS direct, coalesce(score, 3) AS score FROM u LEFT JOIN m ON u.brand = m.brand),
k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY direct DESC, score DESC, brand) AS k FROM j)
SELECT ticker, max(CASE WHEN k = 1 THEN brand END) AS brand, coalesce(string_agg(CASE WHEN k > 1 THEN brand END, ', ' ORDER BY k), '') AS proxied FROM k GROUP BY 1"""
)
def collapsed_proxies(spark, sf):
    """One row a ticker, direct ones first, then by score; the others are listed."""
    m = F.broadcast(spark.createDataFrame(PROXIES, "brand string, proxy string, score int"))
    j = table(spark, sf, "part").select(F.col("p_brand").alias("brand")).distinct().join(m, "brand", "left")
    j = j.select("brand", F.coalesce("proxy", "brand").alias("ticker"), F.col("proxy").isNotNull().alias("indirect"), (-F.coalesce("score", F.lit(3))).alias("low"))
    g = j.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("indirect", "low", "brand")))["brand"].alias("b"))
    return g.select("ticker", F.element_at("b", 1).alias("brand"), F.array_join(F.slice("b", F.lit(2), F.size("b")), ", ").alias("proxied"))


ASSET = f"{history('x', 'month', CROSS)}, a AS (SELECT ticker, split_part(ticker, '/', 2) AS tier1, round(avg(ret), 6) AS mean_ret, round(stddev_samp(ret), 6) AS vol, count(ret) AS n FROM x GROUP BY 1)"


def asset_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """(ticker, tier1, mean_ret, vol, n) over the history of each brand and type."""
    r = rets(spark, sf, "month", P.CROSS)
    return rounded(r.groupBy("ticker", F.split_part("ticker", F.lit("/"), F.lit(2)).alias("tier1")).agg(F.avg("ret").alias("mean_ret"), F.stddev_samp("ret").alias("vol"), F.count("ret").alias("n")))


@query(
    f"""WITH {ASSET}, q AS (SELECT quantile_cont(vol, 0.25) AS lo, quantile_cont(vol, 0.75) AS hi FROM a)
SELECT ticker, concat_ws(' ', CASE WHEN vol <= lo THEN 'Low-Vol' WHEN vol >= hi THEN 'High-Vol' ELSE 'Mid-Vol' END, tier1, CASE WHEN mean_ret > 2 THEN 'Strong' WHEN mean_ret > 0.5 THEN 'Rising' WHEN mean_ret >= -0.5 THEN 'Flat' ELSE 'Falling' END) AS label FROM a, q"""
)
def return_buckets(spark, sf):
    """A name by the bucket of the mean return and the quartiles of volatility."""
    a = asset_metrics(spark, sf)
    q = a.agg(F.percentile("vol", F.lit(0.25)).alias("lo"), F.percentile("vol", F.lit(0.75)).alias("hi"))
    vol = F.when(F.col("vol") <= F.col("lo"), "Low-Vol").when(F.col("vol") >= F.col("hi"), "High-Vol").otherwise("Mid-Vol")
    ret = F.when(F.col("mean_ret") > 2, "Strong").when(F.col("mean_ret") > 0.5, "Rising").when(F.col("mean_ret") >= -0.5, "Flat").otherwise("Falling")
    return a.join(F.broadcast(q)).select("ticker", F.concat_ws(" ", vol, "tier1", ret).alias("label"))


@query(
    f"""WITH {ASSET}, k AS (SELECT ticker, tier1, round(mean_ret / nullif(vol, 0), 6) AS sharpe FROM a)
SELECT ticker, tier1, sharpe, CASE WHEN row_number() OVER (PARTITION BY tier1 ORDER BY sharpe DESC NULLS LAST, ticker) <= 5 THEN 'KEEP' ELSE 'REMOVE' END AS verdict FROM k"""
)
def keep_by_sharpe(spark, sf):
    """The five best of each category by return over volatility stay."""
    k = asset_metrics(spark, sf).select("ticker", "tier1", F.round(F.try_divide("mean_ret", "vol"), 6).alias("sharpe"))
    rank = F.row_number().over(Window.partitionBy("tier1").orderBy(F.desc_nulls_last("sharpe"), "ticker"))
    return k.withColumn("verdict", F.when(rank <= 5, "KEEP").otherwise("REMOVE"))


@query(
    f"""WITH {ASSET}, s AS (SELECT tier1, avg(vol) AS m, stddev_pop(vol) AS s FROM a GROUP BY 1) SELECT ticker, round(CASE WHEN s.s > 0 THEN (vol - m) / s.s END, 6) AS z FROM a JOIN s ON a.tier1 = s.tier1"""
)
def standardised(spark, sf):
    """Volatility in population deviations from the mean of its category."""
    a = asset_metrics(spark, sf)
    s = a.groupBy("tier1").agg(F.avg("vol").alias("m"), F.stddev_pop("vol").alias("s"))
    return rounded(a.join(s, "tier1").select("ticker", F.when(F.col("s") > 0, (F.col("vol") - F.col("m")) / F.col("s")).alias("z")))


@query(
    f"""WITH RECURSIVE {ASSET}, z AS (SELECT ticker AS key, tier1 AS block, (mean_ret - avg(mean_ret) OVER w) / nullif(stddev_pop(mean_ret) OVER w, 0) AS x, (vol - avg(vol) OVER w) / nullif(stddev_pop(vol) OVER w, 0) AS y
FROM a WINDOW w AS (PARTITION BY tier1)),
p AS (SELECT b.key, list(a.key) AS before FROM z a JOIN z b ON a.block = b.block AND a.key < b.key AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 1.0 GROUP BY 1),
n AS (SELECT z.block, z.key, coalesce(p.before, []) AS before, row_number() OVER (PARTITION BY z.block ORDER BY z.key) AS k FROM z LEFT JOIN p ON p.key = z.key),
r AS (SELECT block, k, [key] AS leaders FROM n WHERE k = 1
UNION ALL SELECT n.block, n.k, CASE WHEN list_has_any(n.before, r.leaders) THEN r.leaders ELSE list_append(r.leaders, n.key) END FROM r JOIN n ON n.block = r.block AND n.k = r.k + 1),
l AS (SELECT block, arg_max(leaders, k) AS leaders FROM r GROUP BY 1)
SELECT n.key, CASE WHEN list_contains(leaders, n.key) THEN n.key ELSE list_min(list_intersect(n.before, leaders)) END AS leader FROM n JOIN l ON n.block = l.block"""
)
def leader_clusters(spark, sf):
    """Assets of a category led by the first one within 1.0 of them in standardised return and volatility."""
    a = asset_metrics(spark, sf)
    w = Window.partitionBy("tier1")
    z = lambda c: F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w)).alias(c)
    a = written(a.select("ticker", "tier1", z("mean_ret"), z("vol")), "standardised")
    nodes = a.select(F.col("tier1").alias("block"), F.col("ticker").alias("key"))
    return C.leader_groups(nodes, S.near_pairs(a, "ticker", "tier1", ["mean_ret", "vol"], 1.0))


def return_vectors(spark, sf):
    """(ticker, tier1, vector): mean monthly return of each quarter, 0 where a ticker has none."""
    r = rets(spark, sf, "month", P.CROSS).withColumn("q", F.date_trunc("quarter", "date"))
    r = written(r.groupBy("ticker", "q").agg(F.round(F.avg("ret"), 6).alias("x")), "quarters")
    grid = r.select("ticker").distinct().join(F.broadcast(r.agg(F.array_sort(F.collect_set("q")).alias("qs")))).select("ticker", F.explode("qs").alias("q"))  # one row of quarters
    v = grid.join(r, ["ticker", "q"], "left").groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("q", F.coalesce("x", F.lit(0.0)).alias("x")))).alias("v"))
    return v.select("ticker", F.split_part("ticker", F.lit("/"), F.lit(2)).alias("tier1"), F.transform("v", lambda s: s["x"]).alias("vector"))


@query()
def linkage_representatives(spark, sf):
    """Average-linkage clusters of each category's assets by correlation of returns: the asset nearest to each cluster's mean, with distinct names."""
    v = written(return_vectors(spark, sf), "vectors")
    c = C.average_linkage(v, "tier1", "ticker", "vector").join(v.select("ticker", "vector"), "ticker")
    return C.representatives(c, "tier1", "ticker", "vector", F.concat_ws(" ", F.element_at(F.split("ticker", "/"), 1), "tier1"))


# ranking and sampling


@query("SELECT p_partkey AS key, p_name || CASE WHEN k > 1 THEN ' #' || k ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)")
def ordinal_names(spark, sf):
    """Names made distinct by an ordinal from the second on."""
    k = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    return table(spark, sf, "part").withColumn("k", k).select(F.col("p_partkey").alias("key"), F.when(F.col("k") > 1, F.concat("p_name", F.lit(" #"), "k")).otherwise(F.col("p_name")).alias("name"))


@query(f"WITH {SCORES} SELECT key, source, tier, score FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY score DESC, source, key) AS k FROM scored) JOIN (VALUES (0, 10), (1, 6), (2, 3)) q(t, target) ON tier = t WHERE k <= target")
def top_per_tier(spark, sf):
    """The best of each tier up to the tier's own target."""
    q = F.broadcast(spark.createDataFrame([(0, 10), (1, 6), (2, 3)], "tier long, target int"))
    k = F.row_number().over(Window.partitionBy("tier").orderBy(F.desc("score"), "source", "key"))
    return scored(spark, sf).join(q, "tier").withColumn("k", k).where("k <= target").select("key", "source", "tier", "score")


@query(f"WITH {SCORES} SELECT tier, key, source FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY score DESC, source, key) AS k FROM scored) WHERE k = 5")
def fifth_of_tier(spark, sf):
    """LIMIT 1 OFFSET 4 in each tier."""
    k = F.row_number().over(Window.partitionBy("tier").orderBy(F.desc("score"), "source", "key"))
    return scored(spark, sf).withColumn("k", k).where("k = 5").select("tier", "key", "source")


@query(
    f"""WITH {SCORES}, k AS (SELECT tier, source, key, row_number() OVER (PARTITION BY tier, source ORDER BY score DESC, key) AS up, row_number() OVER (PARTITION BY tier, source ORDER BY score, key DESC) AS down FROM scored) SELECT tier, source, key FROM k WHERE up <= 3 OR down <= 3"""
)
def head_and_tail(spark, sf):
    """The first three and last three of each tier and source, once each."""
    w = Window.partitionBy("tier", "source")
    s = scored(spark, sf).withColumn("up", F.row_number().over(w.orderBy(F.desc("score"), "key"))).withColumn("down", F.row_number().over(w.orderBy("score", F.desc("key"))))
    return s.where("up <= 3 or down <= 3").select("tier", "source", "key")


@query(f"WITH {SCORES}, k AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY score DESC, source, key) AS k FROM scored) SELECT tier, key, source FROM k WHERE (k - 1) % 9 = 0")
def systematic_sample(spark, sf):
    """Every ninth row of a tier by score: the sampling operator."""
    k = F.row_number().over(Window.partitionBy("tier").orderBy(F.desc("score"), "source", "key"))
    return scored(spark, sf).withColumn("k", k).where((F.col("k") - 1) % 9 == 0).select("tier", "key", "source")


#: 32 bits of a text's digest as a fraction, the same in both dialects.
_U = "((('0x' || left(md5(source || '/' || key), 8))::BIGINT + 1) / 4294967297.0)"


@query(
    f"""WITH {SOURCES}, c AS (SELECT source, key, {_U} AS u, count(*) OVER (PARTITION BY source) AS n FROM src), f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY u, key) <= 5 AS first FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY first ORDER BY round(-ln(u) * n, 9), source, key) AS k FROM f) SELECT source, key, CASE WHEN first THEN 'minimum' ELSE 'rarity' END AS stage FROM k WHERE first OR k <= 30"""
)
def rarity_sample(spark, sf):
    """A least number of each source, then a fill that favours rare sources: the sampling operator."""
    return S.rarity_sample(sources(spark, sf), "source", "key", 5, 30)


@query("SELECT source, key, row_number() OVER (ORDER BY md5('7' || source || key), source, key) AS place FROM (SELECT 'part' AS source, p_partkey AS key FROM part)")
def seeded_shuffle(spark, sf):
    """All rows with their place in an order drawn by a seeded hash."""
    s = table(spark, sf, "part").select(F.lit("part").alias("source"), F.col("p_partkey").alias("key"))
    return S.seeded_order(s, "7", ["source", "key"])


@query(
    f"""WITH {SCORES}, per AS (SELECT tier, count(*) AS n FROM scored GROUP BY 1), s AS (SELECT tier, n, 100.0 * n / sum(n) OVER () AS exact FROM per), f AS (SELECT tier, n, floor(exact) AS base, exact - floor(exact) AS rest FROM s),
k AS (SELECT *, 100 - sum(base) OVER () AS left_over, row_number() OVER (ORDER BY round(rest, 9) DESC, tier) AS k FROM f) SELECT tier, n, CAST(base + CASE WHEN k <= left_over THEN 1 ELSE 0 END AS BIGINT) AS seats FROM k"""
)
def proportional_allocation(spark, sf):
    """A hundred places shared out in proportion, the rest by largest remainder."""
    return S.proportional_allocation(scored(spark, sf), "tier", 100)


# sets


@query("SELECT 'customer' AS side, count(*) AS n FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'supplier', count(*) FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer) UNION ALL SELECT 'both', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'any', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def set_overlap(spark, sf):
    """Keys in one table, in the other, in both and in any."""
    c, s = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    n = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return n("customer", c.subtract(s)).union(n("supplier", s.subtract(c))).union(n("both", c.intersect(s))).union(n("any", c.union(s).distinct()))


@query("SELECT n_name AS missing FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def missing_keys(spark, sf):
    """Requested keys without a row: left anti join."""
    got = table(spark, sf, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, sf, "nation").join(got, "n_nationkey", "left_anti").select(F.col("n_name").alias("missing"))


@query(f"WITH {SOURCES}, g AS (SELECT name, count(*) AS size FROM src GROUP BY 1) SELECT size, count(*) AS n_groups, CAST(sum(size) AS BIGINT) AS n_rows FROM g GROUP BY 1")
def group_size_histogram(spark, sf):
    """How many names occur how often."""
    g = sources(spark, sf).groupBy("name").agg(F.count("*").alias("size"))
    return g.groupBy("size").agg(F.count("*").alias("n_groups"), F.sum("size").alias("n_rows"))


@query(f"WITH {SOURCES} SELECT source, count(*) AS n, round(avg(value), 3) AS mean, round(median(value), 3) AS median, round(stddev_samp(value), 3) AS std, count(DISTINCT name) AS n_names FROM src GROUP BY 1")
def source_statistics(spark, sf):
    g = sources(spark, sf).groupBy("source")
    return rounded(g.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.stddev_samp("value").alias("std"), F.count_distinct("name").alias("n_names")), 3)


@query(
    f"""WITH {SOURCES}, a AS (SELECT source, key % 10 AS bin, count(*) AS n FROM src WHERE source <> 'part' GROUP BY 1, 2), s AS (SELECT bin, 1.0 * n / sum(n) OVER () AS p FROM a WHERE source = 'supplier'), c AS (SELECT bin, 1.0 * n / sum(n) OVER () AS p FROM a WHERE source = 'customer')
SELECT coalesce(s.bin, c.bin) AS bin, round(coalesce(s.p, 0), 6) AS before, round(coalesce(c.p, 0), 6) AS after, round(coalesce(c.p, 0) - coalesce(s.p, 0), 6) AS change FROM s FULL JOIN c ON s.bin = c.bin"""
)
def distribution_change(spark, sf):
    """Shares by bin in two sources, absent ones as zero."""
    s = sources(spark, sf).where("source <> 'part'").withColumn("bin", F.col("key") % 10)
    return rounded(S.compare_distributions(s.where("source = 'supplier'"), s.where("source = 'customer'"), "bin"))


@query("SELECT s_suppkey AS key, n_name AS country, CASE WHEN r_name IN ('AMERICA', 'EUROPE') THEN 'Developed' WHEN r_name = 'ASIA' THEN 'Emerging' ELSE 'Frontier' END AS market FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def country_taxonomy(spark, sf):
    """Countries mapped to market classes, with a default."""
    m = F.broadcast(spark.createDataFrame([("AMERICA", "Developed"), ("EUROPE", "Developed"), ("ASIA", "Emerging")], "r_name string, market string"))
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(m, "r_name", "left")
    return j.select(F.col("s_suppkey").alias("key"), F.col("n_name").alias("country"), F.coalesce("market", F.lit("Frontier")).alias("market"))


@query("SELECT n_name AS name, s_suppkey AS key FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier) s RIGHT JOIN nation ON s_nationkey = n_nationkey AND k = 1")
def first_row_per_key(spark, sf):
    """Each nation with its first supplier, if it has one."""
    s = S.keep_first(table(spark, sf, "supplier"), ["s_nationkey"], F.desc("s_acctbal"), "s_suppkey").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").alias("key"))
    return table(spark, sf, "nation").join(s, "n_nationkey", "left").select(F.col("n_name").alias("name"), "key")


@query(
    """WITH t AS (SELECT p_partkey AS key, CASE WHEN p_size % 6 = 0 THEN 'pinned' END AS own, CASE WHEN p_size % 4 = 0 THEN p_type END AS listed, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS cached FROM part)
SELECT key, coalesce(own, listed, nullif(cached, '')) AS tag, CASE WHEN own IS NOT NULL THEN 'override' WHEN listed IS NOT NULL THEN 'universe' WHEN cached <> '' THEN 'cache' ELSE 'none' END AS origin FROM t"""
)
def tag_priority(spark, sf):
    """The first tag of override, universe and non-empty cache, with where it came from."""
    z = F.col("p_size")
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.when(z % 6 == 0, "pinned").alias("own"), F.when(z % 4 == 0, F.col("p_type")).alias("listed"), F.when(z % 3 == 0, "").otherwise(F.col("p_brand")).alias("cached"))
    return L.by_priority(t, "tag", {"override": F.col("own"), "universe": F.col("listed"), "cache": F.nullif(F.col("cached"), F.lit(""))})


@query("SELECT status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct, CASE WHEN status = 'F' AND 100.0 * count(*) / sum(count(*)) OVER () > 20 THEN 'fail' ELSE 'ok' END AS gate FROM (SELECT o_orderstatus AS status FROM orders) GROUP BY 1")
def quality_gate(spark, sf):
    """Share of each status; a run with more than a fifth failed does not pass."""
    g = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    pct = 100.0 * F.col("n") / F.col("total")
    j = g.join(F.broadcast(g.agg(F.sum("n").alias("total"))))
    return rounded(j.select("status", "n", pct.alias("pct"), F.when((F.col("status") == "F") & (pct > 20), "fail").otherwise("ok").alias("gate")))


@query("SELECT o_orderkey AS key, CAST(o_orderdate AS DATE) - CASE isodow(o_orderdate) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS session FROM orders")
def last_session(spark, sf):
    """The weekday on or before a date."""
    back = F.greatest(F.weekday("o_orderdate") - 4, F.lit(0))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.date_sub(F.to_date("o_orderdate"), back).alias("session"))


@query(
    """WITH d AS (SELECT l_orderkey AS key, l_linenumber AS line, CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT *, date_diff('day', DATE '1970-01-05', a) AS i, date_diff('day', DATE '1970-01-05', b) AS j FROM d)
SELECT key, line, CAST(j - i AS BIGINT) AS days, CAST((5 * (j // 7) + least(j % 7, 4)) - (5 * (i // 7) + least(i % 7, 4)) AS BIGINT) AS business_days FROM n"""
)
def business_day_gap(spark, sf):
    """Days, and weekdays, from an order to its shipment, signed."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    a, b = F.to_date("o_orderdate"), F.to_date("l_shipdate")
    return j.select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), F.datediff(b, a).cast("bigint").alias("days"), L.business_days(a, b).alias("business_days"))
