"""Queries over catalogs that Spark has written: databases side by side, registries, tables merged by bucket."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from finspan.functions import validation as V
from finspan.plans.sqlbase import CROSS, panel, registry
from finspan.sources import buckets, ledger, sqlite, views
from finspan.sources import registry as R
from finspan.sources.panels import prices, table, universe
from finspan.sources.sinks import shared_folder

QUERIES, ORACLES, query = registry()

_SINCE = date(1995, 1, 1)


@query(f"""WITH p AS ({panel("month", CROSS)}), u AS (SELECT DISTINCT {CROSS} AS ticker, p_type AS tier1 FROM part)
SELECT tier1, count(*) AS n_prices, count(DISTINCT p.ticker) AS n_tickers, min(date) AS first_date, max(date) AS last_date, round(sum(volume), 2) AS volume
FROM p JOIN u ON p.ticker = u.ticker WHERE date >= DATE '1995-01-01' GROUP BY 1""")
def two_catalogs(spark, sf):
    """Prices of one database since a date, joined with the assets of another; the date is compared inside the first."""
    market, assets = shared_folder(spark, "market"), shared_folder(spark, "assets")
    sqlite.write(prices(spark, sf, "month", CROSS), market, "prices", indexes=[["date"]])
    sqlite.write(universe(spark, sf), assets, "assets")
    p = R.Catalog(spark, market).table("prices", ["date", "ticker", "volume"], first=_SINCE)
    joined = p.join(R.Catalog(spark, assets).table("assets", ["ticker", "tier1"]), "ticker")
    g = joined.groupBy("tier1").agg(F.count("*").alias("n_prices"), F.countDistinct("ticker").alias("n_tickers"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum("volume").alias("volume"))
    return g.withColumn("volume", F.round("volume", 2))


def held(spark, sf):
    """Holdings by portfolio, quarter and ticker: parts too large to have a listed size are unresolved, returned lines short."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_extendedprice", "l_returnflag")
    owners = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.concat_ws("/", "c_mktsegment", "c_nationkey").alias("portfolio_id"))
    part = table(spark, sf, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") > 45, "failed").otherwise("resolved").alias("resolution_status"))
    value = F.when(F.col("l_returnflag") == "R", -1).otherwise(1) * F.col("l_extendedprice").cast("decimal(18,2)")
    rows = lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    by = ["portfolio_id", F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("date"), F.col("p_brand").alias("ticker"), "resolution_status"]
    return rows.groupBy(*by).agg(F.sum(value).cast("decimal(18,2)").alias("market_value"))


_HELD = """SELECT c_mktsegment || '/' || c_nationkey AS portfolio_id, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS date, p_brand AS ticker,
CASE WHEN p_size > 45 THEN 'failed' ELSE 'resolved' END AS resolution_status, sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(18,2))) AS market_value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4"""


@query(f"""WITH h AS ({_HELD}), a AS (SELECT * FROM h WHERE split_part(portfolio_id, '/', 1) <> 'MACHINERY' AND date <= DATE '1997-06-30'),
l AS (SELECT portfolio_id, max(date) AS date FROM a GROUP BY 1)
SELECT a.portfolio_id, split_part(a.portfolio_id, '/', 1) AS portfolio_name, a.date, count(*) AS n_positions, count(*) FILTER (resolution_status = 'resolved') AS n_resolved,
CAST(sum(market_value) FILTER (market_value > 0) AS DOUBLE) AS long_value, CAST(sum(market_value) FILTER (market_value < 0) AS DOUBLE) AS short_value
FROM a JOIN l ON a.portfolio_id = l.portfolio_id AND a.date = l.date GROUP BY 1, 2, 3""")
def registered_holdings(spark, sf):
    """Each active portfolio of a registry with its last holdings not after a date, read from the registry's database."""
    db = shared_folder(spark, "registry")
    rows = held(spark, sf)
    sqlite.write(rows, db, "portfolio_holdings", indexes=[["portfolio_id", "date"]])
    name = F.split("portfolio_id", "/")[0]
    ids = sqlite.read(spark, db, "portfolio_holdings", ["portfolio_id"]).distinct()
    sqlite.write(ids.select("portfolio_id", name.alias("portfolio_name"), (name != "MACHINERY").alias("is_active")), db, "portfolios")
    c = R.Catalog(spark, db)
    last = R.latest(R.holdings_until(c, date(1997, 6, 30)))
    active = R.portfolios(c).select("portfolio_id", "portfolio_name")
    out = R.summary(last.join(active, "portfolio_id"), ["portfolio_id", "portfolio_name", "date"], F.col("market_value"))
    return out.withColumn("long_value", F.col("long_value").cast("double")).withColumn("short_value", F.col("short_value").cast("double"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders), m AS (SELECT max(o_orderdate) AS last FROM l WHERE k = 1)
SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderstatus FROM l, m WHERE k = 1 AND CAST(o_orderdate AS DATE) > CAST(last AS DATE) - 365""")
def merged_by_bucket(spark, sf):
    """Each customer's last order, merged year by year in no order of time into a table of buckets; customers without one for a year are deleted."""
    path = shared_folder(spark, "merged")
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_orderstatus")
    years = sorted(r[0] for r in rows.select(F.year("o_orderdate")).distinct().collect() if r[0] is not None)
    for y in years[1::2] + years[::2]:
        buckets.upsert(rows.where(F.year("o_orderdate") == y), path, ["o_custkey"], ["o_orderdate", "o_orderkey"], latest=True)
    buckets.retain(spark, path, "o_orderdate", 365)
    return buckets.read(spark, path)


@query("SELECT p_partkey AS key, p_name AS name, CASE WHEN p_size > 25 THEN p_brand END AS brand, CASE WHEN p_size > 25 THEN 'v2' ELSE 'v1' END AS source, p_size > 25 AND p_brand LIKE 'Brand#1%' AS first_brands FROM part")
def evolved_table(spark, sf):
    """A table whose later rows have a column more, read as one with its older files through a view that is kept beside it."""
    catalog = shared_folder(spark, "evolved")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), "p_size", F.col("p_brand").alias("brand"))
    buckets.upsert(p.select("key", "name", F.lit("v1").alias("source")), f"{catalog}/tags", ["key"])
    buckets.upsert(p.where("p_size > 25").select("key", "name", F.lit("v2").alias("source"), "brand"), f"{catalog}/tags", ["key"], evolve=True)
    views.save_view(spark, catalog, "tagged", "SELECT *, coalesce(brand LIKE 'Brand#1%', false) AS first_brands FROM tags")
    views.open_catalog(spark, catalog)
    return spark.table("tagged").select("key", "name", "brand", "source", "first_brands")


@query("SELECT p_partkey AS key, CASE WHEN p_size <= 45 THEN upper(p_name) END AS name, CASE WHEN p_size > 45 THEN 'no name for ' || p_partkey END AS error FROM part")
def resumed_lookups(spark, sf):
    """Names looked up part by part by a run that breaks off and one that goes on; lookups that fail are kept as failures."""
    path = shared_folder(spark, "ledger")
    p = table(spark, sf, "part")

    def look_up(rows):
        known = F.col("p_size") <= 45
        return rows.select(F.col("key"), F.when(known, F.upper("p_name")).alias("name"), F.when(~known, F.concat(F.lit("no name for "), "key")).alias("error"))

    rows = p.select(F.col("p_partkey").alias("key"), "p_name", "p_size")
    ledger.resume(rows, "key", look_up, path, buckets=4, most=2)
    ledger.resume(rows, "key", look_up, path)
    return buckets.read(spark, path)


SHAPE = {
    "executive_synthesis": {"single_most_important": V.ANY, "key_takeaways": V.LIST, "what_to_watch": V.LIST},
    "flash_headlines": V.ANY,
    "sections": ["Section", {"title": V.ANY, "narrative": V.ANY, "tables?": ["Table", {"headers": V.ANY, "rows": V.ANY}]}],
}


@query("""WITH c AS (SELECT *, c_mktsegment AS s FROM customer), e AS (
SELECT unnest(CASE WHEN s = 'BUILDING' THEN ['not JSON'] ELSE list_filter([
CASE WHEN c_acctbal < 0 THEN 'executive_synthesis missing ''single_most_important''' END, CASE WHEN c_nationkey = 3 THEN 'executive_synthesis key_takeaways must be a list' END,
CASE WHEN s = 'HOUSEHOLD' THEN 'report missing ''flash_headlines''' END, CASE WHEN s = 'MACHINERY' THEN 'sections must be a list' END,
CASE WHEN s <> 'MACHINERY' AND c_acctbal > 5000 THEN 'Section 0 missing ''title''' END, CASE WHEN s <> 'MACHINERY' AND c_nationkey < 5 THEN 'Section 1, Table 0 missing ''rows''' END], lambda x: x IS NOT NULL) END) AS error FROM c)
SELECT error, count(*) AS n FROM e GROUP BY 1 UNION ALL SELECT 'valid', count(*) FROM c WHERE s IN ('AUTOMOBILE', 'FURNITURE') AND c_acctbal BETWEEN 0 AND 5000 AND c_nationkey >= 5""")
def validated_reports(spark, sf):
    """Reports as JSON, some broken off or with parts missing or of another kind, and how often each error occurs."""
    segment, balance, nation = F.col("c_mktsegment"), F.col("c_acctbal"), F.col("c_nationkey")
    synthesis = F.struct(F.when(balance >= 0, F.lit("x")).alias("single_most_important"), F.lit("@").alias("key_takeaways"), F.array(F.lit("w")).alias("what_to_watch"))
    one = F.struct(F.when(balance <= 5000, F.col("c_name")).alias("title"), F.lit("n").alias("narrative"), F.lit(None).cast("array<struct<headers:array<string>,rows:array<string>>>").alias("tables"))
    rows = F.struct(F.array(F.lit("h")).alias("headers"), F.when(nation >= 5, F.array(F.lit("r"))).alias("rows"))
    two = F.struct(F.lit("t").alias("title"), F.lit("n").alias("narrative"), F.array(rows).alias("tables"))
    text = F.to_json(F.struct(synthesis.alias("executive_synthesis"), F.when(segment != "HOUSEHOLD", F.array(F.lit("f"))).alias("flash_headlines"), F.array(one, two).alias("sections")))
    text = F.when(nation == 3, text).otherwise(F.replace(text, F.lit('"@"'), F.lit('["k"]')))
    text = F.when(segment == "BUILDING", F.left(text, F.length(text) - 5)).when(segment == "MACHINERY", F.regexp_replace(text, r'"sections":.*\}$', '"sections":"none"}')).otherwise(text)
    checked = V.validated(table(spark, sf, "customer").select(text.alias("json")), "json", SHAPE)
    found = checked.select(F.explode(F.when(F.col("valid"), F.array(F.lit("valid"))).otherwise(F.col("errors"))).alias("error"))
    return found.groupBy("error").agg(F.count("*").alias("n"))
