"""Views of the tables as price histories, holdings and universes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: When a row of a table of facts came to be.
KNOWN = {"lineitem": "l_shipdate", "orders": "o_orderdate", "events": "ts"}


class AsOf(str):
    """A folder of tables as they were at the end of a day: every plan that is given it in the folder's place sees no later facts.

    Calendars, years, last sessions and positions follow from what is seen. Rows without a date aren't seen.
    """

    date: str

    def __new__(cls, sf_dir: str, date: str) -> AsOf:
        out = super().__new__(cls, sf_dir)
        out.date = str(date)
        return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; its date condition reaches the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if isinstance(sf_dir, AsOf) and name in KNOWN:
        df = df.where(F.col(KNOWN[name]) < F.date_add(F.lit(sf_dir.date).cast("date"), 1))
    return df


def prices(spark: SparkSession, sf_dir: str, grain: str = "week", key: str = "p_brand") -> DataFrame:
    """(date, ticker, close, volume): volume-weighted price of each key and period; money is summed as decimals."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", F.expr(key).alias("ticker"))
    money = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    return (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.to_date(F.date_trunc(grain, "l_shipdate")).alias("date"), "ticker")
        .agg((money / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"))
    )


CROSS = "p_brand || '/' || p_type"


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, tier1, tier2): every brand and type in use."""
    return table(spark, sf_dir, "part").select(F.expr(CROSS).alias("ticker"), F.col("p_type").alias("tier1"), F.col("p_brand").alias("tier2")).distinct()


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, tag, axis, ord): the words of the parts' names, by brand."""
    words = table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker"), F.posexplode(F.split("p_name", " ")).alias("ord", "tag"))
    return words.select("ticker", "tag", F.when(F.col("ord") == 0, "Style").otherwise("Sector").alias("axis"), "ord").distinct()


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(broker, account, symbol, quantity, avg_price, market_value, open_pnl): signed lots; returned lines are short."""
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    joined = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    )
    return joined.select(
        F.col("c_mktsegment").alias("broker"),
        F.col("c_nationkey").cast("string").alias("account"),
        F.col("p_brand").alias("symbol"),
        (sign * F.col("l_quantity")).alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("avg_price"),
        (sign * F.col("l_extendedprice")).cast("decimal(18,2)").alias("market_value"),
        F.when(F.col("l_linenumber") < 7, sign * (F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_discount").cast("decimal(4,2)"))).alias("open_pnl"),
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that results do not depend on the order of sums."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def signed_sum(c: Column) -> Column:
    return F.sum(c).cast("double")
