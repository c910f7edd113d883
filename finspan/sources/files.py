"""Landed files as tables: exports, statements and snapshots of brokers and vendors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOLDING = T.StructType([T.StructField(c, T.StringType()) for c in ("broker", "account", "symbol")] + [T.StructField(c, T.DoubleType()) for c in ("quantity", "avg_price", "market_value")])


def conform(df: DataFrame, schema: T.StructType, aliases: dict[str, str] | None = None) -> DataFrame:
    """The columns of a schema by exact name in any case, else by the first header that contains an alias; bad values and absent columns become null."""
    names = {c.lower().strip(): c for c in df.columns}

    def find(field: T.StructField) -> Column:
        hits = [names[field.name.lower()]] if field.name.lower() in names else [c for k, c in names.items() for part, to in (aliases or {}).items() if to == field.name and part in k]
        c = F.col(f"`{hits[0]}`").try_cast(field.dataType) if hits else F.lit(None).cast(field.dataType)
        if isinstance(field.dataType, T.DoubleType):
            c = F.when(~F.isnan(c), c)
        return c.alias(field.name)

    return df.select(*map(find, schema.fields))


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    if absent := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, or an error with some of the keys that occur more than once."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"keys repeated: {[tuple(r)[:-1] for r in twice]}")
    return df


def read_export(spark: SparkSession, path: str, schema: T.StructType, aliases: dict[str, str] | None = None) -> DataFrame:
    """A CSV export with a header; all columns are read as text, so that nothing is inferred."""
    return conform(spark.read.csv(path, header=True), schema, aliases)


def read_statement(spark: SparkSession, path: str, row: str = "OpenPosition") -> DataFrame:
    """Holdings of an XML statement: one element a lot, values in attributes."""
    raw = "_accountId string, _symbol string, _position string, _costBasisPrice string, _positionValue string"
    df = spark.read.format("xml").option("rowTag", row).schema(raw).load(path)
    number = lambda c: F.col(c).try_cast("double")
    return df.select(F.lit("statement").alias("broker"), F.col("_accountId").alias("account"), F.trim("_symbol").alias("symbol"), number("_position").alias("quantity"), number("_costBasisPrice").alias("avg_price"), number("_positionValue").alias("market_value")).where("quantity <> 0")


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    """Holdings of JSON account files: positions with long and short quantities; those of none go."""
    schema = "account string, positions array<struct<symbol: string, longQuantity: double, shortQuantity: double, averagePrice: double, marketValue: double>>"
    df = spark.read.schema(schema).json(path, multiLine=True).select("account", F.explode("positions").alias("p"))
    quantity = F.coalesce("p.longQuantity", F.lit(0.0)) - F.coalesce("p.shortQuantity", F.lit(0.0))
    return df.select(F.lit("accounts").alias("broker"), "account", F.trim("p.symbol").alias("symbol"), quantity.alias("quantity"), F.col("p.averagePrice").alias("avg_price"), F.col("p.marketValue").alias("market_value")).where("quantity <> 0")


def holdings(parts: list[DataFrame], saved: DataFrame | None = None) -> DataFrame:
    """All brokers' holdings with `stale`; a broker that is only in the last saved holdings is taken from there."""
    fresh = parts[0]
    for p in parts[1:]:
        fresh = fresh.unionByName(p, allowMissingColumns=True)
    fresh = fresh.withColumn("stale", F.lit(False))
    if saved is None:
        return fresh
    old = saved.join(fresh.select("broker").distinct(), "broker", "left_anti").withColumn("stale", F.lit(True))
    return fresh.unionByName(old, allowMissingColumns=True)


def labelled_holdings(df: DataFrame, least: float = 100.0) -> DataFrame:
    """Rows without a symbol go if their value is under least, else they are called UNKNOWN."""
    blank = F.coalesce(F.trim("symbol") == "", F.lit(True))
    small = F.coalesce(F.abs("market_value") < least, F.lit(True))
    return df.where(~(blank & small)).withColumn("symbol", F.when(blank, "UNKNOWN").otherwise(F.col("symbol")))


def covered(prices: DataFrame, tickers: DataFrame, least: float = 0.9) -> DataFrame:
    """prices without null closes, or an error if fewer than least of the tickers have one."""
    known = prices.where("close is not null")
    n, got = tickers.select("ticker").distinct().agg(F.count("*")).first()[0], known.select("ticker").join(tickers, "ticker", "left_semi").agg(F.count_distinct("ticker")).first()[0]
    if got < least * n:
        raise ValueError(f"prices of {got} of {n} tickers")
    return known


def newest(df: DataFrame, at: str, key: str) -> DataFrame:
    """The rows of each key's newest snapshot."""
    last = df.groupBy(key).agg(F.max(at).alias(at))
    return df.join(last, [key, at], "left_semi")


def unloaded(wanted: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """What a resumed load still has to fetch."""
    return wanted.join(loaded.select(key), key, "left_anti")


def mock_prices(tickers: DataFrame, days: int, seed: int = 7) -> DataFrame:
    """(date, ticker, close, volume) by a seeded walk of hashed steps, the same at every run."""
    day = tickers.select("ticker").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(days))))
    u = (F.pmod(F.xxhash64("ticker", "i", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0 - 0.5) * 0.04
    path = F.exp(F.sum(u).over(Window.partitionBy("ticker").orderBy("i")))
    return day.select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("i") - 1).alias("date"), "ticker", (100 * path).alias("close"), (1000 + F.pmod(F.xxhash64("i", "ticker"), F.lit(500))).cast("double").alias("volume"))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Lines of JSON by a schema; a line that is none raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
